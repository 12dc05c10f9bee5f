"""Data quality: every group of checks is one (check, violations) table from as few passes as possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrec.operators.fuse import SEVEN_CHANNELS


def _as_rows(one_row: DataFrame) -> DataFrame:
    names = one_row.columns
    return one_row.select(*[F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "check", "violations")


def raise_on_violations(checks: DataFrame) -> None:
    """Fail with the names of the violated checks (a handful of rows)."""
    bad = checks.where(F.col("violations") > 0).collect()
    if bad:
        raise ValueError("quality checks failed: " + ", ".join(f"{row.check}={row.violations}" for row in bad))


def split_checks(ratings: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """No overlap, one test row per user, test users known in train, rows add up."""
    keys = ["user_id", "item_id", "ts"]
    tagged = train.select(*keys, F.lit(0).alias("t")).unionByName(test.select(*keys, F.lit(1).alias("t")))
    overlap = tagged.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("overlap")
    )
    users = tagged.groupBy("user_id").agg(F.sum("t").alias("tests"), F.count_if(F.col("t") == 0).alias("trains"))
    per_user = users.agg(
        F.count_if(F.col("tests") > 1).alias("several_test_rows"),
        F.count_if((F.col("tests") > 0) & (F.col("trains") == 0)).alias("test_user_not_in_train"),
    )
    enough = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.sum("n")).scalar()
    total = tagged.agg(F.count(F.lit(1))).scalar()
    rows = per_user.withColumn("row_difference", F.abs(F.coalesce(enough, F.lit(0)) - total))
    return _as_rows(rows).unionByName(_as_rows(overlap))


def candidate_checks(candidates: DataFrame, seen: DataFrame, channel: str, top_n: int) -> DataFrame:
    """Single channel, no null scores, at most top_n per user, nothing already seen."""
    rows = candidates.agg(
        F.count_if(F.col("channel") != channel).alias("other_channel"),
        F.count_if(F.col("score").isNull()).alias("null_score"),
    )
    long = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > top_n).alias("too_many")
    )
    leak = candidates.join(seen, ["user_id", "item_id"], "left_semi").agg(F.count(F.lit(1)).alias("seen_item"))
    return _as_rows(rows).unionByName(_as_rows(long)).unionByName(_as_rows(leak))


def fusion_checks(fused: DataFrame, top_n: int = 100, channels: Sequence[str] = tuple(SEVEN_CHANNELS)) -> DataFrame:
    flags = sum((F.col(f"is_{c}_recall") for c in channels[1:]), F.col(f"is_{channels[0]}_recall"))
    rows = fused.agg(
        F.count_if(F.col("recall_source_count") < 1).alias("no_source"),
        F.count_if(flags != F.col("recall_source_count")).alias("flag_mismatch"),
        F.count_if(F.col("merged_score").isNull()).alias("null_score"),
    )
    long = fused.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > top_n).alias("too_many")
    )
    return _as_rows(rows).unionByName(_as_rows(long))


def profile_checks(user_profile: DataFrame, item_profile: DataFrame, train: DataFrame, items: DataFrame) -> DataFrame:
    """Keys present and unique, one user row per train user, at least one item row per item."""
    users = user_profile.agg(
        F.count_if(F.col("user_id").isNull()).alias("null_user"),
        (F.count(F.lit(1)) - F.count_distinct("user_id")).alias("repeated_user"),
    ).withColumn(
        "user_difference",
        F.abs(user_profile.agg(F.count(F.lit(1))).scalar() - train.agg(F.count_distinct("user_id")).scalar()),
    )
    missing = items.select("item_id").distinct().join(item_profile, "item_id", "left_anti")
    rows = item_profile.agg(F.count_if(F.col("item_id").isNull()).alias("null_item"))
    lost = missing.agg(F.count(F.lit(1)).alias("missing_item"))
    return _as_rows(users).unionByName(_as_rows(rows)).unionByName(_as_rows(lost))


def assert_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"feature columns must be numeric: {wrong}")
    return df


def feature_checks(train_features: DataFrame, candidate_features: DataFrame, recall: DataFrame) -> DataFrame:
    """Labels 0 or 1, some positives, candidate rows within 5 % of the recall rows."""
    bad_label = lambda df, name: df.agg(F.count_if(~F.col("label").isin(0, 1)).alias(name))
    train = train_features.agg(
        F.count_if(~F.col("label").isin(0, 1)).alias("train_label"),
        (F.count_if(F.col("label") == 1) == 0).cast("int").alias("no_positive"),
    )
    n = candidate_features.agg(F.count(F.lit(1))).scalar()
    m = recall.agg(F.count(F.lit(1)).alias("m"))
    close = m.select(((n < F.floor(F.col("m") * 0.95)) | (n > F.floor(F.col("m") * 1.05) + 1)).cast("int").alias("row_gap"))
    return _as_rows(train).unionByName(_as_rows(bad_label(candidate_features, "candidate_label"))).unionByName(_as_rows(close))


def metric_checks(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _as_rows(
        metrics.agg(*[F.count_if(~F.coalesce(F.col(c).between(0, 1), F.lit(False))).alias(c) for c in columns])
    )


def rank_checks(ranked: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """Positions start at 1 and are unique per user; unwanted columns are absent."""
    per_user = ranked.groupBy("user_id").agg(
        F.min("rank_position").alias("lo"),
        (F.count(F.lit(1)) - F.count_distinct("rank_position")).alias("repeats"),
    )
    rows = per_user.agg(
        F.count_if(F.col("lo") != 1).alias("start"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeated_position")
    )
    return _as_rows(rows.withColumn("forbidden_column", F.lit(len(set(forbidden) & set(ranked.columns)))))


def reference_checks(facts: DataFrame, key: str, dimension: DataFrame, name: str) -> DataFrame:
    """Rows whose non-null key is missing from the dimension."""
    lost = facts.where(F.col(key).isNotNull()).join(dimension.select(key).distinct(), key, "left_anti")
    return _as_rows(lost.agg(F.count(F.lit(1)).alias(name)))


def unique_checks(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Key values that occur more than once."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _as_rows(counts.agg(F.count_if(F.col("_n") > 1).alias(name)))
