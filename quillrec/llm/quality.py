"""Quality and toxicity by hierarchical empirical Bayes.

Document evidence: for each hashed word and text shape, the rate of an outcome among labelled documents that have it,
shrunk to the overall rate; only what its credible interval keeps apart from that rate speaks, by its log odds. Site
evidence: labelled outcomes of all documents counted by host and by host and path, each level shrunk to the one
above with a beta prior whose strength is the moment estimate over the level's groups. A document's probability adds
its own evidence to the log odds of its site.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.llm.words import LOWER, WordHashes, split_words
from quillrec.operators.skew import salted_join
from quillrec.session import stage

OUTCOMES = ("good", "toxic")
FEATURES = 1 << 18
MAX_LABELLED = 50_000  # labelled documents the word evidence is fitted on, at most about so many
WORD_STRENGTH = 10.0  # prior observations of a word
Z = 2.5
LEAST_WEIGHT = 0.7  # weaker features are many and go together: their sum would drown the strong ones
PUNCTUATION = b""".,;:!?"'()[]{}<>|*#$%&-_/\\`~+=^@"""
MOST_COMMON_SIDE = 2.0  # log odds that a text's features add at most towards what most documents are
SHAPES = 64  # features for the shape of a text stand before those of words


def features(known: WordHashes, data: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a text: its words without outer punctuation, and its shape."""
    words = split_words(data.translate(LOWER))
    if not words:
        return np.zeros(1, np.int64)
    bare = {w.strip(PUNCTUATION) for w in words}
    hashed = known.of(list(bare))
    stripped = len(data) - len(data.translate(None, PUNCTUATION))
    lengths = (
        min(15, int(8 * len(bare) / len(words))),
        16 + min(15, int(40 * stripped / len(data))),
        32 + min(15, int(math.log2(len(words)))),
        48 + min(15, int(len(data) / len(words))),
    )
    numbers = (hashed % np.uint64(FEATURES - SHAPES)).astype(np.int64) + SHAPES
    return np.unique(np.concatenate([numbers, lengths]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents that have each feature, and how many of them have each outcome."""
    known, total = WordHashes(), np.zeros((FEATURES, 1 + len(OUTCOMES)), np.int64)
    for batch in batches:
        outcomes = np.stack([batch.column(i).to_numpy() for i in range(1, 1 + len(OUTCOMES))], 1)
        for data, own in zip(batch.column(0).to_pylist(), outcomes, strict=True):
            total[features(known, data or b"")] += np.concatenate([[1], own])
    found = np.flatnonzero(total[:, 0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(found), *(pa.array(total[found, i]) for i in range(total.shape[1]))], ["feature", "n", *OUTCOMES]
    )


def evidence_weights(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Log odds that each feature adds (features x outcomes), 0 where its interval holds the base rate."""
    n = counts[:, :1] + WORD_STRENGTH
    mean = (counts[:, 1:] + WORD_STRENGTH * base) / n
    spread = Z * np.sqrt(mean * (1 - mean) / (n + 1))
    low, high = np.maximum(mean - spread, 1e-6), np.minimum(mean + spread, 1 - 1e-6)
    bound = np.where(low > base, low, np.where(high < base, high, base))
    bound, base = np.clip(bound, 1e-6, 1 - 1e-6), np.clip(base, 1e-6, 1 - 1e-6)
    weights = np.log(bound / (1 - bound)) - np.log(base / (1 - base))
    weights[(counts[:, 0] == 0) | (np.abs(weights).max(axis=1) < LEAST_WEIGHT)] = 0
    return weights.astype(np.float32)


def fit_evidence(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and the common side of each outcome, from about MAX_LABELLED labelled documents, chosen by a hash of doc_id."""
    n = labels.count()
    share = min(1.0, MAX_LABELLED / max(1, n))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sample.select("text", *OUTCOMES).mapInArrow(_counts, "feature long, n long, good long, toxic long")
    rows = rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *OUTCOMES)]).toArrow()  # FEATURES rows at most
    counts = np.zeros((FEATURES, 1 + len(OUTCOMES)))
    counts[rows.column("feature").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in ("n", *OUTCOMES)], 1)
    # Every document has one feature of each shape; those of one kind hold all documents once.
    total = counts[:16].sum(axis=0)
    base = total[1:] / max(1.0, total[0])
    return evidence_weights(counts, base), np.where(base > 0.5, 1.0, -1.0)


def evidence(weights: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Log odds of each outcome from the weights of a text's features; `common` is 1 or -1, the side of most texts."""
    towards = np.maximum(weights * common, 0).sum(axis=0)
    return common * (np.minimum(towards, MOST_COMMON_SIDE) + np.minimum(weights * common, 0).sum(axis=0))


def _scores(shared, kind: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (weights, common) = WordHashes(), shared.value
        for batch in batches:
            sums = [evidence(weights[features(known, data or b"")], common) for data in batch.column(3).to_pylist()]
            sums = np.array(sums, np.float64).reshape(-1, len(OUTCOMES))
            columns = [pa.array(sums[:, i]) for i in range(len(OUTCOMES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "host", "site", *OUTCOMES])

    return score, f"doc_id {kind}, host string, site string, good double, toxic double"


def site_rates(sites: DataFrame, outcome: str) -> DataFrame:
    """(host, site, rate) from (host, site, n, <outcome>): posterior mean of the outcome at each site.

    Levels are the whole table, host and site. Without labelled rows the rate is one half.
    """
    share = F.sum(outcome) / F.when(F.sum("n") > 0, F.sum("n"))
    above, parent = None, sites.agg(F.coalesce(share, F.lit(0.5)).alias("rate")).scalar()
    for keys in (["host"], ["host", "site"]):
        groups = sites.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(outcome).alias("k"))
        if above is None:
            groups = groups.withColumn("m", parent)
        else:
            groups = groups.join(above.select("host", F.col("rate").alias("m")), "host")
        spread = F.col("m") * (1 - F.col("m"))
        moments = groups.where("n > 0").agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("s"),
            F.sum(spread).alias("a"),
            F.sum(spread * (F.col("n") - 1)).alias("b"),
        )
        rho = F.greatest(F.lit(1e-4), F.least(F.lit(0.5), (F.col("s") - F.col("a")) / F.col("b")))
        strength = moments.select(1 / F.when(F.col("b") > 0, rho).otherwise(1e-4) - 1).scalar()
        rate = (strength * F.col("m") + F.col("k")) / (strength + F.col("n"))
        above = stage(groups.select(*keys, rate.alias("rate")))
    return above


def _log_odds(rate: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))
    return F.log(safe / (1 - safe))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, p_good, p_toxic, keep (likely good and not likely toxic) of every row of `docs` (doc_id, text, ...).

    `labels`: doc_id, good, toxic (0/1); repeated labels of a document count as good if all are, toxic if any is;
    null outcomes and ids are left out. `host` and `path` are columns of `docs`; null counts as empty. Null and empty
    texts have no word; repeated rows stay; other columns are ignored; an empty table gives none. Without labels
    every probability is one half.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and good is not null and toxic is not null").groupBy("doc_id").agg(
        F.min(F.col("good").cast("long")).alias("good"), F.max(F.col("toxic").cast("long")).alias("toxic")
    )
    labels = stage(labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.coalesce(host.cast("string"), F.lit(""))
    site = F.concat_ws("/", place, F.coalesce(path.cast("string"), F.lit("")))
    rows = docs.select("doc_id", place.alias("host"), site.alias("site"), F.col("text").cast("binary").alias("text"))
    score, schema = _scores(spark.sparkContext.broadcast(fit_evidence(docs, labels)), kind)
    scored = stage(rows.mapInArrow(score, schema))
    marks = labels.select("doc_id", F.col("good").alias("g"), F.col("toxic").alias("t"))
    sites = scored.select("doc_id", "host", "site").join(marks, "doc_id", "left").groupBy("host", "site").agg(
        F.count("g").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(x) for c, x in (("g", "good"), ("t", "toxic"))]
    )
    sites = stage(sites)
    good, toxic = (
        site_rates(sites, x).select("site", _log_odds(F.col("rate")).alias(f"{x}_site")) for x in OUTCOMES
    )
    judged = salted_join(scored.drop("host"), good.join(toxic, "site"), "site", "left")
    p = [1 / (1 + F.exp(-(F.col(f"{x}_site") + F.col(x)))) for x in OUTCOMES]
    judged = judged.select("doc_id", p[0].alias("p_good"), p[1].alias("p_toxic"))
    return judged.withColumn("keep", (F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5))
