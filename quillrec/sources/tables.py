"""Readers: Parquet tables, raw CSV/TSV with explicit text schemas, typed through try_cast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATING_FILE = ("userId", "movieId", "rating", "timestamp")
ITEM_FILE = ("movieId", "title", "genres")
TAG_FILE = ("userId", "movieId", "tag", "timestamp")
RAW_FILES = {"ratings": "ratings.csv", "items": "movies.csv", "tags": "tags.csv"}
CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("channel", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Delimited file with a header, every column read as text and bound by name."""
    raw = spark.read.options(header=True, sep=sep, multiLine=True, escape='"').csv(path)
    return require_columns(raw, columns, path).select(*columns)


def find_raw_dir(spark: SparkSession, root: str) -> str:
    """`root` or its first sub-folder (by name) that holds all raw rating files, on any file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [root] + sorted(
        status.getPath().toString() for status in fs.listStatus(path) if status.isDirectory()
    )
    for folder in folders:
        if all(fs.exists(jvm.org.apache.hadoop.fs.Path(folder, name)) for name in RAW_FILES.values()):
            return folder
    raise FileNotFoundError(f"no folder under {root} holds {sorted(RAW_FILES.values())}")


def read_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three raw files as text tables with the engine's own column names."""
    folder = find_raw_dir(spark, root)
    names = {"userId": "user_id", "movieId": "item_id", "timestamp": "ts"}
    shapes = {"ratings": RATING_FILE, "items": ITEM_FILE, "tags": TAG_FILE}
    return {
        table: read_text_table(spark, f"{folder}/{RAW_FILES[table]}", columns).withColumnsRenamed(names)
        for table, columns in shapes.items()
    }


def read_ingredient_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated dictionary: ingredient, count, translated label."""
    raw = read_text_table(spark, path, ("ingredient", "count", "translated_ingredient"), sep="\t")
    return raw.select(
        F.lower(F.trim("ingredient")).alias("name"),
        F.trim(F.coalesce("translated_ingredient", F.lit(""))).alias("raw_label"),
        F.coalesce(F.col("count").try_cast("long"), F.lit(0)).alias("n"),
    )


def read_candidates(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """Candidate lists of one channel; other channels and null keys or scores are dropped."""
    df = require_columns(spark.read.parquet(path), CANDIDATE_SCHEMA.fieldNames(), path)
    return keep_channel(df, channel)


def keep_channel(df: DataFrame, channel: str) -> DataFrame:
    typed = df.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("item_id").cast("long").alias("item_id"),
        "channel",
        F.col("score").cast("double").alias("score"),
    )
    return typed.where(F.col("channel") == channel).dropna(subset=["user_id", "item_id", "score"])
