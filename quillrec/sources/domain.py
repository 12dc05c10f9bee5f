"""Domain view of the TPC-H-like tables: interactions, items, tags, feedback, vectors, texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrec.functions import text as tx
from quillrec.functions.scores import ab_group, unit
from quillrec.operators import fuse, hot, itemcf, prepare, profiles
from quillrec.session import small_tasks, stage, still_there

EXPERIMENT = "default"
# How event types stand in for feedback types.
FEEDBACK_TYPES = {
    "click": "click",
    "purchase": "like",
    "view": "exposure",
    "error": "dislike",
    "signup": "rating",
}


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


class Domain:
    """Lazy DataFrames over one data folder; nothing runs until a result is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        small_tasks(spark)

    def _staged(self, name: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
        """A foundation table, written once per application and data folder and then read by every query."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STAGED or not still_there(_STAGED[key]):
            _STAGED[key] = stage(build(), *partition_by)
        return _STAGED[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw_ratings(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
            tx.epoch_seconds(F.col("l_shipdate")).alias("ts"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        return prepare.clean_ratings(self.raw_ratings)

    @cached_property
    def items(self) -> DataFrame:
        words = F.split(F.col("p_name"), " ")
        genres = F.concat(F.array(F.concat(F.lit("type-"), F.lower("p_type")), F.lower("p_brand")), words)
        year = (F.lit(1990) + F.col("p_partkey") % 30).cast("int")
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat("p_name", F.lit(" ("), year.cast("string"), F.lit(")")).alias("title"),
            F.col("p_name").alias("clean_title"),
            year.alias("year"),
            genres.alias("genres"),
            F.size(genres).alias("genre_count"),
            words.alias("ingredients"),
            F.col("p_size").alias("minutes"),
            F.col("p_retailprice").alias("calories"),
            F.col("p_size").cast("double").alias("protein_pct"),
            (F.col("p_partkey") % 3 == 0).cast("int").alias("has_image"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        own = self.items.select("item_id", "genres", "ingredients")
        kinds = own.select(
            "item_id", F.explode(F.slice("genres", 1, 2)).alias("tag"), F.lit("genre").alias("tag_type")
        )
        words = own.select("item_id", F.explode("ingredients").alias("tag"), F.lit("recipe_tag").alias("tag_type"))
        return kinds.unionByName(words).distinct()

    @cached_property
    def split(self) -> DataFrame:
        return self._staged("split", lambda: prepare.leave_one_out(self.ratings), "is_test")

    @cached_property
    def train(self) -> DataFrame:
        return prepare.train_rows(self.split)

    @cached_property
    def test(self) -> DataFrame:
        return prepare.test_rows(self.split)

    @cached_property
    def seen(self) -> DataFrame:
        return self.train.select("user_id", "item_id").distinct()

    @cached_property
    def user_profile(self) -> DataFrame:
        return self._staged("user_profile", lambda: profiles.build_user_profile(self.train, self.items))

    @cached_property
    def item_profile(self) -> DataFrame:
        return self._staged("item_profile", lambda: profiles.build_item_profile(self.train, self.items, self.tags))

    @cached_property
    def item_texts(self) -> DataFrame:
        """(item_id, text): everything known about an item in one lower-case text."""
        parts = [F.col("clean_title"), F.col("title"), tx.pipe_join(F.col("genres")), tx.pipe_join(F.col("tags"))]
        return self.item_profile.select("item_id", tx.content_text(*parts).alias("text"))

    def hot_lists(self, top_n: int = 50) -> DataFrame:
        pairs = self.train.select("user_id", "item_id")
        return hot.hot_recall(pairs, self.item_profile, pairs, top_n)

    @cached_property
    def candidates(self) -> DataFrame:
        """Lists of the two channels that need no model: co-occurrence and popularity."""

        def build() -> DataFrame:
            return itemcf.itemcf_recall(self.train).unionByName(self.hot_lists())

        return self._staged("candidates", build)

    @cached_property
    def fused(self) -> DataFrame:
        return self._staged("fused", lambda: fuse.fuse(self.candidates))

    @cached_property
    def feedback(self) -> DataFrame:
        """Events as feedback: (event_id, user_id, item_id, feedback_type, feedback_value, ts, run_id)."""
        kind = F.create_map(*[F.lit(x) for pair in FEEDBACK_TYPES.items() for x in pair])
        kind = F.try_element_at(kind, F.col("event_type"))
        value = F.when(kind == "rating", F.floor(F.col("value") % 5) + 1)
        return self.table("events").select(
            "event_id",
            "user_id",
            F.get_json_object("props", "$.k").try_cast("long").alias("item_id"),
            kind.alias("feedback_type"),
            value.cast("double").alias("feedback_value"),
            tx.epoch_seconds(F.col("ts")).alias("ts"),
            ab_group(F.lit(EXPERIMENT), F.col("user_id")).alias("run_id"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("item_id"), unit(F.col("embedding")).alias("vector"), "label"
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")
