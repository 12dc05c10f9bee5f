"""A training corpus from documents: known languages, one of each group of near copies, no repeated passages, no
benchmark items, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrec.llm import decontaminate, language, ngram_join, packing, shards, substring
from quillrec.llm.queries import TOKEN_LIMIT, table, tokenizer
from quillrec.session import stage

LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or with no likely language; null and empty texts have no letter.

    Repeated rows are judged one by one; an empty table gives none.
    """
    return language.accepted(docs, language.fit(docs), LEAST_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies, and one of equal rows of an id (or of a null id).

    Null and empty texts are alone and stay. Rows of one id with different texts stay together: they are one document.
    """
    found = ngram_join.near_duplicates(docs)
    docs = shards.without(docs, stage(found.where("id <> component").select("id").distinct()))
    ids = docs.groupBy(shards.id_key().alias("id")).agg(F.count("*").alias("n"))
    often = stage(ids.where("n > 1").select("id"))
    if often.isEmpty():
        return docs
    key = "_" + max([*docs.columns, ""], key=len)  # longer than any column's name
    rows = docs.withColumn(key, shards.id_key())
    rows = rows.join(often.select(F.col("id").alias(key)), key, "left_semi").dropDuplicates(["doc_id", "text"])
    return shards.without(docs, often).unionByName(rows.drop(key))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in an earlier document; drop documents of which nothing is left.

    A text that loses nothing stays as it is, null and empty ones too; n_chars follows the text. Rows travel as one
    column, so their names cannot clash with the operator's.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    cut = substring.dedup_substrings(rows, "row")
    changed = F.size("spans") > 0
    own = {x: F.col("row").getField(x) for x in docs.columns}
    own["text"] = F.when(changed, F.col("kept")).otherwise(own["text"])
    if "n_chars" in own:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(changed, length).otherwise(own["n_chars"])
    return cut.where(~changed | (F.col("kept") != "")).select(*[x.alias(name) for name, x in own.items()])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark, all rows of an id that does."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return shards.without(docs, stage(leaks.select(shards.id_key().alias("id")).distinct()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most TOKEN_LIMIT tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), TOKEN_LIMIT, end_id=1)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# No SQL: languages come from a trained network. The tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, build in STAGES:
        docs = stage(build(spark, docs, sf_dir))
    return docs
