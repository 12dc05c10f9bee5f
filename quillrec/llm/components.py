"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrec.session import stage


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars around the least id of each of their components."""
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    if not pairs:
        return
    ids, places = np.unique(np.concatenate(pairs), return_inverse=True)
    places = places.reshape(-1, 2)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[places[:, 0]], label[places[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[places].ravel(), np.repeat(least, 2))
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node points to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id with a smaller one in reach of `links` (a, b: long), the least in reach.

    Links of a task are contracted in place first; then stars grow until nothing changes, a written table a round.
    """
    edges = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_contract, "u long, v long")
    edges, before = stage(edges.distinct()), None
    while True:
        shape = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if shape == before or not shape[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, edges = shape, stage(_small_star(_large_star(edges)))
