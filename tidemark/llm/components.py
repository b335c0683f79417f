"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import saved


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member's number for each of n items joined by the pairs left-right (minimum labels, halved until still)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a star for each of their components."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = local_roots(len(node), at[: len(a)], at[len(a) :])
        far = np.flatnonzero(root != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root for every node of edges (a long, b long): root is the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges are stars; each round's edges are a written table.
    Loops, repeated edges and an empty table are allowed; edges with a null end link nothing.
    """
    salt = 0x2545F491
    now = saved(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").bitwiseXOR(F.lit(salt)).alias("k")).agg(F.min(F.least("a", "b")).alias("m")).select(F.expr("k + 1 - 1").alias("k"), "m")
        large = both.where("b > a").withColumn("k", F.col("a").bitwiseXOR(F.lit(salt))).join(least, "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least = down.groupBy(F.col("a").bitwiseXOR(F.lit(salt)).alias("k")).agg(F.min("b").alias("m")).select(F.expr("k + 1 - 1").alias("k"), "m")
        small = down.withColumn("k", F.col("a").bitwiseXOR(F.lit(salt))).join(least, "k")
        step = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = saved(step, "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
