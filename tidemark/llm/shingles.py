"""Exact Jaccard similarity of word-shingle sets, as the last check of near-duplicate pairs.

Groups that share a block are first joined to one member each, and pairs are made only of what is still in different
components, so a large group of near copies does not make all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytehash as bh
from tidemark.llm.components import components
from tidemark.llm.durable import saved
from tidemark.llm.license_scan import LOWER

WORDS, PARTS = 5, 64
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, in order) of each text of a slice, text after text, and where each text's begin.

    Words are cut at white space and ASCII letters lower-cased; a text of fewer words is one shingle.
    """
    low = LOWER[data]
    starts, stops, first = bh.word_spans(low, offsets)
    codes = bh.word_codes(low, starts, stops)
    length = np.diff(first)
    total = np.where(length >= words, length - words + 1, np.minimum(length, 1))
    text = np.repeat(np.arange(len(length)), total)
    at = np.arange(len(text)) - np.repeat(np.cumsum(total) - total, total) + first[text]
    value = bh.mix(bh.Rolling(codes, 1).spans(at, np.minimum(at + words, first[text + 1])))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(length) + 1))


def class_of(value: np.ndarray, bounds: np.ndarray, lane: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One hash a set, another for each lane; zero for the empty set."""
    total = np.concatenate((np.zeros(1, _U), np.cumsum(bh.mix(value ^ _U(lane)))))
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size > 0, bh.mix(total[bounds[1:]] - total[bounds[:-1]] + bh.mix(size)), _U(0)).view(np.int64)


def similar_sizes(a: str, b: str) -> F.Column:
    """Whether the sizes of two sets leave room for a similarity of 4/5."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 4/5 or more, by counting their common shingles."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    one = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    met = pairs.join(one, "a").join(two, "b")
    return met.where(9 * F.size(F.array_intersect("ga", "gb")) >= 4 * (F.size("ga") + F.size("gb"))).select("a", "b")


def _part_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, s and parts from each set's shared shingles."""
    for batch in batches:
        lists = batch.column(1)
        size = lists.value_lengths().to_numpy().astype(np.int64)
        part = np.repeat(np.arange(len(size)), size) * PARTS + (lists.flatten().to_numpy() & (PARTS - 1))
        parts = np.bincount(part, minlength=len(size) * PARTS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * PARTS), pa.array(parts))], names=["cls", "s", "parts"])


def shared_counts(sets: DataFrame) -> DataFrame:
    """cls and s: how many of a set's shingles stand in another of the sets too; parts: the same for each of PARTS classes of hashes.

    Two of the sets have min(s) in common at most, and no more than the sum of min(parts) over the classes.
    """
    gram = sets.select("cls", F.explode("grams").alias("gram"))
    alone = gram.groupBy(F.col("gram").bitwiseXOR(F.lit(7)).alias("k")).agg(F.count("*").alias("m"), F.min("cls").alias("cls")).where("m = 1").groupBy("cls").agg(F.collect_list(F.col("k").bitwiseXOR(F.lit(7))).alias("alone"))
    shared = sets.join(alone, "cls", "left").select("cls", F.when(F.col("alone").isNull(), F.col("grams")).otherwise(F.array_except("grams", "alone")).alias("grams"))
    return shared.mapInArrow(_part_task, "cls long, s int, parts array<int>")


def may_be_similar(one: str, two: str, sizes: F.Column) -> F.Column:
    """Whether the parts of two sets, where both are known, leave room for a similarity of 4/5; sizes: the sum of the sets' sizes."""
    most = F.aggregate(F.zip_with(one, two, lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    return F.col(one).isNull() | F.col(two).isNull() | (9 * most >= 4 * sizes)


def with_counts(roots: DataFrame, shared: DataFrame) -> DataFrame:
    """c, root, s, parts of every class of roots (c, root) or of shared."""
    return roots.join(shared, F.col("c") == F.col("cls"), "full").select(F.coalesce("c", "cls").alias("c"), "root", "s", "parts")


def similar_edges(met: DataFrame, check: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame], lane_distance: int, few: int) -> DataFrame:
    """Edges (a, b) between classes that join what checked pairs join; met: tok, cls, n, lane, head, head_n, gap.

    head is a class of tok that may be near, gap its distance.  `check` takes pairs (a, b) and returns those that are
    near.  First each class meets the nearest of its heads, then its other heads, as far as they are in other
    components, and last all of a tok whose classes still are in several.  After the first step the sets of a tok of
    more than `few` classes are counted: what a set has alone, and what it lacks of each class of hashes, leave two
    sets only so many shingles to share, so almost no pair of unlike ones is made, however large the tok.
    """
    heads = met.where("cls <> head").where(similar_sizes("n", "head_n"))
    nearest = heads.groupBy("cls").agg(F.min(F.struct("gap", "head")).getField("head").alias("head"))
    edges = saved(check(nearest.select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b")).distinct()), "stars")

    def mixed(known: DataFrame, *columns: str) -> DataFrame:
        """tok, x, main, size and `columns` of known, for the rows of toks whose classes are in several components."""
        item = F.struct("cls", "n", "lane", F.coalesce("root", "cls").alias("root"))
        rows = met.join(known, F.col("cls") == F.col("c"), "left").select("tok", item.alias("x"), *columns)
        rows = rows.withColumn("m", F.count("*").over(Window.partitionBy("tok", "x.root")))
        tok = Window.partitionBy("tok")
        rows = rows.withColumn("main", F.max(F.struct("m", "x.root")).over(tok).getField("root")).withColumn("size", F.count("*").over(tok))
        return rows.where("m < size").select("tok", "x", "main", "size", *columns)

    roots = saved(components(edges), "roots").withColumnRenamed("node", "c")
    crowded = saved(mixed(roots).where(F.col("size") > few).select(F.col("x.cls").alias("c")).distinct(), "crowded")
    shared = saved(shared_counts(sets_of(crowded)), "shared")
    known = with_counts(roots, shared)
    one, two = F.struct(F.col("cls").alias("c"), "n"), F.struct(F.col("head").alias("c"), F.col("head_n").alias("n"))
    other = heads.select(F.greatest(one, two).alias("x"), F.least(one, two).alias("y")).distinct().select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), (F.col("x.n") + F.col("y.n")).alias("sizes"))
    other = other.join(known.select(F.col("c").alias("a"), F.col("root").alias("ra"), F.col("parts").alias("pa")), "a", "left").join(known.select(F.col("c").alias("b"), F.col("root").alias("rb"), F.col("parts").alias("pb")), "b", "left")
    other = other.where(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))).where(may_be_similar("pa", "pb", F.col("sizes")))
    edges = edges.unionByName(saved(check(other.select("a", "b")), "more-stars"))
    every = mixed(with_counts(components(edges).withColumnRenamed("node", "c"), shared), "s", "parts")
    every = saved(every.where("s IS NULL OR 5 * s >= 4 * x.n"), "mixed")
    apart = every.where("x.root <> main")
    near = similar_sizes("x.n", "y.n") & (F.bit_count(F.col("x.lane").bitwiseXOR(F.col("y.lane"))) <= lane_distance)
    near &= F.expr("s IS NULL OR t IS NULL OR 9 * least(s, t) >= 4 * (x.n + y.n)") & may_be_similar("parts", "others", F.col("x.n") + F.col("y.n"))
    # a pair with one end in the main component is made once, from its other end
    pairs = apart.select("tok", "x", "s", "parts").join(every.select("tok", F.col("x").alias("y"), "main", F.col("s").alias("t"), F.col("parts").alias("others")), "tok").where("x.root <> y.root and (y.root = main or x.cls < y.cls)").where(near)
    last = check(pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    return edges.unionByName(saved(last, "similar"))
