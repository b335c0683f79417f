"""Embedding near-dedup by dual traversal of cover trees.

Vectors are put on the unit sphere, where cosine >= t means distance <= sqrt(2 - 2 t).  The top of the tree is made in
Spark: rows go to the nearest of a few pivots, cells too far apart for their radii are never paired, and each remaining
pair of cells (cut to chunks) is one task.  Inside a task each chunk gets a tree whose levels halve the covering radius,
and pairs of nodes are dropped, accepted whole or opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, local_roots
from tidemark.llm.durable import saved
from tidemark.llm.vectors import matrix, usable

LEAF, CELL_ROWS, CHUNK_ROWS, MAX_PIVOTS, SLACK = 32, 4_096, 2_048, 1_024, 1e-9


class CoverTree:
    """Nodes as arrays: center, radius, first and end of the node's rows in `order`, children (none for a leaf)."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.children: list[list[int]] = []
        todo = [(self._add(np.arange(len(x)), x[0]), 1.0)] if len(x) else []
        while todo:
            node, reach = todo.pop()
            rows = self.rows[node]
            if len(rows) <= LEAF or self.radius[node] < 1e-12:
                continue
            while reach >= self.radius[node]:
                reach /= 2
            alone, left = [], rows
            while len(left):  # greedy cover: the first row left takes all rows within reach
                near = np.linalg.norm(self.x[left] - self.x[left[0]], axis=1) <= reach
                if near.sum() == 1:
                    alone.append(left[0])
                else:
                    child = self._add(left[near], self.x[left[0]])
                    self.children[node].append(child)
                    todo.append((child, reach / 2))
                left = left[~near]
            for a in range(0, len(alone), LEAF):  # rows far from all others share leaves around their parent's center
                self.children[node].append(self._add(np.array(alone[a : a + LEAF]), self.center[node]))

    def _add(self, rows: np.ndarray, center: np.ndarray) -> int:
        self.center.append(center)
        self.radius.append(float(np.linalg.norm(self.x[rows] - center, axis=1).max()))
        self.rows.append(rows)
        self.children.append([])
        return len(self.rows) - 1


def close_pairs(a: CoverTree, b: CoverTree, reach: float, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (of a, of b) of all pairs with inner product >= least; with `same`, a row may meet itself."""
    if not a.rows or not b.rows:
        return
    ca, cb, ra, rb = np.array(a.center), np.array(b.center), np.array(a.radius), np.array(b.radius)
    frontier = [(0, 0)]
    while frontier:
        i, j = np.array(frontier).T
        frontier = []
        for s in range(0, len(i), 4096):
            u, v = i[s : s + 4096], j[s : s + 4096]
            d = np.linalg.norm(ca[u] - cb[v], axis=1)
            for u, v in zip(*((w[d - ra[u] - rb[v] <= reach + SLACK]) for w in (u, v)), strict=True):
                kids_a, kids_b = a.children[u], b.children[v]
                if not kids_a and not kids_b:
                    p, q = np.nonzero(a.x[a.rows[u]] @ b.x[b.rows[v]].T >= least)
                    yield a.rows[u][p], b.rows[v][q]
                elif kids_a and (not kids_b or ra[u] >= rb[v]):
                    frontier += [(k, v) for k in kids_a]
                else:
                    frontier += [(u, k) for k in kids_b]


def _tile_task(threshold: float) -> Callable[[pa.Table], pa.Table]:
    reach = float(np.sqrt(2 - 2 * threshold))

    def run(rows: pa.Table) -> pa.Table:
        side, cid, weight, x = rows["side"].to_numpy(), rows["cid"].to_numpy(), rows["m"].to_numpy(), matrix(rows["v"])
        first = np.flatnonzero(side <= 1)
        same = bool((side == 0).any())
        second = first if same else np.flatnonzero(side == 2)
        a = CoverTree(x[first])
        b = a if same else CoverTree(x[second])
        links, left, right = np.zeros(len(cid), np.int64), [], []
        for p, q in close_pairs(a, b, reach, threshold, same):
            p, q = first[p], second[q]
            apart = p != q
            p, q = p[apart], q[apart]
            np.add.at(links, p, weight[q])
            if not same:
                np.add.at(links, q, weight[p])
            left.append(p)
            right.append(q)
        none = np.zeros(0, np.int64)
        root = local_roots(len(cid), np.concatenate([none, *left]), np.concatenate([none, *right]))
        hit = np.flatnonzero(links)
        return pa.table({"cid": cid[hit], "root": cid[root[hit]], "links": links[hit]})

    return run


def _pivot_task(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, far = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            fits = np.flatnonzero(batch.column(2).value_lengths().to_numpy() == pivots.shape[1])  # others share a cell
            if len(fits) and len(pivots):
                gap = np.sqrt(np.maximum(0, 2 - 2 * matrix(batch.column(2).take(pa.array(fits))) @ pivots.T))
                cell[fits] = gap.argmin(axis=1)
                far[fits] = gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["cid", "grp", "v", "m", "cell", "far"])

    return run


def _pair_task(pivots: np.ndarray, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep the pairs of cells (columns a, b, ra, rb) that some close pair of rows could join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            gap = np.linalg.norm(pivots[a] - pivots[b], axis=1) if len(pivots) else np.zeros(len(a))
            yield batch.filter(pa.array(gap <= batch.column("ra").to_numpy() + batch.column("rb").to_numpy() + reach))

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector; links are pairs of one label with cosine >= threshold.

    Equal vectors of a label are one class with a weight, so copies cost nothing.  n_links counts the other vectors
    linked directly; component_id is the least vec_id reachable; kept says whether that is the row's own.  Vectors that
    are null, zero or hold null or non-finite components, and rows with a null label, link with nothing; vectors of
    different length neither; an empty table gives an empty result.  A null vec_id names no component but its own.
    """
    every = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("e"), F.col(f"`{label}`").alias("label"))
    part = usable(every.where(F.col("label").isNotNull()), "e")
    # two lanes name equal vectors of a label; a number given out once names them from there on
    part = part.withColumn("grp", F.xxhash64("label", F.size("e"))).withColumn("k1", F.xxhash64("label", "e")).withColumn("k2", F.xxhash64(F.lit(1), F.reverse("e"), "label"))
    # a power of two, so that no digit changes: squares of the rest neither overflow nor vanish
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("e", lambda x: F.abs(x.cast("double")))))))
    sound = F.transform("e", lambda x: x.cast("double") / F.col("scale"))
    norm = F.sqrt(F.aggregate("sound", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("sound", lambda x: x / F.col("norm"))
    # max of equal vectors: any of them
    classes = part.groupBy("k1", "k2", "grp").agg(F.max("e").alias("e"), F.count("*").alias("m"), F.min("id").alias("id")).withColumn("cid", F.monotonically_increasing_id())
    classes = classes.withColumn("scale", scale).withColumn("sound", sound).withColumn("norm", norm)
    classes = saved(classes.select("cid", "k1", "k2", "grp", unit.alias("v"), "m", "id"), "vectors")
    largest = classes.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n_pivots = min(MAX_PIVOTS, max(1, -(-largest // CELL_ROWS)))
    dims = F.size("v")
    common = classes.groupBy(dims.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    chosen = classes.where(dims == (common.d if common else 0)).orderBy("k1", "k2").select("v").limit(n_pivots).collect()
    pivots = np.array([r.v for r in chosen], dtype=np.float64).reshape(len(chosen), common.d if common else 0)
    celled = classes.select("cid", "grp", "v", "m").mapInArrow(_pivot_task(pivots), "cid long, grp long, v array<double>, m long, cell int, far double")
    cells = celled.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("n") / CHUNK_ROWS).cast("int"))
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    left = cells.select("grp", F.col("cell").alias("a"), F.col("radius").alias("ra"), F.col("parts").alias("ap"))
    right = cells.select("grp", F.col("cell").alias("b"), F.col("radius").alias("rb"), F.col("parts").alias("bp"))
    met = left.join(right, "grp").where("a <= b").select("grp", "a", "b", "ra", "rb", "ap", "bp")  # at most MAX_PIVOTS cells a group
    met = met.mapInArrow(_pair_task(pivots, reach), met.schema).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ap") - 1)))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("bp") - 1))).where("a < b or i <= j")
    tile = F.struct("grp", "a", "i", "b", "j")
    own = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    routes = met.select("grp", F.col("a").alias("cell"), F.col("i").alias("part"), tile.alias("tile"), F.when(own, 0).otherwise(1).alias("side"))
    routes = routes.unionByName(met.where(~own).select("grp", F.col("b").alias("cell"), F.col("j").alias("part"), tile.alias("tile"), F.lit(2).alias("side")))
    placed = celled.join(cells.select("grp", "cell", "parts"), ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    sent = placed.join(routes, ["grp", "cell", "part"]).select("tile", "side", "cid", "v", "m")
    found = saved(sent.groupBy("tile").applyInArrow(_tile_task(threshold), "cid long, root long, links long"), "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "k1", "k2", "m", "id").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id")).select(F.expr("root + 1 - 1").alias("root"), "component_id")
    of = named.join(least, "root").join(links, "cid", "left").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    linked = part.select("id", "k1", "k2").join(of, ["k1", "k2"]).select("id", "n_links", "component_id")
    v, n = F.col("e"), F.col("label")
    good = v.isNotNull() & n.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    lone = every.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(lone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
