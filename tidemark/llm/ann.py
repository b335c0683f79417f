"""Approximate nearest neighbours: few stable projections in a kd-tree, verified until a chi-square test says stop.

Inner product is made distance by one more component, sqrt(M^2 - |x|^2) with M the largest norm.  A projection on
`dims` Gaussian directions then scales every squared distance by a chi-square variable of `dims` degrees, so once the
next projected distance is large against the k-th best verified one, a better row would have shown up before with
probability `confidence`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, usable

DIMS, CONFIDENCE, LEAF, SEED = 8, 0.98, 1_024, 7
SHARD_ROWS = 20_000
BLOCK, WILD_BLOCK = 512, 16
TINY = 2.0**-1070


def chi_square_quantile(p: float, dims: int) -> float:
    """Point below which a chi-square variable of an even number of degrees lies with probability p."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


class KdTree:
    """Leaves of a kd-tree: row order, leaf bounds, and each leaf's box."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        parts, done = [np.arange(len(points))], []
        while parts:
            rows = parts.pop()
            if len(rows) <= leaf:
                done.append(rows)
                continue
            x = points[rows]
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            order = np.argpartition(x[:, axis], len(rows) // 2)
            parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.order = np.concatenate(done)
        self.bounds = np.concatenate(([0], np.cumsum([len(r) for r in done])))
        self.low = np.array([points[r].min(axis=0) for r in done])
        self.high = np.array([points[r].max(axis=0) for r in done])

    def box_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(axis=1)


class Shard:
    """Rows of one shard in the order of the kd-tree over their projections.

    Projections and distances are those of vectors divided by `scale`, a power of two as large as the largest component
    of all, so that no square overflows; scores are of the vectors as they are.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, scale: float = 1.0) -> None:
        d = x.shape[1]
        directions = np.random.Generator(np.random.PCG64(SEED)).standard_normal((d + 1, DIMS))
        small = x / scale
        square = (small * small).sum(axis=1)
        self.tree = KdTree(np.column_stack((small, np.sqrt(np.maximum(0, norm * norm - square)))) @ directions, LEAF)
        order = self.tree.order
        self.ids, self.x, self.small = ids[order], x[order], small[order]
        # What a product taken in another order of sums may be off, for a query of length 1.
        self.slack = 2 * (d + 2) * np.finfo(float).eps * np.sqrt(square[order])
        self.norm, self.scale, self.directions = norm, scale, directions[:d]
        self.wild = math.isinf(scale * scale * norm * norm)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of the nearest k found for each query, a block of queries at a time."""
        step = WILD_BLOCK if self.wild else BLOCK
        parts = [self._block(query_ids[i : i + step], q[i : i + step], k, stop) for i in range(0, len(q), step)]
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

    def _block(self, query_ids: np.ndarray, q: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each round verifies every open query's next leaf by projected distance; queries at one leaf share a product.

        A query is done once its next leaf fails the chi-square test.  Products steer the search with their rounding
        allowed for; what may be among the k best is then computed anew, one row at a time.
        """
        tree, (n, d) = self.tree, q.shape
        power = np.frexp(np.abs(q).max(axis=1))[1]
        unit = np.ldexp(q, -power[:, None])
        length = np.sqrt((unit * unit).sum(axis=1))
        small = q / self.scale
        exponent = math.frexp(self.scale)[1] - 1
        square, ratio = (small * small).sum(axis=1) + self.norm * self.norm, np.ldexp(1.0, power - exponent)
        tiny = d * (TINY + np.ldexp(TINY, -power - exponent))  # what vanishes below the least double, here and in the vectors' own products
        box = np.array([tree.box_distances(p) for p in small @ self.directions])
        leaves = np.argsort(box, axis=1, kind="stable")
        box = np.take_along_axis(box, leaves, axis=1)
        best, limit, going, kept = np.full((n, k), -np.inf), np.full(n, np.inf), np.arange(n), []
        for at in range(leaves.shape[1]):
            going = going[box[going, at] < stop * limit[going]]
            if not len(going):
                break
            going = going[np.argsort(leaves[going, at], kind="stable")]
            for here in np.split(going, np.flatnonzero(np.diff(leaves[going, at])) + 1):
                a, b = tree.bounds[leaves[here[0], at]], tree.bounds[leaves[here[0], at] + 1]
                product = unit[here] @ self.small[a:b].T
                product[query_ids[here, None] == self.ids[a:b]] = np.nan
                slack = length[here, None] * self.slack[a:b] + tiny[here, None]
                least = np.where(np.isnan(product), -np.inf, product - slack)
                best[here] = np.partition(np.concatenate((best[here], least), axis=1), -k, axis=1)[:, -k:]
                floor = np.full(len(here), -np.inf) if self.wild else best[here].min(axis=1)
                who, row = np.nonzero(product + slack >= floor[:, None])
                kept.append((here[who], row + a, (product + slack)[who, row]))
            worst = best[going].min(axis=1)
            limit[going] = np.where(worst > -np.inf, np.maximum(0, square[going] - 2 * worst * ratio[going]), np.inf)
        if not kept:
            return query_ids[:0], query_ids[:0], np.zeros(0)
        who, row, most = (np.concatenate(column) for column in zip(*kept, strict=True))
        if not self.wild:
            may = most >= best.min(axis=1)[who]
            who, row = who[may], row[may]
        score = np.concatenate([(self.x[row[i : i + 65_536]] * q[who[i : i + 65_536]]).sum(axis=1) for i in range(0, max(1, len(row)), 65_536)])
        if self.wild:  # products beyond all numbers: infinite, or none
            score[np.isnan(score)] = -np.inf
        order = np.lexsort((self.ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        return query_ids[who[top]], self.ids[row[top]], score[top]


def _search_task(k: int, norm: float, scale: float, stop: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by shard, length and side: a shard's rows are gathered and indexed once, then its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, index = None, [], None
        for batch in batches:
            shard, dim, side = (batch.column(f).to_numpy() for f in ("shard", "dim", "side"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if now != (shard[a], dim[a]):
                    now, parts, index = (shard[a], dim[a]), [], None
                ids, v = batch.column("id").slice(a, b - a).to_numpy(), matrix(batch.column("v").slice(a, b - a))
                if side[a] == 0:
                    parts.append((ids, v))
                    continue
                if index is None and parts:
                    index = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), norm, scale)
                if index is not None:
                    found = index.search(ids, v, k, stop)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows found of largest inner product, nearest first.

    Every usable row is indexed, in shards of about SHARD_ROWS rows, each sent and indexed once; every query goes to
    every shard and streams past it in Arrow batches, so no task holds more than a shard and a batch.  Vectors that are null, zero or hold null or non-finite
    components take no part; vectors of another length than the query's are no candidates; rows with the query's own
    vec_id are left out, and of query rows that repeat a vec_id the least vector searches.  Ties go to the smaller
    vec_id; fewer candidates than k give all of them; an empty table gives an empty result.
    """
    rows = usable(vectors, vector).where(F.col(f"`{vec_id}`").isNotNull())
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(f"`{vector}`", lambda x: x.cast("double")).alias("v"), is_query.alias("q")).withColumn("dim", F.size("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    scale = 2.0 ** math.floor(math.log2(size.largest)) if size.n else 1.0
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
    norm = rows.agg(F.sqrt(F.max(square))).first()[0] or 0.0
    shards = max(1, round(size.n / SHARD_ROWS))
    stop = chi_square_quantile(confidence, DIMS)
    queries = rows.where("q").groupBy("id", "dim").agg(F.min("v").alias("v"))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards).cast("long")).alias("shard"), "dim", F.lit(0).alias("side"), "id", "v")
    right = queries.select(F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), "dim", F.lit(1).alias("side"), "id", "v")
    dealt = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "side")
    found = dealt.mapInArrow(_search_task(k, norm, scale, stop), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
