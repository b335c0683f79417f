"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import field, named, row_of, with_row

SHARD_PIECES, SOURCE_SHARE = 4_000, 0.5


def best_fit(sizes: list[int], sources: list[object], clusters: list[object], capacity: int, source_share: float = SOURCE_SHARE) -> list[int]:
    """Bin number of each piece, pieces being placed from the largest down.

    Bins are kept in order of residual; the search starts at the least residual that holds the piece and goes on to
    the next larger until a bin takes it.  A bin's cluster bitmap holds the duplicate clusters in it; a source's bit is
    set once that source fills `source_share` of the bin.  Either bit refuses a piece.  Nulls conflict with nothing.
    """
    shared: dict[object, int] = {}
    for c in clusters:
        shared[c] = shared.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in shared.items() if n > 1 and c is not None)}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    quota = max(1, int(capacity * source_share))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out = [0] * len(sizes)
    free: list[tuple[int, int]] = []
    in_clusters: list[int] = []
    full_sources: list[int] = []
    held: list[dict[object, int]] = []
    for i in order:
        size, c, s = sizes[i], cluster_bit.get(clusters[i], 0), source_bit.get(sources[i], 0)
        at = bisect_left(free, (size, -1))
        while at < len(free) and (in_clusters[free[at][1]] & c or full_sources[free[at][1]] & s):
            at += 1
        if at < len(free):
            residual, b = free.pop(at)
        else:
            residual, b = capacity, len(held)
            in_clusters.append(0)
            full_sources.append(0)
            held.append({})
        in_clusters[b] |= c
        if s:
            held[b][sources[i]] = held[b].get(sources[i], 0) + size
            if held[b][sources[i]] >= quota:
                full_sources[b] |= s
        out[i] = b
        insort(free, (residual - size, b))
    return out


def _pack_task(capacity: int, source_share: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("order", "ascending"), ("start", "ascending")])
        size = rows["size"].to_pylist()
        bins = best_fit(size, rows["source"].to_pylist(), rows["cluster"].to_pylist(), capacity, source_share)
        used: dict[int, int] = {}
        offset = []
        for b, n in zip(bins, size, strict=True):
            offset.append(used.get(b, 0))
            used[b] = offset[-1] + n
        return pa.table({"row": rows["row"], "start": rows["start"], "size": rows["size"], "shard": rows["shard"], "bin": pa.array(bins, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return run


def pack(docs: DataFrame, size: F.Column, source: F.Column, cluster: F.Column, capacity: int = 8192, key: str = "doc_id", source_share: float = SOURCE_SHARE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row for each piece of each document: docs' columns, start, size, shard, bin, offset.

    Pieces are whole documents, or runs of `capacity` tokens of a longer one.  Pieces are dealt by hash to shards of
    about `shard_pieces`, each packed alone by `best_fit`, so no source or cluster meets in one task; (shard, bin) names
    a bin and offset is the piece's place in it.  No bin exceeds the capacity, holds two pieces of one cluster (a long
    document's own pieces never meet, as all but its last fill a bin), or takes more of a source once that fills `source_share` of it.  A document
    of null or no size has one piece of size 0; null sources and clusters conflict with nothing; repeated rows are
    packed apart; an empty table gives an empty result.  docs' columns should leave out the text.
    """
    new = ("start", "size", "shard", "bin", "offset")
    keep = [c for c in docs.columns if c not in new]
    n = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0).cast("long"))
    rows = docs.select(row_of(docs, keep), n.alias("n"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"), F.xxhash64(named(key).cast("string")).alias("order"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0).cast("long")), F.lit(capacity).cast("long"))
    pieces = rows.withColumn("start", F.explode(starts)).withColumn("size", F.least(F.col("n") - F.col("start"), F.lit(capacity).cast("long")))
    total = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)))).first()[0] or 0
    shards = max(1, round(int(total) / shard_pieces))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("order", "start", F.lit(3)), F.lit(shards).cast("long"))).drop("n")
    out = pieces.groupBy("shard").applyInArrow(_pack_task(capacity, source_share), with_row(pieces.schema["row"].dataType, "start long, size long, shard long, bin long, offset long"))
    return out.select(*[field(c) for c in keep], *new)
