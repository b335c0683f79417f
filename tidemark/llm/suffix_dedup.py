"""Suffix-array dedup over bytes: sorted suffixes whose neighbours agree on `length` bytes are repeated strings.

Only suffixes that the anchors and blocks of `windows` leave undecided are sorted.  Such a suffix travels as its first
`length` bytes.  Spark samples splitters and range-partitions the suffixes by these bytes; each bucket is put in order by
multikey quicksort, eight bytes at a time, and adjacent suffixes are compared byte by byte.  Equal suffixes may spread
over several buckets, so the outermost groups of each bucket, two rows at most, are compared across boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import windows as wd
from tidemark.llm.durable import saved
from tidemark.llm.rows import field, with_row

SMALL, STEP, BUCKET = 32, 1 << 13, 1 << 17
_SUFFIX = "suffix binary, rid long, rid2 int, lo int, live boolean"
_FOUND = "rid long, rid2 int, lo int, live boolean, suffix binary, m long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _suffix_task(shape: wd.Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in wd.window_batches(batch, shape, STEP):
                flat = x["data"][x["place"][:, None] + np.arange(shape.window)].reshape(-1)
                ends = np.arange(len(x["place"]) + 1, dtype=np.int32) * shape.window
                suffix = pa.Array.from_buffers(pa.binary(), len(x["place"]), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([suffix, *(pa.array(x[k]) for k in (*wd.ID, "lo", "live"))], names=["suffix", *wd.ID, "lo", "live"])

    return run


def multikey_quicksort(text: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix.

    Rows are split three ways by eight bytes of a pivot; those equal to it go on with the next eight.  A few rows are
    compared whole.
    """
    n, width = text.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    words = padded.view(">u8")
    order, todo = np.arange(n), [(0, n, 0)]
    while todo:
        a, b, k = todo.pop()
        if b - a < 2 or k == words.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= SMALL:
            order[a:b] = sorted(rows.tolist(), key=lambda r: (padded[r].tobytes(), r))
            continue
        x = words[rows, k]
        pivot = sorted((x[0], x[len(x) // 2], x[-1]))[1]
        less, more = x < pivot, x > pivot
        same = ~(less | more)
        i, j = a + int(less.sum()), b - int(more.sum())
        order[a:b] = np.concatenate((rows[less], rows[same], rows[more]))
        todo += [(a, i, k), (i, j, k + 1), (j, b, k)]
    return order


def _bucket_task(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Live suffixes of a bucket that agree with another one (m null), then its outermost groups: a member and their size m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        suffix = np.concatenate([np.frombuffer(b.column(0).buffers()[2], np.uint8)[b.column(0).offset * length :][: b.num_rows * length] for b in full]).reshape(-1, length)
        rid, rid2, lo, live = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in full]) for i in range(1, 5))
        order = multikey_quicksort(suffix)
        first = np.ones(len(order), dtype=bool)
        for a in range(1, len(order), STEP):
            b = min(len(order), a + STEP)
            first[a:b] = (suffix[order[a:b]] != suffix[order[a - 1 : b - 1]]).any(axis=1)
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        out = order[(size[group] > 1) & live[order]]
        ends = np.unique(group[[0, -1]])
        outer = order[np.flatnonzero(first)[ends]]
        rows = np.concatenate((out, outer))
        m = pa.array(np.concatenate((np.zeros(len(out), np.int64), size[ends])), mask=np.arange(len(rows)) < len(out))
        kept = pa.array([None] * len(out) + [suffix[r].tobytes() for r in outer], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (rid, rid2, lo, live)] + [kept, m], names=["rid", "rid2", "lo", "live", "suffix", "m"])

    return run


def _compare_neighbours(texts: DataFrame, shape: wd.Shape, total: int) -> DataFrame:
    """Live suffixes that agree with another one on the whole length; a bucket holds about BUCKET of the `total`."""
    every = texts.mapInArrow(_suffix_task(shape), _SUFFIX)
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    buckets = every.repartitionByRange(parts, "suffix", F.xxhash64(*wd.ID, "lo"))
    # written, so that both readers see the same buckets
    found = saved(buckets.mapInArrow(_bucket_task(shape.window), _FOUND), "buckets")
    outer = found.where("m is not null")
    across = outer.groupBy("suffix").agg(F.sum("m").alias("m"), F.collect_list(F.struct(*wd.ID, "lo", "live")).alias("rows"))
    met = across.where("m > 1").select(F.explode("rows").alias("x")).select("x.*").where("live")
    return found.where("m is null").select(*wd.ID, "lo").unionByName(met.select(*wd.ID, "lo")).distinct()


def _remove_task(shape: wd.Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n_bytes, n_removed, removed, kept = [], [], [], []
            at, run_of = wd.run_lists(batch.column("runs"))
            bounds = np.searchsorted(at, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                data = (texts[i].as_py() or "").encode()
                a, b = bounds[i], bounds[i + 1]
                n_bytes.append(len(data))
                if a == b:
                    n_removed.append(0)
                    removed.append([])
                    kept.append(data)
                    continue
                mask = wd.covered(len(data), run_of["lo"][a:b].astype(np.int64), run_of["n"][a:b].astype(np.int64), shape.window)
                start, stop = wd.spans_of(mask)
                n_removed.append(int(mask.sum()))
                removed.append([{"start": int(s), "stop": int(e)} for s, e in zip(start, stop, strict=True)])
                kept.append(np.frombuffer(data, np.uint8)[~mask].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, _SPANS), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "n_removed", "removed", "kept_bytes"],
            )

    return run


def remove_repeated_strings(docs: DataFrame, text: str = "text", length: int = 400, gram: int = 200, block: int = 8) -> DataFrame:
    """All rows of docs with n_bytes, n_removed, removed (maximal byte runs) and, for the text, kept_bytes.

    Texts are UTF-8 bytes.  A byte is removed if a string of `length` bytes over it also starts elsewhere, in the same
    text or another; strings are judged on the input, overlaps count, and no match crosses texts.  A null text is
    empty; texts under `length` bytes lose nothing; a row that occurs twice repeats itself; an empty table gives an
    empty result.  Kept bytes may cut a character, so they are binary.  Columns of docs named like a result column are
    replaced by it.  `gram` (bytes in an anchor) and `block` (strings asked together) set only the cost.
    """
    shape = wd.Shape(length, gram, "byte", block)
    base = wd.keyed(docs, text)
    runs = wd.repeated_runs(base, shape, _compare_neighbours, by_blocks=True)
    done = wd.with_runs(base, runs).select("text", "runs", "row")
    out = done.mapInArrow(_remove_task(shape), with_row(base.schema["row"].dataType, "n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, kept_bytes binary"))
    new = ["n_bytes", "n_removed", "removed", "kept_bytes"]
    return out.select(*[field(c) for c in docs.columns if c not in new and c != text], *new)
