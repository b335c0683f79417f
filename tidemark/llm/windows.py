"""Windows of a fixed number of tokens that start more than once in a corpus.

A window's Rabin-Karp hash decides whether it repeats, but most windows of a corpus occur once and need not travel.
Each window selects one anchor, the smallest of the hashed grams inside it; equal windows select equal anchors at the
same offset.  So Spark first counts anchors (about two for each window length), each with the run of windows around it:

* an anchor that occurs once: none of its windows repeats;
* an anchor whose whole context (the tokens of all its windows) occurs again: all of its windows repeat;
* the rest is undecided.  It is cut to blocks of a few windows and asked again, with the tokens that all windows of a
  block share as the anchor (`blocks`), or its windows are looked at one by one.

Equality of contexts and windows is that of two independent hashes of 64 and 32 bits; an anchor's single hash only
proposes.
Every shuffle is keyed by a hash and pre-aggregated, or is a join whose frequent keys (fewer than HEAVY, whatever
the data) are dealt to several parts, so a passage that a third of all texts share puts no unbounded group into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytehash as bh
from tidemark.llm.durable import saved, small_batches
from tidemark.llm.rows import named, row_of

#: rid, rid2: the row; g: anchor; c, d: context; lo, n: first window and number of windows; at: anchor's place after lo.
RUNS = "rid long, rid2 int, g long, c long, d int, lo int, n int, at int, live boolean"
ID = ("rid", "rid2")
HEAVY, LIGHT = 1_024, 1_000
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


@dataclass(frozen=True)
class Shape:
    """window: tokens in a window; gram: tokens in an anchor; unit: 'word' or 'byte'; block: windows asked together."""

    window: int
    gram: int
    unit: str
    block: int = 8


def tokens(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Token codes of a slice and the token number at which each text starts (one more entry than texts)."""
    if unit == "byte":
        return bh.BYTE_CODES[0][data], offsets
    starts, stops, first = bh.word_spans(data, offsets)
    return bh.word_codes(data, starts, stops), first


def _contexts(codes: np.ndarray, lo: np.ndarray, n: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the tokens of n windows from lo on, and of the anchor's place among them."""
    shape = (n.astype(np.uint64) << _U(32)) ^ at.astype(np.uint64)
    c, d = (bh.mix(bh.mix(bh.Rolling(codes, lane).spans(lo, lo + n - 1 + window)) ^ shape) for lane in (1, 0))
    return c.view(np.int64), (d >> _U(32)).astype(np.uint32).view(np.int32)


def anchors(codes: np.ndarray, first: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Runs of windows that select the same anchor: text number and the fields of RUNS."""
    w, k = shape.window, shape.gram
    length = np.diff(first)
    if len(codes) < w or not (length >= w).any():
        none = np.zeros(0, np.int64)
        return {f: none for f in ("text", "lo", "n", "at", "c")} | {"g": none.view(np.uint64), "d": none.astype(np.int32)}
    gram = bh.mix(bh.Rolling(codes, 0).every(k))
    key = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    chosen = bh.sliding_min(key, w - k + 1)
    text = np.repeat(np.arange(len(length)), length)[: len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) + w <= first[1:][text])
    anchor = (chosen[start] & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, n, anchor = start[cut], np.diff(np.concatenate((cut, [len(start)]))), anchor[cut]
    c, d = _contexts(codes, lo, n, anchor - lo, w)
    text = text[lo]
    return {"text": text, "lo": lo - first[text], "n": n, "at": anchor - lo, "g": gram[anchor], "c": c, "d": d}


def blocks(codes: np.ndarray, first: np.ndarray, runs: dict[str, np.ndarray], shape: Shape) -> dict[str, np.ndarray]:
    """Runs (text, lo, n, at, live) cut to blocks of `shape.block` windows, counted from the anchor.

    A block's anchor is what all its windows share, whether or not the run holds all of them, so that equal windows
    lie in blocks of equal anchors.
    """
    b, w = shape.block, shape.window
    back, least = runs["at"] // b, (runs["at"] - runs["n"] + 1) // b  # block numbers of a run's first and last window
    size = back - least + 1
    of = np.repeat(np.arange(len(size)), size)
    number = back[of] - (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size))
    anchor = runs["lo"][of] + runs["at"][of]
    lo = np.maximum(runs["lo"][of], anchor - number * b - b + 1)
    end = np.minimum(runs["lo"][of] + runs["n"][of] - 1, anchor - number * b)
    text = runs["text"][of]
    begin = first[text]
    core = begin + anchor - number * b
    g = bh.mix(bh.mix(bh.Rolling(codes, 0).spans(core, core + w - b + 1)) ^ number.astype(np.uint64))
    at, n = anchor - lo, end - lo + 1
    c, d = _contexts(codes, begin + lo, n, at, w)
    return {"text": text, "lo": lo, "n": n, "at": at, "g": g, "c": c, "d": d, "live": runs["live"][of]}


def _run_batch(rid: np.ndarray, rid2: np.ndarray, row: int, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    of = row + found["text"]
    live = found.get("live", np.ones(len(of), dtype=bool))
    small = [pa.array(found[f].astype(np.int32)) for f in ("lo", "n", "at")]
    return pa.RecordBatch.from_arrays(
        [pa.array(rid[of]), pa.array(rid2[of]), pa.array(found["g"].view(np.int64)), pa.array(found["c"]), pa.array(found["d"]), *small, pa.array(live.astype(bool))],
        names=["rid", "rid2", "g", "c", "d", "lo", "n", "at", "live"],
    )


def _anchor_task(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rid2 = (batch.column(f).to_numpy() for f in ID)
            for row, _, data, offsets in bh.text_slices(batch.column("text")):
                codes, first = tokens(data, offsets, shape.unit)
                yield _run_batch(rid, rid2, row, anchors(codes, first, shape))

    return run


def run_lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row numbers and fields of a list<struct> column."""
    flat = column.flatten()
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    return np.repeat(np.arange(len(column)), size), fields


def listed_runs(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """First row, bytes, token codes, token offsets and listed runs of each slice of a batch (columns text, runs)."""
    runs = batch.column("runs")
    for row, end, data, offsets in bh.text_slices(batch.column("text")):
        text, run = run_lists(runs.slice(row, end - row))
        if len(text):
            codes, first = tokens(data, offsets, shape.unit)
            yield row, data, codes, first, {"text": text, "live": run["live"].astype(bool)} | {f: run[f].astype(np.int64) for f in ("lo", "n", "at")}


def _block_task(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rid2 = (batch.column(f).to_numpy() for f in ID)
            for row, _, codes, first, runs in listed_runs(batch, shape):
                yield _run_batch(rid, rid2, row, blocks(codes, first, runs, shape))

    return run


def window_batches(batch: pa.RecordBatch, shape: Shape, step: int = 1 << 17) -> Iterator[dict[str, np.ndarray]]:
    """Windows of the runs listed beside each text, some `step` at a time: rid, rid2, lo, live, two hashes, and the slice's bytes and places."""
    rid, rid2 = (batch.column(f).to_numpy() for f in ID)
    for row, data, codes, first, runs in listed_runs(batch, shape):
        rolling = [bh.Rolling(codes, lane) for lane in (1, 0)]
        # a slice of many runs is cut again: memory follows the texts, not the number of windows
        for part in np.array_split(np.arange(len(runs["text"])), max(1, int(runs["n"].sum()) // step)):
            n = runs["n"][part]
            at = np.repeat(runs["lo"][part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            of = np.repeat(runs["text"][part], n)
            place = first[of] + at
            k1, k2 = (bh.mix(r.spans(place, place + shape.window)) for r in rolling)
            k1, k2 = k1.view(np.int64), (k2 >> _U(32)).astype(np.uint32).view(np.int32)
            yield {"rid": rid[row + of], "rid2": rid2[row + of], "lo": at.astype(np.int32), "live": np.repeat(runs["live"][part], n), "k1": k1, "k2": k2, "data": data, "place": place}


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """rid, rid2, text and row (all other columns): 96 bits of hash of the whole row name it, so that equal rows share them.

    Hashes pass over nulls, so which columns are null is hashed too.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    body = named(text).cast("string")
    whole = [body, *[named(c).cast("string") for c in others]]
    whole += [c.isNull() for c in whole]
    return docs.select(F.xxhash64(*whole).alias("rid"), F.hash(*whole).alias("rid2"), body.alias("text"), row_of(docs, others) if others else F.lit(None).cast("struct<none:int>").alias("row"))


def meet(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows (with ID and lo) whose key is among keys (on, m): m counts the rows of a key, total all rows of all keys.

    Keys of more than total / HEAVY rows are fewer than HEAVY, so they are broadcast; their rows need no partner and are
    dealt by their own hash.  Other keys are joined.
    """
    frequent = F.col("m") > max(LIGHT, total // HEAVY)
    heavy = F.broadcast(keys.where(frequent).select(*on, F.lit(True).alias("hot")))
    light = keys.where(~frequent).select(F.col(on[0]).alias("dealt"), *on[1:], F.lit(True).alias("met"))
    # part of the key itself: a constant beside it would be folded out of the shuffle's keys; what a hot row meets is no matter
    dealt = rows.join(heavy, on, "left").withColumn("dealt", F.when(F.col("hot"), F.xxhash64(*ID, "lo")).otherwise(F.col(on[0])))
    return dealt.join(light, ["dealt", *on[1:]], "left").where("hot OR met").select(*rows.columns)


def _settle(runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Runs (ID, lo, n) of live runs whose windows all repeat, and what is left: ID, runs (lo, n, at, live) to be looked at.

    Of equal contexts one is left, live only if it stands alone.
    """
    again = saved(runs.groupBy(F.col("g").bitwiseXOR(F.lit(0x5DEECE66D)).alias("k")).agg(F.count("*").alias("m")).where("m > 1"), f"{name}-anchors")
    repeated = again.select(F.col("k").bitwiseXOR(F.lit(0x5DEECE66D)).alias("g"), "m")
    dup = saved(meet(runs, repeated, ["g"], again.agg(F.sum("m")).first()[0] or 0), f"{name}-runs")
    classes = saved(dup.groupBy("g", "c", "d").agg(F.count("*").alias("m"), F.max("live").alias("live"), *[F.first(f).alias(f) for f in (*ID, "lo", "n", "at")]), f"{name}-contexts")
    whole = classes.where("m > 1").select("g", "c", "d", "m")
    all_repeat = meet(dup.where("live"), whole, ["g", "c", "d"], dup.count()).select(*ID, "lo", "n")
    alone = (F.col("m") == 1) & F.col("live")
    groups = classes.groupBy(F.col("g").bitwiseXOR(F.lit(0x2545F491)).alias("k")).agg(F.count("*").alias("m"), F.max(alone).alias("open")).where("open")
    groups = groups.select(F.col("k").bitwiseXOR(F.lit(0x2545F491)).alias("g"), "m")
    left = meet(classes.withColumn("live", alone).drop("m"), groups, ["g"], classes.count())
    return all_repeat, left.groupBy(*ID).agg(F.collect_list(F.struct("lo", "n", "at", "live")).alias("runs"))


def repeated_runs(base: DataFrame, shape: Shape, repeated_windows: Callable[[DataFrame, Shape, int], DataFrame], by_blocks: bool = False) -> DataFrame:
    """rid, rid2, lo, n: the runs of windows of `base` (columns rid, rid2, text, row) that start more than once in the corpus.

    `repeated_windows` takes texts with their undecided runs, and how many windows these have, and returns rid, rid2, lo
    of the live windows that repeat; with by_blocks, undecided runs are first asked again block by block.
    """
    texts = base.select(*ID, "text")

    def beside(lists: DataFrame) -> DataFrame:
        return texts.join(lists, list(ID)).dropDuplicates(list(ID))  # one of each set of equal rows

    found, left = _settle(texts.mapInArrow(_anchor_task(shape), RUNS), "anchor")
    if by_blocks:
        open_texts = saved(beside(left), "open-texts")  # later steps read only these
        more, left = _settle(open_texts.mapInArrow(_block_task(shape), RUNS), "block")
        found, texts = found.unionByName(more), open_texts.select(*ID, "text")
    left = saved(left, "undecided")
    total = left.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["n"]))).first()[0] or 0
    return found.unionByName(repeated_windows(beside(left), shape, total).select(*ID, "lo", F.lit(1).alias("n")))


def every_window(base: DataFrame, shape: Shape, repeated_windows: Callable[[DataFrame, Shape, int], DataFrame]) -> DataFrame:
    """The same result without anchors: each window of each text is looked at."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) if shape.unit == "word" else F.octet_length("text")
    n = F.greatest(words - shape.window + 1, F.lit(0))
    runs = base.select(*ID, "text", F.array(F.struct(F.lit(0).alias("lo"), n.alias("n"), F.lit(0).alias("at"), F.lit(True).alias("live"))).alias("runs")).where(words >= shape.window)
    total = runs.agg(F.sum(n.cast("long"))).first()[0] or 0
    return repeated_windows(runs, shape, total).select(*ID, "lo", F.lit(1).alias("n")).distinct()


def with_runs(base: DataFrame, runs: DataFrame) -> DataFrame:
    """base with a list column `runs`; texts without any keep a null.  Equal rows give each run once."""
    return base.join(runs.groupBy(*ID).agg(F.collect_set(F.struct("lo", "n")).alias("runs")), list(ID), "left")


def covered(n_tokens: int, lo: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which tokens lie in a repeated window."""
    edge = np.zeros(n_tokens + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
