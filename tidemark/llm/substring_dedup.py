"""Substring dedup: passages of at least `window` words that repeat anywhere are removed wherever they stand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import windows as wd
from tidemark.llm.durable import saved
from tidemark.llm.rows import field, with_row

REMOVED = "n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string"


def _window_task(shape: wd.Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in wd.window_batches(batch, shape):
                names = ["k1", "k2", *wd.ID, "lo", "live"]
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for k in names], names=names)

    return run


def _count_windows(texts: DataFrame, shape: wd.Shape, total: int) -> DataFrame:
    """Live windows whose two hashes occur more than once."""
    every = texts.mapInArrow(_window_task(shape), "k1 long, k2 int, rid long, rid2 int, lo int, live boolean")
    again = every.groupBy(F.col("k1").bitwiseXOR(F.lit(1)).alias("k"), F.col("k2").alias("l")).agg(F.count("*").alias("m")).where("m > 1")
    again = again.select(F.col("k").bitwiseXOR(F.lit(1)).alias("k1"), F.expr("l + 1 - 1").alias("k2"), "m")
    return wd.meet(every.where("live"), saved(again, "window-counts"), ["k1", "k2"], total)


def _remove_task(shape: wd.Shape, as_is: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column("text"), batch.column("runs")
            n_words, n_removed, removed, kept = [], [], [], []
            at, run_of = wd.run_lists(runs)
            bounds = np.searchsorted(at, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                words = (texts[i].as_py() or "").encode().split()
                a, b = bounds[i], bounds[i + 1]
                n_words.append(len(words))
                if a == b:
                    n_removed.append(0)
                    removed.append([])
                    kept.append((texts[i].as_py() or "") if as_is else b" ".join(words).decode())
                    continue
                mask = wd.covered(len(words), run_of["lo"][a:b].astype(np.int64), run_of["n"][a:b].astype(np.int64), shape.window)
                start, stop = wd.spans_of(mask)
                n_removed.append(int(mask.sum()))
                removed.append([{"start": int(s), "stop": int(e)} for s, e in zip(start, stop, strict=True)])
                left = zip(np.concatenate(([0], stop)), np.concatenate((start, [len(words)])), strict=True)
                kept.append(b" ".join(w for s, e in left for w in words[s:e]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "removed", "kept_text"],
            )

    return run


def remove_repeated_passages(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 8, as_is: bool = False, screen: bool = True) -> DataFrame:
    """All rows of docs with n_words, n_removed, removed (maximal word intervals) and, for the text, kept_text.

    Words are maximal runs of characters other than ASCII white space, unchanged.  A word is removed if a window of
    `window` consecutive words over it also starts elsewhere, in the same text or another; windows are judged on the
    input.  A null text has no words and an empty kept_text; texts under `window` words lose nothing; a row that
    occurs twice repeats itself and so loses every window; an empty table gives an empty result.  Columns of docs
    named like a result column are replaced by it.  `gram` (words in an anchor) sets only the cost.  Kept words are joined by one
    space; with as_is, a text that loses nothing is kept with its own white space.
    """
    shape = wd.Shape(window, gram, "word")
    base = wd.keyed(docs, text)
    runs = (wd.repeated_runs if screen else wd.every_window)(base, shape, _count_windows)
    done = wd.with_runs(base, runs).select("text", "runs", "row")
    out = done.mapInArrow(_remove_task(shape, as_is), with_row(base.schema["row"].dataType, REMOVED))
    new = ["n_words", "n_removed", "removed", "kept_text"]
    return out.select(*[field(c) for c in docs.columns if c not in new and c != text], *new)
