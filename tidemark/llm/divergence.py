"""How the sources of a language differ in their words: exact counts behind a sketch of document frequencies.

A count-min sketch of (language, term) document frequencies is built in tasks, shipped as the cells that are not zero and
merged block by block.  A cell is never below the true frequency, so a term with a cell below `min_docs` cannot be kept
and is left out before anything is shuffled.  What survives is counted exactly; groups are then compared by a join of the
terms that both have, and by histograms of counts for those that only one has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.durable import saved, small_batches
from tidemark.llm.rows import named

DEPTH, BLOCK, ENTRIES = 2, 1 << 16, 1 << 18
#: Cells a row of the sketch: 32 a document, within these bounds.  What is broadcast is a bit a cell, 64 MB at most.
LEAST, MOST = BLOCK, 1 << 28
#: Group tables up to this many rows are broadcast.
SMALL = 1 << 16
#: A-Z lower-cased; other ASCII than letters parts terms; bytes of longer characters stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def cells(lang: str, found: list[bytes], width: int) -> np.ndarray:
    """The cell of each term in each row of the sketch."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    digests = b"".join(xxhash.xxh3_128_digest(t, seed) for t in found)
    return np.frombuffer(digests, np.uint64).reshape(-1, DEPTH) & np.uint64(width - 1)


def _frequency_task(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shipped(docs: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        at = np.concatenate([cells(lang, list(n), width) for lang, n in docs.items()])
        n = np.concatenate([np.fromiter(x.values(), np.int64, len(x)) for x in docs.values()])
        for row in range(DEPTH):
            places, back = np.unique(at[:, row], return_inverse=True)
            sums = np.bincount(back, weights=n).astype(np.int64)
            blocks, first = np.unique(places // BLOCK, return_index=True)
            parts = list(zip(blocks.tolist(), np.split(places % BLOCK, first[1:]), np.split(sums, first[1:]), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row * (width // BLOCK) + b for b, _, _ in parts], pa.int64()),
                    pa.array([p.astype(np.uint16).tobytes() for _, p, _ in parts], pa.binary()),
                    pa.array([s.astype(np.int64).tobytes() for _, _, s in parts], pa.binary()),
                ],
                names=["block", "places", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, Counter] = {}
        held = 0
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = docs.setdefault(lang, Counter())
                held -= len(own)
                own.update(set(terms(text.as_py())))
                held += len(own)
                if held >= ENTRIES:
                    yield from shipped(docs)
                    docs, held = {}, 0
        if held:
            yield from shipped(docs)

    return run


def _merge_task(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum each block's parts, which come one after another; a bit a cell is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])

        block, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for b, places, docs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block, total = b, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(places.as_py(), np.uint16)] += np.frombuffer(docs.as_py(), np.int64)
        if block is not None:
            yield done()

    return run


def possible(docs: DataFrame, min_docs: int, width: int) -> np.ndarray:
    """One bit a cell: whether the merged sketch reaches min_docs there.  docs has text (binary) and lang."""
    parts = docs.select("text", "lang").mapInArrow(_frequency_task(width), "block long, places binary, docs binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_task(min_docs), "block long, bits binary")
    bits = np.zeros((DEPTH * width // BLOCK, BLOCK // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(DEPTH, -1)


def survives(bits: np.ndarray, lang: str, found: list[bytes]) -> np.ndarray:
    at = cells(lang, found, bits.shape[1] * 8)
    keep = np.ones(len(found), bool)
    for row in range(DEPTH):
        keep &= (bits[row, at[:, row] >> np.uint64(3)] >> (np.uint64(7) - (at[:, row] & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return keep


def _count_task(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, source, term, n, docs) of terms that may be kept; a row without a term for each group seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def shipped(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                found = list(n)
                found = [t for t, keep in zip(found, survives(bits, lang, found), strict=True) if keep]
                k = len(found) + 1
                columns = [[lang] * k, [source] * k, [None, *(t.decode("utf-8", "replace") for t in found)]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns), *(pa.array([0, *map(x.__getitem__, found)], pa.int64()) for x in (n, docs))], names=["lang", "source", "term", "n", "docs"]
                )

        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                own = Counter(terms(text.as_py()))
                n.update(own)
                docs.update(own.keys())
                held += len(n)
                if held >= ENTRIES:
                    yield from shipped(groups)
                    groups, held = {}, 0
        yield from shipped(groups)

    return run


def _small(df: DataFrame) -> DataFrame:
    """A saved group table, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def count_terms(docs: DataFrame, min_docs: int = 30, text: str = "text", lang: str = "lang", source: str = "source", width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts of the terms in at least min_docs documents of their language, and every (lang, source) group.

    Counts: lang, source, term, n (occurrences in the group), n_lang (in the language), leads (one row a lang and term).
    Groups: lang, source.  Both are tables in the shared folder.
    """
    small_batches(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(F.coalesce(named(text).cast("string"), empty).cast("binary").alias("text"), *(F.coalesce(named(c).cast("string"), empty).alias(a) for c, a in ((lang, "lang"), (source, "source"))))
    width = width or min(MOST, max(LEAST, 1 << (32 * rows.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(possible(rows, min_docs, width))
    found = rows.mapInArrow(_count_task(sent), "lang string, source string, term string, n long, docs long")
    exact = saved(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    term = Window.partitionBy("lang", "term")
    counts = exact.where(F.col("term").isNotNull()).select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("n_lang"), (F.min("source").over(term) == F.col("source")).alias("leads"))
    kept = saved(counts.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    return kept, saved(exact.where(F.col("term").isNull()).select("lang", "source"), "divergence-groups")


def _share(count: str, total: str, scale: int, prior: int) -> Column:
    """1 + floor(scale * (count + prior) / total), in decimals that hold any product; null if total is 0."""
    return F.expr(f"1L + CAST({scale} AS DECIMAL(12,0)) * CAST({count} + {prior} AS DECIMAL(20,0)) div nullif(CAST({total} AS DECIMAL(20,0)), 0)")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, scale: int = 1_000_000_000, prior: int = 5, text: str = "text", lang: str = "lang", source: str = "source", width: int | None = None) -> DataFrame:
    """How far each source's term shares are from the other sources' and from the language's.

    Rows: lang, source, part, item, value, rank.  Part `pair`: for each other source of the lang the sum of the
    differences of shares over all kept terms.  Part `term`: the kept terms whose share in the group is above the
    language's, by that difference, the first `top`.  Null text, lang and source count as empty; groups without any
    term have pairs; a lang without kept terms has differences of 0; ties go to the smaller item; repeated rows count
    each time; an empty table gives no rows.  `width` (a power of 2, at least 65,536) sets the sketch's cells a row: it
    changes what is shuffled, never the result.
    """
    kept, groups = count_terms(docs, min_docs, text, lang, source, width)
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_all"), F.count_if("leads").alias("v"))
    totals = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["n", "n_all", "v"])
    totals = totals.select("lang", "source", "v", (F.col("n") + prior * F.col("v")).alias("total"), (F.col("n_all") + prior * F.col("v")).alias("total_all"))
    totals = _small(saved(totals.withColumn("none", _share("0", "total", scale, prior)), "divergence-totals"))
    shares = kept.join(totals, ["lang", "source"]).select("lang", "source", "term", "none", _share("n", "total", scale, prior).alias("p"), _share("n_lang", "total_all", scale, prior).alias("q"))

    other = totals.select("lang", F.col("source").alias("item"), F.col("none").alias("none_b"))
    both = totals.join(other, "lang").where(F.col("source") != F.col("item"))
    level = both.select("lang", "source", "item", (F.col("v") * F.coalesce(F.abs(F.col("none") - F.col("none_b")), F.lit(0))).alias("value"))
    # Terms of one group, as if the other had none of them: by how many terms have each share.
    heights = shares.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("times")).join(other, "lang").where(F.col("source") != F.col("item"))
    alone = heights.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("none_b")) - F.abs(F.col("none") - F.col("none_b")))).alias("value"))
    # Terms that both have: what was counted above for each comes off again.
    a = shares.select("lang", "term", "source", "none", "p")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("none").alias("none_b"), F.col("p").alias("p_b"))
    value = F.abs(F.col("p") - F.col("p_b")) - F.abs(F.col("p") - F.col("none_b")) - F.abs(F.col("none") - F.col("p_b")) + F.abs(F.col("none") - F.col("none_b"))
    shared = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(value).alias("value"))
    twice = alone.unionByName(shared)
    swapped = twice.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = level.unionByName(twice).unionByName(swapped).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).where(F.col("rank") <= top))
