"""SimHash near-dedup: fingerprints meet on pigeonhole blocks and are verified by Hamming distance.

`near_duplicates` links 64-bit fingerprints within a few bits, exactly.  `representatives` keeps one text of each group
whose word shingles are 80 % alike: so far apart only part of the blocks agree, so its fingerprints are wider and its
keys are many choices of blocks, and what they propose is verified by Hamming distance, then by the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytehash as bh
from tidemark.llm import shingles
from tidemark.llm.components import components, local_roots
from tidemark.llm.durable import saved, small_batches
from tidemark.llm.rows import field, named, row_of, with_row

BITS, TILE = 64, 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text; zero without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    total, counts = max(1, len(w) - words + 1), np.zeros(BITS, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64, count=total)
    for i in range(0, total, 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """docs with a column fp (signed 64-bit fingerprint)."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in column], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", of(named(text).cast("string")))


def _blocks(distance: int, equal: int) -> list[tuple[int, int]]:
    """(shift, bits) of distance + equal blocks; a pair within `distance` agrees on at least `equal` of them."""
    n = distance + equal
    sizes = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _keys(fp: F.Column, distance: int, equal: int) -> F.Column:
    """One bucket key a choice of `equal` blocks."""
    out = []
    for i, chosen in enumerate(combinations(_blocks(distance, equal), equal)):
        key = F.lit(i).cast("long")
        for shift, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1)))
        out.append(key)
    return F.array(*out)


def _near_pairs(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows are sorted by group) within the distance."""
    size = np.bincount(group)
    left, right = [], []
    for step in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(group[:-step] == group[step:])
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        left.append(hit)
        right.append(hit + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _link_task(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stars(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([False], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, np.int64)
        left, right = _near_pairs(fp.view(np.uint64), group, distance)
        root = local_roots(len(fp), left, right)
        far = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((keys, np.column_stack([batch.column(i).to_numpy() for i in range(3)])))
            fps = np.concatenate((fps, batch.column(3).to_numpy()))
            last = int(np.argmax((keys == keys[-1]).all(axis=1)))  # a group that may go on in the next batch
            yield stars(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
        yield stars(keys, fps)

    return run


def equal_blocks(n: int, distance: int = 4) -> int:
    """Blocks that a bucket key names: the fewest, two at least, whose bits give a bucket for every 64 of n fingerprints."""
    return next((e for e in range(2, 12) if n <= 64 << (BITS // (distance + e)) * e), 12)


def near_edges(fps: DataFrame, distance: int = 4, equal: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join what distinct fingerprints (fp) within `distance` bits join.

    The 64 bits are cut into distance + equal blocks: a close pair agrees on `equal` of them and meets in that bucket.
    Rows of a bucket over `tile` are dealt to numbered chunks, and each pair of chunks is a task's group of its own, so
    no group is unbounded and none is cut short.  A group sends a star for each of its components, not its pairs.
    """
    rows = fps.select("fp", F.explode(_keys(F.col("fp"), distance, equal)).alias("key"))
    sizes = rows.groupBy(F.col("key").bitwiseXOR(F.lit(7)).alias("k")).agg(F.count("*").alias("m")).where("m > 1").select(F.expr("k + 1 - 1").alias("k"), "m")
    met = rows.withColumn("k", F.col("key").bitwiseXOR(F.lit(7))).join(sizes, "k")
    chunks = F.ceil(F.col("m") / tile).cast("int")
    met = met.select("fp", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("own"))
    tiles = met.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "fp")
    dealt = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(_link_task(distance), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, carry_text: bool = True) -> DataFrame:
    """All rows of docs with fp, root (a fingerprint that names the component), fingerprint (16 hex digits) and component_id.

    Texts link whose fingerprints differ in at most `distance` bits; component_id is the smallest doc_id reachable, the
    row's own included.  Null texts and texts without words have fingerprint zero and link like any other; equal rows
    share a component; an empty table gives an empty result; a null doc_id never names a component unless all its
    members' are null.  Columns of docs named like a result column are replaced by it.  Without carry_text the result
    has no text column, and texts are not written to the shared folder.
    """
    new = ["fp", "root", "fingerprint", "component_id"]
    keep = [c for c in docs.columns if c not in new]
    others = row_of(docs, [c for c in keep if c != text])
    body = [named(text).alias("body")] if carry_text else []
    base = saved(fingerprints(docs.select(*[named(c) for c in keep]), text, words).select(others, *body, "fp"), "fingerprints")
    least = base.select("fp", F.col("row").getField(doc_id).alias("id")).groupBy("fp").agg(F.min("id").alias("id"))
    classes = saved(least, "classes")
    roots = components(near_edges(classes.select("fp"), distance, equal_blocks(classes.count(), distance)))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    names = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    of = linked.select("fp", "root").join(names.select(F.expr("root + 1 - 1").alias("root"), "component_id"), "root").select(F.col("fp").alias("fp2"), "root", "component_id")
    out = base.join(of, F.col("fp") == F.col("fp2"))
    columns = [F.col("body").alias(c) if c == text else field(c) for c in keep if carry_text or c != text]
    return out.select(*columns, "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


LANES, KEY_LANES, LEAST_BLOCKS, RECALL, SIMILARITY = 16, 4, 5, 0.995, 0.8
NIBBLES = 16 * KEY_LANES
FEW, LONG = 16, 1 << 16
SET_LANES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _agreement(similarity: float) -> float:
    """Share of fingerprint bits that two sets of this Jaccard similarity have in common, on average."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _distance(similarity: float, lanes: int = LANES) -> int:
    """Bits in which sets of this similarity differ at most, but for one pair in a thousand."""
    n, p = lanes * 64, 1 - _agreement(similarity)
    return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))


def block_choices(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """Choices of four-bit blocks, a row a bucket key, for n fingerprints.

    Keys are as wide as log2 n, so that unlike fingerprints seldom meet, and so many that a pair of the given
    similarity agrees on all blocks of one with probability `recall`.
    """
    wide = max(LEAST_BLOCKS, math.ceil(math.log2(max(2, n)) / 4))
    keys = math.ceil(math.log(1 - recall) / math.log(1 - _agreement(similarity) ** (4 * wide)))
    rng = np.random.Generator(np.random.PCG64(5))
    return np.array([rng.choice(NIBBLES, wide, replace=False) for _ in range(keys)])


def wide_prints(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """LANES x 64 fingerprint bits (as signed 64-bit numbers) of each set of shingles."""
    counts = np.zeros((len(bounds) - 1, LANES * 64), np.int32)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(value), 1 << 12):
        part, of = value[a : a + (1 << 12)], text[a : a + (1 << 12)]
        lanes = np.column_stack([bh.mix(part ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) for i in range(1, LANES + 1)])
        bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        counts[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > np.diff(bounds)[:, None], axis=1, bitorder="little").view(np.int64)


def _set_task(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, two hashes of the set, its size n and the fingerprint (or the whole set) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in bh.text_slices(batch.column(0)):
                value, bounds = shingles.shingle_sets(data, offsets)
                if whole:
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(end - row + 1, dtype=np.int32) * LANES), pa.array(wide_prints(value, bounds).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), *(pa.array(shingles.class_of(value, bounds, lane)) for lane in SET_LANES), pa.array(np.diff(bounds).astype(np.int32)), lists], names=["row", "h1", "h2", "n", "grams"])

    return run


def _sets(docs: DataFrame, columns: list[str], whole: bool) -> DataFrame:
    rows = docs.select(F.col("text").cast("string").alias("text"), row_of(docs, columns))
    return rows.mapInArrow(_set_task(whole), with_row(rows.schema["row"].dataType, "h1 long, h2 long, n int, grams array<long>"))


def _key_task(choices: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """tok, cls, n and the first lane of the fingerprint for each class and key."""
    keys, wide = choices.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lanes = part.column(2).flatten().to_numpy().reshape(-1, LANES)
                prints = np.ascontiguousarray(lanes[:, :KEY_LANES]).view(np.uint8)
                nibble = np.stack((prints & 15, prints >> 4), axis=2).reshape(len(prints), NIBBLES).astype(np.int64)
                tok = np.broadcast_to(np.arange(keys, dtype=np.int64), (len(prints), keys)).copy()
                for i in range(wide):
                    tok = tok << 4 | nibble[:, choices[:, i]]
                of = np.repeat(np.arange(len(prints)), keys)
                yield pa.RecordBatch.from_arrays([pa.array(tok.reshape(-1)), pa.array(part.column(0).to_numpy()[of]), pa.array(part.column(1).to_numpy()[of]), pa.array(lanes[of, 0])], names=["tok", "cls", "n", "lane"])

    return run


def _meet_task(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by tok, cls: those that may have a near class in their tok, each with one such class (or itself) and its distance.

    In a tok of few classes every pair's lanes are compared and the nearest is taken; in a larger one each row is
    compared with the row nearest to the lane that most bits vote for, which is near the text that all were copied from.
    """

    def met(goes_on: bool, tok: np.ndarray, cls: np.ndarray, n: np.ndarray, lane: np.ndarray) -> pa.RecordBatch:
        """`goes_on`: the first tok is the rest of one that was large already, however few rows are left of it."""
        new = np.ones(len(tok), dtype=bool)
        new[1:] = tok[1:] != tok[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate((begin, [len(tok)])))
        small = np.repeat(size <= FEW, size)
        small[: size[0]] &= not goes_on
        head, gap, mate = np.arange(len(tok)), np.full(len(tok), 65), ~small
        for step in range(1, FEW):
            at = np.flatnonzero(small[step:] & (tok[step:] == tok[:-step]))
            if not len(at):
                break
            apart = np.bitwise_count(lane[at] ^ lane[at + step]).astype(np.int64)
            at, apart = at[apart <= distance], apart[apart <= distance]
            mate[at] = mate[at + step] = True
            for one, two in ((at, at + step), (at + step, at)):
                nearer = apart < gap[one]
                head[one[nearer]], gap[one[nearer]] = two[nearer], apart[nearer]
        large = np.flatnonzero(~small)
        if len(large):
            group = np.flatnonzero(tok[large] != np.concatenate((tok[large][:1] - 1, tok[large][:-1])))
            bits = np.unpackbits(lane[large].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n_rows = np.diff(np.concatenate((group, [len(large)])))
            middle = np.packbits(2 * np.add.reduceat(bits, group, axis=0, dtype=np.int64) > n_rows[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
            off = np.bitwise_count(lane[large] ^ np.repeat(middle, n_rows)).astype(np.int64)
            order = np.lexsort((np.arange(len(large)), off, np.repeat(np.arange(len(group)), n_rows)))
            center = np.repeat(large[order[group]], n_rows)
            apart = np.bitwise_count(lane[large] ^ lane[center]).astype(np.int64)
            near = apart <= distance
            head[large[near]], gap[large[near]] = center[near], apart[near]
        keep = np.flatnonzero(mate)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (tok[keep], cls[keep], n[keep], lane[keep].view(np.int64), cls[head[keep]], n[head[keep]], gap[keep].astype(np.int32))], names=["tok", "cls", "n", "lane", "head", "head_n", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        goes_on = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(4)]
            rows[3] = rows[3].view(np.uint64)
            rows = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            # a tok that may go on waits; of a long one only its first class does, and that it was long
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if len(rows[0]) - cut > LONG:
                yield met(goes_on, *rows)
                kept, goes_on = [x[cut : cut + 1] for x in rows], True
                continue
            if cut:
                yield met(goes_on, *(x[:cut] for x in rows))
                goes_on = False
            kept = [x[cut:] for x in rows]
        if kept is not None:
            yield met(goes_on, *kept)

    return run


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each component of similar texts does: the one of least doc_id.

    Texts are similar whose sets of 5-word shingles have a Jaccard similarity of 4/5 or more.  Pairs are proposed by
    1,024-bit fingerprints of the sets that agree on the blocks of some bucket key and differ in no more bits than such
    sets do; then the sets themselves are compared, so no pair below 4/5 links.  A pair of just 4/5 is proposed with
    probability RECALL, closer ones nearly always, equal sets always.  Texts without words (null ones too) are alike.
    Null ids come last, then the least text hash decides; of repeated rows one stays.  Columns are those of docs; an
    empty table stays empty.
    """
    small_batches(docs.sparkSession)
    whole_text = F.coalesce(named(text).cast("string"), F.lit(""))
    bodies = [F.xxhash64(whole_text), F.xxhash64(F.lit(1), whole_text)]
    keys = ["key1", "key2"]  # name a row by its id and text, in two lanes

    def with_keys(source: DataFrame, *columns: Column) -> DataFrame:
        return source.select(*columns, *(F.xxhash64(named(doc_id), b).alias(k) for b, k in zip(bodies, keys, strict=True)))

    marked = with_keys(docs, named(doc_id).alias("id"), bodies[0].alias("body_hash"), named(text).alias("text"))
    who = F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), F.col("row.body_hash").alias("body_hash"), *(F.col("row")[k].alias(k) for k in keys))
    grouped = _sets(marked, ["id", "body_hash", *keys], False).groupBy("h1", "h2")
    classes = grouped.agg(F.min(who).alias("x"), (F.count("*") > 1).alias("many"), F.first("n").alias("n"), F.first("grams").alias("fp"))
    classes = saved(classes.drop("h1", "h2").withColumn("cls", F.monotonically_increasing_id()), "classes")
    toks = classes.where("n > 0").select("cls", "n", "fp").mapInArrow(_key_task(block_choices(classes.count())), "tok long, cls long, n int, lane long")
    sorted_toks = toks.repartition("tok").sortWithinPartitions("tok", "cls")
    met = saved(sorted_toks.mapInArrow(_meet_task(_distance(SIMILARITY, 1)), "tok long, cls long, n int, lane long, head long, head_n int, gap int"), "met")

    def rows_of(source: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of source that are wanted (keys, many), one of each; only rows that may be repeated are dealt anew to keep one."""
        here = source.join(wanted, keys)
        one = Window.partitionBy(*keys).orderBy(F.lit(1))
        return here.where("not many").unionByName(here.where("many").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth"))

    def sets_of(compared: DataFrame) -> DataFrame:
        wanted = classes.join(compared, F.col("cls") == F.col("c"), "left_semi").select(*(F.col("x")[k].alias(k) for k in keys), "many", "cls")
        return saved(_sets(rows_of(with_keys(docs, named(text).alias("text")), wanted), ["cls"], True).select(field("cls"), "grams"), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        one = classes.select(F.col("cls").alias("a"), F.col("fp").alias("fa"))
        two = classes.select(F.col("cls").alias("b"), F.col("fp").alias("fb"))
        apart = sum((F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(LANES)), F.lit(0))
        near = pairs.join(one, "a").join(two, "b").where(apart <= _distance(SIMILARITY)).select("a", "b")
        return shingles.verified(saved(near, "pairs"), sets_of)

    roots = components(shingles.similar_edges(met, check, sets_of, _distance(SIMILARITY, 1), FEW))
    linked = classes.select("cls", "x", "many").join(roots, F.col("cls") == F.col("node"), "left").select("x", "many", F.coalesce("root", "cls").alias("root"))
    first = linked.groupBy("root").agg(F.min(F.struct("x", "many")).alias("y"))
    chosen = saved(first.select(*(F.col("y.x")[k].alias(k) for k in keys), "y.many"), "chosen")
    whole = with_keys(docs, F.struct(*[named(c) for c in docs.columns]).alias("row"))
    return rows_of(whole, chosen).select(*[field(c) for c in docs.columns])
