"""Edit-aware token counts.

A document is cut into segments of whole pre-tokens; a sum tree over the segments holds their token counts.  The trees'
leaves are a column of a table (`keep_trees`), which an edit job reads and gives back (`edit_trees`).  An edit re-encodes
only the segments that it touches and the neighbours whose border it makes unsafe, then updates the sums on their paths
to the root.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, pairwise

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import saved, small_batches
from tidemark.llm.rows import field, named, row_of, with_row

SEGMENT = 512
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"


@cache
def counter(path: str, pattern: str) -> Callable[[str], int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def safe_cut(left: str, right: str) -> bool:
    """Whether left | right is a pre-token border whatever stands further away: a lone space before a word begins right."""
    return bool(left) and len(right) > 1 and right[0] == " " and not left[-1].isspace() and not right[1].isspace()


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Cut at safe borders, at least `size` characters apart; a text without any is one segment."""
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while 0 <= (at := text.find(" ", at)) and not safe_cut(text[at - 1 : at], text[at : at + 2]):
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class SegmentTree:
    """Segments of one document with sums of their lengths and token counts in a complete binary tree."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = SEGMENT, leaves: list[tuple[int, int]] | None = None) -> None:
        """With `leaves` (lengths and token counts of the segments, as kept) nothing is encoded."""
        self.count, self.size, self.encoded = count, size, 0
        if leaves is None:
            leaves = [(len(t), count(t)) for t in segments(text, size)]
        ends = list(accumulate((n for n, _ in leaves), initial=0))
        self.texts = [text[a:b] for a, b in pairwise(ends)] or [""]
        self.width = 1
        while self.width < len(self.texts):
            self.width *= 2
        self.length, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (n, tokens) in enumerate(leaves):
            self.length[self.width + i], self.tokens[self.width + i] = n, tokens
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.length[i] = self.length[2 * i] + self.length[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, i: int, text: str) -> None:
        self.texts[i] = text
        self.encoded += len(text)
        node = self.width + i
        self.length[node], self.tokens[node] = len(text), self.count(text) if text else 0
        while node > 1:
            node //= 2
            self._sum(node)

    def _find(self, at: int) -> tuple[int, int]:
        """Segment that holds character `at` (the last one for the end) and the place within it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.length[node] and (at > self.length[node] or self.length[node + 1]):
                at -= self.length[node]
                node += 1
        return min(node - self.width, len(self.texts) - 1), at

    def _beside(self, i: int, step: int) -> int | None:
        """Next segment with any text in that direction."""
        i += step
        while 0 <= i < len(self.texts):
            if self.texts[i]:
                return i
            i += step
        return None

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters start to stop (clipped to the document) and bring the sums up to date."""
        n = self.length[1]
        start = max(0, min(start, n))
        stop = max(start, min(stop, n))
        i, a = self._find(start)
        j, b = self._find(stop)
        joined = self.texts[i][:a] + text + self.texts[j][b:]
        first, last = i, j
        while (k := self._beside(first, -1)) is not None and not safe_cut(self.texts[k], joined):
            joined, first = self.texts[k] + joined, k
        while (k := self._beside(last, 1)) is not None and not safe_cut(joined, self.texts[k]):
            joined, last = joined + self.texts[k], k
        for k in range(first + 1, last + 1):
            if self.texts[k]:
                self._set(k, "")
        self._set(first, joined)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> list[tuple[int, int]]:
        """Lengths and token counts of the segments to keep; one that edits have made long is cut again."""
        out: list[tuple[int, int]] = []
        for i, t in enumerate(self.texts):
            if len(t) > 4 * self.size:
                parts = segments(t, self.size)
                self.encoded += len(t) if len(parts) > 1 else 0
                out += [(len(p), self.count(p)) for p in parts] if len(parts) > 1 else [(len(t), self.tokens[self.width + i])]
            elif t:
                out.append((len(t), self.tokens[self.width + i]))
        return out


LEAF = pa.struct([("length", pa.int32()), ("tokens", pa.int32())])
TREE = "array<struct<length:int,tokens:int>>"


def _leaf_lists(trees: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"length": n, "tokens": t} for n, t in leaves] for leaves in trees], pa.list_(LEAF))


def _keep_task(path: str, pattern: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            trees = [SegmentTree(t.as_py() or "", count, size).leaves() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), _leaf_lists(trees)], names=["row", "tree"])

    return run


def _edit_task(path: str, pattern: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            rows, texts, trees = [], [], []
            for text, leaves, edits in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                kept = leaves.as_py()
                tree = SegmentTree(text.as_py() or "", count, size, None if kept is None else [(x["length"], x["tokens"]) for x in kept])
                before, done = tree.total, 0
                for e in edits.as_py() or []:
                    if e is not None:
                        at = e["start"] or 0
                        tree.edit(at, at if e["stop"] is None else e["stop"], e["text"] or "")
                        done += 1
                after = tree.leaves()
                texts.append("".join(tree.texts))
                trees.append(after)
                rows.append((before, tree.total, done, tree.encoded, len(texts[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(texts, pa.string()), _leaf_lists(trees), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], names=["row", "text", "tree", *RESULT])

    return run


RESULT = ("tokens_before", "tokens_after", "n_edits", "chars_encoded_again", "n_chars_after")


def keep_trees(docs: DataFrame, path: str, pattern: str, text: str = "text", size: int = SEGMENT) -> DataFrame:
    """docs with a column tree: lengths (in characters) and token counts of each text's segments, to be written and kept.

    A null or empty text has an empty tree; a text without a safe border is one segment, however long.  Repeated rows
    get equal trees; an empty table stays empty; a column of docs named tree is replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "tree"]
    rows = docs.select(named(text).cast("string").alias("text"), row_of(docs, keep))
    out = rows.mapInArrow(_keep_task(path, pattern, size), with_row(rows.schema["row"].dataType, f"tree {TREE}"))
    return out.select(*[field(c) for c in keep], "tree")


def edit_trees(table: DataFrame, path: str, pattern: str, text: str = "text", edits: str = "edits", size: int = SEGMENT) -> DataFrame:
    """The table of `keep_trees` after its edits: text and tree brought up to date, without `edits`, with RESULT.

    `edits` is a list of (start, stop, text) in characters, applied in order, each to the text as it then is.  A null
    text is empty; a null list or entry edits nothing; a null start is 0, a null stop inserts, a null replacement
    deletes; places beyond the end are clipped; a null tree is made anew.  Counts are those of encoding the whole text.
    Repeated rows count alike; an empty table stays empty; columns named like a result column are replaced.
    """
    small_batches(table.sparkSession)
    keep = [c for c in table.columns if c not in RESULT and c not in (edits, text, "tree")]
    rows = table.select(named(text).cast("string").alias("text"), F.col("tree").cast(TREE).alias("tree"), named(edits).cast(EDITS).alias("edits"), row_of(table, keep) if keep else F.lit(None).cast("struct<none:int>").alias("row"))
    kinds = f"text string, tree {TREE}, " + ", ".join(f"{c} long" for c in RESULT)
    out = rows.mapInArrow(_edit_task(path, pattern, size), with_row(rows.schema["row"].dataType, kinds))
    return out.select(*[field(c) for c in keep], F.col("text").alias(text), "tree", *RESULT)


def count_edited(docs: DataFrame, path: str, pattern: str, text: str = "text", edits: str = "edits", size: int = SEGMENT) -> DataFrame:
    """docs without `edits`, with its text as edited and RESULT: trees are kept as a table in the shared folder, then edited."""
    table = saved(keep_trees(docs, path, pattern, text, size), "trees")
    return edit_trees(table, path, pattern, text, edits, size).drop("tree")
