"""Byte-level BPE in DuckDB recursive queries, run inside Spark tasks on each batch's distinct pre-tokens.

A word's state is its token list.  Each round lays the lists out as token-position rows, joins neighbouring tokens with
the merge table, takes each word's leftmost pair of least rank and contracts it, until no word has a pair left.
Decoding joins token-position rows with the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import field, named, row_of, with_row

#: Words of more bytes are contracted by a priority queue: a recursive query takes a round a merge.
SQL_BYTES, CHUNK_BYTES, ROWS = 256, 1 << 19, 256

_ENCODE = """
WITH RECURSIVE s(i, w, l) AS (
  SELECT 0::INTEGER, w, list(t ORDER BY p) FROM init GROUP BY w
  UNION ALL
  SELECT i + 1, w, l[: q - 1] || [r] || l[q + 2 :]
  FROM (SELECT any_value(i) AS i, w, any_value(l) AS l, min(r::BIGINT << 32 | p) AS least,
               (least & 4294967295)::INTEGER AS q, (least >> 32)::INTEGER AS r
        FROM (SELECT i, w, l, p, l[p]::BIGINT << 20 | l[p + 1] AS pair FROM (SELECT i, w, l, unnest(range(1, len(l))) AS p FROM s))
        JOIN merges USING (pair)
        GROUP BY w)
)
SELECT w, arg_max(l, i) AS ids FROM s GROUP BY w ORDER BY w
"""
_DECODE = "SELECT w, unhex(string_agg(h, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary USING (t) GROUP BY w ORDER BY w"


class Coder:
    """Ranks, merge table and a DuckDB connection of one worker process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        rows = [(self.ranks[z[:i]] << 20 | self.ranks[z[i:]], r) for z, r in self.ranks.items() for i in range(1, len(z)) if z[:i] in self.ranks and z[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        merges = pa.table({"pair": pa.array([k for k, _ in rows], pa.int64()), "r": pa.array([r for _, r in rows], pa.int32())})
        vocabulary = pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "h": pa.array([z.hex() for z in self.ranks])})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _by_queue(self, word: bytes) -> list[int]:
        """The same contraction for one long word: a heap of (rank, place) over a linked list of parts."""
        n = len(word)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := self.ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and where each word's begin (one more entry than words)."""
        out: list[np.ndarray | list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        todo = [k for k, w in enumerate(words) if w not in self.ranks]
        for k in (k for k in todo if len(words[k]) > SQL_BYTES):
            out[k] = self._by_queue(words[k])
        todo = [k for k in todo if 0 < len(words[k]) <= SQL_BYTES]
        size = np.cumsum([len(words[k]) for k in todo])
        for part in np.split(np.array(todo, dtype=np.int64), np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1) if todo else []:
            chosen = [words[k] for k in part]
            length = np.array([len(w) for w in chosen])
            at = np.repeat(np.arange(len(chosen), dtype=np.int32), length)
            place = (np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
            self.db.register("init", pa.table({"w": at, "p": place, "t": self.bytes[np.frombuffer(b"".join(chosen), np.uint8)]}))
            ids = self.db.sql(_ENCODE).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("init")
            flat, offsets = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
            for k, a, b in zip(part, offsets[:-1], offsets[1:], strict=True):
                out[k] = flat[a:b]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
        return (np.concatenate([np.asarray(x, dtype=np.int32) for x in out]) if out else np.zeros(0, np.int32)), starts

    def decode_words(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids."""
        out: list[bytes] = []
        step = 1 << 16
        for a in range(0, len(starts) - 1, step):
            part = starts[a : a + step + 1]
            n = np.diff(part)
            at = np.repeat(np.arange(len(n), dtype=np.int32), n)
            place = (np.arange(len(at)) - np.repeat(part[:-1] - part[0], n)).astype(np.int32)
            self.db.register("tokens", pa.table({"w": at, "p": place, "t": ids[part[0] : part[-1]]}))
            got = self.db.sql(_DECODE).to_arrow_table()["bytes"].to_pylist()
            self.db.unregister("tokens")
            out += got
        return out


@cache
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


class _Numbers(dict):
    """Number of each distinct word, given at first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _gather(flat: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    size = starts[words + 1] - starts[words]
    at = np.repeat(starts[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return flat[at]


def _code_task(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            numbers = _Numbers()
            texts = [np.fromiter(map(numbers.__getitem__, own.split(t.as_py() or "")), dtype=np.int32) for t in batch.column(0)]
            words = [w.encode() for w in numbers]
            ids, starts = own.encode_words(words)
            back = own.decode_words(ids, starts)
            del numbers, words
            for a in range(0, len(texts), ROWS):
                part = [_gather(ids, starts, t) for t in texts[a : a + ROWS]]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, ROWS),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part))),
                        pa.array([b"".join(map(back.__getitem__, t.tolist())) for t in texts[a : a + ROWS]], pa.binary()),
                    ],
                    names=["row", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids (token ids of the whole text) and decoded (the bytes that the ids stand for).

    `path` is a rank file on every executor, `pattern` splits a text into words that are coded separately; special
    tokens are ordinary text.  A word that is itself a token takes that id.  A null or empty text has no ids and empty
    bytes; equal texts get equal ids; an empty table stays empty; columns of docs named ids or decoded are replaced.
    """
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    rows = docs.select(named(text).cast("string").alias("text"), row_of(docs, keep))
    out = rows.mapInArrow(_code_task(path, pattern), with_row(rows.schema["row"].dataType, "ids array<int>, decoded binary"))
    return out.select(*[field(c) for c in keep], "ids", "decoded")
