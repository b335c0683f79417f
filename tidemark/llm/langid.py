"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies) its letters' vectors, each rotated
by its place; a text's vector bundles (adds) its n-grams' vectors, and a language's prototype bundles its texts'
vectors.  The predicted language is the prototype of largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytehash import text_slices
from tidemark.llm.durable import small_batches
from tidemark.llm.rows import field, named

DIM, SYMBOLS, SEED, CHUNK, SLICE = 512, 128, 11, 64, 1 << 18
UNKNOWN = "und"


@cache
def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1 to 26 for a-z in either case, else one of 101 classes."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % 101
    return table


@cache
def _gram_tables() -> tuple[np.ndarray, np.ndarray]:
    """Scratch space of a worker: which trigrams a slice has (all false between slices), and their numbers."""
    return np.zeros(SYMBOLS**3, dtype=bool), np.zeros(SYMBOLS**3, dtype=np.int32)


@cache
def _letters() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIM))


def _bound(grams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: letters rotated by place and multiplied."""
    letters = _letters()
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    out = np.roll(letters, 2, axis=1)[a]
    out *= np.roll(letters, 1, axis=1)[b]
    out *= letters[c]
    return out


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of a slice, the text that each belongs to, and each text's number of letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    symbol = _symbol_table()[points].astype(np.int32)
    n = len(offsets) - 1
    letters = np.concatenate(([0], np.cumsum(symbol > 0)))[begins]
    symbol = np.insert(symbol, np.column_stack((begins[:-1], begins[1:])).reshape(-1), 0)  # a boundary before and after every text
    starts = begins[:-1] + 2 * np.arange(n)
    text = np.repeat(np.arange(n), np.diff(np.concatenate((starts, [len(symbol)]))))
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    keep[starts] = True
    symbol, text = symbol[keep], text[keep]
    whole = text[:-2] == text[2:]
    gram = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    return gram[whole], text[:-2][whole], np.diff(letters)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of a slice, each trigram's number among them, its text, and letters by text."""
    gram, text, letters = _trigrams(data, offsets)
    seen, number = _gram_tables()
    seen[gram] = True
    distinct = np.flatnonzero(seen)
    seen[distinct] = False
    number[distinct] = np.arange(len(distinct))
    return distinct, number[gram], text, letters


def _bundle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of text vectors (each text weighs the same) by language, one row a language and task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for row, end, data, offsets in text_slices(batch.column(0), SLICE):
            distinct, number, text, letters = _counted(data, offsets)
            weight = 1.0 / np.maximum(1, np.bincount(text, minlength=end - row))
            for lang in set(langs[row:end]):
                mine = (langs[row:end] == lang) & (letters > 0)
                pick = mine[text]
                share = np.bincount(number[pick], weights=weight[text[pick]], minlength=len(distinct))
                total[lang] = total.get(lang, 0.0) + share.astype(np.float32) @ _bound(distinct)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(float).tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])


@dataclass(frozen=True)
class Profiles:
    """Language names and their prototypes, each of length one."""

    names: tuple[str, ...]
    vectors: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Bundle the prototypes of all non-null languages of docs; texts without letters teach nothing.

    The driver receives one vector of DIM numbers a language, summed by Spark.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(named(lang).isNotNull()).select(named(text).cast("string").alias("text"), named(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(_bundle_task, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted((r.lang, [c.x for c in r.v]) for r in sums.collect())
    vectors = np.array([v for _, v in found], dtype=np.float32).reshape(len(found), DIM)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    kept = norm[:, 0] > 0
    return Profiles(tuple(n for (n, _), k in zip(found, kept, strict=True) if k), vectors[kept] / norm[kept])


def _predict(profiles: Profiles, column: pa.Array) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(column))
    for row, end, data, offsets in text_slices(column, SLICE):
        distinct, number, text, letters = _counted(data, offsets)
        bound = _bound(distinct)
        for at in range(0, end - row, CHUNK):
            n = min(CHUNK, end - row - at)
            a, b = np.searchsorted(text, [at, at + n])
            counts = np.bincount((text[a:b] - at) * len(distinct) + number[a:b], minlength=n * len(distinct)).reshape(n, len(distinct))
            vector = counts.astype(np.float32) @ bound
            length = np.linalg.norm(vector, axis=1)
            if not profiles.names:
                names += [UNKNOWN] * n
                continue
            cosine = vector @ profiles.vectors.T / np.maximum(length, 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            known = letters[at : at + n] > 0
            scores[row + at : row + at + n] = np.where(known, np.clip((1 + cosine[np.arange(n), best].astype(float)) / 2, 0, 1), 0.0)
            names += [profiles.names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
    return names, scores


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score = (1 + cosine) / 2.

    A null or empty text, one without letters, or no profiles at all: `und` with score 0; a text with a letter always
    gets a language.  Only the text is an input, whole, however long.  Ties go to the first name in order.  Equal texts
    get equal answers, repeated rows stay; an empty table stays empty; columns of docs named lang_pred or score are
    replaced, all others kept whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(profiles)  # languages x DIM floats

    @F.pandas_udf("lang_pred string, score double")
    def of(column: pd.Series) -> pd.DataFrame:
        names, scores = _predict(shared.value, pa.array(column, pa.string(), from_pandas=True))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # called nondeterministic, so that a filter on its result is not pushed below it and evaluated a second time
    once = of.asNondeterministic()
    told = docs.select(F.struct(*[named(c) for c in keep]).alias("row"), once(named(text).cast("string")).alias("told"))
    return told.select(*[field(c) for c in keep], "told.lang_pred", "told.score")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of doc_id as text leaves 1 modulo 3 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
