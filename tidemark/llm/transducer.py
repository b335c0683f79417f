"""BPE as a streaming transducer: tokens leave as soon as no later symbol can change them.

How far the merge list can look ahead is worked out once (`Merges.lookahead`).  A word longer than that passes through a
window of a fixed number of symbols; all but the last `lookahead` symbols of the window are final and are let go.  Text
comes in slices, so memory does not grow with a text or a word.  Decoding is a state machine from token bytes to text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.durable import small_batches
from tidemark.llm.rows import field, named, row_of, with_row

SLICE, MEMO, SHORT = 1 << 16, 1 << 19, 48
END = "</w>"
LETTERS, REST = 1, 2
#: The vocabulary's own splitting pattern (a fixed value), and what goes on with an open word of each kind.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
FURTHER = {LETTERS: regex.compile(r"\p{L}+"), REST: regex.compile(r"[^\s\p{L}\p{N}]+")}
#: Characters that Python's Unicode tables may know less of than the library's: it is asked itself where one occurs.
UNSURE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x370, 0x10000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) == "Cn" or 0xA7C0 <= c < 0xA800)) + "\U00010000-\U0001efff\U0001fb00-\U0010ffff]")
#: Only texts with such characters can hold any of those.
FAR = re.compile("[^\0-\u036f]")
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """Vocabulary, merge ranks and the lookahead that is enough for them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelling = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.plain, self.final = [vocab[c] for c in letters], [vocab[c + END] for c in letters]
        self.pairs = {(vocab[a], vocab[b]): r << 20 | vocab[a + b] for r, (a, b) in reversed(list(enumerate(merges)))}
        self.size = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.lookahead = self._lookahead()
        self.window = 2 * self.lookahead + max(self.size.values())
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.classes = library.normalizer, library.pre_tokenizer, {}

    def _lookahead(self) -> int:
        """Symbols at the end of a prefix whose tokens may still change, whatever follows.

        Let two strings share a prefix, and let the border be the last place up to which both are cut alike.  It moves
        left only by a merge (u, v) of one string across it, by |u| symbols; then whatever starts at the new border has
        u at the left end of its derivation.  So the next such merge is an (x, y), of later rank, with u on the left
        spine of y.  The heaviest chain of such merges bounds how far the border moves.
        """
        made: dict[int, list[int]] = {}
        for (a, _), value in self.pairs.items():
            made.setdefault(value & 0xFFFFF, []).append(a)
        spines: dict[int, set[int]] = {}

        def spine(token: int) -> set[int]:
            if token not in spines:
                spines[token] = {token}.union(*(spine(a) for a in made.get(token, ())))
            return spines[token]

        best: dict[int, int] = {}
        known = {*self.plain, *self.final}
        for (a, b), value in sorted(self.pairs.items(), key=lambda x: x[1]):
            if a not in known or b not in known:
                raise ValueError("a merge stands before those that make its parts: no lookahead is known for such a list")
            known.add(value & 0xFFFFF)
            best[a] = max(best.get(a, 0), self.size[a] + max(best.get(t, 0) for t in spine(b)))
        return max(best.values(), default=0)

    def contract(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of least rank until no pair has a rank."""
        if len(ids) > SHORT:
            return self._by_queue(ids)
        get = self.pairs.get
        ranks = [get(p, NEVER) for p in pairwise(ids)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = (new := least & 0xFFFFF,)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), NEVER)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), NEVER)
        return ids

    def whole(self, data: bytes) -> list[int]:
        """Tokens of a word's bytes, the last of which ends it."""
        return self.contract([*map(self.plain.__getitem__, data[:-1]), self.final[data[-1]]])

    def _by_queue(self, ids: list[int]) -> list[int]:
        """The same for a long list: a heap of (rank, place) over the places still standing."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(value, i) for i, p in enumerate(pairwise(ids)) if (value := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            value, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != value:
                continue
            ids[i], ids[j] = value & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (value := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (value, i))
            if (h := before[i]) >= 0 and (value := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (value, h))
        return [t for t in ids if t >= 0]

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter."""
        if text.isascii():
            return text.lower()
        if FAR.search(text) and UNSURE.search(text):
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def shape(self, text: str) -> str:
        """The text with a stand-in of its class for each character that the library may class otherwise."""
        return UNSURE.sub(lambda c: self._stand_in(c.group()), text) if FAR.search(text) else text

    def _stand_in(self, char: str) -> str:
        if char not in self.classes:
            found = [len(self.splitter.pre_tokenize_str(x + char)) for x in "a1!"]
            self.classes[char] = "x" if found == [1, 2, 2] else "1" if found == [2, 2, 2] else "!" if found == [2, 2, 1] else " "
        return self.classes[char]


@cache
def merges(path: str) -> Merges:
    return Merges(path)


class OpenWord:
    """A word that comes in parts; tokens that nothing after them can change leave, the rest waits in the window."""

    def __init__(self, model: Merges) -> None:
        self.model, self.ids, self.held = model, [], b""

    def push(self, text: str) -> list[int]:
        """The last byte is held: only its successor tells whether the word ends there."""
        model, out = self.model, []
        data = self.held + text.encode()
        for a in range(0, len(data) - 1, model.lookahead + 1):
            self.ids += map(model.plain.__getitem__, data[a : min(a + model.lookahead + 1, len(data) - 1)])
            if len(self.ids) >= model.window:
                out += self._stable()
        self.held = data[-1:]
        return out

    def _stable(self) -> list[int]:
        sure, tokens, at = len(self.ids) - self.model.lookahead, self.model.contract(list(self.ids)), 0
        for n, t in enumerate(tokens):
            if at + self.model.size[t] > sure:
                break
            at += self.model.size[t]
        del self.ids[:at]
        return tokens[:n]

    def end(self) -> list[int]:
        ids = [*self.ids, *(self.model.final[b] for b in self.held)]
        self.ids, self.held = [], b""
        return self.model.contract(ids)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Packed tokens of short words seen lately; emptied when full."""

    def __init__(self, model: Merges) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(word) > SHORT:
            one = OpenWord(self.model)
            return packed([*one.push(word), *one.end()])
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = packed(self.model.whole(word.encode()))
        return out


@cache
def memo(path: str) -> Words:
    return Words(merges(path))


class Encoder:
    """One text in slices (cut by `slices`) to packed ids."""

    def __init__(self, path: str) -> None:
        self.model, self.known = merges(path), memo(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.model.special)) + ")") if self.model.special else None
        self.kind, self.word, self.start = 0, OpenWord(self.model), ""

    def feed(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._part(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out += [self.close(), packed([self.model.special[part]])]
            elif part:
                out.append(self._part(part))
        return b"".join(out)

    def _part(self, text: str) -> bytes:
        text, at, out = self.model.normal(text), 0, []
        shape = self.model.shape(text)
        if self.kind:
            if more := FURTHER[self.kind].match(shape):
                at = more.end()
                out.append(packed(self.word.push(self.start + text[:at])))
                self.start = ""
                if at == len(text):
                    return b"".join(out)
            out.append(self.close())
        words = WORDS.findall(shape, at) if shape is text else [text[w.start() : w.end()] for w in WORDS.finditer(shape, at)]
        if words and (kind := self._stays_open(shape[-len(words[-1]) :])) and text.endswith(words[-1]):
            self.kind, self.start = kind, words.pop()
        out += map(self.known.__getitem__, words)
        return b"".join(out)

    @staticmethod
    def _stays_open(word: str) -> int:
        """Kind of a last word that what follows may lengthen; numbers and contractions are complete."""
        return next((kind for kind, further in FURTHER.items() if further.fullmatch(word)), 0)

    def close(self) -> bytes:
        """Tokens of the word that is still open: the text, or what stands before a special token, ends here."""
        out = self.known[self.start] if self.start else packed(self.word.end())
        self.kind, self.start = 0, ""
        return out if self.start or out else b""


def slices(text: str, size: int, special: list[str]) -> Iterator[str]:
    """Cut where neither normal form, contraction nor special token reaches across."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while at < len(text) and not _apart(text, at, special):
            at += 1
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


def _apart(text: str, at: int, special: list[str]) -> bool:
    right = text[at]
    kind = unicodedata.category(right)
    if kind[0] == "M" or kind == "Cn" or "ᄀ" <= right < "ሀ" or unicodedata.combining(right):
        return False
    if right.isalpha() and "'" in text[max(0, at - 3) : at]:
        return False
    return all(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) < 0 for s in special)


class Decoder:
    """ids to text: bytes of one token after another run through an incremental UTF-8 decoder.

    `spelled` gives the vocabulary's spellings with one space between tokens, as the library does for a vocabulary
    without a decoder; otherwise the bytes that the tokens stand for, with one space after each word.
    """

    def __init__(self, path: str, spelled: bool = True) -> None:
        self.bytes, self.between = _token_bytes(path, spelled), b" " if spelled else b""
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: list[int] | memoryview) -> str:
        data = self.between.join(map(self.bytes.__getitem__, ids))
        if not self.first and len(ids):
            data = self.between + data
        self.first = self.first and not len(ids)
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", final=True)


@cache
def _token_bytes(path: str, spelled: bool) -> dict[int, bytes]:
    model = merges(path)
    if spelled:
        return {i: t.encode() for i, t in model.spelling.items()}
    back = {c: b for b, c in enumerate(byte_letters())}
    special = set(model.special.values())
    return {i: t.encode() + b" " if i in special else bytes(map(back.__getitem__, t.removesuffix(END))) + b" " * t.endswith(END) for i, t in model.spelling.items()}


def encode_text(text: str, path: str, size: int = SLICE) -> bytes:
    own = Encoder(path)
    return b"".join([*map(own.feed, slices(text, size, list(own.model.special))), own.close()])


def decode_ids(ids: bytes, path: str, spelled: bool = True, step: int = SLICE) -> str:
    own, view = Decoder(path, spelled), memoryview(ids).cast("I")
    return "".join([*(own.feed(view[a : a + step]) for a in range(0, len(view), step)), own.close()])


def _task(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(t.as_py() or "", path) for t in batch.column(0)]
            texts = [decode_ids(x, path) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["row", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (the whole text's ids as little-endian unsigned 32-bit integers) and decoded (the ids' text).

    `path` is a vocabulary file of the tokenizers library on every executor; special tokens in a text are taken as such,
    none are added.  A null or empty text has no ids and decodes to an empty text; equal texts get equal ids; an empty
    table stays empty; columns of docs named ids or decoded are replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    rows = docs.select(named(text).cast("string").alias("text"), row_of(docs, keep))
    out = rows.mapInArrow(_task(path), with_row(rows.schema["row"].dataType, "ids binary, decoded string"))
    return out.select(*[field(c) for c in keep], "ids", "decoded")
