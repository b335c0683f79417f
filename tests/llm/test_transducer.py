"""The streaming transducer against the tokenizers library, on whole texts and on slices of every size."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries, transducer
from tidemark.llm.transducer import OpenWord, decode_ids, encode_text, merges, slices

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["a", "b", "th", "ing", "'", "'s", "'re", "'v", "e", "!", "!!", " ", "\n", "1", "²", "½", "é", "é", "Σ", "ß", "İ", "̇", "中", "<|endoftext|>", "<|startoftext|>", "<|", "한", "한", "\U0001f600", "‍", "\U00016d63\U00016d67", "\U00011de0", "\x1c", "\x85", "　", "ࢗ", "A"]


def plain(text: str) -> tuple[bytes, str]:
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.sampled_from([1, 2, 3, 7, 1000]))
def test_any_slices_equal_the_library(text: str, size: int) -> None:
    ids, decoded = plain(text)
    assert encode_text(text, PATH, size) == ids
    assert decode_ids(ids, PATH, step=size) == decoded
    assert "".join(slices(text, size, list(merges(PATH).special))) == text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "!" * 5_000 + "'s", "中文" * 5_000, "'" * 3_000 + "s", "remembranceday" * 900])
@pytest.mark.parametrize("size", [1 << 16, 1000, 7])
def test_words_beyond_the_window(text: str, size: int) -> None:
    assert encode_text(text, PATH, size) == plain(text)[0]


def test_open_word_keeps_a_window_only() -> None:
    rnd, one, most, out = random.Random(2), OpenWord(merges(PATH)), 0, []
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(50_000))
    for a in range(0, len(text), 100):
        out += one.push(text[a : a + 100])
        most = max(most, len(one.ids))
    assert most <= merges(PATH).window + merges(PATH).lookahead
    assert [*out, *one.end()] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_lookahead_is_enough_in_a_small_list(tmp_path) -> None:
    """All strings of one letter pair: every prefix's tokens before the lookahead are those of every longer string."""
    letters = transducer.byte_letters()
    base = [*letters, *(c + "</w>" for c in letters)]
    rules = [("b", "a"), ("a", "ba"), ("a", "a"), ("aba", "b"), ("ba", "aa"), ("b", "b")]
    vocab = {t: i for i, t in enumerate([*base, *dict.fromkeys(a + b for a, b in rules)])}
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"] |= {"vocab": vocab, "merges": [list(r) for r in rules]}
    spec["added_tokens"] = []
    own = tmp_path / "small.json"
    own.write_text(json.dumps(spec), encoding="utf-8")
    model, library = transducer.Merges(str(own)), Tokenizer.from_file(str(own))
    assert 0 < model.lookahead < 12
    for n in range(1 << 12):
        text = format(n | 1 << 12, "b")[1:].replace("0", "a").replace("1", "b") * 3
        one = OpenWord(model)
        got = [t for c in text for t in one.push(c)]
        assert [*got, *one.end()] == library.encode(text, add_special_tokens=False).ids


def test_bytes_of_words_come_back_across_tokens() -> None:
    text = "héllo wörld 中 <|endoftext|> \U0001f600"
    assert decode_ids(plain(text)[0], PATH, spelled=False, step=1) == "héllo wörld 中 <|endoftext|> \U0001f600 "
    assert decode_ids(plain("é")[0], PATH, spelled=False) == "é "


def test_query_and_edges(spark, tmp_path) -> None:
    texts = [None, "", " ", "One one", "One one", "x" * 5_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_bpe_transducer(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids, decoded = plain(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert transducer.encode(docs, PATH).columns == ["doc_id", "text", "ids", "decoded"]
    assert transducer.encode(docs.limit(0), PATH).count() == 0
