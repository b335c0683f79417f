"""Near-dedup by shingle similarity against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def kept(texts):
    """Ids left by brute force, and the similarities of linked pairs."""
    sets, root, links = [grams(t) for t in texts], list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if 5 * both >= 4 * union:
                links.append(both / union if union else 1.0)
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root)), links


def planted(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    line = [rnd.choice(words) for _ in range(30)]
    texts = [None, "", "One two", "one  TWO", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "é ß w1"]
    for k in range(60):
        body = [rnd.choice(words) for _ in range(rnd.randint(20, 300))]
        texts.append(" ".join(body))
        for _ in range(rnd.randint(0, 3)):  # some copies above, some below the threshold
            copy = list(body)
            for _ in range(rnd.randint(1, max(1, len(body) // 35))):
                copy[rnd.randrange(len(copy))] = "x" + str(rnd.random())
            texts.append(" ".join(copy))
        if k % 3 == 0:
            texts.append(" ".join(line + body[: rnd.randint(1, 60)]))
    return texts


@pytest.mark.parametrize("blocks", [5, 6])
def test_near_copies_go(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "LEAST_BLOCKS", blocks)
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want, links = kept(texts)
    assert sum(0.8 <= x < 0.95 for x in links) > 30
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    # no pair below 0.8 links; of those above, one of just 0.8 may be missed, most so among sets of a few shingles
    assert len(got) == len(set(got)) and set(want) <= set(got)
    assert len(got) - len(want) <= 0.03 * (len(texts) - len(want))


def test_one_family_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "LONG", 20)
    rnd = random.Random(5)
    body = [f"w{rnd.randrange(900)}" for _ in range(120)]
    texts = []
    for k in range(80):
        copy = list(body)
        for _ in range(2):
            copy[rnd.randrange(120)] = f"x{k}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == kept(texts)[0]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_the_rest_of_a_long_key_stays(monkeypatch):
    """A key above LONG rows, then a short tail of it in the next batch: the tail counts as part of a large key."""
    monkeypatch.setattr(simhash, "LONG", 40)
    rng = np.random.default_rng(2)
    lane = rng.integers(-(1 << 62), 1 << 62, 47)
    lane[45] = lane[7] ^ 1
    tok = np.array([5] * 46 + [6])
    rows = [pa.array(tok), pa.array(np.arange(47)), pa.array(np.full(47, 100, np.int32)), pa.array(lane)]
    whole = pa.RecordBatch.from_arrays(rows, names=["tok", "cls", "n", "lane"])
    out = list(simhash._meet_task(16)(iter([whole.slice(0, 44), whole.slice(44, 0), whole.slice(44, 2), whole.slice(46)])))
    found = [c for b in out for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t == 5]
    assert set(found) == set(range(46))


def test_shared_counts_bound_every_pair(spark):
    rnd = random.Random(8)
    sets = [sorted({rnd.randrange(60) for _ in range(30)} | {1000 + 100 * i + j for j in range(i)}) for i in range(12)]
    got = {r.cls: r.s for r in shingles.shared_counts(spark.createDataFrame(list(enumerate(sets)), "cls long, grams array<long>")).collect()}
    for i, a in enumerate(sets):
        assert got[i] <= len(a) - i
        for j, b in enumerate(sets):
            assert i == j or len(set(a) & set(b)) <= min(got[i], got[j])


def crowd(seed=6):
    """A body and copies of it that mostly differ from it and one another by a little more than similar texts may."""
    rnd = random.Random(seed)
    body = [f"w{rnd.randrange(900)}" for _ in range(150)]
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(body)]
    for _ in range(240):
        copy = list(body)
        for _ in range(rnd.randint(2, 6)):
            copy[rnd.randrange(150)] = rnd.choice(common)
        texts.append(" ".join(copy))
    return texts


def test_parts_bound_every_pair(spark):
    sets = [sorted(hash((7, g)) for g in grams(t)) for t in crowd()[:60]] + [[]]
    got = {r.cls: r for r in shingles.shared_counts(spark.createDataFrame(list(enumerate(sets)), "cls long, grams array<long>")).collect()}
    assert len(got) == len(sets) and all(sum(r.parts) == r.s and len(r.parts) == shingles.PARTS for r in got.values())
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            assert len(set(a) & set(b)) <= sum(map(min, got[i].parts, got[j].parts))


def test_pairs_of_a_crowd(spark, monkeypatch):
    """Members of a large group that are not similar are told apart before their pairs are made."""
    monkeypatch.setattr(simhash, "FEW", 4)
    texts = crowd()
    want, links = kept(texts)
    asked = []
    edges = shingles.similar_edges

    def counting(met, check, *rest):
        def ask(pairs):
            asked.append(pairs.count())
            return check(pairs)

        return edges(met, ask, *rest)

    monkeypatch.setattr(shingles, "similar_edges", counting)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert len(want) > 100 and set(want) <= set(got) and len(got) <= len(want) + 2
    assert asked[-1] <= len(texts)
