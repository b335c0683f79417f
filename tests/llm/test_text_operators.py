"""Text operators against brute-force versions on small tables with nulls, copies, ties, long and empty texts."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, license_scan, packing, simhash, token_count, windows
from tidemark.llm.bytehash import sliding_min, text_slices
from tidemark.llm.components import components
from tidemark.llm.substring_dedup import _count_windows, remove_repeated_passages
from tidemark.llm.suffix_dedup import multikey_quicksort, remove_repeated_strings

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, rid string, n int, row string"


def corpus(seed: int = 0) -> list[tuple]:
    """Few words, so that windows repeat; a passage that many texts share; copies, near copies, nulls, repeated rows."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß", "The", "THE", "<|endoftext|>", "it's", "2,000"]
    passage = [rnd.choice(words) for _ in range(60)]
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "ONE", "!!! ???", "a" * 700, "ab " * 300, "x\x1cy   z"]
    for _ in range(30):
        body = [rnd.choice(words) for _ in range(rnd.randint(1, 150))]
        if rnd.random() < 0.5:
            at = rnd.randint(0, len(body))
            body[at:at] = passage[rnd.randint(0, 10) :]
        texts.append(rnd.choice([" ", "  ", "\n"]).join(body))
    texts += texts[12:16]
    near = texts[20].split()
    texts.append(" ".join(near[:-1]))
    texts.append(" ".join(rnd.choice(words) for _ in range(6000)))
    rows = [(i, t, rnd.choice(["en", None]), "hot", "clash", 1, None) for i, t in enumerate(texts)]
    return [*rows, rows[13], rows[13], (None, "nobody's text", None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(rows: list[tuple], units, window: int) -> Counter:
    """(doc_id, what is kept, n, removed) of every row, by counting every window."""
    seen = Counter()
    for r in rows:
        u = units(r[1])
        seen.update(tuple(u[k : k + window]) for k in range(len(u) - window + 1))
    out = Counter()
    for r in rows:
        u = units(r[1])
        mask = [False] * len(u)
        for k in range(len(u) - window + 1):
            if seen[tuple(u[k : k + window])] > 1:
                mask[k : k + window] = [True] * window
        out[(r[0], len(u), sum(mask), tuple(x for x, m in zip(u, mask, strict=True) if not m))] += 1
    return out


@pytest.mark.parametrize("window,screen", [(35, True), (8, True), (35, False)])
def test_passages(docs, rows, window, screen):
    got = remove_repeated_passages(docs, window=window, gram=4, screen=screen)
    assert set(docs.columns) - {"text"} <= set(got.columns)
    found = Counter((r.doc_id, r.n_words, r.n_removed, tuple(r.kept_text.encode().split())) for r in got.collect())
    assert found == removed(rows, lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), window)


def test_passages_as_is_and_spans(docs, rows):
    got = remove_repeated_passages(docs, as_is=True).collect()
    texts = {(r[0], r[1]) for r in rows}
    for r in got:
        assert r.n_removed == sum(s.stop - s.start for s in r.removed)
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
        if not r.n_removed and r.doc_id is not None and rows[r.doc_id][1] is not None:
            assert (r.doc_id, r.kept_text) in texts


@pytest.mark.parametrize("length,gram,block", [(400, 200, 8), (50, 20, 8), (50, 20, 1), (30, 10, 21)])
def test_strings(docs, rows, length, gram, block):
    got = remove_repeated_strings(docs, length=length, gram=gram, block=block)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(bytes(r.kept_bytes))) for r in got.collect())
    assert found == removed(rows, lambda t: (t or "").encode(), length)


def test_frequent_anchors_are_dealt(docs, rows, monkeypatch):
    monkeypatch.setattr(windows, "LIGHT", 1)
    got = remove_repeated_strings(docs, length=60, gram=20)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(bytes(r.kept_bytes))) for r in got.collect())
    assert found == removed(rows, lambda t: (t or "").encode(), 60)


def test_rows_of_a_frequent_key_leave_its_partition(spark, monkeypatch):
    """A frequent key's rows meet in no partition of the shuffle; all rows of known keys come through once."""
    monkeypatch.setattr(windows, "LIGHT", 100)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = F.col("id") < 4_000
        rows = spark.range(5_000).select(F.xxhash64("id").alias("rid"), F.lit(0).alias("rid2"), F.col("id").cast("int").alias("lo"), F.when(hot, F.lit(7)).otherwise(F.col("id") % 500).alias("g"))
        rows = rows.withColumn("c", F.col("g") + 1)
        keys = rows.groupBy("g", "c").agg(F.count("*").alias("m")).where("g < 250")
        for on in (["g"], ["g", "c"]):
            met = windows.meet(rows, keys, on, 5_000).withColumn("p", F.spark_partition_id()).collect()
            assert sorted(r.lo for r in met) == [i for i in range(5_000) if i < 4_000 or i % 500 < 250]
            assert max(Counter(r.p for r in met).values()) < 2_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_equal_rows(spark):
    """Equal rows cost their number, not its square: each run is listed once."""
    text = " ".join(f"w{i * 7 % 311}" for i in range(120))
    table = spark.createDataFrame([(1, text)] * 10_000 + [(2, text + " tail"), (3, "other words")], "doc_id long, text string")
    base = windows.keyed(table, "text")
    runs = windows.repeated_runs(base, windows.Shape(35, 8, "word"), _count_windows)
    longest = windows.with_runs(base, runs).agg(F.max(F.size("runs"))).first()[0]
    assert longest <= 120
    got = remove_repeated_passages(table).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 120, 120, 10_000), (2, 121, 120, 1), (3, 2, 0, 1)}


def test_empty_tables(empty):
    profiles = langid.fit(empty)
    assert profiles.names == ()
    for out in (
        remove_repeated_passages(empty),
        remove_repeated_strings(empty),
        simhash.near_duplicates(empty),
        simhash.representatives(empty),
        langid.identify(empty, profiles),
        license_scan.scan(empty),
        bpe.encode(empty, RANKS, PATTERN),
        packing.pack(empty.drop("text"), F.col("n"), F.col("source"), F.col("rid")),
        token_count.count_edited(empty.withColumn("edits", F.lit(None)), RANKS, PATTERN),
    ):
        assert out.collect() == []


def test_saved_tables_can_be_dropped(spark):
    from tidemark.llm.durable import drop_saved, saved

    df = saved(spark.range(5).toDF("id"), "five")
    assert df.count() == 5
    path = df.inputFiles()[0]
    drop_saved(spark)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(conf).exists(place)


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for n, width, letters in ((0, 9, 4), (1, 9, 4), (500, 3, 2), (3000, 21, 2), (700, 40, 256)):
        text = rng.integers(0, letters, (n, width)).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]
        order = multikey_quicksort(text)
        assert [bytes(text[i]) for i in order] == sorted(map(bytes, text))
        assert sorted(order.tolist()) == list(range(n))


def test_sliding_min_and_slices():
    import pyarrow as pa

    x = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 7, 64, 199):
        assert sliding_min(x, width).tolist() == [int(x[i : i + width].min()) for i in range(200 - width + 1)]
    column = pa.array(["ab", None, "", "é" * 50, "z"])[1:]
    parts = [(a, b, bytes(d), o.tolist()) for a, b, d, o in text_slices(column, 10)]
    assert b"".join(p[2] for p in parts) == ("é" * 50 + "z").encode()
    assert [p[:2] for p in parts][-1][1] == 4 and parts[0][0] == 0


def plain_fingerprint(text: str | None, words: int = 4) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least: dict[int, int | None] = {}
    for g, r in zip(group, rows, strict=True):
        ids = [x for x in (least.get(g), r[0]) if x is not None]
        least[g] = min(ids) if ids else None
    expected = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    got = simhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == expected
    assert set(docs.columns) <= set(got.columns)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() <= len({r[1] for r in rows})


def test_near_edges_lose_no_link(spark):
    """A bucket far over the tile size gives the components of all its close pairs."""
    rnd = random.Random(5)
    center = rnd.getrandbits(64)
    prints = {center ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = [p - (p >> 63 << 64) for p in prints]
    edges = simhash.near_edges(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=16)
    got = {r.node: r.root for r in components(edges).collect()}
    label = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    sizes = Counter(label.values())
    assert got == {p: r for p, r in label.items() if sizes[r] > 1}


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(7, 7), (100, 101), (101, 100), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_language(spark):
    rnd = random.Random(2)
    sound = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ein", "ung", "pf"]}
    texts = [(i, " ".join("".join(rnd.choices(sound[k], k=3)) for _ in range(rnd.randint(1, 60))), k, "s") for i in range(120) for k in [("xx", "yy")[i % 2]]]
    extra = [(900, None, "xx", "s"), (901, "", "yy", "s"), (902, "123 !!", "xx", "s"), (903, "kalo", None, "s"), (None, "einung", None, None)]
    docs = spark.createDataFrame(texts + extra, "doc_id long, text string, lang string, source string").repartition(3)
    profiles = langid.fit(docs.where(~langid.held_out()))
    assert profiles.names == ("xx", "yy")
    got = langid.identify(docs, profiles).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 125
    told = {r.doc_id: r.lang_pred for r in got}
    assert [told[i] for i in (900, 901, 902)] == ["und"] * 3 and told[903] == "xx" and told[None] == "yy"
    assert sum(told[i] == k for i, _, k, _ in texts) >= 118


def plain_profile(text: str) -> np.ndarray:
    """Sum of a text's trigram vectors, letter by letter: 0 is a boundary."""
    symbols = [0]
    for c in text:
        low = ord(c.lower()[0])
        s = 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + low % 101
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    v = langid._letters()
    out = np.zeros(langid.DIM)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_language_by_hand(spark):
    """Prototypes and cosines worked out text by text; short and odd texts; names that clash; repeated rows."""
    texts = ["a", "7a", " a", "é", "1 2 z", "", "12", None, "Straße heute", "the cat", "the cat", "le chat", "x" * 30_000, "der  Hund\n\tläuft", "a1b2c3"]
    langs = ["en", "en", None, "fr", "en", "en", "fr", "en", "de", "en", "en", "fr", None, "de", None]
    rows = [(i, t, g, "user's own", 0.25) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, lang string, told__ string, score double").repartition(3)
    profiles = langid.fit(docs)
    want: dict[str, np.ndarray] = {}
    for _, t, g, *_ in [*rows, rows[9]]:
        if g and any(c.isalpha() for c in t or ""):
            v = plain_profile(t)
            want[g] = want.get(g, 0) + v / max(1, len([1 for c in zip(*_grams(t))]))
    assert profiles.names == ("de", "en", "fr")
    proto = np.array([want[n] / np.linalg.norm(want[n]) for n in profiles.names])
    assert np.allclose(profiles.vectors, proto, atol=1e-4)
    got = langid.identify(docs, profiles)
    assert got.columns == ["doc_id", "text", "lang", "told__", "lang_pred", "score"]
    for r in got.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        v = plain_profile(r.text)
        cosine = proto @ v / np.linalg.norm(v)
        assert r.score == pytest.approx((1 + cosine.max()) / 2, abs=1e-4)
        assert r.lang_pred in profiles.names and cosine[profiles.names.index(r.lang_pred)] == pytest.approx(cosine.max(), abs=1e-4)
        assert r["told__"] == "user's own"
    one = langid.Profiles(("b", "c"), np.vstack([proto[:1]] * 2).astype(np.float32))
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id = 0"), one).collect()} == {"b"}  # a tie


def _grams(text: str) -> list[list[int]]:
    symbols = [0]
    for c in text:
        s = int(c.isalpha())
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    return [symbols[:-2], symbols[1:-1], symbols[2:]]


def test_licenses(spark, docs, rows):
    extra = [(5000, "Released under CC BY. All rights reserved, all RIGHTS reserved", None, None, None, None, None), (5001, license_scan.NOTICES[0][1].title(), None, None, None, None, None), (5002, license_scan.NOTICES[0][2] + " only", None, None, None, None, None), (5003, "the gnu general public  License", None, None, None, None, None)]
    table = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = license_scan.scan(table).collect()
    assert len(got) == len(rows) + 4
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in [*rows, *extra]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = by_id[doc_id]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert by_id[5001].labels == "mit" and by_id[5001].score == pytest.approx(1) and by_id[5002].labels == ""


def plain_scan(text: str | None, idf: dict[str, float]) -> tuple[set[str], float]:
    """Labels and score by trying every start of every template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels = {label for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
    best = 1.0 if labels else 0.0
    for label, notice, key in license_scan.NOTICES:
        t, k = notice.split(), key.split()
        a = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        weight = [max(idf[x], 1e-6) for x in t]
        for start in range(-a, len(w)):
            if w[start + a : start + a + len(k)] == k:
                share = sum(v for d, v in enumerate(weight) if 0 <= start + d < len(w) and w[start + d] == t[d]) / sum(weight)
                if share >= license_scan.LEAST_SHARE:
                    labels.add(label)
                    best = max(best, share)
    return labels, best


def test_notices_by_every_start(spark):
    rnd = random.Random(12)
    texts: list[str | None] = [None, "", "mit", "public license"]
    for _, notice, key in license_scan.NOTICES * 4:
        w = notice.split()
        for _ in range(rnd.randint(0, 8)):  # some words altered, dropped or put in
            i = rnd.randrange(len(w))
            w[i : i + rnd.choice([0, 1])] = rnd.choice([[], ["changed"]])
        texts.append(rnd.choice(["", "before it, "]) + " ".join(w[rnd.choice([0, 0, 3]) :]) + rnd.choice([".", " " + key, " general public license"]))
    texts.append("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted")
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    idf = dict(zip(license_scan._vocabulary()[0], license_scan.rarity(table), strict=True))
    found = 0
    for r in license_scan.scan(table).collect():
        labels, score = plain_scan(texts[r.doc_id], idf)
        assert (r.labels, r.score) == (",".join(sorted(labels)), pytest.approx(score))
        found += bool(labels)
    assert 30 < found < len(texts)


def test_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, RANKS, PATTERN)
    expected = Counter((r[0], tuple(own.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got.collect()) == expected


def test_bpe_words_by_either_way():
    rnd = random.Random(4)
    coder = bpe.coder(RANKS, PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rnd.choices("abetinorsé", k=rnd.randint(1, 40))).encode() for _ in range(300)] + [b"a" * 5000, b"ab" * 900, bytes(range(128, 256))]
    ids, starts = coder.encode_words(words)
    for k, w in enumerate(words):
        assert ids[starts[k] : starts[k + 1]].tolist() == own._encode_single_piece(w)
        assert coder._by_queue(w) == own._encode_single_piece(w) or w in ranks
    assert coder.decode_words(ids, starts) == words


def test_kept_trees(spark, docs, tmp_path):
    """An edit job reads the kept trees, encodes little, and gives back trees that the next job can use."""
    count = token_count.counter(RANKS, PATTERN)
    token_count.keep_trees(docs.withColumn("tree", F.lit("clash")), RANKS, PATTERN).write.parquet(f"{tmp_path}/one")
    table = spark.read.parquet(f"{tmp_path}/one")
    assert set(table.columns) == {*docs.columns, "tree"}
    for name in ("two", "three"):
        edit = F.struct(F.lit(3).alias("start"), F.lit(5).alias("stop"), F.lit(" new words").alias("text"))
        out = token_count.edit_trees(table.withColumn("edits", F.array(edit)), RANKS, PATTERN)
        out.drop(*token_count.RESULT).write.parquet(f"{tmp_path}/{name}")
        for r in out.collect():
            assert sum(x.length for x in r.tree) == len(r.text) and sum(x.tokens for x in r.tree) == count(r.text) == r.tokens_after
            assert len(r.text) < 9000 or r.chars_encoded_again < 4 * token_count.SEGMENT
        table = spark.read.parquet(f"{tmp_path}/{name}")
    long = token_count.SegmentTree("ab " * 2000, count)
    long.edit(10, 10, " cd ef" * 2000)
    assert len(long.leaves()) > 20 and sum(t for _, t in long.leaves()) == long.total


def test_edited_counts(spark, docs):
    count = token_count.counter(RANKS, PATTERN)
    rnd = random.Random(6)
    for size in (4, 16, 64):
        for trial in range(40):
            text = "".join(rnd.choices(["a", "b", " ", "  ", "\n", "'s", "12", ".", "é", " word"], k=rnd.randint(0, 120)))
            tree = token_count.SegmentTree(text, count, size)
            for _ in range(6):
                start = rnd.randint(0, len(text) + 2)
                stop = start + rnd.choice([0, 0, 1, 3, 30])
                new = "".join(rnd.choices(["", " ", "x", "\n ", "'ll", " y z", "9"], k=3))
                tree.edit(start, stop, new)
                a = min(start, len(text))
                text = text[:a] + new + text[max(a, min(stop, len(text))) :]
                assert "".join(tree.texts) == text, (size, trial)
                assert tree.total == count(text)
    edits = F.array(F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.lit("Oh ").alias("text")), F.lit(None))
    got = token_count.count_edited(docs.withColumn("edits", edits), RANKS, PATTERN)
    for r, text in ((r, r.text.removeprefix("Oh ")) for r in got.collect()):
        assert r.text == "Oh " + text
        assert (r.tokens_before, r.tokens_after, r.n_edits, r.n_chars_after) == (count(text), count("Oh " + text), 1, len(text) + 3)


def test_long_edit_touches_little():
    count = token_count.counter(RANKS, PATTERN)
    tree = token_count.SegmentTree("some words here " * 5000, count)
    tree.edit(40000, 40004, "other")
    assert tree.encoded < 3 * token_count.SEGMENT


def plain_packing(sizes, sources, clusters, capacity, share=0.5):
    """Every open bin is tried; the fullest that takes the piece gets it, of equally full ones the first opened."""
    bins: list[list[int]] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = []
        for b, held in enumerate(bins):
            room = capacity - sum(sizes[j] for j in held)
            mine = sum(sizes[j] for j in held if sources[j] == sources[i])
            alike = any(clusters[j] == clusters[i] for j in held) and clusters[i] is not None
            full = sources[i] is not None and any(sources[j] == sources[i] for j in held) and mine >= max(1, int(capacity * share))
            if room >= sizes[i] and not alike and not full:
                fits.append((room, b))
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[b].append(i)
        out[i] = b
    return out


def test_packing_is_best_fit():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(0, 60)
        sizes = [rnd.choice([0, 1, 5, 20, 40, 60, 99, 100]) for _ in range(n)]
        sources, clusters = ([rnd.choice([None, *names]) for _ in range(n)] for names in ("ab", "klmnopq"))
        assert packing.best_fit(sizes, sources, clusters, 100) == plain_packing(sizes, sources, clusters, 100)


def test_long_documents_are_cut_to_pieces(spark):
    docs = spark.createDataFrame([(1, 2500, None, None), (2, 1000, "s", "k"), (3, 500, "s", None)], "doc_id long, n long, source string, kind string")
    got = packing.pack(docs, F.col("n"), F.col("source"), F.col("kind"), capacity=1000).collect()
    mine = [r for r in got if r.doc_id == 1]
    assert sorted((r.start, r.size) for r in mine) == [(0, 1000), (1000, 1000), (2000, 500)]
    assert len({r.bin for r in mine}) == 3


def test_packing(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 1, 50, 300, 900, 2500]), rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, "c1", "c2", f"u{i}"])) for i in range(400)]
    rows += [rows[3], (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, source string, bin string")
    got = packing.pack(docs.withColumnRenamed("bin", "kind"), F.col("n"), F.col("source"), F.col("kind"), capacity=1000, shard_pieces=100).collect()
    assert Counter((r.doc_id, r.n) for r in got if r.start == 0) == Counter((r[0], r[1]) for r in rows)
    assert sum(r.size for r in got) == sum(r[1] or 0 for r in rows)
    bins: dict[tuple, list] = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for pieces in bins.values():
        assert sum(p.size for p in pieces) <= 1000
        kinds = [p.kind for p in pieces if p.kind is not None]
        assert len(kinds) == len(set(kinds))
        ends = sorted((p.offset, p.offset + p.size) for p in pieces)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert packing.best_fit([6, 4, 3], ["a", "b", "c"], [None] * 3, 10) == [0, 0, 1]
    assert packing.best_fit([6, 5, 4], ["a", "b", "c"], ["k", "m", "k"], 10) == [0, 1, 1]
    assert hashlib.sha256(str(sorted((r.doc_id or -1, r.start, r.shard, r.bin) for r in got)).encode()).hexdigest() == hashlib.sha256(str(sorted((r.doc_id or -1, r.start, r.shard, r.bin) for r in packing.pack(docs.withColumnRenamed("bin", "kind").repartition(5), F.col("n"), F.col("source"), F.col("kind"), capacity=1000, shard_pieces=100).collect())).encode()).hexdigest()


def test_rows_that_differ_in_which_column_is_null(spark):
    """A text in one row is the title of another: rows are told apart by their nulls, nothing is lost or taken from the wrong one."""
    passage = " ".join(f"p{i}" for i in range(120))
    table = spark.createDataFrame([(passage, None), (None, passage), (passage, "x"), ("short", None), (None, "short")], "text string, title string")
    for out, removed in ((remove_repeated_passages(table), 120), (remove_repeated_strings(table), len(passage))):
        got = sorted((r.title or "", r.n_removed) for r in out.collect())
        assert got == sorted([("", removed), (passage, 0), ("x", removed), ("", 0), ("short", 0)])


def test_a_window_that_most_texts_share(spark, monkeypatch):
    """Keys above the heavy bound and below it together, in every context."""
    monkeypatch.setattr(windows, "LIGHT", 3)
    rnd = random.Random(5)
    notice = [f"n{i}" for i in range(35)]
    texts = [" ".join([*(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 30))), *notice, *(f"t{rnd.random()}" for _ in range(20))]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for screen in (True, False):
        got = remove_repeated_passages(docs, screen=screen).collect()
        assert len(got) == 60 and all(r.n_removed >= 35 for r in got) and all("n34" not in r.kept_text.split() for r in got)
