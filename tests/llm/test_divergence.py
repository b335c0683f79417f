"""The divergence audit against a plain dense count on a small table with nulls, rare and common terms, repeated rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence
from tidemark.llm.divergence import audit, cells, possible, survives

LEAST, TOP = 4, 7
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, value int"


def rows(seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["É", "é", "İx", "The", "THE", "it's", "über2alles"]
    out: list[tuple] = [(0, None, None, None, "x", "y", 1), (1, "", "en", "quiet", None, None, None), (2, None, "en", "", None, None, None), (3, "alone alone", "xx", "s", None, None, None), (4, "1 2 3", "xx", "t", None, None, None)]
    for i in range(5, 160):
        n = 4000 if i == 77 else rnd.randint(0, 40)
        text = rnd.choice([" ", "\n", "-"]).join(words[min(int(rnd.expovariate(0.04)), len(words) - 1)] for _ in range(n))
        out.append((i, text, rnd.choice(["en", "en", "fr", None]), rnd.choice(["hot", "hot", "hot", "b", "c", None]), "clash", None, 3))
    return [*out, out[20], out[20]]


def plain(table: list[tuple]) -> list[tuple]:
    own: dict = defaultdict(Counter)
    docs: Counter = Counter()
    for _, text, lang, source, *_ in table:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))
        own[lang or "", source or ""].update(found)
        docs.update((lang or "", t) for t in set(found))
    out = []
    for lang in {k[0] for k in own}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= LEAST)
        groups = {s: c for (x, s), c in own.items() if x == lang}

        def shares(count: Counter) -> dict[str, int]:
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        for s, count in groups.items():
            p = shares(count)
            far = [(s2, sum(abs(p[t] - v) for t, v in shares(c2).items())) for s2, c2 in groups.items() if s2 != s]
            above = [(t, p[t] - whole[t]) for t in kept if count[t] and p[t] > whole[t]]
            for part, found, most in (("pair", far, None), ("term", above, TOP)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("width", [None, 1 << 16, 1 << 20])
def test_equals_a_dense_count(spark, width) -> None:
    table = rows()
    got = audit(spark.createDataFrame(table, SCHEMA).repartition(5), LEAST, TOP, width=width)
    assert sorted(map(tuple, got.collect())) == plain(table)


def test_many_flushes_lose_nothing(spark, monkeypatch) -> None:
    """Tasks that ship after every few terms."""
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    table = rows(4)
    assert sorted(map(tuple, audit(spark.createDataFrame(table, SCHEMA), LEAST, TOP).collect())) == plain(table)


def test_sketch_never_underestimates_and_discards(spark) -> None:
    table = [(f"common rare{chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(600)]
    bits = possible(spark.createDataFrame(table, "text string, lang string").selectExpr("CAST(text AS BINARY) AS text", "lang").repartition(4), 30, 1 << 16)
    found = [b"common", *sorted({t.split()[1].encode() for t, _ in table})]
    kept = survives(bits, "en", found)
    assert kept[0] and kept[1:].sum() < 10
    assert cells("en", found, 1 << 16).shape == (len(found), 2)


def test_large_counts_stay_exact(spark) -> None:
    total = spark.range(1).select((divergence.F.lit(10**12)).alias("n"), divergence.F.lit(3 * 10**12 + 7).alias("t")).select(divergence._share("n", "t", 10**9, 5).alias("p"))
    assert total.first().p == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 7)


def test_empty_table(spark) -> None:
    assert audit(spark.createDataFrame([], SCHEMA)).collect() == []
