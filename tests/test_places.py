"""Evidence is searched once a text and only what stands near a place travels: against the plain version, and by the plan."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_budget import select
from tidemark import catalog
from tidemark.functions import budget as bu
from tidemark.functions import reports as rp
from tidemark.functions import text as tx

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")
def test_no_text_is_dealt_out_once_more_for_its_places(spark):
    """A section's body stays in its task, a filing's text is dealt out for the last join alone."""
    qe = catalog.queries()["X24_form_aware_evidence"](spark, SF)._jdf.queryExecution()
    blocks = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", spark._jvm.PythonSQLUtils.explainString(qe, "formatted"))
    carried = [{c.split("#")[0] for c in b.split(", ")} for b in blocks]
    assert carried and not any(c & {"body", "near", "shown"} for c in carried)
    assert sum("visible" in c for c in carried) == 1


def plain_and_here(spark, rows):
    f = spark.createDataFrame(rows, "k int, text string, form string, changed array<string>")
    base = {r.k: r.b or "" for r in f.select("k", rp.excerpt_of(rp.keyword_windows(f["text"], bu.UP, bu.DOWN)).alias("b")).collect()}
    got = {r.k: (r.family, r.kept_terms, [tuple(w) for w in r.windows], r.text) for r in bu.selected(f, "k", "text", "form", "changed").collect()}
    assert len(got) == len(rows)
    for k, text, form, changed in rows:
        assert got[k] == select(text, form, changed, base[k]), (k, form, changed, text)


def test_places_equal_the_plain_version(spark):
    """Marks inside a text, letters that grow in lower case, language that spans other words, sentences around WINDOW, long texts."""
    rnd = random.Random(9)
    words = ["The", "company", "İstanbul", "\x01", "Straße", "subcontractor", "contract-free", "awarded", "x" * 90, "and", "nothing", "else"]
    said = [
        "Item 1.01 Entry", "Item 4.02 Non-Reliance.", "ITEM 1A. Risk Factors", "Item 2. Management’s Discussion and Analysis", "Risk Factors", "Controls and Procedures", "SIGNATURES", "Our disclosure controls and procedures",
        "internal control over financial reporting", "were ineffective", "is effective.", "a material weakness", "AWARD", "Contract contract", "default.", "a guidance? ", "going concern!", "An independent registered public accounting firm", "delisting and delisted shelf cash flows",
        "\x01Item 1.01", "we identified no material changes", "exhibit index", "12 34 56 78 90 report notes operations statements cash flows",
    ]
    rows = []
    for i in range(160):
        parts = [rnd.choice(said) if rnd.random() < 0.3 else " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 20, 90]))) + rnd.choice([".", "", "?"]) for _ in range(rnd.choice([2, 10, 40]))]
        rows.append((i, " ".join(parts), rnd.choice(["8-K", "10-Q", "10-K/A", "S-1"]), rnd.choice([[], ["risk factors"]])))
    for n in range(540, 580):  # a sentence of about WINDOW to either side of its place
        rows.append((1000 + n, f"Item 1.01 Begin. {'y' * (n - 30)} a contract {'z ' * 4}end. More. " + "w " * 900, "8-K", []))
        rows.append((2000 + n, f"Item 1.01 {'y ' * 700}. A contract {'z' * (n - 20)}. More.", "8-K", []))
    plain_and_here(spark, rows)


def test_cut_and_literals(spark):
    rnd = random.Random(3)
    texts = ["", "ab", "x", *["".join(rnd.choice(["ab", "a", "b", "\x01", "é", " "]) for _ in range(n)) for n in (3, 50, 300, 2000)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", tx.cut(F.col("t"), "ab").alias("c"), tx.literals(F.col("t"), F.lit("ab")).alias("l")).collect():
        at = [m.start() for m in re.finditer("ab", r.t)]
        assert r.l == at
        assert "".join(x.text for x in r.c) == r.t and all(r.t[x.start : x.stop] == x.text for x in r.c)
        assert set(at) <= {x.start for x in r.c} <= {0, *at}


def test_each_wording_begins_with_a_word():
    """Every text that a pattern of material language or boilerplate says begins with one of its words, or holds what it needs."""

    def said(parsed) -> set[str]:
        out = {""}
        for op, v in parsed:
            name = str(op)
            if name == "LITERAL":
                step = {chr(v)}
            elif name == "ANY":
                step = {" "}
            elif name == "AT":
                step = {""}
            elif name == "SUBPATTERN":
                step = said(v[3])
            elif name == "BRANCH":
                step = set().union(*[said(x) for x in v[1]])
            else:
                assert name == "MAX_REPEAT"
                step = {x * n for x in said(v[2]) for n in {v[0], min(v[1], v[0] + 1)}}
            out = {a + b for a in out for b in step}
        return out

    for i, (pattern, _, _) in enumerate(bu.MATERIAL):
        assert all(x.startswith(bu.WORDS[i]) for x in said(re._parser.parse(pattern)))
    for pattern in bu.REPEATED:
        assert all(any(n in x for n in bu.NEEDS_REPEATED) for x in said(re._parser.parse(pattern)))
    for pattern in bu.BOILERPLATE:
        assert all(any(n in x for n in bu.NEEDS) for x in said(re._parser.parse(pattern)))
    assert all("no changes" in x or "no material" in x or "no response" in x for x in said(re._parser.parse(bu.EMPTY)))
