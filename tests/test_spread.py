"""Work on texts is dealt over all cores and done once; searches are left out only where nothing can be found."""

from __future__ import annotations

import random
import re
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import accounting as ac
from tidemark.functions import financing as fin
from tidemark.functions import reports as rp
from tidemark.functions import text as tx
from tidemark.streaming import stateful

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["X08_item_sections", "X13_accounting_events", "X09_financing_windows", "X10_financing_terms", "R16_fact_adapters", "R17_convergence_producers"])
def test_texts_are_dealt_over_the_cores(spark, name):
    assert "RoundRobinPartitioning" in plan(spark, name)


@tables
def test_sections_read_the_texts_once(spark):
    assert plan(spark, "X08_item_sections").count("FileScan") == 1


@tables
def test_events_are_told_once(spark):
    assert plan(spark, "X13_accounting_events").count("Join") == 0


@tables
def test_selected_evidence_reads_what_was_kept(spark):
    """Sections and baselines come from tables, not from the documents again."""
    p = plan(spark, "X24_form_aware_evidence")
    assert "documents.parquet" not in p and "sections-" in p


@tables
def test_fact_adapters_state_all_kinds(spark):
    kinds = {r.kind for r in catalog.queries()["R16_fact_adapters"](spark, SF).select("kind").distinct().collect()}
    assert kinds == {"dilutive_instrument_count", "named_instrument_count", "issuable_shares", "registered_shares"}


def test_spans_of_a_pattern(spark):
    """Runs of matches below, at and above a run's length, of several widths, at either end of a text."""
    rnd = random.Random(4)
    texts = ["", "none", *["".join(rnd.choice(["ab", "aab", "é", " x", "aaaab"]) for _ in range(n)) for n in (1, 5, 127, 128, 129, 300, 1000)], None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", tx.spans(F.col("t"), "a+b").alias("s")).collect()}
    for i, t in enumerate(texts[:-1]):
        assert [tuple(x) for x in got[i]] == [m.span() for m in re.finditer("a+b", t)]
    assert got[len(texts) - 1] is None


def test_collapsed_white_space(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(" \t\n\r\fab\u00a0") for _ in range(n % 40)) for n in range(300)]
    got = {r.i: r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.collapse(F.col("t")).alias("c")).collect()}
    assert got == {i: re.sub(r"[ \t\n\r\f]+", " ", t).strip(" ") for i, t in enumerate(texts)}


def test_what_a_pattern_needs_stands_in_it():
    """Every needed wording is a plain part of its pattern that no choice or option can leave out."""
    for name, p in fin.PATTERNS.items():
        must = re.sub(r"\(\?:[^()]*\)\?", "\0", p.replace(fin._N, "\0").replace(fin._DATE, "\0")).replace("\\", "").lower()
        assert fin.NEEDS[name] in must.replace("includes (", "includes ").replace("covenants)", "covenants"), name
    for name, (_, p) in ac.SIGNALS.items():
        assert name in ac.NEEDS and all(w.split(" ")[-1] in p.lower() or w in p.lower() for w in ac.NEEDS[name])


def test_numbered_borders(spark):
    """Marks before numbers with a dot that no letter, digit or dot precedes, at any place."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["1", "22", "333", ".", " ", "a", "_", "é", "(", "1. "]) for _ in range(12)) for _ in range(400)]
    got = {r.i: r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.regexp_replace("t", *rp.NUMBERED).alias("n")).collect()}
    assert got == {i: re.sub(r"(^|[^A-Za-z0-9_.])([0-9]{1,2}\.)", "\\1\x03\\2", t) for i, t in enumerate(texts)}


def test_governor_sets_one_timer_a_batch():
    """Timers and calls to the state follow keys and batches, not readings."""

    class Held:
        def __init__(self):
            self.rows, self.calls = [], 0

        def appendList(self, rows):
            self.rows, self.calls = self.rows + rows, self.calls + 1

        def appendValue(self, row):
            self.appendList([row])

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    timers, value = [], []
    g = stateful.Governor(60.0, 20.0, 3)
    g.handle = SimpleNamespace(registerTimer=timers.append)
    g.waiting = Held()
    g.now = SimpleNamespace(exists=lambda: bool(value), get=lambda: value[-1], update=value.append)
    batch = pd.DataFrame({"us": [n * 1_000_000 for n in range(500, 0, -1)], "event_id": range(500), "value": [70.0] * 500})
    list(g.handleInputRows((1,), iter([batch]), None))
    assert timers == [1001] and g.waiting.calls == 1
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 100_000)
    out = pd.concat(list(g.handleExpiredTimer((1,), at, None)))
    assert len(out) == 99 and timers == [1001, 100_001]
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 600_000)
    assert len(pd.concat(list(g.handleExpiredTimer((1,), at, None)))) == 401 and len(timers) == 2
