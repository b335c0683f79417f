"""Golden values, fail-closed statuses, determinism and state of the engine's own operators."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import changes, indicators, ledger, outcomes
from tidemark.sources import filings
from tidemark.streaming import stateful


def day_bars(spark, closes, instrument=1, volumes=None, spread=1.0, adjustment="split_adjusted"):
    rows = [(instrument, dt.date(2024, 1, 1) + dt.timedelta(days=i), c + spread, c - spread, float(c), (volumes or [100] * len(closes))[i], adjustment) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "instrument_id int, session_date date, high double, low double, close double, volume long, adjustment string")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("session_date").collect()]


def test_golden_indicators(spark):
    b = day_bars(spark, [1, 2, 3, 4, 5, 6])
    assert values(indicators.sma(b, 3)) == [2, 3, 4, 5]
    assert values(indicators.ema(b, 3)) == pytest.approx([2, 3, 4, 5])
    assert values(indicators.rsi(b, 3)) == [100, 100, 100]
    m = indicators.macd(b, 2, 3, 2)
    assert values(m, "line") == pytest.approx([0.5] * 3) and values(m, "signal") == pytest.approx([0.5] * 3) and values(m, "histogram") == pytest.approx([0] * 3, abs=1e-12)
    a = spark.createDataFrame([(1, dt.date(2024, 1, 1 + i), 10.0 + i, 8.0 + i, 9.0 + i) for i in range(5)], "instrument_id int, session_date date, high double, low double, close double")
    assert values(indicators.atr(a, 3)) == pytest.approx([2, 2])
    assert indicators.volatility(day_bars(spark, [100, 110, 132, 171.6]), 100).first().value == pytest.approx(1.0)
    assert indicators.maximum_drawdown(day_bars(spark, [100, 120, 90, 100])).first().value == pytest.approx(-0.25)
    assert indicators.range_position(day_bars(spark, [10, 12, 14, 13]), 4).first().value == pytest.approx(0.75)
    assert indicators.relative_volume(day_bars(spark, [1, 1, 1], volumes=[100, 200, 300]), 2).first().value == 2
    asset, bench = day_bars(spark, [100, 120, 168, 268.8]), day_bars(spark, [100, 110, 132, 171.6], 0)
    assert indicators.beta(asset, bench).first().value == pytest.approx(2)
    assert indicators.relative_return(asset, bench).first().value == pytest.approx(0.972)


def test_statuses_instead_of_errors(spark):
    assert indicators.range_position(day_bars(spark, [5, 5, 5]), 3).first().status == "flat_range"
    assert indicators.relative_volume(day_bars(spark, [1, 1, 1], adjustment="unadjusted"), 2).first().status == "unadjusted"
    assert indicators.beta(day_bars(spark, [1, 2, 3]), day_bars(spark, [7, 7, 7], 0)).first().status == "zero_variance"
    assert indicators.cumulative_return(day_bars(spark, [1])).first().status == "insufficient_bars"
    assert indicators.rsi(day_bars(spark, [4, 4, 4, 4]), 3).first().value == 50
    assert indicators.ema(day_bars(spark, [4, 4]), 3).count() == 0


def test_order_of_rows_does_not_matter(spark):
    b = day_bars(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    again = b.orderBy(F.rand(1)).repartition(3)
    for f in (lambda x: indicators.ema(x, 3), lambda x: indicators.rsi(x, 3), indicators.true_range, indicators.lineage):
        assert f(b).exceptAll(f(again)).count() == 0


def test_wilson_and_samples(spark):
    low, high = outcomes.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert (r.low, r.high) == (pytest.approx(0.2366, abs=1e-4), pytest.approx(0.7634, abs=1e-4))
    none = outcomes.wilson(F.lit(0), F.lit(0))[0]
    assert spark.range(1).select(none.alias("x")).first().x is None
    assert outcomes.sample_size(0.5, 0.0704) == 194
    assert [r.d for r in spark.range(1, 8).select(outcomes.retry_delay(F.col("id")).alias("d")).collect()] == [300, 600, 1200, 2400, 4800, None, None]


def test_uuid5_and_chain(spark):
    r = spark.createDataFrame([("filing",), ("",), ("é",)], "name string").select("name", ledger.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("name")).alias("id")).collect()
    assert all(x.id == str(uuid.uuid5(uuid.NAMESPACE_URL, x.name)) for x in r)
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, p string")
    b = spark.createDataFrame([(1, 1, "b"), (1, 2, "a")], "k int, n int, p string")
    heads = {ledger.hash_chain(x, ["k"], ["n"], "p").first().head for x in (a, a.repartition(2), b)}
    assert len(heads) == 2


def test_lei(spark):
    codes = [("5493001KJTIIGC8Y1R12",), ("5493001KJTIIGC8Y1R13",), ("short",), (None,)]
    assert [r.v for r in spark.createDataFrame(codes, "c string").select(ledger.lei_valid(F.col("c")).alias("v")).collect()] == [True, False, False, None]


def test_membership_cutoff_is_monotone(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", 1, "added", t(1), t(1)), ("a", 2, "removed", t(5), t(3)), ("b", 3, "added", t(2), t(9)), ("c", 4, "removed", t(2), t(2))]
    e = spark.createDataFrame(rows, "key string, event_id long, action string, recorded_at timestamp_ntz, effective_at timestamp_ntz")
    at = lambda d: sorted(r.key for r in ledger.membership(e, f"2024-01-{d:02d}").collect())
    assert (at(1), at(4), at(5), at(9)) == (["a"], ["a"], [], ["b"])
    assert [r.violation for r in ledger.chain_violations(e).collect()] == ["starts_with_removal"]


def test_page_and_filter_bounds(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        ledger.page(df, [F.col("id")], 501)
    with pytest.raises(ValueError):
        ledger.substring_filter(df, "x" * 65, ["id"])
    names = spark.createDataFrame([("50% off",), ("50 off",)], "n string")
    assert [r.n for r in ledger.substring_filter(names, "50%", ["n"]).collect()] == ["50% off"]


def test_append_and_conflicts(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, h string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k int, h string")
    assert [r.k for r in ledger.append_new(old, new, "k").collect()] == [3]
    assert [r.k for r in ledger.conflicting_replays(old, new, "k", "h").collect()] == [2]
    assert ledger.append_new(old, old, "k").count() == 0


def test_text_functions(spark):
    html = "<html><head><title>t</title></head><body><script>x</script>A &amp;lt; <b>B</b><!-- c -->\n C</body></html>"
    df = spark.createDataFrame([(html, "HTTP://Ex.com:80/A/?q#f", "1,234 and 12345")], "html string, url string, n string")
    r = df.select(tx.visible_text(F.col("html")).alias("v"), tx.canonical_url(F.col("url")).alias("u"), tx.holds_number(F.col("n"), "1234").alias("a"), tx.holds_number(F.col("n"), "234").alias("b")).first()
    assert (r.v, r.u, r.a, r.b) == ("A &lt; B C", "http://ex.com/A", True, False)


def test_sections_ignore_white_space(spark):
    a = spark.createDataFrame([(1, "Same  text"), (2, "old"), (3, "gone")], "s int, text string")
    b = spark.createDataFrame([(1, "same text "), (2, "new"), (4, "fresh")], "s int, text string")
    assert {(r.s, r.change) for r in changes.section_changes(a, b, ["s"]).collect()} == {(2, "modified"), (3, "removed"), (4, "added")}


def test_csv_header_is_checked(spark, tmp_path):
    good = "instrument_id,session_date,open,high,low,close,volume\n1,2024-01-02,1,2,0.5,1.5,10\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "bad.csv").write_text(good.replace("close", "last"))
    assert filings.read_bars(spark, str(tmp_path / "good.csv")).first().close == 1.5
    with pytest.raises(Exception):  # noqa: B017
        filings.read_bars(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "set.json").write_text('{"name": "x",\n "cases": [{"id": 1}]}')
    assert filings.read_dataset(spark, str(tmp_path / "set.json"), "name string, cases array<struct<id:int>>").first().cases[0].id == 1


def test_entities_in_xml_are_refused(spark):
    x = "<doc><issuer>5</issuer><transaction><code>A</code><shares>3</shares></transaction></doc>"
    df = spark.createDataFrame([(x,), ("<!DOCTYPE doc>" + x,)], "value string")
    assert [tuple(r) for r in filings.ownership_xml(df).collect()] == [(5, "A", 3)]


def test_limiter_forgets_refusals():
    assert stateful.admissions([0, 1, 2, 10.5, 11], 10, 2, []) == [(True, 0.0), (True, 0.0), (False, 8), (True, 0.0), (True, 0.0)]


def test_caps_against_a_plain_count(spark):
    import random

    rnd = random.Random(1)
    caps, times = [(60.0, 3), (600.0, 8), (5.0, 1)], sorted(rnd.uniform(0, 3000) for _ in range(400))
    held, want = [], []
    for now in times:
        want.append(all(sum(t > now - w for t in held) < n for w, n in caps))
        held += [now] if want[-1] else []
    assert stateful.capped(times, caps) == want
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(u, i, base + dt.timedelta(microseconds=round(t * 1e6))) for u in (1, 2) for i, t in enumerate(times)], "user_id long, event_id long, ts timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {(r.user_id, r.event_id): r.admitted for r in stateful.capped_batch(df, caps).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(u, i): x for u in (1, 2) for i, x in enumerate(want)}


def test_all_caps_hold_at_once():
    assert stateful.capped([0, 5, 12, 24, 36, 101], ((10.0, 1), (100.0, 3))) == [True, False, True, True, False, True]


def test_retries_and_sessions(spark):
    rows = [(1, 1, False), (1, 2, True), (2, 1, False), (3, 6, False)]
    got = stateful.terminal_status(spark.createDataFrame(rows, "job int, n_try int, ok boolean"), "job", "n_try", F.col("ok"), 6)
    assert {r.job: (r.status, r.first_ok, r.delay) for r in got.collect()} == {1: ("completed", 2, None), 2: ("retry_wait", None, 300), 3: ("failed", None, None)}
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 3, 8)], "day date")
    assert {(r.day.day, r.horizon, r.target_date and r.target_date.day) for r in ledger.sessions_after(days, "day", (1, 2)).collect()} == {(2, 1, 3), (2, 2, 8), (3, 1, 8), (3, 2, None), (8, 1, None), (8, 2, None)}


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(u, 10 * u + i, dt.datetime(2024, 1, 1, 0, 0, i * 7 % 50)) for u in range(3) for i in range(8)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stateful.limit_stream(stream, 20.0, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select event_id, admitted, retry_after_s from limited").collect()}
    assert got == {tuple(r) for r in stateful.limit_batch(events, 20.0, 2).select("event_id", "admitted", "retry_after_s").collect()}


def test_sink_appends_once(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    write = stateful.append_once(str(tmp_path / "out"), "k")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(3, "c")], "k int, v string"), 1)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_windowed_counts_stream(spark, tmp_path):
    rows = [(i, "view", dt.datetime(2024, 1, 1, i % 5)) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stateful.windowed_counts(stream, size="2 hours").writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("windowed").collect()} == {tuple(r) for r in stateful.windowed_counts(events, size="2 hours").collect()}


def test_governor_hysteresis(spark):
    readings = [10, 95, 15, 15, 50, 10, 10, 10, 95]
    df = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1, 0, i), float(v)) for i, v in enumerate(readings)], "u int, event_id long, ts timestamp, value double")
    got = [r.state for r in stateful.governor(df, ["u"], 90.0, 20.0, 3).orderBy("event_id").collect()]
    assert got == ["running", "paused", "paused", "paused", "paused", "paused", "paused", "running", "paused"]


def test_calendar_as_of(spark):
    closes = [(i, dt.datetime(2024, 1, 1 + d, 16)) for i, d in enumerate([0, 1, 4])]
    cal = spark.createDataFrame(closes, "session_idx int, close_at timestamp_ntz")
    asked = [dt.datetime(2023, 12, 30, 9), dt.datetime(2024, 1, 1, 16), dt.datetime(2024, 1, 1, 17), dt.datetime(2024, 1, 3, 2), dt.datetime(2024, 1, 6)]
    e = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, ts timestamp_ntz")
    assert {r.id: r.session_idx for r in ledger.first_session_from(e, cal, "ts").collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: None}
