"""Recurrences over many chunks, chains that are appended to, and the governor as a stream."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, ledger
from tidemark.streaming import stateful


def smooth(x, period, alpha):
    """The recurrence, a value at a time."""
    if len(x) < period:
        return []
    out = [sum(x[:period]) / period]
    for v in x[period:]:
        out.append(alpha * v + (1 - alpha) * out[-1])
    return out


@pytest.fixture(scope="module")
def walk(spark):
    """Three instruments: one of many chunks with gaps and a long flat stretch, one short, one too short."""
    rnd, rows = random.Random(3), []
    for instrument, n in ((1, 3000), (2, 40), (3, 5)):
        close, day = 100.0, dt.date(1990, 1, 1)
        for i in range(n):
            day += dt.timedelta(days=rnd.choice([1, 1, 1, 3, 60]))
            close = close if 1000 <= i < 1400 else max(1.0, close + rnd.choice([-2, -1, 0, 1, 2.5]))
            rows.append((instrument, day, close + rnd.random(), close - rnd.random(), close))
    return rows, spark.createDataFrame(rows, "instrument_id int, session_date date, high double, low double, close double").orderBy(F.rand(1)).repartition(5)


def of(rows, instrument):
    return [r for r in sorted(rows) if r[0] == instrument]


def got(df, column="value"):
    out = {}
    for r in df.collect():
        out.setdefault(r.instrument_id, []).append((r.session_date, r[column]))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


@pytest.mark.parametrize("period", [1, 2, 5, 14])
def test_smoothing_over_chunks_equals_the_recurrence(walk, period):
    rows, bars = walk
    ema, rsi, atr = got(indicators.ema(bars, period)), got(indicators.rsi(bars, max(2, period))), got(indicators.atr(bars, period))
    for k in (1, 2, 3):
        close = [r[4] for r in of(rows, k)]
        assert ema.get(k, []) == pytest.approx(smooth(close, period, 2 / (period + 1)), rel=1e-9)
        wide = [max(h - l, abs(h - c), abs(l - c)) for (_, _, h, l, _), c in zip(of(rows, k)[1:], close, strict=False)]
        assert atr.get(k, []) == pytest.approx(smooth(wide, period, 1 / period), rel=1e-9)
        p = max(2, period)
        move = [b - a for a, b in zip(close, close[1:], strict=False)]
        up, down = (smooth([max(s * m, 0) for m in move], p, 1 / p) for s in (1, -1))
        want = [50 if u == d == 0 else 100 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down, strict=True)]
        assert rsi.get(k, []) == pytest.approx(want, rel=1e-7, abs=1e-7)


def test_macd_over_chunks(walk):
    rows, bars = walk
    line, signal = got(indicators.macd(bars, 3, 6, 4), "line"), got(indicators.macd(bars, 3, 6, 4), "signal")
    for k in (1, 2):
        close = [r[4] for r in of(rows, k)]
        quick, late = smooth(close, 3, 0.5), smooth(close, 6, 2 / 7)
        want = [a - b for a, b in zip(quick[3:], late, strict=True)]
        mark = smooth(want, 4, 0.4)
        assert line[k] == pytest.approx(want[3:], rel=1e-9, abs=1e-9) and signal[k] == pytest.approx(mark, rel=1e-9, abs=1e-9)


def test_no_window_holds_a_whole_instrument(walk):
    """Bars are only ever partitioned with their chunk; windows by instrument alone run over one row a chunk."""
    plan = indicators.ema(walk[1], 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("part#" in w or "chunk#" in w for w in windows)
    assert "FlatMapGroups" not in plan


def test_chains_go_on_from_saved_heads(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice(["a", "b", "é"])) for k in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, n int, p string").repartition(4)
    whole = {r.k: (r.n, r.head) for r in ledger.hash_chain(df, ["k"], ["n"], "p").collect()}
    for k in range(5):
        head = "0" * 64
        for _, _, p in rows[30 * k : 30 * k + 30]:
            head = hashlib.sha256(f"{head}\n{p}".encode()).hexdigest()
        assert whole[k] == (30, head)
    first = ledger.hash_chain(df.where("n < 13 and k < 4"), ["k"], ["n"], "p")
    then = ledger.hash_chain(df.where("(n >= 13 or k = 4) and k <> 2"), ["k"], ["n"], "p", first)
    got = {r.k: (r.n, r.head) for r in then.collect()}
    assert {k: got[k] for k in (0, 1, 3, 4)} == {k: whole[k] for k in (0, 1, 3, 4)} and got[2][0] == 13


def test_governed_readings():
    state, out = (False, 0), []
    for v in (70, 10, 10, None, 30, float("nan"), 5, 5, 5, 60, 20, 20, 20):
        state = stateful.governed(*state, v, 60, 20, 3)
        out.append(state[0])
    assert out == [True, True, True, False, False, True, True, True, False, True, True, True, False]


def test_governor_stream_equals_the_batch(spark, tmp_path):
    """Readings that come shuffled within the watermark, in ten batches."""
    rnd, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(minutes=i // 2, milliseconds=rnd.choice([0, 0, 7])), i, float(rnd.choice([5, 10, 30, 70]))) for i in range(300)]
    schema = "user_id long, ts timestamp, event_id long, value double"
    arrived = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.randint(0, 20)))
    for n in range(10):
        spark.createDataFrame(arrived[30 * n : 30 * n + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    spark.createDataFrame([(9, start + dt.timedelta(days=1), -1, 0.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/z")
    import os
    import shutil

    os.makedirs(f"{tmp_path}/flat")
    for i, d in enumerate(sorted(os.listdir(f"{tmp_path}/in"))):
        for f in os.listdir(f"{tmp_path}/in/{d}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/in/{d}/{f}", f"{tmp_path}/flat/{i:02}.parquet")
                os.utime(f"{tmp_path}/flat/{i:02}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
        out = stateful.governor_stream(stream, "user_id", 60.0, 20.0, 3, "21 minutes")
        query = out.writeStream.format("memory").queryName("governed").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    found = sorted(map(tuple, spark.table("governed").collect()))
    want = stateful.governor(spark.createDataFrame(rows, schema), ["user_id"], 60.0, 20.0, 3)
    assert found == sorted(map(tuple, want.collect()))
