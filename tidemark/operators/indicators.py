"""Indicators over daily bars: one row in, one row out, by instrument; what cannot be computed keeps its row and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import ordered_digest

KEY, DAY = "instrument_id", "session_date"


def _by_day() -> Window:
    return Window.partitionBy(KEY).orderBy(DAY)


def last_day(bars: DataFrame, n: str = "n") -> DataFrame:
    """Last bar of each instrument with the number of bars."""
    return bars.groupBy(KEY).agg(F.max(DAY).alias(DAY), F.count("*").alias(n))


def cumulative_return(bars: DataFrame) -> DataFrame:
    """last / first - 1; under two bars: insufficient_bars."""
    out = bars.groupBy(KEY).agg(F.count("*").alias("n"), F.min_by("close", DAY).alias("first"), F.max_by("close", DAY).alias("last"))
    good = (F.col("n") >= 2) & (F.col("first") > 0)
    return out.select(KEY, "n", F.when(good, F.col("last") / F.col("first") - 1).alias("value"), F.when(good, "ok").otherwise("insufficient_bars").alias("status"))


def simple_returns(bars: DataFrame) -> DataFrame:
    """close / previous close - 1 from the second bar on; prices must be positive."""
    before = F.lag("close").over(_by_day())
    return bars.select(KEY, DAY, "close", before.alias("before")).where("before > 0 and close > 0").select(KEY, DAY, (F.col("close") / F.col("before") - 1).alias("value"))


def sma(bars: DataFrame, period: int) -> DataFrame:
    """Mean of the last `period` closes, from the bar where there are as many."""
    w = _by_day()
    mean = F.avg("close").over(w.rowsBetween(-(period - 1), 0))
    return bars.select(KEY, DAY, mean.alias("value"), F.row_number().over(w).alias("i")).where(F.col("i") >= period).drop("i")


#: Days in a chunk of an instrument when its bars are numbered, and bars in one, for each of the period, when they are smoothed.
CHUNK_DAYS, CHUNK_PERIODS, CARRIED = 512, 64, 12


def numbered(bars: DataFrame, *columns: str) -> DataFrame:
    """KEY, DAY, columns, i (from 1 by day) and before (the close of the bar before).

    An instrument's days are cut to chunks, which are numbered on their own and then set behind one another by a window
    over one row a chunk, so its bars need not meet in a task.
    """
    part = F.floor(F.datediff(DAY, F.lit("1970-01-01").cast("date")) / CHUNK_DAYS)
    rows = bars.select(KEY, DAY, *columns, part.alias("part"), *(["close"] if "close" not in columns else []))
    w, chunks = Window.partitionBy(KEY, "part").orderBy(DAY), Window.partitionBy(KEY).orderBy("part")
    ends = rows.groupBy(KEY, "part").agg(F.count("*").alias("n"), F.max_by("close", DAY).alias("end"))
    ends = ends.select(KEY, "part", F.coalesce(F.sum("n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.lag("end").over(chunks).alias("end"))
    here = rows.withColumns({"place": F.row_number().over(w), "prior": F.lag("close").over(w)}).join(ends, [KEY, "part"])
    return here.select(KEY, DAY, *columns, (F.col("ahead") + F.col("place")).alias("i"), F.coalesce("prior", "end").alias("before"))


def smoothed(rows: DataFrame, value: str, first: int, period: int, alpha: float, name: str) -> DataFrame:
    """rows (KEY, i) with a column `name`: the mean of the first `period` values, then alpha * value + (1 - alpha) * previous.

    Values begin at i = first, the result `period` - 1 bars later; before, it is null.  Each step is the affine map
    y -> d * y + alpha * x with d = 1 - alpha, so a chunk of n bars is y -> d^n * y + c.  Chunks of CHUNK_PERIODS periods
    are summed apart (chunk -1 gives the mean), and what enters one is put together from the CARRIED chunks before it by
    a window over one row a chunk; what is older is below the least double.
    """
    if period == 1:
        return rows.withColumn(name, F.when(F.col("i") >= first, F.col(value)))
    d, length, seed = 1 - alpha, CHUNK_PERIODS * period, first + period - 1
    power = lambda e: F.pow(F.lit(d), e)
    after = F.col("i") - (seed + 1)
    rows = rows.withColumns({"chunk": F.when(after >= 0, F.floor(after / length)).otherwise(F.lit(-1).cast("long")), "place": after % length + 1})
    early = F.col("chunk") < 0
    w = Window.partitionBy(KEY, "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(~early, alpha * F.col(value) * power(-F.col("place"))).when(F.col("i") >= first, F.col(value) / period)
    rows = rows.withColumn("own", F.sum(term).over(w) * F.when(early, 1.0).otherwise(power(F.col("place"))))
    ends = rows.where((F.col("i") == seed) | (~early & (F.col("place") == length))).select(KEY, "chunk", F.col("own").alias("end"))
    by = Window.partitionBy(KEY).orderBy("chunk")
    enters = sum((F.coalesce(F.lag("end", m).over(by), F.lit(0.0)) * d ** (length * m) for m in range(1, CARRIED)), F.col("end"))
    carried = ends.select(KEY, (F.col("chunk") + 1).alias("chunk"), enters.alias("enters"))
    smooth = F.when(F.col("i") == seed, F.col("own")).when(~early, F.col("own") + power(F.col("place")) * F.col("enters"))
    return rows.join(carried, [KEY, "chunk"], "left").withColumn(name, smooth).drop("chunk", "place", "own", "enters")


def ema(bars: DataFrame, period: int) -> DataFrame:
    """Exponential mean, seeded with the simple mean of the first `period` closes."""
    return smoothed(numbered(bars, "close"), "close", 1, period, 2 / (period + 1), "value").where("value IS NOT NULL").select(KEY, DAY, "value")


def rsi(bars: DataFrame, period: int) -> DataFrame:
    """Relative strength with smoothed gains and losses: 50 if flat, 100 without losses."""
    move = F.col("close") - F.col("before")
    rows = numbered(bars, "close").withColumns({"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0))})
    for value, name in (("gain", "up"), ("loss", "down")):
        rows = smoothed(rows, value, 2, period, 1 / period, name)
    up, down = F.col("up"), F.col("down")
    value = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    return rows.where("up IS NOT NULL").select(KEY, DAY, value.alias("value"))


def macd(bars: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """line, signal and histogram, from bar slow + signal - 2 on."""
    rows = numbered(bars, "close")
    for period, name in ((fast, "quick"), (slow, "late")):
        rows = smoothed(rows, "close", 1, period, 2 / (period + 1), name)
    rows = smoothed(rows.withColumn("line", F.col("quick") - F.col("late")), "line", slow, signal, 2 / (signal + 1), "signal")
    return rows.where("signal IS NOT NULL").select(KEY, DAY, "line", "signal", (F.col("line") - F.col("signal")).alias("histogram"))


def true_range(bars: DataFrame) -> DataFrame:
    """max(high - low, |high - previous close|, |low - previous close|); the first bar has high - low."""
    before = F.lag("close").over(_by_day())
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.select(KEY, DAY, wide.alias("value"))


def atr(bars: DataFrame, period: int) -> DataFrame:
    """Smoothed true range, seeded with the mean of the first `period` after the first bar."""
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before")))
    rows = numbered(bars, "high", "low").withColumn("wide", wide)
    return smoothed(rows, "wide", 2, period, 1 / period, "value").where("value IS NOT NULL").select(KEY, DAY, "value")


def volatility(bars: DataFrame, periods_per_year: int) -> DataFrame:
    """Sample deviation of simple returns times the root of the periods in a year; under three bars null."""
    r = simple_returns(bars).groupBy(KEY).agg(F.count("*").alias("n"), F.stddev_samp("value").alias("s"))
    return r.select(KEY, F.when(F.col("n") >= 2, F.col("s") * F.sqrt(F.lit(float(periods_per_year)))).alias("value"))


def relative_volume(bars: DataFrame, period: int) -> DataFrame:
    """Last volume over the mean of the `period` before it; only adjusted series, else a status."""
    w = _by_day()
    mean = F.avg("volume").over(w.rowsBetween(-period, -1))
    rows = bars.select(KEY, DAY, "volume", "adjustment", mean.alias("mean"), F.row_number().over(w).alias("i"), F.max(DAY).over(Window.partitionBy(KEY)).alias("end")).where(F.col(DAY) == F.col("end"))
    status = F.when(F.col("adjustment") != "split_adjusted", "unadjusted").when(F.col("i") <= period, "insufficient_bars").when(F.col("mean") <= 0, "no_volume").otherwise("ok")
    return rows.withColumn("status", status).select(KEY, F.when(F.col("status") == "ok", F.col("volume") / F.col("mean")).alias("value"), "status")


def range_position(bars: DataFrame, period: int) -> DataFrame:
    """Place of the last close between the least and greatest of the last `period` closes; flat_range if they are one."""
    w = _by_day().rowsBetween(-(period - 1), 0)
    rows = bars.select(KEY, DAY, "close", F.min("close").over(w).alias("a"), F.max("close").over(w).alias("b"), F.row_number().over(_by_day()).alias("i"), F.max(DAY).over(Window.partitionBy(KEY)).alias("end")).where(F.col(DAY) == F.col("end"))
    status = F.when(F.col("i") < period, "insufficient_bars").when(F.col("a") == F.col("b"), "flat_range").otherwise("ok")
    return rows.withColumn("status", status).select(KEY, F.when(F.col("status") == "ok", (F.col("close") - F.col("a")) / (F.col("b") - F.col("a"))).alias("value"), "status")


def maximum_drawdown(bars: DataFrame) -> DataFrame:
    """Least close / highest close so far - 1."""
    top = F.max("close").over(_by_day().rowsBetween(Window.unboundedPreceding, 0))
    return bars.select(KEY, (F.col("close") / top - 1).alias("d")).groupBy(KEY).agg(F.min("d").alias("value"))


def matched(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Asset and benchmark closes on the days that both traded."""
    return bars.join(benchmark.select(DAY, F.col("close").alias("benchmark_close")), DAY)


def relative_return(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Asset's return less the benchmark's over their common days."""
    m = matched(bars, benchmark).groupBy(KEY).agg(*[f(c, DAY).alias(f"{n}_{c}") for c in ("close", "benchmark_close") for n, f in (("a", F.min_by), ("b", F.max_by))])
    return m.select(KEY, (F.col("b_close") / F.col("a_close") - F.col("b_benchmark_close") / F.col("a_benchmark_close")).alias("value"))


def beta(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Covariance over variance of returns taken after matching days; zero_variance without any."""
    w = _by_day()
    m = matched(bars, benchmark).select(KEY, DAY, (F.col("close") / F.lag("close").over(w) - 1).alias("a"), (F.col("benchmark_close") / F.lag("benchmark_close").over(w) - 1).alias("b")).where("a is not null")
    out = m.groupBy(KEY).agg(F.covar_samp("a", "b").alias("c"), F.var_samp("b").alias("v"))
    return out.select(KEY, F.when(F.col("v") > 0, F.col("c") / F.col("v")).alias("value"), F.when(F.col("v") > 0, "ok").otherwise("zero_variance").alias("status"))


def eligibility(bars: DataFrame, as_of: str, minimum: int, limit_days: int) -> DataFrame:
    """Whether each series may be used: enough bars, adjusted, and fresh as of a day."""
    out = bars.groupBy(KEY).agg(F.count("*").alias("n"), F.max(DAY).alias("end"), F.max("adjustment").alias("adjustment"))
    old = F.datediff(F.lit(as_of).cast("date"), "end") > limit_days
    status = F.when(F.col("n") < minimum, "insufficient_bars").when(F.col("adjustment") == "unadjusted", "unadjusted").when(old, "stale").otherwise("eligible")
    return out.select(KEY, "n", status.alias("status"))


def lineage(bars: DataFrame) -> DataFrame:
    """How many inputs each series' metric has, and a hash over all of them in order, which streams past."""
    line = F.concat_ws(",", F.col(DAY).cast("string"), F.floor(F.col("close") * 100 + 0.5).cast("string"))
    out = ordered_digest(bars.select(KEY, DAY, line.alias("line")), [KEY], [DAY, "line"], "line", ";")
    return out.select(KEY, F.col("n").alias("n_inputs"), F.col("digest").alias("inputs_sha256"))
