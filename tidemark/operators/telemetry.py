"""Look-back reports over event tables: every window is one conditional aggregation of a single pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOURS = (24, 48, 168)


def at(ts: str) -> F.Column:
    return F.lit(ts).cast("timestamp_ntz")


def since(now: str, hours: int) -> F.Column:
    return at(now) - F.expr(f"INTERVAL {hours} HOUR")


def conditional_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """A count for each value of a column, by keys."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def look_back(df: DataFrame, ts: str, now: str, hours: Sequence[int], measures: dict) -> DataFrame:
    """hours and measures: measures maps a name to a function of the window's condition giving an aggregate."""
    until = df.where(F.col(ts) <= at(now))
    flat = until.agg(*[f(F.col(ts) >= since(now, h)).alias(f"{name}_{h}") for h in hours for name, f in measures.items()])
    rows = F.array(*[F.struct(F.lit(h).alias("hours"), *[F.col(f"{name}_{h}").alias(name) for name in measures]) for h in hours])
    return flat.select(F.inline(rows))


def covered_windows(df: DataFrame, ts: str, now: str, hours: Sequence[int]) -> DataFrame:
    """Counts in each window, and whether the table reaches back to its start."""
    first = F.min(ts)
    out = df.where(F.col(ts) <= at(now)).agg(first.alias("first"), *[F.count_if(F.col(ts) >= since(now, h)).alias(f"n_{h}") for h in hours])
    rows = F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"n_{h}").alias("n"), (F.col("first") <= since(now, h)).alias("complete"), F.greatest("first", since(now, h)).alias("coverage_start")) for h in hours])
    return out.select(F.inline(rows))


def reason_histogram(df: DataFrame, ts: str, now: str, hours: Sequence[int], reason: str) -> DataFrame:
    """hours, reason, n: a row counts in every window that holds it, after one aggregation by reason."""
    by = df.where(F.col(ts) <= at(now)).groupBy(reason).agg(*[F.count_if(F.col(ts) >= since(now, h)).alias(f"n_{h}") for h in hours])
    rows = F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"n_{h}").alias("n")) for h in hours])
    return by.select(F.col(reason).alias("reason"), F.inline(rows)).where("n > 0")


def ratio(numerator: F.Column, denominator: F.Column) -> F.Column:
    """Whole parts in a million; null over zero."""
    return F.when(denominator > 0, F.floor(numerator * 1_000_000 / denominator))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, nearest-rank p50, p90, p95, max by keys."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), disc(0.5).alias("p50"), disc(0.9).alias("p90"), disc(0.95).alias("p95"), F.max(value).alias("max"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[F.Column]) -> DataFrame:
    """First row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def exactly_once(parents: DataFrame, children: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Parents with exactly one child over parents, in parts a million."""
    n = children.groupBy(key).agg(F.count("*").alias("n_children"))
    out = parents.join(n, key, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("n_children") == 1).alias("n_once"))
    return out.withColumn("rate", ratio(F.col("n_once"), F.col("n")))


def latency(start: F.Column, end: F.Column) -> tuple[F.Column, F.Column]:
    """Milliseconds between two times, cut to whole ones, and why there is none."""
    ms = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)
    reason = F.when(start.isNull(), "no_start").when(end.isNull(), "no_end").when(end < start, "reversed").otherwise("ok")
    return F.when(end >= start, ms), reason


def null_propagating_sum(value: F.Column) -> F.Column:
    """Sum, or null if any value is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
