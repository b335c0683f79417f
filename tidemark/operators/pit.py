"""Point-in-time predicates and scans: a row counts only if it was available and retrieved by the cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_by(cutoff: str, *columns: str) -> F.Column:
    """All of the columns (available_at and retrieved_at by default) lie at or before the cutoff."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    out = F.lit(True)
    for c in columns or ("available_at", "retrieved_at"):
        out = out & (F.col(c) <= at)
    return out


def bar_scan(bars: DataFrame, instrument: int, start: str, end: str, currency: str, adjustment: str, cutoff: str) -> DataFrame:
    """Bars of one instrument between two days as known at the cutoff."""
    day = F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return bars.where((F.col("instrument_id") == instrument) & day & (F.col("currency") == currency) & (F.col("adjustment") == adjustment) & known_by(cutoff)).orderBy("session_date")


def series_quality(asked: DataFrame, bars: DataFrame, cutoff: str, limit_days: int) -> DataFrame:
    """Row count, coverage and freshness of each asked series; a series without rows is no_data."""
    found = bars.where(known_by(cutoff)).groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"), F.max("available_at").alias("latest"))
    oldest = F.lit(cutoff).cast("timestamp_ntz") - F.expr(f"INTERVAL {limit_days} DAY")
    fresh = F.when(F.col("n") == 0, "no_data").when(F.col("latest") < oldest, "stale").otherwise("current")
    return asked.join(found, "instrument_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("freshness", fresh)


def bar_violations(bars: DataFrame, known: DataFrame) -> DataFrame:
    """violation, instrument_id, n: repeated keys, unknown instruments and days before an instrument was active."""
    again = bars.groupBy("instrument_id", "session_date", "currency", "adjustment").agg(F.count("*").alias("m")).where("m > 1").groupBy("instrument_id").agg(F.count("*").alias("n"))
    unknown = bars.join(known, "instrument_id", "left_anti").groupBy("instrument_id").agg(F.count("*").alias("n"))
    early = bars.join(known, "instrument_id").where("session_date < active_from").groupBy("instrument_id").agg(F.count("*").alias("n"))
    parts = [d.select(F.lit(v).alias("violation"), "instrument_id", "n") for v, d in (("duplicate_key", again), ("unknown_instrument", unknown), ("inactive_day", early))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Bars by the first price rule that they break."""
    rule = F.when(F.col("high") < F.greatest("open", "close"), "high").when(F.col("low") > F.least("open", "close"), "low").when(F.col("volume") <= 0, "volume").otherwise("none")
    return bars.groupBy(rule.alias("violation")).agg(F.count("*").alias("n"))
