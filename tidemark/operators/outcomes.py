"""Forecast outcomes, backtests and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(hits: F.Column, n: F.Column, z: float = Z, clamp: bool = True, empty: float | None = None) -> tuple[F.Column, F.Column]:
    """Lower and upper end of the score interval of a rate; over no trials both are `empty`."""
    p = hits / n
    center = p + z * z / (2 * n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    low, high = (center - half) / (1 + z * z / n), (center + half) / (1 + z * z / n)
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    none = F.lit(empty).cast("double")
    return F.when(n > 0, low).otherwise(none), F.when(n > 0, high).otherwise(none)


def sample_size(rate: float, margin: float, z: float = Z) -> int:
    """Trials needed to know a rate to within a margin."""
    x = z * z * rate * (1 - rate) / (margin * margin)
    return int(x) + (x > int(x))


def trials_needed(rate: F.Column, margin: float, z: float = Z) -> F.Column:
    """The same for a rate of each row; a rate of 0 or 1 tells nothing."""
    return F.when((rate > 0) & (rate < 1), F.ceil(F.lit(z) * F.lit(z) * rate * (1 - rate) / (F.lit(margin) * F.lit(margin))))


def unreconciled(totals: DataFrame, strata: DataFrame, key: str, most: int) -> DataFrame:
    """key, total, strata_total, strata of reports whose total is not the sum of their strata, or that have more than `most`.

    totals: key, total; strata: key, stratum, n.  A report without strata counts as one of sum 0, and strata without a
    report have a null total.
    """
    sums = strata.groupBy(key).agg(F.sum("n").alias("strata_total"), F.count("*").alias("strata"))
    both = totals.join(sums, key, "full_outer").select(key, "total", F.coalesce("strata_total", F.lit(0)).alias("strata_total"), F.coalesce("strata", F.lit(0)).alias("strata"))
    return both.where(~F.col("total").eqNullSafe(F.col("strata_total")) | (F.col("strata") > most))


def evaluate(cases: DataFrame, cost: float) -> DataFrame:
    """net_relative and error category of each case: forecast label against what happened.

    A case without either return is unavailable; a bullish label is right if the net relative return is positive.
    """
    net = F.col("asset_return") - F.col("benchmark_return") - F.lit(cost)
    bullish = F.col("label").isin("strong", "speculative")
    error = F.when(net.isNull(), "unavailable").when(F.col("label") == "insufficient", "not_rated").when(bullish & (net > 0), "true_positive").when(bullish, "false_positive").when(net > 0, "missed").otherwise("true_negative")
    return cases.withColumns({"net_relative": net, "error": error})


def calibration(evaluated: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Cases, favorable ones, rate and interval for every label, those without cases included."""
    spark = evaluated.sparkSession
    domain = spark.createDataFrame([(x,) for x in labels], "label string")
    done = evaluated.where("net_relative is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("net_relative") > 0).alias("favorable"))
    out = F.broadcast(domain).join(done, "label", "left").select("label", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "favorable")])  # as many rows as labels
    low, high = wilson(F.col("favorable"), F.col("n"))
    return out.select("*", F.when(F.col("n") > 0, F.col("favorable") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def assessed(relative: F.Column, band: float) -> F.Column:
    """Three-way view of a relative return."""
    return F.when(relative.isNull(), "unavailable").when(relative > band, "outperformed").when(relative < -band, "underperformed").otherwise("in_line")


def strata(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each stratum and, with null keys, the total: completed, unavailable, favorable and the favorable rate's interval."""
    out = evaluated.groupingSets([[*keys], []], *keys).agg(F.count("net_relative").alias("completed"), F.count_if(F.col("net_relative").isNull()).alias("unavailable"), F.count_if(F.col("net_relative") > 0).alias("favorable"))
    low, high = wilson(F.col("favorable"), F.col("completed"))
    return out.select("*", F.when(F.col("completed") > 0, F.col("favorable") / F.col("completed")).alias("rate"), low.alias("low"), high.alias("high"))


def job_status(due: F.Column, now: F.Column, has_outcome: F.Column) -> F.Column:
    return F.when(has_outcome, "completed").when(due <= now, "ready").otherwise("not_due")


def retry_delay(attempts: F.Column) -> F.Column:
    """Seconds until the next try: doubling from 300 up to a day; null once six are used up."""
    return F.when(attempts < 6, F.least(F.lit(86400), F.lit(300) * F.pow(F.lit(2.0), attempts - 1)).cast("long"))
