"""Ratios and growth over reported facts: a missing or unfit input gives a status, never a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import latest_before


def pivoted(facts: DataFrame, cutoff: str) -> DataFrame:
    """One row an issuer and period with a column a concept, of facts known by the cutoff."""
    concepts = ("assets", "liabilities", "revenue", "income", "equity")
    at = F.lit(cutoff).cast("date")
    known = facts.where((F.col("available_at") <= at) & (F.col("period_end") <= at))
    return known.groupBy("issuer", "period_end").agg(*[F.max(F.when(F.col("concept") == c, F.col("cents"))).alias(c) for c in concepts])


def ratio(df: DataFrame, name: str, numerator: str, denominator: str) -> DataFrame:
    """A same-period ratio with its status."""
    n, d = F.col(numerator), F.col(denominator)
    status = F.when(n.isNull() | d.isNull(), "missing_fact").when(d <= 0, "non_positive_denominator").otherwise("ok")
    return df.select("issuer", "period_end", F.lit(name).alias("metric"), F.when(status == "ok", n / d).alias("value"), status.alias("status"))


def growth(facts: DataFrame, concept: str, months: int) -> DataFrame:
    """current / prior - 1 against the period that ended exactly `months` before; the prior value must be positive."""
    now = facts.where(F.col("concept") == concept).select("issuer", "period_end", "cents")
    shifted = F.last_day(F.add_months("period_end", months))
    prior = now.select("issuer", shifted.alias("period_end"), F.col("cents").alias("prior"))
    out = now.join(prior, ["issuer", "period_end"], "left")
    status = F.when(F.col("prior").isNull(), "no_prior").when(F.col("prior") <= 0, "non_positive_prior").otherwise("ok")
    return out.select("issuer", "period_end", F.when(status == "ok", F.col("cents") / F.col("prior") - 1).alias("value"), status.alias("status"))


def compound_growth(facts: DataFrame, concept: str, years: int) -> DataFrame:
    g = growth(facts, concept, 12 * years)
    return g.withColumn("value", F.pow(F.col("value") + 1, F.lit(1.0 / years)) - 1)


def return_on_equity(wide: DataFrame) -> DataFrame:
    """Income over the mean of equity at the period's two ends."""
    before = wide.select("issuer", F.last_day(F.add_months("period_end", 3)).alias("period_end"), F.col("equity").alias("beginning"))
    j = wide.join(before, ["issuer", "period_end"], "left")
    mean = (F.col("beginning") + F.col("equity")) / 2
    status = F.when(F.col("income").isNull() | mean.isNull(), "missing_fact").when(mean <= 0, "non_positive_denominator").otherwise("ok")
    return j.select("issuer", "period_end", F.when(status == "ok", F.col("income") / mean).alias("value"), status.alias("status"))


def valuation(prices: DataFrame, facts: DataFrame, concept: str) -> DataFrame:
    """Price over the latest fact of a concept known by the price's day: an as-of join, no product of an issuer's rows."""
    f = facts.where((F.col("concept") == concept) & (F.col("available_at") >= F.col("period_end"))).select("issuer", "period_end", "available_at", F.col("cents").alias("fact"))
    asked = prices.withColumn("known_before", F.date_add("day", 1))
    j = latest_before(asked, f.withColumn("tie", F.datediff("period_end", F.lit("1970-01-01").cast("date"))), ["issuer"], "known_before", "available_at", ["fact"], "tie")
    return j.where("prior_fact is not null").select("issuer", "day", F.when(F.col("prior_fact") > 0, F.col("price") / F.col("prior_fact")).alias("value"))


def literals(text: F.Column, limit: int = 24) -> F.Column:
    """The first numbers that a text states."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), 1, limit)


def claim_verdict(claimed: F.Column, actual: F.Column, tolerance: float) -> F.Column:
    return F.when(claimed.isNull() | actual.isNull(), "unverifiable").when(F.abs(claimed - actual) <= tolerance, "verified").otherwise("conflicting")


def claim_against_values(claimed: F.Column, values: F.Column, tolerance: float) -> F.Column:
    """No value: fallback; one: verified or conflicting; several: partly verified on a match, never conflicting."""
    distinct = F.array_distinct(values)
    match = F.exists(distinct, lambda v: F.abs(v - claimed) <= tolerance)
    return F.when(F.size(distinct) == 0, "fallback").when(F.size(distinct) == 1, F.when(match, "verified").otherwise("conflicting")).otherwise(F.when(match, "partially_verified").otherwise("unverifiable"))


def liquidity_pair(facts: DataFrame, cutoff: str) -> DataFrame:
    """The latest period's one cash and one liabilities value, or why there is no such pair."""
    at = F.lit(cutoff).cast("date")
    by = facts.where((F.col("available_at") <= at) & F.col("concept").isin("assets", "liabilities")).groupBy("issuer", "period_end").agg(*[f(F.when(F.col("concept") == c, F.col(v))).alias(f"{p}_{c}") for c in ("assets", "liabilities") for p, f, v in (("n", F.max, "n_sources"), ("v", F.max, "cents"))])
    last = by.groupBy("issuer").agg(F.max(F.struct("period_end", *[c for c in by.columns if c[1:2] == "_"])).alias("x")).select("issuer", "x.*")
    status = F.when(F.col("n_assets").isNull() | F.col("n_liabilities").isNull(), "incomplete").when((F.col("n_assets") > 1) | (F.col("n_liabilities") > 1), "ambiguous").otherwise("ok")
    return last.select("issuer", "period_end", status.alias("status"), F.when(status == "ok", F.col("v_assets") - F.col("v_liabilities")).alias("margin_cents"))
