"""Explainable scores: rules give points, points are kept as traces, a score is their clamped sum."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric of each rule, its dimension, and the points below each bound; the last stands for all above.
BELOW: dict[str, tuple[str, str, tuple[tuple[float, int], ...], int]] = {
    "cumulative_price_return": ("opportunity.return", "opportunity", ((0, 0), (0.05, 5), (0.15, 12), (0.30, 18)), 20),
    "benchmark_relative_return": ("opportunity.relative", "opportunity", ((0, 0), (0.05, 5), (0.15, 10)), 15),
    "period_over_period_growth": ("opportunity.growth", "opportunity", ((0, 0), (0.10, 5), (0.25, 10)), 15),
    "gross_margin": ("opportunity.margin", "opportunity", ((0, 0), (0.20, 3), (0.40, 6)), 10),
    "annualized_historical_volatility": ("risk.volatility", "risk", ((0.25, 5), (0.45, 12), (0.70, 20)), 25),
    "maximum_drawdown": ("risk.drawdown", "risk", ((0.15, 5), (0.30, 12), (0.50, 20)), 25),
    "debt_to_equity_ratio": ("risk.leverage", "risk", ((0.5, 3), (1, 8), (2, 14)), 20),
}
# A price-earnings ratio up to each bound, and the bands of the strength index from the inside out.
VALUATION, VALUATION_ABOVE = ((15, 10), (25, 7), (40, 4)), 1
STRENGTH = ((40, 70, 5), (30, 80, 3))
METRICS = (*tuple(BELOW)[:4], "price_to_earnings_ratio", "relative_strength_index", *tuple(BELOW)[4:])
# Weight of a cited source, and the slots of inputs with the metrics that fill them; critical ones decide.
SOURCE_WEIGHTS = {"sec": 4, "sedar_plus": 4, "government_regulatory": 4, "company_ir": 3, "official_release": 3, "reputable_news": 2, "discovery_only": 0}
SLOTS = {
    "momentum": ("cumulative_price_return",),
    "benchmark": ("benchmark_relative_return",),
    "fundamentals": ("period_over_period_growth", "gross_margin", "debt_to_equity_ratio"),
    "valuation": ("price_to_earnings_ratio",),
    "risk_metrics": ("annualized_historical_volatility", "maximum_drawdown"),
}
CRITICAL = ("momentum", "risk_metrics", "qualitative_analysis", "cited_evidence")
RULESET = "ruleset-1"


def metric_points(name: str, value: F.Column) -> F.Column:
    """Ordinal points of a metric's value; null stays null."""
    if name == "price_to_earnings_ratio":
        out = F.when(value.isNull(), F.lit(None).cast("int"))
        for bound, points in VALUATION:
            out = out.when(value <= bound, points)
        return out.otherwise(VALUATION_ABOVE)
    if name == "relative_strength_index":
        out = F.when(value.isNull(), F.lit(None).cast("int"))
        for low, high, points in STRENGTH:
            out = out.when(value.between(low, high), points)
        return out.otherwise(0)
    value = F.abs(value) if name == "maximum_drawdown" else value
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for bound, points in BELOW[name][2]:
        out = out.when(value < bound, points)
    return out.otherwise(BELOW[name][3])


def clamped(points: F.Column) -> F.Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def _of(dimension: str) -> Callable[[F.Column], F.Column]:
    return lambda trace: trace["dimension"] == dimension


def _any(names: Sequence[str]) -> F.Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])


def signal_inputs(metrics: DataFrame, findings: DataFrame, contradictions: DataFrame) -> DataFrame:
    """One row a subject: METRICS, and counts of what its analyses found.

    metrics: subject and METRICS (null where unknown); findings: subject, role, category, evidence_id, source_class;
    contradictions: subject, role, status, evidence_id, source_class.  A role is an analysis; evidence counts once.
    """
    none = F.lit(None).cast("string")
    said = findings.select("subject", "role", "category", none.alias("status"), "evidence_id", "source_class").unionByName(contradictions.select("subject", "role", none.alias("category"), "status", "evidence_id", "source_class"))
    open_status = F.col("status").isin("confirmed", "unresolved")
    weights = F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair])
    # first by cited record, so that no subject's records meet in one task before they are counted
    cited = said.groupBy("subject", "evidence_id").agg(
        F.max(weights[F.col("source_class")]).alias("weight"),
        F.collect_set("role").alias("roles"),
        F.count_if(F.col("category").isin("catalyst", "bull_case")).alias("bull"),
        F.count_if(F.col("category").isin("risk", "bear_case")).alias("bear"),
        F.count_if(open_status).alias("open"),
        F.count_if(F.col("status").isNotNull() & ~open_status).alias("settled"),
    )
    found = cited.groupBy("subject").agg(*[F.sum(c).alias(c) for c in ("bull", "bear", "open", "settled")], F.sum(F.when(F.col("evidence_id").isNotNull(), F.col("weight"))).alias("weight"), F.count("evidence_id").alias("cited"), F.size(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("analyses"))
    return metrics.select("subject", *METRICS).join(found, "subject", "left").na.fill(0, ["bull", "bear", "open", "settled", "weight", "cited", "analyses"])


def signal_traces(inputs: DataFrame) -> DataFrame:
    """inputs with traces (rule, dimension, points), in the order in which the rules run."""
    parts = []

    def add(rule: str, dimension: str, when: F.Column, points: F.Column | int) -> None:
        points = F.lit(points) if isinstance(points, int) else points
        parts.append(F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(dimension).alias("dimension"), points.cast("int").alias("points"))))

    names = {"price_to_earnings_ratio": ("opportunity.valuation", "opportunity"), "relative_strength_index": ("opportunity.rsi", "opportunity")} | {k: v[:2] for k, v in BELOW.items()}
    for metric in METRICS:
        add(*names[metric], F.col(metric).isNotNull(), metric_points(metric, F.col(metric)))
    for i in (1, 2):
        add(f"opportunity.qualitative.{i}", "opportunity", F.col("bull") >= i, 5)
    for i in (1, 2, 3):
        add(f"risk.qualitative.{i}", "risk", F.col("bear") >= i, 10)
    add("risk.contradictions", "risk", F.col("open") + F.col("settled") > 0, 15 * F.col("open") + 3 * F.col("settled"))
    for slot in ("momentum", "benchmark", "fundamentals", "valuation"):
        add(f"confidence.{slot}", "confidence", _any(SLOTS[slot]), 10)
    both = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in SLOTS["risk_metrics"]])
    add("confidence.risk_coverage", "confidence", _any(SLOTS["risk_metrics"]), F.when(both, 15).otherwise(8))
    analysed = F.col("analyses") > 0
    add("confidence.validated_analysis", "confidence", analysed, 15)
    add("confidence.cited_sources", "confidence", F.col("cited") > 0, F.least(F.lit(20), F.col("weight")))
    add("confidence.role_diversity", "confidence", analysed, F.least(F.lit(10), 3 * F.col("analyses")))
    add("confidence.unresolved_contradiction", "confidence", F.col("open") > 0, -15)
    out = inputs.withColumn("traces", F.array_compact(F.array(*parts)))
    empty = [F.when(~F.exists("traces", _of(d)), F.struct(F.lit(f"{d}.no_inputs").alias("rule"), F.lit(d).alias("dimension"), F.lit(0).alias("points"))) for d in ("opportunity", "risk", "confidence")]
    return out.withColumn("traces", F.concat("traces", F.array_compact(F.array(*empty))))


def scores(traced: DataFrame) -> DataFrame:
    """subject, opportunity, risk, confidence, missing (slots, joined), label, profile and fingerprint."""
    total = {d: clamped(F.aggregate(F.filter("traces", _of(d)), F.lit(0), lambda a, t: a + t["points"])) for d in ("opportunity", "risk", "confidence")}
    lacks = {slot: ~_any(names) for slot, names in SLOTS.items()} | {"qualitative_analysis": F.col("analyses") == 0, "cited_evidence": F.col("cited") == 0}
    missing = F.array_compact(F.array(*[F.when(no, F.lit(slot)) for slot, no in lacks.items()]))
    out = traced.select("*", *[v.alias(k) for k, v in total.items()], missing.alias("missing"))
    o, r, c = F.col("opportunity"), F.col("risk"), F.col("confidence")
    critical = F.arrays_overlap("missing", F.array(*[F.lit(x) for x in CRITICAL]))
    label = first_true([("Insufficient evidence", critical | (c < 55)), ("Strong opportunity", (o >= 70) & (r <= 35) & (c >= 70)), ("Speculative opportunity", (o >= 55) & (r > 60)), ("Moderate opportunity", o >= 55)], "Weak opportunity")
    profile = first_true([("unclassified", F.col("label") == "Insufficient evidence"), ("conservative", (r <= 35) & (c >= 70)), ("aggressive_speculative", (r > 60) & (o >= 55)), ("elevated_risk", r > 35)], "balanced")
    said = [F.coalesce(F.concat(F.lit(f"{m}="), F.col(m).cast("decimal(18,4)").cast("string")), F.lit(f"{m}=")) for m in METRICS]
    counts = [F.concat(F.lit(f"{n}="), F.col(n).cast("long").cast("string")) for n in ("bull", "bear", "open", "settled", "weight", "cited", "analyses")]
    out = out.withColumn("label", label).withColumn("profile", profile).withColumn("fingerprint", F.sha2(F.concat_ws("\n", F.lit(RULESET), F.col("subject").cast("string"), *said, *counts), 256))
    return out.select("subject", "opportunity", "risk", "confidence", F.array_join("missing", ",").alias("missing"), "label", "profile", "fingerprint")


def first_true(rules: Sequence[tuple[str, F.Column]], otherwise: str) -> F.Column:
    """Name of the first rule that holds, in order."""
    out = reduce(lambda w, r: w.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return out.otherwise(otherwise)


def changed_fields(before: dict[str, F.Column], after: dict[str, F.Column]) -> F.Column:
    """Names of the fields that differ, in order."""
    return F.array_compact(F.array(*[F.when(~before[k].eqNullSafe(after[k]), F.lit(k)) for k in before]))
