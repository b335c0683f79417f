"""Registered queries on invariants, receipts and recovery.  Inputs are one SELECT that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions import financing as fin
from tidemark.operators import forensics as fo
from tidemark.operators import invariants as inv
from tidemark.operators import routing as ro
from tidemark.operators import scoring as sc
from tidemark.plans import evidence as ev
from tidemark.tables import table


def _select(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Rows of a SELECT whose tables are named in braces."""
    return spark.sql(sql, **{t: table(spark, sf, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def _duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _contract(id_: str, key: str, sql: str, rules: dict[str, str]) -> None:
    """A report of the records that break a contract."""
    oracle = f"WITH base AS ({_duck(sql)}) " + " UNION ALL ".join(f"SELECT {key}, '{v}' AS violation FROM base WHERE NOT coalesce({c}, false)" for v, c in rules.items())

    @register(id_, oracle)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ro.violations(_select(spark, sf, sql), key, {v: F.expr(c) for v, c in rules.items()})


_contract(
    "V07_temporal_guards",
    "prediction",
    """SELECT o_orderkey AS prediction, as_of, as_of + cast(o_orderkey % 3 as int) AS cutoff, as_of + 30 AS due, as_of + 29 + cast(o_orderkey % 7 as int) AS evaluated, as_of + 35 + cast(o_orderkey % 11 as int) AS known,
  as_of - 11 + cast(o_orderkey % 13 as int) AS start_date, as_of - 11 + cast(o_orderkey % 13 + o_orderkey % 4 as int) AS start_available, as_of + 29 + cast(o_orderkey % 9 as int) AS end_date, as_of + 30 + cast(o_orderkey % 9 as int) AS end_available,
  CASE WHEN o_orderkey % 2 = 0 THEN as_of - 1 + cast(o_orderkey % 10 as int) END AS action_date, as_of + 10 + cast(o_orderkey % 40 as int) AS action_available, o_custkey % 20 AS instrument,
  (o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) % 20 AS start_instrument, o_custkey % 20 AS end_instrument, 'USD' AS currency, CASE WHEN o_orderkey % 19 = 0 THEN 'CAD' ELSE 'USD' END AS start_currency, 'USD' AS end_currency
  FROM (SELECT *, cast(o_orderdate as date) AS as_of FROM {orders})""",
    inv.OUTCOME_INPUTS,
)
_contract(
    "V08_metric_integrity",
    "metric",
    """SELECT metric, max(as_of) AS as_of, max(as_of) + 1 - cast(metric % 3 as int) AS cutoff, count(*) AS n, count(DISTINCT point) AS n_points, count(DISTINCT input) AS n_inputs, max(available) AS last_available, max(effective) AS last_effective,
  sum(CASE WHEN before > effective THEN 1 ELSE 0 END) AS n_unsorted
  FROM (SELECT o_custkey AS metric, cast(o_orderdate as date) AS effective, cast(o_orderdate as date) + cast(o_orderkey % 5 as int) AS available, concat(cast(cast(o_orderdate as date) as varchar(10)), ':', o_orderpriority) AS point, o_orderkey % 4000 AS input,
    date '2001-08-02' - cast(o_custkey % 9 as int) AS as_of, lag(cast(o_orderdate as date)) OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 2 = 0 THEN o_orderdate END, o_orderkey) AS before FROM {orders}) GROUP BY metric""",
    inv.METRIC_RESULT,
)
_contract(
    "V12_batch_invariants",
    "outcome",
    """SELECT o_orderkey AS outcome, cast(o_orderdate as date) + 120 AS evaluated, cast(o_orderdate as date) + 30 + cast(o_orderkey % 95 as int) AS target_close, cast(o_orderdate as date) + 119 + cast(o_orderkey % 8 as int) AS appended, last_completed,
  coalesce(n_ids, 0) AS n_ids, coalesce(n_numbers, 0) AS n_numbers, coalesce(n_attempts, 0) AS n_attempts, last_status, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'unavailable' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 23 <> 0 THEN o_orderkey % 50 WHEN o_orderkey % 29 = 0 THEN 1 END AS asset_return, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 40 END AS benchmark_return,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 50 - o_custkey % 40 + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END END AS relative_return, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 6 END AS n_limitations
  FROM {orders} LEFT JOIN (SELECT l_orderkey, cast(max(l_shipdate) as date) AS last_completed, count(DISTINCT l_partkey % 500) AS n_ids, count(DISTINCT l_linenumber) AS n_numbers, count(*) AS n_attempts,
    CASE max(concat(cast(l_linenumber as varchar(3)), l_returnflag)) WHEN '1R' THEN 'terminal_failure' ELSE CASE WHEN max(l_linenumber) % 2 = 0 THEN 'succeeded' ELSE 'terminal_failure' END END AS last_status FROM {lineitem} GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    inv.OUTCOME_BATCH,
)
_contract(
    "V13_receipt_invariants",
    "term",
    """SELECT p_partkey AS term, CASE p_partkey % 8 WHEN 0 THEN 'warrant' WHEN 1 THEN 'warrant_repricing' WHEN 2 THEN 'warrant_exercise_inducement' WHEN 3 THEN 'convertible_debt' WHEN 4 THEN 'preferred_equity' WHEN 5 THEN 'debt' WHEN 6 THEN 'pipe' ELSE 'atm_program' END AS instrument,
  2 AS n_evidence, CASE WHEN p_partkey % 15 = 0 THEN 1 ELSE 2 END AS n_distinct_evidence, p_size % 3 AS n_bases, CASE WHEN p_partkey % 21 = 0 THEN 0 ELSE p_size % 3 END AS n_distinct_bases, CASE WHEN p_size % 3 > 1 THEN 'reported' ELSE 'unknown' END AS proceeds_status,
  p_size % 3 > 1 AND p_partkey % 14 <> 0 AS has_proceeds, CASE WHEN p_partkey % 8 < 3 OR p_partkey % 25 = 0 THEN p_retailprice END AS exercise_price, CASE WHEN p_partkey % 8 = 1 OR p_partkey % 33 = 0 THEN p_retailprice END AS previous_price,
  CASE WHEN p_partkey % 8 IN (3, 4) OR p_partkey % 35 = 0 THEN p_retailprice END AS conversion_price, CASE WHEN p_partkey % 8 IN (3, 5) OR p_partkey % 39 = 0 THEN date '2030-01-01' END AS maturity, CASE WHEN p_partkey % 8 IN (3, 5) OR p_partkey % 41 = 0 THEN 5 END AS rate,
  date '2024-01-01' + cast(p_partkey % 30 as int) AS announced, CASE WHEN p_partkey % 2 = 0 THEN date '2024-01-02' + cast(p_size % 30 as int) END AS closing FROM {part}""",
    inv.FINANCING_TERM,
)
_contract(
    "V14_routing_invariants",
    "receipt",
    """SELECT c_custkey AS receipt, c_custkey AS accession, CASE WHEN c_custkey % 50 = 0 THEN c_custkey ELSE c_custkey - 1 END AS prior_accession, c_custkey % 1000 AS manifest, c_custkey % 999 AS prior_manifest, 9 AS n_changes, 6 AS n_selected, CASE WHEN c_custkey % 40 = 0 THEN 2 ELSE 3 END AS n_omitted,
  d AS disposition, CASE WHEN d = 'delta_ready' AND c_custkey % 35 <> 0 THEN 4 ELSE 0 END AS n_changed, CASE WHEN d = 'delta_ready' THEN 'ab' END AS delta_sha, CASE WHEN d = 'delta_ready' OR c_custkey % 55 = 0 THEN 900 ELSE 0 END AS delta_characters, CASE WHEN d = 'full_reanalysis' OR c_custkey % 60 = 0 THEN 1 ELSE 0 END AS n_removed,
  CASE WHEN c_custkey % 45 = 0 THEN 'ruleset_changed' WHEN d = 'delta_ready' THEN 'reliable_section_delta' WHEN d = 'no_selected_delta' THEN 'selected_evidence_unchanged' ELSE 'removed_relevant_section' END AS reason,
  CASE WHEN r = 'no_model' AND c_custkey % 70 <> 0 THEN NULL ELSE 'cd' END AS evidence_sha, CASE WHEN r = 'no_model' THEN 0 ELSE 1 + c_nationkey * 150 END AS evidence_characters, CASE WHEN r = 'no_model' THEN 'none' ELSE 'small' END AS model, CASE WHEN r = 'no_model' AND c_custkey % 65 <> 0 THEN 0 ELSE 768 END AS output_limit,
  r AS route, CASE WHEN r = 'richer_bounded' AND c_custkey % 25 <> 0 THEN 'shadow_only' ELSE 'current_runtime' END AS deployment
  FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'delta_ready' WHEN 1 THEN 'no_selected_delta' ELSE 'full_reanalysis' END AS d, CASE c_custkey % 4 WHEN 0 THEN 'no_model' WHEN 1 THEN 'richer_bounded' ELSE 'bounded' END AS r FROM {customer})""",
    inv.CHANGE_AND_ROUTE,
)
_contract(
    "V15_report_totals",
    "report",
    """SELECT report, sample, available, sample - available + CASE WHEN report % 17 = 0 THEN 1 ELSE 0 END AS unavailable, favorable, CASE WHEN available > 0 THEN favorable * 1.0 / available WHEN report % 2 = 0 THEN 0 END AS rate, 0 AS low, CASE WHEN report % 19 = 0 THEN 2 ELSE 1 END AS high, sample - CASE WHEN report % 23 = 0 THEN 1 ELSE 0 END AS splits, available * 1.0 / sample AS coverage
  FROM (SELECT o_custkey AS report, count(*) AS sample, sum(CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END) AS available, sum(CASE WHEN o_orderstatus = 'F' OR o_orderkey % 30 = 0 THEN 1 ELSE 0 END) AS favorable FROM {orders} GROUP BY o_custkey)""",
    inv.REPORT_COUNTS,
)
_contract(
    "V16_series_invariants",
    "series",
    """SELECT series, sum(CASE WHEN instrument <> series THEN 1 ELSE 0 END) AS n_other_instruments, date '1995-01-05' AS start_date, date '2001-07-25' AS end_date, date '2001-08-20' AS cutoff, min(d) AS first_date, max(d) AS last_date, max(known) AS last_available, count(*) AS n, count(DISTINCT action) AS n_ids,
  sum(CASE WHEN before > d THEN 1 ELSE 0 END) AS n_unsorted, count(*) + CASE WHEN series % 11 = 0 THEN 1 ELSE 0 END AS row_count, min(d) AS coverage_start, CASE WHEN series % 7 = 0 THEN max(known) ELSE max(d) END AS coverage_end
  FROM (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY CASE WHEN series % 3 <> 0 THEN d END, k) AS before FROM (SELECT l_suppkey AS series, CASE WHEN l_orderkey % 900 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS instrument, cast(l_shipdate as date) AS d, cast(l_shipdate as date) + cast(l_orderkey % 30 as int) AS known, l_orderkey * 8 + l_linenumber AS k, (l_orderkey * 8 + l_linenumber) % 100000 AS action FROM {lineitem}))
  GROUP BY series""",
    inv.ACTION_SERIES,
)
_contract(
    "V17_context_rules",
    "event",
    """SELECT event_id AS event, CASE event_type WHEN 'view' THEN 'sec_poll_attempted' WHEN 'error' THEN 'candidate_failed' WHEN 'click' THEN 'candidate_parsed' ELSE 'publication' END AS stage, event_type IN ('error', 'click') AS is_candidate, event_type = 'error' AS is_failure,
  CASE WHEN event_type IN ('error', 'click') AND event_id % 37 <> 0 OR event_id % 41 = 0 THEN event_id END AS accession, CASE WHEN event_type = 'error' AND event_id % 43 <> 0 THEN 'timeout' END AS failure_category, CASE WHEN event_type <> 'view' OR event_id % 31 <> 0 THEN user_id END AS run_id,
  event_id % 4 <> 0 AS invoked, CASE WHEN event_id % 4 = 0 AND event_id % 44 <> 0 THEN 'not_assessed' WHEN event_id % 3 = 0 THEN 'positive' ELSE 'negative' END AS status, event_id % 12 = 3 OR event_id % 47 = 0 AS contributed FROM {events}""",
    inv.TELEMETRY_EVENT,
)


@register(
    "V09_signal_integrity",
    f"""WITH {ev._SIGNALS}, b AS (SELECT subject, count(DISTINCT dimension) AS n_dimensions, {', '.join(f"sum(points) FILTER (dimension = '{d}') AS sum_{d}" for d in ('opportunity', 'risk', 'confidence'))},
  count(*) FILTER (regexp_matches(CASE WHEN subject % 10 = 3 AND points > 9 THEN 'A guaranteed gain' ELSE rule || ' adds points' END, '{inv.PROHIBITED}')) AS n_prohibited FROM t WHERE NOT (subject % 12 = 5 AND dimension = 'risk') GROUP BY 1),
base AS (SELECT *, greatest(0, least(100, sum_opportunity)) + (subject % 9 = 0)::INTEGER AS opportunity, greatest(0, least(100, sum_risk)) AS risk, greatest(0, least(100, sum_confidence)) AS confidence, CASE WHEN sum_confidence < 55 THEN 'Insufficient evidence' ELSE 'Weak opportunity' END AS label, CASE WHEN sum_confidence < 55 AND subject % 8 <> 0 THEN 'unclassified' ELSE 'balanced' END AS profile FROM b)
"""
    + " UNION ALL ".join(f"SELECT subject, '{v}' AS violation FROM base WHERE NOT coalesce({c}, false)" for v, c in inv.SIGNAL_RESULT.items()),
)
def v09(spark: SparkSession, sf: str) -> DataFrame:
    """Scores against their traces; some customers' results are altered so that a rule breaks."""
    s = F.col("subject")
    t = sc.signal_traces(ev._signal_inputs(spark, sf)).select("subject", F.inline("traces")).where(~((s % 12 == 5) & (F.col("dimension") == "risk")))
    said = F.when((s % 10 == 3) & (F.col("points") > 9), "A guaranteed gain").otherwise(F.concat("rule", F.lit(" adds points")))
    dims = ("opportunity", "risk", "confidence")
    b = t.groupBy("subject").agg(F.countDistinct("dimension").alias("n_dimensions"), *[F.sum(F.when(F.col("dimension") == d, F.col("points"))).alias(f"sum_{d}") for d in dims], F.count_if(said.rlike(inv.PROHIBITED)).alias("n_prohibited"))
    low = F.col("sum_confidence") < 55
    b = b.select("*", *[(F.greatest(F.lit(0), F.least(F.lit(100), F.col(f"sum_{d}"))) + (F.when(s % 9 == 0, 1).otherwise(0) if d == "opportunity" else 0)).alias(d) for d in dims], F.when(low, "Insufficient evidence").otherwise("Weak opportunity").alias("label"), F.when(low & (s % 8 != 0), "unclassified").otherwise("balanced").alias("profile"))
    return ro.violations(b, "subject", {v: F.expr(c) for v, c in inv.SIGNAL_RESULT.items()})


@register("V01_append_only", "SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 97 = 0")
def v01(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier snapshot against a later one from which rows are gone and in which some are rewritten."""
    o = table(spark, sf, "orders")
    later = o.where("o_orderkey % 101 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    return inv.snapshot_changes(o, later, "o_orderkey")


@register("H08_receipt_pairs", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 THEN 'appended' WHEN o_orderkey % 4 <> 0 OR o_orderkey % 6 <> 0 THEN 'broken_pair' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'replayed' END AS outcome FROM orders")
def h08(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as incoming pairs; every fourth has a receipt and every sixth a routing row, some of them other ones."""
    o, sha = table(spark, sf, "orders"), F.sha2("o_orderpriority", 256)
    held = lambda n: o.where(f"o_orderkey % {n} = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(sha).alias("sha"))
    return inv.pair_append(o.select("o_orderkey", sha.alias("receipt_sha"), sha.alias("routing_sha")), held(4), held(6), "o_orderkey")


@register("X27_link_binding", "SELECT page_id AS accession, CASE WHEN page_id % 11 = 0 THEN 'not_indexed' WHEN page_id % 7 = 0 THEN 'not_fetched' WHEN page_id % 5 = 0 THEN 'hash_mismatch' WHEN page_id % 3 = 0 THEN 'bound_with_viewer' ELSE 'bound' END AS binding FROM pages")
def x27(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as primary documents; index, earlier fetches and viewers are made so that every binding occurs."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    name = F.concat(F.lit("doc"), k.cast("string"), F.lit(".htm"))
    index = F.concat(F.lit('<a href="/archive/'), F.when(k % 11 == 0, "none.htm").otherwise(name), F.lit('">'))
    f = p.select(k.alias("accession"), name.alias("primary_name"), index.alias("index_html"), F.col("html").alias("body"), F.when(k % 3 == 0, "https://v.w/").alias("viewer_url"))
    fetched = p.where("page_id % 7 <> 0").select(k.alias("accession"), F.sha2(F.when(k % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("body_sha"))
    return inv.link_binding(f, fetched)


@register(
    "R22_amendment_delta",
    """WITH s AS (SELECT conv_id, turn // 2 AS section, turn % 2 AS version, CASE WHEN conv_id % 3 = 0 THEN 'same' ELSE text END AS x FROM conversations),
c AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(a.x) AS n_prior, count(b.x) AS n_current, count(*) FILTER (b.x IS NULL) AS removed, count(*) FILTER (b.x IS NOT NULL AND a.x IS DISTINCT FROM b.x) AS changed, coalesce(sum(length(b.x)) FILTER (a.x IS DISTINCT FROM b.x), 0) AS chars
  FROM (SELECT * FROM s WHERE version = 0) a FULL JOIN (SELECT * FROM s WHERE version = 1) b ON a.conv_id = b.conv_id AND a.section = b.section GROUP BY 1),
r AS (SELECT *, CASE WHEN conv_id % 13 = 0 THEN 'ruleset_changed' WHEN n_prior = 0 OR n_current = 0 THEN 'missing_section_manifest' WHEN removed > 0 THEN 'removed_relevant_section' WHEN changed = 0 THEN 'selected_evidence_unchanged' WHEN chars > 3600 THEN 'delta_exceeds_budget' ELSE 'reliable_section_delta' END AS reason FROM c)
SELECT conv_id, CASE reason WHEN 'reliable_section_delta' THEN 'delta_ready' WHEN 'selected_evidence_unchanged' THEN 'no_selected_delta' ELSE 'full_reanalysis' END AS disposition, reason, CASE WHEN reason = 'reliable_section_delta' THEN changed ELSE 0 END AS changed, CASE WHEN reason = 'removed_relevant_section' THEN removed ELSE 0 END AS removed, CASE WHEN reason = 'reliable_section_delta' THEN chars::BIGINT ELSE 0 END AS delta_characters FROM r""",
)
def r22(spark: SparkSession, sf: str) -> DataFrame:
    """Even turns of a conversation as sections of a filing, odd ones as those of its amendment."""
    t = table(spark, sf, "conversations")
    x = F.when(F.col("conv_id") % 3 == 0, "same").otherwise(F.col("text"))
    s = t.select("conv_id", F.expr("turn div 2").alias("section"), (F.col("turn") % 2).alias("version"), F.sha2(x, 256).alias("sha"), F.length(x).alias("characters"))
    return inv.amendment_delta(s.where("version = 0"), s.where("version = 1"), t.where("conv_id % 13 = 0").select("conv_id").distinct(), "conv_id")


_SUPPORT = ("supported", "too_bullish", "too_bearish", "insufficient", "supported", "supported", "supported")


@register(
    "R23_arbitration",
    f"""WITH e AS (SELECT event_id, user_id, event_id % 3 = 0 AS identity, event_id % 7 = 0 AS unsupported, event_id % 11 = 0 AS risk, event_id % 13 = 0 AS catalyst, event_id % 17 = 0 AS omissions, event_id % 19 = 0 AS uncertainty, {list(_SUPPORT)}[event_id % 7 + 1] AS support, event_id % 5 = 0 AS concerned,
  event_id % 2 = 0 AND event_id % 4 <> 2 AS refuted, event_id % 6 = 1 AS numeric_said FROM events),
x AS (SELECT event_id, CASE WHEN concerned AND refuted THEN 1 ELSE 0 END AS refuted, list_sort(list_distinct(list_filter([CASE WHEN event_id % 23 = 0 THEN 'uncertainty_overstated' END, CASE WHEN identity THEN 'identity_concern' END, CASE WHEN concerned AND NOT refuted THEN 'numeric_concern' END, CASE WHEN unsupported OR support = 'insufficient' THEN 'unsupported_interpretation' END,
  CASE WHEN risk THEN 'missing_material_risk' END, CASE WHEN catalyst THEN 'missing_material_catalyst' END, CASE WHEN omissions THEN 'missing_counterevidence' END, CASE WHEN uncertainty THEN 'uncertainty_overstated' END, CASE WHEN support = 'too_bullish' THEN 'classification_too_bullish' END, CASE WHEN support = 'too_bearish' THEN 'classification_too_bearish' END], lambda c: c IS NOT NULL))) AS cs FROM e)
SELECT event_id, len(cs) = 0 AS approved, array_to_string(cs, ',') AS challenges, refuted::BIGINT AS refuted FROM x""",
)
def r23(spark: SparkSession, sf: str) -> DataFrame:
    """Events as verifier reports; every fifth doubts a number, which claim and record may both hold."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    own = F.array_compact(F.array(F.when(k % 23 == 0, "uncertainty_overstated"), F.when(k % 6 == 1, "numeric_concern"), F.when(k % 4 == 1, "identity_concern")))
    flags = {"identity_concern": 3, "unsupported": 7, "missing_risk": 11, "missing_catalyst": 13, "omissions": 17, "uncertainty": 19}
    reports = e.select("event_id", own.alias("challenges"), *[(k % n == 0).alias(c) for c, n in flags.items()], ev._nth(_SUPPORT, k % 7).alias("support"))
    claim = F.when(k % 4 == 2, "Revenue of 11,250 rose").otherwise("Revenue of 1,250 rose")
    evidence = F.when(k % 2 == 0, "It was $1250, up.").otherwise("It was $12,500, up.")
    concerns = e.where("event_id % 5 = 0").select("event_id", F.lit("1,250").alias("token"), claim.alias("claim"), evidence.alias("evidence"), F.lit(True).alias("cited"))
    return inv.arbitration(reports, concerns, ["event_id"])


@register(
    "D04_lifecycle",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS d, o_orderkey % 3 AS manifest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS r FROM orders),
p AS (SELECT a.o_orderkey, count(*) AS n, max({'d': b.d, 'k': b.o_orderkey, 'm': b.manifest}) FILTER (b.o_orderstatus = a.o_orderstatus) AS p FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.r BETWEEN a.r - 64 AND a.r - 1 AND b.d < a.d GROUP BY 1)
SELECT o.o_orderkey AS accession, CASE WHEN p IS NULL THEN 'snapshot_only' WHEN p.m = manifest THEN 'no_selected_change' ELSE 'selection_recorded' END AS disposition, CASE WHEN n IS NULL THEN 'no_prior_snapshot' WHEN p IS NULL THEN 'no_compatible_prior' WHEN p.m = manifest THEN 'selected_sections_unchanged' ELSE 'changed_sections_selected' END AS reason, p.k AS prior FROM o LEFT JOIN p ON p.o_orderkey = o.o_orderkey""",
)
def d04(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("issuer"), F.col("o_orderstatus").alias("family"), F.to_date("o_orderdate").alias("available_at"), (F.col("o_orderkey") % 3).alias("manifest"))
    return inv.lifecycle(o)


@register("K04_partial_coverage", "SELECT event_type, h AS hours, greatest(min(ts), TIMESTAMP '2024-01-31' - to_hours(h)) AS coverage_start, CASE WHEN min(ts) > TIMESTAMP '2024-01-31' - to_hours(h) THEN 'partial' ELSE 'complete' END AS coverage, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - to_hours(h)) AS n FROM events, (SELECT unnest([24, 168, 719, 800]) AS h) WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1, 2")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that reach back before the first event are covered only from it on."""
    now, hours = F.lit("2024-01-31").cast("timestamp_ntz"), (24, 168, 719, 800)
    start = {h: now - F.expr(f"INTERVAL {h} HOUR") for h in hours}
    by = table(spark, sf, "events").where(F.col("ts") <= now).groupBy("event_type").agg(F.min("ts").alias("first"), *[F.count_if(F.col("ts") >= start[h]).alias(f"n_{h}") for h in hours])
    return by.select("event_type", F.inline(F.array(*[F.struct(F.lit(h).alias("hours"), F.greatest("first", start[h]).alias("coverage_start"), F.when(F.col("first") > start[h], "partial").otherwise("complete").alias("coverage"), F.col(f"n_{h}").alias("n")) for h in hours])))


@register(
    "K11_interrupted_attempts",
    "SELECT l_orderkey AS parent, l_linenumber AS attempt, CASE WHEN o_orderstatus <> 'F' AND l_linenumber < 6 THEN 'interrupted_retryable' ELSE 'interrupted_terminal' END AS closure, CASE WHEN o_orderstatus = 'F' THEN 'unchanged' WHEN l_linenumber < 6 THEN 'queued' ELSE 'failed' END AS parent_status FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND l_shipdate::DATE + 90 < DATE '1998-06-01'",
)
def k11(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as attempts; open ones have line status O, and the parent order is active unless it is finished."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("parent"), (F.col("o_orderstatus") != "F").alias("parent_active"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("attempt"), F.col("l_shipdate").alias("started_at"), (F.col("l_linestatus") != "O").alias("finished")).join(o, "parent")
    return inv.interrupted(a, F.lit("1998-06-01").cast("date"), 90)


@register("K06_hourly_emission", "SELECT event_type, date_trunc('hour', ts) AS hour, arg_min(event_id, (ts, event_id)) AS emitted FROM events GROUP BY 1, 2")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    """One measurement an hour and kind: the first; later ones of the hour are not emitted."""
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("emitted"))


@register("K09_exactly_once", "SELECT user_id, event_type, min(event_id) AS delivered, count(*) - 1 AS suppressed FROM (SELECT *, row_number() OVER (PARTITION BY event_id) AS r FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)) GROUP BY 1, 2")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries by unique key (user and kind), a third of them sent twice: the first counts, the rest is suppressed."""
    e = table(spark, sf, "events")
    sent = e.unionByName(e.where("event_id % 3 = 0"))
    return sent.groupBy("user_id", "event_type").agg(F.min("event_id").alias("delivered"), (F.count("*") - 1).alias("suppressed"))


@register(
    "R30_brief_projection",
    """WITH f AS (SELECT conv_id, turn, trim(regexp_extract(text, '^[^.]*')) AS quote FROM conversations), u AS (SELECT conv_id, quote, min(turn) AS at_turn FROM f WHERE quote <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY at_turn) AS nth FROM u)
SELECT conv_id, count(*) FILTER (nth <= 12) AS n_quotes, sha256(string_agg(quote, chr(10) ORDER BY nth) FILTER (nth <= 12)) AS quotes_sha256, sha256(left(string_agg(quote, ' ' ORDER BY nth) FILTER (nth <= 3), 10000)) AS summary_sha256 FROM r GROUP BY 1""",
)
def r30(spark: SparkSession, sf: str) -> DataFrame:
    """A brief's quotes (each once, in order, twelve at most) and the summary of its first three statements."""
    f = table(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_extract("text", "^[^.]*", 0)).alias("quote")).where("quote <> ''")
    first = f.groupBy("conv_id", "quote").agg(F.min("turn").alias("turn"))
    by = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "quote"))), lambda x: x["quote"]).alias("q"))
    return by.select("conv_id", F.least(F.size("q"), F.lit(12)).cast("long").alias("n_quotes"), F.sha2(F.array_join(F.slice("q", 1, 12), "\n"), 256).alias("quotes_sha256"), F.sha2(F.substring(F.array_join(F.slice("q", 1, 3), " "), 1, 10_000), 256).alias("summary_sha256"))


_DILUTIVE = ("convertible_debt", "preferred_equity", "warrant", "warrant_repricing", "warrant_exercise_inducement", "equity_line")


_QUALIFYING = f"count(*) FILTER (instrument IN {_DILUTIVE} AND status <> 'terminated' AND shares > 0)"


_ADAPTED = {"dilutive_instrument_count": "value", "named_instrument_count": "named", "issuable_shares": "issuable", "registered_shares": "registered"}


@register(
    "R16_fact_adapters",
    f"""WITH t AS ({ev._terms_sql()}), b AS (SELECT doc_id, {_QUALIFYING} AS value, count(*) FILTER (instrument IN {_DILUTIVE}) AS named, (sum(shares) FILTER (instrument IN {_DILUTIVE}))::BIGINT AS issuable, (sum(shares) FILTER (instrument = 'resale_registration'))::BIGINT AS registered FROM t GROUP BY 1)
{" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {c} AS value FROM b WHERE {c} > 0" for k, c in _ADAPTED.items())}""",
)
def r16(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that a filing's financing terms state: its instruments, those in force with stated shares, and the shares; only positive ones."""
    b = fo.dilution_facts(fin.terms(ev._excerpts(spark, sf), "doc_id"), "doc_id")
    return b.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in _ADAPTED.items()]))).where("value > 0")


@register(
    "R17_convergence_producers",
    f"""WITH t AS ({ev._terms_sql()}), b AS (SELECT doc_id, {_QUALIFYING} AS n FROM t GROUP BY 1)
SELECT doc_id, CASE WHEN n > 0 THEN 'eligible_complete_facts' ELSE 'no_relevant_validated_facts' END AS decision, CASE WHEN n > 0 THEN 'supported' END AS disposition, n > 0 AS persisted FROM b""",
)
def r17(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with financing terms as producers of a dilution claim."""
    return fo.financing_claims(fin.terms(ev._excerpts(spark, sf), "doc_id"), "doc_id")


_OWNERSHIP_FORMS = ("4", "4/A", "5", "144", "SC 13D", "3")


@register(
    "R17_ownership_producer",
    f"""WITH f AS (SELECT o_orderkey AS filing, {list(_OWNERSHIP_FORMS)}[o_orderkey % 6 + 1] AS form, o_orderdate::DATE AS event_date, o_totalprice AS planned FROM orders),
t AS (SELECT l_orderkey AS filing, date_trunc('month', l_shipdate)::DATE AS day, l_linenumber % 2 = 0 AS derivative, coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS d FROM lineitem GROUP BY 1, 2, 3)
SELECT filing, CASE WHEN form = '144' THEN 'ownership_form_144' ELSE 'ownership_section_16' END AS source,
  CASE WHEN form = 'SC 13D' THEN 'unsupported_source_context' WHEN form = '144' THEN 'eligible_not_applicable_context' WHEN day IS NULL THEN 'no_relevant_validated_facts' ELSE 'eligible_complete_facts' END AS decision,
  CASE WHEN form = '144' THEN event_date WHEN form <> 'SC 13D' THEN day END AS as_of, CASE WHEN form NOT IN ('144', 'SC 13D') THEN derivative END AS derivative,
  CASE WHEN form = '144' THEN 'not_applicable' WHEN form <> 'SC 13D' AND day IS NOT NULL THEN CASE WHEN a > d THEN 'supported' ELSE 'conflicted' END END AS disposition
FROM f LEFT JOIN t USING (filing) WHERE form NOT IN ('144', 'SC 13D')
UNION ALL SELECT filing, CASE WHEN form = '144' THEN 'ownership_form_144' ELSE 'ownership_section_16' END, CASE WHEN form = '144' THEN 'eligible_not_applicable_context' ELSE 'unsupported_source_context' END, CASE WHEN form = '144' THEN event_date END, NULL, CASE WHEN form = '144' THEN 'not_applicable' END FROM f WHERE form IN ('144', 'SC 13D')""",
)
def r17_ownership(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as filings of six forms, their lines as transactions of a month, derivative or not."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    form = F.element_at(F.array(*[F.lit(x) for x in _OWNERSHIP_FORMS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    filings = o.select(F.col("o_orderkey").alias("filing"), form.alias("form"), F.to_date("o_orderdate").alias("event_date"), F.col("o_totalprice").alias("planned"))
    deals = li.select(F.col("l_orderkey").alias("filing"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), (F.col("l_linenumber") % 2 == 0).alias("derivative"), (F.col("l_returnflag") != "R").alias("acquired"), F.col("l_quantity").alias("shares"))
    return fo.ownership_claims(filings, deals, "filing")


_TAGS = ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "LiabilitiesCurrent", "LiabilitiesCurrent", "Assets")


@register(
    "R17_liquidity_producer",
    f"""WITH f AS (SELECT o_custkey AS filing, {list(_TAGS)}[left(o_orderpriority, 1)::INTEGER] AS tag, round(o_totalprice * 100)::BIGINT AS cents, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, o_orderkey % 7 > 0 AS usd, o_orderkey % 11 > 0 AS instant FROM orders),
g AS (SELECT *, tag LIKE 'Cash%' AS cash FROM f WHERE usd AND instant AND tag <> 'Assets' AND period_end < DATE '2001-06-01'),
p AS (SELECT filing, period_end, count(*) FILTER (cash) AS nc, count(*) FILTER (NOT cash) AS nl, max(cents) FILTER (cash) AS c, max(cents) FILTER (NOT cash) AS l, max(period_end) OVER (PARTITION BY filing) AS latest FROM g GROUP BY 1, 2),
b AS (SELECT filing, bool_or(nc = 1 AND nl = 1) AS complete, bool_or(nc > 0 AND nl > 0 AND NOT (nc = 1 AND nl = 1)) AS ambiguous, bool_or(period_end = latest AND nc = 1 AND nl = 1) AS ready, max(period_end) AS latest, max(c) FILTER (period_end = latest) AS c, max(l) FILTER (period_end = latest) AS l FROM p GROUP BY 1)
SELECT filing, CASE WHEN ready THEN 'eligible_complete_facts' WHEN complete OR ambiguous THEN 'ambiguous_xbrl_context' ELSE 'no_relevant_validated_facts' END AS decision, CASE WHEN ready THEN latest END AS as_of, CASE WHEN ready THEN CASE WHEN c >= l THEN 'supported' ELSE 'conflicted' END END AS disposition
FROM (SELECT DISTINCT filing FROM f) LEFT JOIN b USING (filing)""",
)
def r17_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as tagged facts of one filing: some of another unit, some over a duration, some known too late."""
    o = table(spark, sf, "orders")
    tag = F.element_at(F.array(*[F.lit(x) for x in _TAGS]), F.substring("o_orderpriority", 1, 1).cast("int"))
    end = F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", F.col("o_orderdate"))), 3), 1)
    k = F.col("o_orderkey")
    f = o.select(F.col("o_custkey").alias("filing"), tag.alias("tag"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"), end.alias("period_end"), F.when(k % 7 > 0, "USD").otherwise("EUR").alias("unit"), F.when(k % 11 == 0, F.date_sub(end, 90)).alias("period_start"), F.col("o_orderdate").alias("x"))
    f = f.withColumn("available_at", F.date_add("period_end", 1)).withColumn("retrieved_at", F.date_add("period_end", 1))
    return fo.liquidity_claims(f, "filing", "2001-06-01")
