"""Registered queries on scores, forensic rules, evidence and report checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions import financing as fin
from tidemark.functions import reports as rp
from tidemark.operators import forensics as fo
from tidemark.operators import scoring as sc
from tidemark.tables import FACTS, documents, facts, table

# A metric's stand-in: (factor, modulus, shift, divisor) of a customer's total in cents; null where that leaves j modulo 11.
_SPEC = {
    "cumulative_price_return": (3, 61, -20, 100),
    "benchmark_relative_return": (5, 41, -15, 100),
    "period_over_period_growth": (7, 51, -10, 100),
    "gross_margin": (11, 61, -5, 100),
    "price_to_earnings_ratio": (13, 60, 1, 1),
    "relative_strength_index": (17, 101, 0, 1),
    "annualized_historical_volatility": (19, 90, 0, 100),
    "maximum_drawdown": (23, 70, -69, 100),
    "debt_to_equity_ratio": (29, 260, 0, 100),
}
_CATEGORIES = ("catalyst", "bull_case", "risk", "bear_case", "document_fact")
_STATUSES = ("confirmed", "unresolved", "resolved_by_later_correction", "not_material")


def _array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def _nth(values, n: F.Column) -> F.Column:
    return F.element_at(_array(values), (n + 1).cast("int"))


def _sql_points(name: str) -> str:
    if name == "price_to_earnings_ratio":
        return f"CASE {' '.join(f'WHEN {name} <= {b} THEN {p}' for b, p in sc.VALUATION)} ELSE {sc.VALUATION_ABOVE} END"
    if name == "relative_strength_index":
        return f"CASE {' '.join(f'WHEN {name} BETWEEN {a} AND {b} THEN {p}' for a, b, p in sc.STRENGTH)} ELSE 0 END"
    value = f"abs({name})" if name == "maximum_drawdown" else name
    return f"CASE {' '.join(f'WHEN {value} < {b} THEN {p}' for b, p in sc.BELOW[name][2])} ELSE {sc.BELOW[name][3]} END"


def _some(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{n} IS NOT NULL" for n in names) + ")"


def _trace_sql() -> str:
    rules = {"price_to_earnings_ratio": ("opportunity.valuation", "opportunity"), "relative_strength_index": ("opportunity.rsi", "opportunity")} | {k: v[:2] for k, v in sc.BELOW.items()}
    parts = [(rules[m][0], rules[m][1], f"{m} IS NOT NULL", _sql_points(m)) for m in sc.METRICS]
    parts += [(f"opportunity.qualitative.{k}", "opportunity", f"bull >= {k}", "5") for k in (1, 2)] + [(f"risk.qualitative.{k}", "risk", f"bear >= {k}", "10") for k in (1, 2, 3)]
    parts.append(("risk.contradictions", "risk", "opened + settled > 0", "15 * opened + 3 * settled"))
    parts += [(f"confidence.{s}", "confidence", _some(sc.SLOTS[s]), "10") for s in ("momentum", "benchmark", "fundamentals", "valuation")]
    risk = sc.SLOTS["risk_metrics"]
    parts.append(("confidence.risk_coverage", "confidence", _some(risk), f"CASE WHEN {risk[0]} IS NOT NULL AND {risk[1]} IS NOT NULL THEN 15 ELSE 8 END"))
    parts += [("confidence.validated_analysis", "confidence", "analyses > 0", "15"), ("confidence.cited_sources", "confidence", "cited > 0", "least(20, weight)"), ("confidence.role_diversity", "confidence", "analyses > 0", "least(10, 3 * analyses)"), ("confidence.unresolved_contradiction", "confidence", "opened > 0", "-15")]
    return " UNION ALL ".join(f"SELECT subject, '{r}' AS rule, '{d}' AS dimension, ({p})::INTEGER AS points FROM i WHERE {w}" for r, d, w, p in parts)


_SIGNALS = f"""u AS (SELECT o_custkey AS subject, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS s FROM orders GROUP BY 1),
m AS (SELECT subject, {', '.join(f"CASE WHEN (s + {j}) % 11 <> 0 THEN (s * {a} % {r} + {k}) / {d}.0::DOUBLE END AS {n}" for j, (n, (a, r, k, d)) in enumerate(_SPEC.items()))} FROM u),
said AS (SELECT o_custkey AS subject, 'r' || (o_orderkey % 4) AS role, CASE WHEN o_orderpriority = '1-URGENT' THEN {list(_CATEGORIES)}[o_orderkey % 5 + 1] END AS category,
  CASE WHEN o_orderpriority = '2-HIGH' THEN {list(_STATUSES)}[o_orderkey % 4 + 1] END AS status, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 7 END AS evidence
  FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderkey % 3 = 0)),
f AS (SELECT subject, count(*) FILTER (category IN ('catalyst', 'bull_case')) AS bull, count(*) FILTER (category IN ('risk', 'bear_case')) AS bear, count(*) FILTER (status IN ('confirmed', 'unresolved')) AS opened,
  count(*) FILTER (status NOT IN ('confirmed', 'unresolved')) AS settled, count(DISTINCT evidence) AS cited, count(DISTINCT role) AS analyses FROM said GROUP BY 1),
wt AS (SELECT subject, sum(w)::BIGINT AS weight FROM (SELECT DISTINCT subject, evidence, {list(sc.SOURCE_WEIGHTS.values())}[evidence + 1] AS w FROM said WHERE evidence IS NOT NULL) GROUP BY 1),
i AS (SELECT m.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('bull', 'bear', 'opened', 'settled', 'cited', 'analyses', 'weight'))} FROM m LEFT JOIN f USING (subject) LEFT JOIN wt USING (subject)),
traced AS ({_trace_sql()}),
t AS (SELECT * FROM traced UNION ALL SELECT subject, d || '.no_inputs', d, 0 FROM i, (SELECT unnest(['opportunity', 'risk', 'confidence']) AS d) WHERE (subject, d) NOT IN (SELECT subject, dimension FROM traced))"""


def _signal_inputs(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    u = o.groupBy(F.col("o_custkey").alias("subject")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("s"))
    m = u.select("subject", *[F.when((F.col("s") + j) % 11 != 0, (F.col("s") * a % r + b) / d).alias(n) for j, (n, (a, r, b, d)) in enumerate(_SPEC.items())])
    cited = [F.when(k % 13 != 0, k % 7).alias("evidence_id"), _nth(sc.SOURCE_WEIGHTS, k % 7).alias("source_class")]
    head = [F.col("o_custkey").alias("subject"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("role")]
    found = o.where("o_orderpriority = '1-URGENT'").select(*head, _nth(_CATEGORIES, k % 5).alias("category"), *cited)
    against = o.where("o_orderpriority = '2-HIGH' and o_orderkey % 3 = 0").select(*head, _nth(_STATUSES, k % 4).alias("status"), *cited)
    return sc.signal_inputs(m, found, against)


def _traces(spark: SparkSession, sf: str, pattern: str) -> DataFrame:
    return sc.signal_traces(_signal_inputs(spark, sf)).select("subject", F.inline("traces")).where(F.col("rule").rlike(pattern)).select("subject", "rule", "points")


for _id, _pattern in {
    "R01_opportunity_points": "^opportunity[.](return|relative|growth|margin|valuation|rsi)$",
    "R02_risk_points": "^risk[.](volatility|drawdown|leverage)$",
    "R03_opportunity_findings": "^opportunity[.](qualitative|no_inputs)",
    "R04_risk_findings": "^risk[.](qualitative|contradictions|no_inputs)",
    "R05_confidence": "^confidence[.]",
}.items():
    register(_id, f"WITH {_SIGNALS} SELECT subject, rule, points FROM t WHERE regexp_matches(rule, '{_pattern}')")(lambda spark, sf, p=_pattern: _traces(spark, sf, p))

_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_some(names)} THEN '{slot}' END" for slot, names in sc.SLOTS.items()) + ", CASE WHEN analyses = 0 THEN 'qualitative_analysis' END, CASE WHEN cited = 0 THEN 'cited_evidence' END)"
_SAID = ", ".join([f"'{m}=' || coalesce({m}::DECIMAL(18,4)::VARCHAR, '')" for m in sc.METRICS] + [f"'{shown}=' || {c}" for shown, c in (("bull", "bull"), ("bear", "bear"), ("open", "opened"), ("settled", "settled"), ("weight", "weight"), ("cited", "cited"), ("analyses", "analyses"))])


@register(
    "R06_scores",
    f"""WITH {_SIGNALS},
p AS (SELECT subject, {', '.join(f"greatest(0, least(100, sum(points) FILTER (dimension = '{d}')))::INTEGER AS {d}" for d in ('opportunity', 'risk', 'confidence'))} FROM t GROUP BY 1),
x AS (SELECT p.*, {_MISSING} AS missing, sha256(concat_ws(chr(10), '{sc.RULESET}', subject::VARCHAR, {_SAID})) AS fingerprint FROM p JOIN i USING (subject)),
y AS (SELECT *, CASE WHEN confidence < 55 OR regexp_matches(missing, 'momentum|risk_metrics|qualitative_analysis|cited_evidence') THEN 'Insufficient evidence'
  WHEN opportunity >= 70 AND risk <= 35 AND confidence >= 70 THEN 'Strong opportunity' WHEN opportunity >= 55 AND risk > 60 THEN 'Speculative opportunity' WHEN opportunity >= 55 THEN 'Moderate opportunity' ELSE 'Weak opportunity' END AS label FROM x)
SELECT *, CASE WHEN label = 'Insufficient evidence' THEN 'unclassified' WHEN risk <= 35 AND confidence >= 70 THEN 'conservative' WHEN risk > 60 AND opportunity >= 55 THEN 'aggressive_speculative' WHEN risk > 35 THEN 'elevated_risk' ELSE 'balanced' END AS profile FROM y""",
)
def r06(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores, label, risk profile, missing slots and fingerprint of every customer's inputs."""
    return sc.scores(sc.signal_traces(_signal_inputs(spark, sf)))


_TEXTS = ("There is SUBSTANTIAL doubt about it.", "", "A Reverse Stock Split took effect.", "Nothing to report.", "substantial  doubt")
_PERIODS = f"{FACTS}, w AS (SELECT issuer, period_end, " + ", ".join(f"max(cents) FILTER (concept = '{c}') AS {c}" for c in ("assets", "liabilities", "revenue", "income", "equity")) + " FROM facts GROUP BY 1, 2)"


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    names = ("assets", "liabilities", "revenue", "income", "equity")
    return facts(spark, sf).groupBy("issuer", "period_end").agg(*[F.max(F.when(F.col("concept") == c, F.col("cents"))).alias(c) for c in names])


@register(
    "R14_detectors",
    f"""WITH {_PERIODS}, d AS (SELECT issuer, period_end, assets AS now, CASE WHEN issuer % 10 = 0 THEN 0 ELSE lag(assets) OVER (PARTITION BY issuer ORDER BY period_end) END AS before, income, liabilities, lower({list(_TEXTS)}[issuer % 5 + 1]) AS x FROM w)
SELECT issuer, period_end, 'share_count_growth' AS signal, CASE WHEN now IS NULL OR before IS NULL THEN 'unknown' WHEN before = 0 THEN 'insufficient_evidence' WHEN now > before THEN 'positive' ELSE 'negative' END AS status FROM d
UNION ALL SELECT issuer, period_end, 'liquidity_pressure', CASE WHEN income IS NULL OR liabilities IS NULL THEN 'not_assessed' WHEN income < liabilities THEN 'positive' ELSE 'negative' END FROM d
UNION ALL SELECT issuer, period_end, 'going_concern', CASE WHEN x = '' THEN 'not_assessed' WHEN regexp_matches(x, 'going concern|substantial doubt') THEN 'positive' ELSE 'negative' END FROM d
UNION ALL SELECT issuer, period_end, 'reverse_split', CASE WHEN x = '' THEN 'not_assessed' WHEN regexp_matches(x, 'reverse split|reverse stock split') THEN 'positive' ELSE 'negative' END FROM d""",
)
def r14(spark: SparkSession, sf: str) -> DataFrame:
    """Four detectors; assets stand for shares, income for cash, five sentences for the filing's text."""
    before = F.lag("assets").over(Window.partitionBy("issuer").orderBy("period_end"))
    w = _periods(spark, sf).select("issuer", "period_end", F.col("assets").alias("shares"), F.when(F.col("issuer") % 10 == 0, 0).otherwise(before).alias("prior_shares"), F.col("income").alias("cash"), F.col("liabilities").alias("current_liabilities"), _nth(_TEXTS, F.col("issuer") % 5).alias("text"))
    return fo.detectors(w, ["issuer", "period_end"])


_PREDICATES = ("cash_at_least_current_liabilities", "dilution_exposure_present", "insider_buying_exceeds_selling")
# each fact's stand-in: its value, and the days by which it lies before the period's end
_CLAIM_FACTS = {
    "cash": ("income", "0"),
    "current_liabilities": ("liabilities", "CASE WHEN issuer % 6 = 1 THEN 1 ELSE 0 END"),
    "shares_prior": ("equity", "CASE WHEN issuer % 9 = 2 THEN 0 ELSE 90 END"),
    "shares_current": ("assets", "0"),
    "issuable_shares": ("CASE WHEN issuer % 4 = 0 THEN revenue % 2 END", "0"),
    "dilutive_instruments": ("CASE WHEN issuer % 3 = 0 THEN liabilities % 2 END", "0"),
    "registered_shares": ("CASE WHEN issuer % 5 = 0 THEN income % 3 END", "0"),
    "insider_acquired": ("CASE WHEN issuer % 7 <> 0 THEN revenue END", "0"),
    "insider_disposed": ("CASE WHEN issuer % 7 <> 0 THEN income END", "CASE WHEN issuer % 8 = 1 THEN 5 ELSE 0 END"),
    "planned_sale": ("equity", "0"),
}


@register(
    "R15_contradictions",
    f"""WITH {_PERIODS}, c AS (SELECT issuer, period_end, predicate, (issuer + length(predicate)) % 2 = 0 AS asserted,
  income AS cash, liabilities AS owed, CASE WHEN issuer % 6 = 1 THEN 1 ELSE 0 END AS owed_lag, equity AS prior, CASE WHEN issuer % 9 = 2 THEN 0 ELSE 90 END AS prior_lag, assets AS now,
  CASE WHEN issuer % 4 = 0 THEN revenue % 2 END AS issuable, CASE WHEN issuer % 3 = 0 THEN liabilities % 2 END AS instruments, CASE WHEN issuer % 5 = 0 THEN income % 3 END AS registered,
  CASE WHEN issuer % 7 <> 0 THEN revenue END AS bought, CASE WHEN issuer % 7 <> 0 THEN income END AS sold, CASE WHEN issuer % 8 = 1 THEN 5 ELSE 0 END AS sold_lag, equity AS planned
  FROM w, (SELECT unnest({list(_PREDICATES)}) AS predicate)),
s AS (SELECT *, CASE predicate
  WHEN 'cash_at_least_current_liabilities' THEN CASE WHEN cash IS NULL OR owed IS NULL THEN 'missing' WHEN owed_lag > 0 THEN 'periods' WHEN cash >= owed THEN 'true' ELSE 'false' END
  WHEN 'dilution_exposure_present' THEN CASE WHEN prior IS NOT NULL AND now IS NOT NULL AND prior_lag = 0 THEN 'periods' WHEN coalesce(issuable, 0) > 0 OR coalesce(instruments, 0) > 0 THEN 'true'
    WHEN prior IS NULL OR now IS NULL THEN 'missing' WHEN now > prior THEN 'true' WHEN instruments = 0 AND coalesce(registered, 0) = 0 THEN 'false' ELSE 'missing' END
  ELSE CASE WHEN bought IS NULL AND sold IS NULL AND planned IS NOT NULL THEN 'planned' WHEN bought IS NULL OR sold IS NULL THEN 'missing' WHEN sold_lag > 0 THEN 'periods' WHEN bought > sold THEN 'true' ELSE 'false' END END AS seen FROM c)
SELECT issuer, period_end, predicate, CASE WHEN seen IN ('true', 'false') THEN seen = 'true' END AS observed,
  CASE WHEN seen = 'planned' THEN 'not_applicable' WHEN seen IN ('missing', 'periods') THEN 'insufficient' WHEN (seen = 'true') = asserted THEN 'supported' ELSE 'conflicted' END AS disposition,
  CASE seen WHEN 'planned' THEN 'planned_sale_is_not_executed_transaction' WHEN 'missing' THEN 'required_facts_missing' WHEN 'periods' THEN 'fact_periods_incomparable'
    ELSE CASE WHEN (seen = 'true') = asserted THEN 'exact_facts_support_claim' ELSE 'exact_facts_conflict_with_claim' END END AS reason FROM s""",
)
def r15(spark: SparkSession, sf: str) -> DataFrame:
    """Three claims an issuer and period against the facts of the period."""
    filed = [F.expr(f"CASE WHEN ({v}) IS NOT NULL THEN named_struct('value', ({v}), 'as_of', date_sub(period_end, {lag})) END").alias(n) for n, (v, lag) in _CLAIM_FACTS.items()]
    c = _periods(spark, sf).select("issuer", "period_end", F.explode(_array(_PREDICATES)).alias("predicate"), *filed)
    c = c.withColumn("asserted", (F.col("issuer") + F.length("predicate")) % 2 == 0)
    return fo.contradictions(c).select("issuer", "period_end", "predicate", "observed", "disposition", "reason")


_NAMES = ("ada", "bee", "cat", "dog")
_DISCLOSED = """d AS (SELECT event_id, user_id AS issuer, event_type AS category, CASE WHEN event_id % 5 <> 0 THEN ts - to_hours((event_id % 3)::INTEGER) END AS published_at, ts AS retrieved_at, event_id % 29 AS source_sha,
  list_filter(['ada', 'bee', 'cat', 'dog'], lambda x, i: (event_id * 7 // CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END) % 2 = 1) AS entities, CASE WHEN event_id % 4 = 0 THEN [ts::DATE::VARCHAR] ELSE []::VARCHAR[] END AS dates,
  CASE WHEN event_id % 3 = 0 THEN [(floor(value / 40)::BIGINT)::VARCHAR] ELSE []::VARCHAR[] END AS facts, event_id % 17 = 0 AS historical, user_id % 3 <> 0 AS search_complete FROM events),
e AS (SELECT *, md5(category || ':' || array_to_string(entities, ',')) AS fingerprint, row_number() OVER (PARTITION BY issuer ORDER BY retrieved_at, event_id) AS r FROM d)"""


def _disclosures(spark: SparkSession, sf: str) -> DataFrame:
    """Events as disclosures: the bits of a multiple of the id choose up to four entities."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    bits = F.array_compact(F.array(*[F.when(F.floor(k * 7 / 2**i) % 2 == 1, F.lit(n)) for i, n in enumerate(_NAMES)]))
    none = F.array().cast("array<string>")
    d = e.select(
        "event_id",
        F.col("user_id").alias("issuer"),
        F.col("event_type").alias("category"),
        F.when(k % 5 != 0, F.expr("ts - make_dt_interval(0, cast(event_id % 3 as int))")).alias("published_at"),
        F.col("ts").alias("retrieved_at"),
        (k % 29).alias("source_sha"),
        bits.alias("entities"),
        F.when(k % 4 == 0, F.array(F.to_date("ts").cast("string"))).otherwise(none).alias("dates"),
        F.when(k % 3 == 0, F.array(F.floor(F.col("value") / 40).cast("long").cast("string"))).otherwise(none).alias("facts"),
        (k % 17 == 0).alias("historical"),
        (F.col("user_id") % 3 != 0).alias("search_complete"),
    )
    return d.withColumn("fingerprint", F.md5(F.concat(F.col("category"), F.lit(":"), F.array_join("entities", ","))))


@register(
    "D05_event_novelty",
    f"""WITH {_DISCLOSED},
p AS (SELECT a.event_id, b.event_id AS prior, coalesce(b.published_at, b.retrieved_at) AS o, b.source_sha = a.source_sha AND b.fingerprint = a.fingerprint AS exact,
  b.category = a.category AND (b.fingerprint = a.fingerprint OR (len(b.entities) > 0 AND len(b.entities) < len(a.entities) AND list_has_all(a.entities, b.entities))) AS related,
  b.category = a.category AND list_has_any(a.entities, b.entities) AS meets,
  NOT (list_has_all(b.entities, a.entities) AND list_has_all(b.dates, a.dates) AND list_has_all(b.facts, a.facts)) AS gained
  FROM e a JOIN e b ON a.issuer = b.issuer AND b.r BETWEEN a.r - 64 AND a.r - 1),
g AS (SELECT event_id, max({{'o': o, 'prior': prior}}) FILTER (exact) AS x, max({{'o': o, 'prior': prior, 'gained': gained}}) FILTER (related) AS y, bool_or(meets) AS meets FROM p GROUP BY 1)
SELECT e.event_id, CASE WHEN historical THEN 'historical_context' WHEN x IS NOT NULL THEN 'duplicate_disclosure' WHEN y.gained THEN 'material_update' WHEN y IS NOT NULL THEN 'recap_existing_event' WHEN meets THEN 'unknown_novelty' WHEN search_complete THEN 'new_event' ELSE 'unknown_novelty' END AS disposition,
  CASE WHEN historical THEN 'explicit_historical_context' WHEN x IS NOT NULL THEN 'same_source_document' WHEN y.gained THEN 'supported_material_fact_changed' WHEN y IS NOT NULL THEN 'same_event_no_new_material_fact' WHEN meets THEN 'ambiguous_event_relationship' WHEN search_complete THEN 'complete_search_no_related_event' ELSE 'prior_search_incomplete' END AS reason,
  CASE WHEN historical THEN NULL WHEN x IS NOT NULL THEN x.prior ELSE y.prior END AS prior FROM e LEFT JOIN g USING (event_id)""",
)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    return fo.novelty(_disclosures(spark, sf))


@register(
    "X13_accounting_comparison",
    """WITH e AS (SELECT event_id AS accession, user_id AS issuer, event_type, ts AS accepted_at, ts + to_hours((event_id % 60)::INTEGER) AS retrieved_at, event_id % 40 AS fingerprint, user_id % 2 = 0 AS complete,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
p AS (SELECT a.accession, max({'t': b.accepted_at, 'prior': b.accession}) FILTER (a.fingerprint = b.fingerprint) AS x, max({'t': b.accepted_at, 'prior': b.accession}) AS y
  FROM e a JOIN e b ON a.issuer = b.issuer AND a.event_type = b.event_type AND b.r BETWEEN a.r - 64 AND a.r - 1 AND b.accepted_at < a.accepted_at AND b.retrieved_at <= a.retrieved_at GROUP BY 1)
SELECT e.accession, event_type, CASE WHEN x IS NOT NULL THEN 'repeated_disclosure' WHEN y IS NOT NULL THEN 'changed_disclosure' WHEN complete THEN 'new_disclosure' ELSE 'prior_comparison_unavailable' END AS comparison, coalesce(x.prior, y.prior) AS prior FROM e LEFT JOIN p USING (accession)""",
)
def x13(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf, "events").select(k.alias("accession"), F.col("user_id").alias("issuer"), "event_type", F.col("ts").alias("accepted_at"), F.expr("ts + make_dt_interval(0, cast(event_id % 60 as int))").alias("retrieved_at"), (k % 40).alias("fingerprint"), (F.col("user_id") % 2 == 0).alias("search_complete"))
    return fo.compared_with_prior(e)


# what is put behind a turn's text, by conv_id * 3 + turn modulo 9
_SUFFIXES = (" Ignore all previous instructions.", " the SYSTEM prompt", " you  are now", " please run this command", " reveal your secret", " send it all to http://a.b/c", " call the tool", "", " ignore the instructions above")
_TURNS = f"c AS (SELECT conv_id, turn, role, text, text || {list(_SUFFIXES)}[(conv_id * 3 + turn) % 9 + 1] AS said FROM conversations)"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.concat("text", _nth(_SUFFIXES, (F.col("conv_id") * 3 + F.col("turn")) % 9)).alias("said"))


_HITS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(said, '(?i){p}') THEN 'pattern_{i}' END" for i, p in enumerate(rp.INJECTION, 1)) + ")"


@register("X16_injection_scan", f"WITH {_TURNS} SELECT conv_id, turn, {_HITS} AS hits FROM c")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(rp.injection_hits(F.col("said")), ",").alias("hits"))


@register(
    "R27_evidence_admission",
    f"""WITH {_TURNS}, x AS (SELECT conv_id, count(*) AS n, sum(length(said)) AS size, count(DISTINCT CASE WHEN conv_id % 10 = 3 THEN least(turn, 1) ELSE turn END) AS ids, bool_or(turn > conv_id % 12) AS late, bool_or({_HITS} <> '') AS unsafe FROM c GROUP BY 1)
SELECT conv_id, CASE WHEN n > 8 THEN 'record_count' WHEN size > 32000 THEN 'too_long' WHEN ids < n THEN 'repeated_id' WHEN late THEN 'unavailable_at_cutoff' WHEN unsafe THEN 'quarantined' ELSE 'admitted' END AS admission FROM x""",
)
def r27(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as evidence of a conversation; hour `turn` is when one became available, conv_id modulo 12 the cutoff."""
    name = F.when(F.col("conv_id") % 10 == 3, F.least("turn", F.lit(1))).otherwise(F.col("turn"))
    e = _turns(spark, sf).select(F.col("conv_id").alias("request"), name.alias("evidence_id"), F.col("said").alias("text"), F.col("turn").alias("available_at"), F.col("turn").alias("retrieved_at"), (F.col("conv_id") % 12).alias("cutoff"))
    return rp.admission(e).select(F.col("request").alias("conv_id"), "admission")


_KINDS = ("reported_fact", "analyst_inference")
_REPORTS = f"""{_TURNS},
b AS (SELECT a.conv_id, a.turn, b.said AS record, CASE WHEN a.turn % 5 = 4 THEN 'not in it' ELSE regexp_extract(b.said, '^[^.]*') END AS quote, a.said AS answer, {list(_KINDS)}[(a.conv_id + a.turn) % 2 + 1] AS kind FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
s AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN '  ' || replace(quote, 'e', 'E') WHEN 1 THEN answer ELSE quote || ' 12,5% of -3 at https://x.y/z' END AS statement, CASE WHEN conv_id % 11 = 5 THEN NULL ELSE record END AS known FROM b),
v AS (SELECT *, known IS NULL AS unknown_id, known IS NOT NULL AND NOT contains(known, quote) AS not_verbatim, CASE WHEN known IS NOT NULL AND contains(known, quote) THEN quote ELSE '' END AS support FROM s),
w AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(statement, '[A-Za-z][A-Za-z''-]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains({list(rp.STOP_WORDS)}, x))) AS mine, list_distinct(list_transform(regexp_extract_all(support, '[A-Za-z][A-Za-z''-]{{2,}}'), lambda x: lower(x))) AS theirs FROM v)"""


def _statements(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Findings that turns make about the turn before, and the evidence records that exist."""
    c = _turns(spark, sf)
    quote = F.when((F.col("turn") + 1) % 5 == 4, "not in it").otherwise(F.regexp_extract("said", "^[^.]*", 0))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), quote.alias("quote"))
    b = c.select("conv_id", "turn", F.col("said").alias("answer")).join(before, ["conv_id", "turn"])
    statement = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), F.replace("quote", F.lit("e"), F.lit("E")))).when(F.col("conv_id") % 3 == 1, F.col("answer")).otherwise(F.concat("quote", F.lit(" 12,5% of -3 at https://x.y/z")))
    cite = F.array(F.struct(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("evidence_id"), F.col("quote").alias("quote")))
    found = b.select("conv_id", "turn", statement.alias("statement"), _nth(_KINDS, (F.col("conv_id") + F.col("turn")) % 2).alias("kind"), cite.alias("citations"))
    records = c.where("conv_id % 11 <> 5").select(F.concat_ws("-", "conv_id", "turn").alias("evidence_id"), F.col("said").alias("text"))
    return found, records


_NUMBERS = r"(?:^|[^A-Za-z0-9_])([-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?)"


@register(
    "X17_report_validation",
    rf"""WITH {_REPORTS} SELECT conv_id, turn, concat_ws(',',
  CASE WHEN kind = 'analyst_inference' AND len(list_intersect(mine, theirs)) < greatest(2, (len(mine) + 3) // 4) THEN 'inference_lexically_ungrounded' END,
  CASE WHEN not_verbatim THEN 'quote_not_verbatim' END,
  CASE WHEN kind = 'reported_fact' AND (support = '' OR lower(trim(regexp_replace(statement, '\s+', ' ', 'g'))) <> lower(trim(regexp_replace(support, '\s+', ' ', 'g')))) THEN 'reported_fact_not_verbatim' END,
  CASE WHEN unknown_id THEN 'unknown_evidence_id' END,
  CASE WHEN len(list_filter(regexp_extract_all(statement, '{_NUMBERS}', 1), lambda x: NOT contains(support, x))) > 0 THEN 'unsupported_numeric_token' END,
  CASE WHEN len(list_filter(regexp_extract_all(statement, 'https?://[^\s)\]}}>"'']+'), lambda x: NOT contains(support, x))) > 0 THEN 'unsupported_url' END) AS errors FROM w""",
)
def x17(spark: SparkSession, sf: str) -> DataFrame:
    found, records = _statements(spark, sf)
    return rp.finding_errors(found, records, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@register(
    "R26_failure_class",
    rf"""WITH q AS (SELECT event_id, list_filter({list(rp.ERROR_CODES)}, lambda x, i: (event_id * 31 + i * i) % 7 = 0) AS codes FROM events)
SELECT event_id, CASE WHEN list_contains(codes, 'unknown_evidence_id') THEN 'invalid_evidence_id' WHEN list_contains(codes, 'unsupported_numeric_token') THEN 'numeric_conflict'
  WHEN list_has_any(codes, {list(rp.FAILURES['provenance_failure'][1])}) THEN 'provenance_failure' WHEN list_has_any(codes, {list(rp.FAILURES['invalid_enum'][1])}) THEN 'invalid_enum'
  WHEN list_has_any(codes, {list(rp.FAILURES['unsupported_claim'][1])}) THEN 'unsupported_claim' ELSE 'other' END AS category,
  CASE WHEN list_contains(codes, 'unknown_evidence_id') THEN '$.findings.citations.evidence_id' WHEN list_contains(codes, 'unsupported_numeric_token') THEN '$.findings.statement'
  WHEN list_has_any(codes, {list(rp.FAILURES['provenance_failure'][1])}) THEN '$.contradictions' WHEN list_has_any(codes, {list(rp.FAILURES['invalid_enum'][1])}) THEN '$.role'
  WHEN list_has_any(codes, {list(rp.FAILURES['unsupported_claim'][1])}) THEN '$.findings' ELSE '$' END AS path FROM q""",
)
def r26(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    codes = F.array_compact(F.array(*[F.when((k * 31 + i * i) % 7 == 0, F.lit(c)) for i, c in enumerate(rp.ERROR_CODES, 1)]))
    return table(spark, sf, "events").select("event_id", *rp.failure(codes))


# ten words of the tables' texts that stand for the terms of either polarity
_UP, _DOWN = ("the ", "license", "token", "ing ", "phone"), ("der ", "les ", "error", "rights", "que ")


@register("X05_keyword_windows")
def x05(spark: SparkSession, sf: str) -> DataFrame:
    """Up to six windows that do not overlap, one for each polarity first.  A fold, which tests compare with a plain version."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", rp.keyword_windows(t, _UP, _DOWN).alias("w")).select("doc_id", F.size("w").alias("n_windows"), F.sha2(rp.excerpt_of(F.col("w")), 256).alias("excerpt_sha256"))


@register(
    "R08_radar_points",
    f"""WITH h AS (SELECT doc_id, {' + '.join(f"contains(lower(text), '{t}')::INTEGER" for t in _UP)} AS up, {' + '.join(f"contains(lower(text), '{t}')::INTEGER" for t in _DOWN)} AS down FROM documents),
f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (category IN ('catalyst', 'bull_case') OR polarity = 'bullish') AS pos, count(*) FILTER (category IN ('risk', 'bear_case') OR polarity = 'bearish') AS neg, sum(k)::BIGINT AS cites, count(DISTINCT role) AS analyses
  FROM (SELECT o_custkey % (SELECT count(*) FROM documents) AS doc_id, {list(_CATEGORIES)}[o_orderkey % 5 + 1] AS category, ['bullish', 'neutral', 'bearish', 'neutral'][o_orderkey % 4 + 1] AS polarity, o_orderkey % 3 AS k, o_orderstatus AS role FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1),
p AS (SELECT doc_id, pos, neg, least(100, up * 5 + pos * 18 + n * 3)::INTEGER AS attention, least(100, down * 7 + neg * 18)::INTEGER AS risk, least(100, 35 + analyses * 15 + cites * 5)::INTEGER AS strength FROM h JOIN f USING (doc_id))
SELECT doc_id, attention, risk, strength, CASE WHEN pos > 0 AND neg > 0 AND least(attention, risk) >= 30 THEN 'mixed' WHEN pos > 0 AND attention >= 35 THEN 'opportunity' WHEN neg > 0 AND risk >= 35 THEN 'risk' ELSE 'watch' END AS classification FROM p""",
)
def r08(spark: SparkSession, sf: str) -> DataFrame:
    """Findings are urgent orders, dealt to documents by customer; a document without findings gets no brief."""
    docs, k = table(spark, sf, "documents"), F.col("o_orderkey")
    n = docs.count()
    found = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % n).alias("doc_id"), _nth(_CATEGORIES, k % 5).alias("category"), _nth(("bullish", "neutral", "bearish", "neutral"), k % 4).alias("polarity"), (k % 3).alias("citations"), F.col("o_orderstatus").alias("role"))
    terms = docs.select("doc_id", rp.terms_found(F.col("text"), _UP).alias("up"), rp.terms_found(F.col("text"), _DOWN).alias("down"))
    return rp.radar_points(terms, found, "doc_id")


@register(
    "R12_adaptive_route",
    """WITH x AS (SELECT conv_id, count(*) > 1 AS needs, max(length(text)) > 1500 AS complex, bool_or(role = 'system') AS important FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN NOT needs THEN 'no_model' WHEN complex OR important THEN 'richer_bounded' ELSE 'bounded' END AS route, CASE WHEN needs AND (complex OR important) THEN 'shadow_only' ELSE 'current_runtime' END AS deployment,
  CASE WHEN NOT needs THEN 'none' WHEN complex OR important THEN 'richer_bounded_shadow' ELSE 'accepted_bounded' END AS evidence_profile, CASE WHEN needs AND (complex OR important) THEN 'unavailable_no_benefit_evidence' ELSE 'not_requested' END AS larger_model FROM x""",
)
def r12(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "conversations").groupBy("conv_id").agg((F.count("*") > 1).alias("requires_model"), (F.max(F.length("text")) > 1500).alias("complex"), F.bool_or(F.col("role") == "system").alias("important"))
    return x.select("conv_id", *rp.compute_route(F.col("requires_model"), F.col("complex"), F.col("important")))


_FOUND_SECTIONS = ("liquidity", "risks", "going_concern", "debt", "issuance", "litigation", "controls", "outlook")
_VERSIONS = f"s AS (SELECT conv_id, turn // 2 AS section, {list(_FOUND_SECTIONS)}[turn // 2 % 8 + 1] AS category, turn % 2 AS version, text FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, 100 + turn, {list(_FOUND_SECTIONS)}[(turn * 3) % 8 + 1], v, CASE WHEN v = 1 AND turn % 2 = 1 THEN left(text, 40) || '#' || substr(text, 41) ELSE text END FROM conversations, (SELECT unnest([0, 1]) AS v))"


@register(
    "D02_changed_excerpts",
    f"""WITH {_VERSIONS},
c AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.section, b.section) AS section, coalesce(b.category, a.category) AS category, a.text AS x, b.text AS y, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' ELSE 'modified' END AS kind
  FROM (SELECT * FROM s WHERE version = 0) a FULL JOIN (SELECT * FROM s WHERE version = 1) b ON a.conv_id = b.conv_id AND a.section = b.section WHERE a.text IS DISTINCT FROM b.text),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY list_position({list(_FOUND_SECTIONS)}, category), section) AS nth FROM c),
d AS (SELECT *, CASE kind WHEN 'modified' THEN coalesce(list_min(list_filter(range(1, least(length(x), length(y)) + 1), lambda k: x[k] <> y[k])) - 1, least(length(x), length(y))) END AS k0 FROM r WHERE nth <= 6),
e AS (SELECT *, CASE WHEN kind = 'modified' THEN greatest(0, least(k0 - 150, length(x) - 300)) ELSE 0 END AS p, CASE WHEN kind = 'modified' THEN greatest(0, least(k0 - 150, length(y) - 300)) ELSE 0 END AS q FROM d)
SELECT conv_id, section, category, kind, k0::INTEGER AS first_difference, sha256(coalesce(substr(x, p + 1, CASE WHEN kind = 'modified' THEN 300 ELSE 600 END), '')) AS previous_sha256, sha256(coalesce(substr(y, q + 1, CASE WHEN kind = 'modified' THEN 300 ELSE 600 END), '')) AS current_sha256 FROM e""",
)
def d02(spark: SparkSession, sf: str) -> DataFrame:
    """Whole sections of two versions; the six first changed ones by category, with excerpts around their first difference."""
    t = table(spark, sf, "conversations")
    own = t.where("role <> 'system'").select("conv_id", F.expr("turn div 2").alias("section"), _nth(_FOUND_SECTIONS, F.expr("turn div 2") % 8).alias("category"), (F.col("turn") % 2).alias("version"), "text")
    edited = F.when((F.col("v") == 1) & (F.col("turn") % 2 == 1), F.concat(F.substring("text", 1, 40), F.lit("#"), F.expr("substr(text, 41)"))).otherwise(F.col("text"))
    more = t.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select("conv_id", (F.col("turn") + 100).alias("section"), _nth(_FOUND_SECTIONS, F.col("turn") * 3 % 8).alias("category"), F.col("v").cast("long").alias("version"), edited.alias("text"))
    s = own.unionByName(more)
    out = rp.changed_excerpts(s.where("version = 0"), s.where("version = 1"), "conv_id", "section", _FOUND_SECTIONS)
    return out.select("conv_id", "section", "category", "kind", "first_difference", F.sha2(F.coalesce("previous", F.lit("")), 256).alias("previous_sha256"), F.sha2(F.coalesce("current", F.lit("")), 256).alias("current_sha256"))


_DEALS = (
    "Our partnership with Acme Corp and Blue Sky Ltd to build a plant over $2.5 million.",
    "A partnership with Acme Corp to raise capital.",
    "Partnerships with Delta Inc, Epsilon AG and Zeta SA to finance at least $3 billion! Nothing else.",
    "One partnership with A B and C D to deploy. Another partnership with E F and G H to build.",
    "No deal was made.",
)
_DEAL_SQL = f"x AS (SELECT doc_id, regexp_replace(text, '[.!?]', ',', 'g') || '. ' || {list(_DEALS)}[doc_id % 5 + 1] AS t FROM documents)"


@register(
    "X14_partnerships",
    rf"""WITH {_DEAL_SQL}, s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(t, '\s+', ' ', 'g'), '[.!?]'), lambda q: contains(lower(q), 'partnership'))) AS q FROM x),
c AS (SELECT doc_id, trim(q) AS q, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(regexp_extract(q, '(?i)\bwith\s+(.{{3,500}}?)\s+to\s+(?:mobilize|raise|deploy|establish|create|build|finance)\b', 1)), '(?i)^(the\s+)?(strategic\s+)?(partnerships?\s+)?', ''), '\s*,\s*|\s+and\s+'), lambda n: trim(n, ' ,')), lambda n: n <> '') AS names FROM s),
k AS (SELECT * FROM c WHERE len(names) >= 2)
SELECT doc_id, array_to_string(list_sort(list_transform(any_value(names), lambda n: lower(n))), '|') AS entities, nullif(lower(any_value(regexp_extract(q, '(?i)(over|more than|at least|up to|approximately)\s*\$', 1))), '') AS comparator,
  replace(any_value(regexp_extract(q, '\$\s*([0-9][0-9,.]*)', 1)), ',', '') AS amount, nullif(lower(any_value(regexp_extract(q, '(?i)\$\s*[0-9][0-9,.]*\s*(million|billion|trillion)', 1))), '') AS scale FROM k GROUP BY 1 HAVING count(*) = 1""",
)
def x14(spark: SparkSession, sf: str) -> DataFrame:
    """A deal's sentence behind each text, whose own sentence marks are taken out; only one candidate a text is believed."""
    t = F.concat(F.regexp_replace("text", "[.!?]", ","), F.lit(". "), _nth(_DEALS, F.col("doc_id") % 5))
    return rp.partnerships(table(spark, sf, "documents").select("doc_id", t.alias("text")), "doc_id")


# sentences that stand behind a text, chosen by doc_id
_FINANCING = (
    "The proposed resale or other disposition by holders of up to 1,250,000 shares; we will not receive any proceeds.",
    "Under our ATM facility we reduce the maximum aggregate offering price from $50,000,000 to $12,500,000. To date we have sold 40,500 ADSs having an aggregate offering price of approximately $81,000.50.",
    "The issuer is offering on a best-efforts basis up to 3,000,000 Class A Ordinary Shares at a public offering price of $4.25 per Class A Ordinary Share.",
    "It agreed to sell to investors in a private placement to be closed soon an aggregate of 900,000 shares of stock at an offering price of $2.10 per Share. The gross proceeds of the Private Placement are expected to be approximately $1.89 million.",
    "The company issued to a lender a senior secured convertible promissory note in the original principal amount of $5,000,000. The Convertible Note bears interest at an annual rate of 8.5%. The Convertible Note matures on March 31, 2027.",
    "It agreed to sell (i) 10,000 shares of Series A 10% Convertible Preferred Stock for aggregate gross proceeds of $10,000,000.",
    "And in a concurrent private placement we are issuing unregistered warrants to purchase up to 500,000 Common Shares at an exercise price of $1.15 per share.",
    "It was previously amended to establish a reduced exercise price period and the exercise price was amended to $3.00 per Warrant share. We now amend the exercise price to $1.50 per Warrant share.",
    "Holders agreed to exercise the Existing Warrants for cash at a reduced exercise price of $0.75 per share for new Class B warrants to purchase up to 2,000,000 shares; the exercise price thereof is $0.90 per share. If all of the Existing Warrants are exercised in full we will receive aggregate gross proceeds of approximately $1.5 million.",
    "The Equity Purchase Agreement provided the Company the right, but not the obligation, to direct the Investor to purchase up to $20,000,000. The Equity Purchase Agreement terminated effective as of June 1.",
    "It closed its previously announced notes offering of $1.25 billion aggregate principal amount of its 6.125% senior notes due 2031. The Notes will mature on May 15, 2031.",
    "It closed its previously announced notes offering of $300 million aggregate principal amount of its 5% senior notes due 2030. The Notes will mature on May 15, 2031.",
    "The issuer is offering up to 3,500,000 Common Shares at a public offering price of $4.25 per Common Share.",
    "Nothing was financed.",
)


def _excerpts(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    broken = [s.replace(" shares of ", " shares\n\tof ") for s in _FINANCING]  # phrases over a line break
    behind = lambda n: F.concat_ws(" ", "text", _nth(broken, n))
    return d.select("doc_id", F.explode(F.array(behind(F.col("doc_id") % 14), behind(F.col("doc_id") * 5 % 14))).alias("text"))


def _terms_sql() -> str:
    """Each pattern's distinct statements by document, then one branch a term."""
    broken = [s.replace(" shares of ", " shares\n\tof ") for s in _FINANCING]
    x = "x AS (SELECT doc_id, trim(regexp_replace(text || ' ' || " + str(broken).replace("\\n\\t", "  ") + "[n + 1], '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM documents, (SELECT unnest([0, 1]) AS k) , LATERAL (SELECT CASE k WHEN 0 THEN doc_id % 14 ELSE doc_id * 5 % 14 END AS n))"
    groups = ", ".join(f"list(DISTINCT [{', '.join(f"regexp_extract(t, '(?i){p}', {i})" for i in range(1, fin.GROUPS[n] + 1))}]) FILTER (regexp_matches(t, '(?i){p}')) AS {n}" for n, p in fin.PATTERNS.items())
    has = ", ".join(f"bool_or({' OR '.join(f"contains(lower(t), '{p}')" for p in phrases)}) AS has_{s}" for s, phrases in fin.SIGNALS.items() if s in ("atm_program", "public_offering", "offering_price", "private_placement"))
    has += f", bool_or(contains(lower(t), '{fin.NO_PROCEEDS}')) AS has_no_proceeds, bool_or(contains(lower(t), '{fin.LINE_ENDED}')) AS has_line_ended"
    g = lambda n, i: f"{n}[1][{i}]"
    num = lambda n, i: f"replace({g(n, i)}, ',', '')::DECIMAL(24,4)"
    big = lambda n, i, j: f"({num(n, i)}::DECIMAL(18,4) * CASE WHEN lower({g(n, j)}) = 'billion' THEN 1000000000 ELSE 1000000 END)::DECIMAL(24,4)"
    day = lambda n: f"try_strptime({g(n, 1)}, '%B %d, %Y')::DATE"
    rows = (
        ("resale IS NOT NULL AND has_no_proceeds", "resale_registration", "registered", {"shares": num("resale", 1)}),
        ("capacity IS NOT NULL AND has_atm_program", "atm_program", "amended", {"amount": num("capacity", 2), "shares": num("sales", 1), "sale_amount": num("sales", 2)}),
        ("offering IS NOT NULL AND has_public_offering AND has_offering_price", "public_offering", "priced", {"shares": num("offering", 1), "price": num("offering", 2)}),
        ("placement IS NOT NULL AND has_private_placement", "pipe", "priced", {"shares": num("placement", 1), "price": num("placement", 2), "amount": big("placement_gross", 1, 2)}),
        ("note IS NOT NULL", "convertible_debt", "closed", {"amount": num("note", 1), "rate": num("note_interest", 1), "maturity": day("note_maturity"), "covenants": g("note_covenant", 1)}),
        ("preferred IS NOT NULL", "preferred_equity", "proposed", {"shares": num("preferred", 1), "amount": num("preferred", 2)}),
        ("warrant IS NOT NULL", "warrant", "priced", {"shares": num("warrant", 1), "exercise_price": num("warrant", 2)}),
        ("repricing IS NOT NULL", "warrant_repricing", "amended", {"price": num("repricing", 1), "exercise_price": num("repricing", 2)}),
        ("inducement IS NOT NULL AND inducement_shares IS NOT NULL AND inducement_price IS NOT NULL", "warrant_exercise_inducement", "proposed", {"shares": num("inducement_shares", 1), "price": num("inducement", 1), "exercise_price": num("inducement_price", 1), "amount": big("inducement_gross", 1, 2)}),
        ("equity_line IS NOT NULL AND has_line_ended", "equity_line", "terminated", {"amount": num("equity_line", 1)}),
        ("debt IS NOT NULL AND debt_maturity IS NOT NULL", "debt", "closed", {"amount": big("debt", 1, 2), "rate": num("debt", 3), "maturity": day("debt_maturity")}),
    )
    clash = " OR ".join([f"coalesce(len({n}), 0) > 1" for n in fin.PATTERNS] + [f"coalesce(NOT ends_with({g('debt_maturity', 1)}, {g('debt', 4)}), false)"])
    kinds = {"maturity": "DATE", "basis": "VARCHAR", "covenants": "VARCHAR"}
    fields = lambda v: ", ".join(f"({v.get(f, 'NULL')})::{kinds.get(f, 'DECIMAL(24,4)')} AS {f}" for f in ("amount", "shares", "price", "exercise_price", "rate", "maturity", "sale_amount", "basis", "covenants"))
    based = lambda i, v: v | ({"basis": f"CASE WHEN {v['amount']} IS NOT NULL THEN '{fin.BASES[i]}' END"} if "amount" in v else {})
    parts = [f"SELECT doc_id, '{i}' AS instrument, '{s}' AS status, {fields(based(i, v))} FROM z WHERE NOT clash AND {w}" for w, i, s, v in rows]
    return f"WITH {x}, y AS (SELECT doc_id, {groups}, {has} FROM x GROUP BY 1), z AS (SELECT *, {clash} AS clash FROM y) " + " UNION ALL ".join([f"SELECT doc_id, 'conflict' AS instrument, 'conflict' AS status, {fields({})} FROM z WHERE clash", *parts])


@register("X10_financing_terms", _terms_sql())
def x10(spark: SparkSession, sf: str) -> DataFrame:
    """Two excerpts a document, each its whole text and a sentence behind it; eleven kinds of terms, and conflicts."""
    return fin.terms(_excerpts(spark, sf), "doc_id")


@register("X09_financing_windows")
def x09(spark: SparkSession, sf: str) -> DataFrame:
    """Windows around the signal phrases of a whole text with two such sentences.  A fold, which tests compare with a plain version."""
    t = F.concat_ws(" ", _nth(_FINANCING, F.col("doc_id") % 14), "text", _nth(_FINANCING, F.col("doc_id") * 3 % 14))
    w = documents(spark, sf).select("doc_id", fin.evidence_windows(t).alias("windows"))
    return w.select("doc_id", F.posexplode("windows").alias("pos", "w")).select("doc_id", "pos", "w.start", "w.stop", F.array_join("w.signals", ",").alias("signals"))


# headings that stand before and between the halves of a page's text
_HEADS = ("Item 1A. Risk Factors ", "RISK FACTORS ", "Item 3. Legal Proceedings ", "Use of Proceeds 12 13 14 SIGNATURES AND MORE ", "Debt Financing ", "Business Outlook ", "Item 4. Controls and Procedures ", "Item 1 Item 2 Item 3 Dilution ", "Risk Factors ", "1. General 2. Debt Financing ")
# what stands behind them
_BORDERED = ("Item 9. End ", "7. Other Information ", "SIGNATURES ", "note 2.7. Not a border 8. ab ")


def _sections_sql() -> str:
    """The same places by regular expressions without look-around."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    bare = lambda x: f"list_transform({x}, lambda s: length(replace(s, chr(3), '')))"

    def places(name: str, source: str, pattern: str) -> str:
        found = f"SELECT doc_id, periodic, visible, {bare(f'string_split_regex({source}, {q(pattern)})')} AS gaps, {bare(f'regexp_extract_all({source}, {q(pattern)})')} AS ns FROM t"
        rows = f"SELECT doc_id, periodic, visible, generate_subscripts(ns, 1) AS pos, unnest(ns) AS n, gaps FROM ({found})"
        return f"{name} AS (SELECT doc_id, periodic, visible, stop - n AS start, stop FROM (SELECT *, sum(gaps[pos] + n) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM ({rows})))"

    ctes, heads = [], []
    for i, (selector, (heading, items)) in enumerate(rp.HEADINGS.items()):
        ctes.append(places(f"h{i}", "visible", rf"\b(?:{heading})\b"))
        context = rf" WHERE NOT periodic OR regexp_matches(visible[greatest(0, start - 48)::BIGINT + 1 : start::BIGINT], '(?:ITEM|Item)\s+(?:{items})\.?\s*$')" if items else ""
        heads.append(f"SELECT doc_id, periodic, '{selector}' AS selector, start, stop, visible[start::BIGINT + 1 : start::BIGINT + 20000] AS body FROM h{i}{context}")
    border = rp.BORDER.replace("\x03", "\\x03")
    ctes.append(places("b", "numbered", border))
    return ", ".join([*ctes, "heads AS (" + " UNION ALL ".join(heads) + ")"])


@register(
    "X08_item_sections",
    rf"""WITH t AS (SELECT *, regexp_replace(visible, '(^|[^\w.])([0-9]{{1,2}}\.)', '\1' || chr(3) || '\2', 'g') AS numbered FROM (SELECT doc_id, doc_id % 2 = 0 AS periodic,
  trim(regexp_replace({list(_HEADS)}[doc_id % 10 + 1] || text || ' ' || {list(_HEADS)}[doc_id * 4 % 10 + 1] || text || ' ' || {list(_BORDERED)}[doc_id % 4 + 1] || text, '[ \t\n\r\f]+', ' ', 'g')) AS visible FROM documents)),
{_sections_sql()},
marks AS (SELECT doc_id, start AS place, 0 AS kind, NULL AS periodic, NULL AS selector, NULL AS begin, NULL AS body FROM (SELECT doc_id, start FROM b UNION ALL SELECT doc_id, start FROM heads UNION ALL SELECT doc_id, length(visible) FROM t)
  UNION ALL SELECT doc_id, stop, 1, periodic, selector, start, body FROM heads),
p AS (SELECT *, min(place) FILTER (kind = 0) OVER (PARTITION BY doc_id ORDER BY place, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM marks),
s AS (SELECT doc_id, periodic, selector, begin, trim(body[1 : coalesce(stop - begin, length(body))::BIGINT]) AS section FROM p WHERE kind = 1),
g AS (SELECT *, regexp_replace(left(section, 600), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]', 'x', 'g') AS x FROM s WHERE length(section) >= 80),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, selector ORDER BY NOT periodic AND NOT regexp_matches(section, '^[A-Z]{{2}}'), begin) AS nth FROM g
  WHERE NOT (len(regexp_extract_all(x, '\b(?:ITEM|Item)\s+[0-9]')) >= 3 OR len(regexp_extract_all(x, '\b[0-9]{{1,3}}\s+(?:ITEM|Item|PART|Part)\b')) >= 2 OR (len(regexp_extract_all(x, '\b(?:S-|F-)?[0-9]{{1,3}}\b')) >= 3 AND len(regexp_extract_all(x, '\b[A-Z][A-Z &’''\-/]{{4,}}\b')) >= 2)))
SELECT doc_id, selector, begin::BIGINT AS start, length(section)::INTEGER AS n, sha256(section) AS section_sha256 FROM r WHERE nth = 1""",
)
def x08(spark: SparkSession, sf: str) -> DataFrame:
    """Each text twice, with a heading before either and a border behind; even documents are periodic forms, which need the item before some."""
    k = F.col("doc_id")
    t = F.concat(_nth(_HEADS, k % 10), F.col("text"), F.lit(" "), _nth(_HEADS, k * 4 % 10), F.col("text"), F.lit(" "), _nth(_BORDERED, k % 4), F.col("text"))
    d = documents(spark, sf).select("doc_id", t.alias("text"), (k % 2 == 0).alias("periodic"))
    return rp.sections(d, "doc_id", "text", "periodic").select("doc_id", "selector", "start", F.length("section").alias("n"), F.sha2("section", 256).alias("section_sha256"))
