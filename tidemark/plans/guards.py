"""Registered queries on bounds, recomputation and failure classes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.catalog import register
from tidemark.functions import exact as ex
from tidemark.functions import reports as rp
from tidemark.operators import ledger as led
from tidemark.operators import outcomes as oc
from tidemark.operators.scoring import first_true
from tidemark.tables import table

_LIMBS = ", ".join(f"l{i} AS (SELECT *, r{i - 1} * 1000000000 // d AS q{i}, r{i - 1} * 1000000000 % d AS r{i} FROM l{i - 1})" for i in range(1, ex.LIMBS + 1))
_DIGITS = "q0::VARCHAR || " + " || ".join(f"lpad(q{i}::VARCHAR, 9, '0')" for i in range(1, ex.LIMBS + 1))
_RETURNS = f"""x AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS a, round(o_totalprice * 100)::BIGINT + (o_orderkey * 7919 % 2000001) - 1000000 AS b FROM orders),
l0 AS (SELECT *, abs(b - a)::HUGEINT // a AS q0, abs(b - a)::HUGEINT % a AS r0, a::HUGEINT AS d FROM x WHERE a > 0), {_LIMBS},
s AS (SELECT *, ltrim({_DIGITS}, '0') AS z FROM l{ex.LIMBS}), p AS (SELECT *, z[:34] AS k, z[35:] AS rest FROM s),
u AS (SELECT *, length(rest) > 0 AND (rest > rpad('5', length(rest)::INTEGER, '0') OR (rest = rpad('5', length(rest)::INTEGER, '0') AND (r{ex.LIMBS} > 0 OR k[-1]::INTEGER % 2 = 1))) AS up FROM p),
w AS (SELECT *, CASE WHEN b = a THEN '' ELSE (k::HUGEINT + up::INTEGER)::VARCHAR END AS whole FROM u),
v AS (SELECT o_orderkey, CASE WHEN b = a THEN '0E0' ELSE CASE WHEN b < a THEN '-' ELSE '' END || rtrim(whole, '0') || 'E' || (length(rest) - 63 + length(whole) - length(rtrim(whole, '0'))) END AS value FROM w)"""


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    a = F.round(F.col("o_totalprice") * 100).cast("long")
    x = table(spark, sf, "orders").select("o_orderkey", a.alias("a"), (a + F.col("o_orderkey") * 7919 % 2000001 - 1000000).alias("b")).where("a > 0")
    return x.select("o_orderkey", ex.quotient(F.col("b") - F.col("a"), F.col("a")).alias("value"))


@register("V03_returns_34_digits", f"WITH {_RETURNS} SELECT o_orderkey, value FROM v")
def v03_digits(spark: SparkSession, sf: str) -> DataFrame:
    """A price and one a few thousand away: the return to 34 digits, half to even."""
    return _returns(spark, sf)


@register("V03_returns_disagree", f"WITH {_RETURNS}, r AS (SELECT *, CASE WHEN o_orderkey % 10 = 3 THEN replace(value, 'E', '1E') ELSE value END AS recorded FROM v) SELECT o_orderkey, recorded, value AS recomputed FROM r WHERE recorded <> value")
def v03_disagree(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded returns, a tenth of them with a digit too many, against the returns worked out again."""
    again = _returns(spark, sf)
    recorded = again.withColumn("value", F.when(F.col("o_orderkey") % 10 == 3, F.replace("value", F.lit("E"), F.lit("1E"))).otherwise(F.col("value")))
    return led.mismatches(recorded, again, ["o_orderkey"], "value")


_ODD = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{00A0}\x{3000}]"


@register(
    "P05_argument_bounds",
    rf"""WITH q AS (SELECT doc_id, doc_id * 37 % 700 - 50 AS n, doc_id * 7001 % 150000 - 1000 AS skip, CASE WHEN doc_id % 9 > 0 THEN substr(text, 1 + (doc_id % 50)::INTEGER, (doc_id % 80)::INTEGER) END AS query FROM documents)
SELECT doc_id, CASE WHEN n < 1 OR n > 500 THEN 'limit_out_of_bounds' WHEN skip < 0 OR skip > 100000 THEN 'offset_out_of_bounds' WHEN length(query) > 64 THEN 'query_too_long' WHEN regexp_matches(query, '{_ODD}') THEN 'query_not_printable' ELSE 'accepted' END AS verdict FROM q""",
)
def p05(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as the arguments of a page request; parts of its text are what is searched."""
    k = F.col("doc_id")
    text = F.when(k % 9 > 0, F.substr("text", (1 + k % 50).cast("int"), (k % 80).cast("int")))
    q = table(spark, sf, "documents").select("doc_id", (k * 37 % 700 - 50).alias("limit"), (k * 7001 % 150_000 - 1000).alias("offset"), text.alias("query"))
    return q.select("doc_id", led.argument_verdict(F.col("limit"), F.col("offset"), F.col("query")).alias("verdict"))


@register("P07_optional_exclusion", "WITH p AS (SELECT *, [NULL, 'O', 'F', 'P'][o_custkey % 4 + 1] AS other FROM orders) SELECT o_orderkey, o_orderstatus FROM p WHERE other IS NULL OR o_orderstatus <> other")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose status is not the one that their customer excludes; some exclude none."""
    o = table(spark, sf, "orders")
    other = F.element_at(F.array(F.lit(None).cast("string"), F.lit("O"), F.lit("F"), F.lit("P")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return led.excluding(o.withColumn("other", other), "o_orderstatus", F.col("other")).select("o_orderkey", "o_orderstatus")


@register("V10_tampered_totals", "WITH s AS (SELECT o_custkey AS report, o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT report, sum(n)::BIGINT AS strata_total, count(*) AS strata FROM s GROUP BY 1) SELECT report, strata_total + (report % 7 = 0)::INTEGER AS total, strata_total, strata FROM t WHERE strata_total + (report % 7 = 0)::INTEGER <> strata_total OR strata > 4")
def v10_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Reports whose recorded total (every seventh is one too high) is not the sum of their strata, or that have more than four strata."""
    strata = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"))
    recorded = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.count("*").alias("total")).withColumn("total", F.col("total") + (F.col("report") % 7 == 0).cast("int"))
    return oc.unreconciled(recorded, strata, "report", most=4)


@register("A22_sample_sizes", "SELECT event_type, n, round(rate, 9) AS rate, CASE WHEN rate > 0 AND rate < 1 THEN ceil(1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE * rate * (1 - rate) / (0.0704::DOUBLE * 0.0704::DOUBLE))::BIGINT END AS needed FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value >= 20) / count(*)::DOUBLE AS rate FROM events GROUP BY 1)")
def a22_table(spark: SparkSession, sf: str) -> DataFrame:
    """Trials that each event type needs for its own rate of high values, to within 7.04 points."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("value") >= 20) / F.count("*")).alias("rate"))
    return e.select("event_type", "n", F.round("rate", 9).alias("rate"), oc.trials_needed(F.col("rate"), 0.0704).alias("needed"))


_KINDS = ("analysis_rejected", "verifier_unavailable", "verification_rejected", "model_provider", "other")
_STAGES = ("sec_retrieval", "filing_parse", "companyfacts_normalization", "deterministic_processing", "analyst", "verifier", "persistence", "other")
_CODES = ("numeric_conflict", "provenance_failure", "invalid_evidence_id", "unsupported_claim", "invalid_enum")


@register(
    "R26_terminal_reasons",
    rf"""WITH f AS (SELECT event_id, {list(_KINDS)}[event_id % 5 + 1] AS kind, {list(_STAGES)}[event_id // 5 % 8 + 1] AS stage, list_filter({list(_CODES)}, lambda x, i: (event_id * 13 + i * i) % 6 = 0) AS codes,
  CASE event_id % 3 WHEN 0 THEN 'ModelProviderError < TimeoutError' WHEN 1 THEN 'ModelProviderError: request Refused' ELSE 'ModelProviderError: 500' END AS chain FROM events)
SELECT event_id, CASE kind WHEN 'analysis_rejected' THEN CASE WHEN list_contains(codes, 'numeric_conflict') THEN 'NUMERIC_CONFLICT' WHEN list_contains(codes, 'provenance_failure') THEN 'PROVENANCE_FAILURE' WHEN list_has_any(codes, ['invalid_evidence_id', 'unsupported_claim']) THEN 'EVIDENCE_VALIDATION_REJECTED' ELSE 'ANALYST_CONTRACT_REJECTED' END
    WHEN 'verifier_unavailable' THEN 'VERIFIER_UNAVAILABLE' WHEN 'verification_rejected' THEN 'VERIFIER_FAILURE' WHEN 'model_provider' THEN CASE WHEN contains(chain, 'TimeoutError') THEN 'ANALYST_TIMEOUT' ELSE 'ANALYST_PROVIDER_FAILURE' END
    ELSE ['SOURCE_RETRIEVAL_FAILURE', 'FILING_PARSE_FAILURE', 'COMPANYFACTS_NORMALIZATION_FAILURE', 'DETERMINISTIC_PROCESSING_FAILURE', 'OTHER_BOUNDED_FAILURE', 'VERIFIER_FAILURE', 'PERSISTENCE_FAILURE', 'OTHER_BOUNDED_FAILURE'][list_position({list(_STAGES)}, stage)] END AS reason,
  CASE WHEN contains(lower(chain), 'timeout') THEN 'timeout' WHEN contains(lower(chain), 'refus') THEN 'refusal' ELSE 'provider_error' END AS runtime, CASE WHEN kind IN ('verifier_unavailable', 'verification_rejected') THEN 6 ELSE 3 END AS most_attempts FROM f""",
)
def r26_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Events as failures of five kinds: the terminal reason, the class of the error chain and how many attempts there may be."""
    k = F.col("event_id")
    of = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    chain = F.when(k % 3 == 0, "ModelProviderError < TimeoutError").when(k % 3 == 1, "ModelProviderError: request Refused").otherwise("ModelProviderError: 500")
    codes = F.array_compact(F.array(*[F.when((k * 13 + i * i) % 6 == 0, F.lit(c)) for i, c in enumerate(_CODES, 1)]))
    f = table(spark, sf, "events").select("event_id", of(_KINDS, k).alias("kind"), of(_STAGES, F.floor(k / 5)).alias("stage"), codes.alias("codes"), chain.alias("chain"))
    return f.select("event_id", rp.terminal_reason(*map(F.col, ("kind", "codes", "chain", "stage"))).alias("reason"), rp.runtime_class(F.col("chain")).alias("runtime"), rp.most_attempts(F.col("kind")).alias("most_attempts"))


@F.pandas_udf(StringType())
def json_failure(contents: pd.Series) -> pd.Series:
    """extra_prose if a JSON object stands in other text, malformed_json if none does; valid JSON is no failure (null)."""
    decode = json.JSONDecoder().raw_decode

    def one(text: str | None) -> str | None:
        text = text or ""
        try:
            json.loads(text)
            return None
        except ValueError:
            pass
        for at, c in enumerate(text):
            if c in "[{":
                try:
                    value, end = decode(text, at)
                except ValueError:
                    continue
                if isinstance(value, dict) and (text[:at].strip() or text[end:].strip()):
                    return "extra_prose"
        return "malformed_json"

    return contents.map(one)


_WRAPPED = ("{}", "{} and more", "so: {}", "{", "[1, {}] end", "")


@register("R26_json_failures", "SELECT conv_id, turn, [NULL, 'extra_prose', 'extra_prose', 'malformed_json', 'extra_prose', 'malformed_json'][(conv_id + turn) % 6 + 1] AS failure FROM conversations")
def r26_json(spark: SparkSession, sf: str) -> DataFrame:
    """A turn's text as a JSON answer, alone, in prose, broken off, inside of a list, or missing."""
    n = F.col("conv_id") + F.col("turn")
    answer = F.to_json(F.struct(F.col("text").alias("statement")))
    shapes = F.array(*[F.concat(F.lit(w.split("{}")[0]), answer, F.lit(w.split("{}")[1])) if "{}" in w else F.lit(w) for w in _WRAPPED])
    return table(spark, sf, "conversations").select("conv_id", "turn", json_failure(F.element_at(shapes, (n % 6 + 1).cast("int"))).alias("failure"))
