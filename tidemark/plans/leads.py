"""Registered queries on human leads: customers ask, documents are filings, events are analysts' attempts, orders are facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import leads as ld
from tidemark.tables import table

ARCHIVE = "https://archive.example/data/"

_ACCESSION = "lpad({0}::VARCHAR, 10, '0') || '-24-' || lpad(({0} % 1000000)::VARCHAR, 6, '0')"
_RESULTS = rf"""lead AS (SELECT c_custkey AS lead_id, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 130 END AS cik, CASE WHEN c_custkey % 4 > 0 THEN 'src' || (c_custkey * 7 % 23) END AS ticker,
  CASE c_custkey % 5 WHEN 0 THEN '{ARCHIVE}' || {_ACCESSION.format("(c_custkey * 3 % 2000)")} || '.txt' WHEN 1 THEN '{ARCHIVE}' || 'index.html' END AS pointer FROM customer),
filing AS (SELECT {_ACCESSION.format("doc_id")} AS accession, doc_id % 97 AS cik, source AS ticker, doc_id * 7919 % 10007 AS filed_at, CASE WHEN doc_id % 11 <> 3 THEN lower(text) END AS t FROM documents),
mapped AS (SELECT 'src' || (s_suppkey % 25) AS ticker, min(s_suppkey % 97) AS cik FROM supplier GROUP BY 1),
of_cik AS (SELECT cik, arg_max(accession, (filed_at, accession)) AS a FROM filing GROUP BY 1),
of_ticker AS (SELECT ticker, arg_max(accession, (filed_at, accession)) AS a FROM filing GROUP BY 1),
of_both AS (SELECT cik, ticker, arg_max(accession, (filed_at, accession)) AS a FROM filing GROUP BY 1, 2),
found AS (SELECT lead.*, CASE WHEN lead.ticker IS NULL THEN c.a ELSE coalesce(b.a, t.a, CASE WHEN lead.cik IS NULL THEN m.a END) END AS resolved
  FROM lead LEFT JOIN of_both b ON b.cik = lead.cik AND b.ticker = lead.ticker LEFT JOIN of_cik c ON c.cik = lead.cik LEFT JOIN of_ticker t ON t.ticker = lead.ticker
  LEFT JOIN (SELECT mapped.ticker, of_cik.a FROM mapped JOIN of_cik USING (cik)) m ON m.ticker = lead.ticker),
named AS (SELECT *, CASE WHEN pointer IS NULL THEN resolved ELSE nullif(regexp_extract(pointer, '/(\d{{10}}-\d{{2}}-\d{{6}})\.txt$', 1), '') END AS named FROM found),
chosen AS (SELECT n.*, CASE WHEN k.accession IS NOT NULL THEN named WHEN named IS NOT NULL THEN resolved END AS accession FROM named n LEFT JOIN filing k ON k.accession = n.named),
read AS (SELECT c.*, f.cik AS filing_cik, d.t IS NOT NULL AND c.accession IS NOT NULL AS ok, contains(d.t, 'license') OR contains(d.t, 'phone') OR contains(d.t, 'qu') AS material, contains(d.t, 'the') OR contains(d.t, 'la') AS other
  FROM chosen c LEFT JOIN filing f ON f.accession = c.accession LEFT JOIN filing d ON d.accession = c.named),
tried AS (SELECT user_id AS lead_id, count(*) AS n, count(DISTINCT event_id % 4000) AS n_different, arg_max(event_type IN ('purchase', 'view'), (ts, event_id % 4000)) AS brief, arg_max(CASE event_type WHEN 'purchase' THEN event_id % 3 ELSE 0 END, (ts, event_id % 4000)) AS claims FROM events GROUP BY 1),
fact AS (SELECT o_custkey % 90 AS cik, {_ACCESSION.format("(o_custkey % 90 + 97 * (o_orderkey % 10))")} AS accession FROM orders),
result AS (SELECT r.lead_id, CASE WHEN r.accession IS NULL THEN 'unresolved' WHEN ok THEN 'resolved' ELSE 'retrieval_failed' END AS source_status, CASE WHEN ok THEN r.accession END AS accession,
  CASE WHEN ok AND material THEN 2 WHEN ok THEN 0 END AS tier, CASE WHEN ok AND material THEN 'escalate' WHEN ok AND other THEN 'retain' WHEN ok THEN 'skip' END AS tier_outcome,
  CASE WHEN ok THEN 'assessed' ELSE 'not_assessed' END AS tier_status, CASE WHEN ok AND material THEN CASE WHEN n > 0 THEN 'assessed' ELSE 'failed' END ELSE 'not_assessed' END AS analyst_status,
  CASE WHEN ok AND material THEN coalesce(n, 0) ELSE 0 END AS n_attempts, CASE WHEN ok AND material THEN coalesce(n_different, 0) ELSE 0 END AS n_attempt_ids,
  CASE WHEN ok AND material AND brief AND claims > 0 THEN 'assessed' ELSE 'not_assessed' END AS verification_status,
  CASE WHEN NOT ok THEN 'not_assessed' WHEN nf > 0 THEN 'assessed' ELSE 'failed' END AS xbrl_status, CASE WHEN ok THEN coalesce(nf, 0) END AS n_facts, CASE WHEN ok THEN coalesce(ns, 0) END AS n_same_filing,
  CASE WHEN NOT ok THEN 'insufficient_evidence' WHEN material AND brief THEN 'supported' ELSE 'inconclusive' END AS disposition,
  CASE WHEN r.accession IS NULL THEN 'no_filing' WHEN NOT ok THEN 'unreadable' WHEN NOT material THEN 'classified' WHEN brief THEN 'brief' WHEN n IS NULL THEN 'not_validated' ELSE 'no_brief' END AS basis
  FROM read r LEFT JOIN tried USING (lead_id) LEFT JOIN (SELECT cik AS filing_cik, count(*) AS nf FROM fact GROUP BY 1) USING (filing_cik)
  LEFT JOIN (SELECT cik, accession, count(*) AS ns FROM fact GROUP BY 1, 2) h ON h.cik = r.filing_cik AND h.accession = r.accession)"""


def _accession(k: F.Column) -> F.Column:
    return F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-24-"), F.lpad((k % 1000000).cast("string"), 6, "0"))


def _url(k: F.Column) -> F.Column:
    return F.concat(F.lit(ARCHIVE), _accession(k), F.lit(".txt"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("c_custkey"), F.col("doc_id")
    urls = F.when(k % 5 == 0, F.array(F.lit("https://elsewhere.example/a"), _url(k * 3 % 2000))).when(k % 5 == 1, F.array(F.lit(ARCHIVE + "index.html"))).otherwise(F.array().cast("array<string>"))
    leads = table(spark, sf, "customer").select(k.alias("lead_id"), F.when(k % 3 < 2, k % 130).alias("cik"), F.when(k % 4 > 0, F.concat(F.lit("src"), (k * 7 % 23).cast("string"))).alias("ticker"), urls.alias("urls"))
    docs = table(spark, sf, "documents")
    filings = docs.select(_accession(d).alias("accession"), (d % 97).alias("cik"), F.col("source").alias("ticker"), _url(d).alias("url"), (d * 7919 % 10007).alias("filed_at"))
    low = F.when(d % 11 != 3, F.lower("text"))
    material = F.contains(low, F.lit("license")) | F.contains(low, F.lit("phone")) | F.contains(low, F.lit("qu"))
    read = docs.select(_url(d).alias("url"), (material | F.contains(low, F.lit("the")) | F.contains(low, F.lit("la"))).alias("relevant"), material.alias("material"))
    o = F.col("o_custkey") % 90
    facts = table(spark, sf, "orders").select(o.alias("cik"), _accession(o + 97 * (F.col("o_orderkey") % 10)).alias("accession"))
    kind = F.col("event_type")
    attempts = table(spark, sf, "events").select(F.col("user_id").alias("lead_id"), (F.col("event_id") % 4000).alias("attempt_id"), F.col("ts").alias("at"), kind.isin("purchase", "view").alias("brief"), F.when(kind == "purchase", F.col("event_id") % 3).otherwise(0).alias("numeric_claims"))
    mapping = table(spark, sf, "supplier").select(F.concat(F.lit("src"), (F.col("s_suppkey") % 25).cast("string")).alias("ticker"), (F.col("s_suppkey") % 97).alias("cik"))
    return ld.lead_results(leads, filings, read, facts, attempts, mapping, ARCHIVE)


@register("R29_human_lead_results", f"WITH {_RESULTS} SELECT * FROM result")
def r29_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each lead's filing, tier, attempts, checks and disposition."""
    return _results(spark, sf)


@register(
    "R29_result_lineage",
    f"""WITH {_RESULTS}, bad AS (SELECT * REPLACE (CASE WHEN lead_id % 10 = 3 THEN NULL ELSE tier END AS tier, CASE WHEN lead_id % 10 = 4 THEN 'assessed' ELSE analyst_status END AS analyst_status, CASE WHEN lead_id % 10 = 5 THEN NULL ELSE accession END AS accession) FROM result)
SELECT lead_id, unnest(list_filter([CASE WHEN (tier_status = 'assessed') <> (tier IS NOT NULL) THEN 'tier_without_decision' END, CASE WHEN (analyst_status = 'assessed') <> (n_attempts > 0) THEN 'analyst_without_attempt' END,
  CASE WHEN n_attempts <> n_attempt_ids THEN 'attempt_repeated' END, CASE WHEN source_status = 'resolved' AND accession IS NULL THEN 'resolved_without_evidence' END], lambda v: v IS NOT NULL)) AS violation FROM bad""",
)
def r29_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Results with a decision, an attempt or the evidence missing in a tenth each, and what each breaks."""
    k = F.col("lead_id") % 10
    bad = {"tier": F.when(k != 3, F.col("tier")), "analyst_status": F.when(k == 4, "assessed").otherwise(F.col("analyst_status")), "accession": F.when(k != 5, F.col("accession"))}
    return ld.lineage_violations(_results(spark, sf).withColumns(bad))
