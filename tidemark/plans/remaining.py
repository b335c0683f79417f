"""Registered queries that complete the inventory: session arithmetic, terminal writes, report checks and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions import text as tx
from tidemark.operators import facts as fa
from tidemark.operators import ledger as led
from tidemark.operators import scoring as sc
from tidemark.plans.research import _WIDE, CUT
from tidemark.streaming import stateful
from tidemark.tables import BARS, bars, facts, table


_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) > 0))"


@register("C03_session_arithmetic", f"WITH {BARS}, c AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i FROM (SELECT DISTINCT session_date FROM bars)) SELECT a.session_date, h AS horizon, b.session_date AS target_date FROM c a CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) LEFT JOIN c b ON b.i = a.i + h")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    return led.sessions_after(bars(spark, sf).select("session_date"), "session_date", (1, 5, 20))


@register("K10_rolling_caps")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    """Two caps at once: a call a user and hour and three a day; refused calls count for neither."""
    return stateful.capped_batch(table(spark, sf, "events"), ((3_600.0, 1), (86_400.0, 3)))


@register("K12_terminal_writes", "SELECT l_orderkey, CASE WHEN ok > 0 THEN 'completed' WHEN n >= 6 THEN 'failed' ELSE 'retry_wait' END AS status, first_ok, CASE WHEN ok = 0 AND n < 6 THEN least(86400, 300 * pow(2, n - 1))::BIGINT END AS delay FROM (SELECT l_orderkey, max(l_linenumber) AS n, count(*) FILTER (l_linestatus = 'F') AS ok, min(l_linenumber) FILTER (l_linestatus = 'F') AS first_ok FROM lineitem GROUP BY 1)")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.terminal_status(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_linestatus") == "F", 6)


@register("R28_section_validation", f"SELECT a.conv_id, a.turn, ['bull', 'bear', 'auditor'][a.turn % 3 + 1] AS checked_by, len(list_intersect({_WORDS.format('a.text')}, {_WORDS.format('b.text')})) >= greatest(2, ceil(len({_WORDS.format('a.text')}) / 4.0)) AS supported FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def r28(spark: SparkSession, sf: str) -> DataFrame:
    """A section is supported if its evidence holds a quarter of its words, two at least; each section has a role that checks it."""
    a = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("evidence"))
    role = F.element_at(F.array(F.lit("bull"), F.lit("bear"), F.lit("auditor")), (F.col("turn") % 3 + 1).cast("int"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", role.alias("checked_by"), tx.supported(F.col("text"), F.col("evidence")).alias("supported"))


@register("R29_lead_results", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'no_filing' WHEN failed THEN 'failed' WHEN published THEN 'published' ELSE 'screened' END AS disposition, latest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'P') AS failed, bool_and(o_orderstatus = 'F') AS published, max(o_orderkey) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def r29(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    found = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(s == "P").alias("failed"), F.bool_and(s == "F").alias("published"), F.max("o_orderkey").alias("latest"))
    out = table(spark, sf, "customer").select("c_custkey").join(found, "c_custkey", "left")
    return out.select("c_custkey", sc.first_true([("no_filing", F.col("failed").isNull()), ("failed", F.col("failed")), ("published", F.col("published"))], "screened").alias("disposition"), "latest")


_DISPOSITION = "CASE WHEN income IS NULL OR revenue IS NULL THEN 'not_assessed' WHEN income > revenue THEN 'contradicted' WHEN income * 10 > revenue * 9 THEN 'tension' ELSE 'consistent' END"


@register("V11_receipt_recomputed", f"WITH {_WIDE} SELECT issuer, period_end, 'consistent' AS recorded, {_DISPOSITION} AS recomputed FROM wide WHERE issuer % 10 = 3 AND {_DISPOSITION} <> 'consistent'")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts, a tenth of them with a wrong disposition, against the rule run again."""
    i, r = F.col("income"), F.col("revenue")
    rule = sc.first_true([("not_assessed", i.isNull() | r.isNull()), ("contradicted", i > r), ("tension", i * 10 > r * 9)], "consistent")
    again = fa.pivoted(facts(spark, sf), CUT).select("issuer", "period_end", rule.alias("disposition"))
    receipts = again.withColumn("disposition", F.when(F.col("issuer") % 10 == 3, "consistent").otherwise(F.col("disposition")))
    return led.mismatches(receipts, again, ["issuer", "period_end"], "disposition")


@register("X18_normalized_lists", "SELECT conv_id, string_agg(DISTINCT lower(trim(role)), ',' ORDER BY lower(trim(role))) AS roles FROM conversations GROUP BY 1")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return by.select("conv_id", F.array_join(tx.normalized_list(F.col("roles")), ",").alias("roles"))


_LOW = "lower(text)"


@register("X24_form_aware_excerpt", f"SELECT doc_id, sha256(substr(text, CASE WHEN contains({_LOW}, 'license') THEN instr({_LOW}, 'license') WHEN contains({_LOW}, 'copyright') THEN instr({_LOW}, 'copyright') ELSE 1 END, 200)) AS digest, contains({_LOW}, 'license') OR contains({_LOW}, 'copyright') AS form_aware FROM documents")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    """The excerpt starts at the first required term that occurs, and else with the text."""
    cut, aware = tx.excerpt(F.col("text"), ("license", "copyright"), 200)
    return table(spark, sf, "documents").select("doc_id", F.sha2(cut, 256).alias("digest"), aware.alias("form_aware"))
