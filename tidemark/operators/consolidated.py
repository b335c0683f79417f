"""Consolidated reports: nested sections checked by the role that each belongs to, and what can be put right by rule alone.

A report has, beside its key, prompt_version and assessment, one array a section of findings (statement, kind, category,
polarity, citations of evidence_id and quote) and contradictions (topic, status, citations).  Records are a report's own
evidence: key, evidence_id, text, available_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import reports as rp

# Section to role, categories of each role, versions and statuses.
ROLES = {"material_facts": "document_interpreter", "catalysts": "catalyst_analyst", "positive_factors": "bull_bear_risk_analyst", "negative_factors": "bull_bear_risk_analyst", "risks": "bull_bear_risk_analyst"}
CATEGORIES = {"document_interpreter": ("document_fact",), "catalyst_analyst": ("catalyst",), "bull_bear_risk_analyst": ("bull_case", "bear_case", "risk")}
PROMPT, RESOLVED, CONFLICTING = "consolidated-v1", "resolved_by_later_correction", "conflicting_evidence"
CORRECTION = r"(?i)\b(?:correct|corrected|correction|revised|supersed)[A-Za-z0-9_]*\b"


def exploded(reports: DataFrame, key: str) -> DataFrame:
    """key, section, role, pos and the fields of each finding of every section."""
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(r).alias("role"), F.col(s).alias("findings")) for s, r in ROLES.items()])
    rows = reports.select(key, F.explode(sections).alias("s")).select(key, "s.section", "s.role", F.posexplode("s.findings").alias("pos", "f"))
    return rows.select(key, "section", "role", "pos", "f.*")


def _own(df: DataFrame, key: str) -> DataFrame:
    """Evidence named with its report, so that a citation finds only the report's own."""
    return df.withColumn("evidence_id", F.concat_ws("/", F.col(key).cast("string"), F.col("evidence_id").cast("string")))


def _cited(df: DataFrame, key: str) -> F.Column:
    return F.transform("citations", lambda c: F.struct(F.concat_ws("/", F.col(key).cast("string"), c["evidence_id"].cast("string")).alias("evidence_id"), c["quote"].alias("quote")))


def later_corrections(reports: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, pos, corrected: whether the latest of a contradiction's verbatim quotes, from two dates at least, speaks of a correction."""
    c = reports.select(key, F.posexplode("contradictions").alias("pos", "c")).select(key, "pos", F.explode_outer("c.citations").alias("q"))
    met = c.select(key, "pos", "q.evidence_id", "q.quote").join(records.select(key, "evidence_id", "text", "available_at"), [key, "evidence_id"], "left")
    holds = F.contains("text", F.col("quote"))
    by = met.groupBy(key, "pos").agg(F.count_distinct(F.when(holds, F.col("available_at"))).alias("dates"), F.max(F.when(holds, F.col("available_at"))).alias("last"), F.collect_list(F.when(holds, F.struct("available_at", "quote"))).alias("quotes"))
    said = F.exists("quotes", lambda q: (q["available_at"] == F.col("last")) & q["quote"].rlike(CORRECTION))
    return by.select(key, "pos", ((F.col("dates") >= 2) & said).alias("corrected"))


def validated(reports: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, errors: the codes of all that is wrong with a report's sections, each checked under its own role; sorted, no code twice."""
    found, own = exploded(reports, key), _own(records, key)
    keys = [key, "section", "pos"]
    quoted = rp.finding_errors(found.select(*keys, "statement", "kind", _cited(found, key).alias("citations")), own, keys)
    allowed = F.lit(False)
    for role, categories in CATEGORIES.items():
        allowed = allowed | ((F.col("role") == role) & F.col("category").isin(*categories))
    fact, neutral = F.col("kind") == "reported_fact", F.col("polarity") == "neutral"
    rules = {
        "category_not_allowed_for_role": ~allowed,
        "reported_fact_must_be_neutral": fact & ~neutral,
        "document_interpreter_must_report_neutral_facts": (F.col("role") == "document_interpreter") & ~(fact & neutral),
    }
    by_role = found.select(key, F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])).alias("errors"))
    c = reports.select(key, "contradictions").select(key, F.posexplode("contradictions").alias("pos", "c")).select(key, "pos", "c.*")
    topics = rp.finding_errors(c.select(key, "pos", F.col("topic").alias("statement"), F.lit("contradiction").alias("kind"), _cited(c, key).alias("citations")), own, [key, "pos"])
    settled = c.select(key, "pos", (F.col("status") == RESOLVED).alias("resolved")).join(later_corrections(reports, records, key), [key, "pos"])
    rule = F.when(F.col("resolved") & ~F.col("corrected"), "correction_not_explicit_or_later").when(~F.col("resolved") & F.col("corrected"), "explicit_correction_not_resolved")
    settled = settled.select(key, F.array_compact(F.array(rule)).alias("errors"))
    version = reports.select(key, F.array_compact(F.array(F.when(~F.col("prompt_version").eqNullSafe(F.lit(PROMPT)), "prompt_version_mismatch"))).alias("errors"))
    every = version
    for part in (quoted, by_role, topics, settled):
        every = every.unionByName(part.select(key, "errors"))
    return every.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))


def normalized(reports: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """reports with what the rules alone can put right, and changes: the sorted names of the rules that applied.

    Reported facts become neutral; a report with contradictions is of conflicting evidence; a contradiction whose latest
    quote states a correction is resolved.  Nothing else is touched, nor any order.
    """
    wrong = lambda f: (f["kind"] == "reported_fact") & ~f["polarity"].eqNullSafe(F.lit("neutral"))
    polar = F.lit(False)
    for s in ROLES:
        polar = polar | F.coalesce(F.exists(s, wrong), F.lit(False))
    conflict = F.coalesce(F.size("contradictions") > 0, F.lit(False)) & ~F.col("assessment").eqNullSafe(F.lit(CONFLICTING))
    corrected = later_corrections(reports, records, key).where("corrected").groupBy(key).agg(F.collect_list("pos").alias("settled"))
    r = reports.join(corrected, key, "left").withColumn("settled", F.coalesce("settled", F.array().cast("array<int>")))
    late = lambda c, i: F.array_contains("settled", i) & ~c["status"].eqNullSafe(F.lit(RESOLVED))
    changed = F.exists(F.transform("contradictions", late), lambda x: x)
    names = {"contradiction_assessment": conflict, "explicit_later_correction_status": F.coalesce(changed, F.lit(False)), "reported_fact_neutral_polarity": polar}
    r = r.withColumn("changes", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in names.items()])))
    mended = {s: F.transform(s, lambda f: f.withField("polarity", F.when(wrong(f), "neutral").otherwise(f["polarity"]))) for s in ROLES}
    mended["contradictions"] = F.transform("contradictions", lambda c, i: c.withField("status", F.when(late(c, i), RESOLVED).otherwise(c["status"])))
    mended["assessment"] = F.when(conflict, CONFLICTING).otherwise(F.col("assessment"))
    return r.withColumns(mended).drop("settled")
