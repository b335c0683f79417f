"""Results of human leads: which filing a lead means, what its text calls for, what analysts made of it, and how it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.routing import violations
from tidemark.operators.scoring import first_true

ACCESSION_URL = r"/(\d{10}-\d{2}-\d{6})\.txt$"


def latest_by(filings: DataFrame, *keys: str, name: str) -> DataFrame:
    """One accession a key: the last filed; at equal times the greater accession."""
    return filings.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(F.struct("filed_at", "accession"))["accession"].alias(name))


def resolved(leads: DataFrame, filings: DataFrame, mapping: DataFrame) -> DataFrame:
    """leads with `resolved`, the accession that its identity means, or null.

    With a ticker: the last filing of CIK and ticker, else of the ticker, else (no CIK given) that of the CIK which the
    mapping gives the ticker, the least of several.  Without one: the last filing of the CIK.
    """
    by_cik = latest_by(filings, "cik", name="of_cik")
    mapped = mapping.dropna().groupBy("ticker").agg(F.min("cik").alias("cik")).join(by_cik, "cik").select("ticker", F.col("of_cik").alias("of_mapped"))
    out = leads.join(latest_by(filings, "cik", "ticker", name="of_both"), ["cik", "ticker"], "left").join(by_cik, "cik", "left")
    out = out.join(latest_by(filings, "ticker", name="of_ticker"), "ticker", "left").join(mapped, "ticker", "left")
    named = F.coalesce("of_both", "of_ticker", F.when(F.col("cik").isNull(), F.col("of_mapped")))
    return out.select(*leads.columns, F.when(F.col("ticker").isNull(), F.col("of_cik")).otherwise(named).alias("resolved"))


def lead_results(leads: DataFrame, filings: DataFrame, documents: DataFrame, facts: DataFrame, attempts: DataFrame, mapping: DataFrame, archive: str) -> DataFrame:
    """One row a lead: its filing, the status of each assessment, the disposition and what it rests on.

    leads: lead_id, cik, ticker, urls.  filings: accession, cik, ticker, url, filed_at.  documents: url, relevant,
    material (null where the text could not be read).  facts: cik, accession.  attempts: lead_id, attempt_id, at, brief,
    numeric_claims.  mapping: ticker, cik.  A lead's first url below `archive` comes before the filing that its identity
    means, but its accession must be readable and one of the two filings known.  Analysts are asked where the text is
    relevant and material; the last attempt decides (latest `at`, then attempt_id).
    """
    pointer = F.get(F.filter("urls", lambda u: F.startswith(u, F.lit(archive))), F.lit(0))
    known = filings.select("accession", F.col("cik").alias("filing_cik"), "url")
    out = resolved(leads, filings, mapping).withColumn("pointer", pointer)
    out = out.join(known.select(F.col("accession").alias("resolved"), F.col("url").alias("own_url"), F.col("filing_cik").alias("own_cik")), "resolved", "left")
    out = out.withColumn("source_url", F.coalesce("pointer", "own_url"))
    out = out.withColumn("named", F.nullif(F.regexp_extract("source_url", ACCESSION_URL, 1), F.lit("")))
    out = out.join(known.select(F.col("accession").alias("named"), F.lit(True).alias("is_known"), "filing_cik"), "named", "left")
    chosen = F.when(F.col("is_known"), F.col("named")).otherwise(F.when(F.col("named").isNotNull(), F.col("resolved")))
    out = out.withColumns({"accession": chosen, "filing_cik": F.when(F.col("is_known"), F.col("filing_cik")).otherwise(F.col("own_cik"))})
    out = out.join(documents.withColumnRenamed("url", "source_url"), "source_url", "left")
    read = F.col("accession").isNotNull() & F.col("relevant").isNotNull()
    source = first_true([("unresolved", F.col("accession").isNull()), ("resolved", read)], "retrieval_failed")
    out = out.withColumn("source_status", source)
    ok = F.col("source_status") == "resolved"
    ask = ok & F.col("relevant") & F.col("material")
    out = out.withColumns({"tier": F.when(ask, 2).when(ok, 0), "tier_outcome": F.when(ask, "escalate").when(ok & F.col("relevant"), "retain").when(ok, "skip")})
    tried = attempts.groupBy("lead_id").agg(F.count("*").alias("n"), F.countDistinct("attempt_id").alias("n_different"), F.max(F.struct("at", "attempt_id", "brief", "numeric_claims")).alias("last"))
    all_facts = facts.groupBy(F.col("cik").alias("filing_cik")).agg(F.count("*").alias("n_facts"))
    here = facts.groupBy(F.col("cik").alias("filing_cik"), "accession").agg(F.count("*").alias("n_same"))
    out = out.join(tried, "lead_id", "left").join(all_facts, "filing_cik", "left").join(here, ["filing_cik", "accession"], "left")
    asked, brief = F.col("tier_outcome").eqNullSafe("escalate"), F.coalesce(F.col("last.brief"), F.lit(False))
    zero = F.lit(0).cast("long")
    return out.select(
        "lead_id",
        "source_status",
        F.when(ok, F.col("accession")).alias("accession"),
        "tier",
        "tier_outcome",
        F.when(ok, "assessed").otherwise("not_assessed").alias("tier_status"),
        first_true([("not_assessed", ~asked), ("assessed", F.col("n") > 0)], "failed").alias("analyst_status"),
        F.when(asked, F.coalesce("n", zero)).otherwise(zero).alias("n_attempts"),
        F.when(asked, F.coalesce("n_different", zero)).otherwise(zero).alias("n_attempt_ids"),
        F.when(asked & brief & (F.col("last.numeric_claims") > 0), "assessed").otherwise("not_assessed").alias("verification_status"),
        first_true([("not_assessed", ~ok), ("assessed", F.col("n_facts") > 0)], "failed").alias("xbrl_status"),
        F.when(ok, F.coalesce("n_facts", zero)).alias("n_facts"),
        F.when(ok, F.coalesce("n_same", zero)).alias("n_same_filing"),
        first_true([("insufficient_evidence", ~ok), ("supported", asked & brief)], "inconclusive").alias("disposition"),
        first_true([("no_filing", F.col("source_status") == "unresolved"), ("unreadable", ~ok), ("classified", ~asked), ("brief", brief), ("not_validated", F.col("last").isNull())], "no_brief").alias("basis"),
    )


def lineage_violations(results: DataFrame) -> DataFrame:
    """lead_id, violation: results whose statuses do not go with what they hold."""
    return violations(
        results,
        "lead_id",
        {
            "tier_without_decision": (F.col("tier_status") == "assessed") == F.col("tier").isNotNull(),
            "analyst_without_attempt": (F.col("analyst_status") == "assessed") == (F.col("n_attempts") > 0),
            "attempt_repeated": F.col("n_attempts") == F.col("n_attempt_ids"),
            "resolved_without_evidence": (F.col("source_status") != "resolved") | F.col("accession").isNotNull(),
        },
    )
