"""Forensic rules on filed facts and disclosures: detectors, contradiction checks, novelty, comparison with prior filings.

A missing input is never read as safety: it gets a status of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scoring import first_true

# Phrases of each text detector, and how many prior filings a comparison looks at.
TEXT_SIGNALS = {"going_concern": ("going concern", "substantial doubt"), "reverse_split": ("reverse split", "reverse stock split")}
PRIOR_EVENTS = 64


def detectors(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, signal, status: four rows a row of inputs (shares, prior_shares, cash, current_liabilities, text)."""
    now, before = F.col("shares"), F.col("prior_shares")
    growth = first_true([("unknown", now.isNull() | before.isNull()), ("insufficient_evidence", before == 0), ("positive", now > before)], "negative")
    cash, owed = F.col("cash"), F.col("current_liabilities")
    pressure = first_true([("not_assessed", cash.isNull() | owed.isNull()), ("positive", cash < owed)], "negative")
    out = [F.struct(F.lit("share_count_growth").alias("signal"), growth.alias("status")), F.struct(F.lit("liquidity_pressure").alias("signal"), pressure.alias("status"))]
    text = F.lower(F.coalesce(F.trim("text"), F.lit("")))
    for name, phrases in TEXT_SIGNALS.items():
        hit = F.contains(text, F.lit(phrases[0])) | F.contains(text, F.lit(phrases[1]))
        out.append(F.struct(F.lit(name).alias("signal"), first_true([("not_assessed", text == ""), ("positive", hit)], "negative").alias("status")))
    return inputs.select(*keys, F.inline(F.array(*out)))


def contradictions(claims: DataFrame) -> DataFrame:
    """claims with observed, reason and disposition.

    claims holds predicate, asserted and one struct (value, as_of) or null for each fact: cash, current_liabilities,
    shares_prior, shares_current, issuable_shares, dilutive_instruments, registered_shares, insider_acquired,
    insider_disposed, planned_sale.  A fact that is null was not filed.
    """
    has = lambda *names: sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) == len(names)
    value = lambda n: F.col(n).getField("value")
    at = lambda n: F.col(n).getField("as_of")
    above = lambda n: F.coalesce(value(n) > 0, F.lit(False))
    liquid = first_true([("missing", ~has("cash", "current_liabilities")), ("periods", at("cash") != at("current_liabilities")), ("true", value("cash") >= value("current_liabilities"))], "false")
    pair = has("shares_prior", "shares_current")
    # flat share counts show nothing by themselves: no instrument and no registration must stand beside them
    closed = F.coalesce(value("dilutive_instruments") == 0, F.lit(False)) & ~above("registered_shares")
    diluted = first_true(
        [
            ("periods", pair & (at("shares_prior") >= at("shares_current"))),
            ("true", above("issuable_shares") | above("dilutive_instruments")),
            ("missing", ~pair),
            ("true", value("shares_current") > value("shares_prior")),
            ("false", closed),
        ],
        "missing",
    )
    neither = F.col("insider_acquired").isNull() & F.col("insider_disposed").isNull()
    insider = first_true(
        [
            ("planned", neither & F.col("planned_sale").isNotNull()),
            ("missing", ~has("insider_acquired", "insider_disposed")),
            ("periods", at("insider_acquired") != at("insider_disposed")),
            ("true", value("insider_acquired") > value("insider_disposed")),
        ],
        "false",
    )
    p = F.col("predicate")
    out = claims.withColumn("seen", F.when(p == "cash_at_least_current_liabilities", liquid).when(p == "dilution_exposure_present", diluted).otherwise(insider))
    seen = F.col("seen")
    observed = F.when(seen.isin("true", "false"), seen == "true")
    fits = observed == F.col("asserted")
    disposition = F.when(seen == "planned", "not_applicable").when(observed.isNull(), "insufficient").when(fits, "supported").otherwise("conflicted")
    reason = F.when(seen == "planned", "planned_sale_is_not_executed_transaction").when(seen == "missing", "required_facts_missing").when(seen == "periods", "fact_periods_incomparable").when(fits, "exact_facts_support_claim").otherwise("exact_facts_conflict_with_claim")
    return out.select("*", observed.alias("observed"), disposition.alias("disposition"), reason.alias("reason")).drop("seen")


def novelty(disclosures: DataFrame, prior_events: int = PRIOR_EVENTS) -> DataFrame:
    """event_id, disposition, reason, prior: what a disclosure adds to the issuer's last `prior_events` earlier ones.

    disclosures: event_id, issuer, category, published_at (may be null), retrieved_at, source_sha, fingerprint, entities,
    dates, facts (arrays), historical, search_complete.  In this order: historical context; the same document; a related
    event (equal fingerprint, or its entities are part of these) with new facts or as a recap; overlapping entities that
    settle nothing; and only after a complete search a new event.
    """
    order = F.struct(F.coalesce("published_at", "retrieved_at").alias("at"), "event_id")
    w = Window.partitionBy("issuer").orderBy("retrieved_at", "event_id").rowsBetween(-prior_events, -1)
    item = F.struct(order.alias("o"), "event_id", "category", "source_sha", "fingerprint", "entities", "dates", "facts")
    d = disclosures.withColumn("before", F.collect_list(item).over(w))
    same = lambda x: x["category"] == F.col("category")
    part = lambda x: (F.size(x["entities"]) > 0) & (F.size(F.array_except(x["entities"], "entities")) == 0) & (F.size(x["entities"]) < F.size("entities"))
    exact = F.filter("before", lambda x: (x["source_sha"] == F.col("source_sha")) & (x["fingerprint"] == F.col("fingerprint")))
    related = F.filter("before", lambda x: same(x) & ((x["fingerprint"] == F.col("fingerprint")) | part(x)))
    d = d.select("*", F.array_max(exact).alias("exact"), F.array_max(related).alias("related"), F.exists("before", lambda x: same(x) & F.arrays_overlap(x["entities"], "entities")).alias("overlaps"))
    gained = [F.size(F.array_except(c, F.col("related").getField(c))) > 0 for c in ("entities", "dates", "facts")]
    update = gained[0] | gained[1] | gained[2]
    rules = [
        ("historical_context", "explicit_historical_context", F.col("historical"), None),
        ("duplicate_disclosure", "same_source_document", F.col("exact").isNotNull(), "exact"),
        ("material_update", "supported_material_fact_changed", F.col("related").isNotNull() & update, "related"),
        ("recap_existing_event", "same_event_no_new_material_fact", F.col("related").isNotNull(), "related"),
        ("unknown_novelty", "ambiguous_event_relationship", F.col("overlaps"), None),
        ("new_event", "complete_search_no_related_event", F.col("search_complete"), None),
    ]
    prior = F.when(rules[0][2], F.lit(None).cast("long"))
    for _, _, when, of in rules[1:]:
        prior = prior.when(when, F.col(of).getField("event_id") if of else F.lit(None).cast("long"))
    return d.select("event_id", first_true([(r[0], r[2]) for r in rules], "unknown_novelty").alias("disposition"), first_true([(r[1], r[2]) for r in rules], "prior_search_incomplete").alias("reason"), prior.alias("prior"))


def compared_with_prior(events: DataFrame, prior_events: int = PRIOR_EVENTS, carried: Sequence[str] = ()) -> DataFrame:
    """accession, event_type, carried, comparison, prior: an accounting event against the issuer's last earlier ones of its type.

    events: accession, issuer, event_type, accepted_at, retrieved_at, fingerprint, search_complete.  Only filings
    accepted before and retrieved by then count; an equal fingerprint is preferred, then the latest accepted.
    """
    w = Window.partitionBy("issuer", "event_type").orderBy("accepted_at", "accession").rowsBetween(-prior_events, -1)
    e = events.withColumn("before", F.collect_list(F.struct("accepted_at", "accession", "retrieved_at", "fingerprint")).over(w))
    known = F.filter("before", lambda x: (x["accepted_at"] < F.col("accepted_at")) & (x["retrieved_at"] <= F.col("retrieved_at")))
    e = e.select("*", F.array_max(F.filter(known, lambda x: x["fingerprint"] == F.col("fingerprint"))).alias("exact"), F.array_max(known).alias("last"))
    comparison = first_true([("repeated_disclosure", F.col("exact").isNotNull()), ("changed_disclosure", F.col("last").isNotNull()), ("new_disclosure", F.col("search_complete"))], "prior_comparison_unavailable")
    return e.select("accession", "event_type", *carried, comparison.alias("comparison"), F.coalesce(F.col("exact.accession"), F.col("last.accession")).alias("prior"))


# Instruments that may bring shares, tags of cash and of current liabilities, forms of either owners' source.
DILUTIVE = ("convertible_debt", "preferred_equity", "warrant", "warrant_repricing", "warrant_exercise_inducement", "equity_line")
CASH_TAGS, LIABILITIES_TAG = ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"), "LiabilitiesCurrent"
PLANNED_FORMS, SCHEDULES = ("144", "144/A"), ("SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A")
FACTS = ("cash", "current_liabilities", "shares_prior", "shares_current", "issuable_shares", "dilutive_instruments", "registered_shares", "insider_acquired", "insider_disposed", "planned_sale")


def _claimed(rows: DataFrame, keys: list[str], predicate: str, asserted: F.Column, as_of: F.Column, when: F.Column, **facts: F.Column) -> DataFrame:
    """keys and disposition of a claim of each row on these facts; null where `when` does not hold."""
    none = F.lit(None).cast("struct<value:decimal(24,4),as_of:date>")
    fact = lambda v: F.when(v.isNotNull(), F.struct(v.cast("decimal(24,4)").alias("value"), as_of.cast("date").alias("as_of")))
    claims = rows.select(*keys, when.alias("told"), F.lit(predicate).alias("predicate"), asserted.alias("asserted"), *[(fact(facts[n]) if n in facts else none).alias(n) for n in FACTS])
    return contradictions(claims).select(*keys, F.when(F.col("told"), F.col("disposition")).alias("disposition"))


def dilution_facts(terms: DataFrame, key: str) -> DataFrame:
    """key, value, named, issuable, registered of filings with terms.

    value: instruments in force that may bring a stated number of shares; what only registers a resale is none.  named:
    dilutive instruments of any status, with or without shares; then the shares that those state, and registered ones.
    """
    mine = F.col("instrument").isin(*DILUTIVE)
    counts = mine & ~F.col("status").isin("terminated", "unknown") & (F.col("shares") > 0)
    shares = lambda when: F.sum(F.when(when, F.col("shares"))).cast("long")
    return terms.groupBy(key).agg(F.count_if(counts).alias("value"), F.count_if(mine).alias("named"), shares(mine).alias("issuable"), shares(F.col("instrument") == "resale_registration").alias("registered"))


def financing_claims(terms: DataFrame, key: str) -> DataFrame:
    """key, decision, disposition, persisted: filings whose financing terms claim dilution; without such facts nothing is claimed."""
    facts = dilution_facts(terms, key)
    some = F.col("value") > 0
    told = _claimed(facts.select(key, "value"), [key, "value"], "dilution_exposure_present", F.lit(True), F.lit(None), some, dilutive_instruments=F.when(some, F.col("value")))
    return told.select(key, F.when(some, "eligible_complete_facts").otherwise("no_relevant_validated_facts").alias("decision"), "disposition", F.coalesce(F.col("disposition").isin("supported", "conflicted"), F.lit(False)).alias("persisted"))


def ownership_claims(filings: DataFrame, deals: DataFrame, key: str) -> DataFrame:
    """key, source, decision, as_of, derivative, disposition: claims of net acquisition by insiders.

    filings: key, form, event_date, planned; deals: key, day, derivative, acquired, shares.  Each day and class of
    securities of a filing is a claim of its own, on its own totals; a planned sale makes a claim that nothing executed
    can settle; schedules of large owners make none.
    """
    planned, schedule = F.col("form").isin(*PLANNED_FORMS), F.col("form").isin(*SCHEDULES)
    side = lambda when: F.coalesce(F.sum(F.when(when, F.col("shares"))), F.lit(0))
    scopes = deals.groupBy(key, "day", "derivative").agg(side(F.col("acquired")).alias("bought"), side(~F.col("acquired")).alias("sold"))
    executed = filings.where(~planned & ~schedule).join(scopes, key, "left").select(key, "form", F.col("day").alias("as_of"), "derivative", "bought", "sold", F.lit(None).cast("decimal(24,4)").alias("planned"))
    others = filings.where(planned | schedule).select(key, "form", F.when(planned, F.col("event_date")).alias("as_of"), F.lit(None).cast("boolean").alias("derivative"), F.lit(None).alias("bought"), F.lit(None).alias("sold"), F.when(planned, F.col("planned")).cast("decimal(24,4)").alias("planned"))
    rows = executed.unionByName(others)
    decision = F.when(schedule, "unsupported_source_context").when(planned, "eligible_not_applicable_context").when(F.col("as_of").isNull(), "no_relevant_validated_facts").otherwise("eligible_complete_facts")
    rows = rows.withColumns({"decision": decision, "source": F.when(planned, "ownership_form_144").otherwise("ownership_section_16")})
    keys = [key, "source", "decision", "as_of", "derivative"]
    return _claimed(rows, keys, "net_insider_acquisition", F.col("planned").isNull(), F.col("as_of"), F.startswith("decision", F.lit("eligible")), insider_acquired=F.col("bought"), insider_disposed=F.col("sold"), planned_sale=F.col("planned"))


def liquidity_claims(facts: DataFrame, key: str, cutoff: str) -> DataFrame:
    """key, decision, as_of, disposition: claims that cash covers current liabilities, from one filing's tagged facts.

    facts: key, tag, value, unit, period_start, period_end, available_at, retrieved_at.  Only instants in USD known by
    the cutoff count.  Facts are lined up by period; a period with one of each makes a pair, and only the pair of the
    latest period is claimed.  More than one of either, or a later period without a pair, leaves it ambiguous.
    """
    day = F.lit(cutoff).cast("date")
    cash, owed = F.col("tag").isin(*CASH_TAGS), F.col("tag") == LIABILITIES_TAG
    known = (F.col("unit") == "USD") & F.col("period_start").isNull() & (F.col("available_at") <= day) & (F.col("retrieved_at") <= day)
    p = facts.where(known & (cash | owed)).groupBy(key, "period_end").agg(F.count_if(cash).alias("nc"), F.count_if(owed).alias("no"), F.max(F.when(cash, F.col("value"))).alias("cash"), F.max(F.when(owed, F.col("value"))).alias("owed"))
    pair, both = (F.col("nc") == 1) & (F.col("no") == 1), (F.col("nc") > 0) & (F.col("no") > 0)
    last = F.max(F.struct("period_end", pair.alias("pair"), "cash", "owed")).alias("last")
    b = p.groupBy(key).agg(F.bool_or(both).alias("some"), last)
    rows = facts.select(key).distinct().join(b, key, "left").select(key, "some", F.col("last.period_end").alias("period_end"), F.coalesce("last.pair", F.lit(False)).alias("ready"), "last.cash", "last.owed")
    decision = F.when(F.col("ready"), "eligible_complete_facts").when(F.col("some"), "ambiguous_xbrl_context").otherwise("no_relevant_validated_facts")
    rows = rows.withColumns({"decision": decision, "as_of": F.when(F.col("ready"), F.col("period_end"))})
    return _claimed(rows, [key, "decision", "as_of"], "cash_at_least_current_liabilities", F.lit(True), F.col("period_end"), F.col("ready"), cash=F.col("cash"), current_liabilities=F.col("owed"))
