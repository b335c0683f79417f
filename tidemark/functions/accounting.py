"""Accounting disclosures: regions of a filing, literal signals that count only in their region, and the events they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import collapse, settled

# Signals with the event that each belongs to and what states it.
SIGNALS = {
    "LISTING_NONCOMPLIANCE_LANGUAGE": ("LISTING_COMPLIANCE", r"\b(?:not in compliance|does not comply|non-compliance|deficienc(?:y|ies))\b"),
    "DELISTING_LANGUAGE": ("LISTING_COMPLIANCE", r"\bdelist(?:ing|ed)?\b"),
    "REGAINED_COMPLIANCE_LANGUAGE": ("LISTING_COMPLIANCE", r"\b(?:regained compliance|has determined that .{0,240}? complies)\b"),
    "TRANSFER_OF_LISTING_LANGUAGE": ("LISTING_COMPLIANCE", r"\btransfer(?:red|ring)? (?:of |its )?listing\b"),
    "AUDITOR_DISMISSAL_LANGUAGE": ("AUDITOR_CHANGE", r"\b(?:dismissed|terminated)\b.{0,160}\b(?:accountant|auditor|accounting firm)\b"),
    "AUDITOR_RESIGNATION_LANGUAGE": ("AUDITOR_CHANGE", r"\b(?:accountant|auditor|accounting firm)\b.{0,160}\bresigned\b|\bresigned\b.{0,160}\b(?:accountant|auditor|accounting firm)\b"),
    "AUDITOR_ENGAGEMENT_LANGUAGE": ("AUDITOR_CHANGE", r"\b(?:engaged|appointed)\b.{0,180}\b(?:accountant|auditor|accounting firm)\b"),
    "AUDITOR_DISAGREEMENT_LANGUAGE": ("AUDITOR_CHANGE", r"\bdisagreements?\b.{0,220}\b(?:accounting|auditing|financial statement|disclosure)\b"),
    "REPORTABLE_EVENT_LANGUAGE": ("AUDITOR_CHANGE", r"\breportable events?\b"),
    "RESTATEMENT_LANGUAGE": ("NON_RELIANCE_RESTATEMENT", r"\brestat(?:e|ed|ement|ements|ing)\b"),
    "GOING_CONCERN_LANGUAGE": ("GOING_CONCERN", r"\bsubstantial doubt\b.{0,220}\b(?:continue|going concern)\b|\bability to continue as a going concern\b|\bgoing concern uncertainty\b"),
    "MATERIAL_WEAKNESS_LANGUAGE": ("INTERNAL_CONTROLS", r"\bmaterial weakness(?:es)?\b"),
    "CONTROL_INEFFECTIVENESS_LANGUAGE": ("INTERNAL_CONTROLS", r"\b(?:disclosure controls(?: and procedures)?|internal control(?: over financial reporting)?)\b.{0,220}\b(?:not effective|ineffective|were not effective|was not effective)\b"),
    # "no changes" is told apart without looking ahead: what follows does not begin with the word no
    "CONTROL_CHANGE_LANGUAGE": (
        "INTERNAL_CONTROLS",
        r"\b(?:(?:we|management|the company) (?:made|implemented|completed|identified).{0,80}\bchanges? (?:to|in)|changes? (?:were|was) made (?:to|in)"
        r"|there (?:(?:has|have) been|was|were) (?:|[^n].{0,39}|n[^o].{0,38}|no\w.{0,37})\bchanges? in) (?:the company's |our )?internal controls?(?: over financial reporting)?\b",
    ),
    "REMEDIATION_LANGUAGE": ("INTERNAL_CONTROLS", r"\b(?:remediat(?:e|ed|ion|ing)|corrective action)\b"),
    "ACCOUNTING_ERROR_OR_POLICY_LANGUAGE": (
        "SIGNIFICANT_ACCOUNTING",
        r"\b(?:accounting errors?|error in accounting|accounting misstatements?|change in accounting (?:principle|estimate)|correction of (?:an |the )?accounting (?:error|misstatement))\b",
    ),
}
# Fixed value: what each signal cannot do without (one of these), in lower case; a region that lacks it is not searched.
NEEDS = {
    "LISTING_NONCOMPLIANCE_LANGUAGE": ("not in compliance", "does not comply", "non-compliance", "deficienc"),
    "DELISTING_LANGUAGE": ("delist",),
    "REGAINED_COMPLIANCE_LANGUAGE": ("regained compliance", "has determined that "),
    "TRANSFER_OF_LISTING_LANGUAGE": ("transfer",),
    "AUDITOR_DISMISSAL_LANGUAGE": ("dismissed", "terminated"),
    "AUDITOR_RESIGNATION_LANGUAGE": ("resigned",),
    "AUDITOR_ENGAGEMENT_LANGUAGE": ("engaged", "appointed"),
    "AUDITOR_DISAGREEMENT_LANGUAGE": ("disagreement",),
    "REPORTABLE_EVENT_LANGUAGE": ("reportable event",),
    "RESTATEMENT_LANGUAGE": ("restat",),
    "GOING_CONCERN_LANGUAGE": ("substantial doubt", "going concern"),
    "MATERIAL_WEAKNESS_LANGUAGE": ("material weakness",),
    "CONTROL_INEFFECTIVENESS_LANGUAGE": ("disclosure controls", "internal control"),
    "CONTROL_CHANGE_LANGUAGE": ("internal control",),
    "REMEDIATION_LANGUAGE": ("remediat", "corrective action"),
    "ACCOUNTING_ERROR_OR_POLICY_LANGUAGE": ("accounting error", "error in accounting", "accounting misstatement", "change in accounting "),
}
# Items of a current report that are read, each with the signal of its presence and the events it may tell.
ITEMS = {
    "3.01": ("ITEM_3_01_NOTICE", ("LISTING_COMPLIANCE",)),
    "4.01": ("ITEM_4_01_NOTICE", ("AUDITOR_CHANGE",)),
    "4.02": ("ITEM_4_02_NON_RELIANCE", ("NON_RELIANCE_RESTATEMENT", "INTERNAL_CONTROLS", "SIGNIFICANT_ACCOUNTING")),
}
NOTICES = {"ITEM_3_01_NOTICE": "LISTING_COMPLIANCE", "ITEM_4_01_NOTICE": "AUDITOR_CHANGE", "ITEM_4_02_NON_RELIANCE": "NON_RELIANCE_RESTATEMENT", "LATE_FILING_NOTICE": "LATE_FILING"}
LATE_EVENTS = ("LATE_FILING", "GOING_CONCERN", "INTERNAL_CONTROLS", "SIGNIFICANT_ACCOUNTING")
PERIODIC_EVENTS = ("GOING_CONCERN", "INTERNAL_CONTROLS", "SIGNIFICANT_ACCOUNTING")
CURRENT_FORMS, LATE_FORMS = ("8-K", "8-K/A"), ("NT 10-K", "NT 10-Q")
ITEM, LATE = r"(?i)\bITEM\s+([1-9][.][0-9]{2})\b", r"(?i)\b(?:unable to file|could not be filed|not timely file)\b"
PARSER = "sec-accounting-compliance-v1"
MOST_EXCERPTS, MOST_CHARACTERS, MOST_IN_ALL, LATE_LEAD, NOTICE_HIT = 16, 900, 9_000, 400, 32
BEFORE, BEHIND = 220, 650
_MARK = "\x01"


def regions(filings: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """key, form, item, notice, start, region: where a filing may state something.

    Current reports: the longest section of each item in ITEMS, up to the next item of any number.  Late notices: from
    LATE_LEAD characters before what says so, or nothing.  Other forms: the whole text.  White space is collapsed.
    """
    f = settled(filings.select(key, F.col(form).alias("form"), collapse(F.col(text)).alias("visible"))).where("visible <> ''")
    current, late = F.col("form").isin(*CURRENT_FORMS), F.col("form").isin(*LATE_FORMS)
    parts = f.where(current).select(key, "form", F.posexplode(F.split(F.regexp_replace("visible", ITEM, f"{_MARK}$0"), _MARK)).alias("pos", "region"))
    ahead = F.sum(F.length("region")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("*", F.coalesce(ahead, F.lit(0)).alias("start"), F.regexp_extract("region", ITEM, 1).alias("item")).where(F.col("item").isin(*ITEMS) & (F.col("pos") > 0))
    longest = F.max(F.struct(F.length("region").alias("n"), (-F.col("pos")).alias("first"), "start", "region")).alias("x")
    notice = F.when(F.col("item") == "3.01", "ITEM_3_01_NOTICE").when(F.col("item") == "4.01", "ITEM_4_01_NOTICE").otherwise("ITEM_4_02_NON_RELIANCE")
    items = parts.groupBy(key, "form", "item").agg(longest).select(key, "form", "item", notice.alias("notice"), "x.start", "x.region")
    none = F.lit(None).cast("string")
    said = f.where(late).withColumn("hit", F.regexp_instr("visible", F.lit(LATE)) - 1).where("hit >= 0").withColumn("start", F.greatest(F.lit(0), F.col("hit") - LATE_LEAD))
    said = said.select(key, "form", none.alias("item"), F.lit("LATE_FILING_NOTICE").alias("notice"), F.col("start").cast("long").alias("start"), F.expr("substring(visible, start + 1)").alias("region"))
    whole = f.where(~current & ~late).select(key, "form", none.alias("item"), none.alias("notice"), F.lit(0).cast("long").alias("start"), F.col("visible").alias("region"))
    return items.unionByName(said).unionByName(whole)


def _allowed(event: str) -> Column:
    by_item = F.lit(False)
    for item, (_, events) in ITEMS.items():
        by_item = by_item | ((F.col("item") == item) & (event in events))
    return F.when(F.col("item").isNotNull(), by_item).when(F.col("form").isin(*LATE_FORMS), event in LATE_EVENTS).otherwise(event in PERIODIC_EVENTS)


def _window(start: Column, stop: Column) -> Column:
    """(a, b) of the sentence-wise window around a hit of a region (columns region): from the last sentence's end within BEFORE characters, to the next within BEHIND."""
    r, n = F.col("region"), F.length("region")
    low = F.greatest(F.lit(0), start - BEFORE)
    lead = F.reverse(F.substr(r, low + 1, start - low))
    last = lambda mark: F.locate(mark, lead)
    near = F.when(last(" .") > 0, F.when(last(" ;") > 0, F.least(last(" ."), last(" ;"))).otherwise(last(" ."))).otherwise(last(" ;"))
    a = F.when(near > 0, start - near + 1).otherwise(low)
    high = F.least(n, stop + BEHIND)
    dot = F.locate(". ", F.substr(r, stop + 1, high - stop))
    b = F.when(dot > 0, stop + dot).otherwise(high)
    tail = F.locate(" ", F.reverse(F.substr(r, a + 1, F.lit(MOST_CHARACTERS))))
    cut = F.when((tail > 0) & (tail < MOST_CHARACTERS), a + MOST_CHARACTERS - tail).otherwise(a + MOST_CHARACTERS)
    return F.struct(a.alias("a"), F.when(b - a > MOST_CHARACTERS, cut).otherwise(b).alias("b"))


def evidence(filings: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """key, item, start, stop, signals, text: excerpts of a filing that state something, by place.

    Each signal counts once a region, at its first hit, and only where its event may be told; the notice of a region
    counts at its start.  Signals of one excerpt are put together; an excerpt that would pass MOST_IN_ALL characters is
    left out, and MOST_EXCERPTS are kept.
    """
    r = settled(regions(filings, key, text, form).withColumn("low", F.lower("region")))
    holds = lambda name: reduce(lambda a, x: a | F.contains("low", F.lit(x)), NEEDS[name], F.lit(False))
    hit = lambda name, p: F.when(F.col("region").rlike(f"(?i){p}"), F.struct(F.lit(name).alias("signal"), (F.regexp_instr("region", F.lit(f"(?i){p}")) - 1).alias("at"), F.length(F.regexp_substr("region", F.lit(f"(?i){p}"))).alias("n")))
    notice = F.when(F.col("notice").isNotNull(), F.struct(F.col("notice").alias("signal"), F.lit(0).alias("at"), F.least(F.lit(NOTICE_HIT), F.length("region")).alias("n")))
    hits = F.array_compact(F.array(notice, *[F.when(_allowed(event) & holds(name), hit(name, p)) for name, (event, p) in SIGNALS.items()]))
    h = r.select(key, "item", "start", "region", F.explode(hits).alias("h"))
    h = settled(h.withColumn("w", _window(F.col("h.at"), F.col("h.at") + F.col("h.n"))))
    shown = F.expr("substring(region, w.a + 1, w.b - w.a)")
    h = h.withColumn("shown", shown).select(key, "item", (F.col("start") + F.col("w.a") + F.length("shown") - F.length(F.ltrim("shown"))).alias("start"), F.trim("shown").alias("text"), "h.signal")
    e = h.groupBy(key, "item", "start", "text").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    item = F.struct("start", (F.col("start") + F.length("text")).alias("stop"), "item", "signals", "text")
    kind = "array<struct<start:bigint,stop:bigint,item:string,signals:array<string>,text:string>>"
    first = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["out"]) < MOST_EXCERPTS) & (acc["used"] + F.length(x["text"]) <= MOST_IN_ALL)
        return F.when(fits, F.struct((acc["used"] + F.length(x["text"])).alias("used"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)

    kept = e.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(item)).cast(kind), first, step, lambda a: a["out"]).alias("kept"))
    return kept.select(key, F.explode("kept").alias("x")).select(key, "x.item", "x.start", "x.stop", "x.signals", "x.text")


def events(excerpts: DataFrame, key: str) -> DataFrame:
    """key, event_type, signals, n, fingerprint of the events that a filing's excerpts tell.

    The fingerprint is the SHA-256 of canonical JSON over the event, its signals and its excerpts' hashes, whatever the case.
    """
    event_of = {name: event for name, (event, _) in SIGNALS.items()} | NOTICES
    of = F.create_map(*[F.lit(x) for pair in event_of.items() for x in pair])
    told = excerpts.select(key, "start", "text", F.explode("signals").alias("signal")).withColumn("event_type", of[F.col("signal")])
    by = told.groupBy(key, "event_type").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.collect_set(F.struct("start", "text")).alias("texts"))
    quoted = lambda items: F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    hashes = F.array_sort(F.transform("texts", lambda x: F.sha2(F.lower(x["text"]), 256)))
    payload = F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","evidence_text_sha256s":'), quoted(hashes), F.lit(f',"parser_version":"{PARSER}","signals":'), quoted(F.col("signals")), F.lit("}"))
    return by.select(key, "event_type", F.array_join("signals", ",").alias("signals"), F.size("texts").cast("long").alias("n"), F.sha2(payload, 256).alias("fingerprint"))
