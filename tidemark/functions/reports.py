"""Evidence and report checks as expressions and joins: admission, injection scan, grounding, windows, changed sections."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import collapse, constant, fold, let, settled, spans
from tidemark.operators.changes import first_difference
from tidemark.operators.scoring import first_true

# Patterns of text that gives orders to a model (numbered from 1).
INJECTION = (
    r"\bignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above)\s+instructions?\b",
    r"\b(?:system|developer)\s+(?:prompt|message|instructions?)\b",
    r"\byou\s+are\s+now\b",
    r"\b(?:call|invoke|use)\s+(?:a\s+|the\s+)?(?:tool|function|terminal|shell)\b",
    r"\b(?:execute|run)\s+(?:this\s+|the\s+)?(?:command|code|script)\b",
    r"\breveal\s+(?:the\s+|your\s+)?(?:prompt|secret|credentials?)\b",
    r"\b(?:send|upload|exfiltrate)\b.{0,80}\bhttps?://",
)
# Words that ground nothing, bounds of a request's evidence, and of a filing's windows and excerpts.
STOP_WORDS = ("about", "after", "before", "company", "could", "evidence", "from", "have", "into", "only", "that", "their", "there", "these", "this", "with", "would")
MAX_RECORDS, MAX_CHARACTERS = 8, 32_000
WINDOW, MAX_WINDOWS, MAX_EXCERPT = 560, 6, 3_600
MAX_CHANGES, CHANGE_CHARACTERS = 6, 600
# Failure class of a rejected report, its place, and the error codes that lead to it, the first class winning.
FAILURES = {
    "invalid_evidence_id": ("$.findings.citations.evidence_id", ("unknown_evidence_id",)),
    "numeric_conflict": ("$.findings.statement", ("unsupported_numeric_token",)),
    "provenance_failure": ("$.contradictions", ("correction_not_explicit_or_later", "explicit_correction_not_resolved", "conflict_without_contradiction")),
    "invalid_enum": ("$.role", ("prompt_version_mismatch", "role_mismatch", "category_not_allowed_for_role", "reported_fact_must_be_neutral", "document_interpreter_must_report_neutral_facts")),
    "unsupported_claim": ("$.findings", ("quote_not_verbatim", "reported_fact_not_verbatim", "inference_lexically_ungrounded", "unsupported_url")),
}
ERROR_CODES = tuple(code for _, codes in FAILURES.values() for code in codes)


def injection_hits(c: F.Column) -> F.Column:
    """Names of the patterns that a text holds."""
    return F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(f"pattern_{i}")) for i, p in enumerate(INJECTION, 1)]))


def admission(records: DataFrame) -> DataFrame:
    """request, admission: the first rule that a request's evidence breaks.

    records: request, evidence_id, text, available_at, retrieved_at, cutoff.
    """
    late = (F.col("available_at") > F.col("cutoff")) | (F.col("retrieved_at") > F.col("cutoff"))
    by = records.groupBy("request").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"), F.countDistinct("evidence_id").alias("ids"), F.bool_or(late).alias("late"), F.bool_or(F.size(injection_hits(F.col("text"))) > 0).alias("unsafe"))
    rules = [("record_count", F.col("n") > MAX_RECORDS), ("too_long", F.col("size") > MAX_CHARACTERS), ("repeated_id", F.col("ids") < F.col("n")), ("unavailable_at_cutoff", F.col("late")), ("quarantined", F.col("unsafe"))]
    return by.select("request", first_true(rules, "admitted").alias("admission"))


def _tokens(c: F.Column, pattern: str) -> F.Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _words(c: F.Column) -> F.Column:
    return F.array_distinct(F.transform(_tokens(c, r"[A-Za-z][A-Za-z'-]{2,}"), F.lower))


def finding_errors(findings: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, errors (codes in order): whether findings stand on verbatim quotes of the records that they cite.

    findings: keys, statement, kind, citations (evidence_id, quote); records: evidence_id, text.
    """
    cited = findings.select(*keys, "statement", "kind", F.explode_outer("citations").alias("c")).select(*keys, "statement", "kind", "c.evidence_id", "c.quote")
    checked = cited.join(records.select("evidence_id", F.col("text").alias("record")), "evidence_id", "left")
    holds = F.contains("record", F.col("quote"))
    by = checked.groupBy(*keys).agg(
        F.first("statement").alias("statement"),
        F.first("kind").alias("kind"),
        F.bool_or(F.col("evidence_id").isNotNull() & F.col("record").isNull()).alias("unknown"),
        F.bool_or(F.coalesce(~holds, F.lit(False))).alias("altered"),
        F.array_sort(F.collect_list(F.when(holds, F.col("quote")))).alias("quotes"),
    )
    support, statement = F.array_join("quotes", " "), F.col("statement")
    lacks = lambda tokens: F.exists(tokens, lambda x: ~F.contains(support, x))
    mine = F.filter(_words(statement), lambda x: ~x.isin(*STOP_WORDS))
    grounded = F.size(F.array_intersect(mine, _words(support))) >= F.greatest(F.lit(2), F.floor((F.size(mine) + 3) / 4))
    verbatim = F.exists("quotes", lambda q: fold(q) == fold(statement))
    rules = {
        "inference_lexically_ungrounded": (F.col("kind") == "analyst_inference") & ~grounded,
        "quote_not_verbatim": F.col("altered"),
        "reported_fact_not_verbatim": (F.col("kind") == "reported_fact") & ~verbatim,
        "unknown_evidence_id": F.col("unknown"),
        "unsupported_numeric_token": lacks(_tokens(statement, r"(?<![A-Za-z0-9_])[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?")),
        "unsupported_url": lacks(_tokens(statement, r"https?://[^\s)\]}>\"']+")),
    }
    return by.select(*keys, F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])).alias("errors"))


def failure(codes: F.Column) -> tuple[F.Column, F.Column]:
    """category and path of the first failure class that one of the codes belongs to."""
    rules = [(name, path, F.arrays_overlap(codes, F.array(*[F.lit(c) for c in members]))) for name, (path, members) in FAILURES.items()]
    return first_true([(r[0], r[2]) for r in rules], "other").alias("category"), first_true([(r[1], r[2]) for r in rules], "$").alias("path")


# Terminal reason of a failed stage.
STAGE_REASONS = {
    "sec_retrieval": "SOURCE_RETRIEVAL_FAILURE",
    "filing_parse": "FILING_PARSE_FAILURE",
    "companyfacts_normalization": "COMPANYFACTS_NORMALIZATION_FAILURE",
    "deterministic_processing": "DETERMINISTIC_PROCESSING_FAILURE",
    "verifier": "VERIFIER_FAILURE",
    "persistence": "PERSISTENCE_FAILURE",
}


def runtime_class(chain: F.Column) -> F.Column:
    """Class of an error by the names and messages of its chain of causes."""
    low = F.lower(chain)
    return F.when(F.contains(low, F.lit("timeout")), "timeout").when(F.contains(low, F.lit("refusal")) | F.contains(low, F.lit("refused")), "refusal").otherwise("provider_error")


def terminal_reason(kind: F.Column, codes: F.Column, chain: F.Column, stage: F.Column) -> F.Column:
    """Why a candidate ends incomplete: by the codes of a rejected analysis, the verifier, the provider's error chain, or the stage."""
    has = lambda *c: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in c]))
    rejected = F.when(has("numeric_conflict"), "NUMERIC_CONFLICT").when(has("provenance_failure"), "PROVENANCE_FAILURE").when(has("invalid_evidence_id", "unsupported_claim"), "EVIDENCE_VALIDATION_REJECTED").otherwise("ANALYST_CONTRACT_REJECTED")
    staged = F.lit("OTHER_BOUNDED_FAILURE")
    for name, reason in STAGE_REASONS.items():
        staged = F.when(stage == name, reason).otherwise(staged)
    provider = F.when(F.contains(chain, F.lit("TimeoutError")), "ANALYST_TIMEOUT").otherwise("ANALYST_PROVIDER_FAILURE")
    return F.when(kind == "analysis_rejected", rejected).when(kind == "verifier_unavailable", "VERIFIER_UNAVAILABLE").when(kind == "verification_rejected", "VERIFIER_FAILURE").when(kind == "model_provider", provider).otherwise(staged)


def most_attempts(kind: F.Column) -> F.Column:
    """Six tries where the verifier may recover, else three."""
    return F.when(kind.isin("verifier_unavailable", "verification_rejected"), 6).otherwise(3)


def terms_found(c: F.Column, terms: Sequence[str]) -> F.Column:
    low = F.lower(c)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def radar_points(terms: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key, attention, risk, strength, classification of what has findings.

    terms: key, up, down (terms of either polarity found); findings: key, category, polarity, citations, role.
    """
    good = F.col("category").isin("catalyst", "bull_case") | (F.col("polarity") == "bullish")
    bad = F.col("category").isin("risk", "bear_case") | (F.col("polarity") == "bearish")
    by = findings.groupBy(key).agg(F.count("*").alias("n"), F.count_if(good).alias("pos"), F.count_if(bad).alias("neg"), F.sum("citations").alias("cites"), F.countDistinct("role").alias("analyses"))
    capped = lambda c: F.least(F.lit(100), c).cast("int")
    p = terms.join(by, key).select(
        key, "pos", "neg", capped(F.col("up") * 5 + F.col("pos") * 18 + F.col("n") * 3).alias("attention"), capped(F.col("down") * 7 + F.col("neg") * 18).alias("risk"), capped(35 + F.col("analyses") * 15 + F.col("cites") * 5).alias("strength")
    )
    pos, neg = F.col("pos") > 0, F.col("neg") > 0
    rule = first_true([("mixed", pos & neg & (F.least("attention", "risk") >= 30)), ("opportunity", pos & (F.col("attention") >= 35)), ("risk", neg & (F.col("risk") >= 35))], "watch")
    return p.select(key, "attention", "risk", "strength", rule.alias("classification"))


def compute_route(requires_model: F.Column, complex_: F.Column, important: F.Column) -> list[F.Column]:
    """route, deployment, evidence_profile, larger_model: the cheapest route that a benchmark allows."""
    rich = requires_model & (complex_ | important)
    return [
        first_true([("no_model", ~requires_model), ("richer_bounded", rich)], "bounded").alias("route"),
        F.when(rich, "shadow_only").otherwise("current_runtime").alias("deployment"),
        first_true([("none", ~requires_model), ("richer_bounded_shadow", rich)], "accepted_bounded").alias("evidence_profile"),
        F.when(rich, "unavailable_no_benefit_evidence").otherwise("not_requested").alias("larger_model"),
    ]


def keyword_windows(c: F.Column, up: Sequence[str], down: Sequence[str], collapsed: bool = False) -> F.Column:
    """Up to six windows (start, stop, text) around term hits, in text order, none touching another.

    The first hit of each polarity has the first choice, then all hits in text order; a window is half of WINDOW to
    either side, cut to whole words.  Character 0 is the first of the text with its white space collapsed, as
    `collapsed` says that c has it already.
    """
    return _keyword_windows(c, up, down) if collapsed else let(collapse(c), lambda t: _keyword_windows(t, up, down))


def _keyword_windows(t: F.Column, up: Sequence[str], down: Sequence[str]) -> F.Column:
    at = lambda low, terms: F.filter(F.array(*[F.when(F.contains(low, F.lit(x)), F.locate(x, low) - 1) for x in terms]), lambda p: p >= 0)
    first = lambda p: F.filter(F.array(F.array_min(p)), lambda x: x.isNotNull())
    order = let(F.lower(t), lambda low: let(F.array(at(low, up), at(low, down)), lambda p: F.array_distinct(F.concat(first(p[0]), first(p[1]), F.array_sort(F.flatten(p))))))

    def window(p: F.Column, n: F.Column) -> F.Column:
        ends = F.struct(F.greatest(F.lit(0), p - WINDOW // 2).alias("a"), F.least(n, p + WINDOW // 2).alias("b"))
        near = lambda x: let(F.substr(t, x["a"] + 1, x["b"] - x["a"]), lambda s: F.struct(F.locate(" ", F.substr(s, F.lit(1), p - x["a"])).alias("space"), F.locate(" ", F.reverse(F.substr(s, p - x["a"] + 1, x["b"] - p))).alias("tail")))
        return let(ends, lambda x: let(near(x), lambda y: words(p, n, x["a"], x["b"], y["space"], y["tail"])))

    def words(p: F.Column, n: F.Column, a: F.Column, b: F.Column, space: F.Column, tail: F.Column) -> F.Column:
        start = F.when((a > 0) & (space > 0), a + space).otherwise(a)
        stop = F.when((b < n) & (tail > 0) & (b - tail > p), b - tail).otherwise(b)
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))

    none = F.array().cast("array<struct<start:int,stop:int>>")
    free = lambda acc, w: ~F.exists(acc, lambda o: (w["start"] <= o["stop"]) & (w["stop"] >= o["start"]))
    chosen = F.aggregate(let(F.length(t), lambda n: F.transform(order, lambda p: window(p, n))), none, lambda acc, w: F.when((F.size(acc) < MAX_WINDOWS) & free(acc, w) & (w["stop"] > w["start"]), F.array_append(acc, w)).otherwise(acc))
    return F.transform(F.array_sort(chosen), lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.trim(F.substr(t, w["start"] + 1, w["stop"] - w["start"])).alias("text")))


def excerpt_of(windows: F.Column) -> F.Column:
    """The windows' texts in order, with a mark between them, up to MAX_EXCERPT characters."""
    return F.trim(F.substring(F.array_join(F.transform(windows, lambda w: w["text"]), "\n\n[…]\n\n"), 1, MAX_EXCERPT))


def changed_excerpts(before: DataFrame, after: DataFrame, key: str, section: str, categories: Sequence[str]) -> DataFrame:
    """key, section, category, kind, first_difference, previous, current of the first MAX_CHANGES changed sections of a key.

    before and after: key, section, category, text.  Sections are taken in the order of categories, then of section.  A
    changed section shows half of CHANGE_CHARACTERS of either version around the first difference, others their start.
    """
    a = before.select(key, section, F.col("category").alias("ca"), F.col("text").alias("x"))
    b = after.select(key, section, F.col("category").alias("cb"), F.col("text").alias("y"))
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("modified")
    c = a.join(b, [key, section], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).withColumn("kind", kind).withColumn("category", F.coalesce("cb", "ca"))
    w = Window.partitionBy(key).orderBy(F.array_position(F.array(*[F.lit(x) for x in categories]), F.col("category")), section)
    c = c.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= MAX_CHANGES)
    modified, half = F.col("kind") == "modified", CHANGE_CHARACTERS // 2
    c = c.withColumn("first_difference", F.when(modified, first_difference(F.col("x"), F.col("y"))).cast("int"))

    def shown(t: str) -> F.Column:
        start = F.greatest(F.lit(0), F.least(F.col("first_difference") - half // 2, F.length(t) - half))
        return F.when(modified, F.substr(t, start + 1, F.lit(half))).otherwise(F.substring(t, 1, CHANGE_CHARACTERS))

    return c.select(key, section, "category", "kind", "first_difference", shown("x").alias("previous"), shown("y").alias("current"))


def partnerships(texts: DataFrame, key: str) -> DataFrame:
    """key, entities, comparator, amount, scale of texts with exactly one sentence that names a partnership of two or more."""
    every = F.split(F.regexp_replace("text", r"\s+", " "), "[.!?]")
    sentences = texts.select(key, F.explode(F.filter(every, lambda q: F.contains(F.lower(q), F.lit("partnership")))).alias("q")).withColumn("q", F.trim("q"))
    said = F.regexp_extract("q", r"(?i)\bwith\s+(.{3,500}?)\s+to\s+(?:mobilize|raise|deploy|establish|create|build|finance)\b", 1)
    bare = F.regexp_replace(F.trim(said), r"(?i)^(the\s+)?(strategic\s+)?(partnerships?\s+)?", "")
    names = F.filter(F.transform(F.split(bare, r"\s*,\s*|\s+and\s+"), lambda n: F.btrim(n, F.lit(" ,"))), lambda n: n != "")
    c = sentences.withColumn("names", names).where(F.size("names") >= 2)
    none = lambda x: F.nullif(F.lower(x), F.lit(""))
    c = c.select(
        key,
        F.array_join(F.array_sort(F.transform("names", F.lower)), "|").alias("entities"),
        none(F.regexp_extract("q", r"(?i)(over|more than|at least|up to|approximately)\s*\$", 1)).alias("comparator"),
        F.regexp_replace(F.regexp_extract("q", r"\$\s*([0-9][0-9,.]*)", 1), ",", "").alias("amount"),
        none(F.regexp_extract("q", r"(?i)\$\s*[0-9][0-9,.]*\s*(million|billion|trillion)", 1)).alias("scale"),
    )
    return c.groupBy(key).agg(F.count("*").alias("n"), *[F.min(x).alias(x) for x in ("entities", "comparator", "amount", "scale")]).where("n = 1").drop("n")


# Selectors of a filing's sections with their headings, and the items that must stand before one in a periodic form.
HEADINGS = {
    "controls.internal-control": ("Internal Control over Financial Reporting|INTERNAL CONTROL OVER FINANCIAL REPORTING", ""),
    "controls.procedures": ("Controls and Procedures|CONTROLS AND PROCEDURES", "4|9A"),
    "debt.borrowings": ("Borrowings|BORROWINGS", ""),
    "debt.credit-facilities": ("Credit Facilities|CREDIT FACILITIES", ""),
    "debt.debt": ("Debt(?: Financing)?|DEBT(?: FINANCING)?", ""),
    "going-concern": ("Going Concern(?: Assessment)?|GOING CONCERN(?: ASSESSMENT)?", ""),
    "issuance.dilution": ("Dilution|DILUTION", ""),
    "issuance.securities": ("Description of (?:Capital Stock|Securities)|DESCRIPTION OF (?:CAPITAL STOCK|SECURITIES)", ""),
    "issuance.unregistered-sales": ("Recent Sales of Unregistered (?:Equity )?Securities|RECENT SALES OF UNREGISTERED (?:EQUITY )?SECURITIES", ""),
    "issuance.use-of-proceeds": ("Use of Proceeds|USE OF PROCEEDS", ""),
    "liquidity": ("Liquidity and Capital Resources|LIQUIDITY AND CAPITAL RESOURCES", ""),
    "litigation": ("Legal Proceedings|LEGAL PROCEEDINGS", "1|3"),
    "outlook": ("Outlook|OUTLOOK|Business Outlook|BUSINESS OUTLOOK|Known Trends and Uncertainties|KNOWN TRENDS AND UNCERTAINTIES", ""),
    "risks": ("Risk Factors|RISK FACTORS", "1A"),
}
# Fixed value: borders that are no heading.  _NUMBER stands before a number with a dot that no letter, digit or dot precedes.
_NUMBER = "\x03"
BORDER = rf"\b(?:ITEM|Item)\s+{_NUMBER}?[0-9]{{1,2}}[A-C]?\.?\s+[A-Z]|\bSIGNATURES\b|{_NUMBER}[0-9]{{1,2}}\.\s+[A-Z][A-Za-z][A-Za-z &’'\-/]{{2,80}}"
NUMBERED = (r"(?=[0-9])(?<![\w.])([0-9]{1,2}\.)", rf"{_NUMBER}$1")
# the same borders, with a look at what they begin with before their kinds are told apart
_BORDER = rf"(?=[IS{_NUMBER}])(?:{BORDER})"
LEAST_SECTION, MOST_SECTION, CONTENTS_SAMPLE, CONTEXT = 80, 20_000, 600, 48


def _heads(visible: F.Column, periodic: F.Column) -> F.Column:
    """(selector, start, stop) of all headings; only texts that hold a heading's first words are searched for it."""
    first = lambda heading: sorted({w for w in re.split(r"\||\(.*?\)\??", heading) if w.strip()})
    begin = lambda heading: "".join(sorted({w[0] for w in first(heading)}))
    every = [{"selector": s, "pattern": rf"(?=[{begin(h)}])\b(?:{h})\b", "item": items and rf"(?:ITEM|Item)\s+(?:{items})\.?\s*$", "words": first(h)} for s, (h, items) in HEADINGS.items()]
    before = lambda x: F.substr(visible, F.greatest(F.lit(0), x["start"] - CONTEXT) + 1, F.least(x["start"], F.lit(CONTEXT)))

    def found(h: F.Column) -> F.Column:
        places = F.filter(spans(visible, h["pattern"]), lambda x: ~periodic | (h["item"] == "") | F.rlike(before(x), h["item"]))
        return F.transform(places, lambda x: F.struct(h["selector"].alias("selector"), x["start"].alias("start"), x["stop"].alias("stop")))

    asked = F.filter(constant(every, "array<struct<selector:string,pattern:string,item:string,words:array<string>>>"), lambda h: F.exists(h["words"], lambda w: F.contains(visible, w)))
    return F.flatten(F.transform(asked, found))


def _borders(visible: F.Column) -> F.Column:
    """Starts of the borders that are no heading."""
    numbered = F.when(visible.rlike(r"[0-9]\."), F.regexp_replace(visible, *NUMBERED)).otherwise(visible)
    some = lambda t: reduce(lambda a, w: a | F.contains(t, F.lit(w)), ("ITEM", "Item", "SIGNATURES", _NUMBER), F.lit(False))
    bare = lambda c: F.length(F.replace(c, F.lit(_NUMBER)))
    none = F.array().cast("array<int>")
    return let(numbered, lambda t: F.when(some(t), F.transform(spans(t, _BORDER, bare), lambda x: x["start"])).otherwise(none))


def sections(df: DataFrame, key: str, text: str, periodic: str) -> DataFrame:
    """key, selector, start, section: the first substantial section of each heading, tables of contents aside.

    Borders of all kinds (headings, items, numbered headings, signatures) are places in the text with its white space
    collapsed; in order of place, a section ends at the first one after its heading.  In a periodic form some headings
    count only behind their item.  Other forms prefer a heading in capitals.  Places are found text by text, so no text
    is moved, and of a heading only what its section can hold.
    """
    t = settled(df.select(key, F.col(periodic).alias("periodic"), collapse(F.col(text)).alias("visible"))).where("visible <> ''")
    t = settled(t.select(key, "periodic", "visible", _heads(F.col("visible"), F.col("periodic")).alias("heads"), _borders(F.col("visible")).alias("borders")))
    # a text without headings has no section
    t = t.where(F.size("heads") > 0)
    n = F.length("visible")
    starts = F.concat("borders", F.transform("heads", lambda h: h["start"]), F.array(n))
    border = F.transform(starts, lambda p: F.struct(p.cast("long").alias("place"), F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("selector", "string"), ("begin", "long"), ("body", "string"))]))
    body = lambda h: F.substr("visible", h["start"] + 1, F.lit(MOST_SECTION))
    asked = F.transform("heads", lambda h: F.struct(h["stop"].cast("long").alias("place"), F.lit(1).alias("kind"), h["selector"].alias("selector"), h["start"].cast("long").alias("begin"), body(h).alias("body")))
    marks = t.select(key, "periodic", F.explode(F.concat(border, asked)).alias("m")).select(key, "periodic", "m.*")
    after = Window.partitionBy(key).orderBy("place", "kind").rowsBetween(1, Window.unboundedFollowing)
    p = marks.withColumn("end", F.min(F.when(F.col("kind") == 0, F.col("place"))).over(after)).where("kind = 1")
    p = p.withColumn("section", F.trim(F.expr("substring(body, 1, coalesce(end - begin, length(body)))")))
    sample = F.substring("section", 1, CONTENTS_SAMPLE)
    n = lambda pattern: F.regexp_count(sample, F.lit(pattern))
    contents = (n(r"\b(?:ITEM|Item)\s+[0-9]") >= 3) | (n(r"\b[0-9]{1,3}\s+(?:ITEM|Item|PART|Part)\b") >= 2) | ((n(r"\b(?:S-|F-)?[0-9]{1,3}\b") >= 3) & (n(r"\b[A-Z][A-Z &’'\-/]{4,}\b") >= 2))
    good = p.where((F.length("section") >= LEAST_SECTION) & ~contents)
    plain = ~F.col("periodic") & ~F.col("section").rlike("^[A-Z]{2}")
    first = F.min(F.struct(plain.alias("plain"), F.col("begin").alias("start"), "section")).alias("x")
    return good.groupBy(key, "selector").agg(first).select(key, "selector", "x.start", "x.section")
