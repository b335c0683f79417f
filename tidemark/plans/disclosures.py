"""Registered queries on what filings disclose: accounting signals by region, and the events they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions import accounting as ac
from tidemark.functions import budget as bu
from tidemark.functions import reports as rp
from tidemark.operators import consolidated as co
from tidemark.operators import forensics as fo
from tidemark.tables import documents, table

_FORMS = ("8-K", "8-K/A", "NT 10-K", "NT 10-Q", "10-K", "10-Q")
# what stands before, between and behind two copies of a document's text
_SAID = (
    "Item 4.01 Changes in Registrant's Certifying Accountant. The board dismissed its independent auditor; there were no disagreements on accounting principles.",
    "Item 4.02 Non-Reliance on Previously Issued Financial Statements. We will restate the prior period because of an accounting error and found a material weakness.",
    "ITEM 3.01 Notice of Delisting. The company is not in compliance with the listing rule and may be delisted. Later it regained compliance.",
    "We were unable to file the report in time. There is substantial doubt about our ability to continue. Remediation goes on.",
    "Item 9.01 Financial Statements and Exhibits. The auditor resigned and the listing was transferred.",
    "There have been significant changes in our internal control over financial reporting. Disclosure controls and procedures were not effective.",
    "There have been no changes in our internal control. A change in accounting principle was adopted.",
    "Item 4.01 The accounting firm resigned. We engaged a new auditor after a reportable event.",
    "Item 1.01 Entry into an agreement that could not be filed.",
    "",
)


def _pick(n: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in _SAID]), (n % len(_SAID) + 1).cast("int"))


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    form = F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (k % len(_FORMS) + 1).cast("int"))
    text = F.concat_ws(" ", _pick(k), "text", _pick(k * 3 + 1), "text", _pick(k * 7 + 4))
    return documents(spark, sf).select("doc_id", form.alias("form"), text.alias("text"))


def _evidence_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    said = "[" + ", ".join(map(q, _SAID)) + "]"
    pick = lambda n: f"{said}[({n}) % {len(_SAID)} + 1]"
    at = lambda p, t="region": f"length(regexp_extract({t}, {q('(?is)^(.*?)(?:' + p + ')')}, 1))"
    allowed = lambda event: f"CASE WHEN item IS NOT NULL THEN item IN ({', '.join(q(i) for i, (_, e) in ac.ITEMS.items() if event in e) or 'NULL'}) WHEN form LIKE 'NT%' THEN {event in ac.LATE_EVENTS} ELSE {event in ac.PERIODIC_EVENTS} END"
    hits = ", ".join(f"CASE WHEN ({allowed(event)}) AND regexp_matches(region, {q('(?i)' + p)}) THEN {{'signal': {q(name)}, 'k': {at(p)}, 'n': length(regexp_extract(region, {q('(?i)' + p)}))}} END" for name, (event, p) in ac.SIGNALS.items())
    notice = "CASE WHEN notice IS NOT NULL THEN {'signal': notice, 'k': 0, 'n': least(32, length(region))} END"
    item, late = ac.ITEM.removeprefix("(?i)"), ac.LATE.removeprefix("(?i)")
    notices = " ".join(f"WHEN item = {q(i)} THEN {q(n)}" for i, (n, _) in ac.ITEMS.items())
    last = lambda mark: f"nullif(strpos(reverse(region[greatest(0, k - 220) + 1 : k]), {q(mark)}), 0)"
    return rf"""f AS (SELECT doc_id, {list(_FORMS)}[doc_id % 6 + 1] AS form, trim(regexp_replace(concat_ws(' ', {pick('doc_id')}, text, {pick('doc_id * 3 + 1')}, text, {pick('doc_id * 7 + 4')}), '[ \t\n\r\f]+', ' ', 'g')) AS visible FROM documents),
parts AS (SELECT doc_id, form, generate_subscripts(ps, 1) AS pos, unnest(ps) AS region FROM (SELECT *, string_split(regexp_replace(visible, {q('(?i)(' + item + ')')}, chr(1) || '\1', 'g'), chr(1)) AS ps FROM f WHERE form IN ('8-K', '8-K/A'))),
numbered AS (SELECT *, coalesce(sum(length(region)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_extract(region, {q('(?i)' + item)}, 1) AS item FROM parts),
longest AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY length(region) DESC, pos) AS nth FROM numbered WHERE pos > 1 AND item IN ('3.01', '4.01', '4.02')),
said AS (SELECT *, {at(late, 'visible')} AS hit FROM f WHERE form LIKE 'NT%' AND regexp_matches(visible, {q('(?i)' + late)})),
regions AS (SELECT doc_id, form, item, CASE {notices} END AS notice, start, region FROM longest WHERE nth = 1
  UNION ALL SELECT doc_id, form, NULL, 'LATE_FILING_NOTICE', greatest(0, hit - 400), visible[greatest(0, hit - 400) + 1 :] FROM said
  UNION ALL SELECT doc_id, form, NULL, NULL, 0, visible FROM f WHERE form IN ('10-K', '10-Q')),
hits AS (SELECT doc_id, item, start, region, unnest([{notice}, {hits}]) AS h FROM regions),
h AS (SELECT doc_id, item, start, region, h.signal AS signal, h.k AS k, h.k + h.n AS stop FROM hits WHERE h IS NOT NULL),
lead AS (SELECT *, least(coalesce({last(' .')}, {last(' ;')}), coalesce({last(' ;')}, {last(' .')})) AS near, nullif(strpos(region[stop + 1 : least(length(region), stop + 650)], '. '), 0) AS dot FROM h),
ab AS (SELECT *, CASE WHEN near IS NOT NULL THEN k - near + 1 ELSE greatest(0, k - 220) END AS a, CASE WHEN dot IS NOT NULL THEN stop + dot ELSE least(length(region), stop + 650) END AS b FROM lead),
cut AS (SELECT *, strpos(reverse(region[a + 1 : a + 900]), ' ') AS tail FROM ab),
shown AS (SELECT doc_id, item, start, a, signal, region[a + 1 : CASE WHEN b - a > 900 THEN CASE WHEN tail BETWEEN 1 AND 899 THEN a + 900 - tail ELSE a + 900 END ELSE b END] AS shown FROM cut),
excerpts AS (SELECT doc_id, item, start + a + length(shown) - length(ltrim(shown)) AS start, trim(shown) AS text, list_sort(list(DISTINCT signal)) AS signals FROM shown GROUP BY ALL)"""


@register("X12_accounting_signals", f"WITH {_evidence_sql()} SELECT doc_id, item, start::BIGINT AS start, (start + length(text))::BIGINT AS stop, array_to_string(signals, ',') AS signals, sha256(text) AS text_sha256 FROM excerpts")
def x12_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Six forms; each text twice with sentences around, so that signals stand inside and outside of their regions."""
    e = ac.evidence(_filings(spark, sf), "doc_id", "text", "form")
    return e.select("doc_id", "item", "start", "stop", F.array_join("signals", ",").alias("signals"), F.sha2("text", 256).alias("text_sha256"))


def _events_sql() -> str:
    event_of = {name: event for name, (event, _) in ac.SIGNALS.items()} | ac.NOTICES
    names = "MAP {" + ", ".join(f"'{n}': '{e}'" for n, e in event_of.items()) + "}"
    quoted = lambda items: f"'[' || array_to_string(list_transform({items}, lambda x: '\"' || x || '\"'), ',') || ']'"
    return f"""{_evidence_sql()},
told AS (SELECT doc_id, start, text, signal, {names}[signal] AS event_type FROM (SELECT doc_id, start, text, unnest(signals) AS signal FROM excerpts)),
by_event AS (SELECT doc_id, event_type, list_sort(list(DISTINCT signal)) AS signals, list(DISTINCT {{'start': start, 'text': text}}) AS texts FROM told GROUP BY 1, 2),
events AS (SELECT doc_id, event_type, array_to_string(signals, ',') AS signals, len(texts) AS n,
  sha256('{{"event_type":"' || event_type || '","evidence_text_sha256s":' || {quoted("list_sort(list_transform(texts, lambda x: sha256(lower(x.text))))")} || ',"parser_version":"{ac.PARSER}","signals":' || {quoted("signals")} || '}}') AS fingerprint FROM by_event)"""


@register(
    "X13_accounting_events",
    f"""WITH {_events_sql()}, e AS (SELECT doc_id, doc_id % 50 AS issuer, event_type, signals, n, fingerprint, doc_id % 3 > 0 AS complete, row_number() OVER (PARTITION BY doc_id % 50, event_type ORDER BY doc_id) AS r FROM events),
p AS (SELECT a.doc_id, a.event_type, max(b.doc_id) FILTER (a.fingerprint = b.fingerprint) AS x, max(b.doc_id) AS y FROM e a JOIN e b ON a.issuer = b.issuer AND a.event_type = b.event_type AND b.r BETWEEN a.r - 64 AND a.r - 1 GROUP BY 1, 2)
SELECT e.doc_id, e.event_type, signals, n, fingerprint, CASE WHEN x IS NOT NULL THEN 'repeated_disclosure' WHEN y IS NOT NULL THEN 'changed_disclosure' WHEN complete THEN 'new_disclosure' ELSE 'prior_comparison_unavailable' END AS comparison, coalesce(x, y) AS prior
FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.event_type = e.event_type""",
)
def x13_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of those filings, compared with the issuer's earlier ones; filings are accepted in the order of doc_id."""
    told = ac.events(ac.evidence(_filings(spark, sf), "doc_id", "text", "form"), "doc_id")
    day = F.timestamp_seconds(F.col("doc_id") * 3600)
    e = told.select("*", F.col("doc_id").alias("accession"), (F.col("doc_id") % 50).alias("issuer"), day.alias("accepted_at"), day.alias("retrieved_at"), (F.col("doc_id") % 3 > 0).alias("search_complete"))
    return fo.compared_with_prior(e, carried=("signals", "n", "fingerprint")).withColumnRenamed("accession", "doc_id")


_SECTIONS = (*co.ROLES, "contradictions")
_CITED = """c AS (SELECT conv_id, turn, ['material_facts', 'catalysts', 'positive_factors', 'negative_factors', 'risks', 'contradictions'][(conv_id + turn) % 6 + 1] AS section,
  CASE WHEN turn % 2 = 0 THEN 'reported_fact' ELSE 'analyst_inference' END AS kind, ['document_fact', 'catalyst', 'bull_case', 'bear_case', 'risk'][(conv_id * 2 + turn) % 5 + 1] AS category, ['neutral', 'neutral', 'bullish'][(conv_id + turn * 2) % 3 + 1] AS polarity,
  text || CASE WHEN turn % 4 = 1 THEN ' Later corrected to 12.' ELSE '' END AS record, text || CASE WHEN turn % 5 = 4 THEN ' altered' ELSE '' END AS quote,
  CASE WHEN turn % 7 = 6 THEN -1 ELSE turn END AS evidence_id, ['confirmed', 'resolved_by_later_correction', 'unresolved'][conv_id % 3 + 1] AS status, text || CASE WHEN turn % 3 = 1 THEN ' 77 http://a.b/c' ELSE '' END AS statement, turn % 3 AS available_at FROM conversations),
d AS (SELECT a.*, b.record AS before, b.available_at AS before_at FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)"""


def _reports(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A conversation as a report: each turn a finding or a contradiction of some section that cites the turn, or also the one before."""
    k, t = F.col("conv_id"), F.col("turn")
    of = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    c = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        of(_SECTIONS, k + t).alias("section"),
        F.when(t % 2 == 0, "reported_fact").otherwise("analyst_inference").alias("kind"),
        of(("document_fact", "catalyst", "bull_case", "bear_case", "risk"), k * 2 + t).alias("category"),
        of(("neutral", "neutral", "bullish"), k + t * 2).alias("polarity"),
        F.concat("text", F.when(t % 4 == 1, " Later corrected to 12.").otherwise("")).alias("record"),
        F.concat("text", F.when(t % 5 == 4, " altered").otherwise("")).alias("quote"),
        F.when(t % 7 == 6, -1).otherwise(t).alias("evidence_id"),
        of(("confirmed", co.RESOLVED, "unresolved"), k).alias("status"),
        F.concat("text", F.when(t % 3 == 1, " 77 http://a.b/c").otherwise("")).alias("statement"),
        (t % 3).alias("available_at"),
    )
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("record").alias("before"))
    d = c.join(before, ["conv_id", "turn"], "left")
    quote = lambda i, q: F.struct(i.cast("long").alias("evidence_id"), q.alias("quote"))
    finding = F.struct("turn", F.struct("statement", "kind", "category", "polarity", F.array(quote(F.col("evidence_id"), F.col("quote"))).alias("citations")).alias("f"))
    both = F.array_compact(F.array(quote(t, F.col("record")), F.when(F.col("before").isNotNull(), quote(t - 1, F.col("before")))))
    contradiction = F.struct("turn", F.struct(F.concat(F.lit("topic "), F.col("turn").cast("string")).alias("topic"), "status", both.alias("citations")).alias("f"))
    in_order = lambda s, x: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, x))), lambda y: y["f"]).alias(s)
    reports = d.groupBy("conv_id").agg(*[in_order(s, finding) for s in co.ROLES], in_order("contradictions", contradiction))
    reports = reports.select("*", F.when(k % 5 == 0, "old").otherwise(co.PROMPT).alias("prompt_version"), F.when(k % 4 == 0, co.CONFLICTING).otherwise("evidence_sufficient").alias("assessment"))
    return reports, c.select("conv_id", F.col("turn").cast("long").alias("evidence_id"), F.col("record").alias("text"), "available_at")


_LATE = "(before IS NOT NULL AND before_at <> available_at AND regexp_matches(CASE WHEN available_at > before_at THEN record ELSE before END, '(?i)\\b(?:correct|corrected|correction|revised|supersed)[A-Za-z0-9_]*\\b'))"


@register(
    "R28_consolidated_sections",
    rf"""WITH {_CITED}, s AS (SELECT *, evidence_id = -1 AS unknown, evidence_id <> -1 AND NOT contains(record, quote) AS altered, CASE WHEN evidence_id <> -1 AND contains(record, quote) THEN quote ELSE '' END AS support FROM d),
w AS (SELECT *, list_filter(list_distinct(list_transform(regexp_extract_all(statement, '[A-Za-z][A-Za-z''-]{{2,}}'), lambda x: lower(x))), lambda x: x NOT IN {rp.STOP_WORDS}) AS mine, list_distinct(list_transform(regexp_extract_all(support, '[A-Za-z][A-Za-z''-]{{2,}}'), lambda x: lower(x))) AS theirs FROM s WHERE section <> 'contradictions'),
e AS (SELECT conv_id, unnest([
    CASE WHEN kind = 'analyst_inference' AND len(list_intersect(mine, theirs)) < greatest(2, (len(mine) + 3) // 4) THEN 'inference_lexically_ungrounded' END,
    CASE WHEN altered THEN 'quote_not_verbatim' END, CASE WHEN unknown THEN 'unknown_evidence_id' END,
    CASE WHEN kind = 'reported_fact' AND (support = '' OR lower(trim(regexp_replace(statement, '\s+', ' ', 'g'))) <> lower(trim(regexp_replace(support, '\s+', ' ', 'g')))) THEN 'reported_fact_not_verbatim' END,
    CASE WHEN len(list_filter(regexp_extract_all(statement, '(?:^|[^A-Za-z0-9_])([-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?)', 1), lambda x: NOT contains(support, x))) > 0 THEN 'unsupported_numeric_token' END,
    CASE WHEN len(list_filter(regexp_extract_all(statement, 'https?://[^\s)\]}}>"'']+'), lambda x: NOT contains(support, x))) > 0 THEN 'unsupported_url' END,
    CASE WHEN NOT CASE section WHEN 'material_facts' THEN category = 'document_fact' WHEN 'catalysts' THEN category = 'catalyst' ELSE category IN ('bull_case', 'bear_case', 'risk') END THEN 'category_not_allowed_for_role' END,
    CASE WHEN kind = 'reported_fact' AND polarity <> 'neutral' THEN 'reported_fact_must_be_neutral' END,
    CASE WHEN section = 'material_facts' AND NOT (kind = 'reported_fact' AND polarity = 'neutral') THEN 'document_interpreter_must_report_neutral_facts' END]) AS code FROM w
  UNION ALL SELECT conv_id, unnest([CASE WHEN len(list_filter(regexp_extract_all('topic ' || turn, '[0-9]+'), lambda x: NOT contains(concat_ws(' ', record, before), x))) > 0 THEN 'unsupported_numeric_token' END,
    CASE WHEN status = 'resolved_by_later_correction' AND NOT {_LATE} THEN 'correction_not_explicit_or_later' WHEN status <> 'resolved_by_later_correction' AND {_LATE} THEN 'explicit_correction_not_resolved' END]) FROM d WHERE section = 'contradictions'
  UNION ALL SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'prompt_version_mismatch' END FROM d)
SELECT conv_id, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS errors FROM e GROUP BY 1""",
)
def r28_sections(spark: SparkSession, sf: str) -> DataFrame:
    reports, records = _reports(spark, sf)
    return co.validated(reports, records, "conv_id").select("conv_id", F.array_join("errors", ",").alias("errors"))


@register(
    "X18_report_normalization",
    f"""WITH {_CITED}, e AS (SELECT conv_id, unnest([CASE WHEN section = 'contradictions' AND conv_id % 4 <> 0 THEN 'contradiction_assessment' END, CASE WHEN section = 'contradictions' AND status <> 'resolved_by_later_correction' AND {_LATE} THEN 'explicit_later_correction_status' END,
  CASE WHEN section <> 'contradictions' AND kind = 'reported_fact' AND polarity <> 'neutral' THEN 'reported_fact_neutral_polarity' END]) AS change, section, kind, polarity, status, {_LATE} AS late FROM d)
SELECT conv_id, coalesce(string_agg(DISTINCT change, ',' ORDER BY change), '') AS changes, CASE WHEN conv_id % 4 = 0 OR bool_or(section = 'contradictions') THEN 'conflicting_evidence' ELSE 'evidence_sufficient' END AS assessment,
  count(*) FILTER (section <> 'contradictions' AND (kind = 'reported_fact' OR polarity = 'neutral')) // 3 AS neutral, count(*) FILTER (section = 'contradictions' AND (late OR status = 'resolved_by_later_correction')) // 3 AS resolved FROM e GROUP BY 1""",
)
def x18_reports(spark: SparkSession, sf: str) -> DataFrame:
    reports, records = _reports(spark, sf)
    n = co.normalized(reports, records, "conv_id")
    neutral = sum((F.size(F.filter(s, lambda f: f["polarity"] == "neutral")) for s in co.ROLES), F.lit(0))
    resolved = F.size(F.filter("contradictions", lambda c: c["status"] == co.RESOLVED))
    return n.select("conv_id", F.array_join("changes", ",").alias("changes"), "assessment", neutral.cast("long").alias("neutral"), resolved.cast("long").alias("resolved"))


# what a filing of each form holds around a document's text
_FORMED = (
    "Item 1.01 Entry into a Material Definitive Agreement. The company signed a supply contract with a new partner. It expects more.",
    "Item 4.02 Non-Reliance. A restatement is needed after a material weakness was found by the auditor.",
    "Item 9.01 Financial Statements and Exhibits. None",
    "Item 1A. Risk Factors There is substantial doubt about our ability to continue; a default on debt may follow.",
    "Item 2. Management's Discussion and Analysis Revenue grew and liquidity was adequate. Cash flows from operations rose.",
    "Item 3. Legal Proceedings We received a subpoena in an investigation. Item 4. Controls and Procedures There were no changes in internal control.",
    "Risk Factors 12 SIGNATURES This report contains forward-looking statements about the acquisition.",
    "Ordinary words only.",
)


@register("X24_form_aware_evidence")
def x24_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each text twice with sections of its form around; every fifth says that its risk factors changed.  Folds, which tests compare with a plain version."""
    k = F.col("doc_id")
    said = F.array(*[F.lit(x) for x in _FORMED])
    pick = lambda n: F.element_at(said, (n % len(_FORMED) + 1).cast("int"))
    form = F.element_at(F.array(*[F.lit(x) for x in ("8-K", "10-Q", "10-K/A", "S-1")]), (k % 4 + 1).cast("int"))
    changed = F.when(k % 5 == 0, F.array(F.lit("Risk  Factors"))).otherwise(F.array().cast("array<string>"))
    d = documents(spark, sf).select("doc_id", form.alias("form"), F.concat_ws(" ", pick(k), "text", pick(k * 3 + 1), pick(k * 5 + 2), "text").alias("text"), changed.alias("changed"))
    e = bu.selected(d, "doc_id", "text", "form", "changed")
    kinds = F.array_join(F.transform("windows", lambda w: F.concat_ws(":", w["first"].cast("string"), w["last"].cast("string"), w["kind"], w["reason"])), ",")
    return e.select("doc_id", "family", F.array_join("kept_terms", ",").alias("kept_terms"), kinds.alias("windows"), F.sha2("text", 256).alias("text_sha256"))
