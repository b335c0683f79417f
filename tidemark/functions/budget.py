"""Form-aware evidence: windows around material language in the sections of a filing's form, under one budget.

The keyword excerpt of any form is the baseline.  Its terms are kept if the form's own sections hold them, windows of
different sections come first, and a filing without such windows keeps the baseline.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import reports as rp
from tidemark.functions.text import collapse, cut, holds_any, let, literals, one_of, settled, spans
from tidemark.shared import kept

# Words of a baseline, items of a current report, headings of a periodic one (pattern, kind, priority, label).
UP = ("contract", "award", "partnership", "approval", "guidance", "record revenue", "acquisition", "strategic agreement", "commercial launch", "backlog")
DOWN = ("going concern", "material weakness", "investigation", "subpoena", "impairment", "default", "bankruptcy", "restructuring", "dilution", "restatement")
ITEMS = {
    "1.01": ("material_agreement", 0),
    "1.02": ("material_agreement", 0),
    "2.01": ("material_agreement", 0),
    "2.02": ("financial_results", 1),
    "2.03": ("financing", 0),
    "2.04": ("financing", 0),
    "2.05": ("management", 1),
    "3.01": ("listing_and_regulatory", 0),
    "3.02": ("financing", 0),
    "3.03": ("financing", 1),
    "4.01": ("accounting_and_auditor", 0),
    "4.02": ("accounting_and_auditor", 0),
    "5.02": ("management", 0),
    "5.03": ("other_material", 2),
    "5.07": ("other_material", 2),
    "7.01": ("other_material", 3),
    "8.01": ("other_material", 2),
    "9.01": ("financial_results", 4),
}
HEADINGS = (
    (r"management(?:['’]s|s)? discussion and analysis", "liquidity_and_md_and_a", 0, "Management discussion and analysis"),
    (r"risk factors", "risk_factors", 0, "Risk factors"),
    (r"controls and procedures", "controls", 0, "Controls and procedures"),
    (r"financial statements and supplementary data", "financial_results", 2, "Financial statements and supplementary data"),
    (r"financial statements", "financial_results", 3, "Financial statements"),
    (r"legal proceedings", "legal", 1, "Legal proceedings"),
    (r"defaults upon senior securities", "financing", 0, "Defaults upon senior securities"),
    (r"unregistered sales of equity securities", "financing", 1, "Unregistered sales of equity securities"),
)
# Material language (pattern, kind, priority of a hit), boilerplate, and sections that say nothing.
MATERIAL = (
    (r"\bgoing concern\b|\bsubstantial doubt\b", "going_concern", 0),
    (r"\b(?:independent registered public accounting firm|auditor|accountant)\b|\bnon-reliance\b|\brestatement\b", "accounting_and_auditor", 0),
    (r"\bmaterial weakness\b|\b(?:disclosure controls(?: and procedures)?|internal control(?: over financial reporting)?)\b.{0,220}\b(?:are|were|is|was) (?:in)?effective\b", "controls", 0),
    (r"\bdisclosure controls\b|\binternal control\b", "controls", 1),
    (r"\b(?:delist(?:ing|ed)?|listing deficiency|noncompliance|subpoena|investigation|regulatory)\b", "listing_and_regulatory", 0),
    (r"\b(?:appointed|resigned|terminated|chief executive officer|chief financial officer|director)\b", "management", 1),
    (r"\b(?:agreement|contract|award|partnership|acquisition|disposition|merger)\b", "material_agreement", 1),
    (r"\b(?:offering|shelf|at-the-market|pipe|convertible|preferred|warrant|equity line|credit facility|debt|covenant|maturity|default|dilution)\b", "financing", 1),
    (r"\b(?:liquidity|cash flows?|revenue|net loss|impairment|restructuring|bankruptcy)\b", "liquidity_and_md_and_a", 2),
)
BOILERPLATE = (r"\bforward-looking statements?\b", r"\bincorporated(?: herein)? by reference\b", r"\bexhibit index\b", r"\bpursuant to the requirements of the securities exchange act\b")
REPEATED = (
    *BOILERPLATE,
    r"\bi have disclosed, based on our most recent evaluation\b",
    r"\bwhether (?:any|the) .*financial statements?.*(?:error corrections?|restatements?)\b",
    r"\bexpected\b(?:.{0,1800}\bexpected\b){2}",
    r"\bloss per common share\b.*\bno dilution\b.*\bpotential dilution\b",
)
# How the matches of each piece of material language begin, and wordings of which each match of boilerplate holds one.
WORDS = (
    ("going concern", "substantial doubt"),
    ("independent registered public accounting firm", "auditor", "accountant", "non-reliance", "restatement"),
    ("material weakness", "disclosure controls", "internal control"),
    ("disclosure controls", "internal control"),
    ("delist", "listing deficiency", "noncompliance", "subpoena", "investigation", "regulatory"),
    ("appointed", "resigned", "terminated", "chief executive officer", "chief financial officer", "director"),
    ("agreement", "contract", "award", "partnership", "acquisition", "disposition", "merger"),
    ("offering", "shelf", "at-the-market", "pipe", "convertible", "preferred", "warrant", "equity line", "credit facility", "debt", "covenant", "maturity", "default", "dilution"),
    ("liquidity", "cash flow", "revenue", "net loss", "impairment", "restructuring", "bankruptcy"),
)
NEEDS = ("forward-looking statement", "incorporated", "exhibit index", "pursuant to the requirements")
NEEDS_REPEATED = (*NEEDS, "i have disclosed", "whether ", "expected", "loss per common share")
EMPTY = r"\b(?:there (?:were|have been)|we identified) no (?:material )?changes\b|\bno response is required\b|\bno material developments?\b"
WINDOW, MAX_WINDOWS, SEPARATOR = 560, 6, "\n\n[…]\n\n"
_ITEM, _BORDER = r"\bITEM\s+([0-9]\.[0-9]{2})\b", r"\bITEM\s+[0-9]{1,2}[A-C]?\.?\s+|\bSIGNATURES\b"
_LABELS = "|".join(h[0] for h in HEADINGS)
_WORDS = rf"(?i)\b{one_of(sorted({w for words in WORDS for w in words}))}"
_TERMS = rf"(?i)(?<!\w){one_of((*UP, *DOWN))}(?!\w)"
_WIDE = 2  # the material language that spans other words
_PARTS = "array<struct<start:int,stop:int,k:struct<label:string,kind:string,priority:int,item:string>>>"
BACK, AHEAD = 900, 1_200  # what is looked at around a place: more than a sentence of WINDOW and what fills it up


def family(form: Column) -> Column:
    base = F.regexp_replace(F.upper(form), "/A$", "")
    return F.when(base == "8-K", "current_report").when(base.isin("10-K", "10-Q"), "periodic_report").otherwise("fallback")


def parts(visible: Column, family: Column) -> Column:
    """(start, stop, k: label, kind, priority, item) of the sections of a text that its form knows.

    A current report has its numbered items; a periodic one the items with a known heading, or without any such item the
    known headings wherever they stand.  A section ends at the next item, heading looked for, or the signatures.
    """
    known = lambda label, kind, priority, item: F.struct(F.lit(label).cast("string").alias("label"), F.lit(kind).cast("string").alias("kind"), F.lit(priority).cast("int").alias("priority"), F.lit(item).cast("string").alias("item"))

    def item_of(name: Column) -> Column:
        k = F.when(F.lit(False), known(None, None, None, None))
        for number, (kind, priority) in ITEMS.items():
            k = k.when(name == number, known(f"8-K Item {number}", kind, priority, number))
        return k

    def heading_of(name: Column) -> Column:
        k = F.when(F.lit(False), known(None, None, None, None))
        for pattern, kind, priority, label in HEADINGS:
            k = k.when(name.rlike(f"^(?:{pattern})$"), known(label, kind, priority, None))
        return k

    def named(border: str, head: str, kind_of: Callable[[Column], Column]) -> Column:
        name = lambda x: F.lower(F.regexp_extract(x["text"], f"(?i)^{head}", 1))
        k = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), let(name(x), kind_of).alias("k"))
        return F.filter(F.transform(cut(visible, f"(?i){border}"), k), lambda x: x["k"].isNotNull()).cast(_PARTS)

    periodic, item = family == "periodic_report", r"ITEM\s+[0-9]{1,2}[A-C]?\.?\s+"
    explicit = periodic & visible.rlike(rf"(?i)\b{item}(?:{_LABELS})\b")
    everywhere = named(rf"\b(?:(?:{_LABELS})\b|{item}|SIGNATURES\b)", rf"({_LABELS})\b", heading_of)
    return F.when(family == "current_report", named(_ITEM, _ITEM, item_of)).when(explicit, named(_BORDER, rf"{item}({_LABELS})\b", heading_of)).when(periodic, everywhere).otherwise(F.array().cast(_PARTS))


def sections(filings: DataFrame, key: str) -> DataFrame:
    """key, changed, start, body, label, kind, priority, item: a row for each of the parts of filings (key, visible, changed, parts)."""
    p = filings.select(key, "changed", "visible", F.explode("parts").alias("p"))
    return p.select(key, "changed", F.col("p.start").cast("long").alias("start"), F.substr("visible", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")).alias("body"), "p.k.*")


def _contents(x: Column) -> Column:
    """Whether a text is only a line of a table of contents."""
    n = lambda p: F.regexp_count(x, F.lit(p))
    numbers = x.rlike(r"(?:[0-9]++[^0-9]++){4}[0-9]")  # five of them, before they are looked at
    table = (F.length(x) <= WINDOW) & numbers & ~F.contains(x, F.lit("$")) & (n(r"(?i)\b(?:report|statements?|notes?|balance sheets?|operations|cash flows?)\b") >= 5) & (n(r"(?<![.$])\b[0-9]{1,3}\b(?![.,%])") >= 5)
    bare = F.btrim(F.lower(x), F.lit(" ."))
    labels = "|".join(h[3].lower() for h in HEADINGS)
    line = bare.rlike(rf"^(?:item\s+[0-9]{{1,2}}[a-c]?\.?\s+)?(?:{labels})(?: and use of proceeds)?(?:\s+[0-9]+)?$") | ~x.rlike(r"[.$%]")
    return table | ((F.length(x) < 120) & line)


def _says_nothing(x: Column) -> Column:
    low = F.lower(x)
    short = (F.length(x) <= 180) & low.rlike(r"\b(?:not applicable|none)\.?$")
    refers = (F.length(x) <= 400) & F.contains(low, F.lit("risk factors")) & F.contains(low, F.lit("form 10-k"))
    return short | (holds_any(low, ("no changes", "no material", "no response")) & low.rlike(EMPTY)) | refers


def _any(x: Column, patterns: Sequence[str]) -> Column:
    return x.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _framed(rows: DataFrame, source: Column, at: Column, low: Column, high: Column) -> DataFrame:
    """rows with what stands around a place of a text between two borders: near, its begin n0 in the text, and the place q in near."""
    n0 = F.greatest(low, at - BACK)
    near = F.substr(source, (n0 + 1).cast("int"), (F.least(high, at + AHEAD) - n0).cast("int"))
    return rows.withColumns({"near": near, "n0": n0.cast("int"), "q": (at - n0).cast("int")})


def _around(rows: DataFrame) -> DataFrame:
    """rows with a, b: whole words of near within half a WINDOW to either side of q."""
    rows = settled(rows.withColumns({"n": F.length("near"), "a0": F.greatest(F.lit(0), F.col("q") - WINDOW // 2), "b0": F.least(F.length("near"), F.col("q") + WINDOW // 2)}))
    lead = F.locate(" ", F.substr("near", F.col("a0") + 1, F.col("q") - F.col("a0")))
    tail = F.locate(" ", F.reverse(F.substr("near", F.col("q") + 1, F.col("b0") - F.col("q"))))
    rows = settled(rows.withColumns({"lead": lead, "tail": tail}))
    a = F.when((F.col("a0") > 0) & (F.col("lead") > 0), F.col("a0") + F.col("lead")).otherwise(F.col("a0"))
    b = F.when((F.col("b0") < F.col("n")) & (F.col("tail") > 0) & (F.col("b0") - F.col("tail") > F.col("q")), F.col("b0") - F.col("tail")).otherwise(F.col("b0"))
    return rows.withColumns({"a": a, "b": b}).drop("a0", "b0", "lead", "tail")


def _sentence(rows: DataFrame) -> DataFrame:
    """rows with a, b: the whole sentence of q in near, filled up to WINDOW with whole words; a longer one is cut around the place, and so is what is no sentence (`whole`)."""
    q, span = F.col("q"), BACK * 2 // 3  # a sentence that is not seen to end within a span is longer than WINDOW
    last = F.substr("near", F.greatest(F.lit(0), q - span) + 1, F.least(q, F.lit(span)))
    ahead = F.substr("near", q + 1, F.lit(span))
    for m in (". ", "? ", "! "):
        last = F.substring_index(last, m, -1)
    rows = _around(rows).withColumnsRenamed({"a": "wa", "b": "wb"})
    rows = settled(rows.withColumns({"s": q - F.length(last), "ahead": ahead}))
    until = F.col("ahead")
    for m in (". ", "? ", "! "):
        until = F.substring_index(until, m, 1)
    rows = settled(rows.withColumn("until", F.length(until)))
    e = q + F.col("until") + F.when(F.col("until") < F.length("ahead"), 1).otherwise(0)
    rows = settled(rows.withColumn("e", e).drop("ahead", "until"))
    spare = F.lit(WINDOW) - (F.col("e") - F.col("s"))
    rows = rows.withColumn("ra", F.greatest(F.lit(0), F.col("s") - F.floor(spare / 2)).cast("int"))
    rows = settled(rows.withColumn("rb", F.least(F.col("n"), F.col("e") + spare - (F.col("s") - F.col("ra")))))
    lead = F.locate(" ", F.substr("near", F.col("ra") + 1, F.col("s") - F.col("ra")))
    tail = F.locate(" ", F.reverse(F.substr("near", F.col("e") + 1, F.col("rb") - F.col("e"))))
    rows = settled(rows.withColumns({"lead": lead, "tail": tail}))
    a = F.when((F.col("ra") > 0) & (F.col("lead") > 0), F.col("ra") + F.col("lead")).otherwise(F.col("ra"))
    b = F.when((F.col("rb") < F.col("n")) & (F.col("tail") > 0), F.col("rb") - F.col("tail")).otherwise(F.col("rb"))
    cut_off = ~F.col("whole") | (F.col("e") - F.col("s") > WINDOW)
    return rows.withColumns({"a": F.when(cut_off, F.col("wa")).otherwise(a), "b": F.when(cut_off, F.col("wb")).otherwise(b)})


def _candidates(rows: DataFrame, key: str) -> DataFrame:
    """Windows (a, b) of near as candidates, with where their words begin and end; those that say nothing are left out, unless their section changed."""
    rows = settled(rows.withColumn("shown", F.substr("near", F.col("a") + 1, F.col("b") - F.col("a"))))
    screened, shown = F.col("reason") != "changed_section", F.col("shown")
    rows = rows.where(~screened | (~_contents(shown) & ~_says_nothing(shown)))
    penalty = screened & holds_any(F.lower(shown), NEEDS_REPEATED) & _any(shown, REPEATED)
    start = F.col("start") + F.col("n0") + F.col("a")
    first = start + F.length("shown") - F.length(F.ltrim("shown"))
    return rows.select(key, "label", "kind", "priority", "item", "reason", "hit", "seq", penalty.cast("int").alias("penalty"), start.cast("long").alias("start"), (start + F.length("shown")).cast("long").alias("stop"), first.cast("long").alias("first"), (first + F.length(F.trim("shown"))).cast("long").alias("last"))


def selected(filings: DataFrame, key: str, text: str, form: str, changed: str | None = None) -> DataFrame:
    """key, family, kept_terms, windows (first, last, label, kind, reason by place), text: evidence of each filing.

    `changed` names a column with the names of sections that changed, whose start is wanted.  The order of choice: no
    boilerplate while there is anything else; the best window of each item or kind first; then by priority of the hit
    and of the section, sections without any hit last, by place.  A window that overlaps a chosen one is passed over,
    and so is a second one for a baseline term outside of all sections.  Six windows stay under the budget of the
    excerpt by themselves.  A filing without windows is of family fallback and has its baseline as text.

    A text is searched once for all material language of its sections and once for all terms of its baseline; from then
    on only what stands near a place travels with it.
    """
    name, key = key, "_key"  # no name of a caller meets one used here
    names = F.coalesce(F.col(changed), F.array().cast("array<string>")) if changed else F.array().cast("array<string>")
    f = filings.select(F.col(name).alias(key), family(F.col(form)).alias("family"), F.coalesce(collapse(F.col(text)), F.lit("")).alias("visible"), F.transform(names, lambda c: F.lower(collapse(c))).alias("changed"))
    f = settled(f).withColumns({"baseline": rp.excerpt_of(rp.keyword_windows(F.col("visible"), UP, DOWN, collapsed=True)), "parts": parts(F.col("visible"), F.col("family"))})
    f = kept(f, "filings")
    s = kept(sections(f, key), "sections")
    every = _candidates(_sentence(_places(s, key).unionByName(_terms(f, key))), key)
    return _chosen(f, every, key).withColumnRenamed(key, name)


_PLACE = ("label", "kind", "priority", "item", "start", "reason", "hit", "seq", "whole", "near", "n0", "q")


def _places(s: DataFrame, key: str) -> DataFrame:
    """Places of material language in sections, the begin of those without any and without boilerplate, and of those that changed."""
    s = s.where(F.col("item").isNotNull() | ~_contents(F.col("body")))
    body, kind = F.col("body"), "array<struct<at:int,seq:int>>"

    def of(at: Column, head: Column) -> Column:
        begins = lambda i: reduce(lambda a, w: a | F.startswith(F.lower(head), F.lit(w)), WORDS[i], F.lit(False))
        says = [begins(i) & head.rlike(f"(?i)^(?:{p})") for i, (p, _, _) in enumerate(MATERIAL)]
        return F.transform(F.array_compact(F.array(*[F.when(x, F.lit(100 + i)) for i, x in enumerate(says)])), lambda n: F.struct(at.alias("at"), n.alias("seq")))

    words = F.flatten(F.transform(cut(body, _WORDS), lambda x: let(F.substr(body, x["start"] + 1, F.lit(64)), lambda head: of(x["start"], head)))).cast(kind)
    over = F.transform(spans(body, f"(?i){MATERIAL[_WIDE][0]}"), lambda x: F.struct(x["start"].alias("at"), F.lit(100 + _WIDE).alias("seq"))).cast(kind)
    # only what the next pattern matches too can begin a match that spans other words; then the whole body is searched for those
    wide = F.exists("hits", lambda x: x["seq"] == 101 + _WIDE) & body.rlike("(?i)effective")
    s = settled(s.withColumn("hits", words))
    s = settled(s.withColumn("hits", F.when(wide, F.concat(F.filter("hits", lambda x: x["seq"] != 100 + _WIDE), over)).otherwise(F.col("hits"))))
    begin = lambda seq, when: F.when(when, F.array(F.struct(F.lit(0).alias("at"), F.lit(seq).alias("seq"))).cast(kind)).otherwise(F.array().cast(kind))
    boilerplate = holds_any(F.lower(body), NEEDS) & _any(body, BOILERPLATE)
    named = F.exists("changed", lambda c: F.contains(F.lower("label"), c))
    events = F.concat("hits", begin(201, (F.size("hits") == 0) & ~boilerplate), begin(200, named))
    r = s.select(key, "label", "kind", "priority", "item", "start", "body", F.explode(events).alias("x")).select("*", "x.at", "x.seq")
    r = r.withColumn("reason", F.when(F.col("seq") == 200, "changed_section").when(F.col("seq") == 201, "relevant_section").otherwise("material_term"))
    of_seq = lambda values, t: F.get(F.array(*[F.lit(v).cast(t) for v in values]), F.col("seq") - 100)
    hit = F.when(F.col("seq") == 200, 0).when(F.col("seq") == 201, 4).otherwise(of_seq([h for _, _, h in MATERIAL], "int"))
    told = F.when(F.col("seq") < 200, of_seq([k if h == 0 else None for _, k, h in MATERIAL], "string"))
    r = r.withColumns({"hit": hit, "kind": F.coalesce(told, "kind"), "whole": F.col("reason") == "material_term"})
    return _framed(r, body, F.col("at"), F.lit(0), F.length("body")).select(key, *_PLACE)


def _terms(f: DataFrame, key: str) -> DataFrame:
    """Places of the baseline's terms in the texts of known forms, each with the section that holds it, or the whole text."""
    terms, kind = (*UP, *DOWN), "array<struct<at:int,seq:int>>"
    kinds = [next((k for p, k, _ in MATERIAL if re.search(p, t, re.IGNORECASE)), None) for t in terms]
    numbered = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("seq")) for i, t in enumerate(terms)])
    mine = settled(f.where("family <> 'fallback' AND baseline <> ''").select(key, "visible", "parts", F.lower("visible").alias("low"), let(F.lower("baseline"), lambda low: F.filter(numbered, lambda x: F.contains(low, x["term"]))).alias("terms")))
    # a plain search finds terms in lower case; where a letter becomes two there (one does), all words of the text are looked at
    plain = F.flatten(F.transform("terms", lambda t: F.transform(literals(F.col("low"), t["term"]), lambda at: F.struct(at.alias("at"), t["seq"].alias("seq"))))).cast(kind)
    each = F.flatten(F.transform("terms", lambda t: F.transform(cut(F.col("visible"), _TERMS), lambda x: F.struct(x["start"].alias("at"), t["seq"].alias("seq"))))).cast(kind)
    places = F.explode(F.when(F.contains("visible", F.lit("\u0130")), each).otherwise(plain)).alias("x")
    found = settled(mine.select(key, "visible", "parts", places).select(key, "visible", "parts", "x.at", "x.seq"))
    word, before = F.substr("visible", F.col("at") + 1, F.lit(24)), F.substr("visible", F.greatest(F.col("at"), F.lit(1)), F.lit(1))
    bare = (F.col("at") == 0) | ~before.rlike(r"\w")
    says = reduce(lambda a, i: F.when(F.col("seq") == i, word.rlike(rf"(?i)^{terms[i]}(?!\w)")).otherwise(a), range(len(terms)), F.lit(False))
    found = settled(found.where(bare & says))
    of_seq = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("seq"))
    p = F.get(F.filter("parts", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["stop"])), F.lit(0))
    found = found.withColumns({"term": of_seq(terms), "term_kind": of_seq(kinds), "p": p})
    h = _framed(found, F.col("visible"), F.col("at"), F.coalesce("p.start", F.lit(0)), F.coalesce("p.stop", F.length("visible")))
    return h.select(
        key,
        F.coalesce("p.k.label", F.concat(F.lit("Retained baseline term: "), F.col("term"))).alias("label"),
        F.coalesce("term_kind", "p.k.kind", F.lit("fallback_keyword")).alias("kind"),
        F.coalesce("p.k.priority", F.lit(0)).alias("priority"),
        F.col("p.k.item").alias("item"),
        F.lit(0).cast("long").alias("start"),
        F.lit("fallback_keyword").alias("reason"),
        F.lit(0).alias("hit"),
        "seq",
        F.lit(True).alias("whole"),
        "near",
        "n0",
        "q",
    )


def _chosen(f: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    clean = F.min("penalty").over(Window.partitionBy(key))
    c = candidates.withColumn("least", clean).where("penalty = 0 OR least > 0").withColumn("late", (F.col("reason") == "relevant_section").cast("int"))
    by = ["penalty", "hit", "priority", "late", "start", "seq"]
    own = F.coalesce("item", F.when(F.col("kind") == "fallback_keyword", F.col("label")).otherwise(F.col("kind")))
    best = F.row_number().over(Window.partitionBy(key, own).orderBy(*by)) == 1
    c = c.withColumn("rest", (~(best & (F.col("penalty") == 0))).cast("int")).withColumn("late", F.col("late") * F.col("rest"))
    ordered = F.array_sort(F.collect_list(F.struct("rest", *by, "stop", "first", "last", "label", "kind", "reason")))
    kind = "array<struct<start:bigint,stop:bigint,first:bigint,last:bigint,label:string,kind:string,reason:string>>"

    def step(acc: Column, x: Column) -> Column:
        again = F.exists(acc, lambda o: (o["reason"] == "fallback_keyword") & (o["label"] == x["label"])) & (x["reason"] == "fallback_keyword")
        meets = F.exists(acc, lambda o: (x["start"] < o["last"]) & (x["stop"] > o["first"]))
        one = F.struct(*[x[n].alias(n) for n in ("start", "stop", "first", "last", "label", "kind", "reason")])
        return F.when((F.size(acc) >= MAX_WINDOWS) | again | meets | (x["first"] >= x["last"]), acc).otherwise(F.array_append(acc, one)).cast(kind)

    w = c.groupBy(F.col(key).alias("k")).agg(F.aggregate(ordered, F.array().cast(kind), step).alias("w"))
    w = w.select("k", F.array_sort(F.transform("w", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["label"].alias("label"), x["kind"].alias("kind"), x["reason"].alias("reason")))).alias("windows"))
    out = f.join(w.hint("shuffle_hash"), F.col(key) == F.col("k"), "left").drop("k")
    some = F.coalesce(F.size("windows") > 0, F.lit(False))
    shown = F.array_join(F.transform("windows", lambda x: F.substr("visible", (x["first"] + 1).cast("int"), (x["last"] - x["first"]).cast("int"))), SEPARATOR)
    out = settled(out.select(key, F.when(some, F.col("family")).otherwise("fallback").alias("family"), F.coalesce("windows", F.array().cast("array<struct<first:bigint,last:bigint,label:string,kind:string,reason:string>>")).alias("windows"), F.when(some, shown).otherwise(F.col("baseline")).alias("text"), "baseline"))
    held = let(F.struct(F.lower("text").alias("a"), F.lower("baseline").alias("b")), lambda x: F.filter(F.array(*[F.lit(t) for t in (*UP, *DOWN)]), lambda t: F.contains(x["a"], t) & F.contains(x["b"], t)))
    return out.select(key, "family", held.alias("kept_terms"), "windows", "text")
