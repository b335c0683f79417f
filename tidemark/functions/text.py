"""Text expressions: all built-in functions, so that they stay inside generated code."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never visible, and named entities.
HIDDEN = ("script", "style", "svg", "head")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
RUN = 128
MARK = "\x01"


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: what is computed before it is computed once, not written out again where it is used."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def constant(value: object, kind: str) -> F.Column:
    """A fixed list or map of plain values as one literal of a type, not as an expression an item."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def collapse(c: F.Column) -> F.Column:
    """Each run of white space as one space, none around; single spaces are matched by nothing, so most of a text is passed over."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f](?:(?<=[\t\n\r\f])|(?=[ \t\n\r\f]))[ \t\n\r\f]*+", " "))


def spans(source: F.Column, pattern: str | F.Column, length: Callable[[F.Column], F.Column] = F.length) -> F.Column:
    """(start, stop) from 0 of all matches of a pattern, in order, as their lengths and those of what lies between sum up to."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.zip_with(F.split(source, pattern), F.regexp_extract_all(source, pattern, F.lit(0)), lambda gap, m: F.struct(length(gap).alias("gap"), length(m).alias("n")))
    return let(F.filter(found, lambda x: x["n"].isNotNull()), lambda f: let(_runs(f), _joined))


def cut(source: F.Column, pattern: str) -> F.Column:
    """(start, stop, text) of the pieces of a text: each but the first begins at a match of a pattern, which begins nowhere else inside a match.

    One search finds the places, as cutting at a mark takes none; a text that holds the mark itself is cut without it.
    """
    marked = F.split(F.regexp_replace(source, pattern, f"{MARK}$0"), MARK)
    parts = F.when(F.contains(source, F.lit(MARK)), F.split(source, f"(?={pattern})")).otherwise(marked)
    gap = lambda x: F.struct(F.lit(0).alias("gap"), F.length(x).alias("n"))
    return let(parts, lambda p: F.zip_with(p, let(F.transform(p, gap), lambda f: let(_runs(f), _joined)), lambda x, s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), x.alias("text"))))


def literals(source: F.Column, phrase: F.Column) -> F.Column:
    """Starts of a plain phrase of letters and spaces that does not overlap itself, in order."""
    gaps = F.transform(F.split(source, phrase), lambda x: F.struct(F.length(x).alias("gap"), F.length(phrase).alias("n")))
    return let(let(gaps, lambda f: let(_runs(f), _joined)), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x["start"]))


def one_of(phrases: Sequence[str]) -> str:
    """A pattern for plain phrases; those of one first letter stand together, so that most places are left after a letter."""
    return "(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(re.escape(p[1:]) for p in phrases if p[0] == c)})" for c in sorted({p[0] for p in phrases})) + ")"


def holds_any(low: F.Column, phrases: Sequence[str]) -> F.Column:
    return reduce(lambda a, p: a | F.contains(low, F.lit(p)), phrases, F.lit(False))


def _runs(found: F.Column) -> F.Column:
    """Matches within each run of RUN, counted from the run's own begin, and the run's whole length.

    Adding an item to a list copies it, so lists grow item by item only within a run, and run by run between them.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(a: F.Column, x: F.Column) -> F.Column:
        one = F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("stop"))
        return F.struct(one["stop"].alias("at"), F.array_append(a["out"], one).alias("out")).cast("struct<at:int,out:array<struct<start:int,stop:int>>>")

    last = F.greatest(F.lit(0), F.ceil(F.size(found) / RUN).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.aggregate(F.slice(found, r * RUN + 1, F.lit(RUN)), start, step))


def _joined(runs: F.Column) -> F.Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = F.aggregate(runs, start, lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    return F.flatten(F.zip_with(runs, begins, lambda r, b: F.transform(r["out"], lambda x: F.struct((x["start"] + b).alias("start"), (x["stop"] + b).alias("stop")))))


def fold(c: F.Column) -> F.Column:
    """Lower case with single spaces: what text comparisons use."""
    return F.lower(collapse(c))


def visible_text(html: F.Column, hidden: Sequence[str] = HIDDEN) -> F.Column:
    """Text of a page without the hidden elements, comments and tags, entities read, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in hidden:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def headings(html: F.Column) -> F.Column:
    """Heading elements of levels 1 to 3, with their tags."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>.*?</h[1-3]>"), 0)


def term_hits(c: F.Column, terms: Sequence[str]) -> F.Column:
    """Terms that occur, in the order of the list."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))


def without_quotes(c: F.Column, quotes: F.Column) -> F.Column:
    return F.aggregate(quotes, c, lambda t, q: F.replace(t, q, F.lit(" ")))


def token_estimate(c: F.Column) -> F.Column:
    return F.floor((F.length(c) + 3) / 4)


def name_key(c: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def amount(c: F.Column) -> F.Column:
    """First number of a text with its thousands separators and unit, as a decimal value; null without one."""
    number = F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    scale = F.when(F.lower(c).contains("million"), 1e6).when(F.lower(c).contains("billion"), 1e9).otherwise(1.0)
    return F.when(number != "", F.regexp_replace(number, ",", "").cast("double") * scale)


def only_match(matches: F.Column) -> F.Column:
    """The match if all agree, else null: conflicting matches are refused."""
    distinct = F.array_distinct(matches)
    return F.when(F.size(distinct) == 1, F.element_at(distinct, 1))


def canonical_url(c: F.Column) -> F.Column:
    """Scheme and host in lower case, without fragment, query, port 80 or closing slash."""
    bare = F.regexp_replace(c, r"[?#].*$", "")
    parts = F.regexp_extract(bare, r"^([a-zA-Z]+://[^/]*)", 1)
    host = F.regexp_replace(F.lower(parts), r":80$", "")
    return F.regexp_replace(F.concat(host, F.substr(bare, F.length(parts) + 1)), r"/+$", "")


def words(c: F.Column) -> F.Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 0)


def overlap(a: F.Column, b: F.Column) -> F.Column:
    """Distinct words that both texts have."""
    return F.size(F.array_intersect(words(a), words(b)))


def supported(claim: F.Column, evidence: F.Column) -> F.Column:
    """Whether the evidence holds a quarter of the claim's distinct words, and two at least."""
    return overlap(claim, evidence) >= F.greatest(F.lit(2), F.ceil(F.size(F.array_distinct(words(claim))) / 4))


def normalized_list(c: F.Column) -> F.Column:
    """Entries trimmed, in lower case, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))))


def excerpt(c: F.Column, terms: Sequence[str], width: int) -> tuple[F.Column, F.Column]:
    """`width` characters from the first listed term that occurs, else from the start; and whether a term occurred."""
    low, at, aware = F.lower(c), F.lit(1), F.lit(False)
    for t in reversed(terms):
        hit = F.contains(low, F.lit(t))
        at, aware = F.when(hit, F.locate(t, low)).otherwise(at), hit | aware
    return F.substr(c, at, F.lit(width)), aware


def holds_number(c: F.Column, number: str) -> F.Column:
    """Whether a number stands in a text as a whole, thousands separators aside."""
    return F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3})", "").rlike(rf"(?<![0-9.]){number}(?![0-9]|\.[0-9])")


def submissions(df: DataFrame, value: str, allowed: Sequence[str]) -> DataFrame:
    """df with status and dedupe_key of JSON submissions (ticker, cik, hypothesis, urls); only allowed fields may stand in one."""
    unknown = F.size(F.array_except(F.json_object_keys(value), F.array(*[F.lit(a) for a in allowed]))) > 0
    x = F.from_json(value, "ticker string, cik string, hypothesis string, urls array<string>")
    idea = fold(x["hypothesis"])
    status = F.when(unknown, "unknown_field").when(idea == "", "empty_hypothesis").otherwise("accepted")
    key = F.sha2(F.concat_ws("\n", F.upper(x["ticker"]), F.lpad(x["cik"], 10, "0"), idea, F.array_join(F.array_sort(F.array_distinct(x["urls"])), "\n")), 256)
    return df.withColumn("status", status).withColumn("dedupe_key", F.when(F.col("status") == "accepted", key))
