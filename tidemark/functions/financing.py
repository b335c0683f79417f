"""Financing language: evidence windows around signal phrases, and terms that exact phrases state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse, constant, let, settled, spans

# Phrases of each signal, in the order in which signals have the first choice of a window.
SIGNALS = {
    "registration_resale": ("registering the resale shares for resale", "resale by the selling stockholders", "proposed resale or other disposition"),
    "atm_program": ("at-the-market offering", "atm facility", "as sales agent"),
    "offering_capacity": ("maximum aggregate offering price", "aggregate offering price of up to"),
    "actual_sales_disclosed": ("we have sold", "previously sold pursuant to the sales agreement"),
    "public_offering": ("public offering price", "best-efforts basis"),
    "offering_price": ("public offering price of", "offering price per share"),
    "private_placement": ("private placement", "securities purchase agreement"),
    "convertible_debt": ("convertible promissory note", "convertible note"),
    "preferred_equity": ("convertible preferred stock", "preferred shares"),
    "warrant": ("pre-funded warrant", "purchase warrant", "exercise price"),
    "warrant_repricing": ("warrant amendments amend the exercise price", "reduced exercise price period"),
    "exercise_inducement": ("warrant exercise inducement", "inducement letter", "warrants to purchase up to", "comprised of new"),
    "equity_line": ("equity purchase agreement", "right, but not the obligation", "terminated effective as of"),
    "debt_offering": ("aggregate principal amount", "senior notes due"),
    "maturity": ("will mature on", "matures on", "maturity to a date"),
    "proceeds_language": ("gross proceeds", "net proceeds", "will not receive any proceeds"),
    "issuable_securities": ("issuable upon conversion", "issuable upon exercise"),
}
# What one statement of each kind looks like; the groups are its numbers, words and dates, in order.
_N = r"((?:0|[1-9][0-9]{0,2}(?:,[0-9]{3})*)(?:\.[0-9]+)?)"
_DATE = r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})"
PATTERNS = {
    "resale": rf"proposed resale or other disposition.{{0,240}}?of up to {_N} shares",
    "capacity": rf"reduce the maximum aggregate offering price.{{0,180}}?from \${_N} to \${_N}",
    "sales": rf"we have sold {_N} ADSs having an aggregate offering price of approximately \${_N}",
    "offering": rf"\bis offering(?: on a best-efforts basis)? up to {_N} (?:Class [A-Z] )?(?:Ordinary|Common) Shares.{{0,220}}?at a public offering price of \${_N} per (?:Class [A-Z] )?(?:Ordinary|Common) Share",
    "placement": rf"agreed to sell.{{0,180}}?in a private placement.{{0,180}}?an aggregate of {_N} shares.{{0,180}}?at an offering price of \${_N} per Share",
    "placement_gross": rf"gross proceeds of the Private Placement are expected to be approximately \${_N} (million|billion)",
    "note": rf"issued.{{0,120}}?a senior secured convertible promissory note in the original principal amount of \${_N}",
    "note_interest": rf"Convertible Note.{{0,260}}?bears interest at an annual rate of {_N}%",
    "note_maturity": rf"Convertible Note matures on {_DATE}",
    "note_covenant": r"Convertible Note includes (customary affirmative and negative covenants)",
    "preferred": rf"agreed to sell.{{0,120}}?\(i\) {_N} shares of Series A 10% Convertible Preferred Stock for aggregate gross proceeds of \${_N}",
    "warrant": rf"in a concurrent private placement.{{0,120}}?we are issuing unregistered warrants to purchase up to {_N} Common Shares.{{0,160}}?exercise price of \${_N} per share",
    "repricing": rf"previously amended to establish a reduced exercise price period.{{0,180}}?exercise price was amended to \${_N} per Warrant share..{{0,100}}?amend the exercise price to \${_N} per Warrant share",
    "inducement": rf"agreed to exercise the Existing Warrants for cash at a reduced exercise price of \${_N} per share",
    "inducement_shares": rf"new (?:Class [A-Z] )?warrants to purchase up to {_N} shares",
    "inducement_price": rf"exercise price thereof is \${_N} per share",
    "inducement_gross": rf"If all of the Existing Warrants are exercised in full.{{0,140}}?will receive aggregate gross proceeds of approximately \${_N} (million|billion)",
    "equity_line": rf"Equity Purchase Agreement provided the Company the right, but not the obligation, to direct the Investor to purchase up to \${_N}",
    "debt": rf"closed its previously announced notes offering.{{0,80}}?of \${_N} (million|billion) aggregate principal amount of its {_N}% senior notes due ([0-9]{{4}})",
    "debt_maturity": rf"Notes will mature on {_DATE}",
}
# Fixed value: what each pattern cannot do without, in lower case; a text that lacks it is not searched.
NEEDS = {
    "resale": "proposed resale or other disposition",
    "capacity": "reduce the maximum aggregate offering price",
    "sales": " adss having an aggregate offering price of approximately $",
    "offering": "at a public offering price of $",
    "placement": "at an offering price of $",
    "placement_gross": "gross proceeds of the private placement are expected to be approximately $",
    "note": "a senior secured convertible promissory note in the original principal amount of $",
    "note_interest": "bears interest at an annual rate of ",
    "note_maturity": "convertible note matures on ",
    "note_covenant": "convertible note includes customary affirmative and negative covenants",
    "preferred": " shares of series a 10% convertible preferred stock for aggregate gross proceeds of $",
    "warrant": "we are issuing unregistered warrants to purchase up to ",
    "repricing": "previously amended to establish a reduced exercise price period",
    "inducement": "agreed to exercise the existing warrants for cash at a reduced exercise price of $",
    "inducement_shares": "warrants to purchase up to ",
    "inducement_price": "exercise price thereof is $",
    "inducement_gross": "if all of the existing warrants are exercised in full",
    "equity_line": "equity purchase agreement provided the company the right, but not the obligation, to direct the investor to purchase up to $",
    "debt": "closed its previously announced notes offering",
    "debt_maturity": "notes will mature on ",
}
GROUPS = {name: p.replace("(?:", "").replace(r"\(", "").count("(") for name, p in PATTERNS.items()}
NO_PROCEEDS, LINE_ENDED = "will not receive any proceeds", "equity purchase agreement terminated effective as of"
# What the amount of each instrument is.
BASES = {"atm_program": "maximum_aggregate_offering", "pipe": "gross_proceeds", "convertible_debt": "principal", "preferred_equity": "gross_proceeds", "warrant_exercise_inducement": "gross_proceeds", "equity_line": "commitment", "debt": "principal"}
WINDOW, MAX_EXCERPTS, MAX_TOTAL = 720, 16, 8_000


def positions(low: F.Column, phrase: str | F.Column) -> F.Column:
    """Starts (from 0) of all places of a phrase, none overlapping the one before; texts without it are not split."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    quoted = F.concat(F.lit("\\Q"), phrase, F.lit("\\E"))
    return F.when(~F.contains(low, phrase), F.array().cast("array<int>")).otherwise(F.transform(spans(low, quoted), lambda x: x["start"]))


def evidence_windows(text: F.Column) -> F.Column:
    """Windows (start, stop, signals) in text order: whole-word windows around signal phrases.

    The first hit of each signal comes first, in the signals' order, then all hits by place.  A hit whose phrase stands
    in a window that it overlaps joins that window's signals; windows that pass MAX_TOTAL characters are left out.
    Character 0 is the first of the text with its white space collapsed.
    """
    return let(collapse(text), lambda t: let(F.lower(t), lambda low: let(_ordered_hits(low), lambda hits: _chosen(t, low, hits))))


def _ordered_hits(low: F.Column) -> F.Column:
    every = [{"signal": s, "phrases": phrases} for s, phrases in SIGNALS.items()]
    asked = F.filter(constant(every, "array<struct<signal:string,phrases:array<string>>>"), lambda s: F.exists(s["phrases"], lambda p: F.contains(low, p)))
    hit = lambda s, p: lambda at: F.struct(at.alias("at"), s["signal"].alias("signal"), p.alias("phrase"))
    by_signal = F.transform(asked, lambda s: F.array_sort(F.flatten(F.transform(s["phrases"], lambda p: F.transform(positions(low, p), hit(s, p))))))
    heads = lambda s: F.flatten(F.transform(s, lambda h: F.slice(h, 1, 1)))
    return let(by_signal, lambda s: let(heads(s), lambda first: F.concat(first, F.filter(F.array_sort(F.flatten(s)), lambda h: ~F.array_contains(first, h)))))


def _chosen(t: F.Column, low: F.Column, hits: F.Column) -> F.Column:
    return let(F.length(t), lambda n: _within(t, low, hits, n))


def _within(t: F.Column, low: F.Column, hits: F.Column, n: F.Column) -> F.Column:
    kind = "array<struct<start:int,stop:int,signals:array<string>>>"

    def cut(h: F.Column, a: F.Column, b: F.Column) -> F.Column:
        p = h["at"]

        def at_words(w: F.Column) -> F.Column:
            space = F.locate(" ", F.substr(w, F.lit(1), p - a))
            tail = F.locate(" ", F.reverse(F.substr(w, p - a + 1, b - p)))
            return F.struct(
                F.when((a > 0) & (space > 0), a + space).otherwise(a).cast("int").alias("start"),
                F.when((b < n) & (tail > 0) & (b - tail > p), b - tail).otherwise(b).cast("int").alias("stop"),
                h["signal"].alias("signal"),
                h["phrase"].alias("phrase"),
            )

        return let(F.substr(t, a + 1, b - a), at_words)

    def window(h: F.Column) -> F.Column:
        ends = F.struct(F.greatest(F.lit(0), h["at"] - WINDOW // 2).alias("a"), F.least(n, h["at"] + WINDOW // 2).alias("b"))
        return let(ends, lambda e: cut(h, e["a"], e["b"]))

    def step(acc: F.Column, w: F.Column) -> F.Column:
        met = F.filter(F.transform(acc, lambda o, i: F.when((w["start"] < o["stop"]) & (w["stop"] > o["start"]), i)), lambda i: i.isNotNull())

        def settle(at: F.Column) -> F.Column:
            old = F.get(acc, at)
            joins = F.coalesce(F.contains(F.substr(low, old["start"] + 1, old["stop"] - old["start"]), w["phrase"]), F.lit(False))
            merged = F.transform(acc, lambda o, i: F.struct(o["start"].alias("start"), o["stop"].alias("stop"), F.when(i == at, F.array_sort(F.array_distinct(F.array_append(o["signals"], w["signal"])))).otherwise(o["signals"]).alias("signals")))
            used = F.aggregate(acc, F.lit(0), lambda s, o: s + o["stop"] - o["start"])
            added = F.array_append(acc, F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.array(w["signal"]).alias("signals")))
            return F.when(joins, merged).when(used + w["stop"] - w["start"] <= MAX_TOTAL, added).otherwise(acc)

        return F.when(F.size(acc) >= MAX_EXCERPTS, acc).otherwise(let(F.get(met, 0), settle)).cast(kind)

    return F.array_sort(F.aggregate(F.transform(hits, window), F.array().cast(kind), step))


def _number(c: F.Column) -> F.Column:
    return F.regexp_replace(c, ",", "").cast("decimal(24,4)")


def _scaled(number: F.Column, scale: F.Column) -> F.Column:
    return (_number(number) * F.when(F.lower(scale) == "billion", 1_000_000_000).otherwise(1_000_000)).cast("decimal(24,4)")


def terms(excerpts: DataFrame, key: str) -> DataFrame:
    """key, instrument, status, amount and its basis, sale_amount, shares, price, exercise_price, rate, maturity, covenants.

    excerpts: key, text, whose white space is collapsed first.  A statement that two excerpts make with different values is a conflict: the filing then has one
    row of instrument `conflict` and no terms.
    """
    low = F.col("low")
    e = settled(excerpts.select(key, collapse(F.col("text")).alias("text")))
    e = settled(e.select(key, "text", F.lower("text").alias("low")))
    # each statement is found once; its values stand in itself
    said = {n: F.when(F.contains(low, F.lit(NEEDS[n])), F.regexp_extract("text", f"(?i){p}", 0)) for n, p in PATTERNS.items()}
    holds = {s: F.exists(F.array(*[F.lit(x) for x in SIGNALS[s]]), lambda x: F.contains(low, x)) for s in ("atm_program", "public_offering", "offering_price", "private_placement")}
    holds |= {"no_proceeds": F.contains(low, F.lit(NO_PROCEEDS)), "line_ended": F.contains(low, F.lit(LINE_ENDED))}
    e = settled(e.select(key, *[v.alias(k) for k, v in said.items()], *[v.alias(f"has_{k}") for k, v in holds.items()]))
    values = lambda n: F.struct(*[F.regexp_extract(n, f"(?i){PATTERNS[n]}", i).alias(f"g{i}") for i in range(1, GROUPS[n] + 1)])
    e = settled(e.select(key, *[F.when(F.col(n) != "", values(n)).alias(n) for n in PATTERNS], *[f"has_{k}" for k in holds]))
    by = e.groupBy(key).agg(*[F.collect_set(n).alias(n) for n in PATTERNS], *[F.bool_or(f"has_{k}").alias(f"has_{k}") for k in holds])
    got = lambda *names: sum((F.size(n) for n in names), F.lit(0)) == len(names)
    g = lambda name, i: F.get(F.col(name), 0)[f"g{i}"]
    day = lambda c: F.try_to_timestamp(c, F.lit("MMMM d, yyyy")).cast("date")
    kinds = {"amount": "decimal(24,4)", "shares": "decimal(24,4)", "price": "decimal(24,4)", "exercise_price": "decimal(24,4)", "rate": "decimal(24,4)", "maturity": "date", "sale_amount": "decimal(24,4)", "basis": "string", "covenants": "string"}

    def term(when: F.Column, instrument: str, status: str, **values: F.Column) -> F.Column:
        if "amount" in values:
            values["basis"] = F.when(values["amount"].isNotNull(), F.lit(BASES[instrument]))
        fields = [values.get(f, F.lit(None)).cast(k).alias(f) for f, k in kinds.items()]
        return F.when(when, F.struct(F.lit(instrument).alias("instrument"), F.lit(status).alias("status"), *fields))

    debt_ends = F.endswith(g("debt_maturity", 1), g("debt", 4))
    parts = [
        term(got("resale") & F.col("has_no_proceeds"), "resale_registration", "registered", shares=_number(g("resale", 1))),
        term(got("capacity") & F.col("has_atm_program"), "atm_program", "amended", amount=_number(g("capacity", 2)), shares=_number(g("sales", 1)), sale_amount=_number(g("sales", 2))),
        term(got("offering") & F.col("has_public_offering") & F.col("has_offering_price"), "public_offering", "priced", shares=_number(g("offering", 1)), price=_number(g("offering", 2))),
        term(got("placement") & F.col("has_private_placement"), "pipe", "priced", shares=_number(g("placement", 1)), price=_number(g("placement", 2)), amount=_scaled(g("placement_gross", 1), g("placement_gross", 2))),
        term(got("note"), "convertible_debt", "closed", amount=_number(g("note", 1)), rate=_number(g("note_interest", 1)), maturity=day(g("note_maturity", 1)), covenants=g("note_covenant", 1)),
        term(got("preferred"), "preferred_equity", "proposed", shares=_number(g("preferred", 1)), amount=_number(g("preferred", 2))),
        term(got("warrant"), "warrant", "priced", shares=_number(g("warrant", 1)), exercise_price=_number(g("warrant", 2))),
        term(got("repricing"), "warrant_repricing", "amended", price=_number(g("repricing", 1)), exercise_price=_number(g("repricing", 2))),
        term(got("inducement", "inducement_shares", "inducement_price"), "warrant_exercise_inducement", "proposed", shares=_number(g("inducement_shares", 1)), price=_number(g("inducement", 1)), exercise_price=_number(g("inducement_price", 1)), amount=_scaled(g("inducement_gross", 1), g("inducement_gross", 2))),
        term(got("equity_line") & F.col("has_line_ended"), "equity_line", "terminated", amount=_number(g("equity_line", 1))),
        term(got("debt", "debt_maturity"), "debt", "closed", amount=_scaled(g("debt", 1), g("debt", 2)), rate=_number(g("debt", 3)), maturity=day(g("debt_maturity", 1))),
    ]
    conflict = F.exists(F.array(*[F.size(n) for n in PATTERNS]), lambda n: n > 1) | F.coalesce(got("debt", "debt_maturity") & ~debt_ends, F.lit(False))
    every = F.when(conflict, F.array(term(F.lit(True), "conflict", "conflict"))).otherwise(F.array_compact(F.array(*parts)))
    return by.select(key, F.inline(every))
