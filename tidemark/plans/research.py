"""Registered queries on facts, scores and outcomes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import facts as fa
from tidemark.operators import outcomes as oc
from tidemark.operators import scoring as sc
from tidemark.tables import FACTS, facts, table

CUT = "2001-01-01"
_WIDE = f"{FACTS}, wide AS (SELECT issuer, period_end, " + ", ".join(f"max(cents) FILTER (concept = '{c}') AS {c}" for c in ("assets", "liabilities", "revenue", "income", "equity")) + f" FROM facts WHERE available_at <= DATE '{CUT}' AND period_end <= DATE '{CUT}' GROUP BY 1, 2)"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _ratio_sql(name: str, n: str, d: str) -> str:
    return f"WITH {_WIDE} SELECT issuer, period_end, '{name}' AS metric, CASE WHEN {n} IS NOT NULL AND {d} > 0 THEN round({n} / {d}::DOUBLE, 6) END AS value, CASE WHEN {n} IS NULL OR {d} IS NULL THEN 'missing_fact' WHEN {d} <= 0 THEN 'non_positive_denominator' ELSE 'ok' END AS status FROM wide"


def _ratio_query(name: str, n: str, d: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _round(fa.ratio(fa.pivoted(facts(spark, sf), CUT), name, n, d), "value")

    return run


for _id, _name, _n, _d in (("F01_current_ratio", "current_ratio", "assets", "liabilities"), ("F02_debt_to_equity", "debt_to_equity", "liabilities", "equity"), ("F03_net_margin", "net_margin", "income", "revenue"), ("F04_asset_turnover", "asset_turnover", "revenue", "assets")):
    register(_id, _ratio_sql(_name, _n, _d))(_ratio_query(_name, _n, _d))


@register("F00_fact_guards", f"WITH {FACTS} SELECT CASE WHEN available_at > DATE '{CUT}' THEN 'not_yet_available' WHEN period_end > DATE '{CUT}' THEN 'after_cutoff' WHEN cents <= 0 THEN 'non_positive' ELSE 'ok' END AS guard, count(*) AS n FROM facts GROUP BY 1")
def f00(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit(CUT).cast("date")
    guard = sc.first_true([("not_yet_available", F.col("available_at") > at), ("after_cutoff", F.col("period_end") > at), ("non_positive", F.col("cents") <= 0)], "ok")
    return facts(spark, sf).groupBy(guard.alias("guard")).agg(F.count("*").alias("n"))


@register("F05_return_on_equity", f"WITH {_WIDE} SELECT w.issuer, w.period_end, CASE WHEN w.income IS NOT NULL AND b.equity + w.equity > 0 THEN round(w.income / ((b.equity + w.equity) / 2::DOUBLE), 6) END AS value, CASE WHEN w.income IS NULL OR b.equity IS NULL OR w.equity IS NULL THEN 'missing_fact' WHEN b.equity + w.equity <= 0 THEN 'non_positive_denominator' ELSE 'ok' END AS status FROM wide w LEFT JOIN wide b ON b.issuer = w.issuer AND last_day((b.period_end + INTERVAL 3 MONTH)::DATE) = w.period_end")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    return _round(fa.return_on_equity(fa.pivoted(facts(spark, sf), CUT)), "value")


def _growth_sql(months: int, value: str) -> str:
    return f"WITH {FACTS}, f AS (SELECT * FROM facts WHERE concept = 'revenue') SELECT a.issuer, a.period_end, CASE WHEN b.cents > 0 THEN round({value}, 6) END AS value, CASE WHEN b.cents IS NULL THEN 'no_prior' WHEN b.cents <= 0 THEN 'non_positive_prior' ELSE 'ok' END AS status FROM f a LEFT JOIN f b ON a.issuer = b.issuer AND last_day((b.period_end + INTERVAL {months} MONTH)::DATE) = a.period_end"


@register("F06_period_growth", _growth_sql(3, "a.cents / b.cents::DOUBLE - 1"))
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return _round(fa.growth(facts(spark, sf), "revenue", 3), "value")


@register("F07_compound_growth", _growth_sql(24, "pow(a.cents / b.cents::DOUBLE, 0.5) - 1"))
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return _round(fa.compound_growth(facts(spark, sf), "revenue", 2), "value")


@register("F08_valuation", f"WITH {FACTS}, p AS (SELECT o_custkey % 100 AS issuer, o_orderdate::DATE AS day, max(round(o_totalprice * 100)::BIGINT) AS price FROM orders GROUP BY 1, 2), j AS (SELECT p.*, cents, row_number() OVER (PARTITION BY p.issuer, day ORDER BY period_end DESC) AS r FROM p JOIN facts f ON f.issuer = p.issuer AND concept = 'income' AND period_end <= day AND available_at <= day) SELECT issuer, day, CASE WHEN cents > 0 THEN round(price / cents::DOUBLE, 6) END AS value FROM j WHERE r = 1")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    prices = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("issuer"), F.to_date("o_orderdate").alias("day")).agg(F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("price"))
    return _round(fa.valuation(prices, facts(spark, sf), "income"), "value")


@register("F09_claim_verdict", "SELECT o_orderkey, CASE WHEN s IS NULL THEN 'unverifiable' WHEN abs(o - s) <= 20000000 THEN 'verified' ELSE 'conflicting' END AS verdict FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS o FROM orders) LEFT JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("s"))
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("o"))
    return o.join(s, "o_orderkey", "left").select("o_orderkey", fa.claim_verdict(F.col("o"), F.col("s"), 20_000_000).alias("verdict"))


@register("F10_claim_against_values", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'fallback' WHEN n = 1 THEN CASE WHEN hit THEN 'verified' ELSE 'conflicting' END WHEN hit THEN 'partially_verified' ELSE 'unverifiable' END AS verdict FROM (SELECT o_orderkey, count(DISTINCT l_quantity) AS n, bool_or(abs(l_quantity - o_orderkey % 50) <= 1) AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_quantity").alias("v"))
    empty = F.array().cast("array<double>")
    return table(spark, sf, "orders").select("o_orderkey").join(v, "o_orderkey", "left").select("o_orderkey", fa.claim_against_values((F.col("o_orderkey") % 50).cast("double"), F.coalesce("v", empty), 1.0).alias("verdict"))


@register("F11_numeric_literals", r"WITH t AS (SELECT conv_id, turn, text || ' ' || (conv_id * 7) || ' of ' || (turn * 1.5) AS said FROM conversations), f AS (SELECT a.conv_id, a.turn, b.said AS quote, unnest(list_slice(regexp_extract_all(a.said, '[0-9]+(\.[0-9]+)?'), 1, 24)) AS x FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1) SELECT conv_id, turn, count(*) AS literals, count(*) FILTER (contains(quote, x)) AS supported FROM f GROUP BY 1, 2")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    """Literals of a turn (24 at most, as the rule has it) against the whole turn that it answers."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", (F.col("conv_id") * 7).cast("string"), F.lit("of"), (F.col("turn") * F.lit(1.5).cast("decimal(2,1)")).cast("string")).alias("said"))
    quotes = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("quote"))
    f = t.join(quotes, ["conv_id", "turn"]).select("conv_id", "turn", "quote", F.explode(fa.literals(F.col("said"))).alias("x"))
    return f.groupBy("conv_id", "turn").agg(F.count("*").alias("literals"), F.count_if(F.contains("quote", F.col("x"))).alias("supported"))


@register("F12_liquidity_pair", f"WITH {FACTS}, b AS (SELECT issuer, period_end, max(n_sources) FILTER (concept = 'assets') AS na, max(cents) FILTER (concept = 'assets') AS va, max(n_sources) FILTER (concept = 'liabilities') AS nl, max(cents) FILTER (concept = 'liabilities') AS vl FROM facts WHERE available_at <= DATE '{CUT}' AND concept IN ('assets', 'liabilities') GROUP BY 1, 2) SELECT issuer, period_end, CASE WHEN na IS NULL OR nl IS NULL THEN 'incomplete' WHEN na > 1 OR nl > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN na = 1 AND nl = 1 THEN (va - vl)::BIGINT END AS margin_cents FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY period_end DESC) AS r FROM b) WHERE r = 1")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return fa.liquidity_pair(facts(spark, sf), CUT)


_CASES = """cases AS (SELECT o_orderkey, ['strong', 'speculative', 'weak', 'insufficient', 'weak'][left(o_orderpriority, 1)::INTEGER] AS label, o_orderstatus AS origin,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'tuning' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'held_out' END AS split, net / gross::DOUBLE - 1 AS asset_return,
  (o_orderkey % 21 - 10) / 1000.0::DOUBLE AS benchmark_return FROM orders LEFT JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS gross,
  sum(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100)::BIGINT)::BIGINT AS net FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey), ev AS (SELECT *, asset_return - benchmark_return - 0.002::DOUBLE AS net_relative FROM cases)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    cents = lambda e: F.sum(F.round(F.expr(e)).cast("long"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(cents("l_extendedprice * 100").alias("gross"), cents("l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100").alias("net"))
    d = F.col("o_orderdate")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    label = F.element_at(F.array(*[F.lit(x) for x in ("strong", "speculative", "weak", "insufficient", "weak")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    split = F.when(d < day("1998-01-01"), "tuning").when(d < day("2000-01-01"), "validation").otherwise("held_out")
    o = table(spark, sf, "orders").join(li, "o_orderkey", "left")
    return o.select("o_orderkey", label.alias("label"), F.col("o_orderstatus").alias("origin"), split.alias("split"), (F.col("net") / F.col("gross") - 1).alias("asset_return"), ((F.col("o_orderkey") % 21 - 10) / F.lit(1000.0)).alias("benchmark_return"))


@register("A19_case_evaluation", f"WITH {_CASES} SELECT o_orderkey, round(net_relative, 6) AS net_relative, CASE WHEN net_relative IS NULL THEN 'unavailable' WHEN label = 'insufficient' THEN 'not_rated' WHEN label IN ('strong', 'speculative') AND net_relative > 0 THEN 'true_positive' WHEN label IN ('strong', 'speculative') THEN 'false_positive' WHEN net_relative > 0 THEN 'missed' ELSE 'true_negative' END AS error FROM ev")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return _round(oc.evaluate(_cases(spark, sf), 0.002).select("o_orderkey", "net_relative", "error"), "net_relative")


def _wilson_sql(h: str, n: str) -> str:
    z = repr(oc.Z)
    p, n = f"({h} / {n}::DOUBLE)", f"({n}::DOUBLE)"
    half = f"{z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n})"
    ends = [f"({p} + {z} * {z} / (2 * {n}) {s} {half}) / (1 + {z} * {z} / {n})" for s in "-+"]
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {ends[0]}), 6) END AS low, CASE WHEN {n} > 0 THEN round(least(1.0, {ends[1]}), 6) END AS high"


@register("A20_label_calibration", f"WITH {_CASES}, l AS (SELECT unnest(['strong', 'speculative', 'weak', 'insufficient', 'unclassified']) AS label), c AS (SELECT l.label, count(net_relative) AS n, count(*) FILTER (net_relative > 0) AS favorable FROM l LEFT JOIN ev ON ev.label = l.label GROUP BY 1) SELECT label, n, favorable, CASE WHEN n > 0 THEN round(favorable / n::DOUBLE, 6) END AS rate, {_wilson_sql('favorable', 'n')} FROM c")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    done = oc.evaluate(_cases(spark, sf), 0.002)
    return _round(oc.calibration(done, ("strong", "speculative", "weak", "insufficient", "unclassified")), "rate", "low", "high")


@register("A21_wilson_interval", f"SELECT h, n, {_wilson_sql('h', 'n')} FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS h, count(*) AS n FROM events GROUP BY 1)")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("h"), F.count("*").alias("n"))
    low, high = oc.wilson(F.col("h"), F.col("n"))
    return _round(e.select("h", "n", low.alias("low"), high.alias("high")), "low", "high")


@register("A22_sample_size", "SELECT 194::BIGINT AS n")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    """Trials to tell a rate near one half apart to 7.04 points."""
    return spark.range(1).select(F.lit(oc.sample_size(0.5, 0.0704)).cast("long").alias("n"))


@register("A23_forward_report", f"WITH {_CASES} SELECT origin, count(*) AS n, count(net_relative) AS completed, CASE WHEN origin = 'F' THEN round(sum(round(net_relative * 1000000)::BIGINT)::BIGINT / (1000000.0::DOUBLE * count(net_relative)), 6) END AS forward_mean, count(net_relative) >= 30 AS descriptive_only FROM ev GROUP BY 1")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    done = oc.evaluate(_cases(spark, sf), 0.002)
    micro = F.sum(F.round(F.col("net_relative") * 1_000_000).cast("long"))
    out = done.groupBy("origin").agg(F.count("*").alias("n"), F.count("net_relative").alias("completed"), micro.alias("micro"))
    return out.select("origin", "n", "completed", F.when(F.col("origin") == "F", F.round(F.col("micro") / (F.lit(1_000_000.0) * F.col("completed")), 6)).alias("forward_mean"), (F.col("completed") >= 30).alias("descriptive_only"))


@register("A24_stratified_report", f"WITH {_CASES}, s AS (SELECT label, origin, split, count(net_relative) AS completed, count(*) FILTER (net_relative IS NULL) AS unavailable, count(*) FILTER (net_relative > 0) AS favorable FROM ev GROUP BY GROUPING SETS ((label, origin, split), ())) SELECT *, CASE WHEN completed > 0 THEN round(favorable / completed::DOUBLE, 6) END AS rate, {_wilson_sql('favorable', 'completed')} FROM s")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return _round(oc.strata(oc.evaluate(_cases(spark, sf), 0.002), ["label", "origin", "split"]), "rate", "low", "high")


@register("A25_population_coverage", "SELECT o_orderpriority, count(*) FILTER (n > 0) AS terminal, count(*) FILTER (n = 0 AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '2001-06-01') AS not_yet_due, count(*) FILTER (n = 0 AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '2001-06-01') AS due_without_outcome FROM (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders o) GROUP BY 1")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(n, "o_orderkey", "left")
    status = oc.job_status(F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"), F.lit("2001-06-01").cast("timestamp_ntz"), F.col("n").isNotNull())
    return o.groupBy("o_orderpriority").agg(*[F.count_if(status == s).alias(a) for s, a in (("completed", "terminal"), ("not_due", "not_yet_due"), ("ready", "due_without_outcome"))])


@register("A26_hashed_cohorts", """SELECT sha256('{"label":"' || label || '","split":"' || split || '"}') AS cohort, count(*) AS n FROM (WITH """ + _CASES + " SELECT * FROM ev) GROUP BY 1")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).groupBy(F.sha2(F.to_json(F.struct("label", "split")), 256).alias("cohort")).agg(F.count("*").alias("n"))


@register("R18_outcome_assessment", f"WITH {_CASES} SELECT o_orderkey, CASE WHEN net_relative IS NULL THEN 'unavailable' WHEN net_relative > 0.02 THEN 'outperformed' WHEN net_relative < -0.02 THEN 'underperformed' ELSE 'in_line' END AS assessment FROM ev")
def r18(spark: SparkSession, sf: str) -> DataFrame:
    return oc.evaluate(_cases(spark, sf), 0.002).select("o_orderkey", oc.assessed(F.col("net_relative"), 0.02).alias("assessment"))


@register("R19_job_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '2000-06-01' THEN 'ready' ELSE 'not_due' END AS status FROM orders")
def r19(spark: SparkSession, sf: str) -> DataFrame:
    due = F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")
    return table(spark, sf, "orders").select("o_orderkey", oc.job_status(due, F.lit("2000-06-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "F").alias("status"))


@register("R20_missing_names", "SELECT l_orderkey, concat_ws(',', CASE WHEN NOT bool_or(l_linenumber = 1) THEN 'asset_start' END, CASE WHEN NOT bool_or(l_linenumber = 2) THEN 'asset_end' END, CASE WHEN NOT bool_or(l_linenumber = 3) THEN 'benchmark_start' END, CASE WHEN NOT bool_or(l_linenumber = 4) THEN 'benchmark_end' END) AS missing FROM lineitem GROUP BY 1")
def r20(spark: SparkSession, sf: str) -> DataFrame:
    names = ("asset_start", "asset_end", "benchmark_start", "benchmark_end")
    gone = F.array_compact(F.array(*[F.when(~F.bool_or(F.col("l_linenumber") == i), F.lit(x)) for i, x in enumerate(names, 1)]))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(gone, ",").alias("missing"))


@register("R21_changed_fields", "SELECT event_id, concat_ws(',', CASE WHEN a IS DISTINCT FROM event_type THEN 'event_type' END, CASE WHEN b IS DISTINCT FROM k THEN 'k' END, CASE WHEN c IS DISTINCT FROM d THEN 'day' END) AS reasons FROM (SELECT *, lag(event_type) OVER w AS a, lag(k) OVER w AS b, lag(d) OVER w AS c FROM (SELECT *, props ->> '$.k' AS k, ts::DATE AS d FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def r21(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("*", F.get_json_object("props", "$.k").alias("k"), F.to_date("ts").alias("day"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumns({f"old_{c}": F.lag(c).over(w) for c in ("event_type", "k", "day")})
    names = ("event_type", "k", "day")
    return e.select("event_id", F.array_join(sc.changed_fields({c: F.col(f"old_{c}") for c in names}, {c: F.col(c) for c in names}), ",").alias("reasons"))


@register("R24_retry_delay", "SELECT l_linenumber, CASE WHEN l_linenumber < 6 THEN least(86400, 300 * pow(2, l_linenumber - 1))::BIGINT END AS delay, count(*) AS n FROM lineitem GROUP BY 1")
def r24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n")).select("l_linenumber", oc.retry_delay(F.col("l_linenumber")).alias("delay"), "n")


@register("R09_compute_tier", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'skip' WHEN length(text) > 8000 THEN 'large' WHEN lang <> 'en' THEN 'translate' WHEN length(text) > 1000 THEN 'standard' ELSE 'small' END AS tier FROM documents")
def r09(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "documents").select("doc_id", sc.first_true([("skip", n == 0), ("large", n > 8000), ("translate", F.col("lang") != "en"), ("standard", n > 1000)], "small").alias("tier"))


@register("R11_transition", "SELECT o_orderkey, CASE WHEN b IS NULL THEN 'initial' WHEN b = o_orderstatus THEN 'unchanged' ELSE b || '_to_' || o_orderstatus END AS transition FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)")
def r11(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    b = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    now = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", now, b.alias("b")).select("o_orderkey", F.when(F.col("b").isNull(), "initial").when(F.col("b") == now, "unchanged").otherwise(F.concat("b", F.lit("_to_"), now)).alias("transition"))


@register("R25_quality_grade", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'A' WHEN source IN ('src2', 'src3', 'src4') THEN 'B' ELSE 'C' END AS grade FROM documents")
def r25(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source")
    return table(spark, sf, "documents").select("doc_id", sc.first_true([("A", s.isin("src0", "src1")), ("B", s.isin("src2", "src3", "src4"))], "C").alias("grade"))


@register("V10_totals_reconcile", f"WITH {_CASES} SELECT *, total = strata_total AS reconciles FROM (SELECT (SELECT count(*) FROM ev) AS total, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM ev GROUP BY label, origin, split)) AS strata_total)")
def v10(spark: SparkSession, sf: str) -> DataFrame:
    s = oc.strata(oc.evaluate(_cases(spark, sf), 0.002), ["label", "origin", "split"]).withColumn("n", F.col("completed") + F.col("unavailable"))
    whole = F.col("label").isNull()
    out = s.agg(F.sum(F.when(whole, F.col("n"))).alias("total"), F.sum(F.when(~whole, F.col("n"))).alias("strata_total"))
    return out.withColumn("reconciles", F.col("total") == F.col("strata_total"))
