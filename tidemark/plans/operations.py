"""Registered queries on state, validation and the remaining read models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import scoring as sc
from tidemark.operators.pit import known_by
from tidemark.streaming import stateful as st
from tidemark.tables import BARS, bars, table, table_stream

NOW = "2024-01-30 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@register("P01_point_in_time", f"WITH {BARS} SELECT instrument_id, count(*) AS n FROM bars WHERE available_at <= TIMESTAMP '1998-06-01' AND retrieved_at <= TIMESTAMP '1998-06-01' GROUP BY 1")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).where(known_by("1998-06-01")).groupBy("instrument_id").agg(F.count("*").alias("n"))


@register("P03_three_times", f"WITH {BARS} SELECT instrument_id, session_date, close FROM bars WHERE instrument_id = 5 AND session_date::TIMESTAMP <= TIMESTAMP '1998-06-01' AND available_at <= TIMESTAMP '1998-06-01' AND retrieved_at <= TIMESTAMP '1998-06-01' ORDER BY session_date DESC LIMIT 1")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    at = bars(spark, sf).where("instrument_id = 5").withColumn("published_at", F.col("session_date").cast("timestamp_ntz"))
    return at.where(known_by("1998-06-01", "published_at", "available_at", "retrieved_at")).orderBy(F.desc("session_date")).limit(1).select("instrument_id", "session_date", "close")


@register("P10_public_projection", "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate::DATE AS day FROM orders")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"))


@register("P12_case_by_pattern", "SELECT page_id, CASE WHEN regexp_matches(url, '^https://m\\.') THEN 'mobile' WHEN regexp_matches(url, '\\?') THEN 'query' WHEN regexp_matches(url, '#') THEN 'fragment' ELSE 'plain' END AS kind FROM pages")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", sc.first_true([("mobile", u.rlike(r"^https://m\.")), ("query", u.rlike(r"\?")), ("fragment", u.rlike("#"))], "plain").alias("kind"))


@register("J10_lateral_window_aggregate", f"SELECT hours, user_id % 5 AS shard, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM (SELECT unnest([24, 48, 168])::INTEGER AS hours) w JOIN events ON ts >= TIMESTAMP '{NOW}' - to_hours(hours) AND ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    """Each event once, with the list of windows that hold it: no inequality join."""
    at = F.lit(NOW).cast("timestamp_ntz")
    inside = F.array_compact(F.array(*[F.when(F.col("ts") >= at - F.expr(f"INTERVAL {h} HOUR"), F.lit(h)) for h in (24, 48, 168)]))
    e = _events(spark, sf).where((F.col("ts") <= at) & (F.col("ts") >= at - F.expr("INTERVAL 168 HOUR")))
    return e.select("user_id", "value", F.explode(inside).alias("hours")).groupBy("hours", (F.col("user_id") % 5).alias("shard")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@register("J11_values_cross_bounds", "SELECT hours, last - to_hours(hours) AS start, n FROM (SELECT unnest([24, 48, 168])::INTEGER AS hours), (SELECT max(ts) AS last, count(*) AS n FROM events)")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    state = _events(spark, sf).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return state.select(F.explode(F.array(F.lit(24), F.lit(48), F.lit(168))).alias("hours"), "last", "n").select("hours", (F.col("last") - F.expr("make_dt_interval(0, hours)")).alias("start"), "n")


@register("J12_range_join", f"SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAY GROUP BY 1")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.where(F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@register("J17_optional_key_join", "SELECT o_orderkey, count(DISTINCT l_quantity) AS n_values FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND (o_orderstatus <> 'P' OR l_returnflag = 'R') GROUP BY 1")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    fits = (F.col("o_orderstatus") != "P") | (F.col("l_returnflag") == "R")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(F.countDistinct(F.when(fits, F.col("l_quantity"))).alias("n_values"))


@register("J19_unfinished_polls", "SELECT a.event_type, count(*) AS n, count(*) FILTER (b.event_id IS NULL) AS unfinished FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 AND b.event_type = 'purchase' GROUP BY 1")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    done = _events(spark, sf).where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("event_id"), F.lit(True).alias("done"))
    return _events(spark, sf).join(done, "event_id", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("done").isNull()).alias("unfinished"))


@register("J21_first_match", "SELECT n_nationkey, arg_min(c_custkey, c_custkey) AS first_customer FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("first_customer"))
    return table(spark, sf, "nation").select("n_nationkey").join(c, "n_nationkey", "left")


@register("M01_nonempty_lists", "SELECT count(*) AS n FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) > 0")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)) > 0).agg(F.count("*").alias("n"))


@register("M05_sorted_unique", "SELECT p_partkey, ws = list_sort(list_distinct(ws)) AS sorted_unique FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", (w == F.array_sort(F.array_distinct(w))).alias("sorted_unique"))


@register("C04_origin", "SELECT event_id, CASE WHEN ts < date_trunc('day', ts) + INTERVAL 16 HOUR THEN 'forward' ELSE 'retrospective' END AS origin FROM events")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    close = F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOUR")
    return _events(spark, sf).select("event_id", F.when(F.col("ts") < close, "forward").otherwise("retrospective").alias("origin"))


@register("C08_hours_label", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0)::BIGINT AS hours FROM events")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return _events(spark, sf).select("event_id", F.round((micros(F.lit("2024-02-01")) - micros(F.col("ts"))) / 3_600_000_000).cast("long").alias("hours"))


@register("H04_fact_fingerprint", "SELECT l_orderkey, sha256(string_agg(l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR)) AS fact FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), "|")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sha2(parts, 256).alias("fact"))


@register("K01_limiter")
def k01_limiter(spark: SparkSession, sf: str) -> DataFrame:
    return st.limit_batch(_events(spark, sf), 86_400.0, 2)


@register("K05_lease_recovery", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY THEN CASE WHEN o_orderkey % 8 >= 6 THEN 'failed' ELSE 'retry_wait' END WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'idle' END AS status FROM orders")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "processing").otherwise("idle").alias("status"), F.col("o_orderdate").alias("claimed_at"), (F.col("o_orderkey") % 8).alias("attempts"))
    return st.lease_recovery(jobs, "2001-08-02", "30 DAY", 6).select("o_orderkey", "status")


@register("K07_illegal_transitions", "SELECT event_id, coalesce(b, 'signup') AS before, event_type AS status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE NOT ((coalesce(b, 'signup') = 'signup' AND event_type IN ('view', 'error')) OR (coalesce(b, '') = 'view' AND event_type IN ('click', 'view')) OR (coalesce(b, '') = 'click' AND event_type = 'purchase'))")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).select(F.col("user_id").alias("job"), "event_id", "ts", F.col("event_type").alias("status"))
    return st.illegal_transitions(log, {"signup": ("view", "error"), "view": ("click", "view"), "click": ("purchase",)}, "signup").select("event_id", "before", "status")


_GOVERNED = "WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS i, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), a AS (SELECT *, max(i) FILTER (NOT value <= 20) OVER w AS loud, max(i) FILTER (value >= 60) OVER w AS hot FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)), b AS (SELECT *, max(i) FILTER (i - coalesce(loud, 0) >= 3) OVER (PARTITION BY user_id ORDER BY i) AS calmed FROM a) SELECT user_id, event_id, CASE WHEN hot IS NOT NULL AND coalesce(calmed, 0) < hot THEN 'paused' ELSE 'running' END AS state FROM b"


@register("W07_governor", _GOVERNED)
def w07(spark: SparkSession, sf: str) -> DataFrame:
    return st.governor(_events(spark, sf), ["user_id"], 60.0, 20.0, 3)


@register("K08_governor_stream", f"{_GOVERNED} WHERE epoch_us(ts) < (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream that is drained: all readings but those as new as the newest, which its watermark has not passed."""
    stream = table_stream(st.timer_session(spark), sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.drained(st.governor_stream(stream, "user_id", 60.0, 20.0, 3, "0 seconds"), spark, "governed")


@register("W05_claim_bands", "SELECT band, min(event_id) AS first, count(*) AS n FROM (SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-29 00:00:00' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS band FROM events) GROUP BY 1")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("ts") <= F.lit("2024-01-29").cast("timestamp_ntz"), 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return _events(spark, sf).groupBy(band.alias("band")).agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@register("O02_top_one", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def o02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@register("V02_column_record_mismatch", "SELECT event_id FROM events WHERE (props ->> '$.k')::BIGINT <> event_id % 100")
def v02(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).where(~F.get_json_object("props", "$.k").cast("long").eqNullSafe(F.col("event_id") % 100)).select("event_id")


@register("V06_look_ahead", "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1")
def v06(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.where("l_shipdate < o_orderdate").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("R31_sensor_text", "SELECT event_id, (event_id % 512) * CASE event_id % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1 END AS bytes FROM events")
def r31(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("KiB"), F.lit("MiB"), F.lit("B")), (F.col("event_id") % 3).cast("int") + 1)
    said = F.concat((F.col("event_id") % 512).cast("string"), F.lit(" "), unit)
    scale = F.create_map(F.lit("B"), F.lit(1), F.lit("KiB"), F.lit(1024), F.lit("MiB"), F.lit(1_048_576))
    return _events(spark, sf).select("event_id", said.alias("s")).select("event_id", (F.regexp_extract("s", "^([0-9]+)", 1).cast("long") * F.element_at(scale, F.regexp_extract("s", "([A-Za-z]+)$", 1))).alias("bytes"))


@register("R07_metric_value_pick", "SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN value END), arg_max(value, (ts, event_id))) AS value FROM events GROUP BY 1")
def r07(spark: SparkSession, sf: str) -> DataFrame:
    named = F.max(F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), F.col("value")))
    return _events(spark, sf).groupBy("user_id").agg(F.coalesce(named, F.max_by("value", F.struct("ts", "event_id"))).alias("value"))


@register("R13_disposition_domain", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O') OR o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    fits = F.col("o_orderstatus").isin("F", "O") | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf, "orders").where(~fits).select("o_orderkey")


@register("X21_ticker_extraction", "SELECT doc_id, nullif(regexp_extract(text, '(?:^| )([A-Z]{2,5})(?: |$)', 1), '') AS ticker FROM documents")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "(?:^| )([A-Z]{2,5})(?: |$)", 1), F.lit("")).alias("ticker"))


@register("X26_coerced_numbers", "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9]{1,3}(,[0-9]{3})+'), lambda x: replace(x, ',', '')::BIGINT > 1000))::INTEGER AS n FROM documents")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[0-9]{1,3}(?:,[0-9]{3})+"), 0)
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint") > 1000)).alias("n"))


@register("S03_corporate_actions", f"SELECT s_suppkey % 20 AS instrument_id, s_suppkey AS action_id, DATE '1996-01-01' + (s_suppkey * 37 % 1500)::INTEGER AS effective_date, CASE s_suppkey % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'cash_dividend' ELSE 'symbol_change' END AS action_type FROM supplier WHERE DATE '1996-01-01' + (s_suppkey * 37 % 1500)::INTEGER <= DATE '1999-01-01'")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int"))
    kind = F.element_at(F.array(F.lit("split"), F.lit("cash_dividend"), F.lit("symbol_change")), (F.col("s_suppkey") % 3).cast("int") + 1)
    a = table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("instrument_id"), F.col("s_suppkey").alias("action_id"), day.alias("effective_date"), kind.alias("action_type"), day.cast("timestamp_ntz").alias("available_at"))
    return a.where(known_by("1999-01-01", "available_at")).drop("available_at").orderBy("effective_date", "action_id")


@register("O08_budgeted_selection", "SELECT lang, count(*) AS n, sum(c)::BIGINT AS used FROM (SELECT lang, doc_id, length(text) AS c, sum(length(text)) OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS total FROM documents) WHERE total <= 20000 GROUP BY 1")
def o08(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest texts first while they fit a language's budget: as lengths only grow, the running sum decides."""
    c = F.length("text")
    w = Window.partitionBy("lang").orderBy(c, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "documents").select("lang", c.alias("c"), F.sum(c).over(w).alias("total")).where("total <= 20000").groupBy("lang").agg(F.count("*").alias("n"), F.sum("c").alias("used"))
