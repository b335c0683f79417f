"""Registered look-back reports over events and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import telemetry as t
from tidemark.tables import table

NOW = "2024-01-30 00:00:00"
TYPES = ("view", "click", "error", "purchase", "signup")
_IN = f"ts <= TIMESTAMP '{NOW}'"
_WINDOWS = f"w AS (SELECT unnest([24, 48, 168])::INTEGER AS hours), e AS (SELECT w.hours, events.* FROM w JOIN events ON ts >= TIMESTAMP '{NOW}' - to_hours(w.hours) AND {_IN})"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@register("A01_conditional_counts", "SELECT user_id % 10 AS shard, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS n_{x}" for x in TYPES) + " FROM events GROUP BY 1")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return t.conditional_counts(_events(spark, sf).withColumn("shard", F.col("user_id") % 10), ["shard"], "event_type", TYPES)


@register("A02_windowed_counts", f"WITH w AS (SELECT unnest([24, 48, 168, 1000])::INTEGER AS hours), f AS (SELECT min(ts) AS first FROM events WHERE {_IN}) SELECT hours, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{NOW}' - to_hours(hours) AND {_IN}) AS n, first <= TIMESTAMP '{NOW}' - to_hours(hours) AS complete, greatest(first, TIMESTAMP '{NOW}' - to_hours(hours)) AS coverage_start FROM w, f")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return t.covered_windows(_events(spark, sf), "ts", NOW, (24, 48, 168, 1000))


@register("A03_reason_histogram", f"WITH {_WINDOWS} SELECT hours, event_type AS reason, count(*) AS n FROM e GROUP BY 1, 2")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    return t.reason_histogram(_events(spark, sf), "ts", NOW, t.HOURS, "event_type")


@register("A04_funnel_snapshot", f"WITH {_WINDOWS} SELECT hours, count(*) AS n, count(DISTINCT user_id) AS users, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS n_{x}" for x in TYPES) + ", sum(round(value * 100)::BIGINT)::BIGINT AS cents, round(quantile_cont(value, 0.5) FILTER (event_type = 'error'), 6) AS error_p50, round(quantile_cont(value, 0.95) FILTER (event_type = 'error'), 6) AS error_p95, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers FROM e GROUP BY 1")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """By user first, so that distinct users are rows and no row is expanded; percentiles in an aggregation of their own."""
    e = _events(spark, sf).where(F.col("ts") <= t.at(NOW))
    inside = {h: F.col("ts") >= t.since(NOW, h) for h in t.HOURS}
    kinds = {f"n_{x}": F.col("event_type") == x for x in TYPES}
    by = e.groupBy("user_id").agg(
        *[F.count_if(c).alias(f"n_{h}") for h, c in inside.items()],
        *[F.count_if(c & k).alias(f"{name}_{h}") for h, c in inside.items() for name, k in kinds.items()],
        *[F.sum(F.when(c, F.round(F.col("value") * 100).cast("long"))).alias(f"cents_{h}") for h, c in inside.items()],
    )
    names = ("n", *kinds, "cents")
    flat = by.agg(*[F.sum(f"{n}_{h}").alias(f"{n}_{h}") for h in t.HOURS for n in names], *[F.count_if(F.col(f"n_{h}") > 0).alias(f"users_{h}") for h in t.HOURS], *[F.count_if(F.col(f"n_purchase_{h}") > 0).alias(f"buyers_{h}") for h in t.HOURS])
    rows = flat.select(F.inline(F.array(*[F.struct(F.lit(h).alias("hours"), *[F.col(f"{n}_{h}").alias(n) for n in (*names, "users", "buyers")]) for h in t.HOURS])))
    held = F.array_compact(F.array(*[F.when(c, F.lit(h)) for h, c in inside.items()]))
    errors = e.where("event_type = 'error'").select("value", F.explode(held).alias("hours")).groupBy("hours").agg(*[F.round(F.percentile("value", p / 100), 6).alias(f"error_p{p}") for p in (50, 95)])
    return rows.join(F.broadcast(errors), "hours", "left")  # a row a window


@register("A05_queue_operations", "SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') AS waiting, count(*) FILTER (o_orderstatus = 'P') AS processing, count(*) FILTER (o_orderstatus = 'F') AS done, date_diff('day', min(o_orderdate) FILTER (o_orderstatus IN ('O', 'P'))::DATE, DATE '2001-08-02') AS oldest_days, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS backlog FROM orders GROUP BY 1")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    by = o.groupBy(F.col("o_orderpriority").alias("queue")).agg(F.count_if(status == "O").alias("waiting"), F.count_if(status == "P").alias("processing"), F.count_if(status == "F").alias("done"), F.datediff(F.lit("2001-08-02").cast("date"), F.to_date(F.min(F.when(status.isin("O", "P"), F.col("o_orderdate"))))).cast("long").alias("oldest_days"))
    return by.crossJoin(F.broadcast(by.agg(F.sum(F.col("waiting") + F.col("processing")).alias("backlog"))))


@register("A06_json_array_histogram", "SELECT item, count(*) AS n FROM (SELECT unnest([k % 7, k % 5, k]) AS item FROM (SELECT (props ->> '$.k')::BIGINT AS k FROM events)) GROUP BY 1")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    record = _events(spark, sf).select(F.to_json(F.struct(F.array(k % 7, k % 5, k).alias("items"))).alias("record"))
    items = F.from_json("record", "items array<bigint>").getField("items")
    return record.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


@register("A07_source_class_histogram", "SELECT CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'primary' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'secondary' ELSE 'other' END AS producer, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    source = F.col("source")
    producer = F.when(source.rlike("^src[0-4]$"), "primary").when(source.rlike("^src1[0-9]$"), "secondary").otherwise("other")
    return table(spark, sf, "documents").groupBy(producer.alias("producer"), "lang").agg(F.count("*").alias("n"))


@register("A08_distinct_keys", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))


@register("A09_percentile_cont", "SELECT event_type, round(quantile_cont(value, 0.5) FILTER (user_id % 2 = 0), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (user_id % 2 = 0), 6) AS p95 FROM events GROUP BY 1")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    even = F.when(F.col("user_id") % 2 == 0, F.col("value"))
    return _events(spark, sf).groupBy("event_type").agg(*[F.round(F.percentile(even, p / 100), 6).alias(f"p{p}") for p in (50, 95)])


@register("A10_percentile_nearest_rank", "SELECT user_id % 25 AS shard, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return t.distribution(_events(spark, sf).withColumn("shard", F.col("user_id") % 25), ["shard"], "value").select("shard", "p50", "p90", "p95")


@register("A11_percentile_linear", "SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@register("A12_ratio", "SELECT user_id % 10 AS shard, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN (count(*) FILTER (event_type = 'click') * 1000000 // count(*) FILTER (event_type = 'view'))::BIGINT END AS clicks_a_million_views FROM events GROUP BY 1")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    by = t.conditional_counts(_events(spark, sf).withColumn("shard", F.col("user_id") % 10), ["shard"], "event_type", TYPES)
    return by.select("shard", t.ratio(F.col("n_click"), F.col("n_view")).alias("clicks_a_million_views"))


@register("A13_distribution", "SELECT event_type, count(value) AS n, min(value) AS min, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY 1")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return t.distribution(_events(spark, sf), ["event_type"], "value")


_GAUGES = "SELECT 'events_in_day' AS metric, count(*)::BIGINT AS value, 'available' AS availability, NULL AS reason FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' UNION ALL SELECT 'cpu_temperature', NULL, 'unavailable', 'sensor_missing'"


@register("A14_gauges", _GAUGES)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    day = t.look_back(_events(spark, sf), "ts", NOW, (24,), {"value": lambda c: F.count_if(c)})
    day = day.select(F.lit("events_in_day").alias("metric"), "value", F.lit("available").alias("availability"), F.lit(None).cast("string").alias("reason"))
    return day.unionByName(spark.range(1).select(F.lit("cpu_temperature").alias("metric"), F.lit(None).cast("long").alias("value"), F.lit("unavailable").alias("availability"), F.lit("sensor_missing").alias("reason")))


@register("A15_measurement_set", f"WITH {_WINDOWS} SELECT hours, 'purchase_ratio' AS metric, (count(*) FILTER (event_type = 'purchase') * 1000000 // count(*))::DOUBLE AS value FROM e GROUP BY 1 UNION ALL SELECT hours, 'value_p95', quantile_disc(value, 0.95) FROM e GROUP BY 1 UNION ALL SELECT hours, 'errors', (count(*) FILTER (event_type = 'error'))::DOUBLE FROM e GROUP BY 1")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    measures = {"purchase_ratio": lambda c: t.ratio(F.count_if(c & (kind == "purchase")), F.count_if(c)).cast("double"), "errors": lambda c: F.count_if(c & (kind == "error")).cast("double")}
    counted = t.look_back(_events(spark, sf), "ts", NOW, t.HOURS, measures)
    long = counted.select("hours", F.expr("stack(2, 'purchase_ratio', purchase_ratio, 'errors', errors) AS (metric, value)"))
    seen = _events(spark, sf).where(F.col("ts") <= t.at(NOW)).select("value", F.explode(F.filter(F.array(*[F.when(F.col("ts") >= t.since(NOW, h), F.lit(h)) for h in t.HOURS]), lambda h: h.isNotNull())).alias("hours"))
    return long.unionByName(t.distribution(seen, ["hours"], "value").select("hours", F.lit("value_p95").alias("metric"), F.col("p95").alias("value")))


@register("A16_exactly_once_rate", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (c = 1) AS n_once, (count(*) FILTER (c = 1) * 1000000 // count(*))::BIGINT AS rate FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return t.exactly_once(parents, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), "key", ["status"])


_PAIRS = "p AS (SELECT user_id, min(ts) FILTER (event_type = 'signup' AND event_id % 3 = 0) AS a, max(ts) FILTER (event_type = 'purchase' AND event_id % 5 = 0) AS b FROM events GROUP BY 1)"


@register("A17_latency", f"WITH {_PAIRS} SELECT user_id, CASE WHEN b >= a THEN ((epoch_us(b) - epoch_us(a)) // 1000)::BIGINT END AS ms, CASE WHEN a IS NULL THEN 'no_start' WHEN b IS NULL THEN 'no_end' WHEN b < a THEN 'reversed' ELSE 'ok' END AS reason FROM p")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    p = _events(spark, sf).groupBy("user_id").agg(F.min(F.when((kind == "signup") & (n % 3 == 0), F.col("ts"))).alias("a"), F.max(F.when((kind == "purchase") & (n % 5 == 0), F.col("ts"))).alias("b"))
    ms, reason = t.latency(F.col("a"), F.col("b"))
    return p.select("user_id", ms.alias("ms"), reason.alias("reason"))


@register("A18_hourly_cadence", "SELECT date_trunc('hour', ts) AS hour, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each hour: what a measurement emitted once an hour keeps."""
    e = _events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("hour").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("hour", "x.event_id", "x.ts")


@register("A27_health_rollup", "SELECT user_id % 20 AS shard, CASE max(CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 3 ELSE 2 END WHEN 'view' THEN 0 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'degraded' WHEN 1 THEN 'watch' ELSE 'healthy' END AS health FROM events GROUP BY 1")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rank = F.when((kind == "error") & (F.col("value") > 50), 3).when(kind == "error", 2).when(kind == "view", 0).otherwise(1)
    label = F.element_at(F.array(*[F.lit(x) for x in ("healthy", "watch", "degraded", "critical")]), F.max(rank) + 1)
    return _events(spark, sf).groupBy((F.col("user_id") % 20).alias("shard")).agg(label.alias("health"))


@register("A28_benchmark_summary", "SELECT role, round(avg((length(text) > 200)::INTEGER), 6) AS long_rate, median(length(text)) AS median_chars, count(DISTINCT conv_id) AS cases, count(*) AS runs FROM conversations GROUP BY 1")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("role").agg(F.round(F.avg((n > 200).cast("int")), 6).alias("long_rate"), F.percentile(n, 0.5).alias("median_chars"), F.countDistinct("conv_id").alias("cases"), F.count("*").alias("runs"))


@register("A29_paired_gate", "WITH p AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1) SELECT o_custkey % 10 AS cohort, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, bool_and(a >= b) AS every, bool_or(a >= b) AS some, round(sum(a) / nullif(sum(b), 0), 6) AS ratio FROM p GROUP BY 1")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    ok = F.col("a") >= F.col("b")
    return p.groupBy((F.col("o_custkey") % 10).alias("cohort")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.bool_and(ok).alias("every"), F.bool_or(ok).alias("some"), F.round(F.sum("a") / F.nullif(F.sum("b"), F.lit(0)), 6).alias("ratio"))


@register("A30_resource_trace", "SELECT user_id, max(value) AS peak, arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(arg_max(value, ts) - arg_min(value, ts), 6) AS growth, count(*) FILTER (event_type <> 'error') AS successes FROM events GROUP BY 1")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    first, last = F.min_by("value", "ts"), F.max_by("value", "ts")
    return _events(spark, sf).groupBy("user_id").agg(F.max("value").alias("peak"), first.alias("first"), last.alias("last"), F.round(last - first, 6).alias("growth"), F.count_if(F.col("event_type") != "error").alias("successes"))


@register("A31_convergence", "SELECT user_id, count(DISTINCT event_type) FILTER (value >= 20) AS positive, count(DISTINCT event_type) FILTER (value < 20) AS negative, CASE WHEN count(DISTINCT event_type) FILTER (value >= 20) >= 3 AND count(DISTINCT event_type) FILTER (value < 20) >= 3 THEN 'mixed' WHEN count(DISTINCT event_type) FILTER (value >= 20) >= 3 THEN 'converging_up' WHEN count(DISTINCT event_type) FILTER (value < 20) >= 3 THEN 'converging_down' ELSE 'insufficient' END AS conclusion FROM events GROUP BY 1")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    up = F.col("value") >= 20
    by = _events(spark, sf).groupBy("user_id").agg(F.countDistinct(F.when(up, F.col("event_type"))).alias("positive"), F.countDistinct(F.when(~up, F.col("event_type"))).alias("negative"))
    p, n = F.col("positive") >= 3, F.col("negative") >= 3
    return by.withColumn("conclusion", F.when(p & n, "mixed").when(p, "converging_up").when(n, "converging_down").otherwise("insufficient"))


@register("A32_acquired_disposed", "SELECT l_suppkey, l_shipdate::DATE AS day, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)::BIGINT AS acquired, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS disposed FROM lineitem GROUP BY 1, 2")
def a32(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)).cast("long")
    return table(spark, sf, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(q("A").alias("acquired"), q("R").alias("disposed"))


@register("A33_category_counts", "SELECT category, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS category FROM part) GROUP BY 1")
def a33(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@register("A34_counters_from_events", "SELECT event_type, (count(*) FILTER (value >= 0) - count(*) FILTER (value > 100))::BIGINT AS counter FROM events GROUP BY 1")
def a34(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("event_type").agg((F.count_if(F.col("value") >= 0) - F.count_if(F.col("value") > 100)).alias("counter"))


@register("A35_ordered_array", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_partial, count(DISTINCT o_orderstatus) AS n_status, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def a35(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_partial"), F.countDistinct("o_orderstatus").alias("n_status"), F.array_join(keys, ",").alias("keys"))


@register("A39_null_propagating_sum", "SELECT user_id, CASE WHEN count(x) = count(*) THEN sum(x)::BIGINT END AS total FROM (SELECT user_id, CASE WHEN event_id % 97 <> 0 THEN round(value * 100)::BIGINT END AS x FROM events) GROUP BY 1")
def a39(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100).cast("long"))
    return _events(spark, sf).groupBy("user_id").agg(t.null_propagating_sum(x).alias("total"))


@register("A40_fact_counts", "SELECT l_orderkey AS filing, count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS same_filing FROM lineitem GROUP BY 1")
def a40(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("filing")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "O").alias("same_filing"))


@register("A36_gauge_scaling", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round(value * 1000)::BIGINT END AS milli, CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'available' END AS availability FROM events")
def a36(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    return _events(spark, sf).select("event_id", F.when(~gone, F.round(F.col("value") * 1000).cast("long")).alias("milli"), F.when(gone, "unavailable").otherwise("available").alias("availability"))


@register("A37_exact_field_score", "SELECT p_partkey, (p_type = 'ECONOMY')::INTEGER + (p_size > 25)::INTEGER + (contains(p_name, 'red'))::INTEGER AS score FROM part")
def a37(spark: SparkSession, sf: str) -> DataFrame:
    hits = [F.col("p_type") == "ECONOMY", F.col("p_size") > 25, F.col("p_name").contains("red")]
    return table(spark, sf, "part").select("p_partkey", sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")).alias("score"))


@register("A38_paired_non_regression", "WITH a AS (SELECT user_id, count(*) AS n, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, b.n >= a.n AS count_ok, b.v <= 0.67 * a.v AS latency_ok FROM a JOIN b USING (user_id)")
def a38(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda r: _events(spark, sf).where(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.count("*").alias(f"n{r}"), F.max("value").alias(f"v{r}"))
    return side(0).join(side(1), "user_id").select("user_id", (F.col("n1") >= F.col("n0")).alias("count_ok"), (F.col("v1") <= 0.67 * F.col("v0")).alias("latency_ok"))


@register("W01_latest_per_key", "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    return t.latest(_events(spark, sf), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "user_id", "event_id", "value")


@register("W02_latest_by_composite_key", "SELECT user_id, arg_max(event_id, (event_type = 'purchase', value > 10, ts, event_id)) AS event_id FROM events GROUP BY 1")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct((F.col("event_type") == "purchase").alias("a"), (F.col("value") > 10).alias("b"), "ts", "event_id")
    return _events(spark, sf).groupBy("user_id").agg(F.max_by("event_id", rank).alias("event_id"))


@register("K02_sliding_windows", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "24 hours", "1 hour")
    return _events(spark, sf).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@register("K01_range_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the same user in the day before each event; admission control that depends on past refusals is in streaming.limiter."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-86_400_000_000, 0)
    return _events(spark, sf).select("event_id", F.count("*").over(w).alias("n"))
