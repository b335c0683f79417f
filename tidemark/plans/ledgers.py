"""Registered queries on joins, ordering, sets, identity, dates and arrays, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import ledger as led
from tidemark.operators.telemetry import latest
from tidemark.tables import table

_ACTIONS = "m AS (SELECT user_id AS key, event_id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'added' ELSE 'removed' END AS action, ts AS recorded_at, ts - to_hours((event_id % 48)::BIGINT) AS effective_at FROM events)"
_CUT = "2024-01-20 00:00:00"


def _membership(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type").isin("signup", "view", "click"), "added").otherwise("removed")
    return e.select(F.col("user_id").alias("key"), "event_id", action.alias("action"), F.col("ts").alias("recorded_at"), (F.col("ts") - F.expr("make_dt_interval(0, cast(event_id % 48 as int))")).alias("effective_at"))


@register("J02_one_to_one", "SELECT k % 10 AS shard, count(*) AS n FROM (SELECT coalesce(a.k, b.k, c.k) AS k, a.k IS NULL OR b.k IS NULL OR c.k IS NULL AS gap FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k FULL JOIN (SELECT DISTINCT user_id AS k FROM events) c ON coalesce(a.k, b.k) = c.k) WHERE gap GROUP BY 1")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select(F.col(c).alias("k")).distinct() for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))]
    return led.one_to_one(parts, "k").groupBy((F.col("k") % 10).alias("shard")).agg(F.count("*").alias("n"))


@register("J03_inner_using", "SELECT n_name, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@register("J04_left_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON c_custkey = o_custkey")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register("J05_point_in_time_left_join", "SELECT o_orderkey, max(l_shipdate) AS last_ship, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate <= TIMESTAMP '1998-01-01' WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    known = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= cut).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"))
    return table(spark, sf, "orders").where(F.col("o_orderdate") <= cut).select("o_orderkey").join(known, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@register("J06_incomplete_enrolment", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_orderkey) < 3")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("n < 3")


@register("J07_anti_join", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@register("J08_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@register("J09_lateral_latest", "SELECT c_custkey, o.o_orderkey, o.o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("o"))
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "o.o_orderkey", "o.o_orderstatus")


@register("J13_as_of_same_set", "SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.ts < e.ts) AS prior_event_id FROM events e")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return led.latest_before(e, e, ["user_id", "event_type"], "ts", "ts", ["event_id"], "event_id").select("event_id", "prior_event_id")


@register("J14_compatible_prior", "SELECT event_id, prior FROM (SELECT e.event_id, p.event_id AS prior, row_number() OVER (PARTITION BY e.event_id ORDER BY (p.event_type = e.event_type) DESC, p.ts DESC, p.event_id DESC) AS r FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts < e.ts) WHERE r = 1")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Latest earlier event of the user, one of the same type preferred: two as-of joins instead of all earlier pairs."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    same = led.latest_before(e, e, ["user_id", "event_type"], "ts", "ts", ["event_id"], "event_id").withColumnRenamed("prior_event_id", "same")
    both = led.latest_before(same, e, ["user_id"], "ts", "ts", ["event_id"], "event_id")
    return both.select("event_id", F.coalesce("same", "prior_event_id").alias("prior")).where("prior is not null")


_CALENDAR = "c AS (SELECT row_number() OVER (ORDER BY d) AS session_idx, d + INTERVAL 16 HOUR AS close_at FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-20', INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5)"


def _calendar(spark: SparkSession) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-20')) AS d").where("weekday(d) < 5")
    return days.select(F.row_number().over(Window.orderBy("d")).alias("session_idx"), (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOUR")).alias("close_at"))


@register("J16_calendar_as_of", f"WITH {_CALENDAR}, f AS (SELECT event_id, (SELECT min(session_idx) FROM c WHERE close_at >= ts) AS idx FROM events) SELECT event_id, idx AS session_idx, n.close_at AS close_5 FROM f LEFT JOIN c n ON n.session_idx = idx + 5")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    cal = _calendar(spark)
    e = led.first_session_from(table(spark, sf, "events").select("event_id", "ts"), cal, "ts")
    later = cal.select((F.col("session_idx") - 5).cast("long").alias("session_idx"), F.col("close_at").alias("close_5"))
    return e.join(F.broadcast(later), "session_idx", "left").select("event_id", "session_idx", "close_5")


@register("J18_explode_join", "SELECT n_regionkey, count(*) AS n FROM (SELECT unnest(['ring', 'bolt', 'gear']) AS w, p_partkey, p_name FROM part) JOIN nation ON n_nationkey = p_partkey % 25 WHERE contains(p_name, w) GROUP BY 1")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("n_nationkey"), "p_name", F.explode(F.array(*[F.lit(w) for w in ("ring", "bolt", "gear")])).alias("w"))
    return p.where(F.expr("contains(p_name, w)")).join(table(spark, sf, "nation"), "n_nationkey").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@register("J20_polymorphic_parent", "SELECT event_type, count(c_custkey) AS customers, count(s_suppkey) AS suppliers, count(*) AS n FROM events LEFT JOIN customer ON event_id % 2 = 0 AND user_id = c_custkey LEFT JOIN supplier ON event_id % 2 = 1 AND user_id = s_suppkey GROUP BY 1")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("even", F.col("event_id") % 2 == 0)
    out = e.join(table(spark, sf, "customer"), F.when(F.col("even"), F.col("user_id")) == F.col("c_custkey"), "left").join(table(spark, sf, "supplier"), F.when(~F.col("even"), F.col("user_id")) == F.col("s_suppkey"), "left")
    return out.groupBy("event_type").agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"), F.count("*").alias("n"))


@register("J22_four_point_lookup", "SELECT o_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS q1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS q2, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS q3, max(CASE WHEN l_linenumber = 4 THEN l_quantity END) AS q4 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    points = [F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"q{i}") for i in (1, 2, 3, 4)]
    return table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left").groupBy("o_orderkey").agg(*points)


@register("J23_name_lookup", "SELECT r_regionkey, CASE lower(replace(r_name, ' ', '')) WHEN 'asia' THEN 'XASI' WHEN 'europe' THEN 'XEUR' WHEN 'america' THEN 'XAME' END AS mic FROM region")
def j23(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for x in ("asia", "XASI", "europe", "XEUR", "america", "XAME")])
    return table(spark, sf, "region").select("r_regionkey", F.try_element_at(codes, F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("")))).alias("mic"))


@register("J24_enrolment_fan_out", "SELECT o_orderkey, h AS horizon, o_orderdate::DATE + h::INTEGER AS due FROM orders, (SELECT unnest([1, 5, 20]) AS h) WHERE NOT (o_orderkey % 7 = 0 AND h = 5)")
def j24(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))).alias("horizon"))
    there = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(5).alias("horizon"))
    return o.join(there, ["o_orderkey", "horizon"], "left_anti").select("o_orderkey", "horizon", F.date_add("day", F.col("horizon")).alias("due"))


@register("O01_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 50")
def o01(spark: SparkSession, sf: str) -> DataFrame:
    return led.page(table(spark, sf, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100, 50).select("o_orderkey", "o_orderdate")


@register("O03_priority_claim", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return latest(table(spark, sf, "orders"), ["o_orderpriority"], [rank, F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderpriority", "o_orderkey")


@register("O04_list_position_claim", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY list_position(['2-HIGH', '1-URGENT', '3-MEDIUM', '5-LOW', '4-NOT SPECIFIED'], o_orderpriority), o_orderdate, o_orderkey LIMIT 10")
def o04(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in ("2-HIGH", "1-URGENT", "3-MEDIUM", "5-LOW", "4-NOT SPECIFIED")])
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("P", "O")).orderBy(F.array_position(wanted, F.col("o_orderpriority")), "o_orderdate", "o_orderkey").limit(10).select("o_orderkey")


@register("O05_due_claim", "SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_shipdate <= TIMESTAMP '1999-01-01' ORDER BY l_shipdate, o_orderkey, l_linenumber LIMIT 1")
def o05(spark: SparkSession, sf: str) -> DataFrame:
    due = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1999-01-01").cast("timestamp_ntz"))
    return due.join(table(spark, sf, "orders").where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).orderBy("l_shipdate", "o_orderkey", "l_linenumber").limit(1).select("o_orderkey", "l_linenumber")


@register("O06_bounded_admission", "WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0), w AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderkey % 50 <> 0) SELECT o_orderkey, place FROM w WHERE place <= greatest(400 - (SELECT count(*) FROM a), 0)")
def o06(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return led.admit(o, o.where("o_orderkey % 50 = 0"), "o_orderkey", [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 400).select("o_orderkey", "place")


@register("O07_top_k_with_omitted", "SELECT o_custkey, count(*) FILTER (r <= 6) AS kept, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) FILTER (r > 6) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) GROUP BY 1")
def o07(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 6, F.struct("r", "o_orderkey")))), lambda x: x["o_orderkey"].cast("string"))
    return r.groupBy("o_custkey").agg(F.count_if(F.col("r") <= 6).alias("kept"), F.nullif(F.array_join(names, ","), F.lit("")).alias("omitted"))


@register("O09_bounded_list", "SELECT user_id, list_slice(list(event_id ORDER BY ts, event_id), 1, 24)::VARCHAR AS ids FROM events GROUP BY 1")
def o09(spark: SparkSession, sf: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    first = table(spark, sf, "events").select("user_id", "ts", "event_id", nth.alias("nth")).where("nth <= 24")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_id"))), lambda x: x["event_id"].cast("string"))
    return first.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


@register("O10_last_n_ascending", "SELECT event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) ORDER BY ts, event_id")
def o10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).orderBy("ts", "event_id").select("event_id", "ts")


@register("O11_ordered_attempts", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_quantity::INTEGER, ' ' ORDER BY l_linenumber, l_quantity) AS attempts FROM lineitem GROUP BY 1")
def o11(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["l_linenumber"], x["q"])), " ").alias("attempts"))


@register("U01_union_ordered", "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS seen_at FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY seen_at DESC, kind, id DESC LIMIT 200")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at"))
    e = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("seen_at"))
    return o.unionByName(e).orderBy(F.desc("seen_at"), "kind", F.desc("id")).limit(200)


@register("U02_union_windowed_sum", "SELECT category, count(*) AS n FROM (SELECT 'order:' || o_orderstatus AS category, o_orderdate AS seen_at FROM orders UNION ALL SELECT 'line:' || l_returnflag, l_shipdate FROM lineitem) WHERE seen_at >= TIMESTAMP '2001-01-01' GROUP BY 1")
def u02(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("order:"), "o_orderstatus").alias("category"), F.col("o_orderdate").alias("seen_at"))
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("line:"), "l_returnflag").alias("category"), F.col("l_shipdate").alias("seen_at"))
    return o.unionByName(li).where(F.col("seen_at") >= F.lit("2001-01-01").cast("timestamp_ntz")).groupBy("category").agg(F.count("*").alias("n"))


@register("U03_set_rules", "SELECT user_id, len(list_intersect(list_distinct(list(event_type)), ['error', 'signup', 'purchase']))::INTEGER AS required, len(list_filter(['error', 'signup', 'purchase', 'refund'], lambda x: NOT list_contains(list(event_type), x)))::INTEGER AS missing FROM events GROUP BY 1")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    have = F.collect_set("event_type")
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return table(spark, sf, "events").groupBy("user_id").agg(F.size(F.array_intersect(have, lit("error", "signup", "purchase"))).alias("required"), F.size(F.array_except(lit("error", "signup", "purchase", "refund"), have)).alias("missing"))


@register("U04_selector_diff", "SELECT coalesce(a.p_brand, b.p_brand) AS selector, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'modified' ELSE 'same' END AS change FROM (SELECT p_brand, count(*) AS n FROM part WHERE p_size <= 25 AND p_brand <> 'Brand#3' GROUP BY 1) a FULL JOIN (SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 AND p_brand <> 'Brand#7' GROUP BY 1) b ON a.p_brand = b.p_brand")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.where("p_size <= 25 and p_brand <> 'Brand#3'").groupBy("p_brand").agg(F.count("*").alias("a"))
    b = p.where("p_size > 25 and p_brand <> 'Brand#7'").groupBy("p_brand").agg(F.count("*").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return a.join(b, "p_brand", "full_outer").select(F.col("p_brand").alias("selector"), change.alias("change"))


@register("U05_ordered_distinct", "SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS seen FROM (SELECT user_id, event_type, min(ts) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"]))
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(seen, ">").alias("seen"))


@register("P02_newest_excluding", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01' AND o_orderstatus <> 'P') WHERE r <= 3")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    known = led.excluding(table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit("1999-01-01").cast("timestamp_ntz")), "o_orderstatus", "P")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return known.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@register("P04_substring_list", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND (contains(lower(c_name), '00_1') OR contains(lower(c_name), '01'))")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return led.substring_filter(table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'"), "01", ["c_name"]).select("c_custkey")


@register("P06_key_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 77")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderkey = 77").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@register("P08_domain_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (1, 7) GROUP BY 1")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R") & ~F.col("l_linenumber").isin(1, 7)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register("P09_distinct_from", "SELECT count(*) AS n FROM (SELECT event_type AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE a IS DISTINCT FROM b")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_type", before.alias("b")).where(~F.col("event_type").eqNullSafe(F.col("b"))).agg(F.count("*").alias("n"))


@register("P11_relabel", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS public_status FROM orders")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("other")).alias("public_status"))


@register("W03_membership", f"WITH {_ACTIONS} SELECT key, n_events FROM (SELECT key, count(*) AS n_events, arg_max(action, (recorded_at, event_id)) AS action FROM m WHERE recorded_at <= TIMESTAMP '{_CUT}' AND effective_at <= TIMESTAMP '{_CUT}' GROUP BY 1) WHERE action = 'added'")
def w03(spark: SparkSession, sf: str) -> DataFrame:
    return led.membership(_membership(spark, sf), _CUT)


@register("V05_membership_chain", f"WITH {_ACTIONS} SELECT event_id, CASE WHEN b IS NULL THEN 'starts_with_removal' ELSE 'repeated_action' END AS violation FROM (SELECT *, lag(action) OVER (PARTITION BY key ORDER BY recorded_at, event_id) AS b FROM m) WHERE (b IS NULL AND action <> 'added') OR b = action")
def v05(spark: SparkSession, sf: str) -> DataFrame:
    return led.chain_violations(_membership(spark, sf)).select("event_id", "violation")


@register("W04_queue_bands", "SELECT event_id, band, row_number() OVER (ORDER BY band, ts, event_id) AS place FROM (SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-29 00:00:00' THEN 0 WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 3 END AS band FROM events WHERE ts > TIMESTAMP '2024-01-25')")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    recent = table(spark, sf, "events").where(F.col("ts") > F.lit("2024-01-25").cast("timestamp_ntz"))
    return led.banded_queue(recent, "2024-01-30 00:00:00", band, "ts", "event_id").select("event_id", "band", "place")


@register("W06_latest_appended", "SELECT l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("l_shipdate"), *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]]
    return latest(table(spark, sf, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_quantity")


@register("W08_hash_chain")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    return led.hash_chain(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "props")


@register("W08_chain_appended")
def w08_appended(spark: SparkSession, sf: str) -> DataFrame:
    """The same chains in two runs: events before a day, then those from it on, appended to the first run's heads."""
    e = table(spark, sf, "events")
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    heads = led.hash_chain(e.where(~late), ["user_id"], ["ts", "event_id"], "props")
    return led.hash_chain(e.where(late), ["user_id"], ["ts", "event_id"], "props", heads)


@register("W09_split_chronology", "SELECT split, min(d) AS first, max(d) AS last, count(*) AS n FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'tuning' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'held_out' END AS split, o_orderdate AS d FROM orders) GROUP BY 1")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    split = F.when(d < F.lit("1998-01-01").cast("timestamp_ntz"), "tuning").when(d < F.lit("2000-01-01").cast("timestamp_ntz"), "validation").otherwise("held_out")
    return table(spark, sf, "orders").groupBy(split.alias("split")).agg(F.min(d).alias("first"), F.max(d).alias("last"), F.count("*").alias("n"))


@register("S09_grouped_scan", "SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    odd = led.unsettled(table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority"]).select("o_custkey")
    return table(spark, sf, "orders").join(odd, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@register("S19_write_once", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return led.append_new(d.where("doc_id % 3 = 0"), d, "doc_id").select("doc_id")


@register("S22_logical_fingerprint", "SELECT source, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM (SELECT DISTINCT source, sha256(text) AS h FROM documents) GROUP BY 1")
def s22(spark: SparkSession, sf: str) -> DataFrame:
    h = F.array_join(F.array_sort(F.collect_set(F.sha2("text", 256))), "")
    return table(spark, sf, "documents").groupBy("source").agg(F.sha2(h, 256).alias("fingerprint"))


@register("H01_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def h01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@register("H02_canonical_json_hash", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id"), {"ignoreNullFields": "false"}), 256).alias("digest"))


@register("H03_uuid5")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", led.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("receipt_id"))


@register("H05_dedupe_key", "SELECT event_type, user_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, ts::DATE ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1, 2")
def h05(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return latest(e, ["event_type", "user_id", "day"], [F.col("ts"), F.col("event_id")]).groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@register("H06_replay_conflicts", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0")
def h06(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest"))
    again = o.withColumn("digest", F.when(F.col("o_orderkey") % 11 == 0, F.lit("changed")).otherwise(F.col("digest")))
    return led.conflicting_replays(o, again, "o_orderkey", "digest")


@register("H07_upsert_keep_old", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def h07(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return led.keep_old(c, c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW"))), "c_custkey", ["c_mktsegment"])


@register("H09_set_identity", "SELECT identity, count(*) AS n FROM (SELECT l_orderkey, sha256(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR)) AS identity FROM lineitem GROUP BY 1) GROUP BY 1")
def h09(spark: SparkSession, sf: str) -> DataFrame:
    who = F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sha2(who, 256).alias("identity")).groupBy("identity").agg(F.count("*").alias("n"))


@register("C02_due_date", "SELECT o_orderkey, o_orderdate::DATE + 30 AS due FROM orders")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 30).alias("due"))


@register("C05_quarter_path", "SELECT o_orderkey, year(o_orderdate)::INTEGER || '/QTR' || quarter(o_orderdate) AS path FROM orders")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.year("o_orderdate").cast("string"), F.lit("/QTR"), F.quarter("o_orderdate").cast("string")).alias("path"))


@register("C06_age_seconds", "SELECT event_id, ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 1000000)::BIGINT AS age_seconds FROM events")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.floor((micros(F.lit("2024-02-01")) - micros(F.col("ts"))) / 1_000_000).alias("age_seconds"))


@register("C07_strict_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "MM/dd/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    parsed = F.coalesce(*[F.try_to_timestamp("w", F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy")])
    return table(spark, sf, "orders").select("o_orderkey", written.alias("w")).select("o_orderkey", parsed.alias("day"))


@register("M02_json_path", "SELECT (props ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@register("M03_unnest_ordinality", "SELECT p_partkey, i::INTEGER AS i, w FROM (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i, unnest(string_split(p_name, ' ')) AS w FROM part)")
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))


@register("M04_containment", "SELECT user_id, ts::DATE AS day, list_has_all(['view', 'click', 'error', 'purchase'], list_distinct(list(event_type))) AS inside FROM events GROUP BY 1, 2")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.array(*[F.lit(x) for x in ("view", "click", "error", "purchase")])
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.size(F.array_except(F.collect_set("event_type"), allowed)) == 0).alias("inside"))


@register("M06_json_sum", "SELECT event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def m06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))
