"""Registered queries on routing, admissibility and invariants, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import ledger as led
from tidemark.operators import routing as ro
from tidemark.operators import scoring as sc
from tidemark.tables import BARS, bars, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@register("C01_utc_normalization", "SELECT event_id, ((epoch_us(ts) - 18000000000) // 1000)::BIGINT AS utc_ms FROM events")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    """Local times of a +05:00 zone as UTC milliseconds."""
    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "+05:00")
    return _events(spark, sf).select("event_id", F.unix_millis(utc).alias("utc_ms"))


@register("S10_grouped_scan_by_domain", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    odd = led.unsettled(o, ["o_custkey"], ["o_orderstatus"]).select("o_custkey")
    return o.join(odd, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("S21_response_identity", f"WITH {BARS} SELECT instrument_id, session_date, close FROM bars WHERE instrument_id = 7 AND currency = 'CAD'")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    """A provider's JSON response, kept only if it answers for the instrument and currency that were asked."""
    b = bars(spark, sf)
    said = b.select(F.to_json(F.struct("instrument_id", "currency", F.col("session_date").cast("string").alias("day"), "close")).alias("value"))
    r = said.select(F.from_json("value", "instrument_id int, currency string, day string, close double").alias("r")).select("r.*")
    return r.where("instrument_id = 7 and currency = 'CAD'").select("instrument_id", F.to_date("day").alias("session_date"), "close")


@register("R10_routing_contexts", "SELECT o_custkey, string_agg(DISTINCT CASE o_orderstatus WHEN 'F' THEN 'ownership' WHEN 'O' THEN 'financing' ELSE 'accounting' END, ',' ORDER BY CASE o_orderstatus WHEN 'F' THEN 'ownership' WHEN 'O' THEN 'financing' ELSE 'accounting' END) AS contexts FROM orders GROUP BY 1")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    context = sc.first_true([("ownership", s == "F"), ("financing", s == "O")], "accounting")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(context)), ",").alias("contexts"))


_PRIOR = "(SELECT *, lag(o_orderpriority) OVER w AS bk, lag(o_orderdate) OVER w AS bt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


@register("D03_relationship", f"SELECT o_orderkey, CASE WHEN bk IS NULL THEN 'no_base' WHEN bt >= o_orderdate THEN 'base_is_later' WHEN bk = o_orderpriority THEN 'amends' ELSE 'other_kind' END AS relationship FROM {_PRIOR}")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumns({"bk": F.lag("o_orderpriority").over(w), "bt": F.lag("o_orderdate").over(w)})
    return o.select("o_orderkey", ro.relationship(F.col("bk"), F.col("o_orderpriority"), F.col("bt"), F.col("o_orderdate")).alias("relationship"))


@register("K03_retroactive_rows", "SELECT day, count(*) AS recorded, count(*) FILTER (ts - to_hours((event_id % 72)::BIGINT) <= day) AS effective_before FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY 1")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    effective = F.col("ts") - F.expr("make_dt_interval(0, cast(event_id % 72 as int))")
    e = _events(spark, sf).withColumns({"day": F.to_date("ts"), "effective": effective})
    return e.groupBy("day").agg(F.count("*").alias("recorded"), F.count_if(F.col("effective") <= F.col("day").cast("timestamp_ntz")).alias("effective_before"))


@register("V03_recomputed_returns", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE abs(round(l_extendedprice * 100)::BIGINT - round(round(l_extendedprice / l_quantity, 2) * l_quantity * 100)::BIGINT) > 20")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    again = F.round(unit * F.col("l_quantity") * 100).cast("long")
    return table(spark, sf, "lineitem").where(F.abs(F.round(F.col("l_extendedprice") * 100).cast("long") - again) > 20).select("l_orderkey", "l_linenumber", "l_partkey")


