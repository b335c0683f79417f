"""Registered queries over daily bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import indicators as ind
from tidemark.operators import pit
from tidemark.tables import BARS, bars

CUTOFF = "2000-01-01 00:00:00"


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("S02_bar_scan", f"WITH {BARS} SELECT instrument_id, session_date, close, volume FROM bars WHERE instrument_id = 3 AND session_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND currency = 'CAD' AND available_at <= TIMESTAMP '{CUTOFF}' AND retrieved_at <= TIMESTAMP '{CUTOFF}'")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return pit.bar_scan(bars(spark, sf), 3, "1996-01-01", "1999-12-31", "CAD", "split_adjusted", CUTOFF).select("instrument_id", "session_date", "close", "volume")


@register("S04_series_quality", f"WITH {BARS}, r AS (SELECT unnest(range(0, 25))::INTEGER AS instrument_id) SELECT r.instrument_id, count(session_date) AS n, min(session_date) AS first_day, max(session_date) AS last_day, max(available_at) AS latest, CASE WHEN count(session_date) = 0 THEN 'no_data' WHEN max(available_at) < TIMESTAMP '{CUTOFF}' - INTERVAL 5 DAY THEN 'stale' ELSE 'current' END AS freshness FROM r LEFT JOIN (SELECT * FROM bars WHERE available_at <= TIMESTAMP '{CUTOFF}' AND retrieved_at <= TIMESTAMP '{CUTOFF}') USING (instrument_id) GROUP BY 1")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.range(25).select(F.col("id").cast("int").alias("instrument_id"))
    return pit.series_quality(asked, bars(spark, sf), CUTOFF, 5)


@register("S05_bar_violations", f"WITH {BARS} SELECT 'unknown_instrument' AS violation, instrument_id, count(*) AS n FROM bars WHERE instrument_id >= 18 GROUP BY 2 UNION ALL SELECT 'inactive_day', instrument_id, count(*) FROM bars WHERE instrument_id < 18 AND session_date < DATE '1995-01-01' + instrument_id * 30 GROUP BY 2 UNION ALL SELECT 'duplicate_key', 3, 0 WHERE false")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.range(18).select(F.col("id").cast("int").alias("instrument_id"), F.expr("date_add(DATE '1995-01-01', cast(id * 30 as int))").alias("active_from"))
    return pit.bar_violations(bars(spark, sf), known)


@register("V04_ohlc_violations", f"WITH {BARS} SELECT CASE WHEN high < greatest(open, close) THEN 'high' WHEN low > least(open, close) THEN 'low' WHEN volume <= 0 THEN 'volume' ELSE 'none' END AS violation, count(*) AS n FROM bars GROUP BY 1")
def v04(spark: SparkSession, sf: str) -> DataFrame:
    return pit.ohlc_violations(bars(spark, sf))


@register("T01_cumulative_return", f"WITH {BARS} SELECT instrument_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(arg_max(close, session_date) / arg_min(close, session_date) - 1, 6) END AS value, CASE WHEN count(*) >= 2 THEN 'ok' ELSE 'insufficient_bars' END AS status FROM bars GROUP BY 1")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.cumulative_return(bars(spark, sf)), "value")


@register("T02_simple_returns", f"WITH {BARS} SELECT * FROM (SELECT instrument_id, session_date, round(close / lag(close) OVER (PARTITION BY instrument_id ORDER BY session_date) - 1, 6) AS value FROM bars) WHERE value IS NOT NULL")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.simple_returns(bars(spark, sf)), "value")


@register("T03_sma", f"WITH {BARS} SELECT instrument_id, session_date, value FROM (SELECT instrument_id, session_date, round(avg(close) OVER w, 4) AS value, count(*) OVER w AS k FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE k = 20")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    return ind.sma(bars(spark, sf), 20).withColumn("value", F.round("value", 4))


def _fold(expression: str, n: int, weight: str) -> str:
    return f"list_reduce(list_concat([list_sum({expression}[1:{n}]) / {n}], {expression}[{n + 1}:]), lambda a, x: a + ({weight}) * (x - a))"


_LISTS = f"{BARS}, moves AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument_id ORDER BY session_date) AS move, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY instrument_id ORDER BY session_date)), abs(low - lag(close) OVER (PARTITION BY instrument_id ORDER BY session_date))) AS tr FROM bars), lists AS (SELECT instrument_id, max(session_date) AS session_date, list(close ORDER BY session_date) AS c, list(greatest(move, 0) ORDER BY session_date) FILTER (move IS NOT NULL) AS up, list(greatest(-move, 0) ORDER BY session_date) FILTER (move IS NOT NULL) AS down, list(tr ORDER BY session_date) FILTER (move IS NOT NULL) AS tr FROM moves GROUP BY 1)"


def _last(df: DataFrame, *columns: str) -> DataFrame:
    """Last value of each instrument's series, rounded."""
    picked = [F.round(F.max_by(c, "session_date"), 4).alias(c) for c in columns]
    return df.groupBy("instrument_id").agg(F.max("session_date").alias("session_date"), *picked)


@register("T04_ema", f"WITH {_LISTS} SELECT instrument_id, session_date, round({_fold('c', 12, '2.0 / 13')}, 4) AS value FROM lists WHERE len(c) >= 12")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return _last(ind.ema(bars(spark, sf), 12), "value")


@register("T05_rsi", f"WITH {_LISTS} SELECT instrument_id, session_date, round(CASE WHEN d = 0 AND u = 0 THEN 50 WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END, 4) AS value FROM (SELECT *, {_fold('up', 14, '1.0 / 14')} AS u, {_fold('down', 14, '1.0 / 14')} AS d FROM lists WHERE len(c) >= 15)")
def t05(spark: SparkSession, sf: str) -> DataFrame:
    return _last(ind.rsi(bars(spark, sf), 14), "value")


@register("T06_macd")
def t06(spark: SparkSession, sf: str) -> DataFrame:
    return _last(ind.macd(bars(spark, sf), 12, 26, 9), "line", "signal", "histogram")


@register("T07_true_range", f"WITH {BARS} SELECT instrument_id, session_date, round(greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)), 6) AS value FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date)")
def t07(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.true_range(bars(spark, sf)), "value")


@register("T08_atr", f"WITH {_LISTS} SELECT instrument_id, session_date, round({_fold('tr', 14, '1.0 / 14')}, 4) AS value FROM lists WHERE len(c) >= 15")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    return _last(ind.atr(bars(spark, sf), 14), "value")


_RETURNS = f"{BARS}, r AS (SELECT instrument_id, session_date, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY session_date) - 1 AS x FROM bars)"


@register("T09_volatility", f"WITH {_RETURNS} SELECT instrument_id, round(CASE WHEN count(x) >= 2 THEN stddev_samp(x) * sqrt(252) END, 6) AS value FROM r WHERE x IS NOT NULL GROUP BY 1")
def t09(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.volatility(bars(spark, sf), 252), "value")


@register("T10_relative_volume", f"WITH {BARS}, r AS (SELECT *, avg(volume) OVER (PARTITION BY instrument_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY instrument_id ORDER BY session_date) AS i, row_number() OVER (PARTITION BY instrument_id ORDER BY session_date DESC) AS back FROM bars) SELECT instrument_id, CASE WHEN adjustment = 'split_adjusted' AND i > 20 THEN round(volume / m, 6) END AS value, CASE WHEN adjustment <> 'split_adjusted' THEN 'unadjusted' WHEN i <= 20 THEN 'insufficient_bars' ELSE 'ok' END AS status FROM r WHERE back = 1")
def t10(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.relative_volume(bars(spark, sf), 20), "value")


@register("T11_range_position", f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY session_date DESC) AS back FROM bars) SELECT instrument_id, round(CASE WHEN count(*) = 20 AND max(close) > min(close) THEN (max(CASE WHEN back = 1 THEN close END) - min(close)) / (max(close) - min(close)) END, 6) AS value, CASE WHEN count(*) < 20 THEN 'insufficient_bars' WHEN max(close) = min(close) THEN 'flat_range' ELSE 'ok' END AS status FROM r WHERE back <= 20 GROUP BY 1")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.range_position(bars(spark, sf), 20), "value")


@register("T12_maximum_drawdown", f"WITH {BARS} SELECT instrument_id, round(min(d), 6) AS value FROM (SELECT instrument_id, close / max(close) OVER (PARTITION BY instrument_id ORDER BY session_date) - 1 AS d FROM bars) GROUP BY 1")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.maximum_drawdown(bars(spark, sf)), "value")


_MATCHED = f"{BARS}, m AS (SELECT a.instrument_id, a.session_date, a.close, b.close AS bench FROM bars a JOIN bars b ON a.session_date = b.session_date AND b.instrument_id = 0 WHERE a.instrument_id <> 0)"


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every = bars(spark, sf)
    return every.where("instrument_id <> 0"), every.where("instrument_id = 0")


@register("J01_matched_sessions", f"WITH {_MATCHED} SELECT instrument_id, count(*) AS n, min(session_date) AS first_day, max(session_date) AS last_day FROM m GROUP BY 1")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return ind.matched(*_pair(spark, sf)).groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))


@register("T13_relative_return", f"WITH {_MATCHED} SELECT instrument_id, round(arg_max(close, session_date) / arg_min(close, session_date) - arg_max(bench, session_date) / arg_min(bench, session_date), 6) AS value FROM m GROUP BY 1")
def t13(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.relative_return(*_pair(spark, sf)), "value")


@register("T14_beta", f"WITH {_MATCHED}, r AS (SELECT instrument_id, close / lag(close) OVER w - 1 AS a, bench / lag(bench) OVER w - 1 AS b FROM m WINDOW w AS (PARTITION BY instrument_id ORDER BY session_date)) SELECT instrument_id, round(covar_samp(a, b) / var_samp(b), 6) AS value, 'ok' AS status FROM r WHERE a IS NOT NULL GROUP BY 1")
def t14(spark: SparkSession, sf: str) -> DataFrame:
    return _six(ind.beta(*_pair(spark, sf)), "value")


@register("T15_eligibility", f"WITH {BARS} SELECT instrument_id, count(*) AS n, CASE WHEN count(*) < 50 THEN 'insufficient_bars' WHEN max(adjustment) = 'unadjusted' THEN 'unadjusted' WHEN date_diff('day', max(session_date), DATE '2001-11-06') > 5 THEN 'stale' ELSE 'eligible' END AS status FROM bars GROUP BY 1")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    return ind.eligibility(bars(spark, sf), "2001-11-06", 50, 5)


@register("T16_lineage", f"WITH {BARS} SELECT instrument_id, count(*) AS n_inputs, sha256(string_agg(session_date::VARCHAR || ',' || floor(close * 100 + 0.5)::BIGINT::VARCHAR, ';' ORDER BY session_date)) AS inputs_sha256 FROM bars GROUP BY 1")
def t16(spark: SparkSession, sf: str) -> DataFrame:
    return ind.lineage(bars(spark, sf))
