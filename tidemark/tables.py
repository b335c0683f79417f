"""Driver tables and the typed frames that the operators run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt over all cores: a file of one row group is read by one task, which else has all work on its texts too."""
    return table(spark, sf_dir, "documents").repartition(3 * spark.sparkContext.defaultParallelism)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars made from line items: 20 instruments, one bar a day, with the two times at which a bar became known."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double") / 100.0
    rows = li.select(
        (F.col("l_suppkey") % 20).cast("int").alias("instrument_id"),
        F.to_date("l_shipdate").alias("session_date"),
        F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), price.alias("p")).alias("t"),
        F.col("l_quantity").alias("q"),
    )
    out = rows.groupBy("instrument_id", "session_date").agg(
        F.min("t").getField("p").alias("open"),
        F.max("t.p").alias("high"),
        F.min("t.p").alias("low"),
        F.max("t").getField("p").alias("close"),
        F.sum("q").cast("long").alias("volume"),
    )
    known = F.col("session_date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return out.select(
        "*",
        F.when(F.col("instrument_id") % 2 == 0, "USD").otherwise("CAD").alias("currency"),
        F.when(F.col("instrument_id") % 5 == 4, "unadjusted").otherwise("split_adjusted").alias("adjustment"),
        known.alias("available_at"),
        (known + F.expr("make_dt_interval(0, instrument_id % 3)")).alias("retrieved_at"),
    )


BARS = """bars AS (
  SELECT *, CASE WHEN instrument_id % 2 = 0 THEN 'USD' ELSE 'CAD' END AS currency,
         CASE WHEN instrument_id % 5 = 4 THEN 'unadjusted' ELSE 'split_adjusted' END AS adjustment,
         session_date::TIMESTAMP + INTERVAL 1 DAY AS available_at,
         session_date::TIMESTAMP + INTERVAL 1 DAY + to_hours(instrument_id % 3) AS retrieved_at
  FROM (SELECT (l_suppkey % 20)::INTEGER AS instrument_id, l_shipdate::DATE AS session_date, min(t).p AS open,
               max(t.p) AS high, min(t.p) AS low, max(t).p AS close, sum(q)::BIGINT AS volume
        FROM (SELECT *, {'k': l_orderkey * 8 + l_linenumber, 'p': floor(l_extendedprice * 100 / l_quantity) / 100.0::DOUBLE} AS t,
                     l_quantity AS q FROM lineitem WHERE l_quantity > 0)
        GROUP BY 1, 2))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts of issuers (customers): a value in cents by concept, with the times at which it became known."""
    o = table(spark, sf_dir, "orders")
    concept = F.element_at(F.array(*[F.lit(c) for c in ("assets", "liabilities", "revenue", "income", "equity")]), (F.substring("o_orderpriority", 1, 1)).cast("int"))
    quarter = F.to_date(F.date_trunc("quarter", F.col("o_orderdate")))
    end = F.date_sub(F.add_months(quarter, 3), 1)
    rows = o.select((F.col("o_custkey") % 100).alias("issuer"), concept.alias("concept"), end.alias("period_end"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    return rows.groupBy("issuer", "concept", "period_end").agg(F.sum("cents").alias("cents"), F.count("*").alias("n_sources"), F.max("o_orderkey").alias("source_key")).withColumn("available_at", F.date_add("period_end", 30 + (F.col("issuer") % 5).cast("int")))


FACTS = """facts AS (
  SELECT *, period_end + (30 + issuer % 5)::INTEGER AS available_at
  FROM (SELECT o_custkey % 100 AS issuer, ['assets', 'liabilities', 'revenue', 'income', 'equity'][left(o_orderpriority, 1)::INTEGER] AS concept,
               (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end,
               sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n_sources, max(o_orderkey) AS source_key
        FROM orders GROUP BY 1, 2, 3))"""


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream: a folder of part files, or one file, which a stream finds by its name in the folder."""
    whole = table(spark, sf_dir, name)
    reader = spark.readStream.schema(whole.schema)
    if whole.inputFiles()[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")
