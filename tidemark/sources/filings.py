"""Parsers of semi-structured sources: lines, JSON with parallel arrays or nested maps, XML, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = "instrument_id int, session_date date, open double, high double, low double, close double, volume bigint"
FACT = "map<string,map<string,struct<label:string,units:map<string,array<struct<`end`:string,val:bigint,accn:string>>>>>>"


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """CSV bars; a header with other columns is an error, a bad value too."""
    return spark.read.schema(BAR_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def csv_bars(lines: DataFrame) -> DataFrame:
    """Bars of CSV lines (file, line, value): files whose header is not the expected one, and lines with bad values, give none."""
    names = [f.split()[0] for f in BAR_SCHEMA.split(", ")]
    good = lines.where("line = 0").where(F.array_sort(F.split("value", ",")) == F.array_sort(F.array(*[F.lit(n) for n in names])))
    order = good.select("file", F.split("value", ",").alias("names"))
    cells = lines.where("line > 0").join(order, "file").select("file", "names", F.split("value", ",").alias("cells")).where(F.size("cells") == len(names))
    at = lambda n: F.get("cells", F.array_position("names", F.lit(n)).cast("int") - 1)
    rows = cells.select(*[at(f.split()[0]).try_cast(f.split()[1]).alias(f.split()[0]) for f in BAR_SCHEMA.split(", ")])
    return rows.na.drop()


def historical_cases(documents: DataFrame) -> DataFrame:
    """dataset, case_id, label, horizon_days, asset_return, status of JSON datasets (universe, predictions, outcomes)."""
    d = F.from_json("value", "dataset_name string, expected_universe_count bigint, universe array<struct<case_id:string>>, predictions array<struct<case_id:string,label:string,horizon_days:int>>, outcomes array<struct<case_id:string,asset_return:decimal(18,4)>>")
    x = documents.select(d.alias("d")).where(F.col("d.expected_universe_count") == F.size("d.universe"))
    part = lambda c: x.select(F.col("d.dataset_name").alias("dataset"), F.explode(f"d.{c}").alias("x")).select("dataset", "x.*")
    j = part("universe").join(part("predictions"), ["dataset", "case_id"], "left").join(part("outcomes"), ["dataset", "case_id"], "left")
    return j.withColumn("status", F.when(F.col("label").isNull(), "no_prediction").when(F.col("asset_return").isNull(), "no_outcome").otherwise("complete"))


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document over many lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def index_lines(lines: DataFrame, forms: tuple[str, ...], names: DataFrame) -> DataFrame:
    """cik|name|form|date|path lines of the wanted forms whose path names their cik, joined with known names."""
    f = F.split("value", r"\|")
    rows = lines.where(F.size(f) == 5).select(F.try_element_at(f, F.lit(1)).try_cast("bigint").alias("cik"), f[1].alias("company"), F.trim(f[2]).alias("form"), F.try_to_date(f[3], "yyyy-MM-dd").alias("filed"), f[4].alias("path"))
    good = F.col("form").isin(*forms) & F.col("filed").isNotNull() & (F.regexp_extract("path", r"^data/([0-9]+)/", 1) == F.col("cik").cast("string"))
    return rows.where(good).join(names, "cik")


def ticker_map(documents: DataFrame) -> DataFrame:
    """{"fields": [...], "data": [[cik, name, ticker], ...]}: the first valid ticker of each cik."""
    parsed = documents.select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("d"))
    rows = parsed.select(F.col("d.fields").alias("fields"), F.posexplode("d.data").alias("pos", "row"))
    at = lambda name: F.get("row", F.array_position("fields", F.lit(name)).cast("int") - 1)
    rows = rows.select(at("cik").try_cast("bigint").alias("cik"), F.upper(at("ticker")).alias("ticker"), "pos").where(F.col("ticker").rlike("^[A-Z][A-Z0-9.-]{0,9}$"))
    return rows.groupBy("cik").agg(F.min_by("ticker", "pos").alias("ticker"))


def submissions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filings out of parallel arrays, and the documents whose arrays differ in length."""
    schema = "cik bigint, accession array<string>, form array<string>, filed array<string>"
    d = documents.select(F.from_json("value", schema).alias("d")).select("d.*")
    same = (F.size("accession") == F.size("form")) & (F.size("form") == F.size("filed"))
    rows = d.where(same).select("cik", F.posexplode(F.arrays_zip("accession", "form", "filed")).alias("pos", "x")).select("cik", "pos", "x.accession", "x.form", F.to_date("x.filed").alias("filed"))
    return rows, d.where(~F.coalesce(same, F.lit(False))).select("cik")


def latest_submission(filings: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """First filing of a wanted form in each issuer's list."""
    return filings.where(F.col("form").isin(*forms)).groupBy("cik").agg(F.min_by("accession", "pos").alias("accession"))


def only_accession(filings: DataFrame, wanted: DataFrame) -> DataFrame:
    """accession, status: found once, missing or ambiguous."""
    n = filings.groupBy("accession").agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return wanted.join(n, "accession", "left").select("accession", status.alias("status"))


def company_facts(documents: DataFrame) -> DataFrame:
    """Taxonomy, tag, unit and fact out of three levels of maps; a fact without an end or value is skipped."""
    d = documents.select(F.from_json("value", f"cik bigint, facts {FACT}").alias("d")).select("d.cik", F.explode("d.facts").alias("taxonomy", "tags"))
    d = d.select("cik", "taxonomy", F.explode("tags").alias("tag", "c")).select("cik", "taxonomy", "tag", F.explode("c.units").alias("unit", "f"))
    d = d.select("cik", "taxonomy", "tag", "unit", F.inline("f"))
    return d.where("`end` is not null and val is not null").select("cik", "taxonomy", "tag", "unit", F.to_date("end").alias("period_end"), "val", "accn")


def ownership_xml(documents: DataFrame) -> DataFrame:
    """Transactions of ownership documents; one that declares a document type or entities is refused."""
    schema = T._parse_datatype_string("issuer bigint, transaction array<struct<code:string,shares:bigint>>")
    safe = documents.where(~F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)"))
    return safe.select(F.from_xml("value", schema).alias("d")).select(F.col("d.issuer").alias("issuer"), F.inline("d.transaction"))


def licensed(documents: DataFrame, as_of: str) -> DataFrame:
    """Licensed disclosures with the gate that lets each in or keeps it out."""
    d = documents.select(F.from_json("value", "id bigint, rights struct<mode:string,expires_on:string>, language string").alias("d")).select("d.*")
    gate = F.when(F.col("rights.mode") != "authorized", "not_authorized").when(F.to_date("rights.expires_on") < F.lit(as_of).cast("date"), "expired").when(~F.col("language").isin("en", "fr"), "language").otherwise("admitted")
    return d.select("id", gate.alias("gate"))
