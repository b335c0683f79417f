"""Documents to training bins: language ID, near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
any further columns of docs unchanged, whatever their names.  An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.durable import saved
from tidemark.llm.packing import pack
from tidemark.llm.rows import field, named
from tidemark.llm.simhash import representatives
from tidemark.llm.substring_dedup import remove_repeated_passages

CAPACITY = 8192
#: SQL can express neither the profiles nor the packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside one struct of all other columns, so that no name of docs meets one of an operator's results."""
    return docs.select(F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or unlike every profile, go.

    Null, empty and letterless texts are rejected; a single letter is enough to be judged, and texts are read whole.  A
    null lang is filled in, others are kept.  Repeated rows are judged alike and all stay; ties go to the first language
    in order.  Without any labelled text nothing can be told, so nothing stays.
    """
    profiles = langid.fit(docs.where(~langid.held_out()))
    told = langid.identify(_packed(docs), profiles).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0.5))
    lang = F.coalesce(F.col("row").getField("lang"), "lang_pred").alias("lang")
    return told.select(*["text" if c == "text" else lang if c == "lang" else field(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles are 80 % alike: the one of least doc_id.

    Null and empty texts are alike, so one of them stays; null ids come last; of ties and repeated rows one stays.
    """
    return representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand more than once are cut out; documents left as they are keep their white space.

    No document goes; a null text becomes empty, and one that is all repeated too.  A repeated row repeats itself.
    """
    out = remove_repeated_passages(_packed(docs), as_is=True)
    n_chars = F.length("kept_text").cast("long").alias("n_chars")
    return out.select(*[F.col("kept_text").alias("text") if c == "text" else n_chars if c == "n_chars" else field(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin and an offset for every piece of every document, by words; documents of one text never share a bin.

    Null and empty texts have one piece of size 0; null ids and sources are allowed; repeated rows are packed apart.
    """
    rows = docs.select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"), F.xxhash64("text").alias("cluster"))
    return pack(rows, F.col("n_words"), F.col("source"), F.col("cluster"), capacity=CAPACITY)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
