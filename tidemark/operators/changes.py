"""Changes between versions of documents, and novelty of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fold


def section_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change: added, removed or modified sections (column text); differences in white space or case do not count."""
    a = before.select(*keys, fold(F.col("text")).alias("old"))
    b = after.select(*keys, fold(F.col("text")).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"), "old", "new").where("change is not null")


def first_difference(a: F.Column, b: F.Column) -> F.Column:
    """Length of the common beginning of two texts, by halving: about log2(n) comparisons a row."""
    n = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.lit(float(1 << 30)) / F.pow(F.lit(2.0), i))
    grow = lambda k, s: F.when((k + s <= n) & (F.substr(a, F.lit(1), (k + s).cast("int")) == F.substr(b, F.lit(1), (k + s).cast("int"))), k + s).otherwise(k)
    return F.aggregate(steps, F.lit(0).cast("long"), lambda k, s: grow(k, s.cast("long")))


def manifest(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One hash over all sections of a document, in order of their selector."""
    entries = F.array_sort(F.collect_list(F.struct("selector", F.sha2("text", 256).alias("h"))))
    joined = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["selector"].cast("string"), e["h"])), "\n")
    return sections.groupBy(*keys).agg(F.count("*").alias("n_sections"), F.sha2(joined, 256).alias("manifest"))


def recent(events: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The last `limit` events of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seen_at"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
