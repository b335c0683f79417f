"""Joins, ordered picks and identity rules over ledgers and queues."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def page(df: DataFrame, order: Sequence[F.Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a list; arguments out of bounds are refused before a plan is made."""
    if not 1 <= limit <= 500 or not 0 <= offset <= 100_000:
        raise ValueError("limit must be 1 to 500 and offset 0 to 100000")
    return df.orderBy(*order).offset(offset).limit(limit)


def substring_filter(df: DataFrame, text: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the text, whatever its case; no text keeps all."""
    if not text:
        return df
    if len(text) > 64 or not text.isprintable():
        raise ValueError("the query must be at most 64 printable characters")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
    return df.where(hit)


def argument_verdict(limit: F.Column, offset: F.Column, query: F.Column) -> F.Column:
    """The first bound that a page request breaks: 1 to 500 rows, an offset of 0 to 100,000, 64 printable characters at most."""
    odd = query.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\x{00A0}\x{3000}]")
    bounds = F.when(~F.coalesce(limit.between(1, 500), F.lit(False)), "limit_out_of_bounds").when(~F.coalesce(offset.between(0, 100_000), F.lit(False)), "offset_out_of_bounds")
    return bounds.when(F.length(query) > 64, "query_too_long").when(odd, "query_not_printable").otherwise("accepted")


def excluding(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Rows whose column is another value, which may itself be a column; null excludes nothing."""
    if isinstance(value, Column):
        return df.where(value.isNull() | (F.col(column) != value))
    return df if value is None else df.where(F.col(column) != value)


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str], tie: str) -> DataFrame:
    """As-of join: each left row with the values of the last right row of its key strictly before it.

    Both sides go into one ordered window, so a key costs a sort and no product of its rows.
    """
    struct = F.struct(*[F.col(v) for v in values])
    a = left.select(*keys, F.col(at).alias("at__"), F.lit(0).alias("side__"), F.lit(None).cast("long").alias("tie__"), F.struct(*left.columns).alias("left__"), F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType).alias("right__"))
    b = right.select(*keys, F.col(right_at).alias("at__"), F.lit(1).alias("side__"), F.col(tie).cast("long").alias("tie__"), F.lit(None).cast(a.schema["left__"].dataType).alias("left__"), struct.alias("right__"))
    w = Window.partitionBy(*keys).orderBy("at__", "side__", "tie__").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("found__", F.last("right__", ignorenulls=True).over(w)).where("side__ = 0")
    return both.select("left__.*", *[F.col("found__").getField(v).alias(f"prior_{v}") for v in values])


def first_session_from(events: DataFrame, calendar: DataFrame, at: str) -> DataFrame:
    """session_idx of the first session whose close is at or after each event, null after the last one.

    The calendar (a few hundred closes a year) is laid out by day and broadcast: each day with its own closes and the
    first session of a later day.  Events before the calendar look up its first day; no event is shuffled.
    """
    own = calendar.groupBy(F.to_date("close_at").alias("day__")).agg(F.array_sort(F.collect_list(F.struct("close_at", F.col("session_idx").cast("long").alias("idx")))).alias("closes__"))
    days = own.agg(F.min("day__").alias("a"), F.max("day__").alias("b")).select("a", F.explode(F.sequence("a", "b")).alias("day__"))
    later = Window.orderBy("day__").rowsBetween(1, Window.unboundedFollowing)
    laid = days.join(own, "day__", "left").withColumn("next__", F.min(F.col("closes__")[0]["idx"]).over(later))
    first = F.broadcast(days.select("a").distinct())
    e = events.crossJoin(first).withColumn("day__", F.greatest(F.to_date(at), F.col("a"))).join(F.broadcast(laid.drop("a")), "day__", "left")
    today = F.filter("closes__", lambda c: c["close_at"] >= F.col(at))
    return e.select(*events.columns, F.coalesce(F.get(today, 0)["idx"], F.col("next__")).alias("session_idx"))


def one_to_one(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """key and the names of the parts that lack it, for keys that some part lacks."""
    marked = [p.select(key, F.lit(i).alias("part__")) for i, p in enumerate(parts)]
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    found = every.groupBy(key).agg(F.array_sort(F.collect_set("part__")).alias("held"), F.count("*").alias("n"))
    return found.where((F.size("held") < len(parts)) | (F.col("n") > len(parts)))


def admit(waiting: DataFrame, active: DataFrame, key: str, order: Sequence[F.Column], capacity: int) -> DataFrame:
    """Rows let into a backlog of bounded size: not there yet, best first, as many as there is room for."""
    room = active.agg(F.greatest(F.lit(capacity) - F.count("*"), F.lit(0)).alias("room"))
    fresh = waiting.join(active.select(key), key, "left_anti").orderBy(*order).limit(capacity)
    ranked = fresh.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return ranked.crossJoin(F.broadcast(room)).where("place <= room").drop("room")


def unsettled(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree on a field."""
    out = df.groupBy(*keys).agg(*[F.countDistinct(f).alias(f) for f in fields])
    return out.where(F.greatest(*[F.col(f) for f in fields]) > 1) if len(fields) > 1 else out.where(F.col(fields[0]) > 1)


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not there yet: a replay adds nothing."""
    return incoming.join(existing.select(key), key, "left_anti")


def conflicting_replays(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that came again with other content."""
    return existing.select(key, F.col(digest).alias("before")).join(incoming.select(key, F.col(digest).alias("after")), key).where(~F.col("before").eqNullSafe(F.col("after"))).select(key)


def mismatches(recorded: DataFrame, again: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """keys, recorded, recomputed: receipts that the rule, run again, does not give."""
    both = recorded.select(*keys, F.col(field).alias("recorded")).join(again.select(*keys, F.col(field).alias("recomputed")), [*keys])
    return both.where(~F.col("recorded").eqNullSafe(F.col("recomputed")))


def sessions_after(calendar: DataFrame, day: str, horizons: Sequence[int]) -> DataFrame:
    """day, horizon, target_date: the session so many sessions later, null beyond the calendar's end (a row a day)."""
    numbered = calendar.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)))
    asked = numbered.select(day, "i", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    target = numbered.select(F.col(day).alias("target_date"), F.col("i").alias("j"))
    return asked.join(target, F.col("i") + F.col("horizon") == F.col("j"), "left").select(day, "horizon", "target_date")


def keep_old(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Upsert that overwrites with what is not null."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns])


def membership(events: DataFrame, cutoff: str) -> DataFrame:
    """Members as of a cutoff: the last action of each key that was recorded and effective by then adds it."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    known = events.where((F.col("recorded_at") <= at) & (F.col("effective_at") <= at))
    last = known.groupBy("key").agg(F.max_by("action", F.struct("recorded_at", "event_id")).alias("action"), F.count("*").alias("n_events"))
    return last.where("action = 'added'").drop("action")


def chain_violations(events: DataFrame) -> DataFrame:
    """Membership events out of turn: a chain starts with an addition and alternates."""
    w = Window.partitionBy("key").orderBy("recorded_at", "event_id")
    before = F.lag("action").over(w)
    rule = F.when(before.isNull() & (F.col("action") != "added"), "starts_with_removal").when(before == F.col("action"), "repeated_action")
    return events.withColumn("violation", rule).where("violation is not null")


def banded_queue(candidates: DataFrame, now: str, band: F.Column, at: str, key: str) -> DataFrame:
    """Queue order: rows a day old first, then by band, time of discovery and key.

    A row's place is its rank within its band and day plus the rows of all earlier bands and days, so no task holds the
    whole queue; the running total is over one row a band and day.
    """
    aged = F.col(at) <= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOUR")
    ranked = candidates.withColumns({"band": F.when(aged, 0).otherwise(band), "day__": F.to_date(at)})
    ranked = ranked.withColumn("nth__", F.row_number().over(Window.partitionBy("band", "day__").orderBy(at, key)))
    before = Window.orderBy("band", "day__").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranked.groupBy("band", "day__").agg(F.count("*").alias("n__")).select("band", "day__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("ahead__"))
    out = ranked.join(ahead, ["band", "day__"])
    return out.withColumn("place", F.col("nth__") + F.col("ahead__")).drop("day__", "nth__", "n__", "ahead__")


FIRST_LINK = "0" * 64


def _chain_task(n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, n, payload) in order: a chain's last head and length, of which only the present one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, where, head, n = None, None, FIRST_LINK, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*where.columns[:n_keys], pa.array([n], pa.int64()), pa.array([head])], names=[*where.schema.names[:n_keys], "n", "head"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            for i, (key, ahead, payload) in enumerate(zip(keys, batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist(), strict=True)):
                if key != now:
                    if where is not None:
                        yield done()
                    now, where, head, n = key, batch.slice(i, 1), FIRST_LINK, 0
                if ahead is None:
                    head, n = hashlib.sha256(f"{head}\n{payload}".encode()).hexdigest(), n + 1
                else:  # a chain that goes on: its saved length and head come before its new entries
                    head, n = payload, ahead
        if where is not None:
            yield done()

    return run


def hash_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str, heads: DataFrame | None = None) -> DataFrame:
    """keys, n, head: the head of each key's chain of SHA-256, in which every link covers the one before it.

    Entries pass through a task in order and only the head is carried, so a chain may be of any length.  `heads` is an
    earlier result: its chains go on with the entries of df, which come after all that they cover, and those without
    new entries stay.  Null payloads are no entries.
    """
    entry = df.where(F.col(payload).isNotNull()).select(*keys, F.lit(None).cast("long").alias("n"), F.col(payload).cast("string").alias("payload"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    if heads is not None:
        entry = entry.unionByName(heads.select(*keys, "n", F.col("head").alias("payload")), allowMissingColumns=True)
    placed = entry.repartition(*keys).sortWithinPartitions(*keys, F.col("n").desc_nulls_last(), *[f"_{i}" for i in range(len(order))]).select(*keys, "n", "payload")
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("n", T.LongType()), T.StructField("head", T.StringType())])
    return placed.mapInArrow(_chain_task(len(keys)), schema)


def ordered_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, between: str) -> DataFrame:
    """keys, n, digest: the SHA-256 of each key's texts in order, with `between` between them; only a digest is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, where, n, digest = None, None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*where.columns[:-1], pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=[*where.schema.names[:-1], "n", "digest"])

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for i, (*key, line) in enumerate(rows):
                if where is None or key != now:
                    if where is not None:
                        yield done()
                    now, where, n, digest = key, batch.slice(i, 1), 0, hashlib.sha256()
                digest.update(((between if n else "") + (line or "")).encode())
                n += 1
        if where is not None:
            yield done()

    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def uuid5(namespace_hex: str, name: F.Column) -> F.Column:
    """Name-based identifier (version 5) as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def lei_valid(code: F.Column) -> F.Column:
    """Checksum modulo 97 of a 20-character code: letters count 10 to 35, and the rest must be 1."""
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + digit(c)) % 97).otherwise((a * 100 + digit(c)) % 97)
    chars = F.filter(F.split(F.upper(code), ""), lambda c: c != "")
    return code.rlike("^[0-9A-Za-z]{18}[0-9]{2}$") & (F.aggregate(chars, F.lit(0), step) == 1)
