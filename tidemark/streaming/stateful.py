"""Stateful operators, each with a batch form over a table and a Structured Streaming form over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.shared import new_path

DECISIONS = "user_id long, event_id long, admitted boolean, retry_after_s double"


def admissions(seconds: Iterable[float], window_s: float, limit: int, held: list[float]) -> list[tuple[bool, float]]:
    """Sliding-window limiter: (admitted, seconds until a retry can pass) for each request time, in order.

    `held` are the admitted times still in the window, and is brought up to date; refused requests leave no trace.
    """
    out = []
    for now in seconds:
        while held and held[0] <= now - window_s:
            held.pop(0)
        if len(held) < limit:
            held.append(now)
            out.append((True, 0.0))
        else:
            out.append((False, held[0] + window_s - now))
    return out


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("int64") / (1e9 if str(ts.dtype).endswith("[ns]") else 1e6)


def _decided(pdf: pd.DataFrame, window_s: float, limit: int, held: list[float]) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "event_id"])
    verdicts = admissions(_seconds(pdf["ts"]), window_s, limit, held)
    return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "admitted": [a for a, _ in verdicts], "retry_after_s": [round(s, 3) for _, s in verdicts]})


def ordered_fold(df: DataFrame, key: str, order: Sequence[str], decide: Callable[[pd.DataFrame, list[float]], pd.DataFrame], schema: str) -> DataFrame:
    """decide over each key's rows in order, batch by batch: a task holds a batch and the one list that a key carries on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for k, part in batch.groupby(key, sort=False):
                if k != now:
                    now, held = k, []
                yield decide(part, held)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def limit_batch(events: DataFrame, window_s: float, limit: int) -> DataFrame:
    """Decisions of the limiter over a whole table; a key carries at most `limit` times from row to row."""
    return ordered_fold(events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], lambda part, held: _decided(part, window_s, limit, held), DECISIONS)


def limit_stream(events: DataFrame, window_s: float, limit: int) -> DataFrame:
    """The same decisions over a stream; state holds at most `limit` times a key and goes after an idle window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        whole = pd.concat(list(batches))
        yield _decided(whole, window_s, limit, held)
        state.update((held,))
        state.setTimeoutDuration(int(window_s * 1000))

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, DECISIONS, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def capped(seconds: Iterable[float], caps: Sequence[tuple[float, int]], held: list[float] | None = None) -> list[bool]:
    """Whether each call, in order, stays within all caps (window in seconds, calls admitted in it).

    held are the admitted times in order, of which the last ones still count; it is brought up to date.
    """
    held, out, most = [] if held is None else held, [], max(n for _, n in caps)
    for now in seconds:
        # a cap is full when its n-th last admitted call is still in its window
        out.append(all(len(held) < n or held[-n] <= now - w for w, n in caps))
        if out[-1]:
            held.append(now)
            del held[:-most]
    return out


def capped_batch(events: DataFrame, caps: Sequence[tuple[float, int]]) -> DataFrame:
    """user_id, event_id, admitted under several caps at once; a key carries as many times as the largest cap."""

    def decide(part: pd.DataFrame, held: list[float]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": part["user_id"], "event_id": part["event_id"], "admitted": capped(part["s"], caps, held)})

    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return ordered_fold(events.select("user_id", "event_id", seconds.alias("s")), "user_id", ["s", "event_id"], decide, "user_id long, event_id long, admitted boolean")


def terminal_status(attempts: DataFrame, job: str, attempt: str, ok: F.Column, most: int) -> DataFrame:
    """job, status, first_ok, delay: completed at the first success, failed after `most` attempts, else waiting for a retry."""
    by = attempts.groupBy(job).agg(F.max(attempt).alias("n"), F.min(F.when(ok, F.col(attempt))).alias("first_ok"))
    done, spent = F.col("first_ok").isNotNull(), F.col("n") >= most
    delay = F.least(F.lit(86_400), F.lit(300) * F.pow(F.lit(2), F.col("n") - 1)).cast("long")
    return by.select(job, F.when(done, "completed").when(spent, "failed").otherwise("retry_wait").alias("status"), "first_ok", F.when(~done & ~spent, delay).alias("delay"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts in sliding event-time windows; on a stream, rows later than the watermark are dropped."""
    w = F.window("ts", size, slide)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def append_once(path: str, key: str):
    """foreachBatch sink that appends only keys not yet there, so a batch that is run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def governor(readings: DataFrame, keys: list[str], high: float, low: float, calm: int) -> DataFrame:
    """Hysteresis: a reading of `high` or more pauses; `calm` readings in a row of `low` or less resume.

    keys, event_id, state after each reading.  It is paused while the last high reading is later than the last one that
    ended `calm` quiet ones, so two ordered windows tell it and no key is gathered.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = readings.select(*keys, "ts", "event_id", "value", F.row_number().over(w).alias("i"))
    last = lambda when: F.max(F.when(when, F.col("i"))).over(so_far)
    r = r.withColumns({"loud": last(~(F.col("value") <= low)), "hot": last(F.col("value") >= high)})
    r = r.withColumn("calmed", last(F.col("i") - F.coalesce("loud", F.lit(0)) >= calm))
    paused = F.col("hot").isNotNull() & (F.coalesce("calmed", F.lit(0)) < F.col("hot"))
    return r.select(*keys, "event_id", F.when(paused, "paused").otherwise("running").alias("state"))


class Governor(StatefulProcessor):
    """The same rule over a stream: readings wait until the watermark has passed them, then count in order of time."""

    def __init__(self, high: float, low: float, calm: int) -> None:
        self.high, self.low, self.calm = high, low, calm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, value double")
        self.now = handle.getValueState("now", "paused boolean, quiet int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            came = list(zip(batch["us"].tolist(), batch["event_id"].tolist(), batch["value"].tolist(), strict=True))
            self.waiting.appendList(came)
            first = min(us for us, *_ in came) if first is None else min(first, min(us for us, *_ in came))
        self._wake(first)
        return iter(())

    def _wake(self, us: int | None) -> None:
        """One timer for the earliest reading that waits; when it runs, what still waits sets the next."""
        if us is not None:
            self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready = [r for r in rows if r[0] < passed]
        if not ready:
            return
        paused, quiet = self.now.get() if self.now.exists() else (False, 0)
        states = []
        for _, _, value in ready:
            paused, quiet = governed(paused, quiet, value, self.high, self.low, self.calm)
            states.append("paused" if paused else "running")
        self.now.update((paused, quiet))
        self.waiting.clear()
        if left := rows[len(ready) :]:
            self.waiting.put(left)
            self._wake(left[0][0])
        yield pd.DataFrame({"key": [key[0]] * len(ready), "event_id": [r[1] for r in ready], "state": states})

    def close(self) -> None:
        pass


def governed(paused: bool, quiet: int, value: float | None, high: float, low: float, calm: int) -> tuple[bool, int]:
    """State and run of quiet readings after one more; a missing value counts as quiet, NaN as high."""
    if value is None:
        hot, loud = False, False
    else:
        hot, loud = value >= high or value != value, not value <= low
    quiet = 0 if loud else quiet + 1
    return (True if hot else paused) and quiet < calm, quiet


def governor_stream(readings: DataFrame, key: str, high: float, low: float, calm: int, late: str) -> DataFrame:
    """key, event_id, state of a stream (key, ts, event_id, value): the rows of `governor`, whatever order readings come in.

    A reading counts once the watermark, `late` behind the newest one, has passed it; readings later than that are
    dropped.  State is a flag, a count and what still waits.  It needs a state store that keeps timers
    (spark.sql.streaming.stateStore.providerClass: the RocksDB one).
    """
    rows = readings.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", "event_id", F.col("value").cast("double").alias("value"), F.unix_micros("ts").alias("us"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(Governor(high, low, calm), f"key {kind}, event_id long, state string", "append", "eventTime")
    return out.withColumnRenamed("key", key)


def timer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep timers and have a state store a core; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All that a stream gives for what its source holds now, as a table in the shared folder."""
    path = new_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def lease_recovery(jobs: DataFrame, now: str, lease: str, most: int) -> DataFrame:
    """Jobs whose lease ran out wait for a retry, or fail once their attempts are used up."""
    expired = (F.col("status") == "processing") & (F.col("claimed_at") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {lease}"))
    return jobs.withColumn("status", F.when(expired & (F.col("attempts") >= most), "failed").when(expired, "retry_wait").otherwise(F.col("status")))


def illegal_transitions(log: DataFrame, allowed: dict[str, tuple[str, ...]], first: str) -> DataFrame:
    """Log rows whose status may not follow the one before it."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("job").orderBy("ts", "event_id")), F.lit(first))
    legal = F.lit(False)
    for a, b in allowed.items():
        legal = legal | ((F.col("before") == a) & F.col("status").isin(*b))
    return log.withColumn("before", before).where(~legal)
