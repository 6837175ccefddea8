"""Idempotent append of an at-least-once stream, with bad rows set aside.

Nothing is judged by its age: a row delivered late is as good as any other. What
is known of a key, whether a row of it is stored and how often rows of it were
rejected, lies in the state store of the streaming query, so a micro-batch
looks up its own keys and never reads what earlier ones wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from surveyloom.functions.numeric import col
from surveyloom.functions.ordering import latest, row_text

# Fixed value: how often a row may be rejected before it is given up.
MAX_ATTEMPTS = 5

KEY_PARTS = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAME = T.StructType([T.StructField("key", T.StringType())])
_STATE = T.StructType([T.StructField("stored", T.BooleanType()), T.StructField("attempts", T.LongType())])
_OWN = ("_part", "_key", "_ok", "_tie", "_times")


@dataclass
class AppendSink:
    """Where accepted and rejected rows go, how rows are recognised, and in how many parts keys are looked up.

    The checkpoint holds what is known of keys; ``parts`` stays as it was when the checkpoint began.
    """

    table: str
    quarantine: str
    checkpoint: str
    key: str = "client_key"
    at: str = "created_at"
    source_app: str = "app"
    parts: int = KEY_PARTS


def tagged(df: DataFrame, source_app: str) -> DataFrame:
    """Every row names the application it came from; a missing name gets the default."""
    named = F.coalesce(F.col("source_app"), F.lit(source_app)) if "source_app" in df.columns else F.lit(source_app)
    return df.withColumn("source_app", named)


def timed(df: DataFrame, at: str) -> DataFrame:
    """The time as a timestamp, null where it cannot be read, and its text as delivered in ``<at>_raw``."""
    return df.withColumn(f"{at}_raw", col(at).cast("string")).withColumn(at, col(at).try_cast("timestamp"))


def _earlier(row: tuple, than: tuple) -> bool:
    """Whether (time, tie) comes first; no time comes last."""
    return (row[0] is None, row[0], row[1]) < (than[0] is None, than[0], than[1]) if (row[0] is None) == (than[0] is None) else than[0] is None


def _fewer(at: int):
    """Of the rows in one batch that share a key and a judgement, the earliest, with how many there were in ``_times``.

    It does for the shuffle what a partial aggregate does: a key that a third of
    all rows have leaves a task as two rows a batch.
    """
    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            keys, good, ties = (batch.column(names.index(c)).to_pylist() for c in ("_key", "_ok", "_tie"))
            times = batch.column(at).to_pylist()
            kept, count = {}, {}
            for i, key in enumerate(keys):
                same = (key, good[i]) if key is not None else (None, i)
                first = kept.setdefault(same, i)
                count[same] = count.get(same, 0) + 1
                if first != i and _earlier((times[i], ties[i]), (times[first], ties[first])):
                    kept[same] = i
            rows = batch.take(pa.array(list(kept.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([count[k] for k in kept], pa.int64())], names=names)
    return fewer


class Ledger(StatefulProcessor):
    """Lets the first accepted row of a key through, and rejected rows with their rejections so far."""

    def __init__(self, columns: list[str], at: str):
        self.columns, self.at = columns, at

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", _NAME, _STATE)

    def _row(self, row: Row, good: bool, attempts: int | None) -> Row:
        return Row(**{c: row[c] for c in self.columns}, _ok=good, attempts=attempts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names that Spark calls
        first: dict[tuple[str, bool], Row] = {}
        rejected: dict[str, int] = {}
        for row in rows:
            if row["_key"] is None:  # nothing is known of rows without a key
                yield self._row(row, row["_ok"], None if row["_ok"] else 1)
                continue
            same = (row["_key"], row["_ok"])
            before = first.get(same)
            if before is None or _earlier((row[self.at], row["_tie"]), (before[self.at], before["_tie"])):
                first[same] = row
            if not row["_ok"]:
                rejected[row["_key"]] = rejected.get(row["_key"], 0) + row["_times"]
        for name in dict.fromkeys(k for k, _ in first):
            state = self.known.getValue((name,)) if self.known.containsKey((name,)) else None
            stored, attempts = (bool(state[0]), int(state[1])) if state is not None else (False, 0)
            good = first.get((name, True))
            if good is not None and not stored:
                yield self._row(good, True, None)
            now = attempts + rejected.get(name, 0)
            if now > attempts:
                yield self._row(first[(name, False)], False, now)
            if (good is not None and not stored) or now > attempts:
                self.known.updateValue((name,), (stored or good is not None, now))

    def close(self) -> None:
        pass


def judged(rows: DataFrame, sink: AppendSink, valid: Column) -> DataFrame:
    """The rows of a stream that are new or rejected: ``_ok`` tells which, ``attempts`` how often a key was rejected."""
    columns = rows.columns
    accepted = F.coalesce(valid, F.lit(False)) & col(sink.at).isNotNull()
    tie, key = F.xxhash64(row_text(rows)), col(sink.key).cast("string")
    # Rows without a key meet nobody, so they are dealt out by their contents.
    part = F.pmod(F.xxhash64(F.coalesce(key, tie.cast("string"))), F.lit(sink.parts)).cast("int")
    marked = rows.select(*[col(c) for c in columns], part.alias("_part"), key.alias("_key"), accepted.alias("_ok"), tie.alias("_tie"),
                         F.lit(1).cast("bigint").alias("_times"))
    fewer = marked.mapInArrow(_fewer(columns.index(sink.at)), marked.schema)
    found = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in columns],
                          T.StructField("_ok", T.BooleanType()), T.StructField("attempts", T.LongType())])
    return fewer.groupBy("_part").transformWithState(
        statefulProcessor=Ledger(columns, sink.at), outputStructType=found, outputMode="Append", timeMode="None")


def _with_rocks(spark: SparkSession, start) -> StreamingQuery:
    """Start a query whose state outgrows memory; a query keeps the settings it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def start_append(stream: DataFrame, sink: AppendSink, valid: Column, once: bool = True) -> StreamingQuery:
    """Append each delivered row once, however often and however late it is delivered.

    Of rows that bring the same key in one micro-batch the earliest counts, and a
    key stored before, however long ago, is not stored again. Each micro-batch is
    written to its own folder and overwritten when the engine replays it after a
    failure, with the state it began from, so a half-finished batch leaves nothing behind. Rows that fail
    ``valid``, or whose time is missing or unreadable, go to the quarantine with
    the time as delivered and their attempt count, and a row rejected five times
    is marked as dropped. What is known of keys is in the checkpoint: with a
    new one a stream begins anew.
    """
    ready = tagged(timed(stream, sink.at), sink.source_app)
    taken = [c for c in ready.columns if c in (*_OWN, "attempts")]
    if taken:
        raise ValueError(f"columns {taken} have names this needs for itself")
    found, raw = judged(ready, sink, valid), f"{sink.at}_raw"

    def append(batch: DataFrame, batch_id: int) -> None:
        seen = batch.persist()
        try:
            _write(seen.filter("_ok").drop("_ok", "attempts", raw), sink.table, batch_id)
            bad = seen.filter("not _ok").drop("_ok")
            _write(bad.withColumn("dropped", col(sink.key).isNotNull() & (F.col("attempts") >= MAX_ATTEMPTS)), sink.quarantine, batch_id)
        finally:
            seen.unpersist()

    writer = found.writeStream.foreachBatch(append).option("checkpointLocation", sink.checkpoint).outputMode("append")
    started = writer.trigger(availableNow=True) if once else writer
    return _with_rocks(stream.sparkSession, started.start)


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder for each batch, replaced as a whole when the batch is replayed."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def retry_candidates(quarantine: DataFrame, key: str = "client_key") -> DataFrame:
    """Rejected rows still worth another try, at their latest attempt."""
    return quarantine.groupBy(col(key).alias("_key")).agg(latest(quarantine, "attempts").alias("r")).select("r.*").filter(
        "not dropped")
