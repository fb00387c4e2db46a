"""Incremental operators whose state lies by key in the state store: a batch reads and writes the keys that it touches.

``ingest`` keeps tables that each batch replaces whole, which suits small state. Here a session's checkpoint or a blob's
entry is a value in RocksDB on the executor that has the key, and what a batch changed is what goes to the checkpoint folder
(the store's change log; whole snapshots are taken now and then in the background). A query that is started again goes on
from the last batch that was committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions import hashing
from ..operators.tables import ensure_importable

#: Settings that a query takes over when it starts.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
CHECKPOINT = "archived boolean, last_staged_line long"
OBJECT = "created_at long, last_seen long, size long, kind string, puts long"
DIGEST = "session_id long, content string, turn_count long, total_lines long"


def _struct(schema: str) -> StructType:
    """A worker has no session that could parse it."""
    kinds = {"long": LongType(), "boolean": BooleanType(), "string": StringType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


@contextmanager
def state_store(spark: SparkSession):
    """The session's settings are put back after the query has started."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    try:
        for name, value in STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class SessionProcessor(StatefulProcessor):
    """A session's new lines as one digest; its checkpoint is then set, also backwards, to the last line of the batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.checkpoint = handle.getValueState("checkpoint", _struct(CHECKPOINT))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        archived, last = self.checkpoint.get() if self.checkpoint.exists() else (False, -1)
        total, new = -1, []
        for row in rows:
            total = max(total, row["line_no"])
            if row["line_no"] > last:
                new.append((row["line_no"], row["text"]))
        if new:
            self.checkpoint.update((archived, total))
            new.sort(key=lambda x: (x[0], x[1] is not None, x[1] or ""))
            yield Row(session_id=key[0], content="\n".join(t for _, t in new if t is not None), turn_count=len(new), total_lines=total)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.checkpoint.update((bool(initialState["archived"]), initialState["last_staged_line"] or 0))

    def close(self) -> None:
        pass


class ObjectProcessor(StatefulProcessor):
    """A blob's entry after the accesses of a batch: put by the first ever, touched by the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _struct(OBJECT))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        created, seen, size, kind, puts = self.entry.get() if self.entry.exists() else (None, None, 0, None, 0)
        for row in rows:
            if row["ts"] is not None and (created is None or row["ts"] < created):
                created, kind = row["ts"], row["kind"]
            seen = row["ts"] if seen is None else max(seen, row["ts"] if row["ts"] is not None else seen)
            size, puts = max(size, row["size"] or 0), puts + 1
        self.entry.update((created, seen, size, kind, puts))
        yield Row(handle=key[0], created_at=created, last_seen=seen, size=size, kind=kind, puts=puts)

    def close(self) -> None:
        pass


def _start(out: DataFrame, mode: str, batch: Callable[[DataFrame, int], None] | None, checkpoint: str) -> StreamingQuery:
    with state_store(out.sparkSession):
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = (writer.foreachBatch(batch) if batch else writer.format("noop")).start()
        query.processAllAvailable()  # the settings are read when the first batch is planned
        return query


def ingest_turns(turns: DataFrame, staged: Callable[[DataFrame, int], None], checkpoint: str, initial: DataFrame | None = None) -> StreamingQuery:
    """Stages what is new in a stream of turns (session_id, line_no, text) and keeps each session's checkpoint by its key.

    ``staged`` gets each batch's digests (session_id, content, turn_count, total_lines); it must do no harm when given the
    same batch twice. ``initial`` (session_id, archived, last_staged_line) is what a first run begins with.
    """
    ensure_importable(turns.sparkSession)
    known = None if initial is None else initial.select("session_id", "archived", "last_staged_line").groupBy("session_id")
    out = turns.select("session_id", "line_no", "text").groupBy("session_id").transformWithState(SessionProcessor(), DIGEST, "Append", "None", known)
    return _start(out, "append", staged, checkpoint)


def track_blobs(accesses: DataFrame, checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the entries of a stream of accesses (content, ts, kind) by handle; contents are hashed where they lie and do not
    travel. ``changed`` gets the entries that each batch touched."""
    ensure_importable(accesses.sparkSession)
    lean = accesses.select(hashing.blob_handle(F.col("content")).alias("handle"), "ts", F.octet_length("content").cast("long").alias("size"), "kind")
    out = lean.groupBy("handle").transformWithState(ObjectProcessor(), f"handle string, {OBJECT}", "Update", "None")
    return _start(out, "update", changed, checkpoint)


def _state(spark: SparkSession, checkpoint: str, variable: str, key: str) -> DataFrame:
    with state_store(spark):
        found = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    return found.select(F.col(f"key.{key}").alias(key), "value.*")


def session_checkpoints(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, archived, last_staged_line) as of the last batch of a query's checkpoint folder."""
    return _state(spark, checkpoint, "checkpoint", "session_id")


def blob_entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(handle, created_at, last_seen, size, kind, puts) as of the last batch of a query's checkpoint folder."""
    return _state(spark, checkpoint, "entry", "handle")
