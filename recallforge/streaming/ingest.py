"""Incremental operators as streams: new transcript turns, blob accesses. State is in tables that each batch replaces whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blobs, sessions


class VersionedTable:
    """A Parquet table that is replaced version by version; a version named after its batch is written once or again alike.

    A batch reads the newest version below its own number, so a batch that is run again after a failure sees what it saw.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        done = lambda s: store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in store.listStatus(folder) if s.getPath().getName().startswith("v") and done(s))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}") if known else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")


CHECKPOINTS = "session_id long, archived boolean, last_staged_line long"
OBJECTS = "handle string, created_at long, last_seen long, size long, kind string, puts long"


def ingest_turns(turns: DataFrame, state: VersionedTable, staged: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Stages what is new in a stream of turns (session_id, line_no, text) and moves the sessions' checkpoints.

    ``staged`` gets each batch's digests; it must do no harm when given the same batch twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        before = state.read(number)
        found = sessions.digests(df, before)
        staged(found, number)
        state.write(sessions.stage_checkpoint(before, found), number)

    return turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_blobs(accesses: DataFrame, state: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Keeps the object table of a stream of accesses (content, ts, kind): new objects are put, known ones touched."""

    def batch(df: DataFrame, number: int) -> None:
        both = state.read(number).unionByName(blobs.put(df))
        merged = both.groupBy("handle").agg(F.min("created_at").alias("created_at"), F.max("last_seen").alias("last_seen"), F.max("size").alias("size"), F.min_by("kind", "created_at").alias("kind"), F.sum("puts").alias("puts"))
        state.write(merged, number)

    return accesses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_activity(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """An extension: counts by hour and type of a stream (ts, event_type), with late events up to ``late`` admitted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
