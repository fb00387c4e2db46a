"""Session transcripts: metadata, digests since a checkpoint, staging outcomes, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify, trim_all

QUIET_SECONDS = 600


def json_string(line: Column, field: str) -> Column:
    """The field's value if it is a JSON string; null for other types and for lines that are no JSON."""
    value = F.try_variant_get(F.try_parse_json(line), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(line), f"$.{field}", "string"))


def session_meta(lines: DataFrame) -> DataFrame:
    """Per path of ``lines`` (path, line_no, line): sessionId and cwd of the first line that has both as strings."""
    fields = lines.select("path", "line_no", json_string(F.col("line"), "sessionId").alias("session_id"), json_string(F.col("line"), "cwd").alias("cwd"))
    good = fields.where("session_id is not null and cwd is not null")
    return good.groupBy("path").agg(F.min_by(F.struct("session_id", "cwd"), "line_no").alias("m")).select("path", "m.*")


def digests(turns: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per session of ``turns`` (session_id, line_no, text) what lies after its last staged line.

    (session_id, content, turn_count, total_lines); sessions with nothing new have no row. The filter is pushed below
    the aggregation, so staged lines are not collected again.
    """
    last = checkpoints.select("session_id", F.col("last_staged_line").alias("last"))
    totals = turns.join(last, "session_id", "left").withColumn("new", F.col("line_no") > F.coalesce("last", F.lit(-1)))
    grouped = totals.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("line_no", "text")))), lambda s: s["text"]), "\n").alias("content"),
        F.count_if("new").alias("turn_count"),
        F.max("line_no").alias("total_lines"),
    )
    return grouped.where("turn_count > 0")


def stage_checkpoint(checkpoints: DataFrame, staged: DataFrame) -> DataFrame:
    """last_staged_line is set to what was staged (session_id, total_lines), also backwards; archived stays."""
    joined = checkpoints.join(staged.select("session_id", "total_lines"), "session_id", "full_outer")
    return joined.select("session_id", F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("total_lines", "last_staged_line", F.lit(0)).alias("last_staged_line"))


def archive_checkpoint(checkpoints: DataFrame, archived: DataFrame) -> DataFrame:
    """archived is set for the sessions of ``archived``; last_staged_line stays. Doing it again changes nothing."""
    marked = archived.select("session_id").distinct().withColumn("now", F.lit(True))
    joined = checkpoints.join(marked, "session_id", "full_outer")
    return joined.select("session_id", F.coalesce("now", "archived", F.lit(False)).alias("archived"), F.coalesce("last_staged_line", F.lit(0)).alias("last_staged_line"))


def checkpoint_state(states: DataFrame) -> DataFrame:
    """Rows of the checkpoint maps in column json; missing fields are false and 0, text that is no map gives none."""
    parsed = F.from_json("json", "map<string, struct<archived:boolean, last_staged_line:bigint>>")
    rows = states.select(F.explode(parsed).alias("session_id", "s"))
    return rows.select("session_id", F.coalesce("s.archived", F.lit(False)).alias("archived"), F.coalesce("s.last_staged_line", F.lit(0)).alias("last_staged_line"))


def outcome(enabled: Column, turn_count: Column, n_bytes: Column, min_turns: Column, min_bytes: Column) -> Column:
    return F.when(~enabled, "hook_disabled").when((turn_count < min_turns) | (n_bytes < min_bytes), "below_threshold").otherwise("staged")


def hook_enabled(trigger: Column, pre_compact: Column, session_end: Column) -> Column:
    """A manual run is never gated."""
    return F.when(trigger == "precompact", pre_compact).when(trigger == "sessionend", session_end).otherwise(True)


def sweep(transcripts: DataFrame, checkpoints: DataFrame, current: str | None, now: int, min_turns: int = 1, min_bytes: int = 0) -> DataFrame:
    """(outcome, n) over ``transcripts`` (path, session_id, mtime, turn_count, n_bytes); the first reason that holds counts."""
    archived = checkpoints.where("archived").select("session_id", F.lit(True).alias("done"))
    known = transcripts.join(archived, "session_id", "left")
    what = (
        F.when(F.col("session_id").isNull(), "error")
        .when(F.col("session_id") == F.lit(current), "current_session")
        .when(F.col("done"), "already_archived")
        .when(F.lit(now) - F.col("mtime") < QUIET_SECONDS, "recent_mtime")
        .when(F.col("n_bytes") == 0, "error")
        .when((F.col("turn_count") < min_turns) | (F.col("n_bytes") < min_bytes), "below_threshold")
        .otherwise("archived")
    )
    return known.groupBy(what.alias("outcome")).agg(F.count("*").alias("n"))


def ingest_reason(session_id: Column, cwd: Column, turn_count: Column) -> Column:
    unknown = F.lit("unknown")
    return F.format_string("Session %s in %s (%d text turns): judge which durable facts are worth keeping", F.coalesce(session_id, unknown), F.coalesce(cwd, unknown), turn_count)


def ingest(turns: DataFrame, meta: DataFrame, checkpoints: DataFrame, config: DataFrame, trigger: str = "manual", archive_after: bool = False, since_checkpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """One pass over sessions: (outcomes, checkpoints after it).

    ``turns`` (session_id, line_no, text), ``meta`` (session_id, cwd), ``config`` (session_id, pre_compact, session_end,
    min_turns, min_bytes). Outcomes: (session_id, outcome, job_id, reason, content); job_id is null unless staged.
    Sessions with nothing new since their checkpoint are ``nothing_new``, with nothing at all ``empty``.
    """
    check_modes(archive_after, since_checkpoint)
    known = checkpoints if since_checkpoint else checkpoints.limit(0)
    found = digests(turns, known).withColumn("blank", trim_all(F.col("content")) == "")
    rows = turns.select("session_id").distinct().join(found, "session_id", "left").join(meta, "session_id", "left").join(config, "session_id", "left")
    gate = hook_enabled(F.lit(trigger), F.coalesce("pre_compact", F.lit(True)), F.coalesce("session_end", F.lit(True)))
    what = F.when(F.coalesce("blank", F.lit(True)), "nothing_new" if since_checkpoint else "empty").otherwise(
        outcome(gate, F.col("turn_count"), F.octet_length("content"), F.coalesce("min_turns", F.lit(1)), F.coalesce("min_bytes", F.lit(0)))
    )
    staged = F.col("outcome") == "staged"
    rows = rows.withColumn("outcome", what)
    outcomes = rows.select(
        "session_id", "outcome", F.when(staged, slugify(F.col("content"))).alias("job_id"),
        F.when(staged, ingest_reason(F.col("session_id").cast("string"), F.col("cwd"), F.col("turn_count"))).alias("reason"), F.when(staged, F.col("content")).alias("content"),
    )
    done = rows.where(staged)
    if since_checkpoint:
        return outcomes, stage_checkpoint(checkpoints, done)
    return outcomes, archive_checkpoint(checkpoints, done) if archive_after else checkpoints


def check_modes(archive_after: bool, since_checkpoint: bool) -> None:
    if archive_after and since_checkpoint:
        raise ValueError("archive_after and since_checkpoint cannot be combined")
