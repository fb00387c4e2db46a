"""The store's files as DataFrames: markdown entries, transcripts, source trees, blobs; and the sinks beside them."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_frontmatter, summarize
from .folders import source_files

INDEX_HEAD = "# Index\n\n## Pending\n\n## Entries\n"


def _whole(spark: SparkSession, root: str, glob: str, recursive: bool) -> DataFrame:
    """(path, bytes) of the files below ``root`` whose names match; no file is no row."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", F.col("content").alias("bytes"))


def _relative(path: Column, root: str) -> Column:
    bare = "file:" + os.path.abspath(root) if "://" not in root else root.replace(":///", ":/")
    return F.regexp_replace(F.substring(path, len(bare.rstrip("/")) + 2, 1 << 20), r"\\", "/")


def _text(data: Column) -> Column:
    """UTF-8 text, or null."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def wiki_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, content) of a folder's own *.md files but dot-files, by slug; a missing folder is empty."""
    empty = spark.createDataFrame([], "slug string, content string")
    if "://" not in folder and not os.path.isdir(folder):
        return empty
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return _whole(spark, folder, "*.md", False).select(name.alias("slug"), _text(F.col("bytes")).alias("content")).where("not startswith(slug, '.')").orderBy("slug")


def import_entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, slug, content, summary) of all *.md files below ``root`` but MEMORY.md, by path.

    Later paths win where slugs are equal: ``store.last_wins`` by path.
    """
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = _whole(spark, root, "*.md", True).where(~F.col("path").endswith("/MEMORY.md"))
    found = rows.select(_relative(F.col("path"), root).alias("path"), name.alias("slug"), _text(F.col("bytes")).alias("content"))
    return found.withColumn("summary", summarize(strip_frontmatter(F.col("content")))).orderBy("path")


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, line) of the *.jsonl files exactly one folder below ``root``; blank lines keep their number."""
    found = spark.read.option("pathGlobFilter", "*.jsonl").text(f"{root.rstrip('/')}/*", wholetext=True)
    lines = found.select(_relative(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), root).alias("path"), "value").where("path rlike '^[^/]+/[^/]+$'")
    return lines.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel, content) of supported source files; hidden and build folders are not entered; content that is no UTF-8 is null."""
    return source_files(spark, root).orderBy(F.split("rel", "/"))


def blob_objects(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Objects (handle, content) and sidecars (handle, json) two shard folders below ``root``/objects."""
    handle = lambda end: F.concat(F.lit("ccr_"), F.regexp_extract("path", r"/([0-9a-f]{16})" + end + "$", 1))
    objects = _whole(spark, f"{root.rstrip('/')}/objects/*/*/", "*.bin", False).select(handle(r"\.bin").alias("handle"), F.col("bytes").alias("content"))
    sidecars = _whole(spark, f"{root.rstrip('/')}/objects/*/*/", "*.meta.json", False).select(handle(r"\.meta\.json").alias("handle"), _text(F.col("bytes")).alias("json"))
    return objects, sidecars


PERSONA = "slug string, bank string, description string, source_label string, self_build boolean, artifacts array<string>"


def persona_manifest(spark: SparkSession, path: str, bank: str | None = None) -> DataFrame:
    """One manifest row; a missing or empty required field is an error."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if bank is not None:
        raw["bank"] = bank
    for field in ("slug", "bank", "description", "source_label"):
        if not isinstance(raw.get(field), str):
            raise ValueError(f"{field} must be a string")
    if not raw.get("artifacts") or not all(isinstance(a, str) for a in raw["artifacts"]):
        raise ValueError("artifacts must be a list of strings with at least one")
    row = (*[raw[f] for f in ("slug", "bank", "description", "source_label")], bool(raw.get("self_build", False)), raw["artifacts"])
    return spark.createDataFrame([row], PERSONA)


def origin_url(config: str) -> str | None:
    """The url of the section [remote "origin"] of a git configuration."""
    inside = False
    for line in map(str.strip, config.splitlines()):
        if line.startswith("["):
            inside = line == '[remote "origin"]'
        elif inside and line.startswith(("url = ", "url=")):
            return line.partition("=")[2].strip()
    return None


def write_atomically(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(data)
    os.replace(draft, path)


def archive(path: str, to: str) -> None:
    """Compresses a file, reads it back, and removes it only if both are equal."""
    with open(path, "rb") as f:
        data = f.read()
    write_atomically(to, gzip.compress(data))
    with gzip.open(to) as f:
        if f.read() != data:
            raise OSError(f"{to} does not hold {path}")
    os.remove(path)


def write_index(index: DataFrame, path: str) -> None:
    """The index file from (slug, summary): lines of slugs that are there already are replaced, others appended."""
    lines = (open(path, encoding="utf-8").read() if os.path.exists(path) else INDEX_HEAD).splitlines()
    places = {m: i for i, line in enumerate(lines) if line.startswith("- `") and (m := line[3:].split("`")[0])}
    for row in index.orderBy("slug").toLocalIterator():
        line = f"- `{row['slug']}` — {row['summary']}"
        if row["slug"] in places:
            lines[places[row["slug"]]] = line
        else:
            lines.append(line)
    write_atomically(path, ("\n".join(lines) + "\n").encode())


class Lease:
    """A lock file with the owner's process; a dead owner's is taken over only by ``reclaim``."""

    def __init__(self, folder: str) -> None:
        self.path = os.path.join(folder, ".lock")

    @staticmethod
    def owner(text: str) -> int | None:
        found = [line[4:] for line in text.splitlines() if line.startswith("pid=")]
        return int(found[0]) if found and found[0].isdigit() else None

    def live(self) -> bool:
        with open(self.path, encoding="utf-8") as f:
            pid = self.owner(f.read())
        return pid is not None and os.path.exists(f"/proc/{pid}")

    def __enter__(self) -> "Lease":
        handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        os.write(handle, f"pid={os.getpid()}\n".encode())
        os.close(handle)
        return self

    def __exit__(self, *_) -> None:
        os.remove(self.path)

    def reclaim(self) -> bool:
        if os.path.exists(self.path) and not self.live():
            os.remove(self.path)
            return True
        return False


def _writable(folder: str) -> str | None:
    """Why nothing can be written to the folder, which is made if need be."""
    try:
        os.makedirs(folder, exist_ok=True)
        probe = os.path.join(folder, f".probe-{uuid.uuid4().hex}")
        write_atomically(probe, b"")
        os.remove(probe)
    except OSError as e:
        return str(e)
    return None


def _lock_state(folder: str) -> tuple[str, str]:
    lease = Lease(folder)
    try:
        with open(lease.path, encoding="utf-8") as f:
            pid = Lease.owner(f.read())
    except FileNotFoundError:
        return "pass", "no lock is held"
    except (OSError, UnicodeDecodeError) as e:
        return "warn", f"the lock cannot be read: {e}"
    if pid is None:
        return "warn", "a lock that names no process; it can be reclaimed"
    live = os.path.exists(f"/proc/{pid}")
    return "warn", f"held by live process {pid}" if live else f"stale: process {pid} is gone; it can be reclaimed"


def doctor(folder: str, bank: str | None = None, models: str | None = None, make: Callable[[], object] | None = None, quick: bool = False) -> list[tuple[str, str, str]]:
    """(check, status, message) of a data root: is it writable, does the bank's folder exist (else a warning, since the
    first write makes it), its lock's state, is the folder of models writable, and does ``make`` give an embedder, which
    ``quick`` leaves out. The sixth check, of the blobs' size and age, is operators.store.doctor_ccr."""
    checks = []
    problem = _writable(folder)
    checks.append(("data_root", "fail" if problem else "pass", problem or f"{folder} is writable"))
    bank = bank or folder
    exists = os.path.isdir(bank)
    checks.append(("bank", "pass" if exists else "warn", f"{bank} exists" if exists else f"{bank} is made at the first write"))
    checks.append(("lock", *_lock_state(bank)))
    if models is not None:
        problem = _writable(models)
        held = not problem and any(os.scandir(models))
        checks.append(("models", "fail" if problem else "pass", problem or f"{models} is writable, " + ("with files" if held else "empty yet")))
    if quick or make is None:
        checks.append(("embedder", "skipped", "not loaded"))
    else:
        try:
            make()
            checks.append(("embedder", "pass", "loaded"))
        except Exception as e:  # whatever a model raises is what the check reports
            checks.append(("embedder", "fail", str(e) or type(e).__name__))
    return checks


def remove_tree(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
