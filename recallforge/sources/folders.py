"""Data sources over folders of files: a source tree that never enters pruned folders, and transcripts read from where the
last batch ended.

Both list on the driver, folder by folder, and read in tasks of about ``TASK_BYTES``; what the driver holds is a name and a
size per file. Stores are those that pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.extract import LANGUAGES, SKIPPED_FOLDERS
from ..operators.tables import ensure_importable

TASK_BYTES = 32 << 20
#: Bytes that are looked back at a time for the start of a line.
_BACK = 1 << 12
#: Folders that are listed at a time.
_LISTERS = 16

#: (name, is a folder, size) of what lies in a folder.
Entry = tuple[str, bool, int]


def opened(root: str):
    """The store of ``root``, and its path there."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        store, path = fs.FileSystem.from_uri(root)
        return store, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root)


def lister(store) -> Callable[[str], list[Entry]]:
    from pyarrow import fs

    def listed(folder: str) -> list[Entry]:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [(x.base_name, x.type == fs.FileType.Directory, x.size or 0) for x in found]

    return listed


def walk(listed: Callable[[str], list[Entry]], root: str, enters: Callable[[str], bool], takes: Callable[[str], bool]) -> Iterator[tuple[str, int]]:
    """(path below root, size) of the files that are taken; a folder that ``enters`` refuses is not listed."""
    level = [""]
    with ThreadPoolExecutor(_LISTERS) as pool:
        while level:
            below: list[str] = []
            for folder, entries in zip(level, pool.map(lambda f: listed(f"{root}/{f}".rstrip("/")), level)):
                for name, is_folder, size in sorted(entries):
                    path = f"{folder}/{name}" if folder else name
                    if is_folder and enters(name):
                        below.append(path)
                    elif not is_folder and takes(name):
                        yield path, size
            level = below


def is_source_folder(name: str) -> bool:
    return not name.startswith(".") and name not in SKIPPED_FOLDERS


def is_source_file(name: str) -> bool:
    return name.rpartition(".")[2] in LANGUAGES and "." in name


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last) of what one task reads."""

    ranges: list[tuple[str, int, int]]


def tasks(ranges: Iterable[tuple[str, int, int]]) -> list[Ranges]:
    out: list[Ranges] = []
    size = TASK_BYTES
    for path, a, b in ranges:
        if size >= TASK_BYTES:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append((path, a, b))
        size += b - a
    return out


class _TreeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Ranges]:
        store, root = opened(self.root)
        return tasks((path, 0, size) for path, size in walk(lister(store), root, is_source_folder, is_source_file)) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple[str, str | None]]:
        store, root = opened(self.root)
        for path, _, _ in partition.ranges:
            try:
                with store.open_input_stream(f"{root}/{path}") as f:
                    content = f.read().decode()
            except (OSError, UnicodeDecodeError):
                content = None
            yield path, content


class SourceTree(DataSource):
    """(rel, content) of supported source files below a folder; content that cannot be read as UTF-8 is null."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "rel string, content string"

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(self.options["path"])


def lines_between(handle, a: int, b: int) -> Iterator[tuple[int, bytes]]:
    """(place of its first byte, line) of the lines whose line break lies in bytes a to b of a file.

    A line that had no line break when the last batch ended at ``a`` is read from its start, which is looked for backwards;
    of what lies before it nothing is read. The last line waits for its line break.
    """
    head, at = b"", a
    while at and b"\n" not in head:
        first = max(0, at - _BACK)
        handle.seek(first)
        head = handle.read(at - first) + head
        at = first
    head = head[head.rfind(b"\n") + 1 :]
    handle.seek(a)
    left, place = head, a - len(head)
    while a < b:
        data = handle.read(min(b - a, 1 << 20))
        if not data:
            return
        a += len(data)
        *whole, left = (left + data).split(b"\n")
        for line in whole:
            yield place, line
            place += len(line) + 1


class _TranscriptReader(DataSourceStreamReader):
    """Offsets are the sizes of the files; a batch reads from the size that the last one knew. A file that has become shorter
    is read anew."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        store, root = opened(self.root)
        listed = lister(store)
        folders = [name for name, is_folder, _ in listed(root) if is_folder]
        with ThreadPoolExecutor(_LISTERS) as pool:
            found = zip(folders, pool.map(lambda f: listed(f"{root}/{f}"), folders))
            sizes = {f"{folder}/{name}": size for folder, entries in found for name, is_folder, size in entries if not is_folder and name.endswith(".jsonl")}
        return {"sizes": json.dumps(sizes, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before, after = json.loads(start["sizes"]), json.loads(end["sizes"])
        begun = {path: before.get(path, 0) if before.get(path, 0) <= size else 0 for path, size in after.items()}
        return tasks((path, begun[path], size) for path, size in sorted(after.items()) if size > begun[path] or size < before.get(path, 0))

    def read(self, partition: Ranges) -> Iterator[tuple[str, int, str]]:
        store, root = opened(self.root)
        for path, a, b in partition.ranges:
            try:
                with store.open_input_file(f"{root}/{path}") as f:
                    for place, line in lines_between(f, a, b):
                        yield path, place, line.decode("utf-8", "replace")
            except FileNotFoundError:
                continue


class TranscriptStream(DataSource):
    """(path, line_no, line) of the *.jsonl files exactly one folder below a root, as they grow; ``line_no`` is the place of the
    line's first byte, which grows along a file as numbers of lines do."""

    @classmethod
    def name(cls) -> str:
        return "transcript_stream"

    def schema(self) -> str:
        return "path string, line_no long, line string"

    def streamReader(self, schema) -> _TranscriptReader:
        return _TranscriptReader(self.options["path"])


def source_files(spark: SparkSession, root: str) -> DataFrame:
    ensure_importable(spark)
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(root)


def transcript_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of new lines; each batch reads what the files have grown by."""
    ensure_importable(spark)
    spark.dataSource.register(TranscriptStream)
    return spark.readStream.format("transcript_stream").load(root)
