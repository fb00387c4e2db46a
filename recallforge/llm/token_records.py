"""Token ids as length-delimited binary records with masked checksums, and an offset index for reads in any order.

A shard file is ``RFTK``, a version byte and the width of an id (2 or 4 bytes), then records:
``u64 length | u32 masked crc32 of these 8 bytes | payload | u32 masked crc32 of the payload``, all little-endian. The
payload is a byte that says whether there is a document id, the id as i64, and the token ids. Beside it lies
``<shard>.idx`` with ``u64 offset | u64 length`` for each record, so a reader can fetch record k of shard s alone.

Shards hold ascending ranges of doc_id. Each is written by one task under another name and moved into place when whole,
so a task that is run again after a lost executor leaves the same file.

Defined cases: a null or empty text is a record with only the end id; a null doc_id sorts first; repeated rows are
written each, in an order of their texts; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ensure_importable, frugal, portions, shared_dir, stored
from ._tokens import Encoder

MAGIC = b"RFTK\x01"
SHARDS = "shard long, path string, records long, ids long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """crc32, rotated and offset, so that a checksum stored inside checked data does not check itself."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_record(handle, offset: int, length: int) -> tuple[int | None, bytes]:
    """The document id and payload ids of the record at ``offset``; ValueError if a checksum does not hold."""
    handle.seek(offset)
    data = handle.read(length)
    if len(data) < 16:
        raise ValueError("cut record")
    size, crc = struct.unpack_from("<QI", data)
    payload = data[12 : 12 + size]
    if crc != masked(data[:8]) or len(data) != size + 16 or struct.unpack_from("<I", data, 12 + size)[0] != masked(payload):
        raise ValueError("checksum")
    known, doc_id = struct.unpack_from("<?q", payload)
    return (doc_id if known else None), payload[9:]


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes and writes ``docs``; one row per shard written, in order of ``shard``."""
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows that repeat a doc_id are dealt by a hash of their text, and equal ones by where they lie.
    keyed = docs.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        encoder = Encoder.of(vocabulary, 2)
        width = encoder.width
        shard = TaskContext.get().partitionId()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        path, attempt = f"{root}/part-{shard:06d}.rec", f"{root}/_{uuid.uuid4().hex}"
        head = MAGIC + bytes([width])
        index, at, ids = [], len(head), 0
        out = None
        for batch in portions(batches):
            if out is None:
                out = store.open_output_stream(attempt)
                out.write(head)
            chunk = []
            found, ends = encoder.encode(batch.column(1), end_id)
            data, start = found.tobytes(), 0
            for doc_id, end in zip(batch.column(0).to_pylist(), (ends * width).tolist()):
                record = frame(struct.pack("<?q", doc_id is not None, doc_id or 0) + data[start:end])
                index.append((at, len(record)))
                at, start = at + len(record), end
                chunk.append(record)
            ids += len(found)
            out.write(b"".join(chunk))
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{attempt}.idx") as f:
            f.write(np.array(index, "<u8").tobytes())
        store.move(f"{attempt}.idx", f"{path}.idx")
        store.move(attempt, path)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"part-{shard:06d}.rec", "records": len(index), "ids": ids}], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

    return stored(ordered.mapInArrow(frugal(write), SHARDS), "shards")


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """Per record, from the files: its document, where its ids start in the whole corpus, how many, their crc32."""
    ensure_importable(shards.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]):
        store, root = filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).tolist()
                with store.open_input_file(f"{root}/{name}") as f:
                    head = f.read(6)
                    if head[:5] != MAGIC:
                        raise ValueError(f"{name} is no record file")
                    width = head[5]
                    for at in range(0, len(index), 4096):
                        rows = []
                        for offset, length in index[at : at + 4096]:
                            doc_id, data = read_record(f, offset, length)
                            ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                            rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                            base += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], RECORDS.replace(" long", "").split(", "))

    return placed.select("path", "base").repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism * 4), "path").mapInArrow(frugal(read), RECORDS)


def encode_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0, shard_bytes: int = 64 << 20) -> DataFrame:
    """Writes the records to the shared folder and returns what the files say."""
    folder = f"{shared_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        raise ValueError(f"spark.checkpoint.dir must be a URI or an absolute path: {folder}")
    return read_records(write_records(docs, vocabulary, folder, end_id, shard_bytes), folder)
