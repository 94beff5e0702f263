"""Token ids as length-delimited binary records with an offset index.

A shard file is a run of records, in ascending doc_id order over all shards:

    uint64 length, uint32 masked checksum of the length's 8 bytes,
    `length` bytes: int64 doc_id, then the ids (uint16 if the vocabulary fits, else uint32),
    uint32 masked checksum of those bytes

all little-endian.  A masked checksum is the CRC-32 rotated right by 15 bits plus 0xa282ead8, so that
a checksum of data that hold checksums stays meaningful.  The index is a Parquet table with a row per
record: shard, position, doc_id, offset, length, n_tokens, and the bytes of an id.  It allows to read records in any order
without a scan.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._encode import encoder
from ._store import bound_batches, fresh_path, trim

_INDEX = "shard int, position long, doc_id long, offset long, length long, n_tokens long, width int"
_READ = "shard int, position long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"
_NONE = -(1 << 63)  # a doc_id of null


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one framed record; raises ValueError if a length or checksum is wrong."""
    head = record[:8]
    if len(record) < 16 or struct.unpack("<I", record[8:12])[0] != masked(head):
        raise ValueError("damaged record length")
    (size,) = struct.unpack("<Q", head)
    payload = record[12 : 12 + size]
    if len(record) != size + 16 or struct.unpack("<I", record[12 + size :])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def open_store(path: str):
    """The file system of a shared path (file://, hdfs:// and the like) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _shard(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:06d}.rec"


def ids_fit_short(tokenizer: str, end_id: int) -> bool:
    """Whether every id of a tokenizer file, and the end id, fits 16 bits."""
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None, encode_special_tokens: bool = False) -> DataFrame:
    """Encode every whole text, write the shards under path/data and the index under path/index.

    A null text has the end id alone, like an empty one.  Rows of equal doc_id all get their record,
    ordered by text; those of a null doc_id come first.  Other columns do not matter, whatever their names.
    An empty table gives an index without rows.  Long texts are encoded piece by piece.  A task writes
    its shard under a name of its own and then renames it, so that a repeated task replaces what a lost
    one left.  Ids take 16 bits if all of the vocabulary fit, and the index tells.  Returns the index.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = 2 if ids_fit_short(tokenizer, end_id) else 4
    store = f"{path}/data"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(store)
        fs.create_dir(base, recursive=True)
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer, encode_special_tokens)
        temporary, position, offset = f"{_shard(base, shard)}.{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(temporary) as out:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for i, j, data, offsets in _text.each_slice(batch.column(1)):
                    ids, at = encode.encode(data, offsets, end_id)
                    raw = ids.astype(f"<u{width}").tobytes()
                    records = [frame(struct.pack("<q", _NONE if d is None else d) + raw[width * a : width * b]) for d, a, b in zip(doc_ids[i:j], at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    sizes = np.fromiter(map(len, records), np.int64, j - i)
                    out.write(b"".join(records))
                    begins = offset + np.cumsum(sizes) - sizes
                    n = j - i
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(position, position + n)), pa.array(doc_ids[i:j], pa.int64()), pa.array(begins), pa.array(sizes), pa.array(np.diff(at)), pa.array(np.full(n, width, np.int32))],
                        ["shard", "position", "doc_id", "offset", "length", "n_tokens", "width"],
                    )
                    position, offset = position + n, offset + int(sizes.sum())
        fs.move(temporary, _shard(base, shard))
        trim()

    # the beginnings of texts, which are in the order of the texts, spread the rows of one doc_id, such as null
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(written, _INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Read the records that the index names and check them: one row per record, with `before` (ids
    of the shard's earlier records), `n_tokens`, `ids_crc32` (of the ids as uint32) and `ids` (the
    same as bytes; null if not asked for)."""
    bound_batches(spark)
    store = f"{path}/data"

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(store)
        open_, name, before = None, None, 0
        for batch in batches:
            got: dict[str, list] = {k: [] for k in ("shard", "position", "doc_id", "before", "n_tokens", "ids_crc32", "ids")}
            for shard, position, offset, length, width in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if shard != name:
                    if open_:
                        open_.close()
                    open_, name, before = fs.open_input_file(_shard(base, shard)), shard, 0
                open_.seek(offset)
                payload = unframe(open_.read(length))
                ids = np.frombuffer(payload, f"<u{width}", offset=8).astype("<u4")
                (doc_id,) = struct.unpack("<q", payload[:8])
                raw = ids.tobytes()
                row = (shard, position, None if doc_id == _NONE else doc_id, before, len(ids), zlib.crc32(raw), raw if with_ids else None)
                for k, v in zip(got, row, strict=True):
                    got[k].append(v)
                before += len(ids)
            yield pa.RecordBatch.from_pydict(got, schema=pa.schema([("shard", pa.int32()), *[(k, pa.int64()) for k in list(got)[1:6]], ("ids", pa.binary())]))
        if open_:
            open_.close()

    index = spark.read.schema(_INDEX).parquet(f"{path}/index").select("shard", "position", "offset", "length", "width")
    # a number of partitions of its own: the index is small beside what its rows make a task read
    shards = max(1, index.select("shard").distinct().count())
    return index.repartition(shards, "shard").sortWithinPartitions("shard", "position").mapInArrow(checked, _READ)


def encode_and_read(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write docs as records, read the files back and return what they hold per record, with `start`:
    the ids of all records before it."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "records")
    index = write(docs, path, tokenizer, **options)
    per_shard = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = per_shard.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    back = read(spark, path, with_ids=False)
    return back.join(base, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "position")
