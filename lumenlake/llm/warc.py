"""WARC archives compressed record by record with a Zstandard dictionary that the file carries.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then each record
is a Zstandard frame of its own, so that any record can be read with the dictionary and its offset.
Equal payloads are archived once: the page of the smallest id gets a response record, the others
revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bound_batches, fresh_path, materialize
from .records import open_store

DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of a file's dictionary, and of the first records of a file that it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 2 << 20
#: Payloads of fewer bytes are always archived in full.
LEAST_REVISIT = 100
LEVEL = 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file int, position long, page_id long, offset long, length long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_urn(page_id: int | None, digest: str, again: int = 0) -> str:
    """The id of a record: of its page, its payload, and the number of records before it that share both."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{f':{again}' if again else ''}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip()[len("<urn:x-page:") : -1].partition(":")[0]
    return int(name) if name else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, again: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers alone, with the full payload's length.

    again: how many records of the same page_id and payload there are before it, as no two share an id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_urn(page_id, digest, again)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_urn(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of one record.

    Raises ValueError if lengths or, for a response, the digest do not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("damaged WARC payload")
    refers = _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind, refers, payload if kind == "response" else None


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES):
    """A trained dictionary, or one of the samples' raw bytes where there is too little to train on."""
    import zstandard

    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 8), samples, level=LEVEL, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes records to a stream; holds the first ones until the dictionary can be built."""

    def __init__(self, out, sample_bytes: int = SAMPLE_BYTES):
        self.out, self.sample_bytes, self.held, self.size, self.offset, self.compressor = out, sample_bytes, [], 0, 0, None

    def add(self, raw: bytes) -> list[tuple[int, int]]:
        """(offset, length) of every record that this one caused to be written."""
        if self.compressor is None:
            self.held.append(raw)
            self.size += len(raw)
            return self.close() if self.size >= self.sample_bytes else []
        return [self._write(self.compressor.compress(raw))]

    def close(self) -> list[tuple[int, int]]:
        if self.compressor is not None:
            return []
        import zstandard

        dictionary = build_dictionary(self.held)
        body = dictionary.as_bytes()
        self._write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        held, self.held = self.held, []
        return [self._write(self.compressor.compress(r)) for r in held]

    def _write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.offset += len(data)
        return self.offset - len(data), len(data)


def decompressor(file):
    """A reader of single frames of an open archive file."""
    import zstandard

    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    body = file.read(size)
    trained = body[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))


def _file(base: str, number: int) -> str:
    return f"{base}/part-{number:06d}.warc.zst"


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows to archive, and before the rows of a page one (`page` false) that tells the `first` page of an
    equal payload, where a payload of `least` bytes or more occurs more than once.

    Digests of equal payloads are counted before the shuffle, and only ids and digests meet in the join
    by digest.  Payloads are shuffled once, by page_id and digest, together with what was found out about them."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = own.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    repeated = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    firsts = slim.select("page_id", "digest").distinct().join(repeated, "digest")
    told = firsts.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.lit(False).alias("page"), "first")
    return told.unionByName(own.withColumns({"page": F.lit(True), "first": F.lit(None).cast("long")}))


def write(pages: DataFrame, path: str, files: int | None = None, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Archive every page under path/data and the index of records under path/index; returns the index.

    A null html is an empty payload, a null url has no target.  Of rows that agree in page_id and
    payload one is archived and the others revisit it; a null page_id never is the one referred to.  Rows of one
    page_id, or without any, are dealt to files by their payloads, and no two records share an id.  Other columns do not matter, whatever their names; an empty table gives an index without rows; a long
    payload is a record like others, held by one task at a time.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store = f"{path}/data"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(store)
        fs.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        temporary, position = f"{_file(base, number)}.{uuid.uuid4().hex}", 0
        before = known = first = None
        again = 0
        waiting: list[int | None] = []

        def placed(spots: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal position, waiting
            n = len(spots)
            ids, waiting = waiting[:n], waiting[n:]
            rows = {"file": [number] * n, "position": list(range(position, position + n)), "page_id": ids, "offset": [o for o, _ in spots], "length": [s for _, s in spots]}
            position += n
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("file", pa.int32()), *[(c, pa.int64()) for c in ("position", "page_id", "offset", "length")]]))

        with fs.open_output_stream(temporary) as out:
            writer = Writer(out, sample_bytes)
            for batch in batches:
                spots: list[tuple[int, int]] = []
                for page_id, url, payload, digest, page, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not page:
                        known, first = (page_id, digest), told
                        continue
                    if known != (page_id, digest):
                        first = None
                    revisit = first is not None and (page_id != first or before == (page_id, digest))
                    again = again + 1 if before == (page_id, digest) else 0
                    before = (page_id, digest)
                    waiting.append(page_id)
                    spots += writer.add(record(page_id, url, payload, digest, first, revisit, date, again))
                yield placed(spots)
            yield placed(writer.close())
        fs.move(temporary, _file(base, number))

    rows = plan(pages, least).select("page_id", "url", "payload", "digest", "page", "first")
    rows = rows.repartition(files, "page_id", "digest").sortWithinPartitions("page_id", "digest", "page", "url")
    rows.mapInArrow(written, _INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Read the archived records that the index names, check them, and return one row per record."""
    bound_batches(spark)
    store = f"{path}/data"

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(store)
        open_ = name = unpack = None
        for batch in batches:
            rows = []
            for number, offset, length in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if number != name:
                    if open_:
                        open_.close()
                    open_, name = fs.open_input_file(_file(base, number)), number
                    unpack = decompressor(open_)
                open_.seek(offset)
                row = parse(unpack.decompress(open_.read(length)))
                rows.append(row if with_payload else (*row[:-1], None))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if open_:
            open_.close()

    index = spark.read.schema(_INDEX).parquet(f"{path}/index").select("file", "position", "offset", "length")
    # a number of partitions of its own: the index is small beside what its rows make a task read
    files = max(1, index.select("file").distinct().count())
    return index.repartition(files, "file").sortWithinPartitions("file", "position").mapInArrow(parsed, _READ)


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages as archives, read them back, and return what the records hold, without payloads."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return materialize(read(pages.sparkSession, path, with_payload=False), "warc-read").drop("payload")


def oracle() -> str:
    """What archive() returns of a table without repeated page_ids, in DuckDB's SQL."""
    return f"""
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY h) END AS first
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
