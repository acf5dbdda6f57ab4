"""WARC archives with an index: records written once, selected records read back by byte ranges.

Each task writes its rows as gzip members of one archive file in the shared folder and returns one
index row per record: file, offset, length, URL, digest.  The index is a table of its own, written by
Spark, so it names exactly the files of the attempts that succeeded (a lost attempt leaves a file that
no index row names).  Records are then selected on the index alone; their ranges are sorted by file and
offset, dealt out by range (a large file is shared by many tasks), and ranges that lie close together
are read in one call.  ``index_archives`` builds the same index for archives written elsewhere.

Of records with equal payloads of at least ``min_payload`` bytes that with the largest id is a
``response``, the others are ``revisit`` records without payload.  Equality is that of SHA-256; the
digest written is SHA-1 in base32, of the full payload also for revisits.

A null payload is empty; a null URL has no target header; a null id has an empty record id, comes
before all others and refers like any other.  Rows that repeat the largest id are each a response.
Line ends in URLs are percent-encoded.  Extra columns are left out.  An empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sift.llm.common import bounded_batches, shared_path, tidy, written

INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()),
                   ("id", pa.int64()), ("refers_to", pa.int64())])
RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
HEAVY_SHARE = 1000
#: an archive is closed beyond so many bytes
ARCHIVE = 1 << 30
#: an extension field: a revisit tells the length of the payload that it leaves out
LENGTH_FIELD = "X-Payload-Length"
#: ranges of a file that are at most so far apart are read in one call, of at most READ bytes
GAP, READ = 1 << 16, 8 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str):
    """(file system, path inside it) of a folder URI; a bare path is a mounted folder."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), ("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


# ------------------------------------------------------------------ which records refer to another

def decide(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``pages(id, url, payload)`` with ``refers_to``: the largest id of an equal payload, or null for a response."""
    rows = pages.select(F.col("id").cast("bigint").alias("id"), "url", F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.withColumn("_key", F.when(F.octet_length("payload") >= min_payload, F.sha2("payload", 256)))
    groups = (rows.filter("_key is not null").groupBy("_key").agg(F.max("id").alias("_first"), F.count("*").alias("_n"))
              .filter("_n > 1 and _first is not null"))
    groups = written(groups, "payload-groups")
    heavy_from = pages.count() / HEAVY_SHARE
    # at most HEAVY_SHARE groups hold more than that share of the rows each: they are broadcast
    heavy = groups.filter(F.col("_n") > heavy_from).select("_key", F.col("_first").alias("_heavy"))
    light = groups.filter(F.col("_n") <= heavy_from).select(F.col("_key").alias("_light"), "_first")
    rows = rows.join(F.broadcast(heavy), "_key", "left")
    # rows of heavy groups and rows without a key meet no light group: spread by their id
    rows = rows.withColumn("_light", F.when(F.col("_heavy").isNull() & F.col("_key").isNotNull(), F.col("_key"))
                           .otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    rows = rows.join(light, "_light", "left")
    first = F.coalesce("_heavy", "_first")
    return rows.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(first), first).alias("refers_to"))


# ------------------------------------------------------------------ writing

def _line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in value)


def record_id(number) -> str:
    return f"<urn:record:{'' if number is None else number}>"


def record(kind: str, number, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str]:
    """(bytes of one WARC record, payload digest)."""
    digest = sha1_base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(number)), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha1:{digest}"), (LENGTH_FIELD, str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if kind == "revisit":
        head += [("WARC-Refers-To", record_id(refers_to)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        block += payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", digest


def member(data: bytes, level: int = 1) -> bytes:
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _write(folder: str):
    def run(batches):
        fs, inside = file_system(folder)
        name, sink, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for number, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                    if sink is None or at >= ARCHIVE:
                        if sink is not None:
                            sink.close()
                        at = 0
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink = fs.open_output_stream(f"{inside}/{name}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    payload = payload.encode()
                    data, digest = record(kind, number, url, payload, refers_to)
                    data = member(data)
                    sink.write(data)
                    rows.append((name, at, len(data), url, digest, len(payload), kind, number, refers_to))
                    at += len(data)
                yield _batch(rows, INDEX)
        finally:
            if sink is not None:
                sink.close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write ``pages(id, url, payload)`` as archives in ``folder`` and return their index, with full file names."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or shared_path(spark, "warc")
    fs, inside = file_system(folder)
    fs.create_dir(inside, recursive=True)
    # named in the plan, so that a later reading of the index never writes again
    index = written(decide(pages, min_payload).mapInArrow(tidy(_write(folder)), from_arrow_schema(INDEX)), "warc-index")
    return index.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))


# ------------------------------------------------------------------ reading

def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its header")
    return fields, rest[:size]


def _bytes(fields: dict[str, str], payload: bytes | None):
    """Length of the full payload; a revisit without the extension field has none."""
    told = fields.get(LENGTH_FIELD.lower())
    return len(payload) if payload is not None else int(told) if told is not None else None


def _number(value: str | None):
    digits = (value or "").removeprefix("<urn:record:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _ranges(offsets: list[int], lengths: list[int]):
    """(start, end, first, last) of the joined reads of sorted ranges."""
    i = 0
    while i < len(offsets):
        j, end = i + 1, offsets[i] + lengths[i]
        while j < len(offsets) and offsets[j] <= end + GAP and offsets[j] + lengths[j] - offsets[i] <= READ:
            end = max(end, offsets[j] + lengths[j])
            j += 1
        yield offsets[i], end, i, j
        i = j


def _read(batches):
    open_name, source = None, None
    for batch in batches:
        files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        a = 0
        while a < len(files):
            b = a
            while b < len(files) and files[b] == files[a]:
                b += 1
            if files[a] != open_name:
                if source is not None:
                    source.close()
                fs, inside = file_system(files[a])
                open_name, source = files[a], fs.open_input_file(inside)
            for start, end, i, j in _ranges(offsets[a:b], lengths[a:b]):
                raw = source.read_at(end - start, start)
                rows = []
                for k in range(a + i, a + j):
                    at = offsets[k] - start
                    fields, block = parse(zlib.decompress(raw[at: at + lengths[k]], 31))
                    kind = fields["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and sha1_base32(payload) != digest:
                        raise ValueError(f"{files[k]}: payload at {offsets[k]} does not match its digest")
                    rows.append((_number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind,
                                 _bytes(fields, payload), digest, _number(fields.get("warc-refers-to")),
                                 None if payload is None else payload.decode(errors="replace")))
                yield _batch(rows, RECORD)
            a = b


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of ``index`` name: ``(id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload)``; a revisit has no payload.  Digests are checked."""
    spark = index.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranges = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(tidy(_read), from_arrow_schema(RECORD))


def _scan(batches):
    """Index rows of whole archives, from a stream over their gzip members."""
    for batch in batches:
        for name in batch.column("file").to_pylist():
            fs, inside = file_system(name)
            rows, at, start, data, engine = [], 0, 0, [], zlib.decompressobj(31)
            with fs.open_input_file(inside) as source:
                rest = b""
                while True:
                    part = rest or source.read(1 << 20)
                    if not part:
                        break
                    data.append(engine.decompress(part))
                    rest = engine.unused_data
                    at += len(part) - len(rest)
                    if engine.eof:
                        fields, block = parse(b"".join(data))
                        kind = fields["warc-type"]
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((name, start, at - start, fields.get("warc-target-uri"), digest,
                                     _bytes(fields, block.partition(b"\r\n\r\n")[2] if kind == "response" else None), kind,
                                     _number(fields.get("warc-record-id")), _number(fields.get("warc-refers-to"))))
                        start, data, engine = at, [], zlib.decompressobj(31)
                        if len(rows) == 10_000:
                            yield _batch(rows, INDEX)
                            rows = []
            if rows:
                yield _batch(rows, INDEX)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the archives in ``folder`` (one gzip member a record), one task per group of files."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("path").alias("file"))
    return names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(tidy(_scan), from_arrow_schema(INDEX))


def archived_pages(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` written as archives and read back: ``(page_id, payload_bytes, payload_digest,
    record_type, refers_to)``."""
    index = write_archives(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), min_payload=min_payload)
    return read_records(index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
