"""WARC archives on a shared folder: writing, reading, and revisit resolution.

Records are formatted and written by Spark's text writer, one record per row with the archive's
record separator (two CRLF) between rows, gzip-compressed; nothing passes through a local folder. A file holds what one
task read, so payloads stay where they are, and at most RECORDS_PER_FILE records.
Reading streams each file through Spark's text reader in pieces between separators; a task puts the bytes together again
and walks the records by Content-Length, so it holds a record and a batch, whatever the file's size. Pages of any size
that fits a row (2 GB) pass.

Deduplication shuffles only headers: payload digests meet, the original of each group is chosen,
and the choice returns to the records by (key, digest): by broadcast up to REVISITS records (counted), else by a join
that shuffles the records, payloads included.
Reading back, revisit records (headers without payload) join the original responses by digest.

Defined results: a null payload is an empty one; a null key is written without its header and read
back as null (such a record is chosen as original only if no record of the group has a key);
repeated rows with the chosen key are all responses; control characters in a target address are
written percent-encoded; an empty table makes an empty archive, which reads as no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialise, ship

MIN_BYTES = 1000
RECORDS_PER_FILE = 5000
REVISITS = 300_000    # revisit records (some 70 bytes each) whose choice is broadcast
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH_BYTES = 4_000_000
_END = END.encode()

RECORD = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("refers_to_key", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha1", T.StringType())])


def heads(df: DataFrame, key: str, payload: str, uri: str | None = None) -> DataFrame:
    """key, uri, payload (empty if null), payload_bytes and digest of each row; no shuffle."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    address = F.col(uri).cast("string") if uri else F.lit(None).cast("string")
    return df.select(F.col(key).cast("bigint").alias("key"), address.alias("uri"), body.alias("payload"),
                     F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("digest"))


def revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``heads`` rows with ``original``: for payloads of at least ``min_bytes``, the largest key
    among equal payloads if that is another record's, else null (the record is a response)."""
    large = records.filter(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("digest").agg(F.max("key").alias("original"))
    # headers only: one row per (digest, key), so that a hot digest carries no payload
    others = (large.select("digest", "key").distinct().join(originals, "digest")
              .filter(~F.col("key").eqNullSafe(F.col("original")))
              .select("digest", F.coalesce("key", F.lit(-1)).alias("k"), F.col("key").isNull().alias("no_key"), "original"))
    others = materialise(others, "revisits")
    if others.count() <= REVISITS:
        others = F.broadcast(others)
    left = records.withColumns({"k": F.coalesce("key", F.lit(-1)), "no_key": F.col("key").isNull()})
    return left.join(others, ["digest", "k", "no_key"], "left").drop("k", "no_key")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def _record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def record_text(date: Column) -> Column:
    """The text of a record, without the closing separator, from a ``revisits`` row. Headers are
    made anew; a revisit holds the HTTP head alone and names the record that it refers to."""
    is_revisit = F.col("original").isNotNull()
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    uri = F.expr("regexp_replace(regexp_replace(uri, '[\\\\x00-\\\\x1F\\\\x7F]', '%00'), ' ', '%20')")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _header("WARC-Record-ID", _record_id(F.col("key"), F.col("digest"))), _header("WARC-Date", date),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(is_revisit, _record_id(F.col("original"), F.col("digest")))),
        _header("X-Refers-To-Key", F.col("original").cast("string")),
        _header("X-Key", F.col("key").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END), http, body)


def write_archive(records: DataFrame, path: str) -> None:
    """Write ``revisits`` rows as WARC files under ``path``, at most RECORDS_PER_FILE in a file."""
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    (records.select(record_text(date).alias("value")).write
     .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


class Records:
    """Records of a file whose bytes come piece by piece; holds what is not yet a whole record."""

    def __init__(self) -> None:
        self.data, self.need = bytearray(), 0

    def take(self, piece: bytes) -> Iterator[dict]:
        """Rows of RECORD that are whole with these bytes."""
        self.data += piece
        data, at = self.data, 0
        while len(data) - at >= self.need:
            while data[at:at + 2] == b"\r\n":  # no record begins so: what the last separator leaves
                at += 2
            split = data.find(b"\r\n\r\n", at)
            if split < 0:
                self.need = len(data) - at + 1
                break
            head = dict(x.split(": ", 1) for x in data[at:split].decode().split("\r\n")[1:])
            block = split + 4
            end = block + int(head["Content-Length"])
            if len(data) < end + 4:  # with the separator
                self.need = end + 4 - at
                break
            body = data.index(b"\r\n\r\n", block, end) + 4
            payload = bytes(data[body:end])
            number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
            yield {"key": number("X-Key"), "record_type": head["WARC-Type"], "record_id": head["WARC-Record-ID"],
                   "target_uri": head.get("WARC-Target-URI"), "digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
                   "refers_to_key": number("X-Refers-To-Key"), "payload": payload, "payload_bytes": len(payload),
                   "payload_sha1": hashlib.sha1(payload).hexdigest()}
            at, self.need = end + 4, 0
        del data[:at]


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record under ``path`` (columns of RECORD; without ``payload`` if not asked for).
    Digest and length are taken anew from the payload read. Files must be gzip-compressed (``.gz``), which Spark reads
    from first to last in one task."""
    ship(spark)
    if not spark.read.format("binaryFile").load(path).filter(~F.col("path").endswith(".gz")).select("path").isEmpty():
        raise ValueError(f"{path} holds files that are not compressed with gzip")
    files = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    fields = [f for f in RECORD.fields if payload or f.name != "payload"]
    schema = T.StructType(fields)
    arrow = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()])
                       for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, rows, size = None, Records(), [], 0
        for batch in batches:
            of, pieces = batch.column("file").to_pylist(), batch.column("piece").to_pylist()
            for own, group in groupby(range(len(of)), of.__getitem__):
                if own != name:
                    name, file = own, Records()
                for record in file.take(_END.join([*map(pieces.__getitem__, group), b""])):
                    size += len(record["payload"]) if payload else 200
                    if not payload:
                        del record["payload"]
                    rows.append(record)
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the full payload's length and digest: revisits take them from the response
    that they refer to, by digest and key. A revisit whose response is missing keeps nulls."""
    revisit = F.col("record_type") == "revisit"
    found = (records.filter(~revisit).select(F.col("digest"), F.col("key").alias("refers_to_key"), F.col("payload_bytes").alias("full_bytes"),
                                             F.col("payload_sha1").alias("full_sha1")).dropDuplicates(["digest", "refers_to_key"]))
    return (records.join(found, ["digest", "refers_to_key"], "left")
            .withColumns({"full_bytes": F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")),
                          "full_sha1": F.when(revisit, F.col("full_sha1")).otherwise(F.col("payload_sha1"))}))


def archive(df: DataFrame, path: str, key: str = "page_id", payload: str = "html", uri: str | None = "url",
            min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``df`` as a deduplicated archive under ``path`` and read it back, revisits resolved."""
    write_archive(revisits(heads(df, key, payload, uri), min_bytes), path)
    return resolve(read_archive(df.sparkSession, path, payload=False))
