"""WARC archives as a Spark data source whose rows are chunks of records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from pathlight.llm.similar import small_side
from pathlight.operators.skew import LEAST, PARTS
from pathlight.plans.lineage import cut

#: Bytes of a payload in one row.
CHUNK = 1 << 20
#: An archive file is closed once it has this many bytes.
ROLL = 256 << 20
#: One date for all records, so that reruns write equal archives.
DATE = "2020-01-01T00:00:00Z"

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
    "payload_digest string, chunk_no long, is_last boolean, chunk binary, digest_so_far string"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class Writer(DataSourceArrowWriter):
    """Writes chunk rows as they come: a record's header with its first chunk, the other chunks after it.

    A running SHA-1 goes over the chunks of a response and must be the announced digest at its last one.
    Each task writes files of its own below ``_temporary``; the commit on the driver moves those of the tasks that
    succeeded, so a lost executor or a repeated task leaves no record twice.
    """

    def __init__(self, path: str, options: dict):
        self.path, self.roll = path, int(options.get("roll", ROLL))
        self.level = int(options.get("level", 1))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        done, out, packer = [], None, None
        fs.create_dir(f"{root}/_temporary", recursive=True)

        def put(data: bytes) -> None:
            out.write(packer.compress(data))

        so_far, wanted = hashlib.sha1(), None

        def end_record() -> None:
            nonlocal packer
            if wanted is not None and base32_sha1(so_far.digest()) != wanted:
                raise ValueError(f"the chunks of a record have the digest {base32_sha1(so_far.digest())}, not {wanted}")
            if packer is not None:
                put(b"\r\n\r\n")
                out.write(packer.flush())
                packer = None

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            small = batch.select([n for n in batch.schema.names if n != "chunk"]).to_pylist()
            for i, row in enumerate(small):
                if row["chunk_no"] == 0:
                    end_record()
                    if out is not None and out.tell() >= self.roll:
                        out.close()
                        out = None
                    if out is None:
                        done.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{root}/_temporary/{done[-1]}", compression=None)
                    packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    put(header(row))
                    so_far, wanted = hashlib.sha1(), row["payload_digest"] if row["record_type"] == "response" else None
                data = cols["chunk"][i].as_py() or b""
                so_far.update(data)
                put(data)
        end_record()
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m is not None for n in m.files):
            fs.move(f"{root}/_temporary/{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m is not None for n in m.files):
            if fs.get_file_info(f"{root}/_temporary/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/_temporary/{name}")


@dataclass
class Written(WriterCommitMessage):
    files: list


def header(row: dict) -> bytes:
    """The WARC header of a record, to the blank line."""
    body = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(row["target_uri"].split()))
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: <{row['refers_to']}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class Reader(DataSourceReader):
    """A partition for each archive file; a record of n chunks gives n rows, an empty one a single row."""

    def __init__(self, path: str, options: dict):
        self.path, self.chunk = path, int(options.get("chunk", CHUNK))

    def partitions(self) -> list[File]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [File(x.path) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz"))] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with fs.open_input_stream(partition.value, compression=None, buffer_size=1 << 18) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.value.endswith(".gz") else raw
            for row in records(stream, self.chunk):
                rows.append(row)
                held += len(row[8])
                if held >= 8 << 20 or len(rows) >= 4096:
                    yield to_batch(rows)
                    rows, held = [], 0
        if rows:
            yield to_batch(rows)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
ARROW = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in SCHEMA.split(", ")])


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW, strict=True)], schema=ARROW)


def records(stream, chunk: int) -> Iterator[tuple]:
    """Rows of one archive, never holding more than one chunk of a payload."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        left, so_far, no = int(fields["content-length"]), hashlib.sha1(), 0
        kind = fields["warc-type"]
        wanted = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        while True:
            data = stream.read(min(left, chunk)) if left else b""
            if left and not data:
                raise ValueError("the archive ends inside a record")
            left -= len(data)
            so_far.update(data)
            state = base32_sha1(so_far.digest())
            if not left and kind == "response" and wanted and wanted != state:
                raise ValueError(f"digest of {fields['warc-record-id']} is {state}, not {wanted}")
            yield (
                fields["warc-record-id"].strip("<>"),
                kind,
                fields.get("warc-target-uri"),
                fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                int(fields.get("x-payload-length", fields["content-length"])),
                wanted or state,
                no,
                not left,
                data,
                state,
            )
            no += 1
            if not left:
                break


class WarcDataSource(DataSource):
    """``spark.read.format("pathlight_warc").load(uri)`` and ``df.write.format("pathlight_warc").save(uri)``."""

    @classmethod
    def name(cls) -> str:
        return "pathlight_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("archives are only appended to; choose a new folder")
        return Writer(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 given as 40 hex digits, by tables of 5 bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(
        *[F.substring(letters, F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]
    )


def record_table(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the records of ``pages(page_id, url, html)``, ready for the writer.

    The payload is the html in UTF-8, null as empty. Of the pages with an equal payload of ``min_bytes`` bytes or more
    the one with the smallest id is a response, the others are revisits without a body that refer to it. Repeated
    rows of that smallest id are responses all. A null id is never the smallest; pages that have only null ids are
    responses. Payloads over ``chunk`` bytes become rows ``chunk_no`` 0, 1, ... of one record; the digests that join
    the pages are of the payload's digest and length, so payloads are not shuffled. Other columns are ignored; no rows
    give no rows.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    groups = rows.where(F.col("n") >= min_bytes).groupBy(F.col("sha1").alias("_sha1"), F.col("n").alias("_n"))
    first = cut(groups.agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null"))
    joined = _with_first(rows, first)
    again = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    kept = joined.select(
        F.concat(F.lit("urn:pathlight:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, F.concat(F.lit("urn:pathlight:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.col("n").alias("payload_bytes"),
        base32_of_hex(F.col("sha1")).alias("payload_digest"),
        body.alias("body"),
        F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length(body), F.lit(1)) - 1) / chunk))).alias("chunk_no"),
    )
    piece = F.substring(F.col("body"), (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))
    last = (F.col("chunk_no") + 1) * chunk >= F.octet_length("body")
    return kept.select(
        "record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "chunk_no",
        last.alias("is_last"), piece.alias("chunk"), F.lit(None).cast("string").alias("digest_so_far"),
    )


def _with_first(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``rows`` with the ``first`` page of their payload, null for single ones; payloads stay where they are.

    Beyond the number of repeated payloads that may be broadcast the rows are shuffled, but for those of the payloads
    that very many pages have.
    """
    told = small_side(first)
    if told is not first:
        return rows.join(told, (rows["sha1"] == told["_sha1"]) & (rows["n"] == told["_n"]), "left")
    limit = max(LEAST, (first.agg(F.sum("k")).first()[0] or 0) / PARTS)
    hot = F.broadcast(first.where(F.col("k") > limit).select(F.col("_sha1").alias("_hs"), F.col("_n").alias("_hn"), F.col("first").alias("_hot")))
    cold = first.where(F.col("k") <= limit)
    rows = rows.join(hot, (rows["sha1"] == hot["_hs"]) & (rows["n"] == hot["_hn"]), "left")
    key = F.when(F.col("_hot").isNull(), F.col("sha1")).otherwise(F.concat("sha1", F.lit(":"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_key", key)
    joined = rows.join(cold, (rows["_key"] == cold["_sha1"]) & (rows["n"] == cold["_n"]), "left")
    return joined.withColumn("first", F.coalesce("_hot", "first")).drop("_hot", "_hs", "_hn", "_key")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk: int = CHUNK, roll: int = ROLL) -> None:
    """Write a record for each page below ``folder``, a URI that the executors share.

    Null html is an empty payload, null urls give no target, repeated rows and null ids a record each, which then have
    one id; no rows give no archive, other columns are ignored. The cases are those of ``record_table``.
    """
    register(pages.sparkSession)
    table = record_table(pages, min_bytes, chunk)
    table.write.format("pathlight_warc").mode("append").option("roll", roll).save(folder)


def read_archives(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives in ``folder``; ``digest_so_far`` is that of the payload up to the row's end."""
    register(spark)
    return spark.read.format("pathlight_warc").option("chunk", chunk).load(folder)


def page_records(chunks: DataFrame) -> DataFrame:
    """A row for each record, from its last chunk: the digest of a response is the one computed while reading."""
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("null")).cast("long")
    digest = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest"))
    return chunks.where("is_last").select(
        number(F.col("record_id")).alias("page_id"),
        F.col("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
