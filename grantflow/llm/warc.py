"""Web archives: monolithic gzip files made readable record by record.

``write_monolithic`` writes one WARC record per page with Spark's text writer,
so that a file is one gzip stream and can only be read from its start.
``normalise`` inflates each file once, as a stream, writes every record again
as a gzip member of its own and an offset index beside the archive (as a CDX
file, and as a table).  ``read_records`` then reads any record by its offset.

Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with
the largest id is a ``response`` and the others are ``revisit`` records, which
keep the HTTP head (with the payload's length) and its digest, not the payload.

Memory is one record and a read buffer per task.  A task that runs again
writes to a file of its own; the index table, which Spark commits, names the
file that counts.

Defined cases: a null page is an empty payload; rows that repeat the largest
id of a payload are all responses; a null id counts as the smallest (a group
of null ids only stays responses); a null url is replaced by the record's id;
line breaks in a url are percent-encoded, in the CDX file every blank; an empty table gives no records;
further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grantflow.llm.store import new_folder, open_store, staged

REVISIT_BYTES = 1000
CHUNK = 1 << 20
_END = b"\r\n\r\n"
#: Header fields of the two record types, in the order they are written.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: Column) -> Column:
    return F.when(page_id.isNull(), F.lit("<urn:page-without-id>")) \
        .otherwise(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")))


def _page_id(urn: str) -> str | None:
    return unquote_plus(urn[len("<urn:page:"):-1]) if urn.startswith("<urn:page:") else None


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
            date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the record of each page without its final blank lines."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body")) \
        .withColumn("sha", F.sha1(F.col("body").cast("binary"))) \
        .withColumn("n", F.octet_length("body").cast("long"))
    # Which pages are revisits is found on ids and digests alone; payloads
    # are only moved if that table is too large for Spark to broadcast.
    small = staged(rows.where(F.col("n") >= REVISIT_BYTES).select("id", "sha", "n"), "warc-digests")
    kept = staged(small.groupBy("sha", "n").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("copies"))
                  .where("copies > 1 AND keep IS NOT NULL"), "warc-kept")
    revisits = staged(small.join(kept, ["sha", "n"]).where(~F.col("id").eqNullSafe(F.col("keep")))
                      .select("id", "sha", "keep").distinct(), "warc-revisits")
    r = rows.alias("r").join(revisits.alias("v"), F.col("r.id").eqNullSafe(F.col("v.id"))
                             & (F.col("r.sha") == F.col("v.sha")), "left") \
        .select("r.*", "v.keep")
    again = F.col("keep").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(
            F.url_encode(F.col("id").cast("string")), F.lit("")))),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("sha"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("keep"))))
        .otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "))
    return r.select(http.alias("http"), block.alias("block"), head.alias("head")) \
        .select(F.concat("head", F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), "block").alias("value"))


def write_monolithic(spark: SparkSession, pages: DataFrame, **columns: str) -> str:
    """Archive files of one gzip stream each; returns their folder."""
    folder = new_folder(spark, "warc-monolithic")
    records(pages, **columns).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)
    return folder


# -- streams of records ------------------------------------------------------

def inflate(read) -> Iterator[bytes]:
    """Chunks of a gzip file of any number of members, of bounded size
    however well it is compressed; ``read(n)`` gives bytes."""
    member, waiting = None, b""
    while chunk := waiting or read(CHUNK):
        waiting = b""
        member = member or zlib.decompressobj(31)
        yield member.decompress(chunk, CHUNK)
        while member.unconsumed_tail and not member.eof:
            yield member.decompress(member.unconsumed_tail, CHUNK)
        if member.eof:
            waiting, member = member.unused_data, None
    if member is not None:
        yield member.flush()             # what is left of a match
        if not member.eof:
            raise ValueError("the gzip stream is cut off")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records, with their closing blank lines."""
    buffer, need = bytearray(), None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                end = buffer.find(_END)
                if end < 0:
                    break
                fields = head_fields(bytes(buffer[:end]))
                need = end + len(_END) + int(fields["content-length"]) + len(_END)
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the last record is cut off")


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield from one(source)

    def one(source: str) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{source.rpartition('/')[2].split('.')[0]}-{task.taskAttemptId()}.warc.gz"
        read_store, path = open_store(source)
        store, out_path = open_store(f"{folder}/{name}")
        store.create_dir(out_path.rpartition("/")[0], recursive=True)
        offset, rows = 0, []
        with read_store.open_input_stream(path, compression=None) as f, \
                store.open_output_stream(out_path, compression=None) as out, \
                store.open_output_stream(out_path + ".cdx", compression=None) as cdx:
            cdx.write(b" CDX a m k S V g\n")
            for record in split_records(inflate(f.read)):
                fields = head_fields(record[:record.index(_END)])
                member = gzip.compress(record, 6, mtime=0)
                out.write(member)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                url = re.sub(r"\s", lambda x: quote(x[0]), fields["warc-target-uri"])      # fields end at blanks
                mime = "text/html" if kind == "response" else "warc/revisit"
                cdx.write(f"{url} {mime} {digest} {len(member)} {offset} {name}\n".encode())
                rows.append((name, offset, len(member), fields["warc-record-id"], kind, digest))
                offset += len(member)
                if len(rows) >= 10_000:
                    yield index(rows)
                    rows = []
        yield index(rows)

    def index(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                               names=["archive", "offset", "length", "record_id", "type", "digest"])
    return run


def normalise(spark: SparkSession, monolithic: str) -> tuple[str, DataFrame]:
    """The folder of normalised archives and their index table, in archive order."""
    folder = new_folder(spark, "warc")
    files = spark.read.format("binaryFile").load(monolithic).select("path")
    files = files.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "path")
    index = files.mapInArrow(_normalise(folder), "archive string, offset long, length long, "
                                                 "record_id string, type string, digest string")
    return folder, staged(index, "warc-index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    store, path = open_store(f"{folder}/{archive}")
                    name, file = archive, store.open_input_file(path)
                rows.append(page(gzip.decompress(file.read_at(length, offset))))
            cols = zip(*rows) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                                  names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def page(record: bytes) -> tuple:
        end = record.index(_END)
        fields = head_fields(record[:end])
        block = record[end + len(_END):-len(_END)]
        http, _, payload = block.partition(_END)
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
        refers = fields.get("warc-refers-to")
        return (_page_id(fields["warc-record-id"]), size, digest, kind, refers and _page_id(refers))
    return run


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """Every indexed record, read by its offset: id, payload_bytes,
    payload_digest, record_type, refers_to (ids as text)."""
    return index.select("archive", "offset", "length").mapInArrow(
        _read(folder), "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""
