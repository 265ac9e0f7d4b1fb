"""WARC archives (operator 4): write captures as request, response or revisit, and metadata records; read and assemble them."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table

CRLF = "\r\n"
REQUEST, RESPONSE, METADATA = 1, 2, 3
SALTS = 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(page_id: Column, place: Column, copy: Column, kind: int) -> Column:
    """A version 8 UUID that holds the page's id, the number of its repeated row, and the record's kind; for a page without id, its place."""
    digits = F.lpad(F.hex(F.coalesce(page_id, place)), 16, "0")
    absent = F.when(page_id.isNull(), "8001").otherwise("8000")
    return F.concat(
        F.lit("<urn:uuid:"), F.lower(F.substring(digits, 1, 8)), F.lit("-"), F.lower(F.substring(digits, 9, 4)), F.lit(f"-8{kind:03x}-"), absent,
        F.lit("-"), F.lower(F.substring(digits, 13, 4)), F.lower(F.lpad(F.hex(copy), 8, "0")), F.lit(">"),
    )


def page_of(record_id: Column) -> Column:
    """The page's id that a record's id holds; null for a page without one."""
    digits = F.concat(F.substring(record_id, 11, 8), F.substring(record_id, 20, 4), F.substring(record_id, 35, 4))
    return F.when(F.substring(record_id, 30, 4) == "8000", F.conv(digits, 16, -10).cast("long"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}")]
    for name, value in fields:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(""))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 5000, archive_bytes: int = 256 << 20) -> None:
    """Write gzipped WARC files with three records for each row.

    Of rows with equal payloads of at least `min_bytes`, the one with the largest id is a response and the
    others are revisits that refer to it; a null payload is empty. Repeated ids are numbered, so that each row has
    records of its own; of equal payloads with the same largest id the highest number is the response. A null id comes before all; rows
    without one are told apart by hashes of payload and address, so that only rows alike in all meet to be numbered. No rows
    give no records. Texts of any length are whole; other columns than the three named, whatever their names, are not read.
    A file holds the records of records_per_file rows at most, and of fewer if the largest payload asks for it, so that no archive has more
    than about archive_bytes (or one row) before compression and each can be read by one task.
    Only ids and digests are joined to find copies; a group of copies of any size is dealt over salted keys.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # rows without an id take their place by content; a text key without nulls serves both the numbering and the join, so that payloads are shuffled once
    rows = rows.withColumn("place", F.xxhash64("digest", "url")).withColumn("key", F.coalesce(F.col("page").cast("string"), F.concat(F.lit("at "), F.col("place").cast("string"))))
    numbered = lambda df: df.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("digest", "url")))
    slim = numbered(rows.select("key", "page", "place", "url", "digest", "bytes")).where(F.col("bytes") >= min_bytes)
    holders = slim.groupBy("digest").agg(F.max(F.struct("page", "place", "copy")).alias("holder"), F.count("*").alias("n")).where("n > 1")
    holders = holders.select("digest", F.col("holder.page").alias("to_page"), F.col("holder.place").alias("to_place"), F.col("holder.copy").alias("to_copy"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = (
        slim.withColumn("salt", F.pmod(F.xxhash64("key", "copy"), F.lit(SALTS)).cast("int"))
        .join(holders, ["digest", "salt"])
        .where(~(F.col("page").eqNullSafe(F.col("to_page")) & (F.col("place") == F.col("to_place")) & (F.col("copy") == F.col("to_copy"))))
        .select(F.col("key").alias("from_key"), F.col("copy").alias("from_copy"), "to_page", "to_place", "to_copy", F.lit(True).alias("again"))
    )
    # the difference keeps the second condition out of the join's keys
    all_rows = numbered(rows).join(revisits, (F.col("key") == F.col("from_key")) & ((F.col("copy") - F.col("from_copy")) == 0), "left")

    of = lambda kind: _record_id(F.col("page"), F.col("place"), F.col("copy"), kind)
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    common = [("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))), ("WARC-Date", F.lit(date))]
    http = lambda body: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF), body)
    path_of = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host_of = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    request = _record("request", [("WARC-Record-ID", of(REQUEST)), ("WARC-Concurrent-To", of(RESPONSE)), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), host_of, F.lit(CRLF + CRLF)))
    held = [("WARC-Record-ID", of(RESPONSE)), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", held, http(F.col("payload")))
    target = _record_id(F.col("to_page"), F.col("to_place"), F.col("to_copy"), RESPONSE)
    revisit = _record("revisit", [*held, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", target)], http(F.lit("")))
    metadata = _record("metadata", [("WARC-Record-ID", of(METADATA)), ("WARC-Concurrent-To", of(RESPONSE)), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF)))
    capture = F.concat_ws(CRLF * 2, request, F.when(F.col("again"), revisit).otherwise(response), metadata)
    # every record ends with two line breaks: between the records of a row by concat_ws, after a row by the sink
    largest = rows.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    in_file = max(1, min(records_per_file, archive_bytes // (largest + 4096)))
    all_rows.select(capture.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", in_file).text(path)


_READ = pa.schema([
    ("record_id", pa.string()), ("capture_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("fields", pa.string()), ("payload", pa.binary()),
])


def parse_archive(data: bytes, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, by their content lengths; a response's payload is digested anew."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split(CRLF)[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        kind = head["WARC-Type"]
        out = {
            "record_id": head["WARC-Record-ID"], "capture_id": head.get("WARC-Concurrent-To", head["WARC-Record-ID"]), "type": kind, "uri": head.get("WARC-Target-URI"),
            "date": head.get("WARC-Date"), "refers_to": head.get("WARC-Refers-To"),
        }
        if kind in ("response", "revisit"):
            out["payload_digest"] = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out |= {"digest_ok": out["payload_digest"] in (None, digest), "payload_digest": digest, "payload_bytes": len(payload)}
                if with_payload:
                    out["payload"] = payload
        else:
            out["fields"] = block.decode("utf-8", "replace")
            if kind == "metadata" and "payloadBytes: " in out["fields"]:
                out["payload_bytes"] = int(out["fields"].partition("payloadBytes: ")[2].split()[0])
        yield out


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives below `path`; an archive is parsed within one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for r in parse_archive(value.as_py(), with_payload):
                    rows.append(r)
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    schema = "record_id string, capture_id string, type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, fields string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit with the records concurrent to it.

    Records meet by the capture's id, which is a response's own id and what the others are concurrent to. A
    capture without a request or metadata record has a null there; records whose response is missing have a null response.
    """
    part = lambda kinds, *cols: F.first(F.when(F.col("type").isin(*kinds), F.struct(*cols)), ignorenulls=True)
    return records.groupBy("capture_id").agg(
        part(["response", "revisit"], "record_id", "type", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "payload").alias("response"),
        part(["request"], "record_id", "uri", "fields").alias("request"),
        part(["metadata"], "record_id", "payload_bytes", "fields").alias("metadata"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble_captures(read_records(spark, path))
    return captures.select(
        page_of(F.col("response.record_id")).alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
    )


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p GROUP BY d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}',
    CAST(((CAST('0x' || substr(p.d, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m ON p.d = m.d
"""
