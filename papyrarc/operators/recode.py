"""Stored bodies: decode, verify, recode if smaller, and reports of it. Codecs run in Arrow batches, hashes in Spark."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = ("none", "gzip", "zstd")


#: Bytes that are decoded at a time, and the most that a body may decode to unless another limit is given.
CHUNK, DECODED_LIMIT = 1 << 20, 100 << 20


def _opened(body: bytes, codec: str):
    """A body as a file of its decoded bytes, which are made as they are read."""
    if codec == "none":
        return io.BytesIO(body)
    if codec == "gzip":
        return gzip.GzipFile(fileobj=io.BytesIO(body))
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(body, read_across_frames=True)
    raise ValueError(f"unknown codec {codec}")


def chunks(body: bytes, codec: str | None, limit: int = DECODED_LIMIT) -> Iterator[bytes]:
    """A body's decoded bytes, at most CHUNK at a time; an error once they are more than `limit`."""
    total = 0
    with _opened(body, codec or "none") as f:
        while chunk := f.read(CHUNK):
            total += len(chunk)
            if total > limit:
                raise ValueError(f"more than {limit} bytes decoded")
            yield chunk


def _tried(work: Callable[[], Any]) -> tuple[Any, str | None]:
    try:
        return work(), None
    except Exception as e:  # a broken body is a finding, not a failure of the job
        return None, f"{type(e).__name__}: {e}"[:300]


def _hashed(body: bytes, codec: str | None, limit: int) -> tuple[int, str]:
    size, state = 0, hashlib.sha256()
    for chunk in chunks(body, codec, limit):
        size += len(chunk)
        state.update(chunk)
    return size, state.hexdigest()


def _part(body: bytes, codec: str | None, first: int, last: int, limit: int) -> bytes:
    """The decoded bytes from `first` to `last`; nothing is decoded beyond them."""
    out, at = [], 0
    for chunk in chunks(body, codec, limit):
        out.append(chunk[max(0, first - at) : max(0, last + 1 - at)])
        at += len(chunk)
        if at > last:
            break
    return b"".join(out)


def decode_bodies(bodies: DataFrame, limit: int = DECODED_LIMIT) -> DataFrame:
    """(capture_id, plain, error) of (capture_id, body, compression). A body that decodes to more than `limit` bytes is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a body at a time, as bodies are large
                body, codec = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                plain, error = (None, None) if body is None else _tried(lambda: b"".join(chunks(body, codec, limit)))  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([plain], pa.binary()), pa.array([error], pa.string())], names=["capture_id", "plain", "error"])

    return bodies.select("capture_id", F.col("body").cast("binary"), "compression").mapInArrow(run, "capture_id long, plain binary, error string")


def decode_ranges(bodies: DataFrame, limit: int = DECODED_LIMIT) -> DataFrame:
    """(capture_id, part, error) of (capture_id, body, compression, first, last): a range of the decoded bytes, read up to its end. A null body or range has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, codec, first, last = (batch.column(k)[i].as_py() for k in range(1, 5))
                part, error = (None, None) if None in (body, first, last) else _tried(lambda: _part(body, codec, first, last, limit))  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([part], pa.binary()), pa.array([error], pa.string())], names=["capture_id", "part", "error"])

    return bodies.select("capture_id", F.col("body").cast("binary"), "compression", F.col("first").cast("long"), F.col("last").cast("long")).mapInArrow(run, "capture_id long, part binary, error string")


def verify_bodies(bodies: DataFrame, limit: int = DECODED_LIMIT) -> DataFrame:
    """(capture_id, problem): compares hashes of decoded bodies; null if all is well. A null compression is none.

    Encoded bodies are decoded and hashed a chunk at a time where they are read; their hashes go on, not their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                body, codec = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                found.append(((None, None), None) if body is None else _tried(lambda: _hashed(body, codec, limit)))  # noqa: B023
            hashes, errors = [r and r[1] for r, _ in found], [e for _, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], names=["capture_id", "content_hash", "found", "error"])

    kind = F.coalesce("compression", F.lit("none"))
    body = F.col("body").cast("binary")
    plain = bodies.where(kind == "none").select("capture_id", "content_hash", F.sha2(body, 256).alias("found"), F.lit(None).cast("string").alias("error"))
    coded = bodies.where(kind != "none").select("capture_id", "content_hash", body.alias("body"), "compression").mapInArrow(run, "capture_id long, content_hash string, found string, error string")
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("found").isNull(), "no body").when(~F.col("found").eqNullSafe(F.col("content_hash")), "hash differs")
    return plain.union(coded).select("capture_id", problem.alias("problem"))


def verification_report(verified: DataFrame, most: int = 20) -> DataFrame:
    """One row: checked, failed, and the first failures by id."""
    first = verified.where("problem is not null").orderBy("capture_id").limit(most)
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("capture_id", "problem"))), lambda x: x["capture_id"]).alias("failures"))
    return verified.agg(F.count("*").alias("checked"), F.count_if(F.col("problem").isNotNull()).alias("failed")).crossJoin(listed)


def _smaller(body: bytes, codec: str | None, size: int, content_hash: str, limit: int) -> bytes | None:
    """The body in zstd, verified on the way and coded a chunk at a time; null unless it gets smaller."""
    import zstandard

    coder, state, total, out = zstandard.ZstdCompressor(level=9).compressobj(size=-1 if size is None else size), hashlib.sha256(), 0, []
    for chunk in chunks(body, codec, limit):
        total += len(chunk)
        state.update(chunk)
        out.append(coder.compress(chunk))
    if total != size or state.hexdigest() != content_hash:
        raise ValueError("size or hash differs")
    new = b"".join([*out, coder.flush()])
    return new if len(new) < len(body) else None


def recode_bodies(bodies: DataFrame, ledger: DataFrame, limit: int | None = None, decoded_limit: int = DECODED_LIMIT) -> DataFrame:
    """Outcome for each body that has no ledger entry for its hash: changed (with the zstd body), retained or failed.

    A body is verified before it is coded, and kept as it is unless the result is strictly smaller. A dry run uses the same
    table and drops its body. `limit` takes the bodies of the least ids: these are chosen first, without bodies.
    """
    schema = pa.schema([("capture_id", pa.int64()), ("content_hash", pa.string()), ("outcome", pa.string()), ("detail", pa.string()), ("bytes_before", pa.int64()), ("bytes_after", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, body, codec, content_hash, size = (c[i].as_py() for c in batch.columns)
                new, error = _tried(lambda: _smaller(body, codec, size, content_hash, decoded_limit))  # noqa: B023
                outcome, detail = ("failed", error) if error else ("changed", None) if new is not None else ("retained", "not smaller")
                row = {"capture_id": of, "content_hash": content_hash, "outcome": outcome, "detail": detail, "bytes_before": len(body), "bytes_after": len(body if new is None else new), "body": new}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    due = bodies.where("body is not null").join(ledger.select("capture_id", "content_hash").distinct(), ["capture_id", "content_hash"], "left_anti")
    if limit is not None:
        chosen = due.select("capture_id", "content_hash").distinct().orderBy("capture_id", "content_hash").limit(limit)
        due = due.join(chosen, ["capture_id", "content_hash"], "left_semi")
    return due.select("capture_id", F.col("body").cast("binary"), "compression", "content_hash", "html_size").mapInArrow(run, "capture_id long, content_hash string, outcome string, detail string, bytes_before long, bytes_after long, body binary")


def recode_report(outcomes: DataFrame) -> DataFrame:
    """One row: scanned, changed, retained, failed, bytes before, after and saved."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(F.count("*").alias("scanned"), n("changed").alias("changed"), n("retained").alias("retained"), n("failed").alias("failed"), F.coalesce(F.sum("bytes_before"), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("bytes_after"), F.lit(0)).alias("bytes_after")).withColumn("bytes_saved", F.col("bytes_before") - F.col("bytes_after"))
