"""Stored bodies in chunks, and the values that once came out wrong."""

from __future__ import annotations

import gzip
import hashlib
import tracemalloc

import pytest
import zstandard

from papyrarc.functions import content, urls
from papyrarc.operators import recode as R
from papyrarc.sources import archive as A

SHA = lambda b: hashlib.sha256(b).hexdigest()
TEXT = b"<html>" + bytes(range(256)) * 9000
ZSTD = zstandard.ZstdCompressor().compress(TEXT)


def one(spark, values, column):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(column.alias("x")).collect()]


def test_real_replacement_characters_stay(spark):
    assert one(spark, ["ab��cd"], content.truncate_utf8("v", 8)) == ["ab��"]
    assert one(spark, ["ab��cd"] * 2, content.truncate_utf8("v", 5)) == ["ab�"] * 2
    for n in range(12):
        text = "a😀é�€"
        want = max((text[:k] for k in range(len(text) + 1) if len(text[:k].encode()) <= n), key=len)
        assert one(spark, [text, None], content.truncate_utf8("v", n)) == [want, None]


def test_only_text_fields_count(spark):
    payloads = ['{"url": 5}', '{"url": {"a": 1}}', '{"url": "x\\"y"}', '{"url": null}', "[1]", "{", None, '{"other": "url"}', '{"url": true}', '{"url": ""}']
    assert one(spark, payloads, content.payload_field("v", "url")) == [None, None, 'x"y', None, None, None, None, None, None, ""]


def test_ports_and_paths(spark):
    given = ["http://a.com:080/", "https://a.com:0443/x", "http://a.com:00081/é/%C3%A9 b", "https://a.com/\"<>`{}^|+~*'"]
    assert one(spark, given, urls.normalise_url("v")) == ["http://a.com/", "https://a.com/x", "http://a.com:81/%C3%A9/%C3%A9%20b", "https://a.com/%22%3C%3E%60%7B%7D%5E|+~*'"]


def test_null_compression_is_none_and_ids_repeat(spark):
    rows = [(1, b"x", None, SHA(b"x")), (1, gzip.compress(b"y"), "gzip", SHA(b"y")), (1, gzip.compress(b"y"), "gzip", SHA(b"z")), (2, None, "zstd", SHA(b"")), (3, b"no", "zstd", SHA(b"no")), (4, b"x", "brotli", SHA(b"x"))]
    got = sorted((r.capture_id, r.problem or "") for r in R.verify_bodies(spark.createDataFrame(rows, "capture_id long, body binary, compression string, content_hash string")).collect())
    assert got[:4] == [(1, ""), (1, ""), (1, "hash differs"), (2, "no body")] and "ZstdError" in got[4][1] and "unknown codec" in got[5][1]


def test_a_bomb_is_a_finding(spark):
    bomb = zstandard.ZstdCompressor().compress(b"\0" * (8 << 20))
    rows = [(1, bomb, "zstd", SHA(b"\0" * (8 << 20)), 8 << 20), (2, ZSTD, "zstd", SHA(TEXT), len(TEXT))]
    df = spark.createDataFrame(rows, "capture_id long, body binary, compression string, content_hash string, html_size long")
    assert {r.capture_id: r.problem for r in R.verify_bodies(df, limit=4 << 20).collect()} == {1: "ValueError: more than 4194304 bytes decoded", 2: None}
    assert {r.capture_id: bool(r.error) for r in R.decode_bodies(df, limit=4 << 20).collect()} == {1: True, 2: False}
    assert {r.capture_id: r.outcome for r in R.recode_bodies(df, df.limit(0), decoded_limit=4 << 20).collect()} == {1: "failed", 2: "changed" if len(zstandard.ZstdCompressor(level=9).compress(TEXT)) < len(ZSTD) else "retained"}


@pytest.mark.parametrize("codec", ["gzip", "zstd"])
def test_large_bodies_take_little_memory(codec):
    body = zstandard.ZstdCompressor().compress(bytes(100 << 20)) if codec == "zstd" else gzip.compress(bytes(100 << 20), 1)
    tracemalloc.start()
    assert R._hashed(body, codec, R.DECODED_LIMIT) == (100 << 20, SHA(bytes(100 << 20)))
    tracemalloc.reset_peak()
    assert R._part(body, codec, 60 << 20, (60 << 20) + 9, R.DECODED_LIMIT) == bytes(10)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


@pytest.mark.parametrize(("codec", "body"), [("none", TEXT), ("gzip", gzip.compress(TEXT[:100]) + gzip.compress(TEXT[100:])), ("zstd", ZSTD)])
def test_ranges_of_decoded_bytes(spark, codec, body):
    ranges = [(0, 9), (1 << 20, (1 << 20) + 5), (len(TEXT) - 3, len(TEXT) + 50), (5, 4), (None, 3)]
    df = spark.createDataFrame([(i, body, codec, a, b) for i, (a, b) in enumerate(ranges)], "capture_id long, body binary, compression string, first long, last long")
    got = {r.capture_id: r.part for r in R.decode_ranges(df).collect()}
    assert [None if got[i] is None else bytes(got[i]) for i in range(5)] == [TEXT[:10], TEXT[1 << 20 : (1 << 20) + 6], TEXT[-3:], b"", None]


def test_a_limit_is_chosen_without_bodies(spark):
    df = spark.createDataFrame([(i, TEXT, "none", SHA(TEXT), len(TEXT)) for i in range(9)], "capture_id long, body binary, compression string, content_hash string, html_size long")
    assert sorted(r.capture_id for r in R.recode_bodies(df, df.limit(0), limit=3).collect()) == [0, 1, 2]


@pytest.mark.parametrize(("column", "value"), [("status", "lost"), ("mode", "poster"), ("compression", "brotli"), ("body_format", "pdf")])
def test_unknown_values_are_not_appended(spark, tmp_path, column, value):
    row = {"capture_id": 1, "body": "<html>", "captured_at": "2024-01-01", "status": "succeeded", "mode": "article", "compression": "none", "body_format": "html"}
    frame = lambda r: spark.createDataFrame([tuple(map(str, r.values()))], ", ".join(f"{c} string" for c in r))
    with pytest.raises(A.SourceContractError, match=value):
        A.append_captures(frame(row | {column: value}), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    A.append_captures(frame(row), str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
