"""Content functions, image choice, code blocks and MIME parts on small inputs."""

from __future__ import annotations

import gzip
import hashlib

import zstandard
from pyspark.sql import functions as F

from papyrarc.functions import content
from papyrarc.operators import html as H
from papyrarc.operators import mhtml as M
from papyrarc.operators import recode as R
from papyrarc.operators.search import stem


def _one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_ranges(spark):
    got = _one(spark, ["bytes=0-4", "bytes=5-", "bytes=-3", "bytes=8-99", "bytes=10-", "bytes=4-2", "bytes=-0", "bytes=1-2,3-4", "x"], content.byte_range("v", F.lit(10)))
    assert [tuple(r) if r else None for r in got] == [(0, 4), (5, 9), (7, 9), (8, 9), None, None, None, None, None]


def test_truncate_keeps_whole_characters(spark):
    assert _one(spark, ["aé€😀", "abc", "", None], content.truncate_utf8("v", 5)) == ["aé", "abc", "", None]
    assert _one(spark, ["aé€😀"], content.truncate_utf8("v", 6)) == ["aé€"]


def test_warnings(spark):
    assert _one(spark, ['["a","b"]', "plain", None, "[broken"], content.parse_warnings("v")) == [["a", "b"], ["plain"], [], ["[broken"]]


def test_text_and_formats(spark):
    page = '<!DOCTYPE html><html><body><!-- c --><script>var t="</p>";</script><p>One &amp; <b>two</p><p>three</body></html>'
    assert _one(spark, [page], content.visible_text("v")) == ["One & two three"]
    assert _one(spark, ["﻿ <html>", "Content-Type: multipart/related\r\n\r\nx", "plain", None], content.detect_body_format("v")) == ["html", "mhtml", None, None]


def test_image_choice(spark):
    rows = [("a.png 320w, b.png 800w", "s", 640.0), ("a.png 320w, b.png 800w", "s", None), ("x,1.png 1x, y,2.png 2x", "s", None), ("only.png", "s", None), (None, "s", None), ("a.png 100w", "s", 500.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, srcset string, src string, w double")
    got = [r[0] for r in df.orderBy("i").select(H.choose_image_source(F.col("srcset"), F.col("src"), F.col("w"))).collect()]
    assert got == ["b.png", "b.png", "y,2.png", "only.png", "s", "a.png"]


def test_strip_removes_active_content(spark):
    page = '<p onclick="x()">a</p><script>b</script><iframe src=x></iframe><a href="javascript:go()">c</a><form><input></form><meta http-equiv="refresh" content="0">'
    (left,) = _one(spark, [page], H.strip_active("v"))
    assert not any(w in left for w in ("onclick", "script", "iframe", "form", "input", "refresh"))
    assert "<p>a</p>" in left


def test_mime_parts_decode(spark):
    raw = b'From: x\nContent-Type: multipart/related;\n\tboundary="b"\n\n--b\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\nContent-Location: http://e.com/\n\n<p>caf=C3=A9</p>\n--b\nContent-Type: image/png\nContent-Transfer-Encoding: binary\n\n\x00\x80\x81\xfe\xff\n--b--\n'
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"no mime")), (3, None)], "capture_id long, body binary")
    got = {(r.capture_id, r.pos): r for r in M.mime_parts(df).collect()}
    assert bytes(got[1, 0].data).decode() == "<p>café</p>" and bytes(got[1, 1].data) == b"\x00\x80\x81\xfe\xff"
    assert got[2, None].error and got[3, None].error


def test_recode_keeps_only_smaller_bodies(spark):
    text = b"<html>" + b"a" * 5000
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(1, text, "none", sha(text)), (2, gzip.compress(text), "gzip", sha(text)), (3, b"x", "none", sha(b"x")), (4, text, "none", "0" * 64), (5, text, "brotli", sha(text)), (6, zstandard.ZstdCompressor(level=9).compress(text), "zstd", sha(text))]
    size = {3: 1}
    df = spark.createDataFrame([(i, bytearray(b), c, h, size.get(i, len(text))) for i, b, c, h in rows], "capture_id long, body binary, compression string, content_hash string, html_size long")
    got = {r.capture_id: r for r in R.recode_bodies(df, df.limit(0)).collect()}
    assert {i: r.outcome for i, r in got.items()} == {1: "changed", 2: "changed", 3: "retained", 4: "failed", 5: "failed", 6: "retained"}
    again = R.recode_bodies(df, spark.createDataFrame([(i, r.content_hash) for i, r in got.items()], "capture_id long, content_hash string"))
    assert again.count() == 0
    assert {r.capture_id: r.problem is None for r in R.verify_bodies(df).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "running": "run", "relational": "relat", "happy": "happi", "hopping": "hop", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "adoption": "adopt", "sky": "sky", "é": "é"}
    assert {w: stem(w) for w in words} == words
