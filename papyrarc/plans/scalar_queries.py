"""Queries over the URL and content functions (B and C of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrarc.functions import content, urls

from .base import capture_metadata, jobs, sql_domain, sql_normalise, sql_text, table
from .base import JOBS as SQL_JOBS
from .registry import Registry

registry = Registry()
query = registry.query


def _planted(segment: str, port: str) -> str:
    """URLs with a segment before their path and a port written with a zero."""
    return f"regexp_replace(regexp_replace(url, '^(https?://[^/?#]*)', '{{0}}1{segment}'), '^(http://[^/?#]*)', '{{0}}1{port}')"


@query("b1_normalise_url", f"SELECT page_id, {sql_normalise('url')} AS normalised FROM (SELECT page_id, {_planted('/%C3%A9%20%22', '').format(chr(92))} AS url FROM pages)")
def b1(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{_planted('/é \"', ':080').format('$')} AS url")
    return rows.select("page_id", urls.normalise_url("url").alias("normalised"))


_ODD = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'ftp' || substr(url, position('://' in url)) WHEN 3 THEN 'no url ' || page_id ELSE 'javascript:' || page_id END"


@query("b2_url_reject_reason", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'credentials' WHEN 2 THEN 'scheme' WHEN 3 THEN 'invalid' ELSE 'scheme' END AS reason FROM pages")
def b2(spark, sf):
    odd = table(spark, sf, "pages").selectExpr("page_id", f"{_ODD} AS odd")
    return odd.select("page_id", urls.url_reject_reason("odd").alias("reason"))


@query("b3_url_domain", f"SELECT page_id, {sql_domain('url')} AS domain FROM pages")
def b3(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_domain("url").alias("domain"))


_ADDRESS = "concat(cast(event_id % 256 as varchar), '.', cast(user_id % 256 as varchar), '.', cast(event_id * 7 % 256 as varchar), '.1')"


@query("b4_is_blocked_address", f"""SELECT event_id, a AS address, x IN (0, 10, 127) OR x >= 224 OR (x = 100 AND y BETWEEN 64 AND 127) OR (x = 169 AND y = 254)
  OR (x = 172 AND y BETWEEN 16 AND 31) OR (x = 192 AND (y = 168 OR (y = 0 AND z IN (0, 2)))) OR (x = 198 AND (y IN (18, 19) OR (y = 51 AND z = 100))) OR (x = 203 AND y = 0 AND z = 113) AS blocked
  FROM (SELECT event_id, {_ADDRESS} AS a, event_id % 256 AS x, user_id % 256 AS y, event_id * 7 % 256 AS z FROM events)""")  # fmt: skip
def b4(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", _ADDRESS.replace("varchar", "string") + " AS address")
    return rows.select("event_id", "address", urls.is_blocked_address("address").alias("blocked"))


@query("b5_has_pdf_hint", "SELECT page_id, page_id % 3 <> 2 AS hint FROM pages")
def b5(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN concat('http://x.example.com/a%2EPDF?n=', page_id) WHEN 1 THEN concat('http://x.example.com/?file=b.pdf&n=', page_id) ELSE url END AS u")
    return rows.select("page_id", urls.has_pdf_hint("u").alias("hint"))


_HREF = "CASE page_id % 6 WHEN 0 THEN '/a/../b' WHEN 1 THEN '//cdn.example.com/x' WHEN 2 THEN '#part' WHEN 3 THEN 'mailto:a@b.c' WHEN 4 THEN 'javascript:void(0)' ELSE 'https://Other.example.com' END"


@query("b6_resolve_href", r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/b' WHEN 1 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.com/x'
  WHEN 2 THEN '#part' WHEN 3 THEN 'mailto:a@b.c' WHEN 4 THEN NULL ELSE 'https://other.example.com/' END AS resolved FROM pages""")  # fmt: skip
def b6(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "url", f"{_HREF} AS href")
    return rows.select("page_id", urls.resolve_href("href", "url").alias("resolved"))


@query("b7_slugify", r"""SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'capture') AS slug FROM documents""")
def b7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", urls.slugify("text").alias("slug"))


@query("b8_response_filename", r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a b_' || page_id || '.pdf' WHEN 1 THEN 'r_' || page_id || '.pdf' WHEN 2 THEN 'bare' || page_id || '.pdf' ELSE nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '') END AS filename FROM pages""")
def b8(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "url", """CASE page_id % 4 WHEN 0 THEN concat("attachment; filename*=UTF-8''a%20b%2F", page_id, '.pdf') WHEN 1 THEN concat('attachment; filename="r/', page_id, '.pdf"') WHEN 2 THEN concat('inline; filename=bare', page_id, '.pdf; x=1') END AS header""")
    return rows.select("page_id", urls.response_filename("header", "url").alias("filename"))


@query("c1_detect_body_format", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'mhtml' END AS format FROM pages")
def c1(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN concat('From: x\\r\\nContent-Type: multipart/related;\\r\\n boundary=b\\r\\n\\r\\n', html) ELSE url END AS body")
    return rows.select("page_id", content.detect_body_format("body").alias("format"))


@query("c2_content_hash", "SELECT page_id, sha256(html) AS hash, strlen(html) AS size FROM pages")
def c2(spark, sf):
    return table(spark, sf, "pages").select("page_id", content.content_hash("html").alias("hash"), content.html_size("html").alias("size"))


@query("c3_pdf_signature_ok", "SELECT doc_id, doc_id % 4 = 0 AS ok FROM documents")
def c3(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.7', text) WHEN 1 THEN concat('%PDF', text) WHEN 2 THEN '%PDF' ELSE text END AS data")
    return rows.select("doc_id", content.pdf_signature_ok("data").alias("ok"))


@query("c4_byte_range", """SELECT doc_id, CASE k WHEN 0 THEN least(5, n - 1) WHEN 1 THEN 4 WHEN 2 THEN n - 3 END AS last, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN n - 5 END AS first FROM (SELECT doc_id, CASE k0 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 3 END AS k, n FROM (SELECT doc_id, doc_id % 5 AS k0, 10 + doc_id % 7 AS n FROM documents))""".replace("CASE k WHEN 0 THEN least(5, n - 1) WHEN 1 THEN 4 WHEN 2 THEN n - 3 END AS last, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN n - 5 END AS first", "CASE WHEN k = 0 THEN 5 WHEN k = 1 THEN n - 1 END AS last, CASE WHEN k = 0 THEN 2 WHEN k = 1 THEN n - 3 END AS first"))
def c4(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "10 + doc_id % 7 AS n", "CASE doc_id % 5 WHEN 0 THEN 'bytes=2-5' WHEN 1 THEN 'bytes=-3' WHEN 2 THEN 'bytes=99-' WHEN 3 THEN 'bytes=1-2,4-5' ELSE 'bytes=-0' END AS header")
    r = rows.select("doc_id", content.byte_range("header", "n").alias("r"))
    return r.select("doc_id", F.col("r.last").alias("last"), F.col("r.first").alias("first"))


@query("c5_visible_text", f"SELECT page_id, md5(t) AS text_md5, substr(t, 1, 300) AS excerpt FROM (SELECT page_id, {sql_text('html')} AS t FROM pages)")
def c5(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", content.visible_text("html").alias("t"))
    return rows.select("page_id", F.md5("t").alias("text_md5"), content.excerpt("t").alias("excerpt"))


@query("c6_normalise_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS code FROM documents")
def c6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(content.normalise_text("text")).alias("folded"), F.md5(content.code_signature("text")).alias("code"))


@query("c7_word_coverage", r"""SELECT a.doc_id, CASE WHEN len(wa) = 0 THEN 0 ELSE round(len(list_intersect(wa, wb)) / len(wa), 9) END AS coverage FROM
  (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS wa FROM documents) a JOIN (SELECT doc_id + 1 AS doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS wb FROM documents) b ON a.doc_id = b.doc_id""")  # fmt: skip
def c7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(before, "doc_id").select("doc_id", F.round(content.word_coverage("text", "other"), 9).alias("coverage"))


_CUT = "concat(repeat('x', CAST(doc_id % 3 AS INT)), CASE WHEN doc_id % 2 = 0 THEN repeat('\uFFFD', 400) ELSE '' END, text)"


@query("c8_truncate_utf8", """SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE (SELECT max(p) FROM (SELECT substr(text, 1, n) AS p FROM (SELECT unnest(range(240, 1001)) AS n)) WHERE strlen(p) <= 1000) END AS cut FROM (SELECT doc_id, {} AS text FROM documents)""".replace("SELECT max(p)", "SELECT arg_max(p, strlen(p))").format(_CUT))
def c8(spark, sf):
    """Every other text is cut among replacement characters of its own, at each of their bytes."""
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_CUT} AS text").select("doc_id", content.truncate_utf8("text", 1000).alias("cut"))


@query("c9_normalise_tag", r"SELECT doc_id, CASE WHEN length(t) BETWEEN 1 AND 100 THEN t END AS tag FROM (SELECT doc_id, trim(regexp_replace('  ' || text, '\s+', ' ', 'g')) AS t FROM documents)")
def c9(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "concat('  ', text) AS t")
    return rows.select("doc_id", content.normalise_tag("t").alias("tag"))


@query("c10_append_warnings", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a|b|new' WHEN 1 THEN 'plain|new' ELSE 'new' END AS warnings FROM pages")
def c10(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", """CASE page_id % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN 'plain' END AS w""")
    return rows.select("page_id", F.array_join(content.append_warnings("w", F.array(F.lit("new"))), "|").alias("warnings"))


@query("c11_payload_field", f"WITH {SQL_JOBS} SELECT job_id, CASE WHEN job_id % 10 < 4 THEN NULL ELSE 'https://site' || capture_id || '.example.com/?id=' || (job_id % 3) END AS url FROM jobs")
def c11(spark, sf):
    odd = F.element_at(F.array(*map(F.lit, ("{broken", '{"url": 5}', '{"url": {"a": "b"}}', '{"url": null}'))), (F.col("job_id") % 10 + 1).cast("int"))
    rows = jobs(spark, sf).withColumn("payload", F.when(F.col("job_id") % 10 < 4, odd).otherwise(F.col("payload")))
    return rows.select("job_id", content.payload_field("payload", "url").alias("url"))


@query("c12_archive_timestamp", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN TIMESTAMP '1970-01-01' + to_seconds(1700000000 + event_id) END AS at FROM events")
def c12(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN 'unknown' END AS v", "CASE event_id % 3 WHEN 2 THEN 'no number' ELSE cast(1700000000 + event_id AS string) END AS s")
    return rows.select("event_id", content.archive_timestamp("v", "s").cast("timestamp_ntz").alias("at"))


@query("a5_header_value", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE 'text/html; n=' || page_id END AS content_type FROM pages")
def a5(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", """CASE WHEN page_id % 4 = 3 THEN '{broken' ELSE concat('{"Content-TYPE": "text/html; n=', page_id, '", "x": "y"}') END AS h""")
    return rows.select("page_id", content.header_value("h", "content-type").alias("content_type"))


@query("e3_title_or_url_contains", f"SELECT page_id FROM pages WHERE lower(url) LIKE '%page=2&ref!_x%' ESCAPE '!' OR contains(lower(url), 'utm_source')")
def e3(spark, sf):
    return capture_metadata(spark, sf).where(content.contains_text("source_url", "PAGE=2&ref_x") | content.contains_text("source_url", "UTM_Source")).select(F.col("capture_id").alias("page_id"))
