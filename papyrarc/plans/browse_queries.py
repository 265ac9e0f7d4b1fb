"""Queries for browsing (A1, A8, E, G1-G3, H, I and J of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrarc.functions import content
from papyrarc.operators import browse as B

from .base import CAPTURES, JOBS, TAGS, capture_bodies, capture_metadata, jobs, table, tags
from .registry import Registry

registry = Registry()
query = registry.query
_NOW = "timestamp_ntz'2024-01-02 00:00:00'"

#: PDF facts by arithmetic on ids: every third capture has a PDF, every second of these an extraction.
_LINKS = "links AS (SELECT capture_id, sha256(CAST(capture_id % 5 AS VARCHAR)) AS sha256 FROM captures WHERE capture_id % 3 = 0)"
_BLOBS = "blobs AS (SELECT DISTINCT sha256, 100 AS byte_size FROM links)"
_EXTRACTIONS = "extractions AS (SELECT capture_id, CASE WHEN capture_id % 4 = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM links WHERE capture_id % 2 = 0)"


def _pdf_tables(spark, sf):
    links = capture_metadata(spark, sf).where("capture_id % 3 = 0").select("capture_id", F.sha2((F.col("capture_id") % 5).cast("string"), 256).alias("sha256"))
    blobs = links.select("sha256").distinct().withColumn("byte_size", F.lit(100))
    extractions = links.where("capture_id % 2 = 0").select("capture_id", F.when(F.col("capture_id") % 4 == 0, "succeeded").otherwise("failed").alias("status"))
    return links, blobs, extractions


_A1 = f"WITH {CAPTURES}, {_LINKS}, {_BLOBS}, {_EXTRACTIONS} SELECT c.capture_id, c.domain, c.status, l.sha256 AS pdf_sha256, b.byte_size AS pdf_size, e.status AS pdf_extraction FROM captures c LEFT JOIN links l USING (capture_id) LEFT JOIN blobs b USING (sha256) LEFT JOIN extractions e ON e.capture_id = c.capture_id"


@query("a1_metadata_scan", _A1)
@query("g2_pdf_joins", _A1)
def a1(spark, sf):
    return B.with_pdf_facts(capture_metadata(spark, sf), *_pdf_tables(spark, sf)).select("capture_id", "domain", "status", "pdf_sha256", "pdf_size", "pdf_extraction")


@query("a8_available_formats", f"""WITH {CAPTURES}, {_LINKS}, {_EXTRACTIONS} SELECT c.capture_id, CASE WHEN c.status <> 'succeeded' THEN '' ELSE 'html,article-html,markdown,markdown-zip,epub,pdf' || CASE WHEN l.sha256 IS NULL THEN '' ELSE ',source-pdf' || CASE WHEN e.status = 'succeeded' THEN ',source-pdf-text' ELSE '' END END END AS formats
  FROM captures c LEFT JOIN links l USING (capture_id) LEFT JOIN extractions e ON e.capture_id = c.capture_id""")  # fmt: skip
def a8(spark, sf):
    rows = B.with_pdf_facts(capture_metadata(spark, sf), *_pdf_tables(spark, sf)).join(capture_bodies(spark, sf), "capture_id")
    return rows.select("capture_id", F.array_join(B.available_formats(F.col("status"), content.detect_body_format("body"), F.col("pdf_sha256"), F.col("pdf_extraction")), ",").alias("formats"))


@query("e1_status_filter", f"WITH {CAPTURES} SELECT 'default' AS filter, count(*) AS n FROM captures WHERE status = 'succeeded' UNION ALL SELECT 'all', count(*) FROM captures UNION ALL SELECT 'failed', count(*) FROM captures WHERE status = 'failed'")
def e1(spark, sf):
    c = capture_metadata(spark, sf)
    parts = [B.filter_captures(c, status=s).agg(F.count("*").alias("n")).select(F.lit(s or "default").alias("filter"), "n") for s in (None, "all", "failed")]
    return parts[0].union(parts[1]).union(parts[2])


@query("e2_mode_domain_filter", f"WITH {CAPTURES} SELECT mode, domain, count(*) AS n FROM captures WHERE status = 'succeeded' AND mode = 'article' AND domain = (SELECT min(domain) FROM captures WHERE status = 'succeeded' AND mode = 'article') GROUP BY ALL")
def e2(spark, sf):
    c = capture_metadata(spark, sf)
    first = B.filter_captures(c, mode="article").agg(F.min("domain")).first()[0]
    return B.filter_captures(c, mode="article", domain=first).groupBy("mode", "domain").agg(F.count("*").alias("n"))


@query("e4_date_range", f"WITH {CAPTURES} SELECT capture_id FROM captures WHERE status = 'succeeded' AND captured_at >= TIMESTAMP '2024-01-01 01:00:00' AND captured_at < TIMESTAMP '2024-01-02 00:00:00'")
def e4(spark, sf):
    return B.filter_captures(capture_metadata(spark, sf), date_from="2024-01-01 01:00:00", date_to="2024-01-01").select("capture_id")


@query("e5_tag_filter", f"WITH {CAPTURES}, {TAGS} SELECT capture_id, domain FROM captures WHERE status = 'succeeded' AND capture_id IN (SELECT capture_id FROM tags WHERE tag = 'group 3')")
def e5(spark, sf):
    return B.filter_captures(capture_metadata(spark, sf), tag="group 3", tags=tags(spark, sf)).select("capture_id", "domain")


@query("e7_fresh_captures", f"WITH {CAPTURES}, latest AS (SELECT normalised, max(captured_at) AS seen, arg_max(capture_id, (captured_at, capture_id)) AS capture_id FROM captures WHERE status = 'succeeded' GROUP BY normalised) SELECT normalised, capture_id FROM latest WHERE seen >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 86000 SECOND")
def e7(spark, sf):
    c = capture_metadata(spark, sf)
    return B.fresh_captures(c.select("normalised").distinct(), c, 86000, F.expr(_NOW)).select("normalised", "capture_id")


@query("g1_captures_urls", f"WITH {CAPTURES}, urls AS (SELECT normalised, min(source_url) AS original FROM captures GROUP BY normalised) SELECT capture_id, original FROM captures JOIN urls USING (normalised)")
def g1(spark, sf):
    c = capture_metadata(spark, sf)
    return c.join(c.groupBy("normalised").agg(F.min("source_url").alias("original")), "normalised").select("capture_id", "original")


@query("g3_capture_tags", f"WITH {CAPTURES}, {TAGS} SELECT domain, tag, count(*) AS n FROM captures JOIN tags USING (capture_id) GROUP BY ALL")
def g3(spark, sf):
    return capture_metadata(spark, sf).join(tags(spark, sf), "capture_id").groupBy("domain", "tag").agg(F.count("*").alias("n"))


@query("h1_matching_count", f"WITH {CAPTURES}, {TAGS} SELECT count(DISTINCT c.capture_id) AS n FROM captures c JOIN tags t USING (capture_id) WHERE status = 'succeeded' AND tag = 'group 1' AND mode = 'article'")
def h1(spark, sf):
    return B.filter_captures(capture_metadata(spark, sf), tag="group 1", tags=tags(spark, sf), mode="article").agg(F.count_distinct("capture_id").alias("n"))


@query("h2_status_rollup", f"WITH {JOBS} SELECT count(*) AS total, count_if(status = 'queued') AS queued, count_if(status = 'running') AS running, count_if(status = 'succeeded') AS succeeded, count_if(status = 'failed') AS failed FROM jobs WHERE kind = 'capture'")
def h2(spark, sf):
    return B.status_counts(jobs(spark, sf).where("kind = 'capture'"), ("queued", "running", "succeeded", "failed"))


@query("h3_tag_counts", f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, lower(tag) LIMIT 20")
def h3(spark, sf):
    return B.tag_counts(tags(spark, sf), 20)


@query("h4_grouped_counts", f"WITH {JOBS} SELECT kind, status, count(*) AS n FROM jobs GROUP BY ALL")
def h4(spark, sf):
    return jobs(spark, sf).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("h5_trimmed_durations", f"WITH {CAPTURES}, r AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS i, count(*) OVER () AS n FROM captures WHERE status = 'succeeded') SELECT round(avg(duration_ms), 6) AS average, max(duration_ms) AS p95 FROM r WHERE i <= greatest(1, floor(n * 0.95))")
def h5(spark, sf):
    return B.trimmed_durations(capture_metadata(spark, sf)).select(F.round("average", 6).alias("average"), "p95")


_LATEST = f"WITH {CAPTURES} SELECT normalised, capture_id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY normalised ORDER BY captured_at DESC, capture_id DESC) AS r FROM captures WHERE status = 'succeeded') WHERE r = 1"


@query("h6_latest_capture", _LATEST)
def h6(spark, sf):
    return B.latest_captures(capture_metadata(spark, sf))


@query("h7_blob_totals", "SELECT source, count(DISTINCT sha256(text)) AS blobs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY source")
def h7(spark, sf):
    return B.blob_totals(table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size")), "source", "sha256", "size")


@query("h8_deletion_impact", f"WITH {CAPTURES}, {TAGS}, {JOBS} SELECT c.capture_id, coalesce(t.n, 0) AS tags, coalesce(j.n, 0) AS jobs FROM captures c LEFT JOIN (SELECT capture_id, count(*) AS n FROM tags GROUP BY 1) t USING (capture_id) LEFT JOIN (SELECT capture_id, count(*) AS n FROM jobs GROUP BY 1) j USING (capture_id)")
def h8(spark, sf):
    return B.deletion_impact(capture_metadata(spark, sf), tags=tags(spark, sf), jobs=jobs(spark, sf))


@query("i1_replacement_capture", f"WITH {CAPTURES}, d AS (SELECT normalised, max(capture_id) AS gone FROM captures GROUP BY normalised), l AS (SELECT c.* FROM captures c JOIN d ON c.normalised = d.normalised AND c.capture_id <> d.gone WHERE status = 'succeeded') SELECT d.normalised, arg_max(l.capture_id, (captured_at, capture_id)) AS capture_id FROM d LEFT JOIN l USING (normalised) GROUP BY 1")
def i1(spark, sf):
    c = capture_metadata(spark, sf)
    return B.replacements(c, c.groupBy("normalised").agg(F.max("capture_id").alias("capture_id"))).select("normalised", "capture_id")


@query("i2_capture_history", f"WITH {CAPTURES} SELECT capture_id, domain, row_number() OVER w AS version, date_diff('second', lag(captured_at) OVER w, captured_at) AS gap_seconds, lag(h) OVER w <> h AS changed FROM (SELECT *, md5(CAST(capture_id // 3 AS VARCHAR)) AS h FROM captures WHERE status = 'succeeded') WINDOW w AS (PARTITION BY domain ORDER BY captured_at, capture_id)")
def i2(spark, sf):
    return B.capture_history(capture_metadata(spark, sf).withColumn("content_hash", F.md5(F.expr("cast(capture_id div 3 as string)"))), "domain")


@query("i4_text_budget", "SELECT conv_id, turn, greatest(0, least(n, 2000 - before)) AS bytes_kept, before + n > 2000 AS truncated FROM (SELECT conv_id, turn, strlen(text) AS n, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM conversations)")
def i4(spark, sf):
    return B.text_budget(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2000)


@query("i5_latest_attempts", "SELECT conv_id, max(turn) AS last_attempt, count(*) AS attempts, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def i5(spark, sf):
    return B.latest_attempts(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("j1_sorted_captures", f"WITH {CAPTURES} SELECT capture_id, captured_at, row_number() OVER (ORDER BY captured_at DESC, capture_id DESC) AS place FROM captures WHERE status = 'succeeded' ORDER BY captured_at DESC, capture_id DESC LIMIT 100")
def j1(spark, sf):
    top = B.filter_captures(capture_metadata(spark, sf)).orderBy(*B.sort_keys("newest")).limit(100)
    from pyspark.sql import Window

    return top.select("capture_id", "captured_at", F.row_number().over(Window.orderBy(*B.sort_keys("newest"))).alias("place"))


@query("j2_result_page", f"WITH {CAPTURES}, c AS (SELECT * FROM captures WHERE status = 'succeeded'), n AS (SELECT count(*) AS total, (count(*) - 1) // 20 * 20 AS o FROM c) SELECT capture_id, total, o AS page_offset, o - 20 AS previous_offset FROM (SELECT *, row_number() OVER (ORDER BY captured_at DESC, capture_id DESC) AS r FROM c), n WHERE r > o AND r <= o + 20")
def j2(spark, sf):
    page = B.result_page(B.filter_captures(capture_metadata(spark, sf)), limit=20, offset=10**9)
    return page.select("capture_id", "total", "page_offset", "previous_offset")


@query("j3_tag_sort", f"WITH {TAGS} SELECT capture_id, string_agg(tag, '|' ORDER BY lower(tag)) AS tags FROM tags GROUP BY capture_id")
def j3(spark, sf):
    keyed = tags(spark, sf).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("tag").alias("k"), "tag"))).alias("t"))
    return keyed.select("capture_id", F.array_join(F.transform("t", lambda x: x["tag"]), "|").alias("tags"))


@query("j4_backlog", f"WITH {JOBS} SELECT job_id, status FROM jobs WHERE kind = 'capture' ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, CASE WHEN status IN ('running', 'queued') THEN job_id END, CASE WHEN status NOT IN ('running', 'queued') THEN -job_id END LIMIT 50")
def j4(spark, sf):
    return B.backlog(jobs(spark, sf).where("kind = 'capture'")).select("job_id", "status")


@query("j4_next_jobs", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'queued' AND attempt_count < max_attempts ORDER BY queued_at, job_id LIMIT 25")
def j4_next(spark, sf):
    return B.next_jobs(jobs(spark, sf), 25).select("job_id")


@query("j5_recent_failures", f"WITH {CAPTURES} SELECT capture_id, source_url FROM captures WHERE status = 'failed' ORDER BY captured_at DESC, capture_id DESC LIMIT 20")
def j5(spark, sf):
    return B.filter_captures(capture_metadata(spark, sf), status="failed").orderBy(*B.sort_keys("newest")).limit(20).select("capture_id", "source_url")
