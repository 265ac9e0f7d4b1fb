"""Queries of sources, ledgers, stored bodies and streams (A2-A12, D10-D13, G4-G7, I3, K, L and M of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrarc.functions import content, urls
from papyrarc.operators import browse as B
from papyrarc.operators import html as H
from papyrarc.operators import ledger as L
from papyrarc.operators import mhtml as M
from papyrarc.operators import recode as R
from papyrarc.sources import archive as A
from papyrarc.sources import legacy as G
from papyrarc.sources import tree as T
from papyrarc.streaming import jobs as J

from .html_queries import _MAIN, _MARKDOWN, rich_markdown
from .base import CAPTURES, JOBS, TAGS, capture_bodies, capture_metadata, jobs, scratch, sql_domain, sql_normalise, table, tags
from .registry import Registry

registry = Registry()
query = registry.query


#: A legacy archive out of documents: ids, URLs by number, texts as bodies; every 13th address can't be stored.
_SOURCE = """source AS (SELECT 's' || doc_id AS source_id, doc_id AS "order", CASE WHEN doc_id % 13 = 5 THEN 'ftp://old.example.com/' || doc_id ELSE 'http://www.example.com/p/' || (doc_id // 2) || '?utm_source=x' END AS url, text AS body, CASE WHEN doc_id % 29 = 3 THEN 'unreadable' END AS error FROM documents)"""
_LEDGER = """ledger AS (SELECT 's' || doc_id AS source_id, CASE doc_id % 3 WHEN 0 THEN 'imported' WHEN 1 THEN 'failed' END AS outcome, doc_id AS capture_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 = 0)"""
_STORED = """stored AS (SELECT doc_id AS capture_id, sha256(text) AS content_hash, CASE WHEN doc_id % 12 = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM documents WHERE doc_id % 6 = 0)"""


def source(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("concat('s', doc_id) AS source_id", "doc_id AS `order`", "CASE WHEN doc_id % 13 = 5 THEN concat('ftp://old.example.com/', doc_id) ELSE concat('http://www.example.com/p/', doc_id div 2, '?utm_source=x') END AS url", "text AS body", "CASE WHEN doc_id % 29 = 3 THEN 'unreadable' END AS error")


def ledger(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("doc_id % 4 = 0").selectExpr("concat('s', doc_id) AS source_id", "CASE doc_id % 3 WHEN 0 THEN 'imported' WHEN 1 THEN 'failed' END AS outcome", "doc_id AS capture_id", "sha2(text, 256) AS content_hash")


def stored(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("doc_id % 6 = 0").selectExpr("doc_id AS capture_id", "sha2(text, 256) AS content_hash", "CASE WHEN doc_id % 12 = 0 THEN 'succeeded' ELSE 'failed' END AS status")


@query("a2_candidate_files", f"WITH {CAPTURES} SELECT DISTINCT 'domain=' || domain AS snapshot FROM captures WHERE status = 'succeeded'")
def a2(spark, sf):
    """Folders of a written export, found by listing its files."""
    path = scratch(spark, "files")
    A.export_texts(capture_metadata(spark, sf), capture_bodies(spark, sf), path)
    return A.snapshot_listing(A.candidate_files(spark, path).where("length > 0 and name like 'part-%'"))


@query("a3_index_scan", f"WITH {_SOURCE} SELECT source_id, url FROM source")
def a3(spark, sf):
    return source(spark, sf).select("source_id", "url")


def _write_index(rows: DataFrame, folder: str) -> DataFrame:
    """A database of the legacy index for each partition of (id, url, timestamp, downloaded_at, extractors, tags); a task that runs again replaces its own."""

    def write(batches):
        import os
        import sqlite3
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/writing-{uuid.uuid4().hex}"
        con = sqlite3.connect(own)
        for name, columns in G.INDEX.items():
            con.execute(f"CREATE TABLE {name} ({', '.join(columns)})")
        ids = {}
        for batch in batches:
            for r in batch.to_pylist():
                con.execute("INSERT INTO core_snapshot VALUES (?, ?, ?, NULL, NULL, ?)", (r["id"], r["url"], r["timestamp"], r["downloaded_at"]))
                con.executemany("INSERT INTO core_archiveresult VALUES (?, ?, ?, NULL)", [(r["id"], x["extractor"], x["status"]) for x in r["results"]])
                con.executemany("INSERT INTO core_snapshot_tags VALUES (?, ?)", [(r["id"], ids.setdefault(t, len(ids) + 1)) for t in r["tags"]])
        con.executemany("INSERT INTO core_tag VALUES (?, ?)", [(i, t) for t, i in ids.items()])
        con.commit()
        con.close()
        done = f"{folder}/index-{TaskContext.get().partitionId():06}.sqlite3"
        os.replace(own, done)
        yield pa.RecordBatch.from_pydict({"path": [done]})

    return rows.mapInArrow(write, "path string")


@query("a3_legacy_index", f"""WITH {_SOURCE}, d AS (SELECT 's' || doc_id AS source_id, coalesce(strlen(text), 0) AS n, lang, source AS host FROM documents),
  results AS (SELECT source_id, 'wget' AS extractor, CASE WHEN n % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM d UNION ALL SELECT source_id, 'singlefile', CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'succeeded' END FROM d WHERE n % 3 = 0),
  tags AS (SELECT source_id, lang AS tag FROM d WHERE lang IS NOT NULL UNION ALL SELECT source_id, 'host ' || host FROM d WHERE host IS NOT NULL),
  r AS (SELECT source_id, count(*) AS n_results, count(*) FILTER (WHERE status = 'succeeded') AS n_succeeded FROM results GROUP BY source_id),
  t AS (SELECT source_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY source_id)
  SELECT source_id, url, CASE WHEN n % 7 = 0 THEN 'pending' ELSE 'downloaded' END AS status, coalesce(n_results, 0) AS n_results, coalesce(n_succeeded, 0) AS n_succeeded, tags FROM source JOIN d USING (source_id) LEFT JOIN r USING (source_id) LEFT JOIN t USING (source_id)""")
def a3_legacy(spark, sf):
    """Index databases made of documents, one for each task, and read again as snapshots, results and tags."""
    folder, size = G.local_path(scratch(spark, "legacy")), F.coalesce(F.octet_length("text"), F.lit(0))
    result = lambda e, ok: F.struct(F.lit(e).alias("extractor"), F.when(ok, "succeeded").otherwise("failed").alias("status"))
    facts = table(spark, sf, "documents").select(
        F.concat(F.lit("s"), "doc_id").alias("id"), F.when(size % 7 != 0, F.lit("2024-01-01")).alias("downloaded_at"),
        F.filter(F.array(result("wget", size % 2 == 0), F.when(size % 3 == 0, result("singlefile", size % 5 != 0))), lambda x: x.isNotNull()).alias("results"),
        F.filter(F.array(F.col("lang"), F.concat(F.lit("host "), "source")), lambda x: x.isNotNull()).alias("tags"),
    )
    rows = source(spark, sf).select(F.col("source_id").alias("id"), "url", F.col("order").cast("string").alias("timestamp")).join(facts, "id")
    _write_index(rows, folder).count()
    snapshots, results, tags = (G.legacy_table(spark, folder, t) for t in ("snapshots", "results", "tags"))
    counted = results.groupBy("snapshot_id").agg(F.count("*").alias("n_results"), F.count_if(F.col("status") == "succeeded").alias("n_succeeded"))
    listed = tags.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    out = snapshots.withColumnRenamed("id", "snapshot_id").join(counted, "snapshot_id", "left").join(listed, "snapshot_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("snapshot_id").alias("source_id"), "url", F.when(F.col("downloaded_at").isNull(), "pending").otherwise("downloaded").alias("status"), zero("n_results"), zero("n_succeeded"), "tags")


@query("a4_snapshot_listing", "SELECT DISTINCT 'src' || regexp_extract(source, '([0-9]+)$', 1) AS snapshot FROM documents")
def a4(spark, sf):
    return A.snapshot_listing(table(spark, sf, "documents").select(F.col("source").alias("snapshot")))


@query("a6_append_captures", f"WITH {CAPTURES} SELECT capture_id, CAST(CAST(captured_at AS DATE) AS VARCHAR) AS day, sha256(body) AS content_hash, strlen(body) AS html_size, 'html' AS body_format FROM captures")
def a6(spark, sf):
    path = scratch(spark, "captures")
    A.append_captures(capture_metadata(spark, sf).join(capture_bodies(spark, sf), "capture_id"), path)
    return spark.read.parquet(path).select("capture_id", F.col("capture_date").cast("string").alias("day"), "content_hash", "html_size", "body_format")


@query("a7_run_report")
def a7(spark, sf):
    return A.run_report(L.plan_import(source(spark, sf), ledger(spark, sf), stored(spark, sf), retry_failed=True))


@query("a9_export_texts", f"SELECT page_id AS capture_id, {sql_domain('url')} AS domain, md5({_MAIN}) AS text_md5 FROM pages WHERE page_id % 10 <> 9")
def a9(spark, sf):
    path = scratch(spark, "export")
    A.export_texts(capture_metadata(spark, sf).select("capture_id", "domain", "status"), capture_bodies(spark, sf).select("capture_id", H.main_text("body").alias("text")), path)
    return spark.read.schema("capture_id long, text string, domain string").json(path).select("capture_id", "domain", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("a9_export_markdown", f"WITH {_MARKDOWN} SELECT page_id AS capture_id, {sql_domain('url')} AS domain, md5(markdown) AS text_md5 FROM md WHERE page_id % 10 <> 9")
def a9_markdown(spark, sf):
    """Markdown and metadata of succeeded captures, written and read again."""
    path = scratch(spark, "export")
    A.export_texts(capture_metadata(spark, sf).select("capture_id", "domain", "status"), rich_markdown(spark, sf, "capture_id").select("capture_id", F.col("markdown").alias("text")), path)
    return spark.read.schema("capture_id long, text string, domain string").json(path).select("capture_id", "domain", F.md5("text").alias("text_md5"))


@query("a10_domain_violations", f"WITH {JOBS} SELECT 'status' AS \"column\", status AS value, count(*) AS n FROM jobs WHERE status IN ('failed', 'cancelled') GROUP BY status")
def a10(spark, sf):
    rows = jobs(spark, sf)
    A.require_source({"jobs": rows}, {"jobs": ["job_id", "status"]})
    return A.domain_violations(rows, {"status": ["queued", "running", "succeeded"], "kind": ["capture", "import"]})


def _sql_types(name: str, columns: list[str]) -> str:
    types = " || ',' || ".join(f"'{c} ' || replace(replace(typeof({c}), 'VARCHAR', 'string'), 'BIGINT', 'bigint')" for c in columns)
    return f"(SELECT '{name}(' || max({types}) || ')' FROM {name})"


@query("a11_schema_fingerprint", f"SELECT sha256({_sql_types('documents', ['doc_id', 'lang', 'n_chars', 'source', 'text'])} || chr(10) || {_sql_types('pages', ['html', 'page_id', 'url'])}) AS fingerprint")
def a11(spark, sf):
    return A.schema_fingerprint({n: table(spark, sf, n) for n in ("documents", "pages")})


_SUM = "CAST(sum(CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)) AS VARCHAR)"


@query("a12_changed_rows", "SELECT doc_id, CASE WHEN doc_id % 101 = 7 THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE doc_id % 101 = 7 OR doc_id % 103 = 5 UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 107 = 2")
def a12_changed(spark, sf):
    """Rows that were lost, altered and added between two snapshots, found by their trees of checksums."""
    docs, paths = table(spark, sf, "documents"), [scratch(spark, f"tree{k}") for k in range(2)]
    after = docs.where("doc_id % 101 <> 7").withColumn("text", F.when(F.col("doc_id") % 103 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    after = after.unionByName(docs.where("doc_id % 107 = 2").withColumn("doc_id", -1 - F.col("doc_id")))
    for df, path in zip((docs, after), paths, strict=True):
        T.write_tree_snapshot(df, path, ["doc_id"])
    return T.changed_rows(spark, *paths, ["doc_id"])


@query("a12_table_snapshot", f"""SELECT 'labels' AS name, count(*) AS n_rows, {_SUM.format("concat_ws('|', doc_id, quality, toxic)")} AS checksum, true AS ok FROM labels
  UNION ALL SELECT 'pages', count(*), {_SUM.format("concat_ws('|', html, page_id, url)")}, true FROM pages""")  # fmt: skip
def a12(spark, sf):
    path = scratch(spark, "snapshot")
    A.write_snapshot({n: table(spark, sf, n) for n in ("labels", "pages")}, path)
    return A.verify_snapshot(spark, path, ["labels", "pages"])


@query("g4_unprocessed", "SELECT doc_id AS capture_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0")
def g4(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id AS capture_id", "sha2(text, 256) AS content_hash")
    entries = rows.where("capture_id % 3 = 0").withColumn("content_hash", F.when(F.col("capture_id") % 6 == 0, "another").otherwise(F.col("content_hash")))
    return L.unprocessed(rows, entries, ["capture_id", "content_hash"]).select("capture_id")


@query("g5_orphans", f"WITH {TAGS}, {JOBS}, u AS (SELECT DISTINCT 'https://site' || user_id || '.example.com/?id=' || n AS normalised FROM events, (SELECT unnest([0, 1, 2, 3]) AS n)), used AS (SELECT DISTINCT payload[10:len(payload) - 2] AS url FROM jobs) SELECT 'url' AS kind, normalised AS name FROM u WHERE normalised NOT IN (SELECT url FROM used) UNION ALL SELECT 'tag', 'unused'")
def g5(spark, sf):
    used = tags(spark, sf)
    names = used.select("tag").distinct().union(used.limit(1).select(F.lit("unused").alias("tag")))
    j = jobs(spark, sf)
    u = j.select(F.explode(F.array(*(F.concat(F.lit("https://site"), F.col("capture_id").cast("string"), F.lit(f".example.com/?id={n}")) for n in range(4)))).alias("normalised")).distinct()
    lost = L.orphan_urls(u, capture_metadata(spark, sf), j)
    return lost.select(F.lit("url").alias("kind"), F.col("normalised").alias("name")).union(L.orphan_tags(names, used).select(F.lit("tag").alias("kind"), F.col("tag").alias("name")))


@query("g5_orphan_blobs", "WITH b AS (SELECT doc_id, sha256(text) AS sha256, strlen(text) AS byte_size FROM documents) SELECT DISTINCT sha256, byte_size FROM b WHERE sha256 NOT IN (SELECT sha256 FROM b WHERE doc_id % 3 = 0 OR doc_id % 5 = 0)")
def g5_blobs(spark, sf):
    """Texts as blobs, every third of which a capture refers to and every fifth an enrichment."""
    of = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_size"))
    return L.orphan_blobs(of.select("sha256", "byte_size").distinct(), of.where("doc_id % 3 = 0"), of.where("doc_id % 5 = 0"))


_VERIFY = f"""WITH {_SOURCE}, {_LEDGER}, {_STORED}, v AS (SELECT coalesce(s.source_id, l.source_id) AS source_id, CASE WHEN l.source_id IS NULL THEN 'not in the ledger' WHEN outcome IS NULL THEN 'pending' WHEN outcome = 'imported' AND c.status IS NULL THEN 'capture is missing'
  WHEN outcome = 'imported' AND c.status <> 'succeeded' THEN 'capture did not succeed' WHEN outcome = 'imported' AND c.content_hash <> l.content_hash THEN 'hash differs' END AS problem FROM source s FULL JOIN ledger l USING (source_id) LEFT JOIN stored c ON c.capture_id = l.capture_id)"""


@query("g6_verify_imports", f"{_VERIFY} SELECT source_id, problem FROM v")
def g6(spark, sf):
    return L.verify_imports(ledger(spark, sf), stored(spark, sf), source(spark, sf), "source_id")


@query("l3_reconcile", f"{_VERIFY} SELECT count(*) AS total, count_if(outcome = 'imported') AS imported, 0 AS duplicate, 0 AS skipped, count_if(outcome = 'failed') AS failed, count_if(outcome IS NULL) AS pending, (SELECT count_if(problem IS NOT NULL) FROM v) AS problems, false AS ok FROM ledger")
def l3(spark, sf):
    return L.reconcile(ledger(spark, sf), L.verify_imports(ledger(spark, sf), stored(spark, sf), source(spark, sf), "source_id"))


@query("g7_match_stored", f"WITH {_STORED}, m AS (SELECT content_hash, min(capture_id) AS stored_id FROM stored WHERE status = 'succeeded' GROUP BY 1) SELECT doc_id, stored_id FROM documents LEFT JOIN m ON m.content_hash = sha256(text)")
def g7(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "sha2(text, 256) AS content_hash")
    return L.match_stored(rows, stored(spark, sf)).select("doc_id", "stored_id")


@query("i3_first_usable", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'singlefile.html' WHEN page_id % 3 = 1 THEN 'output.html' END AS chosen, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'singlefile.html' ELSE 'singlefile.html,output.html' END AS rejected FROM pages")
def i3(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(n).alias("name")) for p, n in enumerate(("singlefile.html", "output.html"))))).alias("c"))
    rows = rows.select("page_id", "c.*").withColumn("usable", F.col("page_id") % 3 == F.col("priority"))
    return B.first_usable(rows, "page_id", "priority", "usable", "name").withColumn("rejected", F.array_join("rejected", ","))


@query("k1_set_differences", "SELECT 's' || doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'orphan' ELSE 'missing' END AS state FROM documents WHERE (doc_id % 2 = 0) <> (doc_id % 3 = 0)")
def k1(spark, sf):
    ids = table(spark, sf, "documents").selectExpr("doc_id", "concat('s', doc_id) AS source_id")
    return L.set_differences(ids.where("doc_id % 2 = 0"), ids.where("doc_id % 3 = 0"), "source_id")


@query("k2_identity_conflicts", f"WITH {_SOURCE} SELECT source_id, url FROM source WHERE \"order\" % 17 = 0")
def k2(spark, sf):
    rows = source(spark, sf)
    known = rows.withColumn("url", F.when(F.col("order") % 17 == 0, "http://else.example.com/").otherwise(F.col("url")))
    return L.identity_conflicts(known, rows, "source_id", ["url"]).select("source_id", "url")


@query("l1_upsert_urls", f"WITH n AS (SELECT {sql_normalise('url')} AS normalised, url, page_id FROM pages), known AS (SELECT DISTINCT normalised FROM n WHERE page_id % 3 = 0) SELECT normalised, arg_min(url, page_id) AS original FROM n WHERE normalised NOT IN (SELECT normalised FROM known) GROUP BY normalised")
def l1(spark, sf):
    pages = table(spark, sf, "pages")
    known = pages.where("page_id % 3 = 0").select(urls.normalise_url("url").alias("normalised")).distinct()
    return L.upsert_urls(known, pages, "url", "page_id").select("normalised", "original")


_PLANNED = f"""{_SOURCE}, {_LEDGER}, {_STORED}, due AS (SELECT *, sha256(body) AS h, "order" % 13 = 5 AS bad FROM source WHERE source_id NOT IN (SELECT source_id FROM ledger WHERE outcome IS NOT NULL AND outcome <> 'failed')),
  m AS (SELECT content_hash, min(capture_id) AS stored_id FROM stored WHERE status = 'succeeded' GROUP BY 1), r AS (SELECT due.*, stored_id, min(CASE WHEN error IS NULL AND NOT bad AND stored_id IS NULL THEN "order" END) OVER (PARTITION BY h) AS first FROM due LEFT JOIN m ON m.content_hash = h),
  planned AS (SELECT source_id, url, body, "order", CASE WHEN error IS NOT NULL THEN 'failed' WHEN stored_id IS NOT NULL OR "order" > first THEN 'duplicate' WHEN bad THEN 'skipped' ELSE 'imported' END AS outcome,
  CASE WHEN error IS NOT NULL THEN NULL WHEN stored_id IS NOT NULL THEN stored_id WHEN "order" > first THEN top + 1 + first WHEN bad THEN NULL ELSE top + 1 + "order" END AS capture_id FROM r, (SELECT max(capture_id) AS top FROM stored))"""


@query("l2_plan_import", f"WITH {_PLANNED} SELECT source_id, outcome, capture_id FROM planned")
def l2(spark, sf):
    return L.plan_import(source(spark, sf), ledger(spark, sf), stored(spark, sf), retry_failed=True).select("source_id", "outcome", "capture_id")


@query("l2_import_tables", f"""WITH {_PLANNED} SELECT 'capture' AS kind, capture_id, 'imported_singlefile' AS value FROM planned WHERE outcome = 'imported' UNION ALL SELECT 'capture', capture_id, NULL FROM stored
  UNION ALL SELECT DISTINCT 'alias', capture_id, url FROM planned WHERE outcome IN ('imported', 'duplicate') UNION ALL SELECT DISTINCT 'tag', capture_id, 'group ' || ("order" % 3) FROM planned WHERE outcome IN ('imported', 'duplicate')""")  # fmt: skip
def l2_tables(spark, sf):
    """An import as one job: captures, aliases and tags after it."""
    rows = source(spark, sf).withColumn("tags", F.array(F.concat(F.lit(" group  "), (F.col("order") % 3).cast("string")), F.lit("")))
    none = spark.createDataFrame([], "capture_id long, url string, kind string, tag string")
    out = L.import_tables(rows, L.plan_import(rows, ledger(spark, sf), stored(spark, sf), retry_failed=True), stored(spark, sf), none.select("capture_id", "url", "kind"), none.select("capture_id", "tag"))
    row = lambda name, value, table_: out[table_].select(F.lit(name).alias("kind"), "capture_id", F.col(value).alias("value"))
    return row("capture", "mode", "captures").union(row("alias", "url", "aliases")).union(row("tag", "tag", "tags"))


@query("a7_reported_outcomes", f"WITH {_PLANNED} SELECT outcome, count(*) AS n, (SELECT count(*) FROM planned) AS total, CASE WHEN outcome = 'failed' THEN least(100, count(*)) END AS listed FROM planned GROUP BY outcome")
def a7_outcomes(spark, sf):
    """The run report's document, read again: its counts, total, and how many failures it lists."""
    report = F.from_json("report", "total long, outcomes map<string,long>, failures array<struct<source_id:string,detail:string>>")
    read = A.run_report(L.plan_import(source(spark, sf), ledger(spark, sf), stored(spark, sf), retry_failed=True)).select(report.alias("r"))
    rows = read.select(F.explode("r.outcomes").alias("outcome", "n"), F.col("r.total").alias("total"), F.size("r.failures").cast("long").alias("failures"))
    return rows.select("outcome", "n", "total", F.when(F.col("outcome") == "failed", F.col("failures")).alias("listed"))


#: PDFs of a legacy archive: by the document's number an original, a page, a missing file, two outputs, a wrong length.
def pdf_tables(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", "concat('s', doc_id) AS snapshot_id", "doc_id % 5 AS k")
    results = docs.selectExpr("snapshot_id", "'wget' AS extractor", "'succeeded' AS status", "'a.pdf' AS output").union(docs.selectExpr("snapshot_id", "'headers'", "'succeeded'", "'headers.json'")).union(docs.where("k = 3").selectExpr("snapshot_id", "'wget'", "'succeeded'", "'b.pdf'"))
    size = "octet_length(concat('%PDF-1.7 ', doc_id % 11))"
    files = docs.where("k <> 2").selectExpr("snapshot_id", "'a.pdf' AS path", "cast(CASE WHEN k = 1 THEN '<html>' ELSE concat('%PDF-1.7 ', doc_id % 11) END AS binary) AS content").union(
        docs.selectExpr("snapshot_id", "'headers.json'", f"""cast(concat('{{"Content-Type": "', CASE WHEN k = 1 THEN 'text/html' ELSE 'application/pdf; q=1' END, '", "content-length": "', {size} + CASE WHEN k = 4 THEN 1 ELSE 0 END, '"}}') AS binary)""")
    )
    return docs, results, files


_PDF = "c AS (SELECT doc_id, 's' || doc_id AS snapshot_id, ['accepted', 'MIME type is not application/pdf', 'wget output is missing', 'no single pair of succeeded wget and headers outputs', 'Content-Length differs from the file'][doc_id % 5 + 1] AS detail FROM documents)"


@query("l4_classify_pdfs", f"WITH {_PDF} SELECT snapshot_id, detail = 'accepted' AS accepted, CASE WHEN detail <> 'accepted' THEN detail END AS detail FROM c")
def l4(spark, sf):
    return L.classify_original_pdfs(*pdf_tables(spark, sf), 100 << 20).select("snapshot_id", "accepted", "detail")


@query("l5_enrich_pdfs", f"WITH {_PDF}, due AS (SELECT * FROM c WHERE doc_id % 10 <> 0) SELECT sha256('%PDF-1.7 ' || (doc_id % 11)) AS sha256, count(*) AS uses FROM due WHERE detail = 'accepted' GROUP BY 1")
def l5(spark, sf):
    docs, results, files = pdf_tables(spark, sf)
    done = docs.where("doc_id % 10 = 0").selectExpr("snapshot_id", "'enriched' AS outcome", "cast(NULL AS string) AS sha256", "cast(NULL AS string) AS detail", "cast(1 AS bigint) AS attempt_count", "1 AS run")
    return L.enrich_pdfs(L.classify_original_pdfs(docs, results, files, 100 << 20), done, 2)["blobs"].select("sha256", "uses")


def bodies(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), F.col("html").cast("binary").alias("body"), F.lit("none").alias("compression"), F.when(F.col("page_id") % 7 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("html", 256)).alias("content_hash"), F.octet_length("html").cast("long").alias("html_size"))


@query("l6_recode_bodies", "SELECT page_id AS capture_id, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'changed' END AS outcome, strlen(html) AS bytes_before, CASE WHEN page_id % 7 <> 0 THEN sha256(html) END AS decoded FROM pages WHERE page_id % 5 <> 0 OR page_id % 7 = 0")
def l6(spark, sf):
    rows = bodies(spark, sf)
    done = rows.where("capture_id % 5 = 0 and capture_id % 7 <> 0").select("capture_id", "content_hash")
    coded = R.recode_bodies(rows, done)
    plain = R.decode_bodies(coded.where("body is not null").select("capture_id", "body", F.lit("zstd").alias("compression"))).select("capture_id", F.sha2("plain", 256).alias("decoded"))
    return coded.select("capture_id", "outcome", "bytes_before").join(plain, "capture_id", "left")


@query("h9_recode_report")
def h9(spark, sf):
    return R.recode_report(R.recode_bodies(bodies(spark, sf), bodies(spark, sf).limit(0)))


_PROBLEMS = "SELECT page_id AS capture_id, CASE WHEN page_id % 7 = 0 THEN 'hash differs' END AS problem FROM pages"


@query("h9_recode_counts", "SELECT count(*) AS scanned, count_if(page_id % 7 <> 0) AS changed, CAST(0 AS BIGINT) AS retained, count_if(page_id % 7 = 0) AS failed, CAST(sum(strlen(html)) AS BIGINT) AS bytes_before FROM pages")
def h9_counts(spark, sf):
    """The report's figures that don't depend on the codec."""
    return R.recode_report(R.recode_bodies(bodies(spark, sf), bodies(spark, sf).limit(0))).select("scanned", "changed", "retained", "failed", "bytes_before")


@query("h4_outcome_counts", f"WITH {_LEDGER} SELECT coalesce(outcome, 'pending') AS outcome, count(*) AS n FROM ledger GROUP BY 1")
def h4_outcomes(spark, sf):
    return L.outcome_counts(ledger(spark, sf))


@query("l7_verify_bodies", _PROBLEMS)
def l7(spark, sf):
    """A null compression is none."""
    return R.verify_bodies(bodies(spark, sf).withColumn("compression", F.when(F.col("capture_id") % 5 > 0, F.col("compression"))))


@query("l7_verify_coded_bodies", _PROBLEMS)
def l7_coded(spark, sf):
    plain = bodies(spark, sf)
    coded = R.recode_bodies(plain.withColumn("content_hash", F.sha2("body", 256)), plain.limit(0)).where("body is not null")
    return R.verify_bodies(coded.select("capture_id", "body", F.lit("zstd").alias("compression"), F.when(F.col("capture_id") % 7 == 0, "wrong").otherwise(F.col("content_hash")).alias("content_hash")))


@query("c4_decoded_ranges", "SELECT page_id AS capture_id, substr(hex(encode(html)), CAST(page_id % 50 * 2 + 1 AS BIGINT), 400) AS part FROM pages WHERE page_id % 7 <> 0")
def c4_ranges(spark, sf):
    """200 bytes of each stored body, decoded up to their end only."""
    coded = R.recode_bodies(bodies(spark, sf), bodies(spark, sf).limit(0)).where("body is not null").withColumns({"compression": F.lit("zstd"), "first": F.col("capture_id") % 50, "last": F.col("capture_id") % 50 + 199})
    return R.decode_ranges(coded).select("capture_id", F.hex("part").alias("part"))


@query("l7_verification_report", "SELECT count(*) AS checked, count_if(page_id % 7 = 0) AS failed, array_to_string(list_slice(list(page_id ORDER BY page_id) FILTER (page_id % 7 = 0), 1, 20), ',') AS failures FROM pages")
def l7_report(spark, sf):
    return R.verification_report(R.verify_bodies(bodies(spark, sf))).select("checked", "failed", F.array_join("failures", ",").alias("failures"))


@query("l8_backfill_format", "SELECT page_id AS capture_id, 'html' AS body_format FROM pages WHERE page_id % 2 = 0")
def l8(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), F.col("html").alias("body"), F.when(F.col("page_id") % 2 == 1, "html").alias("body_format"))
    return L.backfill_body_format(rows)


@query("l9_delete_captures", f"WITH {CAPTURES}, {TAGS}, {JOBS} SELECT 'captures' AS name, count(*) AS n FROM captures WHERE capture_id % 4 <> 0 UNION ALL SELECT 'tags', count(*) FROM tags WHERE capture_id % 4 <> 0 OR capture_id NOT IN (SELECT capture_id FROM captures) UNION ALL SELECT 'marked', count(*) FROM jobs WHERE capture_id % 4 = 0 AND capture_id IN (SELECT capture_id FROM captures)")
def l9(spark, sf):
    c = capture_metadata(spark, sf)
    out = L.delete_captures(c, c.where("capture_id % 4 = 0"), jobs(spark, sf), tags=tags(spark, sf))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one(out["captures"], "captures").union(one(out["tags"], "tags")).union(one(out["jobs"].where("result is not null"), "marked"))


@query("l10_submit_jobs", f"WITH {JOBS}, live AS (SELECT kind, idempotency_key, max(job_id) AS existing_job FROM jobs WHERE status IN ('queued', 'running', 'succeeded') AND job_id % 2 = 0 GROUP BY ALL), q AS (SELECT job_id AS request_id, kind, idempotency_key FROM jobs WHERE job_id % 2 = 1), f AS (SELECT kind, idempotency_key, min(request_id) AS first FROM q GROUP BY ALL) SELECT request_id, existing_job, CASE WHEN existing_job IS NULL THEN first END AS job_key FROM q LEFT JOIN live USING (kind, idempotency_key) LEFT JOIN f USING (kind, idempotency_key)")
def l10(spark, sf):
    j = jobs(spark, sf)
    requests = j.where("job_id % 2 = 1").select(F.col("job_id").alias("request_id"), "kind", "idempotency_key", F.col("job_id").alias("order"))
    return L.submit_jobs(j.where("job_id % 2 = 0"), requests)


@query("l11_merge_tags", f"WITH {TAGS} SELECT tag, count(*) AS n FROM (SELECT * FROM tags UNION SELECT doc_id, 'new tag' FROM labels) WHERE NOT (tag = 'quality' AND capture_id % 2 = 0) GROUP BY tag")
def l11(spark, sf):
    t = tags(spark, sf)
    added = table(spark, sf, "labels").select(F.col("doc_id").alias("capture_id"), F.lit("  new   tag ").alias("tag"))
    return L.merge_tags(t, added, t.where("tag = 'quality' and capture_id % 2 = 0")).groupBy("tag").agg(F.count("*").alias("n"))


@query("l12_alias_and_metadata", f"WITH {CAPTURES} SELECT 'alias' AS kind, CAST(count(*) AS VARCHAR) AS value FROM (SELECT capture_id, source_url FROM captures UNION SELECT capture_id, normalised FROM captures) UNION ALL SELECT role, arg_max(text, (conv_id, turn)) FROM conversations GROUP BY role")
def l12(spark, sf):
    c = capture_metadata(spark, sf)
    old = c.select("capture_id", F.col("source_url").alias("url"), F.lit("original").alias("kind"))
    more = c.select("capture_id", F.col("normalised").alias("url"), F.lit("canonical").alias("kind"))
    merged = L.merge_aliases(old, more.union(more)).agg(F.count("*").cast("string").alias("value")).select(F.lit("alias").alias("kind"), "value")
    talk = table(spark, sf, "conversations").select(F.col("role").alias("kind"), F.col("text").alias("value"), F.struct("conv_id", "turn").alias("seq"))
    return merged.union(L.upsert_metadata(talk.where("seq.turn = 0"), talk.where("seq.turn <> 0"), ["kind"], "seq").select("kind", "value"))


@query("l13_recover_jobs", f"WITH {JOBS} SELECT CASE WHEN status = 'running' THEN CASE WHEN attempt_count < max_attempts THEN 'queued' ELSE 'failed' END ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")
def l13(spark, sf):
    return L.recover_jobs(jobs(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


#: An MHTML file for each page: its HTML in quoted-printable form, a style sheet and a picture.
def mhtml_bodies(spark, sf) -> DataFrame:
    crlf = "\r\n"
    head = F.concat(F.lit(f"From: <Saved>{crlf}Snapshot-Content-Location: "), F.col("url"), F.lit(f'{crlf}MIME-Version: 1.0{crlf}Content-Type: multipart/related;{crlf} type="text/html";{crlf} boundary="xYz"{crlf}{crlf}'))
    part = lambda kind, encoding, location, data, more="": F.concat(F.lit(f"--xYz{crlf}Content-Type: {kind}{crlf}Content-Transfer-Encoding: {encoding}{crlf}{more}Content-Location: "), location, F.lit(crlf * 2), data, F.lit(crlf))
    quoted = F.replace(F.replace(F.lit('<html><img src="/a.png">'), F.lit("="), F.lit("=3D")), F.lit("xx"), F.lit("xx"))
    css = part("text/css", "binary", F.lit("http://cdn.example.com/s%20t.css"), F.lit("p{margin:0}"))
    png = part("image/png", "base64", F.lit("http://img.example.com/a.png"), F.base64(F.col("html").cast("binary")), f"Content-ID: <pic@x>{crlf}")
    body = F.concat(head, css, part("text/html", "quoted-printable", F.col("url"), quoted), png, F.lit(f"--xYz--{crlf}"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), body.alias("body"))


@query("d10_mime_parts", "SELECT page_id AS capture_id, pos, ['text/css', 'text/html', 'image/png'][pos + 1] AS type, CASE pos WHEN 0 THEN 11 WHEN 1 THEN 24 ELSE strlen(html) END AS bytes FROM (SELECT *, unnest([0, 1, 2]) AS pos FROM pages)")
def d10(spark, sf):
    return M.mime_parts(mhtml_bodies(spark, sf)).select("capture_id", "pos", "type", "bytes")


@query("d11_root_parts", "SELECT page_id AS capture_id, 1 AS pos, url AS location FROM pages")
def d11(spark, sf):
    return M.root_parts(M.mime_parts(mhtml_bodies(spark, sf))).select("capture_id", "pos", "location")


@query("d12_resolve_references", """SELECT page_id AS capture_id, r AS reference, CASE r WHEN '/none' THEN NULL WHEN 's t.css' THEN 0 ELSE 2 END AS pos, CASE r WHEN 'http://img.example.com/a.png' THEN 'location' WHEN 'a.png' THEN 'resolved' WHEN 'cid:pic@x' THEN 'cid' WHEN 'http://img.example.com/a.png#f' THEN 'bare' WHEN 's t.css' THEN 'contained' END AS "by"
  FROM (SELECT page_id, unnest(['http://img.example.com/a.png', 'a.png', 'cid:pic@x', 'http://img.example.com/a.png#f', 's t.css', '/none']) AS r FROM pages)""")  # fmt: skip
def d12(spark, sf):
    parts = M.mime_parts(mhtml_bodies(spark, sf)).select("capture_id", "pos", "location", "content_id")
    named = ["http://img.example.com/a.png", "a.png", "cid:pic@x", "http://img.example.com/a.png#f", "s t.css", "/none"]
    refs = table(spark, sf, "pages").select(F.col("page_id").alias("capture_id"), F.explode(F.array(*map(F.lit, named))).alias("reference"), F.lit("http://img.example.com/index.html").alias("base"))
    return M.resolve_references(refs, parts)


@query("d13_oversize_report", "SELECT page_id AS capture_id, strlen(html) + 35 AS total, strlen(html) AS eligible, strlen(html) + 35 - 4000 AS to_save FROM pages WHERE strlen(html) + 35 > 4000")
def d13(spark, sf):
    return M.oversize_report(M.mime_parts(mhtml_bodies(spark, sf)).select("capture_id", "type", "bytes"), 4000).select("capture_id", "total", "eligible", "to_save")


def submissions(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query("m1_suppress_fresh", """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f AS (SELECT key, event_id, ts, i, ts AS last, true AS ok FROM e WHERE i = 1 UNION ALL SELECT e.key, e.event_id, e.ts, e.i, CASE WHEN e.ts >= f.last + INTERVAL 86400 SECOND THEN e.ts ELSE f.last END, e.ts >= f.last + INTERVAL 86400 SECOND FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
  SELECT key, event_id FROM f WHERE ok""")  # fmt: skip
def m1(spark, sf):
    return J.suppress_fresh_batch(submissions(spark, sf), 86400).select("key", "event_id")


_EVENTS = "CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' WHEN 5 THEN 'retry' ELSE 'cancelled' END"


def job_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id AS job_id", "event_id", "cast(ts AS timestamp) AS ts", f"{_EVENTS} AS event")


@query("m2_job_states", f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, {_EVENTS} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f AS (SELECT job_id, i, CASE WHEN event = 'queued' THEN 'queued' END AS state, 0 AS attempts FROM e WHERE i = 1 UNION ALL
    SELECT job_id, i, s, a + CASE WHEN s = 'running' AND coalesce(o, '') <> 'running' THEN 1 ELSE 0 END FROM (SELECT e.job_id, e.i, f.state AS o, f.attempts AS a, CASE WHEN event = 'queued' AND state IS NULL THEN 'queued' WHEN event = 'running' AND state = 'queued' THEN 'running'
      WHEN event IN ('succeeded', 'failed') AND state = 'running' THEN event WHEN event = 'retry' AND state IN ('running', 'failed') THEN 'queued' WHEN event = 'cancelled' AND state = 'queued' THEN 'cancelled' ELSE state END AS s FROM f JOIN e ON e.job_id = f.job_id AND e.i = f.i + 1))
  SELECT job_id, arg_max(state, i) AS state, max(attempts) AS attempts FROM f GROUP BY job_id HAVING arg_max(state, i) IS NOT NULL""")  # fmt: skip
def m2(spark, sf):
    return J.job_states_batch(job_events(spark, sf))


@query("m3_overdue_jobs", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'running' AND queued_at < (SELECT max(ts) FROM events) - INTERVAL 600 SECOND")
def m3(spark, sf):
    j = jobs(spark, sf).withColumnRenamed("queued_at", "started_at")
    last = j.agg(F.max("started_at").alias("now"))
    return J.overdue_jobs(j.crossJoin(F.broadcast(last)), F.col("now"), 150).select("job_id")


@query("m4_latest_pointer", f"WITH {CAPTURES} SELECT domain, arg_max(capture_id, (captured_at, capture_id)) AS capture_id FROM captures GROUP BY domain")
def m4(spark, sf):
    return J.latest_pointer(capture_metadata(spark, sf), "domain").select("domain", "capture_id")


@query("m5_status_windows", f"WITH {JOBS} SELECT date_trunc('hour', queued_at) AS start, status, count(*) AS n FROM jobs GROUP BY ALL")
def m5(spark, sf):
    return J.status_windows(jobs(spark, sf), "queued_at", "status").select("start", "status", "n")


@query("m5_sliding_windows", f"WITH {JOBS} SELECT date_trunc('hour', queued_at) - to_hours(h) AS start, status, count(*) AS n FROM jobs, (SELECT unnest([0, 1]) AS h) GROUP BY ALL")
def m5_sliding(spark, sf):
    return J.status_windows(jobs(spark, sf), "queued_at", "status", "2 hours", "1 hour").select("start", "status", "n")
