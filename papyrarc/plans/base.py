"""The collection's tables as the queries see them, derived from the given tables, and the same in DuckDB SQL.

Pages are captures (every tenth failed), documents are searchable bodies, labels are tags, events are jobs, and
conversation turns are attempts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrarc.functions import content, urls

MODES = ("article", "full_page", "imported_singlefile")
JOB_STATES = ("queued", "running", "succeeded", "failed", "cancelled")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or the warehouse where it is not set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures without bodies or hashes of them, so that the scan reads no html."""
    at = F.col("page_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        at.alias("capture_id"), F.col("url").alias("source_url"), urls.normalise_url("url").alias("normalised"), urls.url_domain("url").alias("domain"),
        F.when(at % 10 == 9, "failed").otherwise("succeeded").alias("status"), pick(MODES, at % 3).alias("mode"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(page_id as int), 0)").alias("captured_at"),
        (at * 37 % 5000).alias("duration_ms"),
    )


def capture_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), F.col("html").alias("body"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("job_id"), F.when(e % 4 == 3, "import").otherwise("capture").alias("kind"), F.element_at(F.array(*map(F.lit, JOB_STATES)), (e % 5 + 1).cast("int")).alias("status"),
        F.col("user_id").alias("capture_id"), F.col("ts").alias("queued_at"), (e % 4).alias("attempt_count"), F.lit(3).cast("long").alias("max_attempts"),
        F.concat(F.lit('{"url": "https://site'), F.col("user_id").cast("string"), F.lit('.example.com/?id='), (e % 3).cast("string"), F.lit('"}')).alias("payload"),
        F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("idempotency_key"), F.col("value").alias("duration"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, tag)"""
    named = F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "Toxic"), F.concat(F.lit("group "), (F.col("doc_id") % 7).cast("string")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("capture_id"), F.explode(F.filter(named, lambda t: t.isNotNull())).alias("tag")).distinct()


_TRACKING = "[" + ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS) + "]"


def sql_domain(url: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\.', '')"


def sql_normalise(url: str) -> str:
    path = f"regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    params = rf"list_sort(list_filter(string_split(regexp_extract({url}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({_TRACKING}, lower(split_part(p, '=', 1)))))"
    return rf"(lower(regexp_extract({url}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({url}, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#]*)', 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({params}) = 0 THEN '' ELSE '?' || array_to_string({params}, '&') END)"


CAPTURES = f"""captures AS (SELECT page_id AS capture_id, url AS source_url, {sql_normalise('url')} AS normalised, {sql_domain('url')} AS domain,
  CASE WHEN page_id % 10 = 9 THEN 'failed' ELSE 'succeeded' END AS status, ['article', 'full_page', 'imported_singlefile'][page_id % 3 + 1] AS mode,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS captured_at, page_id * 37 % 5000 AS duration_ms, html AS body FROM pages)"""
JOBS = """jobs AS (SELECT event_id AS job_id, CASE WHEN event_id % 4 = 3 THEN 'import' ELSE 'capture' END AS kind,
  ['queued', 'running', 'succeeded', 'failed', 'cancelled'][event_id % 5 + 1] AS status, user_id AS capture_id, ts AS queued_at, event_id % 4 AS attempt_count, 3 AS max_attempts,
  '{"url": "https://site' || user_id || '.example.com/?id=' || (event_id % 3) || '"}' AS payload, 'key' || user_id AS idempotency_key, value AS duration FROM events)"""
TAGS = """tags AS (SELECT DISTINCT doc_id AS capture_id, unnest(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'Toxic' END, 'group ' || (doc_id % 7)], lambda t: t IS NOT NULL)) AS tag FROM labels)"""


def sql_text(html: str) -> str:
    """`functions.content.visible_text` in DuckDB."""
    hidden = content.HIDDEN.replace("'", "''")
    raw = f"regexp_replace({html}, '{hidden}', ' ', 'g')"
    body = f"coalesce(nullif(regexp_extract({raw}, '(?is)<body\\b[^>]*>(.*)$', 1), ''), {raw})"
    return sql_plain(body)


def sql_text_of(html: str) -> str:
    """`functions.content.text_of` in DuckDB."""
    hidden = content.HIDDEN.replace("'", "''")
    return sql_plain(f"regexp_replace({html}, '{hidden}', ' ', 'g')")


def sql_plain(body: str) -> str:
    text = f"regexp_replace(regexp_replace({body}, '{content.BREAKING}', ' ', 'g'), '(?s)<[^>]*>', '', 'g')"
    for name, value in content.ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, name, value.replace("'", "''"))
    text = f"replace({text}, '&amp;', '&')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
