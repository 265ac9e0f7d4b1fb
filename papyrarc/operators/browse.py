"""Browsing a collection: filters, joins, counts, windows and pages of results."""

from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrarc.functions.content import contains_text
from papyrarc.operators.scan import running

SUCCEEDED = "succeeded"


def filter_captures(
    captures: DataFrame, *, status: str | None = None, mode: str | None = None, domain: str | None = None, title: str | None = None, url: str | None = None,
    date_from: date | datetime | str | None = None, date_to: date | str | None = None, tag: str | None = None, tags: DataFrame | None = None, matches: DataFrame | None = None,
) -> DataFrame:
    """All filters that are given, together.

    Status is `succeeded` if none is given, and `all` keeps every status. date_to includes its whole day. `tags` (capture_id,
    tag) and `matches` (capture_id, of a full-text search) are semi-joined, so that rows aren't multiplied.
    """
    if status != "all":
        captures = captures.where(F.col("status") == (status or SUCCEEDED))
    for name, value in (("mode", mode), ("domain", domain)):
        if value is not None:
            captures = captures.where(F.col(name) == value)
    if title is not None:
        captures = captures.where(contains_text("title", title))
    if url is not None:
        final = "final_url" if "final_url" in captures.columns else "source_url"
        captures = captures.where(contains_text("source_url", url) | contains_text(final, url))
    if date_from is not None:
        captures = captures.where(F.col("captured_at") >= F.lit(str(date_from)).cast("timestamp_ntz"))
    if date_to is not None:
        captures = captures.where(F.col("captured_at") < F.lit(str(date_to)).cast("timestamp_ntz") + F.expr("interval 1 day"))
    if tag is not None and tags is not None:
        captures = captures.join(tags.where(F.col("tag") == tag).select("capture_id"), "capture_id", "left_semi")
    if matches is not None:
        captures = captures.join(matches.select("capture_id"), "capture_id", "left_semi")
    return captures



def sort_keys(order: str) -> list[Column]:
    """Sort keys with ties settled by id: `newest`, `oldest`, or `relevance` (a column bm25, lower is better)."""
    newest = [F.desc("captured_at"), F.desc("capture_id")]
    return {"newest": newest, "oldest": [F.asc("captured_at"), F.asc("capture_id")], "relevance": [F.asc("bm25"), *newest]}[order]


def result_page(captures: DataFrame, order: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of results: a limit of 1 to 200, and an offset past the end moved to the last page.

    Adds total, page_offset, previous_offset and next_offset. Rows are counted by the day of their capture first (by hundredths
    of their score for `relevance`), so that only the days that the page lies in are sorted, however far it is.
    """
    limit = min(200, max(1, limit))
    keys = sort_keys(order)
    coarse = F.floor(F.col("bm25") * 100) if order == "relevance" else F.to_date("captured_at")
    counts = captures.groupBy(coarse.alias("of")).agg(F.count("*").alias("n")).orderBy(F.desc("of") if order == "newest" else F.asc("of")).collect()  # a row for each day
    total = sum(r.n for r in counts)
    offset = max(0, min(offset, (max(0, total - 1) // limit) * limit))
    before, skipped, chosen = 0, 0, []
    for r in counts:
        if before + r.n > offset and before < offset + limit:
            chosen.append(r.of)
        elif before + r.n <= offset:
            skipped += r.n
        before += r.n
    inside = coarse.isin([c for c in chosen if c is not None])
    rows = captures.where((F.coalesce(inside, F.lit(False)) | coarse.isNull()) if None in chosen else inside)
    page = rows.orderBy(*keys).offset(offset - skipped).limit(limit)
    n = lambda v: F.lit(v).cast("long")
    return page.withColumns({"total": n(total), "page_offset": n(offset), "previous_offset": n(offset - limit if offset >= limit else None), "next_offset": n(offset + limit if offset + limit < total else None)})


def with_pdf_facts(captures: DataFrame, links: DataFrame, blobs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Captures with their PDF's hash, size and extraction status, where they have one."""
    out = captures.join(links.select("capture_id", "sha256"), "capture_id", "left")
    out = out.join(blobs.select("sha256", F.col("byte_size").alias("pdf_size")), "sha256", "left")
    return out.join(extractions.select("capture_id", F.col("status").alias("pdf_extraction")), "capture_id", "left").withColumnRenamed("sha256", "pdf_sha256")


def available_formats(status: Column, body_format: Column, pdf_sha256: Column, pdf_extraction: Column) -> Column:
    """Formats that a capture can be served in. Fixed values."""
    ok = status == SUCCEEDED
    body, pdf = ok & body_format.isNotNull(), ok & pdf_sha256.isNotNull()
    texted = pdf & pdf_extraction.isin("succeeded", "image_only")
    names = [F.when(body & (body_format == "mhtml"), "mhtml"), *(F.when(body, f) for f in ("html", "article-html", "markdown", "markdown-zip", "epub", "pdf")), F.when(pdf, "source-pdf"), F.when(texted, "source-pdf-text")]
    return F.filter(F.array(*names), lambda f: f.isNotNull())


def blob_totals(blobs: DataFrame, by: str, hash_col: str, size_col: str) -> DataFrame:
    """(by, blobs, bytes, files): distinct contents, and bytes and number of all files."""
    return blobs.groupBy(by).agg(F.count_distinct(hash_col).alias("blobs"), F.coalesce(F.sum(size_col), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files"))


def latest_captures(captures: DataFrame, key: str = "normalised") -> DataFrame:
    """(key, capture_id, captured_at) of each URL's newest succeeded capture, ties to the larger id."""
    best = captures.where(F.col("status") == SUCCEEDED).groupBy(key).agg(F.max(F.struct("captured_at", "capture_id")).alias("b"))
    return best.select(key, "b.capture_id", "b.captured_at")


def fresh_captures(requests: DataFrame, captures: DataFrame, seconds: int, now: Column, key: str = "normalised") -> DataFrame:
    """Requests whose URL has a succeeded capture of the last `seconds`; none for 0 or less."""
    if seconds <= 0:
        return requests.join(latest_captures(captures, key), key).limit(0)
    return requests.join(latest_captures(captures, key), key).where(F.col("captured_at") >= now - F.make_dt_interval(secs=F.lit(seconds)))


def status_counts(rows: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """One row: total, and how many rows have each status."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in states))


def tag_counts(tags: DataFrame, limit: int | None = None) -> DataFrame:
    """(tag, n), most used first, then by name in any case."""
    out = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.collate("tag", "UTF8_LCASE"), "tag")
    return out.limit(limit) if limit else out


def trimmed_durations(captures: DataFrame, column: str = "duration_ms", share: float = 0.95, bins: int = 1024) -> DataFrame:
    """(average, p95) over the shortest max(1, floor(share * n)) durations of succeeded captures; 0 without any.

    A row's place is found without sorting: durations are counted in `bins` equal steps, and the step that holds
    the last one wanted is divided again until it holds one value. Each round is one grouped sum of at most `bins` rows.
    """
    rows = captures.where((F.col("status") == SUCCEEDED) & F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    left = kept = max(1, int(math.floor(n * share))) if n else 0
    total, last = 0, low
    while left:
        if low == high:
            total, last, left = total + left * low, low, 0
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / bins)))
        found = rows.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        for r in found:
            if r.n > left:
                low, high = r.low, r.high
                break
            total, last, left = total + r.total, r.high, left - r.n
            if not left:
                break
    kind = captures.schema[column].dataType.simpleString()
    return captures.sparkSession.range(1).select(F.lit(float(total) / kept if kept else 0.0).alias("average"), F.lit(last if kept else 0).cast(kind).alias("p95"))


def capture_history(captures: DataFrame, key: str = "normalised", hash_col: str = "content_hash") -> DataFrame:
    """Each succeeded capture's version of its URL, seconds since the one before, and whether its content changed. A URL of any number of captures is spread over all tasks."""
    rows = captures.where(F.col("status") == SUCCEEDED).select("capture_id", key, "captured_at", F.col(hash_col).alias("hash"))
    found = running(rows, [key], ["captured_at", "capture_id"], number="version", before={"at_before": "captured_at", "hash_before": "hash"})
    return found.select("capture_id", key, "version", F.timestamp_diff("SECOND", F.col("at_before"), F.col("captured_at")).alias("gap_seconds"), (F.col("hash_before") != F.col("hash")).alias("changed"))


def replacements(captures: DataFrame, deleted: DataFrame, key: str = "normalised") -> DataFrame:
    """The newest succeeded capture that is left for each URL with a deleted one: (key, capture_id or null)."""
    touched = captures.join(deleted.select("capture_id"), "capture_id", "left_semi").select(key).distinct()
    left = captures.join(deleted.select("capture_id"), "capture_id", "left_anti")
    return touched.join(latest_captures(left, key), key, "left").select(key, "capture_id", "captured_at")


def first_usable(candidates: DataFrame, owner: str, priority: str, usable: str, name: str) -> DataFrame:
    """The first usable candidate of each owner, null if none is, and the names of those that were passed over before it."""
    w = Window.partitionBy(owner).orderBy(priority)
    ranked = candidates.withColumn("at", F.row_number().over(w)).withColumn("best", F.min(F.when(F.col(usable), F.struct(priority, name))).over(Window.partitionBy(owner)))
    rejected = F.array_sort(F.collect_list(F.when(F.col("best").isNull() | (F.col(priority) < F.col(f"best.{priority}")), F.struct(priority, name))))
    return ranked.groupBy(owner).agg(F.first(f"best.{name}").alias("chosen"), F.transform(rejected, lambda r: r[name]).alias("rejected"))


def text_budget(pages: DataFrame, document: str, page: str, text: str, budget: int) -> DataFrame:
    """Pages of a document within a running budget of bytes: (document, page, bytes_kept, truncated). Texts stay where they are read; a document of any number of pages is spread over all tasks."""
    sized = pages.select(document, page, F.octet_length(text).cast("long").alias("size"))
    found = running(sized, [document], [page], sums={"before": "size"})
    return found.select(document, page, F.greatest(F.lit(0), F.least("size", F.lit(budget) - F.col("before"))).cast("long").alias("bytes_kept"), (F.col("before") + F.col("size") > budget).alias("truncated"))


def latest_attempts(attempts: DataFrame, job: str, number: str, *columns: str) -> DataFrame:
    """Each job's last attempt and number of attempts."""
    return attempts.groupBy(job).agg(F.max_by(F.struct(*columns), number).alias("a"), F.max(number).alias("last_attempt"), F.count("*").alias("attempts")).select(job, "last_attempt", "attempts", "a.*")


def backlog(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Jobs as a status page lists them: running, then queued (oldest first), then finished ones (newest first)."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    live = F.col("status").isin("running", "queued")
    return jobs.withColumn("rank", rank).orderBy("rank", F.when(live, F.col("job_id")).asc(), F.when(~live, F.col("job_id")).desc()).limit(limit)


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest queued jobs that have attempts left."""
    return jobs.where((F.col("status") == "queued") & (F.col("attempt_count") < F.col("max_attempts"))).orderBy("queued_at", "job_id").limit(n)


def deletion_impact(captures: DataFrame, **dependents: DataFrame) -> DataFrame:
    """How many rows of each dependent table (with a column capture_id) go with each capture."""
    out = captures.select("capture_id")
    for name, rows in dependents.items():
        out = out.join(rows.groupBy("capture_id").agg(F.count("*").alias(name)), "capture_id", "left")
    return out.fillna(0, list(dependents))
