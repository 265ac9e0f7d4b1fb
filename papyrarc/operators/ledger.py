"""Ledgered batch jobs: idempotent and resumable, each takes and returns tables. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrarc.functions.content import content_hash, detect_body_format, normalise_tag
from papyrarc.functions.urls import normalise_url, url_reject_reason

from .browse import SUCCEEDED, latest_captures


def unprocessed(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a ledger entry for the same keys, as (capture_id, content_hash): a changed body is due again."""
    return rows.join(ledger.select(*keys).distinct(), keys, "left_anti")


def current_entries(ledger: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last entry for each key of an append-only ledger."""
    others = [c for c in ledger.columns if c not in keys]
    return ledger.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("e")).select(*keys, "e.*")


def orphan_tags(tags: DataFrame, uses: DataFrame) -> DataFrame:
    """Tags that no capture uses."""
    return tags.join(uses.select("tag").distinct(), "tag", "left_anti")


def orphan_blobs(blobs: DataFrame, links: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Blobs that neither a capture nor an enrichment refers to."""
    used = links.select("sha256").union(enrichments.select("sha256")).distinct()  # one blob may have very many captures
    return blobs.join(used, "sha256", "left_anti")


def orphan_urls(urls: DataFrame, captures: DataFrame, jobs: DataFrame) -> DataFrame:
    """URLs without captures whose normalised form is in no job's payload."""
    wanted = jobs.select(normalise_url(F.get_json_object("payload", "$.url")).alias("normalised")).where("normalised is not null").distinct()
    return urls.join(captures.select("normalised").distinct(), "normalised", "left_anti").join(wanted, "normalised", "left_anti")


def set_differences(listed: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(key, state): listed but not indexed is `orphan`, indexed but not listed is `missing`."""
    one, two = listed.select(key).distinct(), indexed.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("state", F.lit("orphan")).union(two.join(one, key, "left_anti").withColumn("state", F.lit("missing")))


def identity_conflicts(ledger: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key is known with other values; a job that finds any must stop before it writes."""
    known = ledger.select(key, *(F.col(c).alias(f"known_{c}") for c in columns))
    differs = ~F.col(columns[0]).eqNullSafe(F.col(f"known_{columns[0]}"))
    for c in columns[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"known_{c}"))
    return source.select(key, *columns).join(known, key).where(differs)


def require_no_conflicts(conflicts: DataFrame) -> None:
    rows = conflicts.take(5)
    if rows:
        raise ValueError(f"source rows don't match the ledger: {rows}")


def verify_imports(ledger: DataFrame, captures: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, problem) for each source or ledger row, null if all is well.

    Every source row needs one ledger row and the other way round, imported and duplicate ones need a succeeded capture, and hashes must agree.
    """
    held = captures.select("capture_id", F.col("content_hash").alias("stored_hash"), F.col("status").alias("stored_status"))
    both = source.select(key, F.lit(True).alias("in_source")).join(ledger.select(key, "outcome", "capture_id", "content_hash", F.lit(True).alias("in_ledger")), key, "full_outer").join(held, "capture_id", "left")
    needs = F.col("outcome").isin("imported", "duplicate")
    problem = (
        F.when(F.col("in_ledger").isNull(), "not in the ledger").when(F.col("in_source").isNull(), "not in the source").when(F.col("outcome").isNull(), "pending")
        .when(needs & F.col("stored_status").isNull(), "capture is missing").when(needs & (F.col("stored_status") != SUCCEEDED), "capture did not succeed")
        .when(needs & ~F.col("stored_hash").eqNullSafe(F.col("content_hash")), "hash differs")
    )
    return both.select(key, problem.alias("problem"))


def reconcile(ledger: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: how many of each outcome, how many are pending and have problems, and whether all is well."""
    counts = ledger.agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("imported", "duplicate", "skipped", "failed")), F.count_if(F.col("outcome").isNull()).alias("pending"))
    return counts.crossJoin(verified.agg(F.count_if(F.col("problem").isNotNull()).alias("problems"))).withColumn("ok", (F.col("problems") == 0) & (F.col("pending") == 0))


def match_stored(rows: DataFrame, captures: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Adds stored_id, the least succeeded capture of the same hash, if any."""
    stored = captures.where((F.col("status") == SUCCEEDED) & F.col("content_hash").isNotNull()).groupBy(F.col("content_hash").alias(hash_col)).agg(F.min("capture_id").alias("stored_id"))
    return rows.join(stored, hash_col, "left")


def upsert_urls(urls: DataFrame, rows: DataFrame, original: str, order: str) -> DataFrame:
    """New rows of the URL table: one for each normalised URL that isn't there, with its first spelling."""
    new = rows.select(normalise_url(original).alias("normalised"), F.col(original).alias("original"), order).where("normalised is not null")
    first = new.groupBy("normalised").agg(F.min_by("original", order).alias("original"))
    return first.join(urls.select("normalised"), "normalised", "left_anti").select(F.xxhash64("normalised").alias("url_id"), "normalised", "original")


def plan_import(source: DataFrame, ledger: DataFrame, captures: DataFrame, *, order: str = "order", limit: int | None = None, retry_failed: bool = False) -> DataFrame:
    """Outcome of each due source row (source_id, url, body, order): imported, duplicate, skipped or failed.

    Rows with a final outcome in the ledger aren't due again, failed ones only with retry_failed. A body that is stored already, or
    that an earlier row of the same run brings, makes its row a duplicate of that capture; a URL that can't be
    stored is skipped; the others are imported. `failed` marks rows whose reading failed (a column error). New captures
    get ids above the stored ones, in source order. Returns source_id, outcome, capture_id, content_hash, detail.
    Raises ValueError if `order` is null, negative or repeated among the source's rows, as ids could then be given twice.
    """
    wrong = source.groupBy(order).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col(order).isNull() | (F.col(order) < 0)).take(1)
    if wrong:
        raise ValueError(f"source rows need different numbers in {order}, not {wrong[0][0]} {wrong[0][1]} times")
    done = ledger.where(F.col("outcome").isNotNull() & ((F.col("outcome") != "failed") | F.lit(not retry_failed)))
    due = source.join(done.select("source_id"), "source_id", "left_anti")
    if limit is not None:
        due = due.orderBy(order).limit(limit)
    error = F.col("error") if "error" in source.columns else F.lit(None).cast("string")
    rows = match_stored(due.select("source_id", "url", order, error.alias("error"), content_hash("body").alias("content_hash"), url_reject_reason("url").alias("reason")), captures)
    good = F.col("error").isNull() & F.col("reason").isNull() & F.col("stored_id").isNull()
    # the first importable row of each body; one row for each hash, so that a common body never meets in one task
    firsts = rows.where(good & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(order).alias("first"))
    rows = rows.join(firsts, "content_hash", "left")
    repeated = F.col("first").isNotNull() & (F.col(order) > F.col("first"))
    outcome = (
        F.when(F.col("error").isNotNull(), "failed").when(F.col("stored_id").isNotNull() | (repeated), "duplicate").when(F.col("reason").isNotNull(), "skipped").otherwise("imported")
    )
    top = captures.agg(F.coalesce(F.max("capture_id"), F.lit(0)).alias("top"))
    planned = rows.crossJoin(F.broadcast(top)).withColumn("outcome", outcome)
    # ids follow source order without a sort of all rows in one task: the order itself is added to the largest stored id
    new_id = lambda at: F.col("top") + 1 + F.col(at)
    capture = F.when(F.col("outcome") == "imported", new_id(order)).when(F.col("outcome") == "duplicate", F.coalesce(F.col("stored_id"), new_id("first")))
    detail = F.when(F.col("outcome") == "failed", F.col("error")).when(F.col("outcome") == "skipped", F.concat(F.lit("unsupported URL: "), F.col("reason"))).when(F.col("outcome") == "duplicate", "same content")
    return planned.select("source_id", "outcome", capture.cast("long").alias("capture_id"), "content_hash", detail.alias("detail"))


def import_tables(source: DataFrame, planned: DataFrame, captures: DataFrame, aliases: DataFrame, tags: DataFrame, modes: Column | None = None) -> dict[str, DataFrame]:
    """The tables after an import that `plan_import` has planned: captures, aliases, tags and ledger.

    An imported row becomes a succeeded capture with its address, hash and mode (`modes`, an expression over the source; without a body
    metadata_only). Imported rows and duplicates add their address as an alias of their capture, and
    their names (a column tags, an array) to its tags; all other rows only reach the ledger.
    """
    rows = planned.select("source_id", "outcome", "capture_id", "content_hash", "detail").join(source.drop("content_hash", "error"), "source_id")
    mode = F.when(F.col("body").isNull(), "metadata_only").otherwise(modes if modes is not None else F.lit("imported_singlefile"))
    new = rows.where("outcome = 'imported'").select("capture_id", F.col("url").alias("source_url"), normalise_url("url").alias("normalised"), "content_hash", F.lit(SUCCEEDED).alias("status"), mode.alias("mode"))
    kept = rows.where("outcome in ('imported', 'duplicate')")
    named = kept.select("capture_id", F.explode("tags").alias("tag")) if "tags" in source.columns else kept.select("capture_id", F.lit(None).cast("string").alias("tag")).limit(0)
    return {
        "captures": captures.unionByName(new, allowMissingColumns=True),
        "aliases": merge_aliases(aliases, kept.select("capture_id", "url", F.lit("original").alias("kind"))),
        "tags": merge_tags(tags, named),
        "ledger": planned,
    }


def merge_aliases(aliases: DataFrame, more: DataFrame) -> DataFrame:
    """Aliases with new (capture_id, url) pairs; those that are there stay as they are."""
    new = more.join(aliases.select("capture_id", "url"), ["capture_id", "url"], "left_anti").dropDuplicates(["capture_id", "url"])
    return aliases.unionByName(new, allowMissingColumns=True)


def upsert_metadata(metadata: DataFrame, more: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Keyed values, the last by `seq` wins."""
    return current_entries(metadata.unionByName(more), keys, seq)


def merge_tags(tags: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(capture_id, tag) after adding normalised names and taking others away; bad names are passed over."""
    clean = added.select("capture_id", normalise_tag("tag").alias("tag")).where("tag is not null")
    out = tags.select("capture_id", "tag").union(clean).distinct()
    return out.join(removed.select("capture_id", "tag"), ["capture_id", "tag"], "left_anti") if removed is not None else out


def submit_jobs(jobs: DataFrame, requests: DataFrame, order: str = "order") -> DataFrame:
    """Each request's job: (request_id, job_key, existing_job). Live jobs of the same kind and key are used again.

    Of several new requests with one key the first makes the job. A request without a key always makes one.
    """
    live = jobs.where(F.col("status").isin("queued", "running", "succeeded") & F.col("idempotency_key").isNotNull()).groupBy("kind", "idempotency_key").agg(F.max("job_id").alias("existing_job"))
    first = requests.where("idempotency_key is not null").groupBy("kind", "idempotency_key").agg(F.min_by("request_id", order).alias("job_key"))
    keyed = requests.join(live, ["kind", "idempotency_key"], "left").join(first, ["kind", "idempotency_key"], "left")
    return keyed.select("request_id", F.when(F.col("existing_job").isNull(), F.coalesce("job_key", "request_id")).alias("job_key"), "existing_job")


def recover_captures(captures: DataFrame) -> DataFrame:
    """Captures with pending ones failed."""
    return captures.withColumn("error", F.when(F.col("status") == "pending", "interrupted")).withColumn("status", F.when(F.col("status") == "pending", "failed").otherwise(F.col("status")))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with running ones queued again, or failed if their attempts are used up."""
    left = F.col("attempt_count") < F.col("max_attempts")
    return jobs.withColumn("status", F.when(F.col("status") == "running", F.when(left, "queued").otherwise("failed")).otherwise(F.col("status")))


def delete_captures(captures: DataFrame, deleted: DataFrame, jobs: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """All tables without a set of captures: captures, latest, jobs (references nulled, marked as deleted) and the dependents."""
    gone = deleted.select("capture_id").distinct()
    left = captures.join(gone, "capture_id", "left_anti")
    marked = jobs.join(gone.withColumn("_gone", F.lit(True)), "capture_id", "left")
    result = F.when(F.col("_gone"), F.to_json(F.struct(F.col("capture_id").alias("captureId"), F.lit(True).alias("deleted"))))
    out = {name: rows.join(gone, "capture_id", "left_anti") for name, rows in dependents.items()}
    return out | {"captures": left, "latest": latest_captures(left), "jobs": marked.withColumn("result", result).withColumn("capture_id", F.when(F.col("_gone").isNull(), F.col("capture_id"))).drop("_gone")}


def backfill_body_format(captures: DataFrame) -> DataFrame:
    """Rows whose body_format is not set and whose body tells it: (capture_id, body_format); the others need no work."""
    due = captures.where(F.col("body_format").isNull() & F.col("body").isNotNull())
    return due.select("capture_id", detect_body_format("body").alias("body_format")).where("body_format is not null")


def classify_original_pdfs(snapshots: DataFrame, results: DataFrame, files: DataFrame, max_bytes: int) -> DataFrame:
    """(snapshot_id, accepted, detail, sha256, byte_size) for each snapshot: is the archived response an original PDF?

    `results` has snapshot_id, extractor, status, output; `files` has snapshot_id, path, content, and headers as JSON text in content. The first rule that
    fails gives the detail.
    """
    one = lambda e: F.collect_set(F.when((F.col("extractor") == e) & (F.col("status") == "succeeded"), F.col("output")))
    outputs = results.groupBy("snapshot_id").agg(one("wget").alias("w"), one("headers").alias("h"))
    rows = snapshots.select("snapshot_id").join(outputs, "snapshot_id", "left")
    rows = rows.withColumn("pair", F.coalesce((F.size("w") == 1) & (F.size("h") == 1), F.lit(False)))
    safe = lambda p: ~p.rlike(r"(^/|(^|/)\.\.(/|$)|^$)")
    rows = rows.withColumn("source", F.when(F.col("pair"), F.try_element_at("w", F.lit(1)))).withColumn("head", F.when(F.col("pair"), F.try_element_at("h", F.lit(1))))
    size = F.octet_length("content").cast("long")
    for side in ("source", "head"):
        extra = [F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 5).alias("first")] if side == "source" else [F.when(size <= 1 << 20, F.decode("content", "UTF-8")).alias("json")]
        part = files.select(F.col("snapshot_id").alias("_s"), F.col("path").alias(f"_{side}"), size.alias(f"{side}_size"), *extra)
        rows = rows.join(part, (F.col("snapshot_id") == F.col("_s")) & (F.col(side) == F.col(f"_{side}")), "left").drop("_s", f"_{side}")
    from papyrarc.functions.content import header_value

    parsed = F.from_json("json", "map<string,string>")
    mime = F.lower(F.trim(F.split_part(header_value("json", "content-type"), F.lit(";"), F.lit(1))))
    length = header_value("json", "content-length")
    detail = (
        F.when(~F.col("pair"), "no single pair of succeeded wget and headers outputs")
        .when(~safe(F.col("source")) | ~safe(F.col("head")), "output path leaves its snapshot")
        .when(F.col("source_size").isNull(), "wget output is missing")
        .when(F.col("head_size").isNull(), "headers output is missing")
        .when(F.col("source_size") < 5, "too small for a PDF")
        .when(F.col("source_size") > max_bytes, "exceeds the size limit")
        .when(F.col("head_size") > 1 << 20, "headers exceed their limit")
        .when(parsed.isNull(), "headers are not valid JSON")
        .when(F.coalesce(mime, F.lit("")) != "application/pdf", "MIME type is not application/pdf")
        .when(length.rlike(r"^\d+$") & (length.try_cast("long") != F.col("source_size")), "Content-Length differs from the file")
        .when(F.hex("first") != "255044462D", "no PDF signature")
    )
    return rows.select("snapshot_id", detail.isNull().alias("accepted"), detail.alias("detail"), F.when(detail.isNull(), F.col("sha256")).alias("sha256"), F.when(detail.isNull(), F.col("source_size")).alias("byte_size"))


def enrich_pdfs(classified: DataFrame, ledger: DataFrame, run: int) -> dict[str, DataFrame]:
    """New blobs (one for each hash) and ledger entries (attempt_count one more) for snapshots that aren't done: `enriched` or `not_original`."""
    done = current_entries(ledger, ["snapshot_id"], "run").where(F.col("outcome").isin("enriched", "not_original"))
    before = current_entries(ledger, ["snapshot_id"], "run").select("snapshot_id", F.col("attempt_count").alias("n"))
    due = classified.join(done.select("snapshot_id"), "snapshot_id", "left_anti").join(before, "snapshot_id", "left")
    entries = due.select("snapshot_id", F.when(F.col("accepted"), "enriched").otherwise("not_original").alias("outcome"), "sha256", "detail", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("attempt_count"), F.lit(run).alias("run"))
    return {"ledger": entries, "blobs": due.where("accepted").groupBy("sha256").agg(F.max("byte_size").alias("byte_size"), F.count("*").alias("uses"))}


def outcome_counts(ledger: DataFrame, column: str = "outcome") -> DataFrame:
    """(outcome, n); no outcome yet counts as pending."""
    return ledger.groupBy(F.coalesce(column, F.lit("pending")).alias("outcome")).agg(F.count("*").alias("n"))
