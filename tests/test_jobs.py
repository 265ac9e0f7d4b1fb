"""Ledgered jobs, paging and streams: idempotence, sums, and batch equal to stream."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from papyrarc.operators import browse as B
from papyrarc.operators import ledger as L
from papyrarc.plans import ledger_queries as Q
from papyrarc.plans.base import capture_metadata
from papyrarc.sources import archive as A
from papyrarc.streaming import jobs as J


def test_import_runs_once(spark, sf_dir):
    source, stored = Q.source(spark, sf_dir), Q.stored(spark, sf_dir)
    empty = Q.ledger(spark, sf_dir).limit(0)
    first = L.plan_import(source, empty, stored).cache()
    assert first.count() == source.count()
    assert first.where("outcome in ('imported', 'duplicate') and capture_id is null").count() == 0
    assert first.where("outcome = 'imported'").select("capture_id").distinct().count() == first.where("outcome = 'imported'").count()
    assert L.plan_import(source, first.select("source_id", "outcome", "capture_id", "content_hash"), stored).count() == 0
    failed = first.where("outcome = 'failed'").count()
    assert L.plan_import(source, first.select("source_id", "outcome", "capture_id", "content_hash"), stored, retry_failed=True).count() == failed > 0


def test_import_limit_advances(spark, sf_dir):
    source, stored = Q.source(spark, sf_dir).limit(40).cache(), Q.stored(spark, sf_dir).limit(0)
    ledger = Q.ledger(spark, sf_dir).limit(0)
    seen = 0
    for _ in range(4):
        step = L.plan_import(source, ledger, stored, limit=10).select("source_id", "outcome", "capture_id", "content_hash").cache()
        assert step.count() == 10
        ledger = ledger.union(step)
        seen += 10
    assert ledger.select("source_id").distinct().count() == seen


def test_pages_neither_repeat_nor_omit(spark, sf_dir):
    captures = B.filter_captures(capture_metadata(spark, sf_dir), status="all").cache()
    n, seen = captures.count(), []
    for offset in range(0, n, 20):
        seen += [r.capture_id for r in B.result_page(captures, limit=20, offset=offset).collect()]
    assert len(seen) == len(set(seen)) == n
    assert B.result_page(captures, limit=1000).count() == min(200, n)


def test_contract_is_checked_first(spark):
    df = spark.createDataFrame([("x",)], "status string")
    with pytest.raises(A.SourceContractError, match="lacks id"):
        A.require_source({"t": df}, {"t": ["id"]})
    with pytest.raises(A.SourceContractError):
        A.require_source({"t": df}, {"t": ["status"]}, {"t": {"status": ["ok"]}})
    with pytest.raises(ValueError):
        L.require_no_conflicts(df)


def test_files_of_a_legacy_archive(spark, tmp_path):
    for name, text in {"1700000000.1/singlefile.html": "<html>a</html>", "1700000001.1/output.html": "b", "1700000001.1/other.txt": "c"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    files = A.candidate_files(spark, str(tmp_path), ["singlefile.html", "output.html"])
    assert {(r.snapshot, r.name, r.length) for r in files.collect()} == {("1700000000.1", "singlefile.html", 14), ("1700000001.1", "output.html", 1)}
    assert A.snapshot_listing(files).count() == 2


def test_original_pdf_cases(spark):
    snapshots = spark.createDataFrame([("original",), ("generated",), ("ambiguous",), ("escape",)], "snapshot_id string")
    results = spark.createDataFrame([("original", "wget", "succeeded", "a.pdf"), ("original", "headers", "succeeded", "h.json"), ("generated", "pdf", "succeeded", "o.pdf"), ("ambiguous", "wget", "succeeded", "a.pdf"), ("ambiguous", "headers", "succeeded", "h.json"), ("escape", "wget", "succeeded", "../a.pdf"), ("escape", "headers", "succeeded", "h.json")], "snapshot_id string, extractor string, status string, output string")
    pdf = bytearray(b"%PDF-1.7\nbytes")
    head = lambda kind: bytearray(f'{{"Content-Type": "{kind}", "Content-Length": "{len(pdf)}"}}'.encode())
    files = spark.createDataFrame([("original", "a.pdf", pdf), ("original", "h.json", head("application/pdf")), ("ambiguous", "a.pdf", pdf), ("ambiguous", "h.json", head("text/html"))], "snapshot_id string, path string, content binary")
    got = {r.snapshot_id: r for r in L.classify_original_pdfs(snapshots, results, files, 1000).collect()}
    assert [got[s].accepted for s in ("original", "generated", "ambiguous", "escape")] == [True, False, False, False]


def _stream(spark, df, tmp_path, build, mode, parts=3, order="ts"):
    """Feed a table in time order, a file for each batch, and return what the query gave."""
    rows = df.orderBy(order).collect()
    folder = tmp_path / "in"
    for i in range(parts):
        part = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out{abs(hash(str(tmp_path)))}"
    run = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    return spark.table(name)


def test_suppression_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = Q.submissions(spark, sf_dir).where("key % 4 = 0")
    batch = {(r.key, r.event_id) for r in J.suppress_fresh_batch(rows, 86400).collect()}
    single = {(r.key, r.event_id) for r in _stream(spark, rows, tmp_path, lambda s: J.suppress_fresh(s, 86400), "append", parts=1).collect()}
    assert single == batch


def test_job_states_stream_ends_as_batch(spark, sf_dir, tmp_path):
    rows = Q.job_events(spark, sf_dir).where("job_id % 5 = 0")
    out = _stream(spark, rows, tmp_path, lambda s: J.job_states(s.withWatermark("ts", "1 hour")), "update", parts=1)
    last = {r.job_id: (r.state, r.attempts) for r in out.where("not overdue").collect()}
    assert last == {r.job_id: (r.state, r.attempts) for r in J.job_states_batch(rows).collect()}


def test_windows_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = Q.job_events(spark, sf_dir)
    out = _stream(spark, rows, tmp_path, lambda s: J.status_windows(s, "ts", "event"), "complete")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in J.status_windows(rows, "ts", "event").collect()}


def test_latest_pointer_takes_late_arrivals_only_if_not_older(spark):
    df = spark.createDataFrame([("u", 1, 10), ("u", 2, 5), ("u", 3, 10)], "k string, capture_id long, captured_at long")
    assert J.latest_pointer(df, "k").collect()[0].capture_id == 3


def test_state_machine():
    assert J.next_state("running", "cancelled") == "running"
    assert J.next_state("queued", "cancelled") == "cancelled"


def test_suppression_keeps_its_state_from_batch_to_batch(spark, sf_dir, tmp_path):
    rows = Q.submissions(spark, sf_dir).where("key % 4 = 1")
    batch = {(r.key, r.event_id) for r in J.suppress_fresh_batch(rows, 86400).collect()}
    several = [(r.key, r.event_id) for r in _stream(spark, rows, tmp_path, lambda s: J.suppress_fresh(s, 86400), "append", parts=3).collect()]
    assert len(several) == len(batch) and set(several) == batch


def test_late_submissions_are_suppressed(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    rows = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(100)), (1, 3, at(50)), (1, 4, at(199)), (1, 5, at(200))], "key long, event_id long, ts timestamp")
    out = _stream(spark, rows, tmp_path, lambda s: J.suppress_fresh(s, 100), "append", parts=5, order="event_id")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 5]


def test_suppression_forgets_keys_and_restarts(spark, tmp_path):
    """Many keys that are met once: state is given up behind the watermark, a restart goes on from the checkpoint, and accepted rows are those of the batch twin."""
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    rows = [(1000 + i, 10 * i, at(60 * i)) for i in range(200)] + [(7, 10 * i + 1, at(60 * i + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp")
    ordered = sorted(rows, key=lambda r: r[2])
    out, kept = tmp_path / "out", []
    for i in range(4):
        spark.createDataFrame(ordered[100 * i : 100 * i + 100], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        run = J.suppress_fresh(stream, 150, "1 minute").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out))
        assert run.awaitTermination(120)
        kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.key, r.event_id) for r in spark.read.parquet(str(out)).collect())
    assert got == sorted((r.key, r.event_id) for r in J.suppress_fresh_batch(df, 150).collect())
    assert max(kept) < 40  # of 201 keys


def test_job_states_over_several_batches(spark, sf_dir, tmp_path):
    rows = Q.job_events(spark, sf_dir).where("job_id % 5 = 1")
    out = _stream(spark, rows, tmp_path, lambda s: J.job_states(s.withWatermark("ts", "1000 days")), "update", parts=3)
    most = {}
    for r in out.where("not overdue").collect():
        most[r.job_id] = max(most.get(r.job_id, 0), r.attempts)
    assert most == {r.job_id: r.attempts for r in J.job_states_batch(rows).collect()}


def test_watchdog_tells_overdue_jobs(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    events = [(1, 1, at(0), "queued"), (1, 2, at(10), "running"), (2, 3, at(20), "queued"), (2, 4, at(30), "running"), (2, 5, at(40), "succeeded"), (3, 6, at(36_000), "queued"), (4, 7, at(72_000), "queued"), (5, 8, at(90_000), "queued")]
    df = spark.createDataFrame(events, "job_id long, event_id long, ts timestamp, event string")
    out = _stream(spark, df, tmp_path, lambda s: J.job_states(s.withWatermark("ts", "1 minute")), "update", parts=8)
    assert {(r.job_id, r.state, r.attempts) for r in out.where("overdue").collect()} == {(1, "running", 1)}


@pytest.mark.parametrize("seconds", [0, 1, 7, 60])
def test_suppression_batch_by_brute_force(spark, seconds):
    """Many events of one key in short order, ties, pauses, and a null key."""
    rng = random.Random(seconds)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, datetime.fromtimestamp(1_700_000_000 + rng.choice([0, 500, 90_000]) + rng.randint(0, 200) / 2, timezone.utc)) for i in range(900)]
    want, last = set(), {}
    for key, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or (ts - last[key]).total_seconds() >= seconds:
            last[key] = ts
            want.add((key, i))
    got = J.suppress_fresh_batch(spark.createDataFrame(rows, "key long, event_id long, ts timestamp").repartition(3), seconds).collect()
    assert len(got) == len(want) and {(r.key, r.event_id) for r in got} == want


@pytest.mark.parametrize("kind", ["regular", "random", "pauses", "dense"])
@pytest.mark.parametrize("stretch", [1, 5, 64])
def test_suppression_batch_of_long_keys(spark, kind, stretch):
    """A key that lies in all tasks, cut into many short stretches that are put together three at a time, among many short ones."""
    rng = random.Random(stretch)
    steps = {"regular": lambda: 1, "random": lambda: rng.choice([1, 2, 7]), "pauses": lambda: rng.choice([1, 1, 1, 1, 300]), "dense": lambda: rng.choice([0, 0, 0, 1])}[kind]
    rows, at = [], 1_700_000_000
    for i in range(700):
        at += steps()
        rows.append((7, i, datetime.fromtimestamp(at, timezone.utc)))
    rows += [(k, 1000 + 3 * k + i, datetime.fromtimestamp(1_700_000_000 + 6 * i, timezone.utc)) for k in range(40) if k != 7 for i in range(3)] + [(7, 5000, None)]
    want, last = set(), {}
    for key, i, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1])):
        if key not in last or (ts - last[key]).total_seconds() >= 10:
            last[key] = ts
            want.add((key, i))
    got = J.suppress_fresh_batch(spark.createDataFrame(rows, "key long, event_id long, ts timestamp").repartition(3), 10, stretch, 3).collect()
    assert len(got) == len(want) and {(r.key, r.event_id) for r in got} == want


def test_no_task_reads_a_whole_key(spark):
    """A quarter of a million events of one key: the accepted ones, and no stretch or table of one above its bound."""
    rows = spark.range(250_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    got = J.suppress_fresh_batch(rows, 100, 5000)
    assert [r.event_id for r in got.orderBy("event_id").collect()] == list(range(0, 250_000, 34))
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 0.7 * sum(sizes)


def test_job_states_batch_by_brute_force(spark):
    """One job with most events, so that its stretches lie in several tasks."""
    rng = random.Random(3)
    kinds = ["queued", "running", "succeeded", "failed", "retry", "cancelled", "unknown"]
    rows = [(rng.choice([7] * 9 + [8, 9]), i, datetime.fromtimestamp(1_700_000_000 + rng.randint(0, 400), timezone.utc), rng.choice(kinds)) for i in range(3000)] + [(11, 9000, datetime.fromtimestamp(1_700_000_000, timezone.utc), "running")]
    states, attempts = {}, {}
    for job, _, _, event in sorted(rows, key=lambda r: (r[2], r[1])):
        before = states.get(job)
        states[job] = J.next_state(before, event)
        attempts[job] = attempts.get(job, 0) + (states[job] == "running" and before != "running")
    got = J.job_states_batch(spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, event string").repartition(3)).collect()
    assert {r.job_id: (r.state, r.attempts) for r in got} == {j: (s, attempts[j]) for j, s in states.items() if s}


@pytest.mark.parametrize("order", ["newest", "oldest", "relevance"])
def test_pages_of_every_order(spark, order):
    """Days without and with many captures, ties, and captures without a time."""
    rng = random.Random(1)
    rows = [(i, None if i % 17 == 0 else datetime(2024, 1, rng.choice([1, 1, 1, 2, 9]), rng.randint(0, 3)), rng.randint(0, 9) / 3) for i in range(230)]
    df = spark.createDataFrame(rows, "capture_id long, captured_at timestamp_ntz, bm25 double").cache()
    whole = [r.capture_id for r in df.orderBy(*B.sort_keys(order)).collect()]
    for offset in (0, 40, 120, 200, 229, 10**9):
        page = B.result_page(df, order, 40, offset).collect()
        at = min(offset, 200)
        assert [r.capture_id for r in page] == whole[at : at + 40] and {(r.total, r.page_offset) for r in page} == {(230, at)}
    assert B.result_page(df.limit(0), order).count() == 0


@pytest.mark.parametrize("kind", ["long", "double"])
def test_trimmed_durations_by_brute_force(spark, kind):
    rng = random.Random(2)
    for n in (0, 1, 2, 19, 400):
        values = [rng.choice([5, 5, 5, rng.randint(0, 10**9), rng.randint(0, 100)]) for _ in range(n)]
        values = [v + rng.random() for v in values] if kind == "double" else values
        other = 1.0 if kind == "double" else 1
        df = spark.createDataFrame([("succeeded", v) for v in values] + [("failed", other), ("succeeded", None)], f"status string, duration_ms {kind}")
        (got,) = B.trimmed_durations(df, bins=16).collect()
        kept = sorted(values)[: max(1, int(n * 0.95))]
        assert got.p95 == (kept[-1] if kept else 0) and got.average == pytest.approx(sum(kept) / len(kept) if kept else 0.0)


def test_ids_need_a_unique_order(spark):
    source = spark.createDataFrame([("a", "http://e.com/1", "x", 7), ("b", "http://e.com/2", "y", 7)], "source_id string, url string, body string, `order` long")
    ledger = spark.createDataFrame([], "source_id string, outcome string, capture_id long, content_hash string")
    stored = spark.createDataFrame([], "capture_id long, content_hash string, status string")
    with pytest.raises(ValueError, match="different numbers"):
        L.plan_import(source, ledger, stored)


def test_a_broken_table_is_found(spark, sf_dir, tmp_path):
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "pages")}
    A.write_snapshot(tables, str(tmp_path / "s"))
    assert {(r.name, r.ok) for r in A.verify_snapshot(spark, str(tmp_path / "s"), ["labels", "pages"]).collect()} == {("labels", True), ("pages", True)}
    # one changed value, and as many rows
    labels = tables["labels"]
    first = labels.agg({"doc_id": "min"}).first()[0]
    labels.withColumn("toxic", F.when(F.col("doc_id") == first, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")).write.mode("overwrite").parquet(str(tmp_path / "s" / "labels"))
    assert {(r.name, r.ok) for r in A.verify_snapshot(spark, str(tmp_path / "s"), ["labels", "pages"]).collect()} == {("labels", False), ("pages", True)}


def test_fingerprint_tells_types(spark):
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(1, "x")], "a long, b string")
    of = lambda df: A.schema_fingerprint({"t": df}).first()[0]
    assert of(one) != of(two) and of(one) == of(one.select("b", "a")) == of(one.limit(0))
