"""Sources and sinks of an archive: scans, checks of what a source must have, appends, exports and snapshots of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrarc.functions.content import content_hash, detect_body_format, html_size


def candidate_files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(snapshot, name, path, length) of files below a folder of snapshots; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    out = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("snapshot"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "length")
    return out.where(F.col("name").isin(names)) if names else out


def snapshot_listing(files: DataFrame) -> DataFrame:
    """Distinct snapshot folders."""
    return files.select("snapshot").distinct()


def read_table(spark: SparkSession, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """A table of a legacy archive's index, from Parquet, CSV or JSON."""
    return spark.read.format(form).options(**options).load(path)


def read_database_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a legacy archive's index over JDBC, in `parts` ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


class SourceContractError(ValueError):
    """A source that lacks columns or holds values out of their domain."""


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def domain_violations(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(column, value, n) of values that aren't among those allowed; nulls are allowed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(c).isin(allowed).alias("ok")) for c, allowed in domains.items())))
    return df.select(pairs.alias("p")).where("not p.ok").groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def require_source(tables: dict[str, DataFrame], columns: dict[str, list[str]], domains: dict[str, dict[str, list[str]]] | None = None) -> None:
    """Raise before anything is written if a table lacks columns or holds values out of their domain."""
    for name, required in columns.items():
        if name not in tables:
            raise SourceContractError(f"table {name} is missing")
        if lacks := missing_columns(tables[name], required):
            raise SourceContractError(f"table {name} lacks {', '.join(lacks)}")
    for name, allowed in (domains or {}).items():
        if bad := domain_violations(tables[name], allowed).take(5):
            raise SourceContractError(f"table {name} has {bad}")


def schema_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(fingerprint): SHA-256 of all tables' columns and types as their schemas declare them, sorted. No row and no single file is looked at."""
    out = None
    for name, df in sorted(tables.items()):
        columns = sorted(df.columns)
        listed = F.concat_ws(",", *(F.concat(F.lit(f"{c} "), F.typeof(c)) for c in columns))
        empty = ",".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
        row = df.agg(F.coalesce(F.max(listed), F.lit(empty)).alias("text")).select(F.lit(name).alias("name"), "text")
        out = row if out is None else out.unionByName(row)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: F.concat(x["name"], F.lit("("), x["text"], F.lit(")")))
    return out.agg(F.sha2(F.array_join(texts, "\n"), 256).alias("fingerprint"))


#: What columns of captures may hold, if anything. Fixed values.
CAPTURE_DOMAINS = {
    "status": ["pending", "succeeded", "failed", "cancelled"], "mode": ["article", "full_page", "imported_singlefile", "metadata_only", "pdf"],
    "compression": ["none", "gzip", "zstd"], "body_format": ["html", "mhtml"],
}


def append_captures(captures: DataFrame, path: str) -> None:
    """Append captures with hash, size and format derived from their body, by day of capture.

    A day is written by as many tasks as its size asks for; the adaptive planner splits large ones and joins small ones.
    """
    rows = captures.withColumns({"content_hash": content_hash("body"), "html_size": html_size("body"), "body_format": F.coalesce("body_format", detect_body_format("body")) if "body_format" in captures.columns else detect_body_format("body")})
    if bad := domain_violations(rows, {c: allowed for c, allowed in CAPTURE_DOMAINS.items() if c in rows.columns}).take(5):
        raise SourceContractError(f"captures hold {', '.join(f'{r.column} {r.value}' for r in bad)}")
    rows.withColumn("capture_date", F.to_date("captured_at")).hint("rebalance", "capture_date").write.mode("append").partitionBy("capture_date").option("compression", "zstd").parquet(path)


def run_report(outcomes: DataFrame, failures: str = "failed", most: int = 100) -> DataFrame:
    """One row, (report): a JSON document of counts by outcome and the first failures."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    first = outcomes.where(F.col("outcome") == failures).orderBy("source_id").limit(most).agg(F.array_sort(F.collect_list(F.struct("source_id", "detail"))).alias("failures"))
    return counts.crossJoin(first).select(F.to_json(F.struct("total", "outcomes", "failures")).alias("report"))


def export_texts(captures: DataFrame, texts: DataFrame, path: str) -> None:
    """Markdown and metadata of succeeded captures, by domain, as JSON lines."""
    rows = captures.where("status = 'succeeded'").join(texts, "capture_id")
    rows.hint("rebalance", "domain").write.mode("overwrite").partitionBy("domain").option("compression", "gzip").json(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, checksum) of each table; the checksum, a sum over the MD5 of all rows, doesn't depend on their order."""
    out = None
    for name, df in sorted(tables.items()):
        text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(df.columns)))
        part = df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("checksum")).select(F.lit(name).alias("name"), "n_rows", "checksum")
        out = part if out is None else out.union(part)
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all tables and their manifest below `path`; the manifest is of what was written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    found = manifest({name: spark.read.parquet(f"{path}/{name}") for name in tables})
    found.write.mode("overwrite").json(f"{path}/_manifest")
    return spark.read.schema("name string, n_rows long, checksum string").json(f"{path}/_manifest")


def verify_snapshot(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, n_rows, checksum, ok): the manifest of each table as it is now, and whether it is as the stored one says."""
    said = spark.read.schema("name string, n_rows long, checksum string").json(f"{path}/_manifest")
    now = manifest({name: spark.read.parquet(f"{path}/{name}") for name in names})
    same = F.col("n_rows").eqNullSafe(F.col("n_now")) & F.col("checksum").eqNullSafe(F.col("sum_now"))
    return said.join(now.select("name", F.col("n_rows").alias("n_now"), F.col("checksum").alias("sum_now")), "name", "full_outer").select("name", F.col("n_now").alias("n_rows"), F.col("sum_now").alias("checksum"), F.coalesce(same, F.lit(False)).alias("ok"))
