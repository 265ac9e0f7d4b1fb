"""Every archive query against its SQL, and those without SQL for what they must hold."""

from __future__ import annotations

import pytest
from compare import rows

from papyrarc import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.fixture
def equals_sql(spark, sf_dir, tmp_path):
    """Compares a query with its SQL on the given pages, whose html becomes this expression."""
    import duckdb

    def compare(name, html):
        spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", f"{html} AS html").write.parquet(f"{tmp_path}/pages.parquet")
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
            theirs = con.sql(SQL[name]).df()
        assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(theirs)

    return compare


#: A title that is cut within a reference, as some pages of larger tables have.
_CUT_TITLES = "replace(html, '</h1>', concat(' R&amp;D ', element_at(array('&amp', '&am', '&quot', '&copy', '&lt', '&'), cast(page_id % 6 + 1 as int)), '</h1>'))"


def test_exported_markdown_of_cut_titles_equals_sql(equals_sql):
    equals_sql("a9_export_markdown", _CUT_TITLES)


def test_markdown_of_cut_titles_and_link_parameters_equals_sql(equals_sql):
    equals_sql("d9_markdown", f"replace({_CUT_TITLES}, 'href=\"/', 'href=\"/a&copy=1&amp;reg=2&lt/')")


def test_few_queries_lack_sql():
    assert sorted(set(QUERIES) - set(SQL)) == ["a7_run_report", "f2_stems", "h9_recode_report"]


def test_run_report_counts_all_rows(spark, sf_dir):
    import json

    (row,) = QUERIES["a7_run_report"](spark, sf_dir).collect()
    report = json.loads(row["report"])
    assert report["total"] == sum(report["outcomes"].values()) > 0
    assert len(report["failures"]) == min(100, report["outcomes"]["failed"])


def test_recode_report_adds_up(spark, sf_dir):
    (row,) = QUERIES["h9_recode_report"](spark, sf_dir).collect()
    assert row.scanned == row.changed + row.retained + row.failed > 0
    assert row.bytes_saved == row.bytes_before - row.bytes_after > 0
