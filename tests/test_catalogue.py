"""Every registered query of the engine gives DuckDB's rows."""

import subprocess
import sys
from pathlib import Path

import pytest

from quillon.plans import catalogue
from tests.compare import DATA, difference

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert difference(df, catalogue.ORACLES[name], SF) == (True, {}, {})
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)


@pytest.mark.parametrize("rows", [0, 49_000, 49_001, 60_000])
def test_empty_page_at_any_size(spark, tmp_path, rows):
    spark.range(rows).selectExpr("id AS doc_id", "'es' AS lang").unionByName(spark.sql("SELECT CAST(NULL AS long) AS doc_id, 'es' AS lang WHERE " + str(rows == 60_000))).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["empty_page"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["bm25_two_term_top20", "bm25_two_term_all", "bm25_under_a_filter"])
def test_ranked_queries_write_what_they_count_and_read_no_text_again(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan and "quillon-bm25-" in plan
