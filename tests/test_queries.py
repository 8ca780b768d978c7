"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("q_")))
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        with duckdb.connect() as db:
            for t in TABLES:
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
            assert rows(got) == rows(db.execute(sql).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count()


@pytest.mark.parametrize("name", ["q_code_edges", "q_source_nodes_whole", "q_shape_counts"])
def test_documents_of_one_file_are_worked_on_by_many_tasks(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_texts_are_searched_after_they_are_dealt_out(spark):
    """The words of all texts were also cut out before, by the one task that reads the file."""
    plan = entry.queries()["q_code_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan.split("REPARTITION_BY_NUM")[0] and "regexp_extract_all" not in plan.split("REPARTITION_BY_NUM")[1]
