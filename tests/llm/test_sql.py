"""The queries with SQL, against it; all others are registered and run elsewhere in this folder."""

import pytest

from genolith.llm.queries import ORACLE_SQL, QUERIES


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return sorted(map(str, pdf[columns].astype(object).where(pdf[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(ORACLE_SQL[name]).df())


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_line_dedup", "op5_decontamination", "op7_source_mix"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
