"""Every registered relational query against its SQL in DuckDB."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lakemill.plans import queries, statement_queries

from .support import DATA, duck, same

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        same(df, con, queries.ORACLES[name])
    else:
        df.collect()


@pytest.mark.parametrize("name", sorted(statement_queries.QUERIES))
def test_statements(spark, con, name):
    same(statement_queries.QUERIES[name](spark, SF), con, statement_queries.ORACLES[name])


def test_operators_over_whole_tables(spark, con):
    def keys(sql):
        return {r[0] for r in con.execute(sql).fetchall()}

    joined = queries.QUERIES["join_full"](spark, SF).collect()
    assert {r.s for r in joined} - {None} == keys("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
    assert {r.c for r in joined} - {None} == keys("SELECT c_custkey FROM customer WHERE c_acctbal > 0")
    assert any(r.s is None for r in joined) and any(r.c is None for r in joined)
    assert queries.QUERIES["in_subq_projected_3vl"](spark, SF).count() == len(keys("SELECT c_custkey FROM customer"))
    assert 0 < queries.QUERIES["anti_not_in"](spark, SF).count() < len(keys("SELECT c_custkey FROM customer"))
    assert 0 < queries.QUERIES["except_"](spark, SF).count() < len(keys("SELECT c_custkey FROM customer"))
    got = [(r.o_orderkey, r.s) for r in queries.QUERIES["sort_nulls_last"](spark, SF).collect()]
    assert got == con.execute(queries.ORACLES["sort_nulls_last"]).fetchall() and len(got) > 600


@pytest.mark.parametrize("name", ["fetch_with_ties", "win_over_aggregate"])
def test_no_task_sees_a_whole_table(spark, name):
    """What comes to one task is cut to the wanted ranks, or aggregated, before."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("SinglePartition")
    assert all("WindowGroupLimit" in x.split("\n")[1] + x.split("\n")[2] or "HashAggregate" in x.split("\n")[1] + x.split("\n")[2] for x in before[1:])


def test_constraint_operators_on_nulls(spark):
    from lakemill.operators import constraints

    df = spark.createDataFrame([(1, 2), (1, 2), (None, 5), (None, 5), (3, None)], "a int, b int")
    assert {(r.a, r.b, r.n) for r in constraints.unique_violations(df, ["a", "b"]).collect()} == {(1, 2, 2)}
    assert sorted(r.violated for r in constraints.not_null_violations(df, ["a", "b"]).collect()) == ["a", "a", "b"]
    assert {r.a for r in constraints.fk_orphans(df, ["a"], spark.createDataFrame([(3,)], "id int"), ["id"]).collect()} == {1}
    assert constraints.check_violations(df.limit(0), {"x": df["a"] > 0}).count() == 0


def test_entry_survives_without_optional_parts(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root / "lakemill", tmp_path / "lakemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split(None, 1)[1].startswith("[] ") and int(run().stdout.split()[0]) == len({**queries.QUERIES, **statement_queries.QUERIES})
    if (root / "lakemill/llm").exists():
        shutil.copytree(root / "lakemill/llm", tmp_path / "lakemill/llm")
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
        (tmp_path / "lakemill/llm/urls.py").write_text("import no_such_module")
        assert "no_such_module" in run().stderr  # a fault inside is no absence


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
