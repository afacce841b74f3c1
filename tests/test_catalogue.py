import os

import pytest
from oracle import DATA, duck, spark_rows

from skerry.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_duckdb(spark, name):
    df = QUERIES[name](spark, DATA)
    got = spark_rows(df)
    if name not in ORACLE:
        assert got[1]
        return
    want, kinds, names = duck(ORACLE[name])
    assert got == want
    assert want[1] or name == "op_empty"  # nothing against nothing would prove nothing
    mine = dict(df.dtypes)
    wrong = {n: (mine[n], k) for n, k in zip(names, kinds, strict=True) if k in KINDS and mine[n] != KINDS[k]}
    assert not wrong, wrong


def test_plans_stay_in_the_jvm(spark):
    for name in catalogue.SQL:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Cartesian" not in plan, name
    pruned = QUERIES["scan_pk_range"](spark, DATA)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in pruned and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in pruned


def plan_of(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().toString()


def test_plans(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        anti = plan_of(spark, "not_in_subquery")
        assert "LeftAnti" in anti and "BroadcastHashJoin" not in anti and "BroadcastNestedLoopJoin" not in anti
        assert "In(o_orderkey" in plan_of(spark, "scan_points").replace(" IN ", " In(") or "o_orderkey IN" in plan_of(spark, "scan_points")
        assert "LocalLimit" in plan_of(spark, "limit_scan") and "TakeOrderedAndProject" in plan_of(spark, "top_k")
        assert "partial_" in plan_of(spark, "user_aggregates")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_estimates_are_not_grouped_by_key(spark, tmp_path):
    plan = QUERIES["approx_cardinality"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "HashAggregate(" in line and "approx_count_distinct" in line and "keys=[]" not in line]
    assert "approx_count_distinct" in plan and "Expand" not in plan and not grouped
    made = spark.sql("select id % 50 o_custkey, if(id % 3 = 0, null, id) o_orderkey from range(9000) union all select null, null")
    for name, rows, want in (("some", made, (True, True)), ("none", made.limit(0), (True, True)), ("nulls", made.filter("o_custkey is null"), (True, True))):
        rows.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        assert [tuple(x) for x in QUERIES["approx_cardinality"](spark, f"{tmp_path}/{name}").collect()] == [want]


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/skerry", tmp_path / "skerry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_group' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
