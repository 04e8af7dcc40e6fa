"""Every registered query of the library against its SQL, and the entry module."""

import re

import pytest

import __spark_entry__
from barloom.plans import queries
from tests.compare import assert_same
from tests.conftest import views


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_its_sql(spark, sql_dir, sql_duck, name):
    assert_same(queries.queries()[name](spark, sql_dir), sql_duck.execute(queries.oracle_sql()[name]))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_comparison_sees_whole_numbers(spark, duck):
    """Integers one apart differ, however many digits they have; doubles are compared to nine."""
    assert_same(spark.sql("SELECT 1704067207180 AS n, 1.00000000001D AS x"), duck.execute("SELECT 1704067207180 AS n, 1.0::DOUBLE AS x"))
    with pytest.raises(AssertionError):
        assert_same(spark.sql("SELECT 1704067207180 AS n"), duck.execute("SELECT 1704067207179 AS n"))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "train_mean" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("partitions", [1, 13])
def test_results_do_not_depend_on_partitions(spark, sf_dir, partitions):
    names = ["bars_sessions", "bars_of_50_ticks", "rel_as_of", "ind_macd", "strat_mined"]
    before = {name: sorted(map(repr, queries.queries()[name](spark, sf_dir).collect())) for name in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in names:
            assert sorted(map(repr, queries.queries()[name](spark, sf_dir).collect())) == before[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_sketches_are_one_an_event_type(spark, tmp_path):
    """No pair of an event type and a user has sketches of its own; rows without a type are a type too, and null values have no rank."""
    rows = [(k, ("a", "b", None)[k % 3], k % 7 if k % 5 else None, float(k) if k % 2 else None) for k in range(300)] + [(300, "nothing", None, None)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    made = queries.queries()["rel_approximate"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("approx_percentile" in line for line in plan)
    assert not [line for line in plan if "approx" in line and re.search(r"keys=\[[^\]]*user_id", line)]
    assert_same(made, views(str(tmp_path)).execute(queries.oracle_sql()["rel_approximate"]))
