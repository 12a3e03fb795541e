import pytest
from conftest import SMALL, same_rows

from partloom.plans import checks, printed, registry, stored, summaries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_roundtrip_is_exact(spark):
    assert registry.QUERIES["t47_g4_roundtrip"](spark, SMALL).where("NOT same").count() == 0


def test_split_keeps_groups_whole(spark):
    from pyspark.sql import functions as F

    out = registry.QUERIES["t41_split"](spark, SMALL)
    assert out.groupBy("source").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_range_join_hashes_its_prefix(spark):
    plan = registry.QUERIES["t10_range_join"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["t79_old_types", "t80_old_gearboxes"])
def test_open_numbers_of_seven_digits(spark, duck, tmp_path, name):
    """Keys of a large table: open-ended numbers grow beyond six digits."""
    rows = duck.sql("SELECT p_partkey + 989990 AS p_partkey, * EXCLUDE (p_partkey) FROM part UNION ALL SELECT p_partkey + 998900, * EXCLUDE (p_partkey) FROM part").arrow()
    import pyarrow.parquet as pq

    pq.write_table(rows if hasattr(rows, "schema") and not hasattr(rows, "read_all") else rows.read_all(), tmp_path / "part.parquet")
    sql = registry.ORACLES[name].replace("FROM part)", f"FROM '{tmp_path}/part.parquet')")
    same_rows(registry.QUERIES[name](spark, str(tmp_path)), duck.sql(sql))
