"""Households holding a large part of all rows, and copies of one row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthtab.operators import skew
from hearthtab.operators.skew import SkewLimits, find_heavy, number_rows
from hearthtab.plans import fixture
from hearthtab.plans.oracle import ORACLES
from hearthtab.plans.queries import QUERIES
from tests.compare import connect, oracle_rows, spark_rows

LIMITS = SkewLimits(rows_per_task=50)
HOT = 7


@pytest.fixture(scope="module")
def skewed(spark, small, tmp_path_factory):
    """A third of all lines in one order; half of those are copies of one line."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    hot = F.col("l_partkey") % 3 == 0
    first = lines.where(hot).orderBy(*lines.columns).first().asDict()
    copy = hot & (F.col("l_suppkey") % 2 == 0)
    lines.select(
        *[
            F.when(copy, F.lit(value)).otherwise(F.col(name)).alias(name)
            for name, value in first.items()
        ]
    ).withColumn(
        "l_orderkey", F.when(hot | copy, F.lit(HOT).cast("bigint")).otherwise(F.col("l_orderkey"))
    ).repartition(3, "l_extendedprice").write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{small}/orders.parquet").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.fixture
def small_tasks(monkeypatch):
    """Treat households as too large from a few rows on."""
    monkeypatch.setattr(fixture, "find_heavy", lambda rows, keys, limits=None: find_heavy(rows, keys, LIMITS))


class Folder:
    """Parquet folders of several files, as views."""

    def __init__(self, path):
        self.con = connect.__globals__["duckdb"].connect()
        for table in ("orders", "lineitem"):
            self.con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")


def test_heavy_keys_are_looked_for_in_groups(spark, monkeypatch):
    """Without a large group no key is counted; keys that share a group with a heavy one are told from it."""
    taken = []
    real = skew.new_location
    monkeypatch.setattr(skew, "new_location", lambda spark, name: taken.append(name) or real(spark, name))
    key = "CASE WHEN id < 300 THEN 7 WHEN id < 500 THEN NULL ELSE id DIV 2 END AS k"
    rows = spark.range(2000).selectExpr(key, "id % 2 AS j", "'x' AS _group")
    assert find_heavy(rows, ["k", "j"], SkewLimits(rows_per_task=150)).table is None
    assert taken == ["key-groups"]
    expected = [(None, 0, 100), (None, 1, 100), (7, 0, 150), (7, 1, 150)]
    # 1504 keys in many groups, in 80, and with too many rows for eight groups.
    for groups in (skew.KEY_GROUPS, 80, 8):
        monkeypatch.setattr(skew, "KEY_GROUPS", groups)
        found = find_heavy(rows, ["k", "j"], SkewLimits(rows_per_task=99)).table
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_fixture_is_skewed(spark, skewed):
    heavy = fixture.heavy_households(spark, skewed, LIMITS)
    lines = spark.read.parquet(f"{skewed}/lineitem.parquet")
    (hot,) = heavy.table.where(f"SERIAL = {HOT}").collect()
    assert hot.rows > lines.count() / 4
    assert lines.where(f"l_orderkey = {HOT}").groupBy(*lines.columns).count().where(
        f"count > {hot.rows} / 3"
    ).count() == 1


@pytest.mark.parametrize(
    "name",
    [
        "write_read_roundtrip", "household_rollup", "person_with_household", "row_count_checks",
        "hhsize_by_year", "multifam_share_by_race", "multifam_hh_percent", "hh_components",
        "rent_burden", "lpm_sufficient_stats",
    ],
)
def test_results_stay_exact(spark, skewed, small_tasks, name):
    con = Folder(skewed).con
    assert spark_rows(QUERIES[name](spark, skewed)) == oracle_rows(con, ORACLES[name])


def test_no_task_gets_the_whole_household(spark, skewed):
    heavy = fixture.heavy_households(spark, skewed, LIMITS)
    rows = fixture._lines(spark, skewed).selectExpr(
        fixture._YEAR, "SERIAL", *fixture._LINE_ORDER,
        "_metadata.file_path AS file_path", "_metadata.row_index AS row_index",
    )
    numbered = number_rows(
        rows, ["YEAR", "SERIAL"], fixture._LINE_ORDER, ["file_path", "row_index"], "n", "size", heavy
    )
    (hot,) = heavy.table.where(f"SERIAL = {HOT}").collect()
    in_order = numbered.where(f"SERIAL = {HOT}").select("n", "size").orderBy("n").collect()
    assert [row.n for row in in_order] == list(range(1, hot.rows + 1))
    assert {row["size"] for row in in_order} == {hot.rows}


@pytest.mark.parametrize("copies", [1, 4])
def test_tasks_stay_small_at_any_size(spark, monkeypatch, tmp_path, copies):
    """Rows of a heavy key per written partition, while its size grows."""
    written = []
    monkeypatch.setattr(skew, "new_location", lambda spark, name: written.append(f"{tmp_path}/{name}") or written[-1])
    rows = spark.range(3000 * copies).selectExpr("id % 7 AS o", "id", "IF(id % 3 = 0, -1L, id) AS k")
    heavy = find_heavy(rows, ["k"], SkewLimits(rows_per_task=100))
    numbered = number_rows(rows, ["k"], ["o"], ["id"], "n", "size", heavy)
    assert numbered.where("k = -1").agg(F.max("n"), F.countDistinct("n")).first() == (1000 * copies, 1000 * copies)
    sizes = (
        spark.read.parquet(written[-1]).groupBy(F.shiftright("_place", 33)).count().agg(F.max("count")).first()[0]
    )
    assert sizes <= 4 * 100


def test_few_ranges_of_many_heavy_rows(spark, monkeypatch, tmp_path):
    """What the driver gathers and the files follow the range partitions: a low limit makes no more of them."""
    written = []
    monkeypatch.setattr(skew, "new_location", lambda spark, name: written.append(f"{tmp_path}/{name}") or written[-1])
    rows = spark.range(1500).selectExpr("id % 7 AS o", "id", "IF(id % 3 = 0, -1L, id) AS k")
    heavy = find_heavy(rows, ["k"], SkewLimits(rows_per_task=1))
    numbered = number_rows(rows, ["k"], ["o"], ["id"], "n", "size", heavy)
    assert numbered.where("k = -1").agg(F.max("n"), F.countDistinct("n")).first() == (500, 500)
    assert len(list((tmp_path / "heavy-rows").glob("part-*"))) <= skew.MOST_RANGES


def test_ranges_grow_with_the_rows():
    assert skew._ranges(4000, 100) == 41
    assert skew._ranges(72_000_000, 1000) == skew.MOST_RANGES
    assert skew._ranges(10**9, 1000) == 1001
    assert skew._ranges(10**9, 10**8) == 11


def test_heavy_keys(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS k")
    assert find_heavy(rows, ["k"], SkewLimits(10)).table is None
    assert find_heavy(rows, ["k"], SkewLimits(9)).table.count() == 100
    assert find_heavy(rows, ["k"]).table is None


def test_skewed_flat_join_is_split_by_adaptive_execution(spark, skewed):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        table = QUERIES["multifam_share_by_year"](spark, skewed)
        table.collect()
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "skew=true" in plan
