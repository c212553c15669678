"""From an extract to stage tables, published CSVs and models."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

from hearthtab.operators.skew import SkewLimits
from hearthtab.operators.validate import ValidationError
from hearthtab.plans import build, fixture, queries
from hearthtab.sources import versions
from tests.compare import spark_rows


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    return build.build_tables(fixture.person(spark, small), str(tmp_path_factory.mktemp("stage")))


def test_stage_tables_equal_the_direct_plans(spark, small, tables):
    household = queries.household(spark, small)
    assert spark_rows(tables.household) == spark_rows(household.select(*tables.household.columns))
    merged = queries.with_household(spark, small)
    columns = merged.columns
    assert spark_rows(tables.person_with_household.select(*columns)) == spark_rows(merged)


def test_duplicate_persons_stop_the_build(spark, small, tmp_path):
    extract = fixture.person(spark, small)
    twice = extract.union(extract.where("SERIAL = 7"))
    with pytest.raises(ValidationError, match="not unique"):
        build.build_tables(twice, str(tmp_path))


def test_checks_and_a_lost_row(spark, small, tables, tmp_path, monkeypatch):
    assert [step for step, _, _ in tables.checks] == [
        "person recode", "unique person key", "household rollup", "person with household",
    ]
    assert all(expected == actual for _, expected, actual in tables.checks)
    real = build.join_household
    monkeypatch.setattr(build, "join_household", lambda *a: real(*a).where("SERIAL <> 7"))
    with pytest.raises(ValidationError, match="person with household: expected"):
        build.build_tables(fixture.person(spark, small), str(tmp_path))


def test_extract_is_parsed_once(spark, small, tmp_path):
    """Each row of the extract goes through the plan once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    extract = fixture.person(spark, small)
    counted = extract.mapInArrow(count, extract.schema)
    tables = build.build_tables(counted, str(tmp_path))
    assert seen.value == tables.person.count()


def test_merge_shuffles_the_persons_once(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = build.join_household(tables.person, tables.household, build.find_heavy(tables.person, ["SERIAL"]))
        merged.collect()
        plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("- Exchange hashpartitioning") == 2  # persons and households
    assert plan.count("FileScan parquet") == 2


def test_build_moves_the_persons_once(spark, small, tables, tmp_path, monkeypatch):
    """Rollup and merge read the stages by bucket, without a shuffle; the tables are the same."""
    plans = {}

    def noted(name):
        real = getattr(build, name)

        def call(*parts):
            made = real(*parts)
            with build._joins_by_bucket(spark):
                plans[name] = made._jdf.queryExecution().executedPlan().toString()
            return made

        monkeypatch.setattr(build, name, call)

    noted("household_rollup")
    noted("join_household")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build.build_tables(fixture.person(spark, small), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {name: plan.count("Exchange") for name, plan in plans.items()} == {
        "household_rollup": 0, "join_household": 0,
    }
    assert spark_rows(built.person_with_household) == spark_rows(tables.person_with_household)
    assert build.SLICE not in built.person.columns + built.household.columns
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hearthtab_")]
    # A year lies in few files.
    assert len(list(tmp_path.glob("person/*/YEAR=2000/*.parquet"))) == 1


def test_merge_sorts_the_persons_once(spark, small, tables, tmp_path, monkeypatch):
    """The join sorts persons in the order of the files, so that nothing is sorted after it."""
    plans = []
    real = versions.Change.write

    def noted(change, name, data, **options):
        if name == "person_with_household":
            plans.append((data._jdf.queryExecution().executedPlan().toString(), options["cluster_by"]))
        return real(change, name, data, **options)

    monkeypatch.setattr(versions.Change, "write", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build.build_tables(fixture.person(spark, small), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ((plan, cluster_by),) = plans
    assert plan.count("Sort [") == 2  # persons and households
    assert not cluster_by
    assert built.person_with_household.columns[:3] == ["SERIAL", "YEAR", "PERNUM"]
    files = list(tmp_path.glob("person_with_household/*/*/*.parquet"))
    assert files
    for file in files:
        rows = pq.ParquetFile(file).read(["SERIAL", "PERNUM"]).to_pylist()
        places = [(row["SERIAL"], row["PERNUM"]) for row in rows]
        assert places == sorted(places)


def test_person_keys_are_checked_by_bucket(spark, small, tmp_path, monkeypatch):
    plans = []
    real = build.validate_unique_key

    def noted(rows, keys, step):
        plans.append(rows.groupBy(*keys).count()._jdf.queryExecution().executedPlan().toString())
        real(rows, keys, step)

    monkeypatch.setattr(build, "validate_unique_key", noted)
    build.build_tables(fixture.person(spark, small), str(tmp_path))
    assert [plan.count("Exchange") for plan in plans] == [0]


def test_heavy_households_are_merged_over_tasks(spark, small, tables, tmp_path):
    """The smallest limits make households heavy, which are not read by bucket."""
    built = build.build_tables(fixture.person(spark, small), str(tmp_path), SkewLimits(rows_per_task=6))
    for name in build.STAGE_NAMES:
        assert spark_rows(getattr(built, name)) == spark_rows(getattr(tables, name))


def test_published_csvs(spark, small, tables, tmp_path):
    results = build.published_tables(tables)
    assert len(results) == 9
    build.write_published(results, str(tmp_path))
    headers = {}
    for name, table in results.items():
        (part,) = (tmp_path / name).glob("part-*")
        lines = part.read_text().splitlines()
        headers[name] = lines[0]
        assert len(lines) == table.count() + 1
    # Headers of the published tables.
    assert headers["hhsize_by_year"] == "YEAR,weighted_count,count,weighted_mean"
    assert headers["multifam_share_by_year"] == "is_multifam,YEAR,weighted_count,count,percent"
    assert headers["multifam_hh_count"] == '"n_multifam","YEAR","weighted_count","count"'
    assert headers["gq_share_by_race"] == "in_gq,YEAR,race_eth,weighted_count,count,percent"
    assert headers["hh_components"] == (
        "YEAR,n_spouse,n_child,n_parent,n_grandchild,n_other_rel,n_non_rel"
    )
    direct = queries.QUERIES["multifam_share_by_age"](spark, small)
    assert spark_rows(results["multifam_share_by_age"]) == spark_rows(direct)


def test_models(spark, small, tables):
    models = build.fit_models(tables)
    assert list(models) == ["base", "child", "demo", "ses"]
    base = {(row.YEAR, row.term): row.estimate for row in models["base"].collect()}
    for row in queries.QUERIES["lpm_base"](spark, small).collect():
        assert base[row.YEAR, row.term] == pytest.approx(row.estimate, abs=1e-6)


def test_year_filter_prunes_partitions(tables):
    plan = tables.household.where("YEAR = 2023").select("hh_size")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in text and "ReadSchema: struct<hh_size:bigint>" in text
