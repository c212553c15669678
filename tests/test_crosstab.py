from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hearthtab.operators import components
from hearthtab.operators.crosstab import (
    crosstab_count,
    crosstab_mean,
    crosstab_percent,
    with_percent,
)
from hearthtab.plans import published, queries
from tests.compare import spark_rows

SCHEMA = "g string, h string, x double, w decimal(12,2)"


def frame(spark, rows):
    return spark.createDataFrame(
        [(g, h, x, None if w is None else Decimal(w)) for g, h, x, w in rows], SCHEMA
    )


def test_count_keeps_null_groups(spark):
    df = frame(spark, [("a", None, 1.0, 2), ("a", "p", 1.0, 3), (None, "p", 1.0, 5)])
    got = {row.g: (row.weighted_count, row["count"]) for row in crosstab_count(df, "w", ["g"]).collect()}
    assert got == {"a": (5.0, 2), None: (5.0, 1)}


def test_mean_skips_unknown_values_and_weights(spark):
    values = [(4.0, 1), (None, 7), (8.0, 3), (9.0, None)]
    df = frame(spark, [("a", None, x, w) for x, w in values])
    row = crosstab_mean(df, "x", "w", ["g"]).first()
    assert (row.weighted_count, row["count"], row.weighted_mean) == (11.0, 4, 7.0)


def test_mean_without_weight_is_null(spark):
    row = crosstab_mean(frame(spark, [("a", None, 4.0, 0)]), "x", "w", ["g"]).first()
    assert row.weighted_mean is None


def test_percent_keeps_null_cells_in_the_denominator(spark):
    df = frame(spark, [("a", "p", 1.0, 1), ("a", None, 1.0, 3), ("b", "p", 1.0, 5)])
    got = {
        (row.g, row.h): row.percent for row in crosstab_percent(df, "w", ["g", "h"], ["g"]).collect()
    }
    assert got == {("a", "p"): 25.0, ("a", None): 75.0, ("b", "p"): 100.0}


def test_percent_over_everything(spark):
    df = frame(spark, [("a", "p", 1.0, 1), ("b", "p", 1.0, 3)])
    got = {row.g: row.percent for row in crosstab_percent(df, "w", ["g"], []).collect()}
    assert got == {"a": 25.0, "b": 75.0}


def test_percent_groups_must_be_part_of_groups(spark):
    with pytest.raises(ValueError, match="part of group_by"):
        crosstab_percent(frame(spark, [("a", "p", 1.0, 1)]), "w", ["g"], ["h"])


row_strategy = st.tuples(
    st.sampled_from(["a", "b", None]),
    st.sampled_from(["p", "q", None]),
    st.floats(-100, 100).map(lambda x: round(x, 2)),
    st.integers(1, 10_000).map(lambda cents: f"{cents / 100:.2f}"),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row_strategy, min_size=1, max_size=30))
def test_percents_sum_to_100_and_counts_to_the_rows(spark, rows):
    cells = crosstab_percent(frame(spark, rows), "w", ["g", "h"], ["g"]).collect()
    assert sum(cell["count"] for cell in cells) == len(rows)
    for group in {cell.g for cell in cells}:
        total = sum(cell.percent for cell in cells if cell.g == group)
        assert total == pytest.approx(100, abs=1e-9)


# Published household composition in 1900 and 2023, and 1900 relative to 2023.
PUBLISHED_1900 = (
    0.7814045594265968, 2.1949051773861656, 0.06609892841681948, 0.07248045188308931,
    0.1689354234104693, 0.29477116458986596,
)
PUBLISHED_1900_RELATIVE = (
    1.6708507030438216, 3.2309210099051042, 1.5760900712934929, 1.4578920509867648,
    2.339106224316213, 1.9976704103690535,
)
PUBLISHED_2023 = (
    0.46766868996918565, 0.6793434969958094, 0.04193854756192473,
    0.04971592501243929, 0.0722222110540764, 0.1475574564551964,
)

# Published multifamily households of 1900 by number of families,
# weighted count and percent.
PUBLISHED_FAMILIES_1900 = {
    2: (1919665.0, 68.8693764798737),
    3: (497590.0, 17.8514027409055),
    4: (176787.0, 6.34236205783167),
    5: (193358.0, 6.93685872138911),
}


def test_normalization_reproduces_published_values(spark):
    schema = "YEAR int, " + ", ".join(f"{name} double" for name in components.COMPONENTS)
    table = spark.createDataFrame([(1900, *PUBLISHED_1900), (2023, *PUBLISHED_2023)], schema)
    got = {row.YEAR: row for row in components.normalize_to_year(table).collect()}
    assert tuple(got[2023])[1:] == (1.0,) * 6
    assert tuple(got[1900])[1:] == pytest.approx(PUBLISHED_1900_RELATIVE, rel=1e-14)


def test_normalization_needs_the_base_year(spark):
    schema = "YEAR int, " + ", ".join(f"{name} double" for name in components.COMPONENTS)
    table = spark.createDataFrame([(1900, *PUBLISHED_1900)], schema)
    with pytest.raises(Exception, match="no rows for base year 2023"):
        components.normalize_to_year(table).collect()


def test_percent_reproduces_published_values(spark):
    rows = [(1900, n, weight) for n, (weight, _) in PUBLISHED_FAMILIES_1900.items()]
    table = spark.createDataFrame(rows, "YEAR int, n int, weighted_count double")
    got = {row.n: row.percent for row in with_percent(table, ["YEAR"]).collect()}
    assert got == pytest.approx({n: p for n, (_, p) in PUBLISHED_FAMILIES_1900.items()}, rel=1e-13)


def test_published_share_is_a_part_of_all_persons(spark):
    # Published persons of 1900, those in multifamily households, percent.
    rows = [(True, 15449629.0), (False, 74048036.0 - 15449629.0)]
    table = spark.createDataFrame(rows, "is_multifam boolean, weighted_count double")
    got = {row.is_multifam: row.percent for row in with_percent(table, []).collect()}
    assert got[True] == pytest.approx(20.864333255239885, rel=1e-13)


def test_long_tables(spark, small):
    wide = components.hh_components(queries.household(spark, small))
    long = components.hh_components_long(wide)
    assert long.count() == 7 * wide.count()
    first = long.where("rank = 7").first()
    assert (first.component, first.label, first.value) == ("reference_person", "Reference person", 1.0)


def test_ages_sum_to_the_year(spark, small):
    person = queries.flat_person(spark, small)
    ages = published.multifam_share_by_age(person).groupBy("YEAR").sum("weighted_count")
    years = published.multifam_share_by_year(person).select("YEAR", "weighted_count")
    assert spark_rows(ages.toDF("YEAR", "weighted_count")) == spark_rows(years)


def test_one_scan_tables_equal_the_single_tables(spark, small):
    person = queries.flat_person(spark, small)
    tables = published.multifam_share_tables(person)
    columns = ["YEAR", "weighted_count", "count", "percent"]
    for name, extra, single in (
        ("all", [], published.multifam_share_by_year(person)),
        ("race_eth", ["race_eth"], published.multifam_share_by_race(person)),
        ("age_bucket", ["age_bucket"], published.multifam_share_by_age(person)),
    ):
        part = tables.where(tables.breakdown == name).select(*columns, *extra)
        assert spark_rows(part) == spark_rows(single.select(*columns, *extra))


def test_percent_scans_the_data_once(spark, small):
    """One scan and one shuffle of the data; totals come from its cells, by one join."""
    data = spark.read.parquet(f"{small}/lineitem.parquet")
    table = crosstab_percent(data, "l_quantity", ["l_returnflag", "l_linestatus"], ["l_returnflag"])
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1
    # The reused one is named once more.
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 2
    assert plan.count("HashJoin") == 1 and plan.count("SortMergeJoin") == 0


def test_percent_of_every_grouping(spark):
    rows = [("a", 1, 2.0), ("a", None, 3.0), (None, 1, 5.0), (None, None, 7.0), ("a", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, h int, w double")

    def found(*within):
        return {(r.g, r.h): round(r.percent, 6) for r in crosstab_percent(df, "w", ["g", "h"], list(within)).collect()}

    assert found() == {("a", 1): 16.666667, ("a", None): 16.666667, (None, 1): 27.777778, (None, None): 38.888889}
    assert found("g") == {("a", 1): 50.0, ("a", None): 50.0, (None, 1): 41.666667, (None, None): 58.333333}
    assert found("h") == {("a", 1): 37.5, (None, 1): 62.5, ("a", None): 30.0, (None, None): 70.0}
    assert set(found("g", "h").values()) == {100.0}
    assert crosstab_percent(df.where("false"), "w", ["g", "h"], ["g"]).collect() == []
    assert crosstab_percent(df.where("false"), "w", ["g", "h"], []).collect() == []
