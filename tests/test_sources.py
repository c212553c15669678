from __future__ import annotations

import gzip
from decimal import Decimal

import pytest

from hearthtab.plans import fixture
from hearthtab.sources import fixed_width, tables, workspace
from tests.compare import spark_rows

CODEBOOK = """<?xml version="1.0" encoding="UTF-8"?>
<codeBook xmlns="ddi:codebook:2_5">
  <dataDscr>
    <var ID="YEAR" name="YEAR" dcml="0">
      <location StartPos="1" EndPos="4" width="4"/><varFormat type="numeric"/>
    </var>
    <var ID="PERWT" name="PERWT" dcml="2">
      <location StartPos="5" EndPos="14"/><varFormat type="numeric"/>
    </var>
    <var ID="SERIAL" name="SERIAL" dcml="0">
      <location StartPos="15" EndPos="24" width="10"/><varFormat type="numeric"/>
    </var>
    <var ID="NOTE" name="NOTE">
      <location StartPos="25" EndPos="27" width="3"/><varFormat type="character"/>
    </var>
  </dataDscr>
</codeBook>
"""
LINES = [
    "196000000001251234567890abc",
    "1970        50         2 x ",
    "2023      -150         3   ",
    "2023                   4abc",
    "    00000100000000000005abc",
]


@pytest.fixture
def extract(tmp_path):
    (tmp_path / "book.xml").write_text(CODEBOOK)
    with gzip.open(tmp_path / "rows.dat.gz", "wt") as out:
        out.write("\n".join(LINES) + "\n")
    return tmp_path


def test_fixed_width(spark, extract):
    book = fixed_width.read_codebook(spark, str(extract / "book.xml"))
    assert [(f.name, f.start, f.width, f.decimals) for f in book] == [
        ("YEAR", 1, 4, 0), ("PERWT", 5, 10, 2), ("SERIAL", 15, 10, 0), ("NOTE", 25, 3, 0),
    ]
    df = fixed_width.read_fixed_width(spark, str(extract / "rows.dat.gz"), book, partitions=3)
    assert dict(df.dtypes) == {
        "YEAR": "int", "PERWT": "decimal(10,2)", "SERIAL": "bigint", "NOTE": "string",
    }
    assert df.rdd.getNumPartitions() == 3
    got = sorted((tuple(row) for row in df.collect()), key=lambda row: row[2])
    assert got == [
        (1970, Decimal("0.50"), 2, "x"),
        (2023, Decimal("-1.50"), 3, None),
        (2023, None, 4, "abc"),
        (None, Decimal("100.00"), 5, "abc"),
        (1960, Decimal("1.25"), 1234567890, "abc"),
    ]


def test_fixed_width_columns_can_be_chosen(spark, extract):
    book = fixed_width.read_codebook(spark, str(extract / "book.xml"))
    df = fixed_width.read_fixed_width(spark, str(extract / "rows.dat.gz"), book, ["SERIAL"])
    assert df.columns == ["SERIAL"]


def test_fixed_width_bad_number_is_an_error(spark, tmp_path):
    (tmp_path / "rows.txt").write_text("19x0\n")
    layout = [fixed_width.Field("YEAR", 1, 4)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fixed_width.read_fixed_width(spark, str(tmp_path / "rows.txt"), layout).collect()


def test_fixed_width_value_must_fit(spark, tmp_path):
    layout = [fixed_width.Field("A", 1, 2)]
    df = spark.createDataFrame([(100,)], "A int")
    with pytest.raises(Exception, match="A too wide: 100"):
        fixed_width.write_fixed_width(df, str(tmp_path / "out"), layout)


def test_record_layout_has_no_gaps():
    place = 1
    for field in fixture.RECORD_LAYOUT:
        assert field.start == place
        place += field.width
    assert [f.name for f in fixture.RECORD_LAYOUT] == list(fixture.PERSON_COLUMNS)


def test_select_samples(spark):
    rows = [(1960, 1, 5, 9), (1950, 1, 5, 9), (2023, 1, 5, 9)]
    extract = spark.createDataFrame(rows, "YEAR int, SERIAL int, AGE int, OTHER int")
    with pytest.raises(ValueError, match="the extract has no HHWT, GQ"):
        tables.select_samples(extract)
    chosen = tables.select_samples(extract, allow_missing=True)
    assert chosen.columns == ["YEAR", "SERIAL", "AGE"]
    lower = extract.toDF(*[c.lower() for c in extract.columns])
    assert tables.select_samples(lower, allow_missing=True).columns == chosen.columns
    assert sorted(row.YEAR for row in chosen.collect()) == [1960, 2023]
    assert [row.YEAR for row in tables.select_samples(extract, [1950], allow_missing=True).collect()] == [1950]
    assert len(tables.SAMPLE_YEARS) == 28 and len(tables.REQUESTED_VARIABLES) == 22


def test_table_is_replaced_and_pruned(spark, small, tmp_path):
    person = fixture.person(spark, small)
    path = str(tmp_path / "person")
    tables.create_or_replace_table(person, path)
    back = tables.create_or_replace_table(person, path)
    assert back.schema.names == person.schema.names
    assert spark_rows(back) == spark_rows(person)
    one_year = back.where("YEAR = 2023").select("AGE")
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in plan
    assert "ReadSchema: struct<AGE:int>" in plan


def read_csv(path):
    (part,) = path.glob("part-*")
    return part.read_text()


def test_result_csv(spark, tmp_path):
    rows = [(True, 2023, None, 1.5), (False, 1960, "a b", 2.0)]
    table = spark.createDataFrame(rows, "is_multifam boolean, YEAR int, race_eth string, x double")
    tables.write_result_csv(table, str(tmp_path / "plain"), ["YEAR"])
    assert read_csv(tmp_path / "plain") == (
        "is_multifam,YEAR,race_eth,x\nFALSE,1960,a b,2\nTRUE,2023,NA,1.5\n"
    )


def test_result_csv_with_quoted_header(spark, tmp_path):
    table = spark.createDataFrame([(2, 2023, 1.5), (3, None, 2.0)], "n int, YEAR int, w double")
    tables.write_result_csv(table, str(tmp_path / "quoted"), ["n"], quote_header=True)
    assert read_csv(tmp_path / "quoted") == '"n","YEAR","w"\n2,2023,1.5\n3,NA,2\n'


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert workspace.new_location(spark, "x").startswith(f"{folder}/hearthtab/x-")
    assert workspace.new_location(spark, "x") != workspace.new_location(spark, "x")


def test_shared_folder_without_the_setting(spark, monkeypatch):
    """The warehouse serves where no folder is set; no machine-local folder is made up."""
    monkeypatch.setattr(workspace, "CHECKPOINT_SETTING", "spark.no.such.setting")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = workspace.shared_folder(spark)
    if chosen.isDefined():
        assert folder == chosen.get()
    else:
        assert folder == spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def test_failed_check_keeps_the_earlier_table(spark, tmp_path):
    path = str(tmp_path / "stage")
    first = spark.createDataFrame([(2000, 1)], "YEAR int, n int")
    tables.create_or_replace_table(first, path)

    def refuse(written):
        assert written.count() == 2
        raise RuntimeError("no")

    second = spark.createDataFrame([(2000, 2), (2010, 3)], "YEAR int, n int")
    with pytest.raises(RuntimeError, match="no"):
        tables.create_or_replace_table(second, path, check=refuse)
    assert spark.read.parquet(path).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["stage"]
    # A table may be made from its own earlier state.
    tables.create_or_replace_table(spark.read.schema(first.schema).parquet(path).union(second), path)
    assert spark.read.parquet(path).count() == 3


def test_codebook_round_trip():
    text = fixed_width.codebook_text(fixture.RECORD_LAYOUT)
    assert fixed_width.parse_codebook(text) == list(fixture.RECORD_LAYOUT)


def test_gzip_lines_are_spread_before_parsing(spark, tmp_path):
    layout = [fixed_width.Field("A", 1, 4)]
    frame = spark.range(500).selectExpr("CAST(id AS INT) AS A").coalesce(1)
    fixed_width.write_fixed_width(frame, str(tmp_path / "zipped"), layout)
    read = fixed_width.read_fixed_width(spark, str(tmp_path / "zipped"), layout)
    assert read.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert read.agg({"A": "sum"}).first()[0] == sum(range(500))
    with pytest.raises(ValueError, match="no B"):
        fixed_width.read_fixed_width(spark, str(tmp_path / "zipped"), layout, ["B"])


def test_csv_lines(spark):
    rows = [
        (102611684.7999898, "a,b", True, 1),
        (1e-7, 'q"x', None, 2),
        (-1.5e22, None, False, 3),
        (0.1, "x", True, None),
        (5.0, "y", True, 7),
        (float("nan"), "n", True, 9),
    ]
    table = spark.createDataFrame(rows, "d double, t string, b boolean, i int")
    assert [r[0] for r in tables.csv_lines(table.coalesce(1)).collect()] == [
        '102611684.7999898,"a,b",TRUE,1',
        '0.0000001,"q""x",NA,2',
        "-15000000000000000000000,NA,FALSE,3",
        "0.1,x,TRUE,NA",
        "5,y,TRUE,7",
        "NA,n,TRUE,9",
    ]
    quoted = [r[0] for r in tables.csv_lines(table.coalesce(1), quote=True).collect()]
    assert quoted[3] == '0.1,"x",TRUE,NA' and quoted[2].split(",")[1] == "NA"
    assert tables.csv_header(table, quote=True) == '"d","t","b","i"'


def test_csv_file_has_no_nul_and_keeps_the_order(spark, tmp_path):
    table = spark.createDataFrame([(k, f"text {k}, more") for k in range(50, 0, -1)], "k int, t string")
    tables.write_result_csv(table, str(tmp_path / "out"), ["k"], quote_header=True)
    (part,) = (tmp_path / "out").glob("part-*")
    lines = part.read_bytes().decode().splitlines()
    assert lines == ['"k","t"', *[f'{k},"text {k}, more"' for k in range(1, 51)]]
