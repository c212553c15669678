"""Versions of stage tables: whole at every moment, changed by year, removed when unused."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest

from hearthtab.operators.validate import ValidationError
from hearthtab.plans import build, fixture
from hearthtab.sources import versions
from tests.compare import spark_rows


def _table(spark, version, years=(2000, 2010, None), rows=40):
    """Rows that all bear the number of their version."""
    data = [(year, k, version, f"{version}-{k}") for year in years for k in range(rows)]
    return spark.createDataFrame(data, "YEAR int, k int, version int, name string")


def _write(spark, folder, data, name="t", **options):
    with versions.Change(spark, folder) as change:
        change.write(name, data, **options)


def _seen(spark, folder, name="t"):
    rows = versions.read_version(spark, folder, name).collect()
    return {r.version for r in rows}, len(rows)


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_replaced_and_read_back(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, folder, "t")
    for version in (1, 2):
        _write(spark, folder, _table(spark, version), cluster_by=("k",))
        found = versions.read_version(spark, folder, "t")
        assert found.columns == ["YEAR", "k", "version", "name"]
        assert spark_rows(found) == spark_rows(_table(spark, version))
    plan = found.where("YEAR = 2010").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in plan and "ReadSchema: struct<k:int>" in plan


def test_rows_may_come_from_the_version_before(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 1))
    twice = versions.read_version(spark, folder, "t").union(_table(spark, 2))
    _write(spark, folder, twice)
    assert _seen(spark, folder) == ({1, 2}, 240)


STEPS = ("_create_text", "_forget_old", "_encoded", "_names", "_read")


@pytest.mark.parametrize("step", STEPS)
def test_a_job_killed_at_any_step_leaves_one_whole_version(spark, tmp_path, monkeypatch, step):
    """Dies without any cleaning up, as a killed driver does, before or after each step of a change."""
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 1))
    real = getattr(versions, step)

    class Killed(BaseException):
        pass

    for after in (False, True):
        left = 0
        # Killed at the first, second, third ... call of this step, until the change gets through.
        while True:
            calls = 0

            def dying(*args):
                nonlocal calls
                calls += 1
                if calls > left and not after:
                    raise Killed
                result = real(*args)
                if calls > left:
                    raise Killed
                return result

            monkeypatch.setattr(versions, step, dying)
            through = False
            try:
                change = versions.Change(spark, folder)
                change.write("t", _table(spark, 2), check=lambda rows: rows.count())
                change.commit()
                through = True
            except Killed:
                pass
            monkeypatch.setattr(versions, step, real)
            seen, rows = _seen(spark, folder)
            assert seen in ({1}, {2}) and rows == 120
            if through:
                break
            left += 1
        assert seen == {2}
        _write(spark, folder, _table(spark, 1))


def test_half_written_manifests_are_not_read(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 1))
    whole = Path(versions._manifest_path(folder, 1)).read_text()
    for number, text in ((2, ""), (3, whole[: len(whole) // 2]), (4, whole[:-1])):
        Path(versions._manifest_path(folder, number)).write_text(text)
        assert _seen(spark, folder) == ({1}, 120)
    _write(spark, folder, _table(spark, 2))
    assert versions.current_manifest(spark, folder).number == 5
    assert _seen(spark, folder) == ({2}, 120)


def test_readers_in_parallel_see_whole_versions(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 0))
    stop, faults, reads = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen, rows = _seen(spark, folder)
            except Exception as error:
                faults.append(error)
                return
            reads.append(seen)
            if len(seen) != 1 or rows != 120:
                faults.append((seen, rows))

    readers = [threading.Thread(target=read) for _ in range(2)]
    for reader in readers:
        reader.start()
    for version in range(1, 6):
        _write(spark, folder, _table(spark, version))
    stop.set()
    for reader in readers:
        reader.join()
    assert not faults and len(reads) > 2


def test_two_jobs_at_once(spark, tmp_path):
    folder = str(tmp_path)
    one, two = versions.Change(spark, folder), versions.Change(spark, folder)
    one.write("t", _table(spark, 1))
    two.write("t", _table(spark, 2))
    one.commit()
    with pytest.raises(versions.ConcurrentWriteError):
        two.commit()
    two.abort()
    assert _seen(spark, folder) == ({1}, 120)
    with pytest.raises(versions.ConcurrentWriteError):
        versions._create_text(spark, versions._manifest_path(folder, 1), "x")


def test_years_are_replaced_alone(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 1))
    before = _files(folder)
    _write(spark, folder, _table(spark, 2, years=(2010, 2020, None)), replace=[2010, 2020, None])
    after = _files(folder)
    assert {f: after[f] for f in before} == before
    found = versions.read_version(spark, folder, "t")
    counts = {(r.YEAR, r.version): r["count"] for r in found.groupBy("YEAR", "version").count().collect()}
    assert counts == {(2000, 1): 40, (2010, 2): 40, (2020, 2): 40, (None, 2): 40}
    assert sum("YEAR=2000" in f for f in after) == sum("YEAR=2000" in f for f in before)
    _write(spark, folder, _table(spark, 3, years=()), replace=[2000])
    assert {r.YEAR for r in versions.read_version(spark, folder, "t").collect()} == {2010, 2020, None}
    with pytest.raises(ValueError, match="not to be replaced"):
        _write(spark, folder, _table(spark, 4, years=(2010, 2020)), replace=[2010])
    with pytest.raises(ValueError, match="other columns"):
        _write(spark, folder, _table(spark, 4, years=(2010,)).drop("name"), replace=[2010])


def test_old_and_unused_files_go(spark, tmp_path):
    folder = str(tmp_path)
    for version in range(5):
        _write(spark, folder, _table(spark, version))
    kept = {p.parts[-3] for p in Path(folder).rglob("*.parquet")}
    assert len(kept) == versions.KEEP_VERSIONS
    assert len(list((tmp_path / "_manifests").glob("*.json"))) == versions.KEEP_VERSIONS
    # A job that was killed after writing.
    lost = versions.Change(spark, folder)
    lost.write("t", _table(spark, 9))
    assert versions.remove_unused(spark, folder) == []
    (gone,) = versions.remove_unused(spark, folder, older_than_seconds=0)
    assert lost._version in gone
    assert _seen(spark, folder) == ({4}, 120)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 1, years=()))
    found = versions.read_version(spark, folder, "t")
    assert found.collect() == [] and found.columns == ["YEAR", "k", "version", "name"]


def test_changed_rows_are_reported(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder, _table(spark, 1), digest=versions.partition_digests())
    assert versions.changed_partitions(spark, folder, "t") == []
    # Swaps a value for another in one row of one partition, as a damaged or edited file would.
    place = next(p.parent for p in Path(folder).rglob("*.parquet") if "YEAR=2010" in str(p))
    rows = spark.read.parquet(str(place)).collect()
    edited = [(r.k, r.version, "edited" if r.k == 7 else r.name) for r in rows]
    for file in place.iterdir():
        file.unlink()
    spark.createDataFrame(edited, "k int, version int, name string").coalesce(1).write.mode("append").parquet(str(place))
    assert versions.changed_partitions(spark, folder, "t") == ["YEAR=2010"]
    # Digests of partitions that stay are kept, that of a replaced one is new.
    _write(spark, folder, _table(spark, 2, years=(2010,)), replace=[2010], digest=versions.partition_digests())
    assert versions.changed_partitions(spark, folder, "t") == []


def test_digest_knows_nulls_and_repeated_rows(spark):
    digest = versions.partition_digests()
    schema = "YEAR int, a string, b string"

    def of(*rows):
        return digest(spark.createDataFrame([(2000, *r) for r in rows], schema))[2000]

    assert of(("x", None), ("y", "z")) == of(("y", "z"), ("x", None))
    assert len({of(("x", None)), of((None, "x")), of(("x", None), ("x", None)), of(("x", ""))}) == 4


def test_years_of_all_stage_tables(spark, small, tmp_path):
    person, folder = fixture.person(spark, small), str(tmp_path)
    whole = build.build_tables(person, str(tmp_path / "whole"))
    build.build_tables(person.where("YEAR <> 2010"), folder, digests=True)
    before = _files(folder)
    done = build.replace_years(person, folder, [2010], digests=True)
    after = _files(folder)
    assert {f: after[f] for f in before} == before
    assert all("YEAR=2010" in f for f in set(after) - set(before))
    for name in build.STAGE_NAMES:
        assert spark_rows(getattr(done, name)) == spark_rows(getattr(whole, name))
        assert versions.changed_partitions(spark, folder, name) == []
    assert all(expected == actual for _, expected, actual in done.checks)


def test_a_failed_stage_leaves_all_tables_of_the_build_before(spark, small, tmp_path, monkeypatch):
    person, folder = fixture.person(spark, small), str(tmp_path)
    first = build.build_tables(person.where("YEAR < 2010"), folder)
    counts = [getattr(first, name).count() for name in build.STAGE_NAMES]
    real = build.join_household
    monkeypatch.setattr(build, "join_household", lambda *a: real(*a).where("SERIAL <> 7"))
    with pytest.raises(ValidationError):
        build.build_tables(person, folder)
    now = build.read_tables(spark, folder)
    assert [getattr(now, name).count() for name in build.STAGE_NAMES] == counts
    assert versions.remove_unused(spark, folder, older_than_seconds=0) == []
