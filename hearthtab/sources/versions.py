"""Stage tables by version: a manifest, written last, says which directories make up each table.

A folder holds one or several tables. Rows are written below ``<table>/stage_version=<id>/<partition>/`` and
never changed. A change of any number of tables becomes visible in one step, when its manifest
``_manifests/<number>.json`` has been written; the manifest with the highest number counts. A manifest is
created only if its number is free, ends with a checksum, and is ignored if that does not fit: a job that is
killed at any moment leaves the version before as it was, and a reader sees the whole of one version.
Nothing is renamed, which on object stores would be a copy.

The files of the latest ``KEEP_VERSIONS`` versions are kept, so that queries planned on the version before
can end. Directories that a killed job left behind are removed by ``remove_unused``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION_COLUMN = "stage_version"
KEEP_VERSIONS = 2
_MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Buckets:
    """Rows of a table dealt over ``number`` buckets by ``column``, which is in the files but not in the table.

    The rows are to lie by ``column`` already, or each task writes a file for every bucket.
    """

    column: str
    number: int


class ConcurrentWriteError(RuntimeError):
    """Another job changed the tables in the meantime."""


@dataclass(frozen=True)
class TableVersion:
    """``directories``: partition directory (such as ``YEAR=2000``) to the version that wrote it."""

    schema: dict
    partition_by: str
    directories: dict[str, str]
    # Partition directory to content digest, where one was asked for.
    digests: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    number: int
    tables: dict[str, TableVersion]


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    return [status.getPath().getName() for status in files.listStatus(place)]


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def _read_text(spark: SparkSession, path: str) -> str:
    files, place = _place(spark, path)
    stream = files.open(place)
    try:
        scanner = spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
        return scanner.next() if scanner.hasNext() else ""
    finally:
        stream.close()


def _create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; ``ConcurrentWriteError`` if there is one."""
    files, place = _place(spark, path)
    try:
        stream = files.create(place, False)
    except Py4JJavaError as error:
        if files.exists(place):
            raise ConcurrentWriteError(f"{path} has been written by another job") from error
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _encoded(tables: dict[str, TableVersion]) -> str:
    text = json.dumps({name: vars(table) for name, table in tables.items()}, sort_keys=True)
    return f"{text}\n{zlib.crc32(text.encode()):08x}"


def _decoded(text: str) -> dict[str, TableVersion] | None:
    body, _, checksum = text.rpartition("\n")
    if checksum != f"{zlib.crc32(body.encode()):08x}":
        return None
    return {name: TableVersion(**table) for name, table in json.loads(body).items()}


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    names = _names(spark, f"{folder}/{_MANIFESTS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest_path(folder: str, number: int) -> str:
    return f"{folder}/{_MANIFESTS}/{number:012d}.json"


def _manifest(spark: SparkSession, folder: str, number: int) -> Manifest | None:
    try:
        tables = _decoded(_read_text(spark, _manifest_path(folder, number)))
    except Py4JJavaError:
        # Removed since it was listed: newer ones are there.
        return None
    return None if tables is None else Manifest(number, tables)


def current_manifest(spark: SparkSession, folder: str) -> Manifest | None:
    """The latest whole version, or None if there is none yet."""
    while True:
        numbers = _numbers(spark, folder)
        for number in reversed(numbers):
            found = _manifest(spark, folder, number)
            if found is not None:
                return found
        if _numbers(spark, folder) == numbers:
            return None


def _table_folder(folder: str, name: str) -> str:
    return f"{folder}/{name}" if name else folder


def _version_folder(folder: str, name: str, version: str) -> str:
    return f"{_table_folder(folder, name)}/{VERSION_COLUMN}={version}"


def _read(spark: SparkSession, folder: str, name: str, table: TableVersion) -> DataFrame:
    schema = T.StructType.fromJson(table.schema)
    if not table.directories:
        return spark.createDataFrame([], schema)
    places = [
        f"{_version_folder(folder, name, version)}/{partition}"
        for partition, version in sorted(table.directories.items())
    ]
    rows = (
        spark.read.schema(schema.add(VERSION_COLUMN, T.StringType()))
        .option("basePath", _table_folder(folder, name))
        .parquet(*places)
    )
    return rows.select(*T.StructType.fromJson(table.schema).names)


def read_version(
    spark: SparkSession, folder: str, name: str = "", manifest: Manifest | None = None
) -> DataFrame:
    """A table as of ``manifest``, by default as it is now. Later changes do not alter the result."""
    found = manifest or current_manifest(spark, folder)
    if found is None or name not in found.tables:
        raise FileNotFoundError(f"no table {name!r} in {folder}")
    return _read(spark, folder, name, found.tables[name])


class Change:
    """A change of tables in a folder; nothing of it is seen before ``commit``.

    As a context manager it commits at the end, or removes what it wrote if there was an error.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder
        self._before = current_manifest(spark, folder)
        self._tables = dict(self._before.tables) if self._before else {}
        numbers = _numbers(spark, folder)
        self._number = (numbers[-1] if numbers else 0) + 1
        self._version = f"{self._number:012d}-{uuid.uuid4().hex[:12]}"
        self._written: set[str] = set()
        # Table to its name in the session's catalog, which is where Spark looks buckets up.
        self._catalog: dict[str, str] = {}

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._forget_buckets()
        if kind is None:
            self.commit()
        else:
            self.abort()

    def write(
        self,
        name: str,
        data: DataFrame,
        partition_by: str = "YEAR",
        cluster_by: Sequence[str] = (),
        check: Callable[[DataFrame], None] | None = None,
        replace: Sequence[object] | None = None,
        digest: Callable[[DataFrame], dict[object, str]] | None = None,
        buckets: Buckets | None = None,
        gathered: bool = False,
    ) -> DataFrame:
        """Write rows aside and return them as read back.

        Without ``replace`` they become the whole table. Otherwise ``data`` has rows of these partition
        values only; they take the place of the partitions of these values and all others stay as they
        are, without being read or written. ``digest`` gives a digest per partition value. With ``buckets``
        the rows can be read by bucket until the change ends (``bucketed``). Rows that are ``gathered`` are
        written where they are.
        """
        spark = self._spark
        if name in self._written:
            raise ValueError(f"table {name!r} has been written in this change")
        columns = [c for c in data.columns if buckets is None or c != buckets.column]
        schema = json.loads(data.select(*columns).schema.json())
        before = self._tables.get(name)
        if replace is not None and before is not None and not _same_columns(before.schema, schema):
            raise ValueError(f"the rows of table {name!r} have other columns than the table")
        place = _version_folder(self._folder, name, self._version)
        self._written.add(name)
        if buckets is None:
            # Rebalancing gathers each partition into few files; adaptive execution splits large ones.
            laid = data if gathered else data.hint("rebalance", partition_by)
            if cluster_by:
                laid = laid.sortWithinPartitions(partition_by, *cluster_by)
            laid.write.partitionBy(partition_by).parquet(place)
        else:
            self._write_buckets(name, data, partition_by, cluster_by, buckets, place)
        found = [n for n in _names(spark, place) if n.startswith(f"{partition_by}=")]
        directories = dict.fromkeys(found, self._version)
        rows = _read(spark, self._folder, name, TableVersion(schema, partition_by, directories))
        if replace is not None:
            expected = {_directory(partition_by, value) for value in replace}
            if not expected.issuperset(found):
                raise ValueError(f"rows of {sorted(set(found) - expected)} are not to be replaced")
        if check is not None:
            check(rows)
        digests = {}
        if digest is not None:
            digests = {_directory(partition_by, value): text for value, text in digest(rows).items()}
        if replace is not None and before is not None:
            stay = {d: v for d, v in before.directories.items() if d not in expected}
            directories = stay | directories
            digests = {d: t for d, t in before.digests.items() if d in stay} | digests
        self._tables[name] = TableVersion(schema, partition_by, directories, digests)
        return rows

    def _write_buckets(
        self,
        name: str,
        data: DataFrame,
        partition_by: str,
        cluster_by: Sequence[str],
        buckets: Buckets,
        place: str,
    ) -> None:
        self._catalog[name] = f"hearthtab_{uuid.uuid4().hex}"
        writer = data.write.partitionBy(partition_by).bucketBy(buckets.number, buckets.column)
        if cluster_by:
            writer = writer.sortBy(*cluster_by)
        writer.option("path", place).format("parquet").saveAsTable(self._catalog[name])

    def bucketed(self, name: str) -> DataFrame:
        """What this change wrote into a table with buckets, the bucket column included, read by bucket."""
        return self._spark.table(self._catalog[name])

    def _forget_buckets(self) -> None:
        """Take the tables from the catalog; their files are not the catalog's and stay."""
        while self._catalog:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._catalog.popitem()[1]}")

    def commit(self) -> Manifest:
        """Make the change visible, then remove what no kept version needs."""
        numbers = _numbers(self._spark, self._folder)
        if numbers and numbers[-1] >= self._number:
            raise ConcurrentWriteError(f"{self._folder} has been changed by another job")
        _create_text(self._spark, _manifest_path(self._folder, self._number), _encoded(self._tables))
        _forget_old(self._spark, self._folder, self._number)
        return Manifest(self._number, self._tables)

    def abort(self) -> None:
        for name in self._written:
            _remove(self._spark, _version_folder(self._folder, name, self._version))


def _same_columns(one: dict, two: dict) -> bool:
    def columns(schema: dict) -> list:
        return [(f["name"], json.dumps(f["type"])) for f in schema["fields"]]

    return columns(one) == columns(two)


def _directory(partition_by: str, value: object) -> str:
    return f"{partition_by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"


def _used(folder: str, manifests: Sequence[Manifest]) -> set[str]:
    return {
        _version_folder(folder, name, version)
        for manifest in manifests
        for name, table in manifest.tables.items()
        for version in table.directories.values()
    }


def _forget_old(spark: SparkSession, folder: str, newest: int) -> None:
    """Remove manifests before the kept ones, and version directories only those refer to."""
    numbers = [n for n in _numbers(spark, folder) if n <= newest]
    whole = [m for m in (_manifest(spark, folder, n) for n in numbers) if m is not None]
    kept, old = whole[-KEEP_VERSIONS:], whole[:-KEEP_VERSIONS]
    # Manifests first: a reader must not find one whose files are gone.
    for manifest in old:
        _remove(spark, _manifest_path(folder, manifest.number))
    for path in _used(folder, old) - _used(folder, kept):
        _remove(spark, path)


def remove_unused(spark: SparkSession, folder: str, older_than_seconds: float = 86_400) -> list[str]:
    """Remove version directories that no manifest refers to, such as those of killed jobs.

    Younger ones may belong to a running job and stay. Returns what was removed.
    """
    manifests = [m for m in (_manifest(spark, folder, n) for n in _numbers(spark, folder)) if m]
    names = {name for m in manifests for name in m.tables} | {""}
    # Tables of a first job that never committed are not in any manifest.
    names |= {n for n in _names(spark, folder) if "=" not in n and not n.startswith("_")}
    used = _used(folder, manifests)
    now = spark._jvm.java.lang.System.currentTimeMillis()
    gone = []
    for name in names:
        for child in _names(spark, _table_folder(folder, name)):
            path = f"{_table_folder(folder, name)}/{child}"
            if not child.startswith(f"{VERSION_COLUMN}=") or path in used:
                continue
            files, place = _place(spark, path)
            if now - files.getFileStatus(place).getModificationTime() >= older_than_seconds * 1000:
                _remove(spark, path)
                gone.append(path)
    return sorted(gone)


def partition_digests(columns: Sequence[str] | None = None, partition_by: str = "YEAR"):
    """A function for ``Change.write``: a digest of each partition's rows that no order changes.

    Two sums of 64-bit hashes over all columns, and the number of rows: a changed, lost or repeated
    row changes the digest.
    """

    def digest(rows: DataFrame) -> dict[object, str]:
        names = list(columns or sorted(c for c in rows.columns if c != partition_by))
        hashes = [F.xxhash64(F.lit(seed), *[_marked(name) for name in names]) for seed in (1, 2)]
        sums = rows.groupBy(partition_by).agg(
            *[F.sum(h.cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k, h in enumerate(hashes)],
            F.count(F.lit(1)).alias("n"),
        )
        # One row per partition.
        return {row[0]: f"{row.h0}:{row.h1}:{row.n}" for row in sums.collect()}

    return digest


def _marked(name: str):
    """A column and whether it is null, as hashes leave nulls out."""
    return F.struct(F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))


def changed_partitions(
    spark: SparkSession, folder: str, name: str = "", manifest: Manifest | None = None
) -> list[str]:
    """Partitions whose rows do not have the digest that was written with them."""
    found = manifest or current_manifest(spark, folder)
    if found is None or name not in found.tables:
        raise FileNotFoundError(f"no table {name!r} in {folder}")
    table = found.tables[name]
    now = partition_digests(partition_by=table.partition_by)(_read(spark, folder, name, table))
    actual = {_directory(table.partition_by, value): text for value, text in now.items()}
    return sorted(d for d, text in table.digests.items() if actual.get(d) != text)
