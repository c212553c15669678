"""Session settings shared by the tests, the bench and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hearthtab.sources.shipping import ship_package


def build_session(
    app_name: str = "hearthtab",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Session with adaptive execution on, and this package on its executors.

    ``shuffle_partitions`` is the number of partitions before adaptive execution
    merges small ones: leave it at two to three times the cluster's cores and
    let Spark shrink it, or pass a small number for local runs.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Hash instead of sort where every partition of one side turns out small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({key.replace("__", "."): value for key, value in conf.items()})

    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session
