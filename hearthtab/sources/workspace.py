"""Where jobs put tables that other tasks must be able to read."""

from __future__ import annotations

import atexit
import uuid
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The setting ``spark.checkpoint.dir`` comes first, then a folder given to
    ``SparkContext.setCheckpointDir``, then a folder in the session's warehouse,
    which a cluster shares as well. A ``file:`` folder is taken as it is: it may be
    a mounted network disk, which cannot be told from here.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if not folder:
        folder = f"{spark.conf.get(WAREHOUSE_SETTING).rstrip('/')}/_shared"
    return folder.rstrip("/")


def new_location(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses.

    What is written there serves this session: it is removed when the driver's process ends, or
    before that by ``remove_locations``.
    """
    path = f"{shared_folder(spark)}/hearthtab/{name}-{uuid.uuid4().hex}"
    if not _given:
        atexit.register(remove_locations)
    _given.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


# Gateway, configuration and path of every location given out.
_given: list[tuple[Any, Any, str]] = []


def remove_locations() -> None:
    """Remove all locations given out so far. Results that are read from them cannot be computed after that."""
    atexit.unregister(remove_locations)
    while _given:
        jvm, configuration, path = _given.pop()
        try:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)
        except (Py4JError, OSError):
            # The process's own Java side has ended already: nothing can be removed from here.
            _given.clear()
