"""Sending this package to the executors of a session."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import hearthtab

_SENT: set[str] = set()


def package_zip() -> bytes:
    """The package's Python files as a zip with fixed times: equal content, equal bytes."""
    root = Path(hearthtab.__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            name = str(Path(root.name) / path.relative_to(root))
            archive.writestr(zipfile.ZipInfo(name), path.read_bytes())
    return data.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``import hearthtab`` work in the session's Python workers.

    Functions that run in tasks are sent by name. A cluster's workers need not have the package
    installed: it is added to the session's files once, which the scheduler gives to every
    executor, also to those that join later.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    # Spark copies added files to its own file server; the driver's spool folder only holds it until then.
    folder = Path(context._temp_dir)
    path = folder / "hearthtab-package.zip"
    path.write_bytes(package_zip())
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)
