"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package, as spark-submit --py-files would; once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="spark-")) / root.name
        sc.addPyFile(shutil.make_archive(str(to), "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)
    return spark
