"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set (tests on one machine), a temporary folder that then becomes the setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"


#: Folders that this process has written and not dropped.
_written: list[str] = []


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table and reads it: later plans start from files that outlive any executor."""
    to = path(df.sparkSession, name)
    _written.append(to)
    df.write.options(**options).parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def drop(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(folder)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Gives a save that also tells its folder, which stays; what else is saved inside goes at the end. Nothing lazy may be left of it by then."""
    before, stay = len(_written), set()

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        out = save(df, name)
        stay.add(_written[-1])
        return out, _written[-1]

    yield keep
    for folder in [f for f in _written[before:] if f not in stay]:
        drop(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
