"""Readers and writers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files of a folder, contents unread; nothing for a folder without such files."""
    found = files(spark, path, pattern)
    bare = F.regexp_replace("path", "^file:/+", "/")
    return found.select(bare.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def json_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of whole-file JSON reports, with unreadable files kept as a text column."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def required_json(spark: SparkSession, path: str, schema: str, label: str) -> DataFrame:
    """Rows of JSON reports that must be there: a path without files raises at once, one that can't be read when it is met."""
    rows, error = optional_json(spark, path, schema, label)
    if error:
        raise FileNotFoundError(error)
    bad = F.concat(F.lit(f"{label} could not be parsed: "), F.substring("_corrupt", 1, 200))
    return rows.where(F.when(F.col("_corrupt").isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).drop("_corrupt")


def optional_json(spark: SparkSession, path: str, schema: str, label: str) -> tuple[DataFrame, str]:
    """Rows of JSON reports, unreadable ones in the text column _corrupt, and what is wrong with the path (nothing, or that it has no files)."""
    try:
        return json_reports(spark, path, schema), ""
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], f"{schema}, _corrupt STRING")
        return empty, f"{label} not found: {path}"


def documents(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, name, length) of the files of a folder with one of the extensions, in the order of Korean dictionaries."""
    from paperloom.operators.reports import korean_order

    wanted = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(extensions)
    return listing(spark, path).where(wanted).orderBy(*korean_order(F.col("path")))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, line: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(line).alias("value")).write.mode(mode).text(path)


#: File signatures in hexadecimal, first fit wins.
SIGNATURES = [("D0CF11E0A1B11AE1", "compound"), ("504B0304", "zip"), ("504B0506", "zip"), ("504B0708", "zip"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("25504446", "pdf")]


def container_format(content: Column, path: Column) -> Column:
    """By signature, then as XML by its first visible byte, then by extension; empty if unknown."""
    head = F.hex(F.substring(content.cast("binary"), 1, 8))
    found = [F.when(F.startswith(head, F.lit(sign)), name) for sign, name in SIGNATURES]
    xml = F.when(F.regexp_like(F.decode(F.substring(content.cast("binary"), 1, 64), "ISO-8859-1"), F.lit("^(ï»¿)?[\t\n\r ]*<")), "xml")
    by_name = F.when(F.contains(path, F.lit(".")), F.lower(F.element_at(F.split(path, r"\."), -1)))
    return F.coalesce(*found, xml, by_name, F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder; below a temporary one, then the session's setting, where none is set and all runs in this process, as in tests."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/paperloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own in the shared folder and read again: later plans start from files that outlive any executor."""
    to = scratch(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
