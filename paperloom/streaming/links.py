"""Links observed on arriving pages, and a keyed list of the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as t


def page_stream(spark: SparkSession, sf_dir: str, name: str = "pages", files_a_batch: int = 8) -> DataFrame:
    """A table's files as they arrive; the table is one file or a folder of them.

    The name is written as a pattern, as a stream takes a plain path for a
    folder's; partitions are found below the folder of tables.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("basePath", sf_dir).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def observe(pages: DataFrame) -> DataFrame:
    """Each link of a page once. A page's links are in its own row, so the stream keeps no state."""
    return pages.select("page_id", F.explode(F.array_distinct(t.hrefs(F.col("html")))).alias("href"))


def run_to_files(stream: DataFrame, to: str) -> DataFrame:
    """Runs what is there into Parquet files and reads them."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{to}-state").trigger(availableNow=True).start(to).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(to)


LATEST = "href string, page_id long, pos long, first_seen struct<page_id: long, pos: long>"


def keep_latest(stream: DataFrame, to: str, limit: int = 100) -> DataFrame:
    """The list of the latest links: by href the last page wins, the newest `limit` stay, those of one page in the order in which they first came.

    The stream's state holds every href seen, since one that fell off the list may
    come again and keeps its first place. Batch n writes version n of the list, so a batch that runs
    again gives the same version, and a query that starts again from its
    checkpoint goes on with the state it had. Version -1 is the list before any batch.
    """
    spark = stream.sparkSession
    place = F.struct("page_id", F.col("pos").cast("long").alias("pos")).alias("place")
    found = stream.select("page_id", F.posexplode(t.hrefs(F.col("html"))).alias("pos", "href")).select("href", place)
    seen = found.groupBy("href").agg(F.max("place").alias("last"), F.min("place").alias("first_seen"))

    def write(every: DataFrame, number: int) -> None:
        kept = every.select("href", "last.*", "first_seen").orderBy(F.desc("page_id"), "first_seen").limit(limit)
        kept.write.mode("overwrite").parquet(f"{to}/version={number}")

    spark.createDataFrame([], LATEST).write.mode("overwrite").parquet(f"{to}/version=-1")
    seen.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{to}-state").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(f"{LATEST}, version int").parquet(to)
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(newest)).drop("version")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of a user's events no further apart than gap, with the last event of each; the same for streams with a watermark on ts."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
