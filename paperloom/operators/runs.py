"""Runs of text or rows: slicing, merging, trimming, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.flow import spare


def slice_by_starts(texts: DataFrame, starts: DataFrame, key: str, text: str, start: str, style: str) -> DataFrame:
    """The text between each start and the next, the first start moved to 0, empty slices left out: (key, run_no, style, slice).

    Starts, which are only numbers and styles, meet their text as one list; the
    text is cut in fixed-width characters, so that the cost is its length.
    """
    placed = starts.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("at"), F.col(style).alias("style")))).alias("starts"))
    met = texts.select(F.col(key).alias("key"), F.encode(F.col(text), "UTF-32").alias("text"), F.length(text).alias("length")).where("text is not null").join(placed, "key")
    runs = F.transform("starts", lambda s, k: F.struct(k.alias("run_no"), F.when(k == 0, 0).otherwise(s["at"]).cast("int").alias("from"), F.coalesce(F.get("starts", k + 1)["at"], F.col("length")).cast("int").alias("to"), s["style"].alias("style")))
    runs = F.filter(runs, lambda r: F.greatest(r["from"], F.lit(0)) < F.least(r["to"], F.col("length")))
    cut = met.select("key", "text", F.explode(runs).alias("r")).select("key", "r.run_no", "r.style", F.decode(F.substring(F.col("text"), F.col("r.from") * 4 + 1, (F.col("r.to") - F.col("r.from")) * 4), "UTF-32").alias("slice"))
    return cut.select(F.col("key").alias(key), "run_no", F.col("style").alias(style), "slice")


def numbered_runs(rows: DataFrame, key: str, order: list[str], style: list[str]) -> DataFrame:
    """rows with run_no from 0: neighbours of one style share a run; nulls equal nulls."""
    w = W.partitionBy(key).orderBy(*order)
    now = F.struct(*style)
    changed = F.when(F.row_number().over(w) == 1, 0).when(now.eqNullSafe(F.lag(now).over(w)), 0).otherwise(1)
    (name,) = spare(rows, "changed")
    return rows.withColumn(name, changed).withColumn("run_no", F.sum(name).over(w)).drop(name)


def longest_run(rows: DataFrame, key: str, order: list[str], style: str) -> DataFrame:
    """The longest run of each key, the first of equals: (key, style, length)."""
    runs = numbered_runs(rows, key, order, [style]).groupBy(key, "run_no", style).agg(F.count("*").alias("length"))
    return runs.groupBy(key).agg(F.max_by(F.struct(style, "length"), F.struct("length", -F.col("run_no"))).alias("longest run")).select(key, "`longest run`.*")


def trim_blank_ends(rows: DataFrame, key: str, order: str, blank: Column) -> DataFrame:
    """Without the blank rows before the first and after the last other one."""
    w = W.partitionBy(key)
    place = F.when(~blank, F.col(order))
    first, last = spare(rows, "first", "last")
    return rows.withColumns({first: F.min(place).over(w), last: F.max(place).over(w)}).where(F.col(order).between(F.col(first), F.col(last))).drop(first, last)


def list_markers(rows: DataFrame, key: str, order: str, level: str, depth: int) -> DataFrame:
    """rows with marker: the counters of the levels down to the row's own, joined by dots. A level's counter starts anew below a shallower row; one not begun shows nothing."""
    # all windows share one sort: a counter is how often its level came so far, less how often before the last shallower row
    w, same = W.partitionBy(key).orderBy(order), W.partitionBy(key, order)
    totals, counts = (spare(rows, *[f"{x}{k}" for k in range(depth)]) for x in ("total", "count"))
    of = lambda k: F.when(F.col(level) == k, 1).otherwise(0)
    rows = rows.withColumns({x: F.sum(of(k)).over(w) for k, x in enumerate(totals)}).withColumns({n: F.sum(of(k)).over(same) for k, n in enumerate(counts)})
    rows = rows.withColumns({n: F.col(x) - F.coalesce(F.max(F.when(F.col(level) < k, F.col(x) - F.col(n))).over(w), F.lit(0)) for k, (x, n) in enumerate(zip(totals, counts))})
    shown = [F.when(F.col(level) >= k, F.when(F.col(n) > 0, F.col(n).cast("string")).otherwise("")) for k, n in enumerate(counts)]
    return rows.withColumn("marker", F.concat_ws(".", *shown)).drop(*totals, *counts)
