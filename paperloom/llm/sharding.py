"""Sharding by a k-d tree over document metadata.

The tree's points are the distinct texts, weighted by the bytes of all their
rows, so rows of one text share a shard. Dimensions are the text's size, its
source and language (the smallest among its rows, placed by a hash) and the
place of its content hash. A node that has to make several shards is cut
along the dimension in which it is widest (against all points), at the weighted
quantile that gives each side its share of the bytes; points of one value are
cut by content hash, so only a single text's weight can unbalance a cut.

Quantiles come from histograms: each pass sums weights by node and bin in
Spark and narrows every node's interval, all nodes of a level at once. A
pass brings nodes x BINS sums to the driver, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.store import save

BINS = 512
#: Rows of a slot bucket.
BUCKET = 50_000
DIMS = ("d_size", "d_source", "d_lang", "d_content")


def _spot(c: Column) -> Column:
    """A place from 0 to 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(c), 11) / F.lit(float(1 << 53))


def _cuts(points: DataFrame, goal: dict[int, float], value: dict[int, Column], span: dict[int, tuple[float, float]], within: dict[int, Column]) -> dict[int, tuple[float, float, float]]:
    """For each node the value at which its running weight passes goal, with the weight below that value and at it."""
    done: dict[int, tuple[float, float, float]] = {}
    below = dict.fromkeys(goal, 0.0)
    span = dict(span)
    while len(done) < len(goal):
        todo = [n for n in goal if n not in done]
        v, lo, hi, ok = F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(False)
        for n in todo:
            at = F.col("node") == n
            v, lo, hi, ok = F.when(at, value[n]).otherwise(v), F.when(at, F.lit(span[n][0])).otherwise(lo), F.when(at, F.lit(span[n][1])).otherwise(hi), F.when(at, within[n] & value[n].between(*map(F.lit, span[n]))).otherwise(ok)
        bin_ = F.when(hi > lo, F.least(F.lit(BINS - 1), F.floor((v - lo) / (hi - lo) * BINS))).otherwise(F.lit(0))
        sums = points.where(ok).groupBy("node", bin_.alias("bin")).agg(F.sum("weight").alias("w"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for n in todo:
            run = below[n]
            mine = sorted((r for r in sums if r["node"] == n), key=lambda r: r["bin"])
            for k, r in enumerate(mine):
                if run + r["w"] >= goal[n] or k == len(mine) - 1:
                    below[n] = run
                    if r["low"] == r["high"]:
                        done[n] = (r["low"], run, float(r["w"]))
                    span[n] = (r["low"], r["high"])
                    break
                run += r["w"]
            if not mine:
                done[n] = (span[n][1], run, 0.0)
    return done


def kd_shards(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty, a null
    source, language or missing column as one value. Equal texts share a
    shard, repeated rows and rows that share a doc_id included, each with a slot
    of its own. slot numbers the rows of a shard from 0 without gaps. An empty
    table gives an empty one; other columns are ignored, whatever their names.
    """
    columns = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("key"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()])
    rows = save(rows, "rows")
    groups = rows.groupBy("key", "size", "crc").agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    points = groups.select("key", "size", "crc", "weight", F.log2("size").alias("d_size"), _spot(F.col("source")).alias("d_source"), _spot(F.col("lang")).alias("d_lang"), _spot(F.col("key")).alias("d_content"))
    points = save(points, "points")

    tree: dict[int, tuple[str, float, float]] = {}  # node -> dimension, value, content cut among points of that value
    wanted = {1: (0, shards)}  # node -> its first shard and how many
    every = None
    while any(s > 1 for _, s in wanted.values()):
        level = [n for n, (_, s) in wanted.items() if s > 1]
        placed = points.withColumn("node", _walk(tree, 1, wanted))
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(d).alias(f"{d}_{f.__name__}") for d in DIMS for f in (F.min, F.max)]).collect()}
        if not stats:
            break
        every = every or {d: max(r[f"{d}_max"] for r in stats.values()) - min(r[f"{d}_min"] for r in stats.values()) for d in DIMS}
        goal, dim, span = {}, {}, {}
        for n in level:
            _, s = wanted[n]
            if n not in stats:
                tree[n] = ("d_size", 0.0, 0.0)
                continue
            width = {d: (stats[n][f"{d}_max"] - stats[n][f"{d}_min"]) / every[d] if every[d] else 0.0 for d in DIMS}
            dim[n] = max(DIMS, key=lambda d: width[d])
            span[n] = (stats[n][f"{dim[n]}_min"], stats[n][f"{dim[n]}_max"])
            goal[n] = stats[n]["weight"] * (s // 2) / s
        one = {n: F.lit(True) for n in goal}
        cut = _cuts(placed, goal, {n: F.col(dim[n]) for n in goal}, span, one)
        rest = {n: goal[n] - cut[n][1] for n in goal}
        inner = _cuts(placed, rest, {n: F.col("d_content") for n in goal}, {n: (0.0, 1.0) for n in goal}, {n: F.col(dim[n]) == F.lit(cut[n][0]) for n in goal})
        for n in goal:
            value, under, own = inner[n]
            # the text at the cut goes where it leaves less of a difference
            tree[n] = (dim[n], cut[n][0], value if under + own / 2 <= rest[n] else value - 2.0**-53)
        for n in level:
            first, s = wanted.pop(n)
            wanted[2 * n], wanted[2 * n + 1] = (first, s // 2), (first + s // 2, s - s // 2)
    shard = F.lit(0)
    for n, (first, _) in wanted.items():
        shard = F.when(F.col("node") == n, F.lit(first)).otherwise(shard)
    owned = points.withColumn("node", _walk(tree, 1, wanted)).select("key", "size", "crc", shard.cast("int").alias("shard"))
    placed = save(rows.select("doc_id", "size", "crc", "key").join(owned, ["key", "size", "crc"]), "placed")
    buckets = max(1, -(-placed.count() // BUCKET))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    before = placed.groupBy("shard", "bucket").count()
    before = before.withColumn("before", F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).drop("count")
    numbered = placed.withColumn("n", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "key", "crc")))
    out = numbered.join(before, ["shard", "bucket"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.coalesce("before", F.lit(0)) + F.col("n") - 1).cast("long").alias("slot"))


def _walk(tree: dict[int, tuple[str, float, float]], node: int, wanted: dict) -> Column:
    """The node in which a point ends so far."""
    if node not in tree:
        return F.lit(node)
    dim, value, content = tree[node]
    left = (F.col(dim) < F.lit(value)) | ((F.col(dim) == F.lit(value)) & (F.col("d_content") <= F.lit(content)))
    return F.when(left, _walk(tree, 2 * node, wanted)).otherwise(_walk(tree, 2 * node + 1, wanted))
