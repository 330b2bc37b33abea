"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are whole numbers. Queries are dealt into blocks and candidates into
shards, both of bounded size; each block meets each shard. In a shard
dimensions go by falling energy and are cut into slices.

1. Every shard gives each query the exact scores of the k entries that are best
   by the first slice alone. The k-th best of all shards' lists is a cutoff, one
   for all shards, that no result is below.
2. The cutoff goes back to the shards with the queries. Slice by slice they
   drop the entries whose sum so far and the norms of what is left can't reach
   it; only the others' products go on.
3. What has come through all slices has its exact score; what reaches the
   cutoff is collected and ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.store import save

#: Queries of a block, and candidates of a shard at most and, where there are few, at least; slices.
QUERIES, SHARD, LEAST, SLICES = 16_384, 65_536, 4096, 4
#: Queries worked on at once.
ROWS = 128


def _numbers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(q: np.ndarray, x: np.ndarray):
    """The fastest type in which all sums are exact."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def _slices(q: np.ndarray, x: np.ndarray):
    """q and x with their dimensions by falling energy, where slices begin, and the norms of what is left from there."""
    by = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    q, x, d = q[:, by], x[:, by], q.shape[1]
    cuts = sorted({d * s // SLICES for s in range(SLICES + 1)})
    norms = [[np.sqrt((y[:, c:].astype(np.float64) ** 2).sum(1)) for c in cuts] for y in (q, x)]
    return q, x, cuts, *norms


def _long(values) -> np.ndarray:
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in values], np.int64) if getattr(values, "dtype", None) == object else np.asarray(values).astype(np.int64)


def _blocks(table: pa.Table):
    """Ids and vectors of a group's queries, its candidates, and the queries' cutoffs."""
    asks = table["ask"].to_numpy().astype(bool)
    ids, x = table["vec_id"].to_numpy(), _numbers(table["x"])
    kind = _kind(x[asks], x[~asks])
    x = x.astype(kind) if kind is not object else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    cut = table["cutoff"].to_pylist() if "cutoff" in table.column_names else None
    by = np.argsort(ids[~asks], kind="stable")
    return ids[asks], x[asks], ids[~asks][by], x[~asks][by], [c for c, a in zip(cut, asks) if a] if cut else None


def _local(k: int):
    def run(table: pa.Table) -> pa.Table:
        qid, q, vid, x, _ = _blocks(table)
        q, x, cuts, _, _ = _slices(q, x)
        best = []
        for lo in range(0, len(qid), ROWS):
            if not len(vid):
                best += [[]] * len(qid[lo : lo + ROWS])
                continue
            lead = q[lo : lo + ROWS, : cuts[1]] @ x[:, : cuts[1]].T
            own = qid[lo : lo + ROWS, None] == vid[None, :]
            few = np.argpartition(-lead, k, axis=1)[:, : k + 1] if len(vid) > k + 1 else np.broadcast_to(np.arange(len(vid)), lead.shape)
            for r, j in enumerate(few):
                j = j[~own[r, j]]
                best.append(np.sort(_long(x[j] @ q[lo + r]))[::-1][:k].tolist())
        return pa.table({"query_id": pa.array(qid, pa.int64()), "best": pa.array(best, pa.list_(pa.int64()))})

    return run


def above(q: np.ndarray, x: np.ndarray, least: np.ndarray, sliced) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of q and of x whose product reaches least, their products, and how many numbers were multiplied for it."""
    cuts, left_q, left_x = sliced

    def reaches(sums, room, least):
        return sums.astype(np.float64) + room * (1 + 1e-9) + 1e-9 * np.abs(sums.astype(np.float64)) >= least

    lead = q[:, : cuts[1]] @ x[:, : cuts[1]].T
    work = lead.size * cuts[1]
    i, j = np.nonzero(reaches(lead, np.outer(left_q[1], left_x[1]), least[:, None]))
    part = lead[i, j]
    for c, (a, b) in enumerate(zip(cuts[1:], cuts[2:]), 2):
        if 4 * len(i) > lead.size:
            part = part + (q[:, a:b] @ x[:, a:b].T)[i, j]
            work += lead.size * (b - a)
        else:
            part = part + (q[i, a:b] * x[j, a:b]).sum(1)
            work += len(i) * (b - a)
        keep = reaches(part, left_q[c][i] * left_x[c][j], least[i])
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, part, work


def _above(k: int):
    def run(table: pa.Table) -> pa.Table:
        qid, q, vid, x, cut = _blocks(table)
        q, x, cuts, left_q, left_x = _slices(q, x)
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(qid) if len(vid) else 0, ROWS):
            rows = slice(lo, lo + ROWS)
            least = np.array([-np.inf if c is None else c for c in cut[rows]])
            i, j, score, _ = above(q[rows], x, least, (cuts, [n[rows] for n in left_q], left_x))
            keep = (score >= least[i]) & (qid[lo + i] != vid[j])
            i, j, score = i[keep], j[keep], _long(score[keep])
            by = np.lexsort((vid[j], -score, i))
            i, j, score = i[by], j[by], score[by]
            first = np.searchsorted(i, np.arange(len(least)))
            keep = np.arange(len(i)) - first[i] < k
            out_q.append(qid[lo + i[keep]])
            out_v.append(vid[j[keep]])
            out_s.append(score[keep])
        join = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
        return pa.table({"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k highest scores, all if there are fewer, ties to the smaller vec_id.

    is_query is a condition on vec_id. Components become floor(scale * x).
    Null vec_ids and vectors that are null, empty or hold null or non-finite
    components take no part; vectors of different lengths don't meet. A
    query's own vec_id is no candidate. Of rows that share a vec_id the one
    with the smallest vector is the query, all are candidates. Scores beyond
    64 bits become the nearest long.
    """
    good = F.expr("coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col("vec_id").isNotNull() & good)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("x"))
    rows = save(rows.withColumn("d", F.size("x")), "whole")
    asks = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("d", F.size("x"))
    asks = save(asks, "queries")
    many, cores = rows.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(1, -(-many // SHARD), min(cores, -(-many // LEAST))), max(1, -(-asks.count() // QUERIES))

    def grid(queries: DataFrame):
        ask = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).withColumn("ask", F.lit(1))
        give = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).withColumn("ask", F.lit(0))
        return ask.unionByName(give, allowMissingColumns=True).groupBy("d", "block", "shard")

    local = grid(asks).applyInArrow(_local(k), "query_id long, best array<long>")
    cutoff = local.groupBy("query_id").agg(F.flatten(F.collect_list("best")).alias("best")).select(F.col("query_id").alias("vec_id"), F.try_element_at(F.reverse(F.array_sort("best")), F.lit(k)).alias("cutoff"))
    cutoff = save(cutoff, "cutoffs")
    found = grid(asks.join(cutoff, "vec_id", "left")).applyInArrow(_above(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
