"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors link when they have one label and their cosine reaches the threshold.
Equal vectors of a label are one class from the start. Unit vectors are turned
onto the principal axes of all vectors, so that a few leading dimensions hold
most of a product. Linked vectors lie within sqrt(2 - 2 threshold) on the
first axis: labels are cut along it into strips, strips into tiles of bounded
size, and only tiles of one strip or of neighbours meet. Within a pair of
tiles leading dimensions are multiplied first; what the rest can add is at
most the product of the suffix norms, and a pair is dropped as soon as even
that leaves it below the threshold.

A tile pair returns sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.graph import components, forest
from paperloom.llm.store import save

TILE = 1024
#: Leading dimensions after which bounds are looked at.
STOPS = (8, 16, 32)
#: Pairs worked on at once, and the rounding that bounds leave room for.
PAIRS, SLACK = 1 << 16, 1e-9


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, x in _matrices(batch.column(0)):
            x = x / np.sqrt((x * x).sum(1))[:, None]
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["d", "m"])


def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[d] = sums.get(d, 0) + np.frombuffer(m).reshape(d, d)
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["d", "m"])


def matrix(column) -> np.ndarray:
    """A list column of rows of one length as a matrix of doubles, each row scaled to a largest component from 1/2 to 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # by a power of two, which rounds nothing, so that squares neither overflow nor vanish
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _matrices(column) -> Iterator[tuple[int, np.ndarray]]:
    size = np.diff(column.offsets.to_numpy())
    for d in np.unique(size):
        yield int(d), matrix(column.filter(pa.array(size == d)))


def _leading(axes):
    """Appends each vector's place on the first axis."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index("embedding"))
            size = np.diff(column.offsets.to_numpy())
            out = np.zeros(len(size))
            for d, x in _matrices(column):
                out[size == d] = (x @ axes.value[d][:, 0]) / np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "lead"])

    return run


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) whose cosine reaches threshold; with same only those with row of a < row of b."""

    def turned(x):
        y = (x / np.sqrt((x * x).sum(1))[:, None]) @ axes
        rest = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], 0))
        return y, np.column_stack((rest, np.zeros(len(y))))

    (ya, ra), (yb, rb) = turned(a), turned(b)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    d = ya.shape[1]
    stops = [s for s in STOPS if s < d] + [d]
    k = stops[0]
    head = ya[:, :k] @ yb[:, :k].T
    live = head + np.outer(ra[:, k], rb[:, k]) >= threshold - SLACK
    if same:
        live = np.triu(live, 1)
    every_i, every_j = np.nonzero(live)
    for lo in range(0, len(every_i), PAIRS):
        i, j = every_i[lo : lo + PAIRS], every_j[lo : lo + PAIRS]
        part = head[i, j]
        for before, k in zip(stops, stops[1:]):
            part = part + np.einsum("pd,pd->p", ya[i, before:k], yb[j, before:k])
            keep = part + ra[i, k] * rb[j, k] >= threshold - SLACK
            i, j, part = i[keep], j[keep], part[keep]
        if len(i):
            keep = np.einsum("pd,pd->p", a[i], b[j]) / (na[i] * nb[j]) >= threshold
            yield i[keep], j[keep]


def _compare(axes, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side, node, times = (table[c].to_numpy() for c in ("side", "node", "times"))
        x = matrix(table["embedding"])
        same = not (side == 1).any() and bool(table["alone"][0].as_py())
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links, found = np.zeros(len(node), np.int64), []
        if len(left) and len(right):
            for i, j in linked_pairs(x[left], x[right], axes.value[x.shape[1]], threshold, same):
                i, j = left[i], right[j]
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                label = forest(len(node), i, j)
                tree = np.flatnonzero(label != np.arange(len(node)))
                found.append((tree, label[tree]))
        at = np.flatnonzero(links)
        tree, top = (np.concatenate(c) for c in zip(*found)) if found else (at[:0], at[:0])
        if len(found) > 1:
            label = forest(len(node), tree, top)
            tree = np.flatnonzero(label != np.arange(len(node)))
            top = label[tree]
        return pa.table({"node": np.concatenate((node[at], node[tree])), "other": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(node[top])]), "links": np.concatenate((links[at], np.zeros(len(tree), np.int64)))})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows that link with the row, component_id is the
    smallest vec_id that links reach, kept tells whether that is the row's own.
    Rows with a null vec_id or label, or whose vector is null, empty, zero or
    holds null or non-finite components, link with nothing; vectors of
    different lengths don't link. Rows that share a vec_id count as rows. A null
    vec_id is kept and has a null component_id. An empty table gives an empty
    one; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.expr("coalesce(forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)") & F.expr("coalesce(exists(embedding, x -> x <> 0), false)")
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "embedding")))
    classes = rows.where("node is not null").groupBy("node", "label", "embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("first"))
    classes = save(classes.withColumn("d", F.size("embedding")), "classes")

    sums: dict[int, np.ndarray] = {}
    for d, m in classes.select("embedding").mapInArrow(_moments, "d int, m binary").repartition(8).mapInArrow(_added, "d int, m binary").collect():
        sums[d] = sums.get(d, 0) + np.frombuffer(m).reshape(d, d)
    axes = spark.sparkContext.broadcast({d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in sums.items()})

    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    led = classes.select("node", "label", "d", "embedding", "times").mapInArrow(_leading(axes), "node long, label %s, d int, embedding array<double>, times long, lead double" % rows.schema["label"].dataType.simpleString())
    led = led.withColumn("strip", F.floor(F.col("lead") / width).cast("int"))
    tiles = led.groupBy("label", "d", "strip").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = save(tiles, "tiles")
    for name, by in (("tiles", 0), ("above", 1), ("below", -1)):
        led = led.join(tiles.select("label", "d", (F.col("strip") - by).alias("strip"), F.col("tiles").alias(name)), ["label", "d", "strip"], "left")
    led = led.withColumn("tile", F.expr("cast(pmod(node, tiles) as int)"))
    # pairs of tiles: (strip, tile) with later tiles of the strip and with all of the next one
    pairs = F.expr(
        """concat(
        transform(sequence(tile, tiles - 1), t -> named_struct('ls', strip, 'lt', tile, 'rs', strip, 'rt', t, 'side', 0, 'alone', t = tile)),
        if(tile > 0, transform(sequence(0, tile - 1), t -> named_struct('ls', strip, 'lt', t, 'rs', strip, 'rt', tile, 'side', 1, 'alone', false)), array()),
        if(above is null, array(), transform(sequence(0, above - 1), t -> named_struct('ls', strip, 'lt', tile, 'rs', strip + 1, 'rt', t, 'side', 0, 'alone', false))),
        if(below is null, array(), transform(sequence(0, below - 1), t -> named_struct('ls', strip - 1, 'lt', t, 'rs', strip, 'rt', tile, 'side', 1, 'alone', false))))"""
    )
    met = led.select("label", "d", "node", "times", "embedding", F.explode(pairs).alias("p")).select("label", "d", "node", "times", "embedding", "p.*")
    found = met.groupBy("label", "d", "ls", "lt", "rs", "rt").applyInArrow(_compare(axes, threshold), "node long, other long, links long")
    found = save(found, "compared")

    reach = components(found.where("other is not null"), "node", "other")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    info = classes.select("node", "times", "first").join(reach, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    info = save(info, "linked")
    least = info.groupBy("root").agg(F.min("first").alias("least"))
    info = info.join(least, "root").select("node", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    out = rows.select("vec_id", "node").join(info, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
