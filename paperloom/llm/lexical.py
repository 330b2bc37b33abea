"""Ranked lexical search by blocked dense multiplication.

Terms are runs of bytes that are no ASCII byte but a letter or digit, A-Z
lower-cased. Items are the queries. They go in blocks of bounded size; what a
block broadcasts is its compact vocabulary and the weight that each of its
items gives each of its terms. The vocabulary is cut into tiles, documents
into tiles of DOCS; an item matrix (items x terms: occurrences times weight)
times an impact matrix (terms x documents) gives the scores of a pair of tiles
by one BLAS call in float64. All numbers are whole, and a vocabulary tile ends
before any item's sum over it could reach 2^53, so every product is exact;
sums over tiles are 64-bit integers.

Of each document tile an item keeps the k best by score and doc_id, ties
beyond the k-th score included until doc_ids decide, and so does a task over its
tiles. Spark ranks what tasks keep, in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.store import save
from paperloom.llm.textcore import Words, kept, raw, spans

#: Items of a block, and cells of its item matrices: items times terms of all of them (an item alone may have more).
ITEMS, CELLS = 1024, 1 << 22
#: Documents of a tile, terms of a vocabulary tile.
DOCS, TERMS = 512, 4096
#: Salts of the first ranking.
SALTS = 256
#: Impacts stay below this; products of float64 are exact below EXACT.
IMPACT, EXACT = 10**6, 1 << 53
#: What parts terms: ASCII bytes that are no letters or digits.
GAPS = np.ones(256, bool)
GAPS[128:] = False
GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of some rows, and where rows begin."""
    w = Words(data, offsets, True, GAPS)
    return w.hashes(), w.first


def counted(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) of small whole numbers, by row, with how often each is there."""
    width = int(key.max(initial=0)) + 1
    both, n = np.unique(row.astype(np.int64) * width + key, return_counts=True)
    return both // width, both % width, n


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, n) of rows (item, text)."""
    kept("lexical")
    for batch in batches:
        item = batch.column(0).to_numpy(zero_copy_only=False)
        data, at = raw(batch.column(1))
        for lo, hi in spans(at):
            h, first = terms(data, at[lo : hi + 1])
            every, which = np.unique(h, return_inverse=True)
            row, term, n = counted(which, np.repeat(np.arange(hi - lo), np.diff(first)))
            yield pa.RecordBatch.from_arrays([pa.array(item[lo + row]), pa.array(every[term].view(np.int64)), pa.array(n)], ["item", "term", "n"])


class Vocabulary:
    """Which of a block's sorted terms a hash is."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms of the block, and those terms."""
        at = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.known, h[at])
        term[term == len(self.known)] = 0
        same = self.known[term] == h[at] if len(self.known) else np.zeros(0, bool)
        return at[same], term[same]


def _statistics(vocabulary):
    """(term, n): in how many documents of a partition each of the block's terms is; under -1 the documents with any term, under -2 all their terms."""

    def run(batches):
        kept("lexical")
        v = vocabulary.value
        df, docs, total = np.zeros(len(v.known), np.int64), 0, 0
        for batch in batches:
            data, at = raw(batch.column(0))
            for lo, hi in spans(at):
                h, first = terms(data, at[lo : hi + 1])
                many = np.diff(first)
                docs, total = docs + int((many > 0).sum()), total + len(h)
                place, term = v.found(h)
                _, term, _ = counted(term, np.repeat(np.arange(hi - lo), many)[place])
                df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((df[some], [docs, total])))], ["term", "n"])

    return run


def vocabulary_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, width: int = TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, items x terms matrix) of entries (item, term, weight), by term: at most width terms and no item's sum of weights times IMPACT beyond EXACT. A weight that is too large alone is spread over tiles."""
    most = EXACT // IMPACT - 1
    parts = -(-weight // most)
    if (parts > 1).any():
        layer = np.concatenate([np.arange(p) for p in parts])
        item, term, whole = (np.repeat(a, parts) for a in (item, term, weight))
        weight = np.minimum(most, whole - layer * most)
        by = np.lexsort((term, layer))
        item, term, weight, layer = item[by], term[by], weight[by], layer[by]
    else:
        by = np.argsort(term, kind="stable")
        item, term, weight = item[by], term[by], weight[by]
    out, lo = [], 0
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(term))
    while lo < len(starts):
        sums, hi = np.zeros(items, np.int64), lo
        while hi < len(starts) and hi - lo < width and (hi == lo or term[starts[hi]] > term[starts[hi - 1]]):
            s = slice(starts[hi], ends[hi])
            more = sums.copy()
            np.add.at(more, item[s], weight[s])
            if hi > lo and more.max() > most:
                break
            sums, hi = more, hi + 1
        s = slice(starts[lo], ends[hi - 1])
        own, column = np.unique(term[s], return_inverse=True)
        matrix = np.zeros((items, len(own)))
        matrix[item[s], column] = weight[s]
        out.append((own, matrix))
        lo = hi
    return out


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The impact of a term that a document of n terms holds tf times, whole numbers below IMPACT."""
    if len(n) and 75 * docs * int(n.max()) >= 1 << 63:
        long = np.array([75 * docs * int(x) // total for x in n], np.int64)
    else:
        long = 75 * n * docs // max(1, total)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 75 + long))


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best by falling score, then doc_id, those without one last."""
    by = np.lexsort((doc, none, -score, item))
    first = np.searchsorted(item[by], item[by])
    return by[np.arange(len(by)) - first < k]


def _ranked(block, k: int):
    """(item, doc_id, score) of a partition's best documents of rows (doc_id, text)."""

    def run(batches):
        kept("lexical")
        v, tiles, items, docs, total = block.value
        held = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        for batch in batches:
            ids = batch.column(0)
            none = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            data, at = raw(batch.column(1))
            for lo, hi in spans(at):
                h, first = terms(data, at[lo : hi + 1])
                place, term = v.found(h)
                row, term, tf = counted(term, np.repeat(np.arange(hi - lo), np.diff(first))[place])
                value = impacts(tf, np.diff(first)[row], docs, total)
                for a in range(0, hi - lo, DOCS):
                    b = min(hi - lo, a + DOCS)
                    s = slice(*np.searchsorted(row, (a, b)))
                    score = _scores(tiles, items, row[s] - a, term[s], value[s], b - a)
                    # nothing below the k-th score of a tile or of what is held can rank
                    floor = np.ones(items, np.int64)
                    if b - a > k:
                        floor = np.maximum(floor, np.partition(score, b - a - k, axis=1)[:, b - a - k])
                    if len(held[0]):
                        full = np.flatnonzero(np.bincount(held[0], minlength=items) >= k)
                        least = np.full(items, np.iinfo(np.int64).max)
                        np.minimum.at(least, held[0], held[2])
                        floor[full] = np.maximum(floor[full], least[full])
                    i, j = np.nonzero(score >= floor[:, None])
                    if len(i):
                        found = [i, ids[lo + a + j], score[i, j], none[lo + a + j]]
                        held = [np.concatenate(x) for x in zip(held, found)]
                        keep = best(held[0], held[2], held[1], held[3], k)
                        held = [x[keep] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1], mask=held[3]), pa.array(held[2])], ["item", "doc_id", "score"])

    return run


def _scores(tiles, items: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """items x documents: the sum over vocabulary tiles of item matrix times impacts."""
    score = np.zeros((items, docs), np.int64)
    for own, matrix in tiles:
        at = np.searchsorted(own, term)
        at[at == len(own)] = 0
        there = own[at] == term
        if there.any():
            present, column = np.unique(at[there], return_inverse=True)
            impact = np.zeros((len(present), docs))
            impact[column, row[there]] = value[there]
            score += (matrix[:, present] @ impact).astype(np.int64)
    return score


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its k documents of highest score above 0, all if fewer; equal scores by doc_id.

    N counts the documents with a term, L their terms with repeats, df the
    documents with a term; a term weighs w = floor(1000 ln((2N+2)/(2df+1))), and a
    document's score sums w * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L)))
    over the item's terms, repeats included. Null and empty texts have no
    terms: such documents count nowhere, such items get no rows. Rows that
    share a doc_id are documents of their own, rows that share an item_id
    items of their own with ranks from 1 each. A null doc_id comes after all
    others of its score. Empty tables give an empty one; other columns are
    ignored, whatever their names. Terms are told apart by 64-bit hashes.

    Each block of items reads the documents twice, for the statistics of its
    terms and for the scores; its size is bounded by ITEMS and CELLS.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = save(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "items")
    entries = save(asked.select("item", "text").mapInArrow(_item_terms, "item long, term long, n long"), "item_terms")
    sizes = entries.groupBy("item").agg(F.count("*").alias("n")).orderBy("item")
    found = None
    for block in _blocks(sizes.toLocalIterator()):
        mine = entries.where(F.col("item").between(block[0], block[-1])).toPandas()
        number = np.searchsorted(np.array(block), mine.item.to_numpy())
        known, term = np.unique(mine.term.to_numpy(np.int64).view(np.uint64), return_inverse=True)
        vocabulary = Vocabulary(known)
        words = spark.sparkContext.broadcast(vocabulary)
        counts = base.select("text").mapInArrow(_statistics(words), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        counts = dict(zip(counts.term.tolist(), counts.n.tolist()))
        many, total = counts.get(-1, 0), counts.get(-2, 0)
        df = np.array([counts.get(t, 0) for t in range(len(known))], np.int64)
        weight = np.floor(1000 * np.log((2 * many + 2) / (2 * df + 1).astype(np.float64))).astype(np.int64)
        times = mine.n.to_numpy(np.int64)
        useful = (df[term] > 0) & (weight[term] > 0)
        tiles = vocabulary_tiles(number[useful], term[useful], (times * weight[term])[useful], len(block))
        ready = spark.sparkContext.broadcast((vocabulary, tiles, len(block), many, total))
        names = spark.createDataFrame(list(enumerate(block)), "number long, item long")
        part = base.mapInArrow(_ranked(ready, k), "number long, doc_id long, score long").join(F.broadcast(names), "number").drop("number")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, score long, item long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    few = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("rank", rank("item", "salt")).where(F.col("rank") <= k)
    few = few.withColumn("rank", rank("item")).where(F.col("rank") <= k)
    return few.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _blocks(sizes) -> Iterator[list[int]]:
    """Runs of items (item, n terms) of at most ITEMS items and CELLS cells, or of one item."""
    block, room = [], 0
    for item, n in sizes:
        if block and (len(block) == ITEMS or (len(block) + 1) * (room + n) > CELLS):
            yield block
            block, room = [], 0
        block.append(item)
        room += n
    if block:
        yield block
