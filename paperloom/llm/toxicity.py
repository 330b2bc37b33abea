"""Toxicity by class-conditional Kneser-Ney models.

Texts are sequences of bytes: A-Z lower-cased, runs of other ASCII than
letters and digits one space, so contexts run over word boundaries. Two
models, toxic and ordinary, tell a byte from the ORDER - 1 before it; a gram
counts once a labelled document of the class, and with DISCOUNT 1 from its
second document on:

    P(s | c, class) = (n(c s) - d + (freed(c) + PRIOR) * P(s | c)) / (n(c) + PRIOR)

P(s | c) is what both classes share: interpolated Kneser-Ney continuation
probabilities of the orders below, from how many different bytes come before a
gram in any document of the corpus, labelled or not. So a rare expression says
nothing unless one class has seen it, and PRIOR damps what a few documents tell.

What is gathered from the corpus is a table of its distinct grams, which grows
with it; continuation counts of all orders are grouped counts over it. Counts
of classes come from a sample of labelled rows of about LABELLED_BYTES of
text. Contexts and grams that neither class has seen have a log-ratio of zero,
so what scoring tasks get by broadcast is bounded by that sample.

A document's evidence is the log-likelihood ratio a byte: over the whole text
and over its densest passages. A logistic regression on a bounded sample of
training documents that the counts leave out turns that into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.store import save
from paperloom.llm.textcore import LOWER, SPAN, kept, raw, spans

#: Labelled rows that class counts take: about so many bytes of text and never more rows; of more a share by hash.
LABELLED_BYTES, LABELLED = 32 << 20, 1_000_000
#: Labelled rows that the calibration takes, about.
CALIBRATION = 20_000
#: Grams that a counting task holds at once, and rows worked on at once.
FLUSH, ROWS = 1 << 21, 1 << 16
#: Bytes of a gram, and of the passages.
ORDER, PASSAGES = 5, (8, 16, 64, 256)
DISCOUNT, PRIOR = 1.0, 5.0
#: What becomes one space: ASCII bytes that are no letters or digits.
GAPS = np.ones(256, bool)
GAPS[128:] = False
GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = False
#: Classes: the first two count before calibration, the last two after it.
CLASSES = ("ordinary", "toxic", "ordinary_late", "toxic_late")


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of some rows (newest byte lowest; spaces come before a text), and where rows begin."""
    buf = LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    gap = GAPS[buf]
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # of a run of gaps the first
    first = np.concatenate(([0], np.cumsum(keep)))[at]
    symbol = np.where(gap, 32, buf)[keep].astype(np.int64)
    inner = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
    key = symbol.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(inner[k:] >= k, symbol[:-k], 32) << 8 * k
        key[:k] |= 32 << 8 * k
    return key, first


def walked(data: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
    """The grams of one text, SPAN bytes of it at a time."""
    held, gapped = np.full(ORDER - 1, 32, np.int64), False  # the symbols before, and whether the byte before was a gap
    for lo in range(start, end, SPAN):
        buf = LOWER[data[lo : min(end, lo + SPAN)]]
        gap = GAPS[buf]
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[0] |= not gapped
        symbol = np.concatenate((held, np.where(gap, 32, buf)[keep]))
        key = symbol[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            key |= symbol[ORDER - 1 - k : len(symbol) - k] << 8 * k
        held, gapped = symbol[len(symbol) - ORDER + 1 :], bool(gap[-1])
        yield key


def distinct_of(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """The distinct grams of one long text."""
    out, held, size = np.zeros(0, np.int64), [], 0
    for key in walked(data, start, end):
        held.append(np.unique(key))
        size += len(held[-1])
        if size > max(FLUSH, len(out)):
            out, held, size = np.unique(np.concatenate([out, *held])), [], 0
    return np.unique(np.concatenate([out, *held]))


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in spans(offsets):
        for a in range(lo, hi, ROWS):
            yield a, min(hi, a + ROWS)


def _places(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted known has each key, and whether it does."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, (known[at] == keys) if len(known) else np.zeros(len(keys), bool)


def _class_counts(known):
    """(gram, class, n): in how many labelled documents of a partition of (text, key) each gram is."""

    def told(held: list) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key >> 2), pa.array((key & 3).astype(np.int32)), pa.array(n)], ["gram", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        keys, classes = known.value
        held, size = [], 0
        for batch in batches:
            at, there = _places(batch.column(1).to_numpy(), keys)
            if not there.any():
                continue
            labels = classes[at[there]]
            data, offsets = raw(batch.column(0).filter(pa.array(there)))
            for lo, hi in pieces(offsets):
                if offsets[hi] - offsets[lo] > SPAN:
                    held.append(distinct_of(data, int(offsets[lo]), int(offsets[hi])) << 2 | labels[lo])
                    size += len(held[-1])
                    continue
                gram, first = grams(data, offsets[lo : hi + 1])
                row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))
                once = np.unique(gram.view(np.uint64) | row << np.uint64(8 * ORDER))
                held.append((once & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64) << 2 | labels[lo:hi][(once >> np.uint64(8 * ORDER)).astype(np.int64)])
                size += len(once)
                if size > FLUSH:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of a partition of texts."""
    kept("toxicity")
    held, size = [], 0
    for batch in batches:
        data, offsets = raw(batch.column(0))
        for lo, hi in pieces(offsets):
            long = offsets[hi] - offsets[lo] > SPAN
            held.append(distinct_of(data, int(offsets[lo]), int(offsets[hi])) if long else np.unique(grams(data, offsets[lo : hi + 1])[0]))
            size += len(held[-1])
            if size > FLUSH:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0])], ["gram"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], ["gram"])


def shared_model(texts: DataFrame) -> DataFrame:
    """(gram, p) for every gram of ORDER - 1 bytes of the corpus: the Kneser-Ney continuation probability of its last byte after the others."""
    every = save(texts.mapInArrow(_distinct, "gram long").distinct(), "grams")
    last = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
    lower = None
    for k in range(1, ORDER):
        seen = every.select(last(k + 1).alias("gram")).distinct() if k + 1 < ORDER else every
        seen = seen.groupBy(last(k).alias("gram")).agg(F.count("*").alias("n"))  # bytes before each gram of k
        context = F.shiftright("gram", 8)
        total = seen.groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        placed = seen.withColumn("context", context).join(total, "context")
        under = F.lit(1 / 256)
        if lower is not None:
            placed = placed.withColumn("suffix", last(k - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("under")), "suffix")
            under = F.col("under")
        p = (F.greatest(F.col("n") - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT) * F.col("kinds") * under) / F.col("all")
        lower = placed.select("gram", p.alias("p"))
    return save(lower, "shared")


def ratios(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """(whole, gram, value) of counts (gram, toxic, ordinary): the log-ratio of a whole gram, and that of what follows a context unseen."""
    n = [F.col(c) for c in ("toxic", "ordinary")]
    freed = lambda c: F.least(c.cast("double"), F.lit(DISCOUNT))
    counts = counts.where("toxic + ordinary > 0").withColumn("context", F.shiftright("gram", 8))
    context = counts.groupBy("context").agg(*[F.sum(c).alias(f"all_{i}") for i, c in enumerate(n)], *[F.sum(freed(c)).alias(f"freed_{i}") for i, c in enumerate(n)])
    back = [F.col(f"freed_{i}") + F.lit(PRIOR) for i in (0, 1)]
    over = [F.col(f"all_{i}") + F.lit(PRIOR) for i in (0, 1)]
    suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))
    placed = counts.withColumn("suffix", suffix).join(shared.select(F.col("gram").alias("suffix"), "p"), "suffix").join(context, "context")
    p = [(F.greatest(c - F.lit(DISCOUNT), F.lit(0.0)) + back[i] * F.col("p")) / over[i] for i, c in enumerate(n)]
    out = placed.select(F.lit(True).alias("whole"), "gram", F.log(p[0] / p[1]).cast("float").alias("value"))
    return out.unionByName(context.select(F.lit(False).alias("whole"), F.col("context").alias("gram"), F.log(back[0] / over[0] / (back[1] / over[1])).cast("float").alias("value")))


class Model:
    """Log-ratios by gram and by context, in sorted arrays."""

    def __init__(self, table):
        self.tables = [(gram[by], value[by]) for gram, value in ((t.gram.to_numpy(np.int64), t.value.to_numpy(np.float32)) for t in (table[table.whole], table[~table.whole])) for by in (np.argsort(gram),)]

    def ratio(self, gram: np.ndarray) -> np.ndarray:
        """log P(byte | before, toxic) - log P(byte | before, ordinary) for the last byte of each gram."""
        every, which = np.unique(gram, return_inverse=True)
        out = np.zeros(len(every), np.float32)
        for keys, (known, value) in ((every >> 8, self.tables[1]), (every, self.tables[0])):
            at, there = _places(keys, known)
            if len(known):
                out = np.where(there, value[at], out)
        return out[which]

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the log-likelihood ratio a byte: of the text, then of its densest passage of each size."""
        n = len(offsets) - 1
        out = np.zeros((n, 1 + len(PASSAGES)))
        if n == 1 and offsets[1] - offsets[0] > SPAN:
            out[0] = self._long(data, int(offsets[0]), int(offsets[1]))
            return out
        gram, first = grams(data, offsets)
        if not len(gram):
            return out
        total = np.concatenate(([0], np.cumsum(self.ratio(gram), dtype=np.float64)))
        for r in range(n):
            a, b = first[r], first[r + 1]
            if b > a:
                out[r, 0] = (total[b] - total[a]) / (b - a)
                for k, size in enumerate(PASSAGES):
                    s = min(size, b - a)
                    out[r, 1 + k] = (total[a + s : b + 1] - total[a : b - s + 1]).max() / size
        return out

    def _long(self, data: np.ndarray, start: int, end: int) -> np.ndarray:
        """The evidence of one long text."""
        most = max(PASSAGES)
        tail, total, many, best = np.zeros(0), 0.0, 0, np.full(len(PASSAGES), -np.inf)
        for gram in walked(data, start, end):
            value = self.ratio(gram).astype(np.float64)
            total, many = total + value.sum(), many + len(value)
            sums = np.concatenate(([0.0], np.cumsum(np.concatenate((tail, value)))))
            for k, size in enumerate(PASSAGES):
                if len(sums) > size:
                    best[k] = max(best[k], (sums[size:] - sums[:-size]).max() / size)
            tail = np.concatenate((tail, value))[-most:]
        if not many:
            return np.zeros(1 + len(PASSAGES))
        short = ~np.isfinite(best)  # of fewer symbols than the passage has
        best[short] = total / np.array(PASSAGES)[short]
        return np.concatenate(([total / many], best))


def _evidence(model, text: int):
    """Rows, whole, with the evidence of their column text."""

    def run(batches):
        kept("toxicity")
        for batch in batches:
            data, at = raw(batch.column(text))
            parts = [model.value.evidence(data, at[lo : hi + 1]) for lo, hi in spans(at)]
            e = np.concatenate(parts) if parts else np.zeros((0, 1 + len(PASSAGES)))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, batch.schema.names), pa.array(list(e), pa.list_(pa.float64()))], ["row", "evidence"])

    return run


def _sampled(model, wanted):
    """(label, evidence) of the rows whose key is wanted."""

    def run(batches):
        kept("toxicity")
        keys, labels = wanted.value
        for batch in batches:
            at, there = _places(batch.column(1).to_numpy(), keys)
            if there.any():
                data, offsets = raw(batch.column(0).filter(pa.array(there)))
                e = np.concatenate([model.value.evidence(data, offsets[lo : hi + 1]) for lo, hi in spans(offsets)])
                yield pa.RecordBatch.from_arrays([pa.array(labels[at[there]]), pa.array(list(e), pa.list_(pa.float64()))], ["label", "evidence"])

    return run


def calibrate(evidence: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights and last the intercept of a logistic regression on evidence, by Newton steps with a small ridge."""
    x = np.column_stack((evidence, np.ones(len(evidence))))
    w = np.zeros(x.shape[1])
    if not 0 < label.sum() < len(label):
        w[:2], w[-1] = 1, -1
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (label - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def _part(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic"):
    """The broadcast model and the calibration's weights; see score."""
    spark = docs.sparkSession
    size, rows = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    key = lambda c: F.xxhash64(F.col(c).cast("string"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where("doc_id is not null and label is not null")
    known = known.select(key("doc_id").alias("key"), (F.col("label") > 0).cast("int").alias("label"), _part("doc_id").alias("part")).where("part <> 2")
    known = save(known, "labelled")
    many = known.count()
    chance = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    room = min(LABELLED, LABELLED_BYTES * max(1, rows) / max(1, size or 0))
    seen = known.where(chance < room / max(1, many)).toPandas().sort_values("key")
    late = seen.part.to_numpy() == 3
    places = spark.sparkContext.broadcast((seen.key.to_numpy(np.int64), seen.label.to_numpy(np.int64) + 2 * late))
    every = base.select("text", F.when(F.col("doc_id").isNotNull(), key("doc_id")).otherwise(0).alias("key"))
    counts = every.mapInArrow(_class_counts(places), "gram long, class int, n long")
    counts = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(CLASSES)])
    counts = save(counts, "counts")
    shared = shared_model(every.select("text"))

    def model(toxic: Column, ordinary: Column):
        return spark.sparkContext.broadcast(Model(ratios(counts.select("gram", toxic.alias("toxic"), ordinary.alias("ordinary")), shared).toPandas()))

    early = model(F.col("toxic"), F.col("ordinary"))
    full = model(F.col("toxic") + F.col("toxic_late"), F.col("ordinary") + F.col("ordinary_late"))
    calibrating = known.where("part = 3").where(chance < CALIBRATION / max(1, many / 3)).toPandas().sort_values("key")
    wanted = spark.sparkContext.broadcast((calibrating.key.to_numpy(np.int64), calibrating.label.to_numpy(np.int64)))
    sample = every.mapInArrow(_sampled(early, wanted), "label long, evidence array<double>").collect()
    weights = calibrate(np.array([r[1] for r in sample]).reshape(-1, 1 + len(PASSAGES)), np.array([float(r[0] > 0) for r in sample]))
    for b in (places, early, wanted):
        b.destroy()
    return full, weights


def _scored(docs: DataFrame, fitted, text: str) -> DataFrame:
    """(row, score): the rows of docs as structs."""
    model, weights = fitted
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("evidence", T.ArrayType(T.DoubleType()))])
    logit = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        logit = logit + F.lit(float(w)) * F.col("evidence")[k]
    return docs.mapInArrow(_evidence(model, docs.columns.index(text)), schema).select("row", (1 / (1 + F.exp(-logit))).alias("score"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score) for every row of docs.

    Labelled rows whose crc32(doc_id) mod 4 is 2 are held out: nothing is
    learnt from them. Of the others remainders 0 and 1 give the class counts with
    which remainder 3 is scored for the calibration (about CALIBRATION of its rows, by
    hash); the final scores count all three. Class counts take labelled rows of
    about LABELLED_BYTES of text at most, by hash; continuation counts take
    every document. Null
    and empty texts have no evidence and get the score of none; a null doc_id
    or label takes no part in training. A doc_id with several labels counts as
    its largest; rows that share a doc_id are documents of their own, and equal
    rows get equal scores. Without labels of both classes the evidence is used as
    it is. An empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    fitted = fit(docs, labels, text, doc_id, label)
    found = _scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), fitted, "text").select("row.doc_id", "score")
    return found.select("doc_id", F.coalesce(_part("doc_id") == 2, F.lit(False)).alias("held_out"), "score")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score stays below threshold, each by its own text, with all their columns whatever their names."""
    return _scored(docs, fit(docs, labels), "text").where(F.col("score") < threshold).select("row.*")
