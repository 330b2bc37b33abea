"""Text quality by a convolutional network over bytes, in numpy.

Bytes become learned vectors; FILTERS learned filters see WIDTH bytes at every
STRIDE-th place. A document is cut into chunks of BLOCKS blocks of places which
overlap by one block and together cover all of it. Of each chunk every filter
keeps its largest answer, and the least of its blocks' largest ones, which tells
even texts from those that repeat themselves; a document is the mean, the largest and the least of
its chunks' answers and the logarithm of its length, from which a small layer makes one probability. What lies
beyond a text is a symbol of its own, so the shortest text has a chunk too.

The network is fitted by Adam, from a fixed seed, on a bounded sample of
labelled rows: in the order of a hash of their doc_ids, until LABELLED rows or
LABELLED_BYTES of text are reached. Scoring reads every text whole, at most
PART bytes of it at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.textcore import kept, raw

#: Labelled rows and bytes of their texts that the fit takes at most; texts of more than a sixteenth of these bytes are left out of it.
LABELLED, LABELLED_BYTES = 8000, 8 << 20
#: Bytes that a fit works through, and passes over the sample at most.
WORK, EPOCHS, BATCH = 128 << 20, 60, 48
#: Numbers of a byte's vector, bytes that a filter sees, bytes from place to place, filters, units of the last layer.
DEEP, WIDTH, STRIDE, FILTERS, UNITS = 8, 8, 4, 32, 16
#: Places of a block, blocks of a chunk; bytes worked on at once, whole blocks.
PLACES, BLOCKS = 32, 4
PART = 256 << 10
OUTSIDE = 256


def symbols(data: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of some parts (from, to, end of the text) one after another, each with what filters see beyond it, and where their places begin (parts + 1)."""
    places = np.array([max(1, -(-(b - a) // STRIDE)) for a, b, _ in parts])
    first = np.concatenate(([0], np.cumsum(places + WIDTH // STRIDE)))
    flat = np.full(first[-1] * STRIDE, OUTSIDE, np.int16)
    for (a, b, end), at, n in zip(parts, first, places):
        see = data[a : min(end, a + n * STRIDE + WIDTH - STRIDE)]
        flat[at * STRIDE : at * STRIDE + len(see)] = see
    return flat, first


def length(size: np.ndarray) -> np.ndarray:
    return (np.log1p(size) / 8).astype(np.float32)


def _chunks(blocks: int) -> np.ndarray:
    """The blocks of each chunk of a document of so many; the last one stands in for those that it has not."""
    many = max(1, -(-(blocks - BLOCKS) // (BLOCKS - 1)) + 1)
    return np.minimum((BLOCKS - 1) * np.arange(many)[:, None] + np.arange(BLOCKS), blocks - 1)


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.byte = f(OUTSIDE + 1, DEEP, scale=0.5)
        self.filters = f(WIDTH * DEEP, FILTERS, scale=(WIDTH * DEEP) ** -0.5)
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = f(6 * FILTERS + 1, UNITS, scale=(6 * FILTERS) ** -0.5)
        self.hidden_bias = np.zeros(UNITS, np.float32)
        self.out = f(UNITS, scale=UNITS**-0.5)
        self.out_bias = np.zeros(1, np.float32)

    def weights(self) -> dict[str, np.ndarray]:
        return vars(self)

    def answers(self, flat: np.ndarray) -> np.ndarray:
        """What each filter says at each place."""
        x = np.ascontiguousarray(self.byte[flat]).reshape(-1)
        n = len(flat) // STRIDE - WIDTH // STRIDE + 1
        step = STRIDE * DEEP * 4
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DEEP), (step, 4)) @ self.filters

    def chunked(self, blocks: np.ndarray) -> np.ndarray:
        """What a document's chunks keep of the largest answers of its blocks."""
        held = blocks[_chunks(len(blocks))] + self.bias
        return np.maximum(np.concatenate((held.max(1), held.min(1)), 1), 0)

    def probability(self, chunks: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        x = np.array([np.concatenate((c.mean(0), c.max(0), c.min(0))) for c in chunks], np.float32)
        x = np.column_stack((x, length(size)))
        z = np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of every row."""
        rows, held = [], []
        parts, who, size = [], [], 0

        def work():
            flat, first = symbols(data, parts)
            y = self.answers(flat)
            for k in range(len(parts)):
                own = y[first[k] : first[k + 1] - WIDTH // STRIDE]
                held.append((who[k], np.maximum.reduceat(own, np.arange(0, len(own), PLACES), axis=0)))
            parts.clear(), who.clear()

        def ready(last):
            while held and (last or held[0][0] != held[-1][0]):
                row = held[0][0]
                n = next((k for k, (r, _) in enumerate(held) if r != row), len(held))
                rows.append(self.chunked(np.concatenate([b for _, b in held[:n]])))
                del held[:n]

        for i in range(len(offsets) - 1):
            for a in range(offsets[i], max(offsets[i + 1], offsets[i] + 1), PART):
                b = min(a + PART, offsets[i + 1])
                if parts and size + b - a > PART:
                    work()
                    ready(False)
                    size = 0
                parts.append((int(a), int(b), int(offsets[i + 1])))
                who.append(i)
                size += b - a
        if parts:
            work()
        ready(True)
        return np.round(self.probability(rows, np.diff(offsets)), 6) if rows else np.zeros(0)

    def gradients(self, texts: list[np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over some texts."""
        at, parts = 0, []
        for t in texts:
            parts.append((at, at + len(t), at + len(t)))
            at += len(t)
        flat, first = symbols(np.concatenate(texts) if texts else np.zeros(0, np.uint8), parts)
        y = self.answers(flat)
        places, of, owner, done = [], [], [], 0
        for i, (a, b) in enumerate(zip(first, first[1:] - WIDTH // STRIDE)):
            blocks = -(-(b - a) // PLACES)
            places.append(np.minimum(a + PLACES * np.arange(blocks)[:, None] + np.arange(PLACES), b - 1))
            of.append(_chunks(blocks) + done)
            owner += [i] * len(of[-1])
            done += blocks
        places, of, owner = np.concatenate(places), np.concatenate(of), np.array(owner)
        seen = y[places]
        largest, place = seen.max(1), np.take_along_axis(places, seen.argmax(1), 1)  # blocks x filters
        held = largest[of]  # chunks x blocks x filters
        picks = [np.take_along_axis(of, k, 1) for k in (held.argmax(1), held.argmin(1))]
        where = np.concatenate([np.take_along_axis(place, p, 0) for p in picks], 1)  # chunks x filters, twice
        pool = np.concatenate((held.max(1), held.min(1)), 1) + np.tile(self.bias, 2)
        live = pool > 0
        pool = pool * live
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        many = np.diff(np.append(starts, len(owner))).astype(np.float32)
        mean, ends = np.add.reduceat(pool, starts) / many[:, None], [f.reduceat(pool, starts) for f in (np.maximum, np.minimum)]
        x = np.column_stack((mean, *ends, length(np.array([len(t) for t in texts]))))
        u = x @ self.hidden + self.hidden_bias
        h = np.maximum(u, 0)
        p = 1 / (1 + np.exp(-(h @ self.out + self.out_bias)))
        dz = ((p - label) / len(label)).astype(np.float32)
        du = dz[:, None] * self.out * (u > 0)
        dx = du @ self.hidden.T
        wide = 2 * FILTERS
        dpool = dx[owner, :wide] / many[owner][:, None]
        for k, end in enumerate(ends, 1):
            equal = (pool == end[owner]).astype(np.float32)
            dpool += equal * (dx[:, k * wide : (k + 1) * wide] / np.add.reduceat(equal, starts))[owner]
        dpool *= live
        where, dpool = (np.concatenate((x[:, :FILTERS], x[:, FILTERS:])) for x in (where, dpool))
        window = flat[where[:, :, None] * STRIDE + np.arange(WIDTH)]  # chunks x filters x bytes
        felt = self.byte[window].reshape(*where.shape, -1)
        dfilters = np.einsum("cfk,cf->kf", felt, dpool, optimize=True)
        back = (dpool[:, :, None] * self.filters.T).reshape(-1, DEEP)
        who = window.reshape(-1)
        dbyte = np.stack([np.bincount(who, back[:, d], OUTSIDE + 1) for d in range(DEEP)], 1).astype(np.float32)
        return {"byte": dbyte, "filters": dfilters, "bias": dpool.sum(0), "hidden": x.T @ du, "hidden_bias": du.sum(0), "out": h.T @ dz, "out_bias": dz.sum(keepdims=True)}


def train(texts: list[np.ndarray], label: np.ndarray, seed: int = 1) -> Network:
    """Adam with falling steps over shuffled batches."""
    net, r = Network(seed), np.random.default_rng(seed)
    size = sum(len(t) + WIDTH for t in texts)
    epochs = int(min(EPOCHS, max(4, WORK // max(1, size))))
    total = epochs * -(-len(texts) // BATCH)
    m = {k: np.zeros_like(v) for k, v in net.weights().items()}
    v = {k: np.zeros_like(x) for k, x in net.weights().items()}
    step = 0
    net.out_bias[:] = np.log((label.sum() + 1) / ((1 - label).sum() + 1))
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            part, step = order[lo : lo + BATCH], step + 1
            rate = 4e-3 * min(1, step / 20) * (1 - (step - 1) / total) + 1e-5
            for k, g in net.gradients([texts[i] for i in part], label[part]).items():
                w = net.weights()[k]
                if w.ndim > 1:
                    g = g + 1e-5 * w
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _part(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Network | float:
    """The network, or where one class has no rows the share of good ones with one more of either; see score."""
    key = lambda c: F.xxhash64(F.col(c).cast("string"))
    known = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where("doc_id is not null and label is not null").where(_part("doc_id") != 2)
    known = known.select(key("doc_id").alias("key"), (F.col("label") > 0).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(2 * LABELLED)
    known = docs.sparkSession.createDataFrame(known.toPandas(), "key long, label int")
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(key("doc_id").alias("key"), "text").join(F.broadcast(known), "key")
    sizes = met.select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "key").where(F.col("size") <= LABELLED_BYTES // 16)
    sizes = sizes.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(F.col("size") <= LABELLED_BYTES // 16).orderBy(F.xxhash64("key"), "key").toPandas()
    fits = sizes[(sizes["size"].cumsum() <= LABELLED_BYTES) & (sizes["n"].cumsum() <= LABELLED)][["key"]]
    chosen = docs.sparkSession.createDataFrame(fits, "key long")
    rows = met.join(F.broadcast(chosen), "key").select("key", "text", "label").toPandas().sort_values(["key", "text"], na_position="first")
    y = rows.label.to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return (float(y.sum()) + 1) / (len(y) + 2)
    return train([np.frombuffer((t or "").encode(), np.uint8) for t in rows.text], y)


def _scored(model):
    """(doc_id, score) of rows (doc_id, text)."""

    def run(batches):
        kept("conv_quality")
        for batch in batches:
            data, at = raw(batch.column(1))
            found = model.value.score(data, at) if isinstance(model.value, Network) else np.full(len(batch), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score) for every row of docs; score, from 0 to 1, is the probability of label 1.

    Labelled rows whose crc32(doc_id) mod 4 is 2 are held out: nothing is learnt
    from them. Null and empty texts get the score of a text that has nothing
    but what lies outside; a null doc_id or label takes no part in the fit. A
    doc_id with several labels counts as its largest; rows that share a
    doc_id are documents of their own, equal texts get equal scores. Without
    labels of both classes every score is the share of good rows, one added
    to either class. An empty table gives an empty one. Other columns are
    ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id, label))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = base.mapInArrow(_scored(model), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", F.coalesce(_part("doc_id") == 2, F.lit(False)).alias("held_out"), "score")
