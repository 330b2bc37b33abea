"""Periodic runs of words by tiles of scale.

A run is a stretch of words, at least 6 and at least EXPONENT times its smallest
period, that no neighbour extends. Periods go in octaves P .. 2P - 1. In an
octave a document is cut into overlapping tiles, with a boundary every P
words. The Z-function of a boundary b says for each period p how far the
words from b on agree with those from b + p on; mirrored, it says so for the
words before b. A run of period p has agreeing stretches of 3p words, so some
boundary in it has a Z of P at least, and the next one too: only such values
are worked out, over all boundaries of a tile at once. Windows of P words are
told apart by 64-bit hashes, doubled from octave to octave; ends are found on
the words.

Tiles overlap by more than the 3p words that make a fragment of a run, so
each tile decides alone whether it holds one, and fragments of a document and
period that overlap are stitched after a shuffle by both. Documents of up to
LONG words are solved where they are read, octave by octave; tiles of longer ones are
rows of their own that Spark deals out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.store import save
from paperloom.llm.textcore import Words, kept, mix, raw, spans

#: A run has so many words and so many periods at least.
LEAST, EXPONENT = 6, 4
#: Words of a document that is solved where it is read, and of a tile's core at least.
LONG = 1 << 16
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def doubled(window: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 * size words from those of size; zeros where the words end."""
    out = np.zeros_like(window)
    n = len(window) - size
    if n > 0:
        out[:n] = mix(window[:n] * _LEFT + window[size:] * _RIGHT)
        out[max(0, len(window) - 2 * size + 1) :] = 0
    return out


def _primitive(window: np.ndarray, size: int, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether p is the smallest period of the words from b on, known to repeat for 2 * size words at least."""
    out, rest = np.ones(len(p), bool), p.copy()

    def test(prime, which):
        q = p[which] // prime
        at = b[which]
        end = np.maximum(at, at + p[which] - q - size)
        out[which] &= ~((window[at] == window[at + q]) & (window[end] == window[end + q]))

    r = 2
    while r * r <= rest.max(initial=0):
        which = np.flatnonzero(rest % r == 0)
        if len(which):
            test(r, which)
            while len(more := np.flatnonzero(rest % r == 0)):
                rest[more] //= r
        r += 1
    which = np.flatnonzero(rest > 1)
    if len(which):
        test(rest[which], which)
    return out


def octave(words: np.ndarray, window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, stop) of the stretches in which words agree with those a period of size .. 2 * size - 1 on, where these make a run."""
    rows = -(-(len(window) - size) // size)
    if rows < 2:
        return (np.zeros(0, np.int64),) * 3
    ahead = np.zeros(rows * size, np.uint64)
    ahead[: len(window) - size] = window[size : (rows + 1) * size]
    hit = (ahead.reshape(rows, size) == window[: rows * size : size, None]).ravel()
    hit[np.flatnonzero(ahead == 0)] = False
    at = np.flatnonzero(hit)
    before, after = at - size, at + size
    first = at[~(hit[np.maximum(before, 0)] & (before >= 0))]
    last = at[~(hit[np.minimum(after, len(hit) - 1)] & (after < len(hit)))]
    first, last = (a[np.lexsort((a // size, a % size))] for a in (first, last))
    long = last > first  # two boundaries at least
    first, last = first[long], last[long]
    p, b, stop = size + first % size, first // size * size, last // size * size + size
    keep = _primitive(window, size, b, p)
    p, b, stop = p[keep], b[keep], stop[keep]
    start = b.copy()
    for k in range(len(p) if size > 1 else 0):
        i, j, q = int(b[k]), int(stop[k]), int(p[k])
        lo = max(0, i - size)
        same = words[lo:i] == words[lo + q : i + q]
        start[k] = i - (len(same) if same.all() else int(np.argmin(same[::-1])))
        far = words[j + q : j + q + size]
        same = words[j : j + len(far)] == far
        stop[k] = j + (len(same) if same.all() else int(np.argmin(same)))
    keep = stop - start >= np.maximum((EXPONENT - 1) * p, LEAST - p)
    return p[keep], start[keep], stop[keep]


def solve(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, period, start, stop) of all stretches of documents of words h, row i from first[i] on; by row."""
    n, rows = np.diff(first), len(first) - 1
    row = np.repeat(np.arange(rows), n)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    # after each document a word that no other place has
    words, own, at = np.empty(len(h) + rows, np.uint64), np.empty(len(h) + rows, np.int64), np.empty(len(h) + rows, np.int64)
    to = np.arange(len(h)) + row
    words[to], own[to], at[to] = h, row, place
    gap = first[1:] + np.arange(rows)
    words[gap], own[gap], at[gap] = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1 << 40)), np.arange(rows), n
    window, size, found = words, 1, []
    while (most := int(n.max(initial=0))) >= EXPONENT * size:
        if 2 * int(n[n >= EXPONENT * size].sum()) < len(words):
            there = (n >= EXPONENT * size)[own]
            words, window, own, at = words[there], window[there], own[there], at[there]
            n = np.where(n >= EXPONENT * size, n, 0)
        p, start, stop = octave(words, window, size)
        if len(p):
            found.append((own[start], p, at[start], at[start] + stop - start))
        if most >= EXPONENT * 2 * size:
            window = doubled(window, size)
        size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    out = [np.concatenate(x) for x in zip(*found)]
    by = np.argsort(out[0], kind="stable")
    return tuple(x[by] for x in out)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text) with their words counted; what is short and has no fragments has its digest, the others keep their text."""
    kept("periodic")
    for batch in batches:
        data, at = raw(batch.column(2))
        for lo, hi in spans(at):
            w = Words(data, at[lo : hi + 1])
            n = np.diff(w.first)
            short = n <= LONG
            h = w.hashes()[np.repeat(short, n)]
            row, period, start, stop = solve(h, np.concatenate(([0], np.cumsum(np.where(short, n, 0)))))
            many = np.bincount(row, minlength=hi - lo)
            plain = short & (many == 0)
            digests = [hashlib.sha256(b" ".join(data[at[lo + i] : at[lo + i + 1]].tobytes().split())).hexdigest() if plain[i] else None for i in range(hi - lo)]
            text = batch.column(2).take(pa.array(np.arange(lo, hi), mask=plain))
            fragments = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (period, start, stop)], fields=list(FRAGMENT)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(~short), text, pa.array(digests, pa.string()), fragments], ["row", "doc_id", "n_words", "long", "text", "digest", "fragments"])


def tiles(n: int) -> Iterator[tuple[int, int, int]]:
    """(octave, from, to) of the tiles of a document of n words. Cores follow each other; a margin of three largest periods is on either side, and the words that the last ones repeat."""
    size = 1
    while n >= EXPONENT * size:
        core = max(LONG, 8 * size)
        for c in range(0, n, core):
            yield size, max(0, c - 6 * size), min(n, c + core + 8 * size)
        size *= 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of rows (row, text), words as numbers of their document."""
    kept("periodic")
    for batch in batches:
        data, at = raw(batch.column(1))
        for i, row in enumerate(batch.column(0).to_pylist()):
            code = np.unique(Words(data, at[i : i + 2]).hashes(), return_inverse=True)[1].astype(np.uint32)
            for size, lo, hi in tiles(len(code)):
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([size]), pa.array([lo]), pa.array([code[lo:hi].tobytes()], pa.binary())], ["row", "size", "lo", "code"])


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments of tiles."""
    kept("periodic")
    for batch in batches:
        for row, size, lo, code in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            words = mix(np.frombuffer(code.as_buffer(), np.uint32).astype(np.uint64) + np.uint64(1))
            window, k = words, 1
            while k < size:
                window, k = doubled(window, k), 2 * k
            p, start, stop = octave(words, window, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), row)), pa.array(p), pa.array(start + lo), pa.array(stop + lo)], ["row", "period", "start", "stop"])


def collapse(data: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words of a text that no run has after its first period, joined by spaces."""
    w = Words(data, np.array([0, len(data)]))
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    stays = np.cumsum(edge[:-1]) == 0
    first, end = w.start[stays], w.end[stays]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[first] += 1
    inside[end + 1] -= 1  # with one byte after the word
    space = end[:-1]
    out = data.copy()
    out[space] = 32
    out = out[np.cumsum(inside[: len(data)], dtype=np.int8) > 0]
    return out[: len(out) - (len(end) > 0 and int(end[-1]) < len(data))].tobytes()


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_words, runs, text) with what is left of their text and its digest."""
    kept("periodic")
    for batch in batches:
        data, at = raw(batch.column(3))
        runs = batch.column(2)
        parts = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in runs.flatten().flatten()]
        off = np.concatenate(([0], np.cumsum(runs.value_lengths().fill_null(0).to_numpy()))).astype(np.int64)
        left = []
        for i in range(len(batch)):
            start, period, length = (x[off[i] : off[i + 1]] for x in parts)
            left.append(collapse(data[at[i] : at[i + 1]], start, length, period))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(left, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())], ["doc_id", "n_words", "runs", "kept", "digest"])


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, runs, kept, digest) of every row of docs.

    runs has a struct (start, period, length) for each run, in words from 0,
    by start and period. A word goes if a run has it after the run's first period;
    kept is what is left, joined by single spaces, for texts in which runs were looked
    for beyond one tile or found, null for texts without a run; digest is
    the SHA-256 of what is left for every text. Null and empty texts have no
    words, no runs and the digest of nothing. Rows that share a doc_id, or
    have none, are documents of their own, repeated rows get equal results.
    An empty table gives an empty one. Other columns are ignored, whatever
    their names. Words and windows are told apart by 64-bit hashes.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    solved = save(base.mapInArrow(_solved, f"row long, doc_id {kind}, n_words long, long boolean, text string, digest string, fragments array<struct<period:bigint,start:bigint,stop:bigint>>"), "solved")
    short = solved.where("size(fragments) > 0").select("row", F.inline("fragments"))
    cut = solved.where("long").select("row", "text").mapInArrow(_cut, "row long, size long, lo long, code binary").repartition("row", "size", "lo")
    fragments = short.unionByName(cut.mapInArrow(_tiled, "row long, period long, start long, stop long"))
    by = W.partitionBy("row", "period").orderBy("start", "stop")
    fragments = fragments.withColumn("reach", F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1)))
    fragments = fragments.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = fragments.groupBy("row", "period", "part").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + F.col("period")).alias("length"))
    whole = whole.where((F.col("length") >= LEAST) & (F.col("length") >= EXPONENT * F.col("period")))
    runs = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = solved.where("text is not null").join(runs, "row", "left")
    none = F.from_json(F.lit("[]"), RUNS)
    texts = texts.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "text").mapInArrow(_collapsed, f"doc_id {kind}, n_words long, runs {RUNS}, kept string, digest string")
    return solved.where("text is null").select("doc_id", "n_words", none.alias("runs"), F.lit(None).cast("string").alias("kept"), "digest").unionByName(texts)
