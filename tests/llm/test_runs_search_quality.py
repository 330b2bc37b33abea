"""Periodic runs, lexical search and the quality network against brute force, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import conv_quality, lexical, periodic, queries, textcore

CLASH = {"row": 1, "term": 2, "item": 3, "score": 4.5, "runs": "x", "key": 5, "label": 6, "rank": 7}


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def brute_runs(words):
    """Runs (start, period, length) and kept words, by comparing each word with those before it."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    runs = sorted((s, p, m) for (s, m), p in found.items())
    gone = {k for s, p, m in runs for k in range(s + p, s + m)}
    return runs, b" ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            block = [r.choice("ab" if r.random() < 0.5 else ["x", "yy", "é", "zzz", "w"]) for _ in range(r.randint(1, 9))]
            parts += block * r.choice([1, 1, 2, 3, 4, 5, 9]) + block[: r.randint(0, len(block))]
        out.append("".join(w + r.choice([" ", "\n", "  \t"]) for w in parts))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_a_batch_and_of_tiles(seed, monkeypatch):
    texts = periodic_texts(seed, 80) + [None, "", "one", "a " * 5, "a " * 6, "same " * 700, "q w e r t " * 300]
    texts += [texts[-1], "thue " + " ".join("ab"[bin(k).count("1") % 2] for k in range(3000))]
    data, at = textcore.raw(pa.array(texts))
    w = textcore.Words(data, at)
    row, period, start, stop = periodic.solve(w.hashes(), w.first)
    found = [[] for _ in texts]
    for i, p, a, b in zip(row.tolist(), period.tolist(), start.tolist(), stop.tolist()):
        found[i].append((a, p, b - a + p))
    monkeypatch.setattr(periodic, "LONG", 16)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        runs, kept = brute_runs(words)
        assert sorted(found[i]) == runs
        s, p, m = np.array(runs, np.int64).reshape(-1, 3).T
        assert periodic.collapse(data[at[i] : at[i + 1]], s, m, p) == kept
        if seed == 0 or len(words) > 500:
            code = np.unique(w.hashes()[w.first[i] : w.first[i + 1]], return_inverse=True)[1].astype(np.uint32)
            fragments = {}
            for size, lo, hi in periodic.tiles(len(code)):
                one = pa.RecordBatch.from_arrays([pa.array([i]), pa.array([size]), pa.array([lo]), pa.array([code[lo:hi].tobytes()], pa.binary())], ["row", "size", "lo", "code"])
                for b in periodic._tiled(iter([one])):
                    for _, q, x, y in zip(*(c.to_pylist() for c in b.columns)):
                        fragments.setdefault(q, []).append((x, y))
            stitched = []
            for q, parts in fragments.items():
                whole = []
                for x, y in sorted(parts):
                    if whole and x <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], y)
                    else:
                        whole.append([x, y])
                stitched += [(x, q, y - x + q) for x, y in whole if y - x + q >= max(6, 4 * q)]
            assert sorted(stitched) == runs


def test_find_runs(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(900)}" for _ in range(70_000)) + " tic tac toe" * 40_000 + " end"  # beyond one tile
    texts = periodic_texts(9, 40) + [None, "", "   ", "a a a a a a", long]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "b b b b b b b"), (None, "c c c c c c c d")]
    found = periodic.find_runs(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    said = Counter((x.doc_id, x.n_words, tuple((q.start, q.period, q.length) for q in x.runs), x.digest) for x in found)
    expected, kept = Counter(), Counter()
    for k, t in rows:
        words = (t or "").encode().split()
        if t == long:
            runs, left = [(70_000, 3, 120_000)], b" ".join(words[:70_003] + words[-1:])
        else:
            runs, left = brute_runs(words)
        expected[k, len(words), tuple(runs), hashlib.sha256(left).hexdigest()] += 1
        kept[left.decode() if runs else None] += 1
    assert said == expected and Counter(x.kept for x in found) == kept
    assert periodic.find_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def brute_search(docs, items, k):
    terms = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    tf = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in tf)
    total = sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for i, text in items:
        scores = []
        for d, c in tf:
            s = 0
            for t in terms(text):
                if c[t]:
                    m = 100 - 75 + 75 * sum(c.values()) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def test_search(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = [f"t{k}" for k in range(60)] + ["Ünï", "ÜNÏ", "A1", "a1", "x-y"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(k, prose(r.randint(1, 40))) for k in range(700)] + [(1000 + k, "t1 t2 t3") for k in range(30)]
    docs += [(2000, None), (2001, ""), (2002, "---"), (5, prose(9)), (None, "t1 t2 t3"), (None, "t1 t2 t3"), (2003, prose(3000))]
    items = [(k, prose(r.randint(1, 12))) for k in range(7)] + [(3, "t1, T1; t2"), (8, None), (9, "unseen words"), (10, "t1 " * 50), (None, "a1 x")]
    r.shuffle(docs)
    frame = lambda rows, name: clashing(spark.createDataFrame(rows, f"{name} long, text string"))
    for block in (1024, 3):
        monkeypatch.setattr(lexical, "ITEMS", block)
        found = lexical.search(frame(docs, "doc_id"), frame(items, "item_id"), 10)
        assert Counter(tuple(x) for x in found.collect()) == brute_search(docs, items, 10)
    assert lexical.search(frame([], "doc_id"), frame(items, "item_id")).count() == 0
    assert lexical.search(frame(docs, "doc_id"), frame([], "item_id")).count() == 0


def test_vocabulary_tiles_stay_exact():
    r = np.random.default_rng(1)
    item, term = r.integers(0, 5, 400), r.integers(0, 90, 400)
    both = np.unique(item * 90 + term)
    item, term = both // 90, both % 90
    weight = r.integers(1, 1 << 36, len(both))
    tiles = lexical.vocabulary_tiles(item, term, weight, 5, 16)
    total = {}
    for own, matrix in tiles:
        assert len(own) <= 16 and matrix.sum(1).max() * lexical.IMPACT < lexical.EXACT and (np.diff(own) > 0).all()
        for i, j in zip(*np.nonzero(matrix)):
            total[i, own[j]] = total.get((i, own[j]), 0) + int(matrix[i, j])
    assert total == dict(zip(zip(item, term), weight.tolist()))


def test_blocks_bound_their_matrices(monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 100)
    sizes = [(k, n) for k, n in enumerate([5, 5, 5, 5, 5, 200, 1, 1, 30, 30])]
    blocks = list(lexical._blocks(iter(sizes)))
    assert [x for b in blocks for x in b] == list(range(10)) and [5] in blocks
    assert all(len(b) == 1 or len(b) * sum(sizes[k][1] for k in b) <= 100 for b in blocks)


def test_impacts_beyond_64_bits():
    tf, n = np.array([1, 5]), np.array([10, 1 << 40])
    said = lexical.impacts(tf, n, 1 << 30, 1 << 50)
    assert said.tolist() == [1_000_000_000 * t // (1000 * t + 8 * (25 + 75 * m * (1 << 30) // (1 << 50))) for t, m in zip(tf.tolist(), n.tolist())]


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(3)
    texts = [r.integers(97, 123, n).astype(np.uint8) for n in (0, 1, 30, 700, 1500)]
    label = np.array([0.0, 1, 0, 1, 1])
    net = conv_quality.Network(5)
    for k, w in net.weights().items():
        setattr(net, k, w.astype(np.float64))

    def loss():
        data, at = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        flat, first = conv_quality.symbols(data, [(int(a), int(b), int(b)) for a, b in zip(at, at[1:])])
        x = net.byte[flat].reshape(-1)
        y = np.array([x[k * 32 : k * 32 + 64] for k in range(len(flat) // 4 - 1)]) @ net.filters
        pooled = [net.chunked(np.maximum.reduceat(y[a : b - 2], np.arange(0, b - 2 - a, conv_quality.PLACES), axis=0)) for a, b in zip(first, first[1:])]
        x = np.column_stack((np.array([np.concatenate((c.mean(0), c.max(0), c.min(0))) for c in pooled]), conv_quality.length(np.diff(at))))
        p = 1 / (1 + np.exp(-(np.maximum(x @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias)))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    net.answers = lambda flat: np.array([net.byte[flat].reshape(-1)[k * 32 : k * 32 + 64] for k in range(len(flat) // 4 - 1)]) @ net.filters
    names = {k: v for k, v in net.weights().items() if isinstance(v, np.ndarray)}
    g = net.gradients(texts, label)
    for k, w in names.items():
        for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(6)] + ([(97 + int(c), 2) for c in range(4)] if k == "byte" else []):
            was, d = w[at], 1e-5
            w[at] = was + d
            up = loss()
            w[at] = was - d
            slope = (up - loss()) / (2 * d)
            w[at] = was
            assert abs(slope - g[k][at]) < 1e-4 + 1e-2 * abs(slope), k


def test_texts_score_the_same_in_parts(monkeypatch):
    r = np.random.default_rng(4)
    texts = [r.integers(32, 123, n).astype(np.uint8).tobytes().decode() for n in (0, 3, 900, 0, 5000, 40_000, 512, 513)] + [None]
    data, at = textcore.raw(pa.array(texts))
    net = conv_quality.Network()
    whole = net.score(data, at)
    monkeypatch.setattr(conv_quality, "PART", conv_quality.PLACES * conv_quality.STRIDE * 3)
    assert abs(whole - net.score(data, at)).max() < 2e-6 and whole[0] == whole[3] == whole[-1]
    assert net.score(*textcore.raw(pa.array([], pa.string()))).tolist() == []


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op12_quality(spark, sf).where("held_out").join(labels, "doc_id").groupBy("quality", "predicted").count().collect()
    n = {(x[0], x[1]): x[2] for x in found}
    assert n[0, 0] >= 0.8 * (n[0, 0] + n.get((0, 1), 0)) and n[1, 1] >= 0.95 * (n[1, 1] + n.get((1, 0), 0))


def test_quality_edges(spark):
    docs = [(k, f"good words number {k} of plain prose") for k in range(40)] + [(100 + k, f"b#a$d {k} ###") for k in range(40)]
    docs += [(None, "x"), (300, None), (301, ""), (302, "y" * 300_000), (1, docs[1][1])]
    labels = [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)] + [(None, 1, 1), (301, None, None), (1, 0, 1)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = conv_quality.score(d, y).collect()
    assert len(found) == len(docs) and all(0 <= x.score <= 1 for x in found) and not any(x.held_out for x in found if x.doc_id is None)
    by = {x.doc_id: x.score for x in found}
    assert by[300] == by[301] and len({x.score for x in found if x.doc_id == 1}) == 1
    assert np.mean([by[k] for k in range(40)]) > 0.7 > 0.3 > np.mean([by[100 + k] for k in range(40)])
    assert {x.score for x in conv_quality.score(d, y.where("quality = 1 or quality is null")).collect()} < {k / (k + 1) for k in range(1, 99)}
    assert conv_quality.score(d.limit(0), y).count() == 0 and {x.score for x in conv_quality.score(d, y.limit(0)).collect()} == {0.5}
