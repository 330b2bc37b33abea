"""Vector operators against brute force."""

import numpy as np
import pytest

from paperloom.llm import embed_dedup, topk
from tests.llm import brute

NAN, INF = float("nan"), float("inf")


def vectors(n=300, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    for k in range(0, n, 3):
        x[k] = x[k // 2] * r.uniform(0.5, 2) + r.normal(size=d) * r.choice([0, 0.05, 0.1])
    x[40:60] = x[7]
    return x


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int, strip int, x int, d string")


def rows_of(x, labels):
    return [(i, [float(v) for v in row], l, 0, 0, 0, "") for i, (row, l) in enumerate(zip(x, labels))]


@pytest.mark.parametrize("tile", [16, 1024])
def test_embedding_dedup(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    x = vectors()
    labels = [i % 2 for i in range(len(x))]
    rows = rows_of(x, labels)
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [NAN] * 16, 1), (1004, [INF] + [1.0] * 15, 1), (1005, [None] + [1.0] * 15, 1), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (None, rows[1][1], 1)]
    rows += [(i, e, l, 0, 0, 0, "") for i, e, l in odd]
    found = {r.vec_id: r for r in embed_dedup.near_duplicates(frame(spark, rows)).collect()}
    y = x.astype(np.float64)
    n = np.sqrt((y * y).sum(1))
    cos = (y @ y.T) / np.outer(n, n)
    links = (cos >= 0.98) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(links, False)
    component = brute.union(zip(*np.nonzero(links)), range(len(x)))
    assert links.sum() > 300
    for i in range(len(x)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (links[i].sum(), component[i], component[i] == i)
    assert found[1007].n_links == found[1008].n_links == 1 and found[1008].component_id == 1007
    assert all(found[i].n_links == 0 and found[i].kept for i in range(1000, 1007))
    assert len(found) == len(rows)


def test_embedding_dedup_of_extreme_magnitudes(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1e200, 0.0], 1), (2, [1e-200, 0.0], 1), (3, [0.0, 5e-324], 1), (4, [0.0, 1.7e308], 1), (None, [1.0, 0.0], 1)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 3: (1, 3, True), 4: (1, 3, False), None: (0, None, True)}


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, []), lambda v: v % 20 == 0).count() == 0


@pytest.mark.parametrize("shard, queries", [(8192, 2048), (37, 5)])
@pytest.mark.parametrize("n", [12, 300])
def test_exact_topk(spark, monkeypatch, shard, queries, n):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "LEAST", shard)
    monkeypatch.setattr(topk, "QUERIES", queries)
    x = vectors(n) if n > 60 else vectors()[:n]
    rows = rows_of(x, [0] * n) + [(1000, None, 0, 0, 0, 0, ""), (1020, [NAN] * 16, 0, 0, 0, 0, ""), (1040, [1.0], 0, 0, 0, 0, ""), (None, [1.0] * 16, 0, 0, 0, 0, "")]
    found = {}
    for r in topk.top_k(frame(spark, rows), lambda v: v % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    score = whole @ whole.T
    for q in range(0, n, 20):
        want = sorted((-score[q, j], j) for j in range(n) if j != q)[:20]
        assert sorted(found[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert set(found) == set(range(0, n, 20))


def test_the_cutoff_spares_products():
    r = np.random.default_rng(3)
    middle = r.normal(size=(40, 64))
    x = np.floor(64 * (middle[r.integers(0, 40, 4000)] + 0.3 * r.normal(size=(4000, 64))))
    score = x[:100] @ x.T
    least = np.sort(score, 1)[:, -21]
    q, y, *sliced = topk._slices(x[:100], x)
    i, j, part, work = topk.above(q, y, least, sliced)
    want = np.nonzero(score >= least[:, None])
    assert set(zip(i[part >= least[i]], j[part >= least[i]])) == set(zip(*want)) and (part == score[i, j]).all()
    assert work < 0.6 * score.size * 64


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e9, 3.0], 0, 0, 0, 0, ""), (1, [1e9, -1.0], 0, 0, 0, 0, ""), (2, [3e38, 1.0], 0, 0, 0, 0, "")]
    got = {r.vec_id: r.score for r in topk.top_k(frame(spark, rows), lambda v: v % 20 == 0).collect()}
    assert got[1] == (64 * 10**9) ** 2 - 192 * 64 or got[1] == 2**63 - 1
