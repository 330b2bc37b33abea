"""Sharding and packing beside plain versions: a k-d tree in lists, all subset sums, the tokenizer's own slices."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import packing, sharding, token_ids


def plain_tree(points, shards, first=0, every=None):
    """{key: shard} of points (key, weight, {dimension: place}): each node is cut in two along its widest dimension."""
    if not points:
        return {}
    if shards == 1:
        return {p[0]: first for p in points}
    wide = {d: max(p[2][d] for p in points) - min(p[2][d] for p in points) for d in sharding.DIMS}
    every = every or wide
    dim = max(sharding.DIMS, key=lambda d: wide[d] / every[d] if every[d] else 0.0)
    goal = sum(p[1] for p in points) * (shards // 2) / shards

    def cut(items, goal):
        """The value at which the running weight passes goal, what is below it and at it."""
        below = 0
        values = sorted({v for v, _ in items})
        for v in values:
            own = sum(w for x, w in items if x == v)
            if below + own >= goal or v == values[-1]:
                return v, below, own
            below += own

    at, under, _ = cut([(p[2][dim], p[1]) for p in points], goal)
    rest = goal - under
    content, below, own = cut([(p[2]["d_content"], p[1]) for p in points if p[2][dim] == at], rest)
    with_it = below + own / 2 <= rest
    left = [p for p in points if p[2][dim] < at or p[2][dim] == at and (p[2]["d_content"] < content or with_it and p[2]["d_content"] == content)]
    gone = {p[0] for p in left}
    out = plain_tree(left, shards // 2, first, every)
    return out | plain_tree([p for p in points if p[0] not in gone], shards - shards // 2, first + shards // 2, every)


@pytest.mark.parametrize(("n", "shards", "hot"), [(1, 8, 0), (90, 8, 0), (300, 5, 120), (250, 8, 100)])
def test_shards_are_those_of_a_plain_tree(spark, monkeypatch, n, shards, hot):
    monkeypatch.setattr(sharding, "BINS", 7)
    r = random.Random(n)
    rows = [(k, "hot text" if k < hot else " ".join("w" * r.randint(1, 9) for _ in range(r.choice([1, 3, 3, 40]))), r.choice(["a", "a", "a", "b", None]), r.choice(["en", "de"])) for k in range(n)]
    docs = spark.createDataFrame([*rows, (n, None, "a", "en"), (n + 1, "", None, None)], "doc_id long, text string, source string, lang string")
    spot = lambda c: sharding._spot(F.coalesce(F.col(c), F.lit("")))
    body = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", body.alias("text"), (F.octet_length(body) + 1).alias("size"), F.xxhash64(body).alias("key"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    groups = facts.groupBy("text", "key", "size").agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    points = groups.select("text", "weight", F.log2("size").alias("d_size"), spot("source").alias("d_source"), spot("lang").alias("d_lang"), sharding._spot(F.col("key")).alias("d_content")).collect()
    plain = plain_tree([(p.text, p.weight, {d: p[d] for d in sharding.DIMS}) for p in points], shards)
    texts = {x.doc_id: x.text for x in facts.collect()}
    found = {x.doc_id: x.shard for x in sharding.kd_shards(docs, shards).collect()}
    assert found == {d: plain[t] for d, t in texts.items()}


def test_fullest_is_the_best_of_all_subsets():
    r = random.Random(6)
    for _ in range(300):
        sizes = sorted(r.sample(range(1, 40), r.randint(1, 5)), reverse=True)
        counts = [r.randint(0, 3) for _ in sizes]
        room = r.randint(0, 90)
        sums = {sum(n * k for n, k in zip(sizes, pick)) for pick in itertools.product(*[range(c + 1) for c in counts])}
        used = packing.fullest(np.array(sizes), np.array(counts), room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)
        assert all(0 <= k <= counts[sizes.index(n)] for n, k in used.items())


def test_each_sequence_is_as_full_as_its_longest_piece_lets_it():
    r = random.Random(7)
    sizes = np.array([r.randint(1, 30) for _ in range(60)])
    sequence, offset = packing.minimum_slack(sizes, 40)
    left = sorted(sizes.tolist(), reverse=True)
    for s in range(sequence.max() + 1):
        own = sizes[sequence == s]
        assert sorted(offset[sequence == s].tolist()) == np.concatenate(([0], np.cumsum(own[np.argsort(offset[sequence == s])])[:-1])).tolist()
        head = left.pop(0)
        assert own.max() == head
        sums = {0}
        for n in left:
            sums |= {x + n for x in sums if x + n <= 40 - head}
        assert own.sum() - head == max(sums)
        for n in sorted(own.tolist(), reverse=True)[1:]:
            left.remove(n)
    assert not left


def test_pieces_of_long_documents_are_the_tokenizers_slices(spark):
    from tokenizers import Tokenizer

    r = random.Random(8)
    texts = [" ".join(r.choice(["alpha", "Beta,", "gämma", "1234", "x\n\ny"]) for _ in range(n)) for n in (0, 5, 3000, 9000, 30_000)]
    tokenizer = Tokenizer.from_file(token_ids.vocabulary())
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in enumerate(texts)}
    for length in (4096, 1000):
        found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length).collect()
        for x in found:
            assert x.ids_crc32 == zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes()) and x.doc_tokens == len(ids[x.doc_id]) and x.length <= length
        for k, own in ids.items():
            pieces = sorted((x.start, x.length) for x in found if x.doc_id == k)
            assert [s for s, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) == len(own)
    assert max(len(x) for x in ids.values()) > 2 * 4096
