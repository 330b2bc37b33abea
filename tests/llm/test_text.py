"""Operators on texts against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import random
import shutil
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.llm import fm_index, graph, jaccard, mixing, packing, sharding, substring, textcore, token_ids, toxicity, url_filter
from tests.llm import brute

ROWS = brute.corpus()
CLASH = "class string, n int, node string, bucket int, token string, rest string, kept string, root int"


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")}) if extra else df


def test_words_of_a_batch():
    texts = ["a  b\tc", "", None, "é\x0bx", " lead", "trail "]
    data, at = textcore.raw(pa.array(texts).slice(0))
    w = textcore.Words(data, at)
    assert np.diff(w.first).tolist() == [len(brute.words(t)) for t in texts]
    assert len(set(w.hashes().tolist())) == 7


def test_lists_of_one_hash_are_one_word(monkeypatch):
    text = " ".join(f"word{k % 50}" for k in range(5000))
    data, at = textcore.raw(pa.array([text]))
    whole = textcore.Words(data, at).hashes()
    monkeypatch.setattr(textcore, "SPAN", 100)
    assert (textcore.Words(data, at).hashes() == whole).all() and len(set(whole.tolist())) == 50


@pytest.mark.parametrize("text", [[1, 2, 3, 1, 2, 3, 0], [1, 1, 1, 1, 0, 1, 1, 0], [2, 0]])
def test_fm_index_counts_patterns(text):
    index = fm_index.FMIndex(np.array(text), max(text) + 1, 3)
    for pattern in ([1], [1, 2], [1, 1, 1], [2, 3, 1], [3, 3]):
        if max(pattern) <= max(text):
            lo, hi = index.ranges(np.array([pattern]), False)
            assert max(0, hi[0] - lo[0]) == sum(text[k : k + len(pattern)] == pattern for k in range(len(text)))


def test_substring_dedup(spark):
    expected = brute.repeats(ROWS)
    found = substring.remove_repeats(frame(spark, ROWS)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256), "rest").collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in found} == expected and len(found) == len(ROWS)
    assert "class" in found[0].rest.asDict()
    assert sum(v[1] for v in expected.values()) > 1000


def test_substring_dedup_splits_the_anchor_of_a_hot_line(spark, monkeypatch):
    r, line = random.Random(5), " ".join(f"hot{k}" for k in range(8))
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{prose(15)} {line} {prose(15)}") for k in range(400)]
    rows += [(1000 + k, f"{prose(9)} {rows[k][1]}") for k in range(0, 400, 9)]  # whole repeats
    rows += [(2000 + k, f"{prose(20)} {' '.join(rows[k][1].split()[12:26])} {prose(5)}") for k in range(0, 400, 7)]  # the line and five words beside it
    r.shuffle(rows)
    monkeypatch.setattr(substring, "BUCKET", 8 << 10)
    met, meeting = [], substring._meeting

    def watched(*args):
        met.append(meeting(*args))
        return met[-1]

    monkeypatch.setattr(substring, "_meeting", watched)
    expected = brute.repeats(rows)
    found = substring.remove_repeats(frame(spark, rows), split=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert {x[0]: (x[1], x[2], x[3]) for x in found} == expected and len(found) == len(rows)
    assert sum(v[1] for v in expected.values()) > 1000
    most = lambda fragments: fragments.groupBy("anchor").agg(F.countDistinct("content").alias("n")).agg(F.max("n")).first()[0]
    assert most(met[0]) <= 20
    substring.remove_repeats(frame(spark, rows))
    assert most(met[1]) > 300  # what one task would get unsplit


def test_substring_dedup_of_rows_without_ids(spark):
    text = " ".join(f"q{k}" for k in range(20))
    rows = [(None, text), (None, text), (5, text), (5, text), (7, text), (-2, "a")]
    found = sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert found == [("-2", 0), ("5", 0), ("5", 0), ("7", 20), ("None", 0), ("None", 0)]
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_small_indexes_give_the_same(monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 40, 400).astype(np.uint32)
    codes = [base[s : s + n] for s, n in zip(r.integers(0, 350, 60), r.integers(13, 40, 60))]
    first = np.arange(60)[::-1].copy()
    checks = [np.array([zlib.crc32(c[k : k + 13].tobytes()) for k in range(len(c) - 12)], np.uint32) for c in codes]
    whole = substring.first_places(codes, checks, first, 13)
    want = {}
    for c, low in zip(codes, first):
        for k in range(len(c) - 12):
            want[c[k : k + 13].tobytes()] = min(want.get(c[k : k + 13].tobytes(), low), low)
    assert all(x.tolist() == [want[c[k : k + 13].tobytes()] for k in range(len(c) - 12)] for c, x in zip(codes, whole))
    monkeypatch.setattr(substring, "INDEX", 100)
    assert all((a == b).all() for a, b in zip(whole, substring.first_places(codes, checks, first, 13)))


def test_words_that_share_a_code_stay(spark):
    """Pairs of words whose hashes agree in the 32 bits that fragments carry, behind twelve common words and before twelve more."""
    made = [f"q{k:x}" for k in range(400_000)]
    low = textcore.Words(*textcore.raw(pa.array([" ".join(made)]))).hashes() & np.uint64(0xFFFFFFFF)
    by = np.argsort(low, kind="stable")
    twin = by[:-1][low[by][1:] == low[by][:-1]], by[1:][low[by][1:] == low[by][:-1]]
    assert len(twin[0]) > 5
    rows = []
    for i, (a, b) in enumerate(zip(*twin)):
        before, after = (" ".join(f"{s}{i}x{k}" for k in range(12)) for s in "mn")
        rows += [(2 * i, f"{before} {made[a]} {after}"), (2 * i + 1, f"{before} {made[b]} {after}")]
    for split in (4096, 0):
        assert {r.n_removed for r in substring.remove_repeats(frame(spark, rows), split=split).select("n_removed").collect()} == {0}


def test_ngram_jaccard(spark):
    found = jaccard.near_duplicates(frame(spark, ROWS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near(ROWS) and len(found) == len(ROWS)


def test_ngram_jaccard_of_a_large_group(spark, monkeypatch):
    """Near copies of one text, most of them linked through others only; small shards and rounds."""
    monkeypatch.setattr(jaccard, "FAN", 16)
    base = [f"b{k}" for k in range(100)]
    r = np.random.default_rng(1)
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.integers(0, 100, 3):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert found == brute.near(rows)


def test_ngram_jaccard_edges(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "A B C D E F"), (9, None), (8, ""), (1, "a b")]
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert found == [("1", 1, 1), ("4", 2, 4), ("4", 2, 4), ("8", 0, 8), ("9", 0, 9), ("None", 2, 4)]
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_components_in_rounds(spark, monkeypatch):
    r = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)] + [(None, 3), (7, None)]
    df = spark.createDataFrame(edges, 'a long, b long')
    want = brute.union([e for e in edges if None not in e], range(450))
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, 'SMALL', small)
        got = {x.node: x.component for x in graph.components(df, 'a', 'b').collect()}
        assert got == {n: want[n] for e in edges if None not in e and e[0] != e[1] for n in e}
    assert graph.components(df.limit(0), 'a', 'b').count() == 0


def test_divide_skip_against_counting():
    r = np.random.default_rng(2)
    sets = [textcore.distinct(r.choice(60, r.integers(1, 50)).astype(np.uint64)) for _ in range(200)]
    lists = jaccard.Lists(sets)
    for q in sets[:60]:
        want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))}
        assert {int(lists.order[k]) for k in lists.search(q, 80)} == want


def test_heap_merge_skips_nothing_that_counts():
    r = np.random.default_rng(7)
    for least in (1, 2, 5, 9):
        lists = [np.unique(r.integers(0, 60, r.integers(0, 30))).tolist() for _ in range(12)]
        flat, at = sum(lists, []), np.cumsum([0, *map(len, lists)]).tolist()
        times = Counter(flat)
        assert jaccard.heap_merge(flat, list(zip(at, at[1:])), least) == sorted((v, c) for v, c in times.items() if c >= least)


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_runs_do_not_depend_on_batches(batch):
    r = np.random.default_rng(4)
    rows = sorted(zip(r.integers(0, 40, 300).tolist(), r.choice([10, 11, 30], 300).tolist(), r.integers(0, 30, 300).tolist()))
    t, n, c = (np.array(x) for x in zip(*rows))
    cut = lambda x, k: pa.array(x[k : k + batch])
    made = [pa.RecordBatch.from_arrays([cut(t, k), cut(c, k), cut(n.astype(np.int32), k), cut(np.zeros(300, np.int32), k)], ["token", "class", "n", "core"]) for k in range(0, 300, batch)]
    got = {}
    for b in jaccard._runs(80)(iter(made)):
        for run, *row, _ in zip(*(y.to_pylist() for y in b.columns)):
            got.setdefault(run, []).append(tuple(row))
    want, run = [], []
    for row in [*zip(t.tolist(), c.tolist(), n.tolist()), (None, None, 0)]:
        if run and (row[0] != run[-1][0] or row[2] * 80 > run[-1][2] * 100):
            want += [[x[1:] for x in run]] if len(run) > 1 else []
            run = []
        if not run or row != run[-1]:
            run.append(row)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_long_words_have_their_own_hashes(spark):
    """Thue-Morse words, which polynomials modulo a power of two can't tell apart."""
    morse = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    for n in (1024, 2048, 4096):
        a, b = morse[:n], morse[:n].translate(str.maketrans("ab", "ba"))
        assert len(set(textcore.Words(*textcore.raw(pa.array([f"{a} {b}"]))).hashes().tolist())) == 2
        rows = [(0, f"x y z {a} u v"), (1, f"x y z {b} u v")]
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()} == {0: 0, 1: 1}
        rest = " ".join(f"w{k}" for k in range(12))
        assert [r.n_removed for r in substring.remove_repeats(frame(spark, [(0, f"{rest} {a}"), (1, f"{rest} {b}")])).collect()] == [0, 0]


def test_keep_one_goes_by_rows(spark):
    text, other = "a b c d e f g", "h i j k l m n"
    rows = [(4, text), (4, text.upper()), (7, text), (7, other), (9, other), (None, other), (None, "p q r s t u"), (None, "p q r s t u"), (3, None), (3, None), (8, "")]
    kept = sorted((str(r.doc_id), r.text) for r in jaccard.keep_one(frame(spark, rows)).withColumn("text", F.lower("text")).collect())
    assert kept == sorted([("4", text), ("7", other), ("None", "p q r s t u"), ("3", None), ("3", None), ("8", "")], key=lambda x: (x[0], x[1] is None, x[1]))
    assert jaccard.keep_one(frame(spark, rows)).columns == frame(spark, rows).columns
    assert jaccard.keep_one(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [*ROWS, (None, "first"), (3, "again, again.")]
    odd = ["foo<|endoftext|>bar", "It's 11 1 o'clock.", "e\u0301 é", "\ufeffx", "<|ENDOFTEXT|>."]
    rows += [(1000 + k, t) for k, t in enumerate(odd)]
    to = str(tmp_path / "tokens")
    token_ids.write_tokens(frame(spark, rows), to)
    tokenizer = Tokenizer.from_file(token_ids.vocabulary())
    at = 0
    found = {(r.doc_id, r.ids_crc32): r for r in token_ids.read_digests(spark, to).collect()}
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "").encode())):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        r = found[i, zlib.crc32(np.array(ids, "<u4").tobytes())]
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)


def test_vocabularies_that_span_white_space_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        token_ids.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files_are_in_order_of_their_numbers(spark, tmp_path):
    """part-100000 comes after part-99999, though not as text."""
    for number, doc in ((99999, 1), (100000, 2)):
        token_ids.write_tokens(frame(spark, [(doc, f"text {doc}")]), str(tmp_path / "one"))
        found = next((tmp_path / "one").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        found.rename(tmp_path / "all" / found.name.replace("part-00000", f"part-{number}"))
        shutil.rmtree(tmp_path / "one")
    assert sorted((r.start, r.doc_id) for r in token_ids.read_digests(spark, str(tmp_path / "all")).collect()) == [(0, 1), (3, 2)]


def test_token_files_serve_selective_reads(spark, tmp_path):
    """Dictionary-encoded ids, delta-encoded metadata, page indexes, and a filter that reaches the scan."""
    token_ids.write_tokens(frame(spark, [(k, f"text {k % 9} again") for k in range(3000)]).withColumn("lang", F.lit("en")), str(tmp_path / "t"))
    file = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet")))
    group = file.metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    some = spark.read.parquet(str(tmp_path / "t")).where("doc_id between 100 and 120").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "tokens" not in plan.split("ReadSchema")[1].replace("n_tokens", "")
    assert some.count() == 21


def test_operators_keep_columns_of_any_name(spark):
    rows = [(k, f"word{k} text") for k in range(40)] + [(None, None), (3, "")]
    names = ["_evidence", "_score", "row", "score", "_source", "_lang", "_topic", "_tokens", "_chance", "class", "root", "judged", "id", "stays", "set"]
    docs = frame(spark, rows, False).withColumns({n: F.lit("own") for n in names})
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    for out in (toxicity.reject(docs, labels, 2.0), mixing.sample(docs, budget=1e9), jaccard.keep_one(docs)):
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) == len(rows) and all(r[n] == "own" for r in found for n in names)
    pages = spark.createDataFrame([(1, "http://a.org/", "own")], "page_id int, url string, _best string")
    assert url_filter.judge(pages).first()["_best"] == "own" and url_filter.judge(pages.limit(0)).count() == 0


def test_mixing_tells_what_it_cannot_reach(spark):
    docs = spark.createDataFrame([(0, "a b c", "en", "x"), (1, "d e f", "de", "y")], "doc_id long, text string, lang string, source string")
    targets = {"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    with pytest.raises(ValueError, match="targets"):
        mixing.mix(docs, targets=targets, tolerance=0.01)
    assert mixing.mix(docs, targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.9, "de": 0.1}}, tolerance=0.01).count() == 2


def plain_kneser_ney(texts, order, discount):
    """P(byte | the order - 2 before it) from how many different bytes come before each gram, by dictionaries."""
    every = set()
    for t in texts:
        s = b" " * order + bytes(t)
        every |= {s[k - order + 1 : k + 1] for k in range(order, len(s))}
    before = {}
    for g in every:
        for k in range(1, order):
            before.setdefault(g[-k:], set()).add(g[-k - 1])

    def p(g):
        if not g:
            return 1 / 256
        same = [x for x in before if len(x) == len(g) and x[:-1] == g[:-1]]
        total = sum(len(before[x]) for x in same)
        return (max(len(before.get(g, ())) - discount, 0) + discount * len(same) * p(g[1:])) / total

    return {g: p(g) for g in before if len(g) == order - 1}


def test_kneser_ney_by_dictionaries(spark):
    rows = [(0, "The cat sat, the cat"), (1, "a cat!! ate"), (2, "that hat"), (3, "that hat"), (4, None), (5, ""), (6, "Ünï 12")]
    normal = [b"the cat sat the cat", b"a cat ate", b"that hat", b"that hat", b"", b"", "Ünï 12".encode()]
    docs = frame(spark, rows)
    shared = {r.gram: r.p for r in toxicity.shared_model(docs.select("text")).collect()}
    want = {int.from_bytes(g): v for g, v in plain_kneser_ney(normal, toxicity.ORDER, toxicity.DISCOUNT).items()}
    assert shared.keys() == want.keys() and all(abs(shared[g] - want[g]) < 1e-12 for g in want)
    counts = {}
    for t, c in zip(normal, (0, 0, 1, 1, 1, 0, 0)):
        s = b" " * toxicity.ORDER + t
        for g in {s[k - toxicity.ORDER + 1 : k + 1] for k in range(toxicity.ORDER, len(s))}:
            counts.setdefault(int.from_bytes(g), [0, 0])[c] += 1
    model = toxicity.Model(toxicity.ratios(spark.createDataFrame([(g, t, o) for g, (o, t) in counts.items()], "gram long, toxic long, ordinary long"), toxicity.shared_model(docs.select("text"))).toPandas())

    def p(g, c):
        same = [n[c] for x, n in counts.items() if x >> 8 == g >> 8]
        freed = sum(min(n, toxicity.DISCOUNT) for n in same) + toxicity.PRIOR
        mine = counts.get(g, (0, 0))[c]
        return (max(mine - toxicity.DISCOUNT, 0) + freed * want[g & ((1 << 8 * toxicity.ORDER - 8) - 1)]) / (sum(same) + toxicity.PRIOR)

    for g in counts:
        assert abs(model.ratio(np.array([g]))[0] - np.log(p(g, 1) / p(g, 0))) < 1e-5
    assert model.ratio(np.array([int.from_bytes(b"zzzzz")]))[0] == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*ROWS, (None, "x"), (None, "x"), (3, "again")]
    found = packing.pack(frame(spark, rows), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(token_ids.vocabulary())
    wanted = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows]
    assert sum(r.length for r in found) == sum(len(x) // 4 for x in wanted)
    assert sorted(r.ids_crc32 for r in found if r.start == 0 and r.length == r.doc_tokens) == sorted(zlib.crc32(x) for x in wanted if len(x) <= 4 * 4096)
    sequences = {}
    for r in found:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(frame(spark, [])).count() == 0


def test_minimum_slack_fills_sequences():
    sizes = np.random.default_rng(6).integers(1, 4096, 3000)
    number, offset = packing.minimum_slack(sizes, 4096)
    full = np.bincount(number, sizes)
    assert full.max() <= 4096 and full.mean() > 0.97 * 4096
    used = packing.fullest(np.array([7, 5, 3]), np.array([1, 2, 1]), 12)
    assert sum(n * c for n, c in used.items()) == 12


def test_sharding(spark):
    rows = [*ROWS, (None, "x"), (None, "x"), (3, ROWS[3][1])]
    found = sharding.kd_shards(frame(spark, rows), 4).collect()
    assert len(found) == len(rows)
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    homes = {}
    for r in found:
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert sorted(r.size for r in found) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sharding.kd_shards(frame(spark, []), 8).count() == 0


def test_shards_are_near_equal(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 97).cast("int")).alias("t"), (F.col("id") % 3).cast("string").alias("source"))
    rows = rows.withColumn("text", F.concat("t", F.col("doc_id").cast("string")))
    total = [r[0] for r in sharding.kd_shards(rows, 8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(total) == 8 and max(total) - min(total) < 0.01 * sum(total)


def test_mixing_reaches_its_targets(spark):
    rows = [(k, " ".join(["w"] * (10 + k % 90)), "de" if k % 3 else "en", f"s{k % 4}" if k % 2 else "s0") for k in range(600)]
    docs = spark.createDataFrame([*rows, (None, None, None, None), (9999, "", "en", "s1")], "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s3": 0.25}, "lang": {"en": 0.5, "de": 0.5}}
    found = mixing.mix(docs, targets=targets, temper={}).toPandas()
    assert len(found) == 602
    got = (found.tokens * found.weight).groupby(found.source).sum() / (found.tokens * found.weight).sum()
    assert abs(got["s0"] - 0.4 / 0.95) < 1e-4 and abs(got["s1"] - 0.3 / 0.95) < 1e-4  # no other source has words
    assert found.probability.between(0, 1).all() and found.probability.max() == 1
    wanted = brute_rates(found, targets)
    for key, weight in wanted.items():
        mine = found[(found.source == key[0]) & (found.lang == key[1]) & (found.topic == key[2]) & (found.tokens > 0)].weight.iloc[0]
        assert abs(mine - weight) < 1e-4
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.sample(docs, targets=targets, temper={}).count() == int(found.sampled.sum())


def test_mixing_keeps_the_corpus_beside_tiny_and_null_sources(spark):
    rows = [(k, " ".join(["w"] * (5 if k % 20 < 2 else 100)), "en", f"s{k % 5}" if k % 2 else "s0") for k in range(2000)]
    docs = spark.createDataFrame([*rows, (5000, "a b c d e", "en", None), (5001, "a b c", "en", "tiny")], "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs)
    found = mixed.toPandas()
    seen = found.groupby("source").tokens.sum()
    want = seen**0.7 / (seen**0.7).sum()
    both = (found.tokens * found.weight.clip(upper=1)).sum()
    assert both > 0.8 * seen.sum()
    assert abs((found.tokens * found.probability).sum() / both - 1) < 1e-6
    assert (found[found.source.isin(["(none)", "tiny"])].probability == 1).all()
    assert mixing.sample(docs).count() == int(found.sampled.sum()) > 0.75 * len(found)
    got = mixing.reached(mixed).toPandas()
    got = got[got.margin == "source"].set_index("category")
    assert all(abs(got.wanted[s] - want[s]) < 1e-4 for s in seen.index)
    assert abs(got.reached["s0"] - want["s0"]) < abs(got.observed["s0"] - want["s0"])
    for budget in (150_000, 10**7):
        some = mixing.mix(docs, budget=budget).toPandas()
        assert abs((some.tokens * some.probability).sum() / min(budget, seen.sum()) - 1) < 1e-6
        low = some[(some.probability < 1)]
        scale = low.probability / low.weight
        assert low.empty or (scale.max() / scale.min() < 1 + 1e-9 and (some[some.probability == 1].weight * scale.max() >= 1 - 1e-9).all())


def brute_rates(found, targets):
    cells = found[found.tokens > 0].groupby(["source", "lang", "topic"]).tokens.sum().to_dict()
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    margin = lambda j, of: {x: sum(v for k, v in of.items() if k[j] == x) for x in {k[j] for k in of}}
    want = []
    for j, name in enumerate(("source", "lang", "topic")):
        seen = margin(j, {k: v / total for k, v in cells.items()})
        given = targets.get(name, {})
        spare, free = 1 - sum(given.values()), sum(v for x, v in seen.items() if x not in given)
        t = {x: given.get(x, spare * v / free if free else 0) for x, v in seen.items()} if given else seen
        want.append({x: v / sum(t.values()) for x, v in t.items()})
    for _ in range(200):
        for j in range(3):
            now = margin(j, w)
            w = {k: v * want[j][k[j]] / now[k[j]] for k, v in w.items()}
    return {k: v / (cells[k] / total) for k, v in w.items()}


def test_url_filter(spark):
    urls = ["http://a.ORG/x", "https://example.org/es/1", "https://www.example.org/es", "http://example.org/en/12?q", "http://example.com/fr/", "x://b.com/de/1#f", "http://org", "http://org:80/", "noscheme", None, "", "http://aorg/", "http://x.example.org?/es/", "a://b://c.org/"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id int, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).orderBy("page_id").collect()]
    assert [g[2] for g in got] == ["org/", "example.org/es/", "org/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None, None, None]
    assert [g[3] for g in got] == ["allow", "block", "allow", "block", "allow", "block"] + ["allow"] * 8
    assert got[0][:2] == ("a.org", "/x") and got[9][:2] == ("", "") and got[13][:2] == ("b:", "//c.org/")


def test_toxicity_learns_from_training_labels_only(spark):
    r = np.random.default_rng(8)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(600):
        w = r.choice(plain, 40).tolist()
        toxic = i % 5 == 0
        if toxic:
            for k in r.integers(0, 40, 4):
                w[k] = r.choice(["scumbag", "moronic", "trashy"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if toxic else 0))
    docs, known = frame(spark, [*rows, (None, "word1"), (9000, None), (9001, "")]), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    found = toxicity.score(docs, known).toPandas()
    assert len(found) == 603 and found.score.between(0, 1).all()
    held = found[found.held_out & (found.doc_id < 600)]
    assert set(held.doc_id.astype(int)) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert ((held.score >= 0.3) == (held.doc_id % 5 == 0)).mean() > 0.95
    lied = known.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, lied).toPandas()
    key = lambda f: sorted((str(a), round(b, 9)) for a, b in zip(f.doc_id, f.score))
    assert key(again) == key(found)
    assert toxicity.score(docs, known.limit(0)).count() == 603
    assert toxicity.reject(docs.limit(0), known).count() == 0


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
from paperloom.llm import textcore, toxicity
kind, limit = sys.argv[1:]
n = (64 << 20) // 6 * 6
text = b"x" * n if kind == "word" else (b"abcde " * (n // 6 + 1))[:n]
column = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, n], np.int32)), pa.py_buffer(text)])
data, at = textcore.raw(column)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
sets = list(textcore.shingle_sets(column))
distinct = toxicity.distinct_of(data, 0, n)
assert len(sets[0]) == 1 and len(distinct) < 13
used = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10
assert used < int(limit), used
"""


@pytest.mark.parametrize(("kind", "limit"), [("word", 150), ("text", 400)])
def test_long_texts_take_bounded_memory(kind, limit):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", LONG, kind, str(limit)], check=True, env=os.environ | {"PYTHONPATH": root}, timeout=300)


def test_words_in_parts_are_those_of_the_whole(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("ab  \té") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["x" * 500, " " * 300, "", "y " * 200]
    data, at = textcore.raw(pa.array(texts))
    whole = textcore.Words(data, at)
    said = whole.hashes()
    for span in (1, 2, 7, 64):
        monkeypatch.setattr(textcore, "SPAN", span)
        part = textcore.Words(data, at)
        assert (part.start == whole.start).all() and (part.end == whole.end).all() and (part.first == whole.first).all()
    assert [w for w in (data[a:b].tobytes() for a, b in zip(whole.start, whole.end))] == [w for t in texts for w in t.encode().split()]
    monkeypatch.setattr(textcore, "SPAN", 64)
    assert (textcore.Words(data, at).hashes() == said).all()


def test_grams_of_a_long_text_in_parts(monkeypatch):
    r = random.Random(9)
    text = "".join(r.choice("abC .,-é7") for _ in range(900))
    data, at = textcore.raw(pa.array([text]))
    whole = toxicity.grams(data, at)[0]

    class Any:
        value = staticmethod(lambda gram: (gram % 7 - 3).astype(np.float32))

    model = toxicity.Model.__new__(toxicity.Model)
    model.ratio = Any.value
    said = model.evidence(data, at)
    for span in (1, 3, 50, 899):
        monkeypatch.setattr(toxicity, "SPAN", span)
        assert np.concatenate(list(toxicity.walked(data, 0, len(data)))).tolist() == whole.tolist()
        assert toxicity.distinct_of(data, 0, len(data)).tolist() == np.unique(whole).tolist()
        assert abs(model.evidence(data, at) - said).max() < 1e-9
    short, at = textcore.raw(pa.array(["a b"]))
    monkeypatch.setattr(toxicity, "SPAN", 1 << 20)
    said = model.evidence(short, at)
    monkeypatch.setattr(toxicity, "SPAN", 1)
    assert abs(model.evidence(short, at) - said).max() < 1e-9


def test_a_batch_is_let_go_before_the_next_is_read():
    held = []

    def batches():
        for k in range(3):
            batch = pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["a b"]})
            told = weakref.ref(batch)
            yield batch
            del batch
            held.append(told() is not None)

    for out in token_ids._encode(token_ids.vocabulary())(batches()):
        del out
    assert held == [False] * 3
