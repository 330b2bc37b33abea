"""The pipeline's stages, each on what the one before kept, and the queries beside their SQL."""

import pytest

import corpus_pipeline
from paperloom.llm.queries import ORACLES, QUERIES
from paperloom.llm.store import save
from tests.compare import connect, difference
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None


def test_stages_take_nulls_repeats_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, None, None, None, None), (None, text, "en", None, 9), (1, text, None, "s", None), (1, text, "en", "s", 3), (2, "", "en", "s", 0), (3, f"other words here {text}", "en", "s", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {"toxicity": 7, "ngram_jaccard": 4, "substring_dedup": 4}
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = save(stage(spark, now, SF), name)
            assert now.columns == docs.columns
            assert now.count() == (left.get(name, now.count()) if some is docs else 0)
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert pieces.count() == now.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "ngram_jaccard":
            found = brute.near([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (n, c) in found.items() if n == 0 or c == i}
        if name == "substring_dedup":
            found = brute.repeats([(i, r.text) for i, r in before.items()])
            assert set(after) == set(before)
            assert all(len(brute.words(after[i].text)) == n - gone for i, (n, gone, _) in found.items())
            assert all(after[i].text == before[i].text for i, (_, gone, _) in found.items() if not gone)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(before)


def test_run_leaves_only_what_its_result_reads(spark):
    from pathlib import Path

    from paperloom.llm import store

    base = Path(store.shared_dir(spark).removeprefix("file:")) / "paperloom"
    before = set(base.iterdir()) if base.exists() else set()
    rows = corpus_pipeline.run(spark, SF)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(base.iterdir()) - before)
    assert [n for n in left if n in {"toxicity", "ngram_jaccard", "substring_dedup"}] == [] and "mixing" in left
    assert not {"grams", "counts", "shared", "labelled"} & set(left)
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    one = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    assert one(rows) == one(now)
