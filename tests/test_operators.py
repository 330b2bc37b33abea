"""Operators on rows written by hand."""

import shutil

from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import units
from paperloom.operators import diagnostics, flow, reports, runs
from paperloom.sources import tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_utf16_length_counts_astral_twice(spark):
    assert one(spark, t.utf16_length, "a😀b") == 4


def test_rounding_is_half_up_for_negatives(spark):
    assert one(spark, units.rounded, -2.5, "double") == -2
    assert one(spark, units.rounded, 2.5, "double") == 3


def test_white_space_of_every_script(spark):
    assert one(spark, t.visible_length, "a b　c﻿d") == 4


def test_entities_turn_back_the_ampersand_last(spark):
    assert one(spark, t.named_entities, "&amp;lt; &lt;b&gt;") == "&lt; <b>"
    assert one(spark, t.escaped, 'a<b>&"c"') == "a&lt;b&gt;&amp;&quot;c&quot;"


def test_occurrences_do_not_overlap(spark):
    rows = spark.createDataFrame([("a a aa", "aa"), ("x", "")], "a string, b string")
    assert [r[0] for r in rows.select(t.occurrences(F.col("a"), F.col("b"))).collect()] == [2, 0]


def test_codes(spark):
    assert one(spark, units.border_width, 99, "int") == 0.1
    assert one(spark, units.border_width, 15, "int") == 5.0
    assert one(spark, units.colour, 255, "long") == "#ff0000"
    assert one(spark, units.verdict, 18.0, "double") == "close"
    assert one(spark, units.verdict, None, "double") == "missing"


def test_blank_runs_keep_two(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(["", "", "", "a", "", " ", "", "b"])], "k int, i int, x string")
    assert sorted(r.i for r in flow.cap_blank_runs(rows, "k", "i", "x").collect()) == [0, 1, 3, 4, 5, 7]


def test_layout_of_published_cases(spark):
    """Content height 800: 500 and 400 take two pages, 1800 takes three."""
    rows = spark.createDataFrame([(1, 0, 500), (1, 1, 400), (2, 0, 1800)], "k int, i int, h int")
    got = sorted((r.k, r.i, r.page, r.y, r.fragments) for r in flow.place_blocks(rows, "k", "i", "h", 800).collect())
    assert got == [(1, 0, 0, 0, 1), (1, 1, 1, 0, 1), (2, 0, 0, 0, 3)]


def test_oversize_rows_stand_alone(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate([3, 20, 1, 0, 8])], "k int, i int, w int")
    got = sorted((r.i, r.page) for r in flow.paginate(rows, "k", "i", "w", 8).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)]


def test_pages_never_pass_the_budget_nor_lose_rows(spark):
    rows = spark.createDataFrame([(k, i, (i * 7 + k) % 9) for k in range(5) for i in range(40)], "k int, i int, w int")
    paged = flow.paginate(rows, "k", "i", "w", 10).join(rows, ["k", "i"])
    assert paged.count() == 200
    assert paged.groupBy("k", "page").agg(F.sum(F.greatest("w", F.lit(1))).alias("s")).where("s > 10").count() == 0


def test_slices_join_back(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, "")], "k int, x string")
    starts = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 5, "c"), (2, 0, "a")], "k int, at int, style string")
    got = sorted((r.run_no, r.slice) for r in runs.slice_by_starts(texts, starts, "k", "x", "at", "style").collect())
    assert "".join(s for _, s in got) == "hello world"


def test_runs_join_equal_neighbours_and_nulls(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "a"])], "k int, i int, s string")
    assert [r.run_no for r in runs.numbered_runs(rows, "k", ["i"], ["s"]).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_longest_run_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabbc")], "k int, i int, s string")
    assert tuple(runs.longest_run(rows, "k", ["i"], "s").first()) == (1, "a", 2)


def test_markers_leave_holes_for_levels_not_begun(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 0, 1, 2, 1, 0])], "k int, i int, n int")
    assert [r.marker for r in runs.list_markers(rows, "k", "i", "n", 3).orderBy("i").collect()] == [".1", "1", "1.1", "1.1.1", "1.2", "2"]


def test_chains_end_and_cycles_stop(spark):
    edges = spark.createDataFrame([(1, 1), (2, 1), (4, 2), (8, 4)], "a int, b int")
    got = {r.a: (r.final, r.steps) for r in reports.follow(edges, "a", "b").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 4: (1, 2), 8: (1, 3)}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "a int, b int")
    assert {r.a: (r.final, r.steps) for r in reports.follow(ring, "a", "b").collect()} == {1: (2, 4), 2: (2, 3), 3: (3, 3), 4: (4, 3)}
    long = spark.createDataFrame([(k, k + 1) for k in range(25)], "a int, b int")
    assert {r.a: (r.final, r.steps) for r in reports.follow(long, "a", "b").collect()}[3] == (18, 15)


def test_boxes_of_blocks(spark):
    """Margins of 100, content height 800: blocks without height take 1, a page with a block has no room for a full one, tall blocks go on."""
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 800), (2, 0, 1800), (2, 1, 700), (3, 0, None)], "k int, i int, h int")
    got = sorted((r.k, r.i, r.page, r.y, r.fragment, r.fragments, r.source_start, r.visible_height) for r in flow.layout_boxes(rows, "k", "i", "h", 1000, top=100, bottom=100).collect())
    assert got == [(1, 0, 0, 100, 0, 1, 0, 1), (1, 1, 1, 100, 0, 1, 0, 800), (2, 0, 0, 100, 0, 3, 0, 800), (2, 0, 1, 100, 1, 3, 800, 800), (2, 0, 2, 100, 2, 3, 1600, 200), (2, 1, 3, 100, 0, 1, 0, 700), (3, 0, 0, 100, 0, 1, 0, 1)]


def test_large_groups_stream(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 3).alias("w"))
    assert flow.paginate(rows, "k", "i", "w", 4).agg(F.max("page"), F.count("*")).first()[:] == (99_999, 300_000)


def test_the_latest_links_survive_a_restart(spark, tmp_path):
    from paperloom.streaming import links

    schema = "page_id long, html string"
    page = lambda k, *hrefs: spark.createDataFrame([(k, "".join(f'<a href="{h}">' for h in hrefs))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted((r.href, r.page_id, r.pos) for r in links.keep_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), 3).collect())
    page(1, "a", "b")
    assert run() == [("a", 1, 0), ("b", 1, 1)]
    page(2, "c", "b")
    assert run() == [("a", 1, 0), ("b", 2, 1), ("c", 2, 0)]
    assert run() == [("a", 1, 0), ("b", 2, 1), ("c", 2, 0)]


def test_upsert_keeps_the_last_and_the_first_place(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("v", 2, "b"), ("u", 3, "c")], "k string, seq int, x string")
    got = {r.k: (r.x, r.first_seen) for r in reports.last_by(rows, "k", F.col("seq"), ["x"]).collect()}
    assert got == {"u": ("c", 1), "v": ("b", 2)}


def test_formats(spark):
    rows = spark.createDataFrame([(b"PK\x03\x04x", "a.bin"), (b"\xef\xbb\xbf\n<a/>", "a"), (b"zz", "b.TXT"), (b"", "none")], "c binary, p string")
    assert [r[0] for r in rows.select(tables.container_format(F.col("c"), F.col("p"))).collect()] == ["zip", "xml", "txt", ""]


def markers(spark, *rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "d long, n long, kind string, list string, level int, start int, form string")
    return [r.marker for r in flow.list_markers(df, "d", "n", "kind", "list", "level", "start", "form").orderBy("n").collect()]


def test_list_markers_count_by_kind_and_list(spark):
    assert markers(spark, ("n", "1", 1, 1, None), ("n", "1", 2, 1, "^n)"), ("n", "2", 1, 3, ""), ("n", "1", 2, 1, "^N"), ("n", "1", 1, 1, "^n^^"), ("n", "1", 2, 1, "^n")) == ["1.", "1.1)", "3.", "1.2.", "2^", "2.1"]
    assert markers(spark, ("bullet", "1", 1, 1, " - "), ("bullet", "1", 1, 1, None), ("n", None, None, None, None)) == ["-", "•", "1."]


def chunks(spark, rows, **more):
    df = spark.createDataFrame([(1, i, w, s) for i, (w, s) in enumerate(rows)], "t long, r long, w long, s long")
    found = {}
    for r in flow.table_chunks(df, "t", "r", "w", "s", 4, **more).orderBy("chunk", "position").collect():
        found.setdefault(r.chunk, []).append(r.row)
    return list(found.values())


def test_tables_break_where_no_cell_reaches_on(spark):
    assert chunks(spark, [(2, 1), (1, 1), (3, 1), (2, 1)]) == [[0, 1, 2], [3]]
    assert chunks(spark, [(2, 1), (1, 1), (3, 1), (2, 1)], strict=True) == [[0, 1], [2], [3]]
    assert chunks(spark, [(2, 3), (2, 1), (2, 1), (2, 1)], strict=True) == [[0, 1, 2], [3]]
    assert chunks(spark, [(4, 1), (1, 3), (4, 1), (4, 1)], headers=1) == [[0], [0, 1, 2, 3]]
    assert chunks(spark, []) == []


def test_fragments_keep_a_paragraph_for_each(spark):
    df = spark.createDataFrame([(1, i, w, 3) for i, w in enumerate([5, 1, 1, 1, 1])] + [(2, 0, 9, 4)], "d long, n long, w long, k int")
    got = [(r.d, r.fragment) for r in flow.fragments(df, "d", "n", "w", "k").orderBy("d", "n").collect()]
    assert got == [(1, 0), (1, 1), (1, 1), (1, 1), (1, 1), (2, 0)]


def test_first_key_that_any_audit_has(spark):
    rows = spark.createDataFrame([(1, ["x", "a"]), (2, ["", None]), (3, ["b", "a"])], "r long, k array<string>")
    others = spark.createDataFrame([(7, ["a"]), (5, ["a", "c"]), (9, ["b"])], "o long, j array<string>")
    assert sorted(tuple(r) for r in reports.first_key_match(rows, "r", F.col("k"), others, "o", F.col("j")).collect()) == [(1, 5), (2, None), (3, 9)]


def test_streams_read_tables_in_folders(spark, tmp_path):
    """A link that fell off the list keeps its first place when it comes again, as in the SQL; files come one a batch."""
    from paperloom.plans import live
    from paperloom.streaming import links

    hrefs = [(1, ["a", "b"]), (2, ["c", "d", "e"]), (3, ["f", "b", "a"])]
    for k, found in hrefs:
        rows = spark.createDataFrame([(k, "".join(f'<a href="{h}">' for h in found))], "page_id long, html string")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "pages.parquet"))
    stream = links.page_stream(spark, str(tmp_path), files_a_batch=1)
    assert sorted((r.href, r.page_id) for r in links.keep_latest(stream, str(tmp_path / "out"), 2).collect()) == [("a", 3), ("b", 3)]
    assert sorted(map(tuple, live.stream_links(spark, str(tmp_path)).collect())) == sorted((k, h) for k, found in hrefs for h in found)
    assert live.stream_latest_links(spark, str(tmp_path)).count() == 6


def test_steps_sort_once(spark):
    """Counters, chunks and repeated heads need one sort of their keys, and words or runs are no rows of their own where they aren't asked for."""
    import io
    from contextlib import redirect_stdout

    from paperloom.operators import runs
    from paperloom.plans import web

    def plan(df):
        with redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()

    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 2, 0), (1, 3, 1), (1, 4, 2)], "k long, n long, v int")
    made = runs.list_markers(rows, "k", "n", "v", 3)
    assert [(r.n, r.v, r.marker) for r in made.orderBy("n", "v").collect()] == [(1, 0, "1"), (2, 0, "2"), (2, 1, "2.1"), (3, 1, "2.2"), (4, 2, "2.2.1")]
    assert plan(made).count("Sort [") == 1
    chunks = flow.table_chunks(rows, "k", "n", "v", "n", 2, headers=1)
    assert plan(chunks).count("Sort [") == 1
    split = flow.split_rows(rows, "k", "n", "v", 2)
    assert plan(split).count("MapInArrow") == 1
    assert sorted(tuple(r[c] for c in ("chunk", "position", "n", "repeated")) for r in split.collect()) == [(0, 0, 1, 0), (0, 1, 2, 0), (1, 0, 1, 1), (1, 1, 2, 0), (1, 2, 3, 0), (2, 0, 1, 1), (2, 1, 4, 0)]
    assert "Generate" not in plan(web.best_script_run(spark, "/root/testdata/sf0.001"))


def test_chunks_of_columns_of_any_name(spark):
    """The fold's own names are free for keys and orders; a table breaks after its weight, blocks and chunks fill pages of 20."""
    rows = spark.createDataFrame([(1, i, w, 1) for i, w in enumerate([3, 2, 2])], "_w long, row long, w long, s long")
    assert sorted(map(tuple, flow.table_chunks(rows, "_w", "row", "w", "s", 4).select("chunk", "position", "row").collect())) == [(0, 0, 0), (0, 1, 1), (1, 0, 2)]
    renamed = rows.toDF("row", "chunk", "w", "s")
    assert sorted(tuple(r)[1:] for r in flow.table_chunks(renamed, "row", "chunk", "w", "s", 4).collect()) == [(0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 2, 0)]
    blocks = spark.createDataFrame([(1, 1, 9), (1, 2, 9), (1, 3, 9)], "doc long, block long, weight long")
    cells = spark.createDataFrame([(1, 2, r, 9, 1) for r in range(3)], "doc long, block long, row long, weight long, span long")
    found = diagnostics.paginate_blocks(blocks, cells, "doc", "block", "weight", "row", "weight", "span", 20)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0, 0), (1, 2, 0, 1), (1, 2, 1, 2), (1, 3, 0, 2)]


def test_streams_read_tables_in_one_file_and_in_partitions(spark, tmp_path):
    from paperloom.plans import live
    from paperloom.streaming import links

    rows = spark.createDataFrame([(1, '<a href="x"><a href="y">'), (2, '<a href="x">')], "page_id long, html string")
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "made").glob("*.parquet")), tmp_path / "one" / "pages.parquet")
    assert sorted(map(tuple, live.stream_links(spark, str(tmp_path / "one")).collect())) == [(1, "x"), (1, "y"), (2, "x")]
    assert [(r.href, r.page_id) for r in live.stream_latest_links(spark, str(tmp_path / "one")).orderBy("href").collect()] == [("x", 2), ("y", 1)]
    rows.withColumn("day", F.col("page_id") + 6).write.partitionBy("day").parquet(str(tmp_path / "many" / "pages.parquet"))
    found = links.run_to_files(links.page_stream(spark, str(tmp_path / "many"), files_a_batch=1).select("page_id", "day"), str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, 8)]
