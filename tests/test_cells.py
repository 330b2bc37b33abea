"""Rules of cells and diagnostics where columns are null, at the edges, and over nothing."""

from pyspark.sql import functions as F

from paperloom.functions import cells as f
from paperloom.operators import diagnostics, nodes

BLOCKS = "k long, page long, kind string, text_runs long, inline boolean, header_rows long, page_break string, explicit boolean, overlap boolean, keep boolean, wrap string, horz string, vert string"
CELLS = "k long, page long, col_span long, row_span long, height double, content_height double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_labels(spark):
    rows = [("가 나 다 라", ["가 나", "다 라"]), ("가\n나 다  라 마", ["가 나", "다 라", "마"]), ("가 나 다", None), ("가 나 다 x", None), ("가 나 다 라 마 바 사 아 자", None), (None, None), ("", None)]
    found = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(f.stacked_lines(F.col("t"))).collect()
    assert [r[0] for r in found] == [x for _, x in rows]
    label = lambda *a: f.is_group_label(*[F.lit(x) for x in a])
    assert list(one(spark, label("구분", 2, 1, 0, False), label("구분", 1, 1, 0, False), label("구분", 2, 2, 0, False), label("구분", 2, 1, 2, False), label("구1", 2, 1, 0, False), label(" ", 2, 1, 0, False), label("가\n나\n다\n라", 2, 1, 0, False), label("x" * 19, 2, 1, 0, False), label("x" * 18, 2, None, None, None), label(None, 2, 1, 0, False))) == [True, False, False, False, False, False, False, False, True, False]


def test_headers(spark):
    cell = lambda text, span=1, nested=False: F.struct(F.lit(text).alias("text"), F.lit(span).cast("int").alias("row_span"), F.lit(nested).alias("nested"))
    head = lambda row, *cells: f.is_compact_header(F.lit(row), F.array(*cells))
    a = cell("a")
    assert list(one(spark, head(0, a, a, a), head(1, a, a, a), head(0, a, a), head(0, *[a] * 7), head(0, a, a, cell("")), head(0, a, a, cell("x" * 19)), head(0, a, a, cell("b", 2)), head(0, a, a, cell("b", None, True)), head(0, a, a, cell("b", None)))) == [True, False, False, False, False, False, False, False, True]
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    both = lambda titles, tables, row=0, span=4, columns=4: f.is_composite_header(F.lit(row), F.lit(span), F.lit(columns), words(*titles), words(*tables))
    assert list(one(spark, both(["휴가 신청", " "], ["담\n당 결 재"]), both(["a"], ["x"]), both([], ["결재"]), both(["a"], ["결재", "결재"]), both(["a"] * 4, ["결재"]), both(["등록신청서"], ["결재"]), both(["a"], ["결재"], 1), both(["a"], ["결재"], 0, 3), both(["a"], []))) == [True] + [False] * 8
    assert [r[0] for r in spark.createDataFrame([("등 록\n신 청 서",), ("접수번호 ① ② ③",), ("접수번호 ① ②",), (None,)], "t string").select(f.is_primary_form(F.col("t"))).collect()] == [True, True, False, False]


def test_counters_of_pages(spark):
    blocks = [
        (1, 0, "table", None, False, 1, "CELL", True, True, None, "square", "PAGE", None), (1, 0, "table", 9, None, None, None, None, True, True, "square", "page", "page"), (1, 0, None, 2, None, None, None, True, True, True, "x", "page", "para"),
        (1, 1, "image", 5, True, None, None, True, None, True, " ", "column", "Paragraph"), (1, 1, "equation", 1, None, None, None, True, None, None, None, None, None), (2, None, "textbox", 1, None, 3, "CELL", True, False, False, "top-and-bottom", None, None), (None, 0, "ole", None, None, None, None, None, None, None, None, None, None),
    ]
    cells = [(1, 0, 2, None, 11_999.0, None), (1, 0, 1, 1, None, 12_000.0), (3, 0, None, 3, None, None)]
    found = {(r.k, r.page): r for r in diagnostics.page_counters(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(cells, CELLS), "k", "page").collect()}
    r = found[1, 0]
    assert (r.controls, r.tables, r.text_runs, r.floating_tables, r.wrapped_controls, r.overlap_allowed, r.keep_with_anchor, r.repeat_header_tables, r.page_break_tables, r.page_anchored, r.merged_cells, r.tall_cells, r.control_types) == (2, 2, 2, 1, 1, 1, 0, 1, 1, 1, 1, 1, {"table": 2})
    r = found[1, 1]
    assert (r.controls, r.pictures, r.equations, r.text_runs, r.floating_pictures, r.wrapped_controls, r.keep_with_anchor, r.column_anchored, r.paragraph_anchored, r.control_types) == (2, 1, 1, 1, 0, 0, 1, 1, 1, {"picture": 1, "equation": 1})
    assert found[2, None].shapes == 1 and found[2, None].page_break_tables == 0 and found[None, 0].oles == 1 and found[3, 0].merged_cells == 1 and found[3, 0].control_types == {}
    sums = {r.k: r for r in diagnostics.document_counters(diagnostics.page_counters(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(cells, CELLS), "k", "page"), "k").collect()}
    assert (sums[1].pages, sums[1].controls, sums[1].control_types, sums[3].pages, sums[3].control_types) == (2, 4, {"equation": 1, "picture": 1, "table": 2}, 1, {})
    empty = diagnostics.page_counters(spark.createDataFrame([], BLOCKS), spark.createDataFrame([], CELLS), "k", "page")
    assert empty.count() == diagnostics.document_counters(empty, "k").count() == 0


def test_text_in_noise(spark):
    noise = "\x00\x01"
    rows = [f"{noise}short 가{noise}" + "가나" * 30 + "x" * 40 + noise + "abc 다" * 5, noise, "", None, "가" * 49, "가" * 50 + noise + "나" * 50]
    found = spark.createDataFrame([(x,) for x in rows], "x string").select(diagnostics.best_run(F.col("x")).alias("a"), diagnostics.best_run(F.col("x"), least=5, strict=False).alias("b"), diagnostics.legible(F.col("x")).isNotNull().alias("c")).collect()
    assert [r.a for r in found] == ["가나" * 30 + "x" * 40, None, None, None, None, "가" * 50]
    assert [r.b and len(r.b) for r in found] == [100, None, None, None, 49, 50]
    assert [r.c for r in found] == [True, False, False, False, True, True]


def test_budgets_ages_and_paths(spark):
    budget = lambda *a: diagnostics.page_budget(*[F.lit(x) for x in a])
    assert list(one(spark, budget(84_188, 5668, 4252, 4252, 4252, "hwp"), budget(84_188, 5668, 4252, 4252, 4252, "hwpx"), budget(84_188, None, None, 4252, None, "owpml"), budget(None, 1, 1, 1, 1, "hwp"), budget(100, 60, 60, 0, 0, "hwp"), budget(10_000, 0, 0, 0, 0, "hwp"), budget(10**7, 0, 0, 0, 0, "hwp"))) == [50, 29, 53, 46, 46, 16, 200]
    rows = spark.createDataFrame([(1, "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-04 01:00:00", None), (2, "x", None, "2024-01-01", None), (3, None, None, None, "gone"), (4, "2024-01-02", None, "2024-01-02", None)], "k long, g string, v string, n string, e string")
    found = {r.k: (r.stale, r.reasons, r.age_hours) for r in diagnostics.staleness(rows, "g", "v", "n", 24, "e").collect()}
    assert found == {1: (True, ["older-than-verify-report", "older-than-max-age"], 49.0), 2: (True, ["missing-generated-at"], None), 3: (True, ["missing"], None), 4: (False, [], 0.0)}
    entries = spark.createDataFrame([(1, 1, 2, "BinData/BIN0001.png", "BIN0001.png"), (1, 2, 2, "x/bin0001.PNG", "bin0001.PNG"), (1, 3, 1, "BinData/BIN0002", "BIN0002"), (1, 4, 2, "bindata/doc", "doc")], "k long, id long, kind long, path string, name string")
    wanted = spark.createDataFrame([(1, "\\BINDATA\\bin0001.png"), (1, "y/BIN0001.png"), (1, "none"), (1, None)], "k long, path string")
    assert {r.path: r.id for r in diagnostics.entry_by_path(wanted, entries, "k").collect()} == {"\\BINDATA\\bin0001.png": 1, "y/BIN0001.png": 1, "none": None, None: None}
    assert [r.id for r in diagnostics.entries_under(entries, "k", "BinData/", "(?i)^BIN[0-9]").collect()] == [1]


def test_what_shows_something(spark):
    pages = nodes.parsed(spark.createDataFrame([(1, "<a><b></b><c>x</c></a><d/>")], "k long, html string"), "k", "html")
    tree = nodes.node_table(pages, "k")
    found = nodes.any_within(tree, "k", F.when(F.col("name") == "c", True)).orderBy("node").collect()
    assert [r.holds for r in found] == [True, False, True, False]
