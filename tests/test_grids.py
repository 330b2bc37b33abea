"""Grids: placement under spans against a plain grid, widths by hand, heights, forms; nulls, ties, clashing names."""

import random

from pyspark.sql import functions as F

from paperloom.operators import flow, grids


def test_cells_go_where_nothing_reaches_down(spark):
    r = random.Random(3)
    rows = [(t, i // 4, i, r.randint(1, 3), r.randint(1, 3), "x") for t in range(40) for i in range(r.randint(1, 16))]
    found = grids.place_cells(spark.createDataFrame(rows, "t long, r long, i long, w long, h long, key string"), "t", "r", "i", "w", "h").collect()
    taken, last, cursor = set(), None, 0
    for x in sorted(found, key=lambda x: (x.t, x.r, x.i)):
        if (x.t, x.r) != last:
            last, cursor = (x.t, x.r), 0
        while (x.t, x.r, cursor) in taken:
            cursor += 1
        assert x.col == cursor
        taken |= {(x.t, x.r + j, cursor + k) for j in range(x.h) for k in range(x.w)}
        cursor += x.w
    assert len(found) == len(rows)


def test_widths_by_hand(spark):
    cells = [
        (1, 0, 0, 1, 30.0), (1, 1, 0, 1, 40.0), (1, 0, 1, 2, 100.0),  # 40, 50, 50
        (1, 2, 0, 3, 280.0),  # all known: each twice as wide
        (2, 0, 0, 2, 90.0), (2, 1, 1, 1, 60.0), (2, 2, 2, 1, None),  # the bare one gets 30; the last the mean
        (3, 0, 0, None, None), (3, 0, 1, 1, -5.0), (3, 0, None, 1, 9.0),
    ]
    found = grids.column_widths(spark.createDataFrame(cells, "t long, r long, c long, s long, w double"), "t", "r", "c", "s", "w").collect()
    by = {(x.t, x.col): x.width for x in found}
    assert by == {(1, 0): 80.0, (1, 1): 100.0, (1, 2): 100.0, (2, 0): 30.0, (2, 1): 60.0, (2, 2): 45.0, (3, 0): 1.0, (3, 1): 1.0}
    empty = spark.createDataFrame([], "t long, r long, c long, s long, w double")
    assert grids.column_widths(empty, "t", "r", "c", "s", "w").count() == 0


def test_heights_over_spans(spark):
    cells = spark.createDataFrame([(1, 0, 2, 301.0, "a"), (1, 1, 1, 75.0, "b"), (1, 3, 1, None, "c"), (1, 0, 9, None, "d"), (None, 0, 1, 75.0, "e"), (2, 0, None, None, "f")], "t long, r long, s long, h double, upto string")
    heights = grids.row_heights(cells, "t", "r", "s", "h")
    assert {(x.t, x.row): x.height for x in heights.collect() if x.t == 1} == {(1, 0): 151, (1, 1): 151, **{(1, k): 0 for k in range(2, 9)}}
    found = {x.upto: x.pixels for x in grids.cell_heights(cells, heights, "t", "r", "s", "h", 28).collect()}
    assert found == {"a": 4, "b": 1, "c": 28, "d": 4, "e": 1, "f": 28}


def test_one_row_becomes_two(spark):
    said = ["① 성명", None, "②", "x", "③", "y"]
    cells = [(1, 0, k, 2 if k == 5 else 1, t) for k, t in enumerate(said)] + [(1, 1, 0, 3, "plain ①"), (1, 1, 5, None, None)]
    found = grids.rewrite_rows(spark.createDataFrame(cells, "t long, row long, c long, s long, x string"), "t", "row", "c", "s", "x").orderBy("row", "sub", "position").collect()
    assert [(x.row, x.sub, x.col, x.span, x.role, x.source, x.text) for x in found] == [
        (0, 0, 0, 1, "field-label", 0, "①성명"), (0, 0, 1, 2, "field-input", 1, ""), (0, 0, 3, 2, "field-label", 2, "②주민등록번호"), (0, 0, 5, 2, "field-input", 3, ""),
        (0, 1, 0, 1, "field-label", 4, "③주소"), (0, 1, 1, 4, "field-input", 1, ""), (0, 1, 5, 2, "field-inline-note", 5, "y"),
        (1, 0, 0, 3, None, 0, "plain ①"), (1, 0, 5, 1, None, 1, ""),
    ]


def test_folds_keep_columns_of_any_name(spark):
    names = ["_w", "_n", "v0", "by", "key", "row", "made", "state"]
    rows = spark.createDataFrame([(1, k, 10) for k in range(9)], "t long, k long, weight long").withColumns({n: F.lit(n) for n in names})
    found = flow.paginate(rows, "t", "k", "weight", 30, carry=tuple(names)).collect()
    assert [x.page for x in sorted(found, key=lambda x: x.k)] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and all(x[n] == n for x in found for n in names)
    assert flow.paginate(rows, "t", "k", "weight", 30, carry=("weight",)).columns == ["t", "k", "weight", "page"]
    assert flow.layout_boxes(rows, "t", "k", "weight", 25, carry=tuple(names)).count() == 9


def test_operators_take_columns_of_any_name(spark):
    from paperloom.operators import reports, runs

    names = ["island", "Rank", "reach", "areas", "place", "group", "value", "joined", "changed", "first", "last", "group0", "count0", "n", "version", "_place"]
    rows = spark.createDataFrame([(1, k, "" if k in (0, 1, 2, 3, 9) else f"t{k // 3}", k % 2, 1 + k % 2) for k in range(10)], "t long, k long, x string, level int, span long").withColumns({n: F.lit(n) for n in names})
    kept = lambda found: all(found.columns.count(n) == 1 for n in names) and all(r[n] == n for r in found.collect() for n in names)
    assert flow.cap_blank_runs(rows, "t", "k", "x").count() == 8 and kept(flow.cap_blank_runs(rows, "t", "k", "x"))
    assert kept(flow.on_pages(rows, [("a", "ODD")], "k")) and kept(flow.first_by_priority(flow.on_pages(rows, [("a", "ODD"), ("b", "BOTH")], "k"), ["t", "k"], {"ODD": 0}))
    assert flow.safe_breaks(rows, "t", "k", "span").count() == 5
    assert kept(runs.numbered_runs(rows, "t", ["k"], ["x"])) and kept(runs.trim_blank_ends(rows, "t", "k", F.col("x") == "")) and kept(runs.list_markers(rows, "t", "k", "level", 2))
    assert runs.longest_run(rows, "t", ["k"], "x").collect()[0][:] == (1, "", 4)
    forms = rows.withColumns({"kind": F.lit("number"), "list": F.lit(None).cast("string"), "start": F.lit(1), "form": F.lit("^n")})
    assert kept(flow.list_markers(forms, "t", "k", "kind", "list", "level", "start", "form"))
    assert reports.histogram_label(rows, ["t"], "place", "l").first()["l"] == "place(10)" and reports.first_examples(rows, ["t"], ["k"], "place", 2, "l").first()["l"] == "place,place"
    assert reports.last_by(rows, "t", F.col("k"), ["x", "version"]).first()[:] == (1, "", "version", 0)


def test_widths_read_their_cells_once(spark):
    import io
    from contextlib import redirect_stdout

    from paperloom.operators import grids

    rows = spark.createDataFrame([(1, 0, 1, 1, 4.0), (1, 0, 1, 1, 6.0), (1, 1, 1, 2, 9.0), (1, 1, 1, 2, 9.0), (1, 1, 2, 1, 0.0), (1, 2, 1, 1, 0.0)], "k long, r long, o long, s long, w double")
    made = grids.column_widths(grids.place_cells(rows, "k", "r", "o", "s", "s"), "k", "r", "col", "s", "w")
    with redirect_stdout(io.StringIO()) as out:
        made.explain()
    assert out.getvalue().count("MapInArrow") == 2  # places, widths
    assert [(r.col, r.width) for r in made.where("col < 2").orderBy("col").collect()] == [(0, 4.0), (1, 6.0)]
