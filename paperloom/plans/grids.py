"""Orders as tables: cells placed under spans, widths, heights, rows of forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import grids
from paperloom.sources.tables import table


def _cells(spark, sf_dir):
    """Lines as cells, three a row, over one to three columns and one or two rows."""
    key = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        ((F.col("l_linenumber") - 1) / 3).cast("long").alias("line"),
        (F.col("l_linenumber") * 10_000_000 + key).cast("long").alias("place"),
        (1 + key % 3).alias("wide"),
        (1 + F.col("l_suppkey") % 2).alias("high"),
        F.when(key % 4 > 0, F.col("l_quantity") * 100).alias("width"),
        F.when(key % 5 > 0, F.col("l_quantity").cast("long") * 130).alias("height"),
    )
    return lines.groupBy("l_orderkey", "line", "place", "wide", "high").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def _placed(spark, sf_dir):
    return grids.place_cells(_cells(spark, sf_dir), "l_orderkey", "line", "place", "wide", "high")


def placed_cells(spark, sf_dir):
    return _placed(spark, sf_dir).select("l_orderkey", "line", "place", "col")


def column_widths(spark, sf_dir):
    found = grids.column_widths(_placed(spark, sf_dir), "l_orderkey", "line", "col", "wide", "width")
    return found.withColumn("width", F.round("width", 3))


def spanned_row_heights(spark, sf_dir):
    return grids.row_heights(_cells(spark, sf_dir), "l_orderkey", "line", "high", "height")


def cell_heights(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    heights = grids.row_heights(cells, "l_orderkey", "line", "high", "height")
    found = grids.cell_heights(cells, heights, "l_orderkey", "line", "high", "height", 28)
    return found.select("l_orderkey", "line", "place", "pixels")


_MARKS = ["①②", "③", "④⑤", "⑥⑦", "⑧질병명", "⑬⑭", "⑮ x", " a  b "]


def form_rows(spark, sf_dir):
    """Each order as one row of a form, its lines as cells."""
    text = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("place") % len(_MARKS)).cast("int") + 1)
    cells = _cells(spark, sf_dir).withColumn("text", text).withColumn("row", F.lit(0))
    return grids.rewrite_rows(cells, "l_orderkey", "row", "place", "wide", "text")


QUERIES = {f.__name__: f for f in (placed_cells, column_widths, spanned_row_heights, cell_heights, form_rows)}

_C = """c AS (SELECT l_orderkey AS k, (l_linenumber - 1) // 3 AS r, l_linenumber::BIGINT * 10000000 + l_partkey AS o, 1 + l_partkey % 3 AS cs, 1 + l_suppkey % 2 AS rs, max(CASE WHEN l_partkey % 4 > 0 THEN l_quantity * 100 END) AS w, max(CASE WHEN l_partkey % 5 > 0 THEN l_quantity::BIGINT * 130 END) AS h FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""
_P = f"""{_C}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, o, cs, rs, w, h) AS i FROM c),
    f AS (SELECT i.*, 0::BIGINT AS col, list_transform(range(cs), lambda x: (r + rs)::BIGINT) AS free FROM i WHERE i = 1
        UNION ALL SELECT k, r, o, cs, rs, w, h, i, col, list_transform(range(greatest(len(free), col + cs)), lambda x: CASE WHEN x >= col AND x < col + cs THEN greatest(coalesce(free[x + 1], r), r + rs) ELSE free[x + 1] END)
            FROM (SELECT i.*, f.free, coalesce(list_filter(range(CASE WHEN i.r = f.r THEN f.col + f.cs ELSE 0 END, len(f.free)), lambda x: f.free[x + 1] <= i.r)[1], len(f.free)) AS col FROM f JOIN i ON i.k = f.k AND i.i = f.i + 1))"""
_H = """e AS (SELECT k, max(r + rs) AS n FROM c GROUP BY 1), g AS (SELECT k, unnest(range(r, r + rs)) AS r, greatest(1, ceil(h / rs)) AS h FROM c WHERE h > 0), m AS (SELECT k, r, max(h) AS h FROM g GROUP BY 1, 2),
    q AS (SELECT e.k, e.r, coalesce(h, 0)::BIGINT AS h FROM (SELECT k, unnest(range(n)) AS r FROM e) e LEFT JOIN m ON m.k = e.k AND m.r = e.r)"""


def _form_sql():
    def rows(sub, role, cells):
        total, out, at = sum(c[2] for c in cells), [], "0"
        for k, (cell_role, source, share, text) in enumerate(cells):
            used = " + ".join(f"greatest(1, floor(t * {c[2]} / {total}.0 + 0.5))" for c in cells[:-1])
            span = f"greatest(1, floor(t * {share} / {total}.0 + 0.5))::BIGINT" if k < len(cells) - 1 else f"greatest(1, t - ({used}))::BIGINT"
            quoted = lambda x: "NULL::VARCHAR" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'"
            out.append(f"{{'sub': {sub}, 'row_role': {quoted(role)}, 'position': {k}, 'col': ({at})::BIGINT, 'span': {span}, 'role': {quoted(cell_role)}, 'source': {source}, 'text': {f'cs[{source + 1}].x' if text is None else quoted(text)}}}")
            at += f" + {span}"
        return out

    cases = []
    for marks, least, forms in [
        ("①②③", 6, [("person-form-upper", [("field-label", 0, 4, "①성명"), ("field-input", 1, 10, ""), ("field-label", 2, 8, "②주민등록번호"), ("field-input", 3, 10, "")]), ("person-form-lower", [("field-label", 4, 4, "③주소"), ("field-input", 1, 18, ""), ("field-inline-note", 5, 10, None)])]),
        ("④⑤⑥⑦", 8, [("military-form-upper", [("field-label", 0, 4, "④입대일자"), ("field-input", 1, 12, ""), ("field-label", 2, 4, "⑤계급"), ("field-input", 3, 12, "")]), ("military-form-lower", [("field-label", 4, 4, "⑥군별"), ("field-input", 5, 12, ""), ("field-label", 6, 4, "⑦군번"), ("field-input", 7, 12, "")])]),
        (["⑧질병명"], 5, [("body", [("field-label", 0, 4, "⑧질병명"), (None, 1, 9, None), (None, 2, 9, None), (None, 3, 10, None)])]),
        ("⑬⑭⑮", 6, [("body", [("field-label", 0, 8, "⑬고엽제후유(의)증\n환자 등과의 관계"), ("field-label", 1, 4, "⑭성명"), ("field-label", 2, 9, "⑮주민등록번호"), ("field-label", 3, 3, "학 력"), ("field-label", 4, 3, "직 업"), ("field-label", 5, 5, "월소득(천원)")])]),
    ]:
        holds = " AND ".join([f"len(cs) >= {least}", *[f"contains(said, '{m}')" for m in marks]])
        cases.append(f"WHEN {holds} THEN [{', '.join(x for sub, (role, cells) in enumerate(forms) for x in rows(sub, role, cells))}]")
    return "\n            ".join(cases)


ORACLES = {
    "placed_cells": f"WITH RECURSIVE {_P} SELECT k AS l_orderkey, r AS line, o AS place, col FROM f",
    "column_widths": f"""WITH RECURSIVE {_P}, n AS (SELECT k, max(col + cs) AS n FROM f GROUP BY 1), b AS (SELECT k, col, max(w) AS w FROM f WHERE cs = 1 AND w > 0 GROUP BY 1, 2),
        z AS (SELECT k, list(coalesce(w, 0)::DOUBLE ORDER BY c) AS ws FROM (SELECT n.k, c, w FROM (SELECT k, unnest(range(n)) AS c FROM n) n LEFT JOIN b ON b.k = n.k AND b.col = c) GROUP BY 1),
        s AS (SELECT k, col, cs, w, row_number() OVER (PARTITION BY k ORDER BY r, col, cs, w) AS i FROM f WHERE cs > 1 AND w > 0),
        d AS (SELECT k, 0::BIGINT AS i, ws FROM z UNION ALL SELECT k, i, list_transform(ws, lambda x, j: CASE WHEN j <= col OR j > col + cs THEN x WHEN known <= 0 THEN greatest(x, w / cs) WHEN w <= known THEN x WHEN bare > 0 THEN CASE WHEN x > 0 THEN x ELSE (w - known) / bare END ELSE x + (w - known) * (x / known) END)
            FROM (SELECT d.k, s.i, ws, col, cs, w::DOUBLE AS w, list_sum(ws[col + 1:col + cs]) AS known, len(list_filter(ws[col + 1:col + cs], lambda x: x <= 0)) AS bare FROM d JOIN s ON s.k = d.k AND s.i = d.i + 1)),
        l AS (SELECT k, arg_max(ws, i) AS ws FROM d GROUP BY 1), a AS (SELECT k, ws, coalesce(list_avg(list_filter(ws, lambda x: x > 0)), 1) AS mean FROM l)
        SELECT k AS l_orderkey, unnest(range(len(ws))) AS col, round(unnest(list_transform(ws, lambda x: CASE WHEN x > 0 THEN x ELSE mean END)), 3) AS width FROM a""",
    "spanned_row_heights": f"WITH {_C}, {_H} SELECT k AS l_orderkey, r AS row, h AS height FROM q",
    "cell_heights": f"""WITH {_C}, {_H}, p AS (SELECT c.k, c.r, c.o, c.h, c.cs, c.w, c.rs, sum(CASE WHEN q.h > 0 THEN greatest(1, floor(q.h / 75.0 + 0.5)) ELSE 0 END) AS total FROM c LEFT JOIN q ON q.k = c.k AND q.r >= c.r AND q.r < c.r + c.rs GROUP BY ALL)
        SELECT k AS l_orderkey, r AS line, o AS place, (CASE WHEN h > 0 THEN greatest(1, floor(h / 75.0 + 0.5)) WHEN total > 0 THEN total ELSE 28 END)::BIGINT AS pixels FROM p""",
    "form_rows": f"""WITH {_C}, x AS (SELECT k, list({{'o': o, 's': cs, 'x': [{", ".join(f"'{m}'" for m in _MARKS)}][o % {len(_MARKS)} + 1]}} ORDER BY o, cs) AS cs, sum(cs)::BIGINT AS t FROM c GROUP BY 1),
        y AS (SELECT *, array_to_string(list_transform(cs, lambda c: trim(regexp_replace(c.x, '\\s+', ' ', 'g'))), ' ') AS said FROM x),
        z AS (SELECT k, unnest(CASE {_form_sql()}
            ELSE list_transform(cs, lambda c, j: {{'sub': 0, 'row_role': NULL::VARCHAR, 'position': j - 1, 'col': c.o, 'span': c.s::BIGINT, 'role': NULL::VARCHAR, 'source': j - 1, 'text': c.x}}) END) AS u FROM y)
        SELECT k AS l_orderkey, 0 AS row, u.* FROM z""",
}
