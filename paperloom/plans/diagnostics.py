"""Orders as parsed documents: counters, signals, histograms, pages of tables in chunks, stored files; documents as noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import diagnostics, reports
from paperloom.sources.tables import table

c = F.col
KINDS = ["table", "image", "shape", "textbox", "equation", "ole", "paragraph", "chart"]


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def _blocks(spark, sf_dir):
    p, s = c("l_partkey"), c("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.floor((c("l_linenumber") - 1) / 3).alias("page"), _pick(KINDS, p).alias("kind"), (s % 4).alias("text_runs"), (p % 3 == 0).alias("inline"), (s % 2).alias("header_rows"),
        _pick(["", "CELL", " "], s).alias("page_break"), F.when(p % 5 > 0, p % 5 > 1).alias("explicit"), F.when(s % 3 > 0, s % 3 > 1).alias("overlap"), (p % 7 > 3).alias("keep"), _pick(["", "square", "top-and-bottom"], p).alias("wrap"),
        _pick(["page", "Column", "para", ""], s).alias("horz"), _pick(["Paper", "paragraph", "x"], p).alias("vert"),
    )


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_partkey % 2 = 0").select("l_orderkey", F.floor((c("l_linenumber") - 1) / 3).alias("page"), (1 + c("l_suppkey") % 2).alias("col_span"), (1 + c("l_partkey") % 3).alias("row_span"), F.when(c("l_suppkey") % 3 > 0, c("l_quantity") * 300).alias("height"), (c("l_quantity") * 250).alias("content_height"))


def _said(map_column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(map_column)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


def page_counters(spark, sf_dir):
    found = diagnostics.page_counters(_blocks(spark, sf_dir), _cells(spark, sf_dir), "l_orderkey", "page")
    return found.withColumn("control_types", _said(c("control_types")))


def document_counters(spark, sf_dir):
    pages = diagnostics.page_counters(_blocks(spark, sf_dir), _cells(spark, sf_dir), "l_orderkey", "page")
    found = diagnostics.document_counters(pages, "l_orderkey")
    return found.withColumn("control_types", _said(c("control_types")))


def parsed_signals(spark, sf_dir):
    """Histograms of break policies, kinds, anchors and flags of each order's blocks."""
    is_table, is_object = c("kind") == "table", c("kind").isin("image", "shape", "textbox", "equation", "ole")
    unknown = lambda n: F.coalesce(F.nullif(c(n), F.lit("")), F.lit("unknown"))
    values = {
        "page_break": F.when(is_table, F.coalesce(F.nullif(F.trim("page_break"), F.lit("")), F.lit("NONE"))),
        "repeat_header": F.when(is_table & (c("header_rows") > 0), "true"),
        "object_type": F.when(is_object, c("kind")),
        "anchor": F.when(is_object, F.concat_ws("/", unknown("vert"), unknown("horz"))),
        "wrap": F.when(is_object & c("explicit"), c("wrap")),
        "runs": F.when(c("kind") == "paragraph", c("text_runs")),
    }
    return diagnostics.histograms(_blocks(spark, sf_dir), "l_orderkey", values)


def line_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_quantity") * 40).cast("long").alias("height"), F.when(c("l_suppkey") % 3 > 0, c("l_partkey") * 7).alias("text_height"), F.when(c("l_suppkey") % 5 > 0, c("l_linenumber").cast("long") * 1200).alias("y"), F.when(c("l_partkey") % 4 > 0, (c("l_partkey") % 4) * 393216).alias("flags"))
    return diagnostics.line_summary(lines, "l_orderkey", "height", "text_height", "y", "flags").withColumn("flags", _said(c("flags")))


def text_in_noise(spark, sf_dir):
    """The best run of accented text in each document, by both rules, and whether the whole is legible."""
    script = "À-ÿ"
    strict, any_ = diagnostics.best_run(c("text"), script, 50, 0.02), diagnostics.best_run(c("text"), script, 10, strict=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(strict).alias("strict_chars"), F.sha2(strict, 256).alias("strict"), F.length(any_).alias("any_chars"), F.sha2(any_, 256).alias("loose"), diagnostics.legible(c("text"), script).isNotNull().alias("legible"))


def audit_staleness(spark, sf_dir):
    """Users' first and last events as audits and reports, by the clock of a day in their midst."""
    t = c("ts").cast("timestamp")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(t).alias("first"), F.max(t).alias("last"))
    u = c("user_id")
    rows = users.select("user_id", F.when(u % 7 > 0, F.when(u % 11 > 0, c("first").cast("string")).otherwise("soon")).alias("generated"), F.when(u % 3 > 0, F.when(u % 2 > 0, c("last")).otherwise(c("first") - F.expr("interval 1 day")).cast("string")).alias("verified"), (c("first") + F.expr("interval 1 hour") * (u % 50)).cast("string").alias("now"), F.when(u % 7 == 0, "no report").alias("error"))
    found = diagnostics.staleness(rows, "generated", "verified", "now", 24, "error")
    return found.select("user_id", "available", "stale", F.concat_ws(",", "reasons").alias("reasons"), "age_hours")


def worst_pages(spark, sf_dir):
    """The three lines of each order with the worst verdicts."""
    verdict = _pick(["close", "capture-error", "mismatch", "ok", "capture-review", "review", "odd", "match"], c("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_linenumber") * 1_000_000 + c("l_partkey") * 100 + c("l_suppkey") % 100).cast("long").alias("page"), verdict.alias("verdict"), F.when(c("l_suppkey") % 4 > 0, F.floor(c("l_quantity") / 5)).alias("diff")).distinct()
    order = [diagnostics.verdict_rank(c("verdict")), F.desc(F.coalesce("diff", F.lit(-1))), c("page").asc()]
    return reports.top_by(rows, ["l_orderkey"], order, 3).select("l_orderkey", "page", "verdict", "diff", "rank")


def section_budgets(spark, sf_dir):
    """Page budgets of sections whose measures are those of documents."""
    n = c("n_chars")
    budget = diagnostics.page_budget(F.when(c("doc_id") % 9 > 0, n * 60), n * 3, F.when(c("doc_id") % 4 > 0, n * 2), F.lit(4000), c("doc_id") % 3 * 2000, _pick(["hwp", "hwpx", "owpml"], c("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", budget.alias("budget"))


def paginate_tables(spark, sf_dir):
    """Documents of 5 orders on pages of 20: orders of open lines are tables in chunks, others blocks of their lines' weight."""
    lines = table(spark, sf_dir, "lineitem").select((c("l_orderkey") / 20).cast("long").alias("doc"), c("l_orderkey").alias("block"), (c("l_linenumber") * 10_000_000 + c("l_partkey")).cast("long").alias("row"), F.ceil(c("l_quantity") / 9).alias("weight"), (1 + c("l_partkey") % 2).alias("span"))
    blocks = lines.groupBy("doc", "block").agg(F.least(F.lit(9), F.sum("weight")).cast("long").alias("weight"))
    return diagnostics.paginate_blocks(blocks, lines.where("block % 2 = 0"), "doc", "block", "weight", "row", "weight", "span", 20)


def stored_binaries(spark, sf_dir):
    """Lines of orders as streams of a container, suppliers' numbers as references."""
    n, p, s = c("l_linenumber"), c("l_partkey"), c("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", n, p, s)
    name = F.when(p % 6 == 0, F.concat(F.lit("doc"), n.cast("string"))).otherwise(F.concat(_pick(["BIN000", "bin", "BinaryData"], n), n.cast("string"), F.lit("."), _pick(["png", "OLE", "jpg"], n)))
    entries = lines.select("l_orderkey", name.alias("name"), F.concat(_pick(["BinData/", "bindata/", "Other/"], n), name).alias("path"), _pick([2, 2, 1, 2], p).alias("kind"))
    refs = lines.select("l_orderkey", (s % 9 + 1).alias("ref_id"), F.when(p % 4 > 0, p % 7 + 1).alias("data_id"), _pick(["", "BMP", "wmf"], s).alias("extension"))
    return diagnostics.binary_map(diagnostics.entries_under(entries, "l_orderkey", "BinData", "(?i)^(?:BIN|BinaryData)[0-9]+"), refs, "l_orderkey")


def entries_by_path(spark, sf_dir):
    """Suppliers' numbers as wanted paths among the lines of orders as entries: by path, else by name."""
    n, p, s = c("l_linenumber"), c("l_partkey"), c("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", n, p, s)
    name = F.concat(_pick(["Sec", "BIN"], n), (p % 4).cast("string"))
    entries = lines.select("l_orderkey", (n * 10_000_000 + p).cast("long").alias("id"), name.alias("name"), F.concat(_pick(["", "Body/"], p), name).alias("path"))
    wanted = lines.select("l_orderkey", F.concat(_pick(["/", "\\", "x/", "BODY\\"], s), _pick(["sec", "bin"], p), (s % 4).cast("string")).alias("path")).distinct()
    return diagnostics.entry_by_path(wanted, entries, "l_orderkey")


def line_heights(spark, sf_dir):
    """Pixels of orders as paragraphs, their lines as segments."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(c("l_suppkey") % 3 > 0, c("l_quantity") * 40).alias("size"), F.when(c("l_partkey") % 4 > 0, c("l_quantity") * 300).alias("text"), (c("l_partkey") % 2 * 900).alias("gap"))
    return diagnostics.line_heights(lines, "l_orderkey", ["size", "text", "gap"])


QUERIES = {f.__name__: f for f in (page_counters, document_counters, parsed_signals, line_summary, text_in_noise, audit_staleness, worst_pages, section_budgets, paginate_tables, stored_binaries, entries_by_path, line_heights)}

_B = """b AS (SELECT l_orderkey AS k, (l_linenumber - 1) // 3 AS page, ['table', 'image', 'shape', 'textbox', 'equation', 'ole', 'paragraph', 'chart'][l_partkey % 8 + 1] AS kind, l_suppkey % 4 AS runs, l_partkey % 3 = 0 AS inline, l_suppkey % 2 AS heads, ['', 'CELL', ' '][l_suppkey % 3 + 1] AS brk, l_partkey % 5 > 1 AS explicit,
    l_suppkey % 3 > 1 AS overlap, l_partkey % 7 > 3 AS keep, ['', 'square', 'top-and-bottom'][l_partkey % 3 + 1] AS wrap, ['page', 'Column', 'para', ''][l_suppkey % 4 + 1] AS horz, ['Paper', 'paragraph', 'x'][l_partkey % 3 + 1] AS vert FROM lineitem)"""
_PC = f"""{_B}, d AS (SELECT *, kind IN ('table', 'image', 'shape', 'textbox') AND explicit AS placed FROM b),
    h AS (SELECT k, page, count(*) FILTER (kind IN ('table', 'image', 'shape', 'textbox', 'equation', 'ole')) AS controls, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'image') AS pictures, count(*) FILTER (kind = 'equation') AS equations, 0 AS charts, 0 AS forms, count(*) FILTER (kind IN ('shape', 'textbox')) AS shapes, count(*) FILTER (kind = 'ole') AS oles, 0 AS videos,
        coalesce(sum(runs) FILTER (kind NOT IN ('table', 'image', 'shape', 'textbox')), 0) AS text_runs, count(*) FILTER (placed AND NOT inline AND kind = 'table') AS floating_tables, count(*) FILTER (placed AND NOT inline AND kind = 'image') AS floating_pictures, count(*) FILTER (placed AND wrap = 'square') AS wrapped_controls, count(*) FILTER (placed AND overlap) AS overlap_allowed, count(*) FILTER (placed AND keep) AS keep_with_anchor,
        count(*) FILTER (kind = 'table' AND heads > 0) AS repeat_header_tables, count(*) FILTER (kind = 'table' AND brk = 'CELL') AS page_break_tables, count(*) FILTER (placed AND (horz = 'page' OR vert = 'Paper')) AS page_anchored, count(*) FILTER (placed AND horz = 'Column') AS column_anchored, count(*) FILTER (placed AND (horz = 'para' OR vert = 'paragraph')) AS paragraph_anchored,
        count(*) FILTER (kind = 'equation') AS n_equation, count(*) FILTER (kind = 'ole') AS n_ole, count(*) FILTER (kind = 'image') AS n_picture, count(*) FILTER (kind = 'shape') AS n_shape, count(*) FILTER (kind = 'table') AS n_table, count(*) FILTER (kind = 'textbox') AS n_textbox FROM d GROUP BY 1, 2),
    e AS (SELECT l_orderkey AS k, (l_linenumber - 1) // 3 AS page, count(*) FILTER (l_suppkey % 2 > 0 OR l_partkey % 3 > 0) AS merged_cells, count(*) FILTER (l_quantity * CASE WHEN l_suppkey % 3 > 0 THEN 300 ELSE 250 END >= 12000) AS tall_cells FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2),
    p AS (SELECT h.*, coalesce(merged_cells, 0) AS merged_cells, coalesce(tall_cells, 0) AS tall_cells FROM h LEFT JOIN e USING (k, page))"""
_NUMBERS = "controls tables pictures equations charts forms shapes oles videos text_runs floating_tables floating_pictures wrapped_controls overlap_allowed keep_with_anchor repeat_header_tables page_break_tables page_anchored column_anchored paragraph_anchored merged_cells tall_cells".split()
_TYPES = "concat_ws(',', " + ", ".join(f"CASE WHEN n_{t} > 0 THEN '{t}:' || n_{t}::BIGINT END" for t in ("equation", "ole", "picture", "shape", "table", "textbox")) + ") AS control_types"
_RUN = "[\\x02\\t\\n\\r\\x20-\\x7E\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{4E00}-\\x{9FFF}À-ÿ]+"

ORACLES = {
    "page_counters": f"WITH {_PC} SELECT k AS l_orderkey, page, {', '.join(_NUMBERS)}, {_TYPES} FROM p",
    "document_counters": f"WITH {_PC}, s AS (SELECT k, count(*) AS pages, {', '.join(f'sum({n}) AS {n}' for n in [*_NUMBERS, 'n_equation', 'n_ole', 'n_picture', 'n_shape', 'n_table', 'n_textbox'])} FROM p GROUP BY 1) SELECT k AS l_orderkey, pages, {', '.join(_NUMBERS)}, {_TYPES} FROM s",
    "parsed_signals": f"""WITH {_B}, o AS (SELECT *, kind IN ('image', 'shape', 'textbox', 'equation', 'ole') AS object FROM b),
        s AS (SELECT k, 'page_break' AS signal, CASE WHEN brk = 'CELL' THEN 'CELL' ELSE 'NONE' END AS value FROM o WHERE kind = 'table' UNION ALL SELECT k, 'repeat_header', 'true' FROM o WHERE kind = 'table' AND heads > 0 UNION ALL SELECT k, 'object_type', kind FROM o WHERE object
            UNION ALL SELECT k, 'anchor', vert || '/' || CASE horz WHEN '' THEN 'unknown' ELSE horz END FROM o WHERE object UNION ALL SELECT k, 'wrap', wrap FROM o WHERE object AND explicit UNION ALL SELECT k, 'runs', runs::VARCHAR FROM o WHERE kind = 'paragraph')
        SELECT k AS l_orderkey, signal, value, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    "line_summary": """WITH l AS (SELECT l_orderkey AS k, greatest((l_quantity * 40)::BIGINT, CASE WHEN l_suppkey % 3 > 0 THEN l_partkey * 7 ELSE 0 END) AS h, CASE WHEN l_suppkey % 5 > 0 THEN l_linenumber::BIGINT * 1200 ELSE 0 END AS y, '0x' || lpad(hex(CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 * 393216 ELSE 0 END), 8, '0') AS f FROM lineitem),
        g AS (SELECT k, f, count(*) AS n FROM l GROUP BY 1, 2), m AS (SELECT k, string_agg(f || ':' || n, ',' ORDER BY f) AS flags FROM g GROUP BY 1), a AS (SELECT k, count(*) AS c, sum(h) AS t, max(h) AS m, min(y) AS l, max(y) AS u FROM l GROUP BY 1)
        SELECT k AS l_orderkey, c AS count, t AS total_height, m AS max_height, l AS min_y, u AS max_y, flags FROM a JOIN m USING (k)""",
    "text_in_noise": f"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '{_RUN}') AS runs FROM documents), u AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS i FROM r), q AS (SELECT *, length(run) AS n, length(regexp_replace(run, '[^À-ÿ]', '', 'g')) AS own FROM u),
        s AS (SELECT doc_id, run FROM q WHERE n >= 50 AND own >= n * 0.02::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY own DESC, i) = 1), a AS (SELECT doc_id, run FROM q WHERE n >= 10 AND own > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n + own DESC, i) = 1)
        SELECT doc_id, length(s.run) AS strict_chars, sha256(s.run) AS strict, length(a.run) AS any_chars, sha256(a.run) AS loose, coalesce(length(regexp_replace(text, '[^À-ÿ]', '', 'g')) >= 3 AND length(regexp_replace(text, '[\\x00-\\x09\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) >= 0.6 * length(text), false) AS legible FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN a USING (doc_id)""",
    "audit_staleness": """WITH u AS (SELECT user_id AS u, min(ts::TIMESTAMP) AS f, max(ts::TIMESTAMP) AS l FROM events GROUP BY 1),
        r AS (SELECT u, CASE WHEN u % 7 > 0 AND u % 11 > 0 THEN f END AS g, CASE WHEN u % 3 > 0 THEN CASE WHEN u % 2 > 0 THEN l ELSE f - INTERVAL 1 DAY END END AS v, u % 50 AS age FROM u)
        SELECT u AS user_id, u % 7 > 0 AS available, u % 7 = 0 OR g IS NULL OR coalesce(g < v, false) OR age > 24 AS stale, CASE WHEN u % 7 = 0 THEN 'missing' WHEN g IS NULL THEN 'missing-generated-at' ELSE concat_ws(',', CASE WHEN g < v THEN 'older-than-verify-report' END, CASE WHEN age > 24 THEN 'older-than-max-age' END) END AS reasons, CASE WHEN g IS NOT NULL THEN age::DOUBLE END AS age_hours FROM r""",
    "worst_pages": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT * 1000000 + l_partkey * 100 + l_suppkey % 100 AS page, ['close', 'capture-error', 'mismatch', 'ok', 'capture-review', 'review', 'odd', 'match'][l_partkey % 8 + 1] AS verdict, CASE WHEN l_suppkey % 4 > 0 THEN floor(l_quantity / 5)::BIGINT END AS diff FROM lineitem)
        SELECT l_orderkey, page, verdict, diff, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE verdict WHEN 'capture-error' THEN 0 WHEN 'mismatch' THEN 1 WHEN 'capture-review' THEN 1 WHEN 'review' THEN 2 WHEN 'close' THEN 3 WHEN 'match' THEN 4 WHEN 'ok' THEN 4 ELSE 8 END, coalesce(diff, -1) DESC, page) AS rank FROM l QUALIFY rank <= 3""",
    "section_budgets": """WITH b AS (SELECT doc_id, n_chars * 60 AS h, doc_id % 3 AS k, n_chars * 60 - n_chars * 3 - CASE WHEN doc_id % 4 > 0 THEN n_chars * 2 ELSE 0 END - CASE doc_id % 3 WHEN 0 THEN 0 ELSE 4000 + doc_id % 3 * 2000 END AS content FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 9 > 0 AND h > 0 AND content > 0 THEN least(200, greatest(16, floor(content / CASE k WHEN 1 THEN 2250.0 ELSE 1500.0 END + 0.5)))::BIGINT ELSE 46 END AS budget FROM b""",
    "paginate_tables": """WITH RECURSIVE l AS (SELECT l_orderkey // 20 AS doc, l_orderkey AS block, l_linenumber::BIGINT * 10000000 + l_partkey AS row, ceil(l_quantity / 9)::BIGINT AS w, 1 + l_partkey % 2 AS span FROM lineitem),
        t AS (SELECT doc, block, w, span, row_number() OVER (PARTITION BY block ORDER BY row, w, span) - 1 AS n, count(*) OVER (PARTITION BY block) AS m FROM l WHERE block % 2 = 0),
        s AS (SELECT *, max(n + span - 1) OVER (PARTITION BY block ORDER BY n) <= n AS safe FROM t),
        d AS (SELECT a.block, a.n AS first, a.m, b.n, sum(b.w) OVER z AS cw, max(CASE WHEN b.safe THEN b.n + 1 END) OVER z AS cut FROM s a JOIN s b ON b.block = a.block AND b.n >= a.n WINDOW z AS (PARTITION BY a.block, a.n ORDER BY b.n)),
        e AS (SELECT block, first, coalesce(arg_min(cut, n) FILTER (cut IS NOT NULL AND cw >= 16), any_value(m)) AS stop FROM d GROUP BY 1, 2),
        c AS (SELECT block, 0::BIGINT AS chunk, first, stop FROM e WHERE first = 0 UNION ALL SELECT e.block, c.chunk + 1, e.first, e.stop FROM c JOIN e ON e.block = c.block AND e.first = c.stop),
        g AS (SELECT s.doc, s.block, c.chunk, sum(s.w) AS w FROM c JOIN s ON s.block = c.block AND s.n >= c.first AND s.n < c.stop GROUP BY 1, 2, 3),
        b AS (SELECT doc, block, 0 AS chunk, least(9, sum(w))::BIGINT AS w FROM l WHERE block % 2 > 0 GROUP BY 1, 2 UNION ALL SELECT * FROM g),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY block, chunk) AS i FROM b),
        f AS (SELECT doc, block, chunk, i, 0::BIGINT AS page, w::BIGINT AS used FROM o WHERE i = 1 UNION ALL SELECT o.doc, o.block, o.chunk, o.i, CASE WHEN used + w > 20 THEN page + 1 ELSE page END, CASE WHEN used + w > 20 THEN w ELSE used + w END FROM f JOIN o ON o.doc = f.doc AND o.i = f.i + 1)
        SELECT doc, block, chunk, page FROM f""",
    "stored_binaries": """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
        e AS (SELECT DISTINCT k, n, ['BIN000', 'bin', 'BinaryData'][n % 3 + 1] || n || '.' || ['png', 'OLE', 'jpg'][n % 3 + 1] AS name FROM l WHERE p % 6 > 0 AND n % 3 < 2 AND p % 4 <> 2),
        r AS (SELECT k, s % 9 + 1 AS ref_id, CASE WHEN p % 4 > 0 THEN p % 7 + 1 END AS data_id, ['', 'BMP', 'wmf'][s % 3 + 1] AS ext FROM l),
        d AS (SELECT k, data_id, min({'r': ref_id, 'e': ext}) AS x FROM r WHERE data_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT k, ref_id, min({'r': ref_id, 'e': ext}) AS x FROM r GROUP BY 1, 2),
        m AS (SELECT e.k, e.n::BIGINT AS stream, name, coalesce(d.x, o.x) AS x FROM e LEFT JOIN d ON d.k = e.k AND d.data_id = e.n LEFT JOIN o ON o.k = e.k AND o.ref_id = e.n),
        y AS (SELECT k, stream, name, lower(coalesce(nullif(x.e, ''), string_split(name, '.')[-1])) AS extension, x.r AS ref FROM m), z AS (SELECT *, regexp_matches(name, '\\.(png|jpg)$') OR extension IN ('png', 'jpg', 'bmp') AS image FROM y),
        b AS (SELECT k, stream AS ref, stream, name, extension, image FROM z UNION ALL SELECT k, ref, stream, name, extension, image FROM z WHERE ref > 0)
        SELECT k AS l_orderkey, ref, stream, name, extension, image FROM b QUALIFY row_number() OVER (PARTITION BY k, ref ORDER BY stream DESC, name DESC) = 1""",
    "entries_by_path": r"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, ['sec', 'bin'][l_linenumber % 2 + 1] || l_partkey % 4 AS name FROM lineitem),
        w AS (SELECT DISTINCT k, ['/', '\', 'x/', 'BODY\'][s % 4 + 1] || ['sec', 'bin'][p % 2 + 1] || s % 4 AS path, ['', '', 'x/', 'body/'][s % 4 + 1] AS folder, ['sec', 'bin'][p % 2 + 1] || s % 4 AS name FROM l),
        a AS (SELECT k, name, CASE p % 2 WHEN 0 THEN '' ELSE 'body/' END AS folder, max(n::BIGINT * 10000000 + p) AS id FROM l GROUP BY 1, 2, 3), b AS (SELECT k, name, min(n::BIGINT * 10000000 + p) AS id FROM l GROUP BY 1, 2)
        SELECT w.k AS l_orderkey, path, coalesce(a.id, b.id) AS id FROM w LEFT JOIN a ON a.k = w.k AND a.name = w.name AND a.folder = w.folder LEFT JOIN b ON b.k = w.k AND b.name = w.name""",
    "line_heights": """WITH l AS (SELECT l_orderkey AS k, greatest(CASE WHEN l_suppkey % 3 > 0 THEN l_quantity * 40 ELSE 0 END, CASE WHEN l_partkey % 4 > 0 THEN l_quantity * 300 ELSE 0 END, l_partkey % 2 * 900)::DOUBLE AS h FROM lineitem), s AS (SELECT k, sum(h) AS t, count(*) AS n FROM l WHERE h > 0 AND h <= 14400 GROUP BY 1)
        SELECT k AS l_orderkey, greatest(11, least(96, floor(t / n / 75 + 0.5)))::BIGINT AS line_pixels, greatest(0, least(480, floor(t / 75 + 0.5)))::BIGINT AS layout_pixels FROM s""",
}
