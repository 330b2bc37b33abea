"""Runs, tables, styles, numbering and incremental lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import units
from paperloom.operators import reports, runs
from paperloom.sources.tables import table


def order_grid(spark, sf_dir):
    """Extents, merged cells and widest columns of orders read as tables, three columns wide."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 3).alias("col"), (1 + F.col("l_quantity").cast("long") % 3).alias("span"), "l_quantity")
    return cells.groupBy("l_orderkey").agg(F.max("row").alias("rows"), (F.max("col") + 1).alias("cols"), F.count_if(F.col("span") > 1).alias("merged"), *[F.max(F.when((F.col("col") == c) & (F.col("span") == 1), F.col("l_quantity"))).alias(f"width_{c}") for c in range(3)])


def row_heights(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_quantity", F.col("l_discount") * 1000).alias("h"))
    return cells.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.when(F.col("h") > 0, F.col("h"))).alias("height"))


def style_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    starts = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars"), F.lit(200).cast("long"))).alias("at")).withColumn("style", F.floor(F.col("at") / 200) % 5)
    return runs.slice_by_starts(docs.select("doc_id", "text"), starts, "doc_id", "text", "at", "style")


def merge_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    merged = runs.numbered_runs(turns, "conv_id", ["turn", "text"], ["role"])
    joined = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return merged.groupBy("conv_id", "run_no", "role").agg(F.concat_ws("\n", F.transform(joined, lambda x: x["text"])).alias("text"))


def merge_event_runs(spark, sf_dir):
    events = runs.numbered_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return events.groupBy("user_id", "run_no", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def longest_event_run(spark, sf_dir):
    return runs.longest_run(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def trim_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return runs.trim_blank_ends(turns, "conv_id", "turn", F.length("text") < 60)


def list_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    rows = rows.withColumn("place", F.col("l_linenumber") * 10000000 + F.col("l_partkey")).withColumn("level", (F.col("l_partkey") % 3).cast("int"))
    return runs.list_markers(rows, "l_orderkey", "place", "level", 3).select("l_orderkey", "place", "marker")


def style_cascade(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    own = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("")
    return joined.select("c_custkey", reports.overlaid(own, F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")), F.col("r_name")).alias("style"))


def dictionary_fallback(spark, sf_dir):
    """A lookup by key that falls back to the key after it."""
    part = table(spark, sf_dir, "part").where("p_size % 2 = 0").select("p_partkey", "p_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    direct, after = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("direct")), part.select((F.col("p_partkey") - 1).alias("l_partkey"), F.col("p_name").alias("after"))
    return rows.join(direct, "l_partkey", "left").join(after, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("direct", "after").alias("name"))


def font_chain(spark, sf_dir):
    """Substitution from each part to half its key until one whose size is registered, 15 hops at most."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    edges = part.select("p_partkey", F.when((F.col("p_size") % 5 == 0) | (F.col("p_partkey") <= 1), F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 2)).alias("to"))
    return reports.follow(edges, "p_partkey", "to")


def recents_top20(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    first = reports.top_by(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).drop("rank")
    return first.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


def map_merge(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).where("k is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"))


def record_inventory(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    sums = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value"), F.max("hour").alias("top_hour"))
    levels = reports.histogram_label(events, ["event_type"], "hour", "hours")
    examples = reports.first_examples(events, ["event_type"], ["ts", "event_id"], "event_id", 5, "examples")
    return sums.join(levels, "event_type").join(examples, "event_type")


def delta_ops(spark, sf_dir):
    """Conversations as ordered inserts: text, then a line end that carries the role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ops = F.array(F.struct(F.col("text").alias("insert"), F.lit(None).cast("string").alias("attribute")), F.struct(F.lit("\n").alias("insert"), F.col("role").alias("attribute")))
    return turns.select("conv_id", "turn", F.posexplode(ops).alias("op", "o")).select("conv_id", "turn", "op", "o.*").where(F.length("insert") > 0)


def delta_roundtrip(spark, sf_dir):
    """Ops back to lines; equal to what went in."""
    ops = delta_ops(spark, sf_dir)
    lines = ops.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("insert") != "\n", F.col("insert"))).alias("text"), F.max("attribute").alias("role"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("role0"), F.col("text").alias("text0")).distinct()
    return lines.join(turns, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("turns"), F.count_if((F.col("text") == F.col("text0")) & (F.col("role") == F.col("role0"))).alias("same"))


def unit_px(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    units_ = (F.col("p_retailprice") * 10).cast("long")
    return part.select("p_partkey", units.pixels(units_, 11, 96).alias("clamped"), units.pixels(units_).alias("px"), units.rounded(F.col("p_retailprice") - 1500, 1).alias("signed"))


def colour_ref(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", units.colour((F.col("p_partkey") * 7919 + F.col("p_size")).cast("long")).alias("colour"))


def enum_maps(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", units.border_width(F.col("p_size") - 10).alias("border"), units.break_policy(F.col("p_size")).alias("policy"))


def unique_ids(spark, sf_dir):
    return reports.numbered_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_id")


def link_latest_100(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(t.hrefs(F.col("html"))).alias("pos", "href"))
    last = reports.last_by(pages, "href", F.struct("page_id", "pos"), ["page_id", "pos"])
    return last.orderBy(F.desc("page_id"), "first_seen").limit(100).select("href", "page_id", "pos")


QUERIES = {f.__name__: f for f in (order_grid, row_heights, style_runs, merge_turns, merge_event_runs, longest_event_run, trim_turns, list_numbering, style_cascade, dictionary_fallback, font_chain, recents_top20, map_merge, record_inventory, delta_ops, delta_roundtrip, unit_px, colour_ref, enum_maps, unique_ids, link_latest_100)}

_RUNS = """marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run_no FROM marked)"""
_HREFS = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages)"""

ORACLES = {
    "order_grid": """WITH c AS (SELECT l_orderkey, l_linenumber AS r, l_partkey % 3 AS col, 1 + l_quantity::BIGINT % 3 AS span, l_quantity FROM lineitem)
        SELECT l_orderkey, max(r) AS rows, max(col) + 1 AS cols, count(*) FILTER (span > 1) AS merged, max(l_quantity) FILTER (col = 0 AND span = 1) AS width_0, max(l_quantity) FILTER (col = 1 AND span = 1) AS width_1, max(l_quantity) FILTER (col = 2 AND span = 1) AS width_2 FROM c GROUP BY 1""",
    "row_heights": "SELECT l_orderkey, l_linenumber, max(greatest(l_quantity, l_discount * 1000)) FILTER (greatest(l_quantity, l_discount * 1000) > 0) AS height FROM lineitem GROUP BY 1, 2",
    "style_runs": """WITH s AS (SELECT doc_id, text, unnest(range(0, n_chars + 1, 200)) AS place FROM documents)
        SELECT doc_id, place // 200 AS run_no, (place // 200) % 5 AS style, substr(text, place + 1, 200) AS slice FROM s WHERE length(substr(text, place + 1, 200)) > 0""",
    "merge_turns": """WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
        n AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn, text)::BIGINT AS run_no FROM m)
        SELECT conv_id, run_no, role, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM n GROUP BY 1, 2, 3""",
    "merge_event_runs": f"WITH {_RUNS} SELECT user_id, run_no, event_type, count(*) AS n, round(sum(value), 4) AS value FROM numbered GROUP BY 1, 2, 3",
    "longest_event_run": f"""WITH {_RUNS}, g AS (SELECT user_id, run_no, event_type, count(*) AS length FROM numbered GROUP BY 1, 2, 3)
        SELECT user_id, event_type, length FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, run_no) = 1""",
    "trim_turns": """WITH b AS (SELECT conv_id, turn, text, min(CASE WHEN length(text) >= 60 THEN turn END) OVER (PARTITION BY conv_id) AS a, max(CASE WHEN length(text) >= 60 THEN turn END) OVER (PARTITION BY conv_id) AS z FROM conversations)
        SELECT conv_id, turn, text FROM b WHERE turn BETWEEN a AND z""",
    "list_numbering": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT * 10000000 + l_partkey AS place, (l_partkey % 3)::INT AS level FROM lineitem),
        g AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w AS g1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS g2 FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
        c AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY place) AS c0, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, g1 ORDER BY place) AS c1, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, g2 ORDER BY place) AS c2 FROM g)
        SELECT l_orderkey, place, CASE WHEN c0 > 0 THEN c0::VARCHAR ELSE '' END || CASE WHEN level >= 1 THEN '.' || CASE WHEN c1 > 0 THEN c1::VARCHAR ELSE '' END ELSE '' END || CASE WHEN level >= 2 THEN '.' || CASE WHEN c2 > 0 THEN c2::VARCHAR ELSE '' END ELSE '' END AS marker FROM c""",
    "style_cascade": """SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE '' END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN n_name END, ''), nullif(r_name, '')) AS style
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "dictionary_fallback": """WITH p AS (SELECT p_partkey, p_name FROM part WHERE p_size % 2 = 0)
        SELECT l_orderkey, l_linenumber, l_partkey, coalesce(a.p_name, b.p_name) AS name FROM lineitem LEFT JOIN p a ON a.p_partkey = l_partkey LEFT JOIN p b ON b.p_partkey = l_partkey + 1""",
    "font_chain": """WITH RECURSIVE e AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_partkey <= 1 THEN p_partkey ELSE p_partkey // 2 END AS nxt FROM part),
        walk AS (SELECT p_partkey, p_partkey AS final, 0 AS steps, [p_partkey] AS path, false AS closed FROM e UNION ALL SELECT w.p_partkey, e.nxt, w.steps + 1, list_append(w.path, e.nxt), list_contains(w.path, e.nxt) FROM walk w JOIN e ON e.p_partkey = w.final WHERE e.nxt <> w.final AND NOT w.closed AND w.steps < 15)
        SELECT p_partkey, arg_max(final, steps) AS final, max(steps) AS steps FROM walk GROUP BY 1""",
    "recents_top20": "WITH f AS (SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM f ORDER BY ts DESC, event_id DESC LIMIT 20",
    "map_merge": "SELECT event_type, (props::JSON->>'$.k')::BIGINT AS k, count(*) AS n FROM events WHERE (props::JSON->>'$.k') IS NOT NULL GROUP BY 1, 2",
    "record_inventory": """WITH s AS (SELECT event_type, count(*) AS n, round(sum(value), 3) AS value, max(hour(ts)) AS top_hour FROM events GROUP BY 1),
        h AS (SELECT event_type, string_agg(hr || '(' || c || ')', ', ' ORDER BY c DESC, hr::VARCHAR) AS hours FROM (SELECT event_type, hour(ts) AS hr, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1),
        x AS (SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS examples FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 5) GROUP BY 1)
        SELECT * FROM s JOIN h USING (event_type) JOIN x USING (event_type)""",
    "delta_ops": """SELECT conv_id, turn, 0 AS op, text AS insert, NULL AS attribute FROM conversations WHERE length(text) > 0 UNION ALL SELECT conv_id, turn, 1, chr(10), role FROM conversations""",
    "delta_roundtrip": """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), o AS (SELECT conv_id, turn, max(nullif(text, '')) AS text, max(role) AS role FROM conversations GROUP BY 1, 2)
        SELECT o.role, count(*) AS turns, count(*) FILTER (o.text = t.text AND o.role = t.role) AS same FROM o JOIN t USING (conv_id, turn) GROUP BY 1""",
    "unit_px": "WITH p AS (SELECT p_partkey, p_retailprice, trunc(p_retailprice * 10)::BIGINT AS u FROM part) SELECT p_partkey, least(greatest(floor(u / 75.0 + 0.5), 11), 96)::BIGINT AS clamped, floor(u / 75.0 + 0.5)::BIGINT AS px, floor((p_retailprice - 1500) * 10 + 0.5) / 10 AS signed FROM part JOIN p USING (p_partkey, p_retailprice)",
    "colour_ref": "WITH c AS (SELECT p_partkey, p_partkey * 7919 + p_size AS v FROM part) SELECT p_partkey, printf('#%02x%02x%02x', v & 255, (v >> 8) & 255, (v >> 16) & 255) AS colour FROM c",
    "enum_maps": """SELECT p_partkey, CASE WHEN p_size - 10 BETWEEN 0 AND 15 THEN ([0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0])[p_size - 10 + 1] ELSE 0.1 END::DOUBLE AS border,
        (['NONE', 'CELL', 'SPLIT', 'RESERVED'])[p_size % 4 + 1] AS policy FROM part""",
    "unique_ids": "SELECT doc_id, source || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS unique_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
    "link_latest_100": f"""WITH {_HREFS}, g AS (SELECT href, max(page_id * 100000 + pos) AS l, min(page_id * 100000 + pos) AS f FROM hrefs GROUP BY 1)
        SELECT href, l // 100000 AS page_id, l % 100000 AS pos FROM g ORDER BY l // 100000 DESC, f LIMIT 100""",
}
