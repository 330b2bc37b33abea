"""Joins, rules, counters and rankings of quality reports, with documents and labels as reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import units
from paperloom.operators import reports
from paperloom.sources.tables import table


def _joined(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("audited"))
    return docs.join(labels, "doc_id", "left")


def audit_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("doc_id", F.coalesce("audited", F.lit(False)).alias("audited"), F.coalesce("quality", F.lit(-1)).alias("quality"))


def audit_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("missing"))


#: Conditions in SQL by the name of the issue, in the order of reports.
RULES = {
    "missing audit": "audited is null",
    "low quality": "quality = 0",
    "toxic": "toxic = 1",
    "too short": "n_chars < 200",
    "too long": "n_chars > 20000",
}


def _rules(*names):
    return reports.rule_list({n: F.expr(RULES[n]) for n in names or RULES})


def guard_issues(spark, sf_dir):
    found = _joined(spark, sf_dir).select("doc_id", F.posexplode(_rules()).alias("n", "issue"))
    priority = F.when(F.col("issue") == "toxic", "P0").when(F.col("issue") == "low quality", "P1").when(F.col("issue") == "missing audit", "P3").otherwise("P2")
    return found.select("doc_id", "n", "issue", priority.alias("priority"))


def issue_priority(spark, sf_dir):
    found = guard_issues(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return found.join(docs, "doc_id").groupBy("source").agg(*[F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")], F.min("priority").alias("worst"))


def doc_status(spark, sf_dir):
    """fail, warn or ok for each document, and the failing rules' names."""
    rows = _joined(spark, sf_dir).withColumns({"fails": _rules("low quality", "toxic"), "warns": _rules("too short", "too long")})
    return rows.select("doc_id", F.when(F.size("fails") > 0, "fail").when(F.size("warns") > 0, "warn").otherwise("ok").alias("state"), F.concat_ws(", ", "fails").alias("failing"))


def structural(spark, sf_dir):
    state = doc_status(spark, sf_dir)
    return state.groupBy("state").agg(F.count("*").alias("docs"))


def worst_documents(spark, sf_dir):
    """The 25 documents with most issues, the most severe first."""
    found = guard_issues(spark, sf_dir).groupBy("doc_id").agg(F.min("priority").alias("worst"), F.count("*").alias("issues"))
    return found.orderBy("worst", F.desc("issues"), "doc_id").limit(25)


def verdicts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 400).alias("diff"))
    judged = lines.groupBy("l_orderkey").agg(F.round(F.avg("diff"), 6).alias("diff"))
    return judged.select("l_orderkey", units.verdict(F.col("diff")).alias("verdict"))


def verdict_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = orders.join(verdicts(spark, sf_dir), "l_orderkey", "left").withColumn("verdict", F.coalesce("verdict", F.lit("missing")))
    return rows.groupBy("o_orderpriority").pivot("verdict", ["close", "review", "mismatch", "missing"]).agg(F.count("verdict")).select("o_orderpriority", *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in ("close", "review", "mismatch", "missing")])


def visual_top(spark, sf_dir):
    """The five orders of each priority whose lines differ most."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.max("l_discount") * 400 + F.count("*"), 4).alias("diff"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return reports.top_by(rows, ["o_orderpriority"], [F.desc(F.coalesce("diff", F.lit(-1.0))), F.asc("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", "diff", "rank")


def freshness_hours(spark, sf_dir):
    """Hours from each user's last event to the newest event of all, and whether that is stale."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = events.agg(F.max("ts").alias("newest"))
    last = events.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(newest))  # one row
    hours = F.round((F.unix_micros("newest") - F.unix_micros("last")) / 3.6e9, 4)
    return last.select("user_id", hours.alias("hours"), (hours > 24).alias("stale"))


def type_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


def top_values(spark, sf_dir):
    """The ten most frequent words of four letters and more."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


def source_languages(spark, sf_dir):
    return reports.histogram_label(table(spark, sf_dir, "documents"), ["source"], "lang", "langs")


def inventory(spark, sf_dir):
    """Parts that were sold and those that were not, with a state."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    rows = table(spark, sf_dir, "part").select("p_partkey").join(sold, "p_partkey", "left")
    state = F.when(F.col("lines").isNull(), "unverified").when(F.col("quantity") < 200, "failed").otherwise("done")
    return rows.select("p_partkey", state.alias("state"), F.coalesce("lines", F.lit(0)).alias("lines"))


def change_detect(spark, sf_dir):
    """Texts that several documents share once white space and case are set aside."""
    digest = F.sha2(F.lower(F.regexp_replace("text", r"[ \n\t\r]+", "")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("docs > 1")


def pixel_diff(spark, sf_dir):
    """Mean absolute difference of each vector and the next, from 0 to 255."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    parts = F.zip_with("embedding", "other", lambda a, b: F.abs(a.cast("double") - b.cast("double")) * 127.5)
    return rows.join(after, "vec_id").select("vec_id", F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size("embedding"), 6).alias("diff"))


def keyword_hits(spark, sf_dir):
    """How often the first word of each benchmark item occurs as a word: documents and hits. Only words that are keys are counted."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.split("text", " ")[0]).alias("word"))
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[ \\t\\n\\r]+")).alias("word"))
    counted = words.where("word <> ''").join(items.select("word").distinct(), "word", "left_semi").groupBy("word", "doc_id").count().groupBy("word").agg(F.count("*").alias("docs"), F.sum("count").alias("hits"))
    return items.join(counted, "word", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("hits", F.lit(0)).alias("hits"))


QUERIES = {f.__name__: f for f in (audit_join, audit_missing, guard_issues, issue_priority, doc_status, structural, worst_documents, verdicts, verdict_counts, visual_top, freshness_hours, type_histogram, top_values, source_languages, inventory, change_detect, pixel_diff, keyword_hits)}

_J = "j AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.doc_id IS NOT NULL AS audited FROM documents d LEFT JOIN labels l USING (doc_id))"
_ISSUES = f"""{_J}, i AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT audited THEN 'missing audit' END, CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'too short' END, CASE WHEN n_chars > 20000 THEN 'too long' END], lambda x: x IS NOT NULL)) AS issue FROM j),
g AS (SELECT doc_id, issue, CASE issue WHEN 'toxic' THEN 'P0' WHEN 'low quality' THEN 'P1' WHEN 'missing audit' THEN 'P3' ELSE 'P2' END AS priority, CASE issue WHEN 'missing audit' THEN 0 WHEN 'low quality' THEN 1 WHEN 'toxic' THEN 2 WHEN 'too short' THEN 3 ELSE 4 END AS k FROM i)"""
_STATE = f"""{_J}, s AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'fail' WHEN n_chars < 200 OR n_chars > 20000 THEN 'warn' ELSE 'ok' END AS state, concat_ws(', ', CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS failing FROM j)"""
_VERDICT = "v AS (SELECT l_orderkey, CASE WHEN diff <= 18 THEN 'close' WHEN diff <= 32 THEN 'review' ELSE 'mismatch' END AS verdict FROM (SELECT l_orderkey, round(avg(l_discount * 400), 6) AS diff FROM lineitem GROUP BY 1))"

ORACLES = {
    "audit_join": f"WITH {_J} SELECT doc_id, audited, coalesce(quality, -1) AS quality FROM j",
    "audit_missing": "SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "guard_issues": f"WITH {_ISSUES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, issue, priority FROM g",
    "issue_priority": f"WITH {_ISSUES} SELECT source, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, min(priority) AS worst FROM g JOIN documents USING (doc_id) GROUP BY 1",
    "doc_status": f"WITH {_STATE} SELECT doc_id, state, failing FROM s",
    "structural": f"WITH {_STATE} SELECT state, count(*) AS docs FROM s GROUP BY 1",
    "worst_documents": f"WITH {_ISSUES} SELECT doc_id, min(priority) AS worst, count(*) AS issues FROM g GROUP BY 1 ORDER BY worst, issues DESC, doc_id LIMIT 25",
    "verdicts": f"WITH {_VERDICT} SELECT l_orderkey, verdict FROM v",
    "verdict_counts": f"""WITH {_VERDICT}, r AS (SELECT o_orderpriority, coalesce(verdict, 'missing') AS verdict FROM orders LEFT JOIN v ON l_orderkey = o_orderkey)
        SELECT o_orderpriority, count(*) FILTER (verdict = 'close') AS close, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'mismatch') AS mismatch, count(*) FILTER (verdict = 'missing') AS missing FROM r GROUP BY 1""",
    "visual_top": """WITH l AS (SELECT l_orderkey, round(max(l_discount) * 400 + count(*), 4) AS diff FROM lineitem GROUP BY 1)
        SELECT o_orderpriority, o_orderkey, diff, row_number() OVER (PARTITION BY o_orderpriority ORDER BY coalesce(diff, -1) DESC, o_orderkey) AS rank FROM orders LEFT JOIN l ON o_orderkey = l_orderkey QUALIFY rank <= 5""",
    "freshness_hours": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), h AS (SELECT user_id, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) / 3.6e9, 4) AS hours FROM l) SELECT user_id, hours, hours > 24 AS stale FROM h",
    "type_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "top_values": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 10",
    "source_languages": "SELECT source, string_agg(lang || '(' || n || ')', ', ' ORDER BY n DESC, lang) AS langs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1",
    "inventory": """WITH s AS (SELECT l_partkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)
        SELECT p_partkey, CASE WHEN lines IS NULL THEN 'unverified' WHEN quantity < 200 THEN 'failed' ELSE 'done' END AS state, coalesce(lines, 0) AS lines FROM part LEFT JOIN s ON l_partkey = p_partkey""",
    "change_detect": r"SELECT sha256(lower(regexp_replace(text, '[ \n\t\r]+', '', 'g'))) AS digest, count(*) AS docs, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1",
    "pixel_diff": """SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * 127.5)) / len(a.embedding), 6) AS diff FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "keyword_hits": r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \t\n\r]+')) AS word FROM documents), c AS (SELECT word, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM w WHERE word <> '' GROUP BY 1)
        SELECT item_id, coalesce(docs, 0) AS docs, coalesce(hits, 0) AS hits FROM benchmark LEFT JOIN c ON word = lower(string_split(text, ' ')[1])""",
}
