"""Streams over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.sources.tables import scratch, table
from paperloom.streaming import links


def stream_links(spark, sf_dir):
    return links.run_to_files(links.observe(links.page_stream(spark, sf_dir)), scratch(spark, "links"))


def stream_latest_links(spark, sf_dir):
    return links.keep_latest(links.page_stream(spark, sf_dir), scratch(spark, "latest")).select("href", "page_id", "pos")


def event_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return links.sessions(events).select("user_id", F.unix_micros("w.start").alias("start"), "n", "last_event")


QUERIES = {f.__name__: f for f in (stream_links, stream_latest_links, event_sessions)}

ORACLES = {
    "stream_links": """SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""",
    "stream_latest_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages),
        g AS (SELECT href, max(page_id * 100000 + pos) AS l, min(page_id * 100000 + pos) AS f FROM l GROUP BY 1) SELECT href, l // 100000 AS page_id, l % 100000 AS pos FROM g ORDER BY l // 100000 DESC, f LIMIT 100""",
    "event_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
        SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY user_id, session""",
}
