"""Pages, markup, text cleaning and format detection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.operators import reports
from paperloom.sources.tables import SIGNATURES, container_format, table


def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(t.hrefs(F.col("html"))).alias("pos", "href"))
    return pages.withColumn("name", t.file_name(F.col("href")))


def link_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href", "name", t.extension(F.col("name")).alias("ext"))


def link_extensions(spark, sf_dir):
    return _links(spark, sf_dir).groupBy(t.extension(F.col("name")).alias("ext")).agg(F.count("*").alias("links"), F.countDistinct("href").alias("urls"))


def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("site"), t.file_name(url).alias("name"))


def clean_text(spark, sf_dir):
    body = t.squeezed(t.named_entities(t.without_tags(F.col("html"))))
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).alias("chars"), F.sha2(body, 256).alias("digest"))


def preview_120(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.shortened(t.squeezed(F.col("text")), 120).alias("preview"))


def tag_histogram(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


#: Elements that have no end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
_TAG = r"<(/?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?)>"


def html_tree_depth(spark, sf_dir):
    """Deepest nesting of each page's paired tags, and how many there are; void elements and self-closed tags aside."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(1))).alias("pos", "tag"))
    name = F.lower(F.regexp_extract("tag", "^/?([a-zA-Z0-9]+)", 1))
    tags = tags.where(~name.isin(VOID) & ~F.endswith("tag", F.lit("/")))
    depth = F.sum(F.when(F.startswith("tag", F.lit("/")), -1).otherwise(1)).over(W.partitionBy("page_id").orderBy("pos"))
    return tags.withColumn("depth", depth).groupBy("page_id").agg(F.max("depth").alias("depth"), F.count("*").alias("tags"))


def script_ratio(spark, sf_dir):
    """Share of accented Latin letters among letters, and whether a text counts as accented."""
    accented, letters = F.regexp_count("text", F.lit("[À-ÿ]")), F.regexp_count("text", F.lit("[A-Za-zÀ-ÿ]"))
    share = F.when(letters > 0, F.round(accented / letters, 6)).otherwise(0.0)
    return table(spark, sf_dir, "documents").select("doc_id", share.alias("share"), ((accented >= 3) & (share >= 0.02)).alias("accented"))


def best_script_run(spark, sf_dir):
    """The longest run of letters in each document, the first of equals."""
    runs = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)), lambda run, pos: F.struct(F.length(run).alias("length"), (-pos).alias("pos"), run.alias("run")))
    best = table(spark, sf_dir, "documents").select("doc_id", F.array_max(runs).alias("best")).where("best is not null")
    return best.groupBy("doc_id").agg(F.max("best").alias("best")).select("doc_id", "best.run")


def nonspace_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", r"\s", "")).alias("score"))


def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


def html_export(spark, sf_dir):
    """Documents as escaped paragraphs."""
    body = F.concat_ws("", F.transform(t.lines(F.col("text")), lambda x: F.concat(F.lit("<p>"), F.when(F.trim(x) == "", "&nbsp;").otherwise(t.escaped(x)), F.lit("</p>"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(body).alias("chars"), F.sha2(body, 256).alias("digest"))


def json_clean(spark, sf_dir):
    """Event properties without empty values, as JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.when(k % 2 == 0, k).alias("k"))).alias("json"))


def magic_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(container_format(F.col("html"), F.col("url")).alias("format")).agg(F.count("*").alias("pages"))


def report_markdown(spark, sf_dir):
    """One line of a Markdown report for each source."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("most"))
    return rows.select("source", F.format_string("| %s | %d | %d | %d |", "source", "n", "chars", "most").alias("line"))


def record_locator(spark, sf_dir):
    """Digest prefix and leading bytes of each text."""
    body = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(body, 256), 1, 24).alias("digest"), F.lower(F.hex(F.substring(body, 1, 16))).alias("head"), F.octet_length("text").alias("size"))


def link_text_labels(spark, sf_dir):
    return reports.histogram_label(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), F.element_at(F.split(F.split("url", "[?#]")[0], "/"), 4).alias("section")).where("section is not null"), ["site"], "section", "sections")


QUERIES = {f.__name__: f for f in (link_extract, link_extensions, url_parts, clean_text, preview_120, tag_histogram, html_tree_depth, script_ratio, best_script_run, nonspace_score, slugs, html_export, json_clean, magic_detect, report_markdown, record_locator, link_text_labels)}

_LINKS = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages),
n AS (SELECT *, string_split(regexp_replace(regexp_replace(href, '[?#].*$', ''), '^[a-z]+://', ''), '/')[-1] AS name FROM l),
e AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext FROM n)"""
_SQUEEZE = r"trim(regexp_replace(regexp_replace(replace(regexp_replace({}, '\r\n|\r|\x02', chr(10), 'g'), chr(160), ' '), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"
_PLAIN = "replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"

ORACLES = {
    "link_extract": f"WITH {_LINKS} SELECT page_id, pos, href, name, ext FROM e",
    "link_extensions": f"WITH {_LINKS} SELECT ext, count(*) AS links, count(DISTINCT href) AS urls FROM e GROUP BY 1",
    "url_parts": r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS site, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/')[-1] AS name FROM pages",
    "clean_text": f"WITH c AS (SELECT page_id, {_SQUEEZE.format(_PLAIN)} AS body FROM pages) SELECT page_id, length(body) AS chars, sha256(body) AS digest FROM c",
    "preview_120": f"WITH c AS (SELECT doc_id, {_SQUEEZE.format('text')} AS body FROM documents) SELECT doc_id, CASE WHEN length(body) > 120 THEN substr(body, 1, 120) || '…' ELSE body END AS preview FROM c",
    "tag_histogram": "WITH g AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM g GROUP BY 1",
    "html_tree_depth": f"""WITH r AS (SELECT page_id, regexp_extract_all(html, '{_TAG}', 1) AS tags FROM pages), u AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM r),
        p AS (SELECT * FROM u WHERE lower(regexp_extract(tag, '^/?([a-zA-Z0-9]+)', 1)) NOT IN ({", ".join(f"'{v}'" for v in VOID)}) AND NOT ends_with(tag, '/')),
        d AS (SELECT page_id, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM p)
        SELECT page_id, max(depth) AS depth, count(*) AS tags FROM d GROUP BY 1""",
    "magic_detect": f"""WITH p AS (SELECT substr(hex(encode(html)), 1, 16) AS head, html, url FROM pages)
        SELECT CASE {" ".join(f"WHEN starts_with(head, '{sign}') THEN '{name}'" for sign, name in SIGNATURES)} WHEN regexp_matches(html, '^\\x{{FEFF}}?[\\t\\n\\r ]{{0,60}}<') THEN 'xml' WHEN contains(url, '.') THEN lower(string_split(url, '.')[-1]) ELSE '' END AS format, count(*) AS pages FROM p GROUP BY 1""",
    "script_ratio": """WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^À-ÿ]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS l FROM documents), s AS (SELECT *, CASE WHEN l > 0 THEN round(a / l, 6) ELSE 0 END AS share FROM c)
        SELECT doc_id, share, a >= 3 AND share >= 0.02 AS accented FROM s""",
    "best_script_run": """WITH r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS runs FROM documents), u AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS pos FROM r)
        SELECT doc_id, run FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(run) DESC, pos) = 1""",
    "nonspace_score": r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS score FROM documents",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(concat_ws(' / ', p_name, p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "html_export": r"""WITH h AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '\r\n|\r|\x02', chr(10), 'g'), chr(10)), lambda x: '<p>' || CASE WHEN trim(x) = '' THEN '&nbsp;' ELSE replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END || '</p>'), '') AS body FROM documents)
        SELECT doc_id, length(body) AS chars, sha256(body) AS digest FROM h""",
    "json_clean": """WITH k AS (SELECT event_id, event_type, (props::JSON->>'$.k')::BIGINT AS k FROM events) SELECT event_id, '{"type":"' || event_type || '"' || CASE WHEN k % 2 = 0 THEN ',"k":' || k ELSE '' END || '}' AS json FROM k""",
    "report_markdown": "SELECT source, '| ' || source || ' | ' || count(*) || ' | ' || sum(n_chars) || ' | ' || max(n_chars) || ' |' AS line FROM documents GROUP BY 1",
    "record_locator": "SELECT doc_id, substr(sha256(text), 1, 24) AS digest, lower(substr(hex(encode(text)), 1, 32)) AS head, strlen(text) AS size FROM documents",
    "link_text_labels": """WITH s AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS site, string_split(regexp_replace(url, '[?#].*$', ''), '/')[4] AS section FROM pages), c AS (SELECT site, section, count(*) AS n FROM s WHERE section IS NOT NULL GROUP BY 1, 2)
        SELECT site, string_agg(section || '(' || n || ')', ', ' ORDER BY n DESC, section) AS sections FROM c GROUP BY 1""",
}
