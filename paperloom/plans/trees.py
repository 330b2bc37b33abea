"""Elements of pages as trees: nodes, axes, attributes, nested blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import nodes
from paperloom.plans.web import VOID
from paperloom.sources.tables import table

#: What elements of the supplied pages stand for.
KINDS = {"ul": "table", "li": "row", "a": "cell", "p": "paragraph", "h1": "paragraph", "div": "textbox", "nav": "textbox", "article": "textbox"}


def _parsed(spark, sf_dir, only=None, held=()):
    return nodes.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", VOID, only, held)


def _nodes(spark, sf_dir, held=()):
    return nodes.node_table(_parsed(spark, sf_dir, held=held), "page_id")


def node_table(spark, sf_dir):
    return _nodes(spark, sf_dir)


def node_attributes(spark, sf_dir):
    return _nodes(spark, sf_dir, ("start",)).select("page_id", "node", F.explode(nodes.attributes(F.col("start"))).alias("name", "value"))


def node_children(spark, sf_dir):
    return nodes.children(_nodes(spark, sf_dir), "page_id", "li")


def node_ancestors(spark, sf_dir):
    """Of each link and emphasis the nearest paragraph or list item above it, and how many there are."""
    rows = _nodes(spark, sf_dir)
    return nodes.nearest(rows.where(F.col("name").isin("a", "b")), rows.where(F.col("name").isin("p", "li")), "page_id")


def node_descendants(spark, sf_dir):
    return nodes.descendants(_nodes(spark, sf_dir), "page_id", F.col("name").isin("body", "nav", "article", "ul", "p"), "p")


def block_walk(spark, sf_dir):
    return nodes.walk_blocks(_parsed(spark, sf_dir, list(KINDS)), "page_id", KINDS)


def block_texts(spark, sf_dir):
    found = nodes.block_texts(_parsed(spark, sf_dir, list(KINDS), ("texts",)), "page_id", KINDS)
    return found.select("page_id", "node", "kind", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (node_table, node_attributes, node_children, node_ancestors, node_descendants, block_walk, block_texts)}


def _tree(only=()):
    """CTEs: k the tags, s the stack after each, n the nodes as node_table has them, with the stack above each."""
    names = f" AND name IN ({', '.join(repr(x) for x in only)})" if only else ""
    void = ", ".join(repr(x) for x in VOID)
    return f"""WITH RECURSIVE g AS (SELECT page_id, regexp_extract_all(html, '<[^<>]+>') AS tags, string_split_regex(html, '<[^<>]+>') AS texts FROM pages),
        r AS (SELECT page_id, unnest(tags) AS tag, unnest(texts[2:]) AS text, unnest(range(len(tags))) AS pos FROM g),
        l AS (SELECT *, lower(regexp_extract(tag, '^<\\s*/?\\s*(?:[A-Za-z_][\\w.-]*:)?([A-Za-z_][\\w.-]*)', 1)) AS name FROM r),
        e AS (SELECT *, CASE WHEN NOT regexp_matches(tag, '^<\\s*/') THEN CASE WHEN regexp_matches(tag, '/\\s*>$') OR name IN ({void}) THEN 3 ELSE 1 END WHEN regexp_matches(tag, '^<\\s*/\\s*[A-Za-z_][\\w:.-]*\\s*>$') THEN 2 END AS kind FROM l WHERE name <> '' AND NOT regexp_matches(tag, '^<[?!]'){names}),
        k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i, count(*) FILTER (kind <> 2) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS node, count(*) FILTER (kind <> 2) OVER (PARTITION BY page_id) - 1 AS most FROM e WHERE kind IS NOT NULL),
        s AS (SELECT page_id, 0::BIGINT AS i, []::BIGINT[] AS ids, []::VARCHAR[] AS names FROM g UNION ALL
            SELECT s.page_id, k.i, CASE kind WHEN 1 THEN list_append(ids, node) WHEN 3 THEN ids ELSE ids[:greatest(0, len(ids) - coalesce(list_position(list_reverse(names), name), len(ids)))] END,
                CASE kind WHEN 1 THEN list_append(names, name) WHEN 3 THEN names ELSE names[:greatest(0, len(names) - coalesce(list_position(list_reverse(names), name), len(names)))] END FROM s JOIN k ON k.page_id = s.page_id AND k.i = s.i + 1),
        c AS (SELECT x.page_id, unnest(x.ids[len(y.ids) + 1:]) AS node, k.node AS last FROM s x JOIN s y ON y.page_id = x.page_id AND y.i = x.i + 1 JOIN k ON k.page_id = y.page_id AND k.i = y.i AND k.kind = 2),
        n AS (SELECT k.page_id, k.node, name, tag, kind, ids AS above, CASE WHEN len(ids) > 0 THEN ids[-1] END AS parent, len(ids) + 1 AS depth, CASE WHEN kind = 3 THEN k.node ELSE coalesce(c.last, most) END AS last, kind = 3 OR c.last IS NOT NULL AS closed
            FROM k JOIN s ON s.page_id = k.page_id AND s.i = k.i - 1 LEFT JOIN c ON c.page_id = k.page_id AND c.node = k.node WHERE kind <> 2)"""


_KIND = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (("ul", "table"), ("li", "row"), ("a", "cell"), ("p", "paragraph"), ("h1", "paragraph"))) + " ELSE 'textbox' END"
_ONLY = ("ul", "li", "a", "p", "h1", "div", "nav", "article")

ORACLES = {
    "node_table": f"{_tree()} SELECT page_id, node, name, parent, depth, last, closed FROM n",
    "node_attributes": rf"""{_tree()}, a AS (SELECT page_id, node, unnest(regexp_extract_all(tag, '([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|''[^'']*'')', 1)) AS name, unnest(regexp_extract_all(tag, '([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|''[^'']*'')', 2)) AS value FROM n)
        SELECT page_id, node, string_split(name, ':')[-1] AS name, replace(replace(replace(replace(replace(value[2:-2], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS value FROM a""",
    "node_children": f"{_tree()} SELECT p.page_id, p.node, count(c.node) AS children, count(c.node) FILTER (c.name = 'li') AS named, min(c.node) FILTER (c.name = 'li') AS first FROM n p LEFT JOIN n c ON c.page_id = p.page_id AND c.parent = p.node GROUP BY 1, 2",
    "node_ancestors": f"{_tree()}, u AS (SELECT page_id, node, unnest(above) AS a FROM n WHERE name IN ('a', 'b')), m AS (SELECT u.page_id, u.node, max(a) AS ancestor, count(*) AS ancestors FROM u JOIN n ON n.page_id = u.page_id AND n.node = a AND n.name IN ('p', 'li') GROUP BY 1, 2) SELECT page_id, node, ancestor, coalesce(ancestors, 0) AS ancestors FROM n LEFT JOIN m USING (page_id, node) WHERE name IN ('a', 'b')",
    "node_descendants": f"{_tree()}, u AS (SELECT page_id, unnest(above) AS node FROM n WHERE name = 'p'), m AS (SELECT page_id, node, count(*) AS c FROM u GROUP BY 1, 2) SELECT page_id, node, coalesce(c, 0) AS descendants FROM n LEFT JOIN m USING (page_id, node) WHERE name IN ('body', 'nav', 'article', 'ul', 'p')",
    "block_walk": f"""{_tree(_ONLY)}, b AS (SELECT *, {_KIND} AS k FROM n), o AS (SELECT *, CASE WHEN k IN ('row', 'cell') THEN k ELSE 'block' END AS sort, CASE WHEN k = 'table' THEN count(*) FILTER (k = 'table') OVER (PARTITION BY page_id ORDER BY node) - 1 END AS table_index FROM b),
        p AS (SELECT *, sort || '[' || (row_number() OVER (PARTITION BY page_id, parent, sort ORDER BY node) - 1) || ']' AS step FROM o),
        u AS (SELECT page_id, node, unnest(above) AS a FROM p), w AS (SELECT u.page_id, u.node, string_agg(step, '/' ORDER BY a) || '/' AS way, max(table_index) AS parent_table, count(table_index) AS nesting FROM u JOIN p ON p.page_id = u.page_id AND p.node = a GROUP BY 1, 2)
        SELECT page_id, node, k AS kind, parent, depth, coalesce(way, '') || step AS path, table_index, parent_table, coalesce(nesting, 0) AS nesting FROM p LEFT JOIN w USING (page_id, node)""",
    "block_texts": f"""{_tree(_ONLY)}, f AS (SELECT r.page_id, r.pos, r.text, max(k.i) AS i FROM r JOIN k ON k.page_id = r.page_id AND k.pos <= r.pos GROUP BY ALL),
        t AS (SELECT f.page_id, s.ids[-1] AS node, string_agg(text, '' ORDER BY pos) AS own FROM f JOIN s ON s.page_id = f.page_id AND s.i = f.i WHERE text <> '' AND len(s.ids) > 0 GROUP BY 1, 2),
        b AS (SELECT page_id, node, parent, {_KIND} AS kind, replace(replace(replace(replace(replace(trim(coalesce(own, '')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS own FROM n LEFT JOIN t USING (page_id, node)),
        w AS (SELECT p.page_id, p.node, p.parent, 'row' AS kind, string_agg(c.own, ' ' ORDER BY c.node) AS text FROM b p LEFT JOIN b c ON c.page_id = p.page_id AND c.parent = p.node AND c.kind = 'cell' WHERE p.kind = 'row' GROUP BY 1, 2, 3),
        q AS (SELECT p.page_id, p.node, p.parent, 'table' AS kind, coalesce(string_agg(c.text, chr(10) ORDER BY c.node), '') AS text FROM b p LEFT JOIN w c ON c.page_id = p.page_id AND c.parent = p.node WHERE p.kind = 'table' GROUP BY 1, 2, 3),
        y AS (SELECT page_id, node, parent, kind, own AS text FROM b WHERE kind IN ('paragraph', 'cell') UNION ALL SELECT page_id, node, parent, kind, coalesce(text, '') FROM w UNION ALL SELECT * FROM q),
        z AS (SELECT page_id, parent AS node, node AS place, text FROM y WHERE kind IN ('paragraph', 'table') UNION ALL SELECT page_id, node, -1, own FROM b WHERE kind = 'textbox' AND own <> ''),
        x AS (SELECT b.page_id, b.node, b.kind, trim(coalesce(string_agg(z.text, chr(10) ORDER BY place), '')) AS text FROM b LEFT JOIN z USING (page_id, node) WHERE b.kind = 'textbox' GROUP BY 1, 2, 3),
        a AS (SELECT page_id, node, kind, text FROM y UNION ALL SELECT page_id, node, kind, CASE text WHEN '' THEN '[텍스트박스]' ELSE text END FROM x)
        SELECT page_id, node, kind, length(text) AS chars, sha256(text) AS digest FROM a""",
}
