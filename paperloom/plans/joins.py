"""Reports reconciled, names and paths looked up, orders by spine and by collation, dictionaries of headers, links resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import urls
from paperloom.operators import headers, nodes, reports
from paperloom.sources.tables import table

c = F.col
_text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


def reconciled(spark, sf_dir):
    """Lines of orders, of which the last counts, against the orders themselves."""
    at = F.concat_ws("|", c("l_linenumber"), c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("int"), c("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 <> 0").select(c("l_orderkey").alias("key"), at.alias("at"), (c("l_quantity").cast("long") % 3).alias("pages"), c("l_returnflag").alias("verdict"))
    verdict = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (c("o_orderkey") % 3).cast("int") + 1)
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(c("o_orderkey").alias("key"), F.lit("").alias("at"), F.when(c("o_custkey") % 4 > 0, c("o_custkey") % 3).alias("pages"), verdict.alias("verdict"))
    found = reports.reconcile(lines, orders, "key", ["pages", "verdict"], "at")
    return found.select("key", "state", F.concat_ws(",", "differing").alias("differing"), c("left.pages").alias("pages"), c("right.pages").alias("other_pages"))


def audit_against(spark, sf_dir):
    """Parts as verified documents, suppliers as audits of them."""
    s = c("s_suppkey")
    brand = _text("brand#", s % 5 + 1, s % 3 + 1, "_", s % 50)
    verified = table(spark, sf_dir, "part").select(_text(F.lower("p_brand"), "_", c("p_size")).alias("filename"), (c("p_partkey") % 4).alias("page_count"))
    verdicts = F.create_map(F.lit("mismatch"), s % 3, F.lit("capture-error"), s % 2, F.lit("review"), s % 5, F.lit("close"), s)
    audited = table(spark, sf_dir, "supplier").select(brand.alias("filename"), (s % 4).alias("page_count"), verdicts.alias("verdicts"), s.alias("at"))
    return reports.audit_findings(verified, audited)


def sample_inventory(spark, sf_dir):
    """Known samples and the documents found beside them, under ids that no other has."""
    s, p = c("s_suppkey"), c("p_partkey")
    known = table(spark, sf_dir, "supplier").select(_text("brand-", s % 25 + 1, "x-", s % 9 + 1).alias("id"), _text("/in/Brand#", s % 25 + 1, "/", s % 50).alias("path"), F.lit("known").alias("kind"))
    known = known.groupBy("path").agg(F.min("id").alias("id"), F.first("kind").alias("kind"))
    found = table(spark, sf_dir, "part").select(p.alias("order"), _text("/in/", c("p_brand"), "/", c("p_size")).alias("path"), F.concat(t.slug(_text(c("p_brand"), "x")), F.when(F.endswith("p_brand", F.lit("1")) & (c("p_size") % 5 == 0), _text("-", c("p_size") % 3 + 2)).otherwise("")).alias("base"))
    new = reports.numbered_ids(found.join(known, "path", "left_anti"), "base", "order", known.select("id"))
    return known.select("id", "path", "kind").unionByName(new.select(c("unique_id").alias("id"), "path", F.lit("found").alias("kind")))


def issue_order(spark, sf_dir):
    """Issues of each language in order: priority, then first words and source as Korean dictionaries sort them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_extract("text", r"^\S+ ?\S*", 0).alias("name"))
    order = [(c("doc_id") % 4).asc(), *reports.korean_order(c("name"), c("source")), c("doc_id").asc()]
    return reports.placed(docs, "lang", order).select("doc_id", "lang", c("place").cast("int").alias("place"))


def name_keys(spark, sf_dir):
    """Keys of names, some of which come decomposed."""
    name = F.regexp_extract("text", r"^\S+", 0)
    apart = F.replace(F.replace(F.replace(F.replace(name, F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ")), F.lit("ü"), F.lit("ü")), F.lit("É"), F.lit("É"))
    given = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), F.when(c("doc_id") % 2 == 0, apart).otherwise(name), F.lit(".HWP ")).alias("name"))
    return given.select("doc_id", t.lookup_key(c("name")).alias("key"), t.extension(t.lookup_key(c("name"))).alias("ext"))


def file_slugs(spark, sf_dir):
    """Names of files from the first words of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", t.file_slug(F.concat(F.regexp_extract("text", r"^\S+[ \t]*\S*", 0), F.when(c("doc_id") % 2 > 0, ".hwp ").otherwise("  --"))).alias("slug"))


def typed_attributes(spark, sf_dir):
    """Values of pages' attributes and of their addresses' last parts: numbers, and what is no number."""
    pages = nodes.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    values = nodes.node_table(pages, "page_id").select("page_id", F.explode(F.map_values(nodes.attributes(c("start")))).alias("value"))
    parts = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "[/?&=#]")).alias("value"))
    typed = t.number_or_text(c("value"))
    found = values.unionByName(parts).select("page_id", typed["number"].alias("number"), typed["text"].alias("text"), t.finite_number(c("value")).alias("finite"))
    return found.groupBy("page_id").agg(F.count("number").alias("numbers"), F.count("text").alias("texts"), F.sum("number").alias("total"), F.count("finite").alias("finite"))


def artifact_paths(spark, sf_dir):
    """The first place where the file of a part is, of four, among the files of suppliers."""
    p, s = c("p_partkey"), c("s_suppkey")
    said = F.when(p % 5 == 0, "").when(p % 7 == 0, None).when(p % 3 == 0, _text("/abs/", c("p_size"), ".png")).otherwise(_text("out/", c("p_size"), ".png"))
    rows = table(spark, sf_dir, "part").select(p, said.alias("path"))
    base, given = F.element_at(F.split("path", "/"), -1), F.length("path") > 0
    tried = F.array(F.when(F.startswith("path", F.lit("/")), c("path")), F.when(given & ~F.startswith("path", F.lit("/")), _text("/root/", c("path"))), F.when(given & ~F.startswith("path", F.lit("/")), _text("/root/reports/", c("path"))), F.when(given, _text("/shots/", base)))
    folder = F.element_at(F.array(*map(F.lit, ["/abs/", "/root/out/", "/root/reports/out/", "/shots/"])), (s % 4).cast("int") + 1)
    existing = table(spark, sf_dir, "supplier").select(_text(folder, s % 50, ".png").alias("path"))
    return headers.first_existing(rows, "p_partkey", tried, existing)


def section_order(spark, sf_dir):
    """Lines of orders as section files, in the order of a spine of suppliers."""
    n = c("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", n)
    files = lines.select("l_orderkey", F.when(n % 2 == 0, _text("Contents/section", n, ".xml")).when(n % 3 == 0, _text("readme", n)).otherwise(_text("contents\\Section", n, ".XML")).alias("path"))
    spine = lines.select("l_orderkey", c("l_partkey").alias("pos"), _text("Contents/section", c("l_suppkey") % 7 + 1, ".xml").alias("href"))
    return headers.spine_order(files, spine, "l_orderkey")


_LANGS = ["HANGUL", "latin", "OTHER", ""]


def _in_order(spark, sf_dir, line, *columns):
    """(l_orderkey, xml): an order's lines one after the other, each as line has it. What is grouped are the numbers that line is made of; the texts, many times as wide, are made after the shuffle."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", *columns).alias("row"))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return rows.select("l_orderkey", F.array_join(F.transform("rows", line), "").alias("xml"))


def _header(row):
    p, s, n = row["l_partkey"], row["l_suppkey"], row["l_linenumber"]
    lang = F.element_at(F.array(*map(F.lit, _LANGS)), (p % 4).cast("int") + 1)
    face = F.when(p % 10 == 0, "").otherwise(_text("F&amp;", p % 50))
    refs = F.concat(F.when(p % 5 > 0, _text(' hangul="', p % 3, '"')).otherwise(""), F.when(s % 5 > 0, _text(" latin='", s % 3, "'")).otherwise(""))
    return F.concat(
        _text('<hh:fontface lang="', lang, '"><hh:font id="', s % 3, '" face="', face, '"/></hh:fontface>'),
        _text('<hh:charPr id="', n, '" height="', (row["l_quantity"] * 7).cast("long"), '"><hh:fontRef', refs, "/>"), F.when(row["l_returnflag"] == "A", "<hh:bold/>").when(row["l_returnflag"] == "R", "<hh:italic/>").otherwise(""), F.lit("</hh:charPr>"),
        _text('<hh:borderFill id="', n, '">'), F.when(p % 3 > 0, _text('<hh:leftBorder type="L', p % 3, '"/>')).otherwise(""), F.when(s % 2 > 0, _text('<hh:topBorder type="T', s % 4, '">')).otherwise(""), F.lit("</hh:topBorder>"[:0]),
        _text('<hc:fillBrush><hc:winBrush faceColor="#', p, '"/></hc:fillBrush></hh:borderFill>'),
    )


def _headers(spark, sf_dir, told):
    """A header for each order, an element of each sort for each line."""
    lines = _in_order(spark, sf_dir, _header, "l_quantity", "l_returnflag")
    return headers.described(nodes.parsed(lines, "l_orderkey", "xml", held=("attributes",), told=told), "l_orderkey")


def font_dictionary(spark, sf_dir):
    return headers.fonts(_headers(spark, sf_dir, ["fontface", "font"]), "l_orderkey")


def character_styles(spark, sf_dir):
    return headers.character_styles(_headers(spark, sf_dir, ["charpr", "fontref", "bold", "italic", "fontface", "font"]), "l_orderkey")


def border_fills(spark, sf_dir):
    return headers.border_fills(_headers(spark, sf_dir, ["borderfill", "leftborder", "rightborder", "topborder", "bottomborder", "winbrush"]), "l_orderkey")


def link_targets(spark, sf_dir):
    """Every link of a page as an address, with up to 120 characters of its text."""
    links = table(spark, sf_dir, "pages").select("page_id", c("url").alias("base"), F.posexplode(urls.anchors(c("html"))).alias("pos", "anchor"))
    said = F.substring(F.trim(t.named_entities(t.without_tags(c("anchor")))), 1, 120)
    return links.select("page_id", "pos", urls.absolute(t.named_entities(urls.address(c("anchor"))), c("base")).alias("url"), said.alias("text"))


def _object(row):
    p, s, n, q = row["l_partkey"], row["l_suppkey"], row["l_linenumber"], row["l_quantity"].cast("long")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)
    pos = _text('<hp:pos treatAsChar="', p % 2, '" allowOverlap="', s % 2, '" flowWithText="', p % 3, '" horzRelTo="', pick(["PAPER", "Column", "x"], p), '" vertRelTo="', pick(["PARA", "page", ""], s), '" horzAlign="', pick(["LEFT", "right", "odd"], s), '" vertOffset="', F.lit(4294967296) - q, '" horzOffset="', q, '"/>')
    sizes = F.concat(F.when(s % 4 > 0, _text('<hp:curSz width="', s % 4 - 1, '" height="', p % 3, '"/>')).otherwise(""), _text('<hp:orgSz width="', q, '" height="', q + 1, '"/>'))
    return F.concat(_text('<hp:pic zOrder="', n, '">'), F.when(p % 4 > 0, pos).otherwise(_text('<hp:offset x="', s, '" y="-', p, '"/>')), sizes, _text('<hp:sz protect="', s % 2, '"/><hp:outMargin left="', p % 9, '"/><hp:x><hc:img binaryItemIDRef="image', s % 5, '"/></hp:x></hp:pic>'))


def _objects(spark, sf_dir, told):
    """An object for each line of an order, as XML."""
    lines = _in_order(spark, sf_dir, _object, "l_quantity")
    return headers.described(nodes.parsed(lines, "l_orderkey", "xml", held=("attributes",), told=told), "l_orderkey")


def object_placements(spark, sf_dir):
    return headers.placements(_objects(spark, sf_dir, ["pic", "pos", "offset", "sz", "outmargin"]), "l_orderkey", ["pic"]).drop("node").withColumn("order", c("order").cast("long"))


def picture_blocks(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), (c("o_custkey") % 5).cast("int"))).alias("k")).select("l_orderkey", _text("image", c("k")).alias("ref"), F.when(c("k") != 1, _text("data:", c("k"))).otherwise("").alias("source"))
    return headers.pictures(_objects(spark, sf_dir, ["pic", "cursz", "orgsz", "img"]), images, "l_orderkey").drop("node")


def table_metrics(spark, sf_dir):
    p, s, n = c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    cells = table(spark, sf_dir, "lineitem").select(c("l_orderkey"), (n % 2).alias("table"), ((n - 1) / 4).cast("long").alias("row"), F.when(p % 3 > 0, p % 3).alias("row_span"), (1 + s % 2).alias("col_span"), F.when(s % 3 > 0, c("l_quantity").cast("double") - 10).alias("height"))
    tables = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("table"), F.element_at(F.array(F.lit(""), F.lit(" cell"), F.lit("0"), F.lit("Split")), (c("o_custkey") % 4).cast("int") + 1).alias("page_break"), F.when(c("o_orderkey") % 3 > 0, c("o_orderkey") % 5).alias("split"))
    found = headers.table_metrics(cells, tables, "l_orderkey", "table")
    return found.withColumn("row_heights", F.array_join(F.transform("row_heights", lambda h: h.cast("long")), ",", "-"))


QUERIES = {f.__name__: f for f in (reconciled, audit_against, sample_inventory, issue_order, name_keys, file_slugs, typed_attributes, artifact_paths, section_order, font_dictionary, character_styles, border_fills, link_targets, object_placements, picture_blocks, table_metrics)}

_LINES = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS i FROM lineitem)"""
_FONTS = f"""{_LINES}, g AS (SELECT k, i, ['HANGUL', 'LATIN', 'OTHER', 'HANGUL'][p % 4 + 1] AS lang, (s % 3)::VARCHAR AS id, CASE WHEN p % 10 = 0 THEN '' ELSE 'F&' || p % 50 END AS face FROM l),
    d AS (SELECT k, lang, id, arg_max(face, i) AS face FROM g GROUP BY 1, 2, 3)"""
_ENCODED = """array_to_string(list_transform(string_split({}, ''), lambda x: CASE WHEN regexp_matches(x, '[^\\x21-\\x7E]|["<>]') THEN url_encode(x) ELSE x END), '')"""

ORACLES = {
    "reconciled": """WITH a AS (SELECT l_orderkey AS key, arg_max({'p': l_quantity::BIGINT % 3, 'v': l_returnflag}, concat_ws('|', l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_returnflag)) AS x FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1),
        b AS (SELECT o_orderkey AS key, {'p': CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 3 END, 'v': ['A', 'N', 'R'][o_orderkey % 3 + 1]} AS y FROM orders WHERE o_orderkey % 5 <> 0),
        j AS (SELECT key, x, y, x IS NOT NULL AND y IS NOT NULL AS met, x.p IS DISTINCT FROM y.p AS dp, x.v IS DISTINCT FROM y.v AS dv FROM a FULL JOIN b USING (key))
        SELECT key, CASE WHEN y IS NULL THEN 'left only' WHEN x IS NULL THEN 'right only' WHEN dp OR dv THEN 'differs' ELSE 'same' END AS state, CASE WHEN NOT met THEN '' ELSE concat_ws(',', CASE WHEN dp THEN 'pages' END, CASE WHEN dv THEN 'verdict' END) END AS differing, x.p AS pages, y.p AS other_pages FROM j""",
    "audit_against": """WITH v AS (SELECT lower(p_brand) || '_' || p_size AS filename, p_partkey % 4 AS pages FROM part), a AS (SELECT 'brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 3 + 1) || '_' || s_suppkey % 50 AS filename, max(s_suppkey) AS s FROM supplier GROUP BY 1)
        SELECT filename, CASE WHEN s IS NULL THEN 'missing' ELSE 'pages differ' END AS finding, NULL::BIGINT AS n FROM v LEFT JOIN a USING (filename) WHERE s IS NULL OR pages <> s % 4
        UNION ALL SELECT filename, 'bad verdicts', s % 3 + s % 2 FROM a WHERE s % 3 + s % 2 > 0 UNION ALL SELECT filename, 'to review', s % 5 FROM a WHERE s % 5 > 0""",
    "sample_inventory": """WITH RECURSIVE w AS (SELECT '/in/Brand#' || (s_suppkey % 25 + 1) || '/' || s_suppkey % 50 AS path, min('brand-' || (s_suppkey % 25 + 1) || 'x-' || (s_suppkey % 9 + 1)) AS id FROM supplier GROUP BY 1),
        f AS (SELECT p_partkey AS o, '/in/' || p_brand || '/' || p_size AS path, 'brand-' || p_brand[7:] || 'x' AS root, 'brand-' || p_brand[7:] || 'x' || CASE WHEN p_brand LIKE '%1' AND p_size % 5 = 0 THEN '-' || (p_size % 3 + 2) ELSE '' END AS base FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY o) AS i FROM f ANTI JOIN w USING (path)),
        g AS (SELECT root, 0::BIGINT AS i, NULL::VARCHAR AS path, NULL::VARCHAR AS id, coalesce((SELECT list(DISTINCT id) FROM w WHERE starts_with(w.id, r.root || '-')), []) AS used FROM (SELECT DISTINCT root FROM n) r
            UNION ALL SELECT n.root, n.i, n.path, x.id, list_append(g.used, x.id) FROM g JOIN n ON n.root = g.root AND n.i = g.i + 1, LATERAL (SELECT list_filter(list_prepend(n.base, list_transform(range(2, len(g.used) + 3), lambda k: n.base || '-' || k)), lambda y: NOT list_contains(g.used, y))[1] AS id) x)
        SELECT id, path, 'known' AS kind FROM w UNION ALL SELECT id, path, 'found' FROM g WHERE i > 0""",
    "issue_order": r"""WITH d AS (SELECT doc_id, lang, source, regexp_extract(text, '^\S+ ?\S*') AS name FROM documents)
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 4, coalesce(name, '') COLLATE ko, coalesce(source, '') COLLATE ko, doc_id)::INT AS place FROM d""",
    "name_keys": r"""SELECT doc_id, coalesce(lower(nfc_normalize(regexp_extract(text, '^\S+'))) || '.hwp', '') AS key, CASE WHEN text IS NULL THEN '' ELSE 'hwp' END AS ext FROM documents""",
    "file_slugs": r"""WITH n AS (SELECT doc_id, coalesce(strip_accents(regexp_extract(text, '^\S+[ \t]*\S*') || CASE WHEN doc_id % 2 > 0 THEN '.hwp ' ELSE '  --' END), '') AS name FROM documents)
        SELECT doc_id, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(name, '[^0-9A-Za-z._-]+', '-', 'g'), '^-+|-+$', '', 'g'), '-+', '-', 'g')), ''), 'document') AS slug FROM n""",
    "typed_attributes": rf"""WITH k AS (SELECT page_id, unnest(list_filter(regexp_extract_all(html, '<[^<>]+>'), lambda x: NOT regexp_matches(x, '^<[?!/]'))) AS tag FROM pages), a AS (SELECT page_id, unnest(regexp_extract_all(tag, '([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|''[^'']*'')', 2)) AS v FROM k),
        v AS (SELECT page_id, v[2:-2] AS v FROM a UNION ALL SELECT page_id, unnest(string_split_regex(url, '[/?&=#]')) FROM pages), n AS (SELECT page_id, v, CASE WHEN regexp_full_match(v, '-?([0-9]+|[0-9]+\.[0-9]+|[0-9]+\.|\.[0-9]+)') THEN v::DOUBLE END AS x FROM v)
        SELECT page_id, count(x) AS numbers, count(*) - count(x) AS texts, sum(x) AS total, count(x) + count(*) FILTER (x IS NULL AND trim(v) = '') + count(*) FILTER (x IS NULL AND trim(v) <> '' AND isfinite(try_cast(v AS DOUBLE))) AS finite FROM n GROUP BY 1""",
    "artifact_paths": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '/abs/' || p_size || '.png' ELSE 'out/' || p_size || '.png' END AS path, p_size FROM part),
        k AS (SELECT p_partkey, unnest(CASE WHEN path IS NULL OR path = '' THEN [] WHEN path[1] = '/' THEN [path, '/shots/' || p_size || '.png'] ELSE ['/root/' || path, '/root/reports/' || path, '/shots/' || p_size || '.png'] END) AS x, generate_subscripts(CASE WHEN path IS NULL OR path = '' THEN [] WHEN path[1] = '/' THEN [1, 2] ELSE [1, 2, 3] END, 1) AS n FROM p),
        e AS (SELECT DISTINCT ['/abs/', '/root/out/', '/root/reports/out/', '/shots/'][s_suppkey % 4 + 1] || s_suppkey % 50 || '.png' AS x FROM supplier),
        m AS (SELECT p_partkey, coalesce(arg_min(k.x, n) FILTER (e.x IS NOT NULL), arg_min(k.x, n)) AS found, count(e.x) > 0 AS "exists" FROM k LEFT JOIN e USING (x) GROUP BY 1)
        SELECT p_partkey, found, coalesce("exists", false) AS "exists" FROM part LEFT JOIN m USING (p_partkey)""",
    "section_order": """WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'Contents/section' || l_linenumber || '.xml' ELSE 'contents\\Section' || l_linenumber || '.XML' END AS path FROM lineitem WHERE l_linenumber % 2 = 0 OR l_linenumber % 3 > 0),
        s AS (SELECT l_orderkey, l_suppkey % 7 + 1 AS n, min(l_partkey) AS pos FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, path, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos NULLS LAST, n) - 1 AS place FROM f LEFT JOIN s USING (l_orderkey, n)""",
    "font_dictionary": f"WITH {_FONTS} SELECT k AS l_orderkey, lang, id, face FROM d",
    "character_styles": f"""WITH {_FONTS}, m AS (SELECT k, id, max(face) FILTER (lang = 'HANGUL' AND face <> '') AS h, max(face) FILTER (lang = 'OTHER' AND face <> '') AS o, max(face) FILTER (lang = 'LATIN' AND face <> '') AS t FROM d GROUP BY 1, 2),
        c AS (SELECT *, CASE WHEN p % 5 > 0 THEN (p % 3)::VARCHAR END AS hg, CASE WHEN s % 5 > 0 THEN (s % 3)::VARCHAR END AS lt FROM l QUALIFY row_number() OVER (PARTITION BY k, n ORDER BY i DESC) = 1),
        r AS (SELECT c.*, coalesce(a.h, a.o, a.t, '') AS font, coalesce(b.t, '') AS lat FROM c LEFT JOIN m a ON a.k = c.k AND a.id = coalesce(hg, lt) LEFT JOIN m b ON b.k = c.k AND b.id = coalesce(lt, hg))
        SELECT k AS l_orderkey, n::BIGINT AS id, font, CASE WHEN lat <> font THEN lat ELSE '' END AS latin, CASE WHEN (q * 7)::BIGINT > 0 THEN floor((q * 7)::BIGINT / 10.0 + 0.5) / 10 ELSE 0 END AS size, f = 'A' AS bold, f = 'R' AS italic FROM r""",
    "border_fills": f"""WITH {_LINES} SELECT k AS l_orderkey, n::BIGINT AS id, CASE WHEN p % 3 > 0 THEN 'L' || p % 3 ELSE 'NONE' END AS "left", 'NONE' AS "right", CASE WHEN s % 2 > 0 THEN 'T' || s % 4 ELSE 'NONE' END AS top, 'NONE' AS bottom, '#' || p AS fill FROM l QUALIFY row_number() OVER (PARTITION BY k, n ORDER BY i DESC) = 1""",
    "link_targets": rf"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^<>]*>.*?</a\s*>') AS anchors FROM pages), u AS (SELECT page_id, url, unnest(anchors) AS anchor, unnest(range(len(anchors))) AS pos FROM a),
        h AS (SELECT page_id, pos, anchor, regexp_extract(anchor, 'href="([^"]*)"', 1) AS ref, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)', 2)) AS site FROM u)
        SELECT page_id, pos, CASE WHEN regexp_matches(ref, '^[a-z]+://[^/]+/') THEN {_ENCODED.format("ref")} ELSE site || {_ENCODED.format("ref")} END AS url, substr(trim(replace(replace(replace(replace(replace(regexp_replace(anchor, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')), 1, 120) AS text FROM h""",
    "object_placements": """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, l_partkey % 4 > 0 AS pos FROM lineitem)
        SELECT l_orderkey, pos AND p % 2 = 1 AS inline, false AS affects_spacing, pos AND p % 3 = 1 AS flows, pos AND s % 2 = 1 AS overlap, false AS keep, s % 2 = 1 AS protected, CASE WHEN pos AND p % 3 = 0 THEN 'paper' ELSE 'column' END AS horz, CASE WHEN pos AND s % 3 = 1 THEN 'page' ELSE 'para' END AS vert, CASE WHEN pos AND s % 3 = 1 THEN 'right' ELSE 'left' END AS across, 'top' AS down,
            CASE WHEN pos THEN q ELSE s END AS x, CASE WHEN pos THEN -q ELSE -p END AS y, n::BIGINT AS "order", (p % 9)::DOUBLE AS margin_left, 0::DOUBLE AS margin_right FROM l""",
    "picture_blocks": """WITH l AS (SELECT l_orderkey, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, s % 4 > 1 AND p % 3 > 0 AS cur FROM lineitem)
        SELECT l_orderkey, 'image' || s % 5 AS ref, 'data:' || s % 5 AS source, CASE WHEN cur THEN s % 4 - 1 ELSE q END::DOUBLE AS width, CASE WHEN cur THEN p % 3 ELSE q + 1 END::DOUBLE AS height FROM l JOIN orders ON o_orderkey = l_orderkey WHERE s % 5 <> 1 AND s % 5 <= o_custkey % 5""",
    "table_metrics": """WITH c AS (SELECT l_orderkey AS k, l_linenumber % 2 AS t, (l_linenumber - 1) // 4 AS r, count(*) AS n, count(*) FILTER (l_partkey % 3 = 2 OR l_suppkey % 2 = 1) AS m, max(l_quantity - 10) FILTER (l_suppkey % 3 > 0 AND l_quantity > 10) AS h FROM lineitem GROUP BY 1, 2, 3),
        w AS (SELECT k, t, count(*) AS rows, sum(n) AS cells, sum(m) AS merged, string_agg(coalesce(h::BIGINT::VARCHAR, '-'), ',' ORDER BY r) AS hs FROM c GROUP BY 1, 2),
        o AS (SELECT o_orderkey AS k, unnest([0, 1]) AS t, ['', 'CELL', '', 'SPLIT'][o_custkey % 4 + 1] AS said, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 ELSE 0 END AS split FROM orders),
        p AS (SELECT *, CASE WHEN said <> '' THEN said ELSE ['NONE', 'CELL', 'SPLIT', 'RESERVED', 'NONE'][split + 1] END AS policy FROM o)
        SELECT k AS l_orderkey, t AS "table", coalesce(rows, 0) AS rows, coalesce(cells, 0) AS cells, coalesce(merged, 0) AS merged, coalesce(hs, '') AS row_heights, policy, split > 0 OR policy <> 'NONE' AS breaks FROM p LEFT JOIN w USING (k, t)""",
}
