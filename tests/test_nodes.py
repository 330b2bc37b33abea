"""Trees of elements: crossed and unclosed tags, axes against a plain walk, blocks in cells three deep."""

import random

from pyspark.sql import functions as F

from paperloom.operators import nodes
from paperloom.plans import trees

KINDS = {"table": "table", "tr": "row", "td": "cell", "p": "paragraph", "div": "textbox", "img": "image", "math": "equation"}


def parsed(spark, pages, **more):
    return nodes.parsed(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html", ["br", "img"], **more)


def table_of(spark, pages, **more):
    return nodes.node_table(parsed(spark, pages, **more), "id").persist()


def test_stack_of_crossed_and_unclosed_tags(spark):
    found = table_of(spark, ["<a><b><br>x</a></b><c/>", "<a>", "", None, "</x><?xml?><!-- <q> -->y<A:B z='1'>"]).drop("start").orderBy("id", "node").collect()
    assert [tuple(r) for r in found] == [
        (0, 0, "a", None, 1, 2, True),
        (0, 1, "b", 0, 2, 2, True),
        (0, 2, "br", 1, 3, 2, True),
        (0, 3, "c", None, 1, 3, True),
        (1, 0, "a", None, 1, 0, False),
        (4, 0, "q", None, 1, 1, False),
        (4, 1, "b", 0, 2, 1, False),
    ]


def test_attributes(spark):
    tags = ["<a b='1' x:c=\"&lt;2&amp;\" b=\"3\" d=4 e>", "<a>", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in tags], "tag string").select(nodes.attributes(F.col("tag"))).collect()]
    assert found == [{"c": "<2&", "b": "3"}, {}, None]


def test_axes_are_those_of_the_tree(spark):
    r = random.Random(5)
    pages = []
    for n in (0, 1, 3, 60, 300, 2000):
        tags, depth = [], 0
        for _ in range(n):
            close = depth and r.random() < 0.5
            depth += -1 if close else 1
            tags.append(r.choice(["</a>", "</b>", "</i>"]) if close else r.choice(["<a>", "<b>", "<i>", "<br>"]))
        pages.append("".join(tags))
    pages.append("<a>" * 400)  # a chain of unclosed ones
    rows = table_of(spark, pages)
    tree = {(x.id, x.node): x for x in rows.collect()}
    above = {}
    for k, x in tree.items():
        p, way = x.parent, []
        while p is not None:
            way.append(p)
            p = tree[x.id, p].parent
        above[k] = way
    wanted = rows.where("name = 'b'")
    pairs = nodes.within(rows, wanted, "id").collect()
    assert len(pairs) == len(set(pairs))
    assert {tuple(p) for p in pairs} == {(d, n, a) for (d, n), way in above.items() for a in way if tree[d, a].name == "b"}
    near = {(x.id, x.node): (x.ancestor, x.ancestors) for x in nodes.nearest(rows, wanted, "id").collect()}
    assert near == {(d, n): (max(named, default=None), len(named)) for (d, n), way in above.items() for named in [[a for a in way if tree[d, a].name == "b"]]}
    below = {(x.id, x.node): x.descendants for x in nodes.descendants(rows, "id", F.col("name") == "a", "i").collect()}
    assert below == {(d, n): sum(x.name == "i" and n in above[k] for k, x in tree.items() if k[0] == d) for (d, n), y in tree.items() if y.name == "a"}
    kids = {(x.id, x.node): (x.children, x.named, x.first) for x in nodes.children(rows, "id", "b").collect()}
    for (d, n), said in kids.items():
        own = [k[1] for k, x in tree.items() if k[0] == d and x.parent == n]
        named = [k for k in own if tree[d, k].name == "b"]
        assert said == (len(own), len(named), min(named, default=None))


NESTED = """<p>top &amp; <b>bold</b></p><table><tr><td><p>a</p><p></p><p>b</p></td><td>c<table><tr><td>d<table><tr><td>deep</td><td><img></td></tr></table></td></tr>
<tr><td><div></div></td></tr></table></td></tr></table><div>  <p>in</p><math></math></div>"""


def test_blocks_in_cells_three_deep(spark):
    pages = parsed(spark, [NESTED, "", None], only=list(KINDS))
    walk = {x.node: (x.kind, x.path, x.table_index, x.parent_table, x.nesting) for x in nodes.walk_blocks(pages, "id", KINDS).collect()}
    assert walk[0] == ("paragraph", "block[0]", None, None, 0)
    assert walk[1] == ("table", "block[1]", 0, None, 0)
    assert walk[6] == ("paragraph", "block[1]/row[0]/cell[0]/block[2]", None, 0, 1)
    assert walk[8] == ("table", "block[1]/row[0]/cell[1]/block[0]", 1, 0, 1)
    inner = "block[1]/row[0]/cell[1]/block[0]/row[0]/cell[0]/block[0]"
    assert walk[11] == ("table", inner, 2, 1, 2) and walk[15] == ("image", f"{inner}/row[0]/cell[1]/block[0]", None, 2, 3)
    said = {x.node: x.text for x in nodes.block_texts(pages, "id", KINDS).collect()}
    assert said[0] == "top & bold"
    assert said[1] == "a\nb c\nd\ndeep [이미지]\n[텍스트박스]"
    last = max(said)
    assert said[last] == "[수식]" and said[last - 2] == "in\n[수식]"


def test_no_pages(spark):
    pages = nodes.parsed(spark.createDataFrame([], "id long, html string"), "id", "html", only=list(KINDS))
    assert nodes.walk_blocks(pages, "id", KINDS).count() == nodes.block_texts(pages, "id", KINDS).count() == 0


def test_queries_on_names_hold_no_tags_and_texts(spark):
    sf = "/root/testdata/sf0.001"
    assert trees._parsed(spark, sf).columns == ["page_id", "nodes"]
    assert "start" not in trees._nodes(spark, sf).columns and "start" in trees._nodes(spark, sf, ("start",)).columns


ROWS = """<a:tbl><a:tr x='1'>no<tc><p>ab</p><cellSz height="7"/><tbl><tr>in<tc/><TC><p/>c</TC><cellsz height=' 2e1 '></tr></tbl></tc><tc>d</tc></a:tr>
<tr/><tr><p>none</p></tr><tr><tc><cellSz height='-5'/><cellSz height="x"/></tc></tr></tbl>out<tr><x><tc/></x><tc><cellSz height="NaN"/>e<tr><tc>never <!-- closed -->f"""


def test_rows_are_summed_up_with_the_rows_inside(spark):
    """Rows without cells are left out, and what an inner row has counts for the one around it, closed or not."""
    docs = spark.createDataFrame([(1, ROWS), (2, None), (3, ""), (4, "<tc>x"), (5, "<tr>" * 3000 + "<tc>ab</tc><p/>")], "id long, xml string")
    found = {(x.id, x.node): (x.cells, x.max_height, x.paragraphs, x.text_length) for x in nodes.row_summaries(docs, "id", "xml").collect()}
    nan = found.pop((1, 19))
    assert str(nan) == str((1, float("nan"), 0, 8))
    assert found == {(1, 1): (2, 20.0, 2, 8), (1, 6): (2, 20.0, 1, 3), (1, 15): (1, -5.0, 0, 0), (1, 24): (1, 0.0, 0, 7), (5, 2999): (1, 0.0, 1, 2)}


def test_heights_are_those_of_a_cast(spark):
    said = ["1", " 7\t", "1e3", "5.", ".5", "2F", "1d", "0x1p3", "-0x1p9999", "+3", "1e999", "NaN", "-NaN", "nan", "+nan", "inf", "-Infinity", "x", "", "1_0", "１", "0x1", "1e", None]
    cast = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").orderBy("i").select(F.col("x").try_cast("double")).collect()]
    assert list(map(str, cast)) == [str(nodes._double(x)) for x in said]


def test_tall_rows_shuffle_lines_once_and_no_nodes(spark):
    import io
    from contextlib import redirect_stdout

    from paperloom.plans import cells

    with redirect_stdout(io.StringIO()) as out:
        cells.tall_rows(spark, "/root/testdata/sf0.001").explain()
    plan = out.getvalue()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan
