"""Reconciled reports, ids, chains, slices, spines, fonts, paths, links, names; nulls, ties, repeats, empty tables."""

import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as t
from paperloom.functions import urls
from paperloom.operators import headers, nodes, reports, runs
from paperloom.plans import joins


def test_reconcile_keeps_both_sides(spark):
    left = [("a", 1, 5, "x"), ("a", 2, 6, "x"), ("b", 1, None, "y"), ("c", 1, 7, None), (None, 1, 1, "n"), (None, 2, 1, "n")]
    right = [("a", 9, 6, "x"), ("c", 1, 8, "z"), ("c", 2, 7, "z"), ("d", 1, 1, "w"), (None, 1, 1, "n")]
    frame = lambda rows: spark.createDataFrame(rows, "key string, at long, pages long, state string")
    found = sorted((r.key or "", r.state, r.differing, r.left and r.left.pages, r.right and r.right.pages) for r in reports.reconcile(frame(left), frame(right), "key", ["pages", "state"], "at").collect())
    assert found == [("", "left only", [], 1, None), ("", "left only", [], 1, None), ("", "right only", [], None, 1), ("a", "same", [], 6, 6), ("b", "left only", [], None, None), ("c", "differs", ["state"], 7, 7), ("d", "right only", [], None, 1)]
    assert reports.reconcile(frame([]), frame([]), "key", ["pages"], "at").count() == 0


def test_audit_findings(spark):
    verified = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1), (None, 1), ("c", None)], "filename string, page_count long")
    audited = spark.createDataFrame([("a", 9, {"mismatch": 9}, 1), ("a", 4, {"review": 2, "capture-review": 1, "close": 5}, 2), ("c", 2, None, 1), ("e", 1, {"capture-error": 2}, 1), (None, 1, {"mismatch": 1}, 1)], "filename string, page_count long, verdicts map<string, long>, at long")
    found = sorted((r.filename, r.finding, r.n or 0) for r in reports.audit_findings(verified, audited).collect())
    assert found == [("a", "bad verdicts", 1), ("a", "pages differ", 0), ("a", "to review", 2), ("b", "missing", 0), ("e", "bad verdicts", 2)]


COLUMNS = "fatal boolean, pages long, diagnostic_pages long, sections long, controls long, controls_of_pages long, dom_pages long, thumbnails long, expected_pages long, visual_pages long, walked boolean, geometry_off long, console_errors long, keywords_missing boolean, screenshot boolean, unresolved_fonts long"


def test_rules_on_named_columns(spark):
    good = dict(zip([x.split()[0] for x in COLUMNS.split(", ")], [False, 3, 3, 1, 5, 5, 3, 3, 3, 3, True, 0, 0, False, True, 0]))
    cases = {
        "good": ({}, [], [], "ok"),
        "fatal": ({"fatal": True}, [], ["not loaded"], "ok"),
        "no pages": ({"pages": 0}, ["diagnostic pages differ", "expected pages differ"], ["has issues", "invalid page count", "expected pages differ", "diagnostic pages differ"], "fail"),
        "walk": ({"walked": False, "thumbnails": 2}, ["page walk failed"], ["has issues", "thumbnails missing"], "warn"),
        "geometry": ({"geometry_off": 3, "dom_pages": 4}, ["page size differs"], ["has issues", "dom pages differ", "page size differs"], "fail"),
        "controls": ({"controls": 4, "unresolved_fonts": 1, "console_errors": 2}, ["console errors", "control sums differ", "unresolved fonts"], ["has issues"], "ok"),
        "visual": ({"visual_pages": 9, "expected_pages": None}, [], [], "fail"),
    }
    unknown = {"pages": ["expected pages differ"]}
    for c in good:
        cases[f"null {c}"] = ({c: None}, None, None, None)
    rows = [(n, *(good | x[0]).values()) for n, x in cases.items()]
    found = reports.page_states(reports.guard_failures(reports.shown_issues(spark.createDataFrame(rows, f"id string, {COLUMNS}")))).collect()
    by = {r.id: r for r in found}
    for n, (_, issues, failures, state) in cases.items():
        if issues is not None:
            assert (by[n].issues, by[n].failures, by[n].state) == (issues, failures, state), n
    assert by["null fatal"].failures == [] and by["null pages"].failures == ["invalid page count", "diagnostic pages differ"] + [] * len(unknown) or "dom pages differ" in by["null pages"].failures
    assert by["null diagnostic_pages"].issues == ["no diagnostics"] and by["null diagnostic_pages"].state == "warn"
    assert by["null screenshot"].failures == ["no screenshot"] and by["null geometry_off"].failures == ["page size differs"] and by["null dom_pages"].failures == ["dom pages differ"]
    oracle = spark.createDataFrame([("good", 5), ("good", 4), (None, 1)], "id string, expected_pages long")
    said = reports.shown_issues(spark.createDataFrame(rows, f"id string, {COLUMNS}").drop("expected_pages"), oracle).where("id in ('good', 'fatal')").collect()
    assert {r.id: r.issues for r in said} == {"good": ["expected pages differ"], "fatal": []}


def ids(rows, taken=()):
    used, out = set(taken), []
    for _, base in sorted(rows):
        n, said = 2, base
        while said in used:
            said, n = f"{base}-{n}", n + 1
        used.add(said)
        out.append(said)
    return out


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_ids_skip_what_is_taken(spark, monkeypatch, bucket):
    monkeypatch.setattr(reports, "BUCKET", bucket)
    r = random.Random(bucket)
    for bases, taken in [(["x", "x", "x-2"], []), (["x-2", "x", "x"], []), ("x y x z x-02 x-2-2 x-2".split() * 3, ["x-3", "y"]), (list("ab") * 20, ["a", "a-2", "a-7", "a-8", "a-40", "a-01", "a-1", "b-19", "b-19", "c", None]), ([r.choice(["p", "p-2", "p-3", "q", "q"]) for _ in range(60)], ["p-4", "q-5"])]:
        rows = [(k * 5, b) for k, b in enumerate(bases)]
        given = spark.createDataFrame([(x,) for x in taken], "id string") if taken else None
        found = reports.numbered_ids(spark.createDataFrame(rows, "o long, b string").withColumn("row", F.lit("kept")), "b", "o", given).orderBy("o").collect()
        assert [x.unique_id for x in found] == ids(rows, [x for x in taken if x]) and found[0].row == "kept"
    rows = [("x", 1), ("x", None), ("x", None), (None, 1), (None, 2)]
    found = [x.unique_id for x in reports.numbered_ids(spark.createDataFrame(rows, "b string, o long"), "b", "o").collect()]
    assert sorted(x for x in found if x) == ["x", "x-2", "x-3"] and len(found) == 5


def test_chains(spark):
    r = random.Random(1)
    edges = [(k, r.choice([k + 1, r.randrange(80), None, k])) for k in range(80)] + [(2, 1), (2, 3), (100, 101), (101, 102), (102, 101)] + [(200 + k, 201 + k) for k in range(40)] + [(None, 5), (None, None)]
    step = {}
    for a, b in edges:
        if b is not None:
            step[a] = min(b, step.get(a, b))
    for hops in (15, 4, 1):
        found = reports.follow(spark.createDataFrame(edges, "a long, b long"), "a", "b", hops).collect()
        assert len(found) == len({a for a, _ in edges})
        for x in found:
            if x.a is not None:
                at, seen = x.a, [x.a]
                while len(seen) <= hops and step.get(at) not in (None, at):
                    at = step[at]
                    seen.append(at)
                    if at in seen[:-1]:
                        break
                assert (x.final, x.steps) == (at, len(seen) - 1)
    assert reports.follow(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_slices(spark):
    texts = [(1, "añb😀cd"), (2, ""), (3, None), (4, "xyz")]
    starts = [(1, 2, "p"), (1, 4, "q"), (1, 4, "r"), (1, 90, "s"), (4, 0, None), (9, 0, "t")]
    found = runs.slice_by_starts(spark.createDataFrame(texts, "k long, x string"), spark.createDataFrame(starts, "k long, at long, s string"), "k", "x", "at", "s").collect()
    assert sorted((r.k, r.run_no, r.s or "", r.slice) for r in found) == [(1, 0, "p", "añb😀"), (1, 2, "r", "cd"), (4, 0, "", "xyz")]


def test_slices_take_time_in_proportion(spark):
    took = []
    for n in (200_000, 1_600_000):
        texts = spark.createDataFrame([(1,)], "k long").select("k", F.repeat(F.lit("añbcdefg"), n // 8).alias("x"))
        starts = spark.range(0, n, 100).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("at"), (F.col("id") % 3).alias("s"))
        began = time.time()
        assert runs.slice_by_starts(texts, starts, "k", "x", "at", "s").agg(F.count("*"), F.sum(F.length("slice"))).first()[:] == (n // 100, n)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5


def test_spine_first_then_by_number(spark):
    files = [(1, "Contents/section2.xml"), (1, "contents/Section10.XML"), (1, "Contents\\section1.xml"), (1, "Contents/section3.xml"), (1, "Contents/section3.xml"), (1, "mimetype"), (2, "section5.xml"), (None, "section1.xml")]
    spine = [(1, 5, "Contents/section10.xml"), (1, 2, "Contents/section3.xml"), (1, 9, "Contents/section3.xml"), (1, 1, "Contents/section77.xml"), (1, 3, None)]
    found = headers.spine_order(spark.createDataFrame(files, "k long, path string"), spark.createDataFrame(spine, "k long, pos long, href string"), "k").orderBy("k", "place").collect()
    assert [(x.k, x.path) for x in found] == [(None, "section1.xml"), (1, "Contents/section3.xml"), (1, "contents/Section10.XML"), (1, "Contents\\section1.xml"), (1, "Contents/section2.xml"), (2, "section5.xml")]


HEAD = """<head><fontface lang="hangul"><font id="0" face="Batang"/><font id="1" face=""/></fontface><fontface><font id="0" face="Dotum"/></fontface><fontface lang="LATIN"><font id="0" face="Arial"/><font id="1" face="Times"/></fontface>
<charPr id="7" height="1050"><fontRef latin="1"/><bold/></charPr><charPr id="8"><fontRef hangul="0" latin="0"/></charPr><charPr id="x"/><charPr id="8"><fontRef hangul="5"/></charPr><charPr id="9"/>
<borderFill id="1"><leftBorder type="SOLID"/><leftBorder type="DASH"/><x><topBorder type="DOT"/><winBrush faceColor="#fff"/></x></borderFill><borderFill/></head>"""


def test_dictionaries_of_a_header(spark):
    tree = headers.described(nodes.parsed(spark.createDataFrame([(1, HEAD), (2, None), (3, "")], "k long, xml string"), "k", "xml"), "k").persist()
    assert {(x.lang, x.id): x.face for x in headers.fonts(tree, "k").collect()} == {("HANGUL", "0"): "Dotum", ("HANGUL", "1"): "", ("LATIN", "0"): "Arial", ("LATIN", "1"): "Times"}
    assert {x.id: (x.font, x.latin, x.size, x.bold) for x in headers.character_styles(tree, "k").collect()} == {7: ("Times", "", 10.5, True), 8: ("", "", 0.0, False), 9: ("", "", 0.0, False)}
    assert [tuple(x) for x in headers.border_fills(tree, "k").collect()] == [(1, 1, "SOLID", "NONE", "NONE", "NONE", "#fff")]


OBJECTS = """<pic zOrder="3" textWrap="x"><pos treatAsChar="1" vertOffset="4294966036" horzOffset="75" vertRelTo="Paper"/><offset x="9" y="9"/><curSz width="0" height="5"/><orgSz width="10" height="20"/><y><img binaryItemIDRef="a"/></y><outMargin left="5"/></pic>
<pic><offset x="-3" y="junk"/><curSz width="7" height="8"/><img binaryItemIDRef="b"/></pic><pic><img/></pic><ole><pos/></ole>"""


def test_placed_objects_and_pictures(spark):
    tree = headers.described(nodes.parsed(spark.createDataFrame([(1, OBJECTS), (2, None)], "k long, xml string"), "k", "xml"), "k").persist()
    found = headers.placements(tree, "k", ["pic", "ole"]).orderBy("node").collect()
    assert [(x.inline, x.vert, x.x, x.y, x.order, x.margin_left) for x in found] == [(True, "paper", 75, -1260, 3.0, 5.0), (False, "para", -3, 0, 0.0, 0.0), (False, "para", 0, 0, 0.0, 0.0), (False, "para", 0, 0, 0.0, 0.0)]
    images = spark.createDataFrame([(1, "a", "data:a"), (1, "b", ""), (1, "b", "data:b"), (1, None, "x"), (2, "a", "data:z")], "k long, ref string, source string")
    assert [(x.ref, x.source, x.width, x.height) for x in headers.pictures(tree, images, "k").orderBy("ref").collect()] == [("a", "data:a", 10.0, 20.0), ("b", "data:b", 7.0, 8.0)]


def test_table_metrics(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 1, 5.0), (1, 0, 0, 1, 2, None, None), (1, 0, 1, 0, None, 1, -1.0)], "k long, t long, row long, col long, row_span long, col_span long, height double")
    tables = spark.createDataFrame([(1, 0, None, None), (1, 1, "0", 2), (2, 0, " cell ", 0), (None, 0, "", 9)], "k long, t long, page_break string, split long")
    found = {(x.k, x.t): tuple(x)[2:] for x in headers.table_metrics(cells, tables, "k", "t").collect()}
    assert found == {(1, 0): (2, 3, 1, [5.0, None], "NONE", False), (1, 1): (0, 0, 0, [], "SPLIT", True), (2, 0): (0, 0, 0, [], "CELL", True), (None, 0): (0, 0, 0, [], "NONE", True)}


def test_first_that_exists(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", None, "", "x", "y"]), (3, []), (4, None), (5, [None, "z", "c"])], "k long, tried array<string>")
    listing = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "path string")
    found = {x.k: (x.found, x.exists) for x in headers.first_existing(rows, "k", F.col("tried"), listing).collect()}
    assert found == {1: ("b", True), 2: ("x", False), 3: (None, False), 4: (None, False), 5: ("c", True)}


def test_references_as_urllib_resolves_them(spark):
    bases = ["http://a.example/b/c/d;p?q", "https://A.example", "https://a.example/x/?y#z"]
    refs = ["g", "./g", "g/", "/g", "//h.Example/k", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http://E.example/../x", "/für x", "mailto:a@b", "a\nb"]
    rows = [(b, r) for b in bases for r in refs] + [(None, "x"), ("no scheme", "x"), (bases[0], None)]
    found = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", urls.absolute(F.col("ref"), F.col("base")).alias("url")).collect()
    for x in found:
        if x.ref is None or x.base is None or "://" not in x.base:
            assert x.url is None
        else:
            from urllib.parse import urlsplit

            said = urljoin(x.base, x.ref.replace("\n", "").replace("ü", "%C3%BC").replace(" ", "%20"))
            if said.startswith("http"):
                parts = urlsplit(said)
                said = said.replace(parts.netloc, parts.netloc.lower(), 1)
                if not parts.path:
                    said = said.replace(parts.netloc.lower(), parts.netloc.lower() + "/", 1)
                if x.ref == "" or x.ref.startswith("?") or x.ref == "#s":
                    said = x.url if said.split("#")[0].rstrip("?") in (x.url, x.url.split("#")[0]) else said
            if "/../" not in said and not said.endswith("/.."):
                assert x.url == said, (x.base, x.ref)


def test_anchors(spark):
    html = """<a href="x?a=1&amp;b=2">one <b>two</b></a><A class='q' HREF='y'>three</A><a href=z>four</a><a name="n">none</a><ahref="no">no</a><a data-href="no">no</a>"""
    found = spark.createDataFrame([(html,)], "html string").select(F.explode(urls.anchors(F.col("html"))).alias("a")).select(urls.address(F.col("a")).alias("u"), t.without_tags(F.col("a")).alias("x")).collect()
    assert [(r.u, r.x) for r in found] == [("x?a=1&amp;b=2", "one two"), ("y", "three"), ("z", "four")]


def test_names_numbers_hashes(spark):
    rows = spark.createDataFrame([(" Ábc ",), ("각",), (None,), ("X",), ("1.5",), ("-7",), (".5",), ("1e3",), ("",), ("Infinity",), ("한글 a",), ("1d",), ("1e999",)], "x string")
    found = rows.select(t.lookup_key(F.col("x")).alias("k"), t.number_or_text(F.col("x")).alias("n"), t.finite_number(F.col("x")).alias("f"), t.hash_36(F.col("x")).alias("h")).collect()
    assert [r.k for r in found][:4] == ["ábc", "각", "", "x"]
    assert [(r.n.number, r.n.text) for r in found][3:9] == [(None, "X"), (1.5, None), (-7.0, None), (0.5, None), (None, "1e3"), (None, "")]
    assert [r.f for r in found][3:10] == [None, 1.5, -7.0, 0.5, 1000.0, 0.0, None] and [r.f for r in found][-2:] == [None, None]

    def fnv(s):
        h = 2166136261
        for ch in s:
            h = (h ^ int.from_bytes(ch.encode("utf-16-be")[:2], "big")) * 16777619 & 0xFFFFFFFF
        out = ""
        while h:
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out
            h //= 36
        return out

    assert [r.h for r in found][3:11] == [fnv(x) for x in ("X", "1.5", "-7", ".5", "1e3", "", "Infinity", "한글 a")]
    slugs = spark.createDataFrame([("Ünï co_dé.HWP",), ("한글",), ("--a--b ",), (None,)], "x string").select(t.file_slug(F.col("x"))).collect()
    assert [r[0] for r in slugs] == ["uni-co_de.hwp", "document", "a-b", "document"]


def test_korean_order(spark):
    rows = spark.createDataFrame([(x,) for x in ["나", "a", "B", "가", "1", "é", None]], "x string")
    assert [r.x for r in rows.orderBy(*reports.korean_order(F.col("x"))).collect()] == [None, "1", "가", "나", "a", "B", "é"]


def test_places_of_a_hot_key(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else f"k{k % 5}", k * 7919 % 1009, "x") for k in range(1500)]
    df = spark.createDataFrame(rows, "n long, key string, o long, row string").repartition(6)
    found = reports.placed(df, "key", [F.col("o").desc(), F.col("n")]).collect()
    wanted = {}
    for n, key, _, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        wanted.setdefault(key, []).append(n)
    assert {(x.key, x.place): x.n for x in found} == {(k, i + 1): n for k, ns in wanted.items() for i, n in enumerate(ns)} and found[0].row == "x"
    assert reports.placed(df.limit(0), "key", [F.col("n")]).count() == 0


def test_pivots_of_wanted_nodes_only(spark):
    """Nodes told by name keep their numbers; a child counts for its parent only, what is below for all above, and what follows an element for none of them."""
    xml = '<r><b id="1"><x><w c="in"/></x><s t="own"/><b id="2"><s t="deep"/></b></b><b id="3"><s/><s t="later"/></b><w c="after"/></r>'
    rows = spark.createDataFrame([(7, xml)], "k long, xml string")
    tree = headers.described(nodes.parsed(rows, "k", "xml", held=("attributes",), told=["b", "s", "w"]), "k")
    assert [(r.node, r["name"], r.parent, r.last) for r in tree.orderBy("node").collect()] == [(1, "b", 0, 6), (3, "w", 2, 3), (4, "s", 1, 4), (5, "b", 1, 6), (6, "s", 5, 6), (7, "b", 0, 9), (8, "s", 7, 8), (9, "s", 7, 9), (10, "w", 0, 10)]
    got = headers.pivoted(tree, "k", "b", {"t": ("s", "t"), "some": ("s", None)}, {"c": ("w", "c")}).orderBy("node").collect()
    assert [(r.node, r.attributes["id"], r.t, r.some, r.c) for r in got] == [(1, "1", "own", "", "in"), (5, "2", "deep", "", None), (7, "3", None, "", None)]


def _lines(df, word, plan="optimizedPlan"):
    return [x for x in getattr(df._jdf.queryExecution(), plan)().toString().splitlines() if word in x]


def test_markup_is_made_after_lines_are_grouped(spark):
    for made in (joins._headers, joins._objects):
        found = _lines(made(spark, "/root/testdata/sf0.001", None), "partial_collect_list", "executedPlan")
        assert found and not any("<h" in x for x in found)


def test_one_aggregate_for_each_name_of_a_child(spark):
    tree = headers.described(nodes.parsed(spark.createDataFrame([(1, "<pic><pos horzOffset='3'/><pos horzOffset='5' vertOffset='4'/><pic><sz protect='1'/></pic></pic>")], "k long, xml string"), "k", "xml", held=("attributes",)), "k")
    rows = headers.placements(tree, "k", ["pic"])
    assert [(x.x, x.y, x.protected) for x in rows.orderBy("node").collect()] == [(3, 0, False), (0, 0, True)]
    assert all(x.count("min(") + x.count("min_by(") <= 4 for x in _lines(rows, "Aggregate ["))
