"""Lookups, counters, rules and rankings over report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.operators.flow import spare, streamed
from paperloom.sources.tables import saved


def overlaid(*layers: Column) -> Column:
    """The first layer that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in layers])


def histogram_label(rows: DataFrame, key: list[str], value: str, label: str) -> DataFrame:
    """For each key its values with their counts, most frequent first: 'a(3), b(1)'."""
    (n,) = spare(rows, "n")
    counts = rows.groupBy(*key, value).agg(F.count("*").alias(n))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("n"), F.col(value).cast("string").alias("v"))))
    return counts.groupBy(*key).agg(F.concat_ws(", ", F.transform(ordered, lambda x: F.concat(x["v"], F.lit("("), (-x["n"]).cast("string"), F.lit(")")))).alias(label))


def first_examples(rows: DataFrame, key: list[str], order: list[str], value: str, n: int, label: str) -> DataFrame:
    """For each key the first n values, joined by commas. Ranks first, so no more than n of a key are gathered."""
    (place,) = spare(rows, "place")
    ranked = rows.withColumn(place, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(place) <= n)
    return ranked.groupBy(*key).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(place, F.col(value).cast("string").alias("v")))), lambda x: x["v"])).alias(label))


def top_by(rows: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def rule_list(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def first_key_match(rows: DataFrame, row: str, keys: Column, others: DataFrame, other: str, other_keys: Column) -> DataFrame:
    """(row, other): the other that the first known key of each row leads to, else null. Of others with the same key the least counts. Keys are arrays of text; empty and null ones lead nowhere."""
    index = others.select(F.col(other).alias("other"), F.explode(other_keys).alias("key")).where("key <> ''").groupBy("key").agg(F.min("other").alias("other"))
    found = rows.select(F.col(row).alias("row"), F.posexplode(keys).alias("n", "key")).join(index, "key").groupBy("row").agg(F.min_by("other", "n").alias("other"))
    return rows.select(F.col(row).alias("row")).join(found, "row", "left").select(F.col("row").alias(row), F.col("other").alias(other))


def last_by(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Upsert: the last version of each key, with its first place."""
    (v,) = spare(rows, "version")
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias(v), F.min(order).alias("first_seen")).select(key, f"{v}.*", "first_seen")


def follow(edges: DataFrame, source: str, target: str, hops: int = 15) -> DataFrame:
    """Where chains of edges end: (source, final, steps), a row for each source.

    A chain ends where no edge goes on (an edge to itself or to nothing is an
    end), at the first place it meets again, or after so many hops. Of several
    edges from one source the one to the least target counts. Paths double in
    length from round to round, each round a table in the shared folder; a path
    holds twice the hops at most.
    """
    least = edges.groupBy(F.col(source).alias("source")).agg(F.min(target).alias("to"))
    paths = least.select("source", F.when(F.col("to") == F.col("source"), F.array("source")).otherwise(F.array_compact(F.array("source", "to"))).alias("path"))
    length = 1
    while length < hops:
        paths = saved(paths, "paths")
        tails = paths.select(F.col("source").alias("last"), F.col("path").alias("tail"))
        # a path that is no longer than before has come to its end
        on = (F.try_element_at("path", F.lit(-1)) == F.col("last")) & (F.size("path") == length + 1)
        paths = paths.join(tails, on, "left").select("source", F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", F.slice("tail", 2, hops))).alias("path"))
        length *= 2
    again = F.filter(F.sequence(F.lit(0), F.size("path") - 1), lambda k: F.array_position("path", F.get("path", k)) <= k)
    steps = F.least(F.lit(hops), F.coalesce(F.get(again, F.lit(0)), F.size("path") - 1))
    ended = paths.withColumn("steps", F.when(F.size("path") > 0, steps).otherwise(0))
    return ended.select(F.col("source").alias(source), F.get("path", F.col("steps")).alias("final"), "steps")


#: Span of the order column in which rows are numbered together.
BUCKET = 50_000


def numbered_ids(rows: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """rows with unique_id: base, then base-2, base-3 and so on in order of a whole number, without the ids in the one column of taken.

    A null base has no id; rows without an order come last; rows of one order
    get different ids, in no order of their own. Bases that end in a number
    (x-2 beside x) can meet each other's ids: where a root has such bases, its rows stream through one
    task that knows the ids given out. All others are numbered in spans of the
    order, so that a frequent base is no single group.
    """
    root = F.regexp_replace("base", "(-[0-9]+)+$", "")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(base).cast("string").alias("base"), F.col(order).cast("long").alias("order")).withColumn("root", root)
    mixed = packed.where("base <> root").select("root").distinct()
    ids = taken.select(F.col(taken.columns[0]).cast("string").alias("base")).where("base is not null").distinct().withColumn("root", root) if taken is not None else None
    plain, folded = packed.join(mixed, "root", "left_anti"), packed.join(mixed, "root", "left_semi").select("root", F.lit(1).alias("kind"), "order", "base", "row")
    if ids is not None:
        held = ids.join(mixed, "root", "left_semi").select("root", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("order"), "base", F.lit(None).cast(folded.schema["row"].dataType).alias("row"))
        folded = held.unionByName(folded)

    def step(state, kind, _, __, base):
        used, next_of = state or (set(), {})
        if kind == 0:
            used.add(base)
            return (used, next_of), []
        said, n = base, next_of.get(base, 2)
        while said in used:
            said, n = f"{base}-{n}", n + 1
        used.add(said)
        next_of[base] = n
        return (used, next_of), [(said,)]

    made = streamed(folded, "root", [F.col("kind"), F.col("order").isNull(), F.col("order"), F.col("base")], None, step, {"unique_id": "string"}).select("row", "unique_id")
    span = F.coalesce(F.floor(F.col("order") / BUCKET), F.lit(1 << 62))
    plain = plain.withColumn("span", span)
    before = F.sum("count").over(W.partitionBy("base").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
    spans = plain.where("base is not null").groupBy("base", "span").agg(F.count("*").alias("count")).select("base", "span", F.coalesce(before, F.lit(0)).alias("before"))
    n = F.row_number().over(W.partitionBy("base", "span").orderBy("order")) + F.coalesce("before", F.lit(0))
    placed = plain.join(spans, ["base", "span"], "left").withColumn("n", F.when(F.col("base").isNotNull(), n).cast("long")).select("row", "base", "n")
    if ids is not None:
        placed = _skipping(placed, ids)
    said = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    return placed.select("row", F.when(F.col("base").isNotNull(), said).alias("unique_id")).unionByName(made).select("row.*", "unique_id")


def _skipping(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """placed (row, base, n) with n the n-th number that ids (base, root) don't have. Of the i-th of a base's taken numbers t, t - i free ones come before; each row counts those that come before it, in spans."""
    number = F.when(F.col("base") == F.col("root"), 1).otherwise(F.regexp_extract(F.substring(F.col("base"), F.length("root") + 2, F.length("base")), "^([2-9]|[1-9][0-9]{1,17})$", 1).try_cast("long"))
    marks = ids.select(F.col("root").alias("base"), number.cast("long").alias("t")).where("t is not null")
    marks = marks.withColumn("n", F.col("t") - F.row_number().over(W.partitionBy("base").orderBy("t"))).select(F.lit(None).cast(placed.schema["row"].dataType).alias("row"), "base", "n", F.lit(1).alias("mark"))
    both = marks.unionByName(placed.withColumn("mark", F.lit(0))).withColumn("span", F.floor(F.col("n") / BUCKET))
    spans = both.groupBy("base", "span").agg(F.sum("mark").alias("marks"))
    spans = spans.withColumn("before", F.coalesce(F.sum("marks").over(W.partitionBy("base").orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("base", "span", "before")
    inside = F.sum("mark").over(W.partitionBy("base", "span").orderBy("n", "mark").rowsBetween(W.unboundedPreceding, 0))  # a row before the marks of its own number
    counted = both.withColumn("inside", inside)
    found = counted.where("mark = 0").join(spans, (counted["base"].eqNullSafe(spans["base"])) & (counted["span"].eqNullSafe(spans["span"])), "left").drop(spans["base"]).drop(spans["span"])
    return found.select("row", "base", (F.col("n") + F.col("inside") + F.coalesce("before", F.lit(0))).alias("n"))


def reconcile(left: DataFrame, right: DataFrame, key: str, compare: list[str], order: str | None = None) -> DataFrame:
    """(key, state, differing, left, right): what two reports say of each key.

    state is left only, right only, differs or same; differing names the columns
    of compare whose values are not the same (null is a value), in their order. On
    either side the last row of a key by order counts; without an order keys
    are told to be unique. Rows without a key meet nothing and stay each.
    """

    def side(rows, name):
        kept = [c for c in rows.columns if c not in (key, order)]
        packed = rows.select(F.col(key).alias("key"), F.struct(*kept).alias(name), *([F.col(order).alias("order")] if order else []))
        last = packed.where("key is not null").groupBy("key").agg((F.max_by(name, "order") if order else F.first(name)).alias(name))
        return last, packed.where("key is null").select("key", name)

    (a, a_loose), (b, b_loose) = side(left, "left"), side(right, "right")
    both = a.join(b, "key", "full_outer").unionByName(a_loose, allowMissingColumns=True).unionByName(b_loose, allowMissingColumns=True)
    differing = F.array_compact(F.array(*[F.when(~F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")), F.lit(c)) for c in compare]))
    met = F.col("left").isNotNull() & F.col("right").isNotNull()
    state = F.when(F.col("right").isNull(), "left only").when(F.col("left").isNull(), "right only").when(F.size(differing) > 0, "differs").otherwise("same")
    return both.select(F.col("key").alias(key), state.alias("state"), F.when(met, differing).otherwise(F.array().cast("array<string>")).alias("differing"), "left", "right")


#: Verdicts of an audited page that fail, and those that only warn.
STRICT, ADVISORY = ["mismatch", "capture-error", "capture-review"], ["review"]


def audit_findings(verified: DataFrame, audited: DataFrame, key: str = "filename", pages: str = "page_count", verdicts: str = "verdicts", order: str = "at") -> DataFrame:
    """(key, finding, n): what an audit says against the reports it covers; the last audit of a key counts.

    verified has (key, pages), audited (key, pages, verdicts: a map from verdict to
    count, order). Findings are: missing from the audit, pages differ, bad
    verdicts and verdicts to review, these two with their sum, also of
    audits that meet no report. Reports without a key find nothing.
    """
    sums = lambda names: F.aggregate(F.array(*[F.coalesce(F.try_element_at(F.col(verdicts), F.lit(n)), F.lit(0)).cast("long") for n in names]), F.lit(0).cast("long"), lambda s, x: s + x)
    last = audited.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct(F.col(pages).alias("pages"), sums(STRICT).alias("bad"), sums(ADVISORY).alias("review")), order).alias("audit"))
    reports = verified.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(pages).alias("pages"))
    against = reports.join(last, "key", "left").select("key", F.when(F.col("audit").isNull(), "missing").when(F.col("pages") != F.col("audit.pages"), "pages differ").alias("finding"), F.lit(None).cast("long").alias("n")).where("finding is not null")
    found = F.array(F.struct(F.lit("bad verdicts").alias("finding"), F.col("audit.bad").alias("n")), F.struct(F.lit("to review").alias("finding"), F.col("audit.review").alias("n")))
    judged = last.select("key", F.inline(found)).where("n > 0")
    return against.unionByName(judged).select(F.col("key").alias(key), "finding", "n")


#: What is wrong with a document as it was shown, in order: name and condition.
SHOWN = {
    "page walk failed": "not walked",
    "keywords not found": "keywords_missing",
    "console errors": "console_errors > 0",
    "screenshot failed": "not screenshot",
    "no diagnostics": "diagnostic_pages is null",
    "diagnostic pages differ": "diagnostic_pages <> pages",
    "no sections": "diagnostic_pages is not null and coalesce(sections, 0) < 1",
    "control sums differ": "diagnostic_pages is not null and controls <> controls_of_pages",
    "page size differs": "diagnostic_pages is not null and geometry_off > 2",
    "unresolved fonts": "unresolved_fonts > 0",
    "expected pages differ": "expected_pages <> pages",
}
#: What fails a report, in order. A document that did not load has no other failure.
GUARDED = {
    "has issues": "size(issues) > 0",
    "invalid page count": "coalesce(pages, 0) < 1",
    "expected pages differ": "expected_pages <> pages",
    "diagnostic pages differ": "not coalesce(diagnostic_pages = pages, false)",
    "dom pages differ": "pages <> 0 and not coalesce(dom_pages = pages, false)",
    "thumbnails missing": "pages <> 0 and thumbnails > 0 and thumbnails < pages",
    "page size differs": "not coalesce(geometry_off <= 2, false)",
    "no screenshot": "not coalesce(screenshot, false)",
}
#: What is wrong with page counts, in order, with its priority.
COUNTED = {
    "P0 invalid": "coalesce(pages, 0) < 1",
    "P1 diagnostics": "pages <> 0 and diagnostic_pages <> pages",
    "P2 no diagnostics": "pages <> 0 and diagnostic_pages is null",
    "P1 dom": "pages <> 0 and dom_pages <> pages",
    "P1 baseline": "pages <> 0 and expected_pages <> pages",
    "P1 visual": "pages <> 0 and visual_pages <> pages",
    "P2 thumbnails": "pages <> 0 and thumbnails > 0 and thumbnails < pages",
    "P2 walk": "not walked",
}


def holding(rules: dict[str, str]) -> Column:
    """Names of the rules, given as SQL conditions, that hold."""
    return rule_list({n: F.expr(c) for n, c in rules.items()})


def shown_issues(reports: DataFrame, oracle: DataFrame | None = None, key: str = "id") -> DataFrame:
    """reports with issues: what is wrong with each document as it was shown (SHOWN). oracle has (key, expected_pages), the last column joined in; a key that it has not, or null there, expects nothing. A rule on a null column doesn't hold."""
    rows = reports if oracle is None else reports.join(oracle.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("expected_pages").alias("expected_pages")), key, "left")
    return rows.withColumn("issues", holding(SHOWN))


def guard_failures(shown: DataFrame) -> DataFrame:
    """Reports that have issues, with failures: what keeps each from passing (GUARDED), or only that it did not load. What is unknown fails where a report must have it: diagnostics, the page's size, pages of the DOM, a screenshot."""
    return shown.withColumn("failures", F.when(F.coalesce("fatal", F.lit(False)), F.array(F.lit("not loaded"))).otherwise(holding(GUARDED)))


def page_states(reports: DataFrame) -> DataFrame:
    """reports with count_issues (COUNTED) and state: fail for a P0 or P1, warn for any other, else ok."""
    rows = reports.withColumn("count_issues", holding(COUNTED))
    severe = F.exists("count_issues", lambda x: F.substring(x, 1, 2).isin("P0", "P1"))
    return rows.withColumn("state", F.when(severe, "fail").when(F.size("count_issues") > 0, "warn").otherwise("ok"))


def placed(rows: DataFrame, key: str, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place from 1 among those of their key in an order that leaves no ties.

    Rows are sorted once over all tasks and saved; a place is the number of rows of
    the key in tasks before plus those before it in its own, so no key is
    a single task. What meets is a count for each key and task.
    """
    packed = rows.orderBy(F.col(key), *order).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("id"))
    packed = saved(packed, "placed").withColumn("task", F.shiftright("id", 33))
    tasks = packed.groupBy("key", "task").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select(F.col("key").alias("of"), F.col("task").alias("in"), "first", before.alias("before"))
    met = packed.join(tasks, packed["key"].eqNullSafe(tasks["of"]) & (packed["task"] == tasks["in"]))
    return met.select("row.*", (F.col("before") + F.col("id") - F.col("first") + 1).alias(name))


def korean_order(*columns: Column) -> list[Column]:
    """An order of texts as Korean dictionaries have it, Hangul before Latin letters; null counts as empty."""
    return [F.collate(F.coalesce(c, F.lit("")), "ko") for c in columns]
