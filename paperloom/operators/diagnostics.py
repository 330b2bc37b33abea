"""What pages hold: counters, layout signals, control types, histograms of parsed blocks, texts found in noise, age of audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import flow

#: Counters of a page, and what each kind of block counts for beside controls.
COUNTERS = ["controls", "tables", "pictures", "equations", "charts", "forms", "shapes", "oles", "videos", "text_runs"]
COUNTED_AS = {"table": "tables", "image": "pictures", "shape": "shapes", "textbox": "shapes", "equation": "equations", "ole": "oles"}
#: The height from which a cell is tall.
TALL = 12_000


def page_counters(blocks: DataFrame, cells: DataFrame, key: str, page: str) -> DataFrame:
    """(key, page, the ten counters, ten layout signals, control_types) of flattened blocks and table cells.

    blocks has (key, page, kind, text_runs, inline, header_rows, page_break, explicit, overlap,
    keep, wrap, horz, vert), cells (key, page, col_span, row_span, height,
    content_height). Placement counts where explicit says that a table, picture or shape has a layout of its own;
    other blocks count their runs with text. Charts, forms and videos are never
    parsed and stay 0. Null flags count as false; cells of a page without
    blocks count for a page of their own. Both sides are summed before they meet.
    """
    kind = F.coalesce(F.col("kind"), F.lit("paragraph"))
    is_control = kind.isin(*COUNTED_AS)
    placed = kind.isin("table", "image", "shape", "textbox") & F.coalesce(F.col("explicit"), F.lit(False))
    rel = lambda *names: F.lower(F.coalesce(F.col("horz"), F.lit(""))).isin(*names) | F.lower(F.coalesce(F.col("vert"), F.lit(""))).isin(*names)
    loose = placed & ~F.coalesce(F.col("inline"), F.lit(False))
    says = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    signals = {
        "floating_tables": loose & (kind == "table"),
        "floating_pictures": loose & (kind == "image"),
        "wrapped_controls": placed & says("wrap") & (F.col("wrap") != "top-and-bottom"),
        "overlap_allowed": placed & F.col("overlap"),
        "keep_with_anchor": placed & F.col("keep"),
        "repeat_header_tables": (kind == "table") & (F.col("header_rows") > 0),
        "page_break_tables": (kind == "table") & says("page_break"),
        "page_anchored": placed & rel("page", "paper"),
        "column_anchored": placed & rel("column"),
        "paragraph_anchored": placed & rel("para", "paragraph"),
    }
    counts = [F.count_if(is_control).alias("controls")]
    counts += [F.count_if(kind.isin(*[k for k, n in COUNTED_AS.items() if n == c])).alias(c) if c in COUNTED_AS.values() else F.lit(0).cast("long").alias(c) for c in COUNTERS[1:-1]]
    runs = F.sum(F.when(~kind.isin("table", "image", "shape", "textbox"), F.coalesce("text_runs", F.lit(0))).otherwise(0)).cast("long").alias("text_runs")
    control = F.when(kind == "image", "picture").when(is_control, kind)
    types = blocks.select(F.col(key).alias("key"), F.col(page).alias("page"), control.alias("control")).where("control is not null").groupBy("key", "page", "control").agg(F.count("*").alias("n"))
    types = types.groupBy("key", "page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("control", "n")))).alias("control_types"))
    held = blocks.groupBy(F.col(key).alias("key"), F.col(page).alias("page")).agg(*counts, runs, *[F.count_if(c).alias(n) for n, c in signals.items()])
    tall = F.greatest(F.coalesce("height", F.lit(0)), F.coalesce("content_height", F.lit(0))) >= TALL
    of_cells = cells.groupBy(F.col(key).alias("key"), F.col(page).alias("page")).agg(F.count_if((F.col("col_span") > 1) | (F.col("row_span") > 1)).alias("merged_cells"), F.count_if(tall).alias("tall_cells"))
    both = held.unionByName(of_cells, allowMissingColumns=True).unionByName(types, allowMissingColumns=True)
    numbers = [c for c in dict.fromkeys([*held.columns, *of_cells.columns]) if c not in ("key", "page")]
    summed = both.groupBy("key", "page").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers], F.max_by("control_types", F.col("control_types").isNotNull()).alias("control_types"))
    return summed.select(F.col("key").alias(key), F.col("page").alias(page), *numbers, F.coalesce("control_types", F.create_map().cast("map<string,bigint>")).alias("control_types"))


def document_counters(pages: DataFrame, key: str) -> DataFrame:
    """Sums over a document's pages, with how many there are and control types added key by key."""
    numbers = [f.name for f in pages.schema.fields if f.dataType.simpleString() == "bigint" and f.name not in (key, "page")]
    sums = pages.groupBy(key).agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in numbers])
    types = pages.select(key, F.explode("control_types").alias("control", "n")).groupBy(key, "control").agg(F.sum("n").alias("n"))
    types = types.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("control", "n")))).alias("control_types"))
    return sums.join(types, key, "left").withColumn("control_types", F.coalesce("control_types", F.create_map().cast("map<string,bigint>")))


def histograms(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(key, signal, value, n): how often each signal has each value, all signals in one pass; null is no value."""
    said = F.array(*[F.struct(F.lit(n).alias("signal"), c.cast("string").alias("value")) for n, c in values.items()])
    return rows.select(key, F.inline(said)).where("value is not null").groupBy(key, "signal", "value").agg(F.count("*").alias("n"))


def line_summary(lines: DataFrame, key: str, height: str, text_height: str, y: str, flags: str) -> DataFrame:
    """(key, count, total_height, max_height, min_y, max_y, flags): lines of paragraphs; flags counts them by eight hexadecimal digits."""
    high = F.greatest(F.coalesce(F.col(height), F.lit(0)), F.coalesce(F.col(text_height), F.lit(0)))
    at = F.coalesce(F.col(y), F.lit(0))
    flag = F.concat(F.lit("0x"), F.lpad(F.hex(F.coalesce(F.col(flags), F.lit(0)).cast("long")), 8, "0"))
    by = lines.groupBy(F.col(key).alias("key"), flag.alias("flag")).agg(F.count("*").alias("n"), F.sum(high).alias("total"), F.max(high).alias("high"), F.min(at).alias("low_y"), F.max(at).alias("high_y"))
    return by.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("count"), F.sum("total").alias("total_height"), F.max("high").alias("max_height"), F.min("low_y").alias("min_y"), F.max("high_y").alias("max_y"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("flag", "n")))).alias("flags"))


def line_heights(lines: DataFrame, key: str, heights: list[str], most: int = 14_400) -> DataFrame:
    """(key, line_pixels, layout_pixels) of paragraphs: the mean and the sum of their lines' heights, each the largest of heights, above 0 and up to most units; 11 to 96 and 0 to 480 pixels. Paragraphs without such lines have no row."""
    high = F.greatest(*[F.coalesce(F.col(h).cast("double"), F.lit(0.0)) for h in heights])
    sums = lines.select(F.col(key).alias("key"), high.alias("high")).where((F.col("high") > 0) & (F.col("high") <= most)).groupBy("key").agg(F.sum("high").alias("total"), F.count("*").alias("n"))
    clamp = lambda c, low, top: F.greatest(F.lit(low), F.least(F.lit(top), F.floor(c / 75 + 0.5))).cast("long")
    return sums.select(F.col("key").alias(key), clamp(F.col("total") / F.col("n"), 11, 96).alias("line_pixels"), clamp(F.col("total"), 0, 480).alias("layout_pixels"))


#: What text is made of beside a script's own characters.
PLAIN = r"\x02\t\n\r\x20-\x7E\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}"
HANGUL = r"\x{AC00}-\x{D7A3}"


def best_run(text: Column, script: str = HANGUL, least: int = 50, share: float = 0.2, strict: bool = True) -> Column:
    """The run of text in noise that looks most like a script, null if none does.

    A run is of plain characters and the script's. strict asks for least
    characters and for a share of the script's, and scores by their number;
    else one is enough, and length counts as well: length * (1 + share). Of equal runs the first.
    """
    runs = F.regexp_extract_all(text, F.lit(f"[{PLAIN}{script}]+"), F.lit(0))
    own = lambda r: F.regexp_count(r, F.lit(f"[{script}]"))
    judged = F.transform(runs, lambda r, k: F.struct(r.alias("run"), F.length(r).alias("size"), own(r).alias("own"), (-k).alias("before")))
    fits = (lambda r: (r["size"] >= least) & (r["own"] >= r["size"] * F.lit(share))) if strict else (lambda r: (r["size"] >= least) & (r["own"] > 0))
    score = (lambda r: r["own"].cast("double")) if strict else (lambda r: r["size"] + r["own"].cast("double"))
    scored = F.transform(F.filter(judged, fits), lambda r: F.struct(score(r).alias("score"), r["before"].alias("before"), r["run"].alias("run")))
    return F.array_max(scored)["run"]


def legible(text: Column, script: str = HANGUL) -> Column:
    """text if three characters are of the script and 60 % are no controls, else null."""
    controls = F.regexp_count(text, F.lit(r"[\x00-\x09\x0B\x0C\x0E-\x1F]"))
    size = F.length(text)
    return F.when((F.regexp_count(text, F.lit(f"[{script}]")) >= 3) & (size - controls >= F.lit(0.6) * size), text)


def staleness(audits: DataFrame, generated: str, verified: str, now: str, most_hours: float, error: str) -> DataFrame:
    """audits with available, stale, reasons and age_hours. A row has the times as text of an audit and of the reports it covers, the time now, and what went wrong when the audit was read (null: it is there)."""
    at, of, here = (F.col(c).try_cast("timestamp") for c in (generated, verified, now))
    age = (F.unix_micros(here) - F.unix_micros(at)) / 3.6e9
    there = F.col(error).isNull()
    reasons = F.when(~there, F.array(F.lit("missing"))).when(at.isNull(), F.array(F.lit("missing-generated-at"))).otherwise(F.array_compact(F.array(F.when(at < of, F.lit("older-than-verify-report")), F.when((age > most_hours) & F.lit(most_hours > 0), F.lit("older-than-max-age")))))
    return audits.withColumns({"available": there, "reasons": reasons, "stale": F.size(reasons) > 0, "age_hours": F.when(there, F.round(age, 2))})


#: How bad verdicts are, the worst first; others come after all of them.
VERDICTS = {"capture-error": 0, "mismatch": 1, "capture-review": 1, "review": 2, "close": 3, "match": 4, "ok": 4}


def verdict_rank(verdict: Column, other: int = 8) -> Column:
    return F.coalesce(*[F.when(verdict == v, n) for v, n in VERDICTS.items()], F.lit(other))


def page_budget(height: Column, top: Column, bottom: Column, header: Column, footer: Column, kind: Column, fallback: int = 46) -> Column:
    """How much weight a page takes: its height without margins, and without header and footer where kind is not hwp, in units of 1500, of hwpx in 2250; 16 to 200. fallback where nothing is left."""
    n = lambda c: F.coalesce(c, F.lit(0))
    content = height - n(top) - n(bottom) - F.when(kind == "hwp", 0).otherwise(n(header) + n(footer))
    weights = F.floor(content / F.when(kind == "hwpx", 2250).otherwise(1500) + 0.5)
    return F.when((height > 0) & (content > 0), F.least(F.lit(200), F.greatest(F.lit(16), weights))).otherwise(fallback).cast("long")


def paginate_blocks(blocks: DataFrame, rows: DataFrame, key: str, order: str, weight: str, row: str, row_weight: str, row_span: str, budget: int) -> DataFrame:
    """(key, order, chunk, page): blocks on pages of a budget, tables in chunks.

    blocks has (key, order, weight), rows (key, order, row, row_weight, row_span) the
    rows of those that are tables. A table comes in chunks that break where no
    cell reaches on, of budget - 4 and 16 at least, each with the weight of its rows; a table
    without rows is a block like any other (chunk 0). Pages fill greedily.
    """
    table = F.struct(F.col(key).alias("key"), F.col(order).cast("long").alias("order"))
    placed = rows.select(table.alias("table"), F.col(row).alias("row"), F.col(row_weight).alias("row_weight"), F.col(row_span).alias("row_span"))
    numbered = placed.withColumn("n", F.row_number().over(flow.W.partitionBy("table").orderBy("row", F.greatest(F.lit(1), F.col("row_weight")).cast("long"), F.col("row_span").cast("long"))) - 1)
    chunks = flow.table_chunks(placed, "table", "row", "row_weight", "row_span", max(16, budget - 4)).where("repeated = 0").select("table", "chunk", F.col("row").alias("n"))
    weights = chunks.join(numbered.select("table", "n", "row_weight"), ["table", "n"]).groupBy("table", "chunk").agg(F.sum(F.greatest(F.lit(1), F.col("row_weight"))).cast("long").alias("chunk_weight"))
    every = blocks.select(table.alias("table"), F.greatest(F.lit(1), F.col(weight)).cast("long").alias("weight")).join(weights, "table", "left")
    every = every.select("table.key", "table.order", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"), F.coalesce("chunk_weight", "weight").alias("weight"))

    def step(state, _, __, w):
        page, used = state
        page, used = (page + 1, w) if used and used + w > budget else (page, used + w)
        return (page, used), [(page,)]

    made = flow.streamed(every, "key", [F.col("order"), F.col("chunk"), F.col("weight")], (0, 0), step, {"page": "long"})
    return made.select(F.col("key").alias(key), F.col("order").alias(order), "chunk", "page")


def entries_under(entries: DataFrame, key: str, folder: str, pattern: str) -> DataFrame:
    """Streams (kind 2) of stored files in a folder whose names fit, whatever the case and slashes."""
    inside = F.startswith(F.lower("path"), F.lit(folder.replace("\\", "/").rstrip("/").lower() + "/"))
    return entries.where((F.col("kind") == 2) & inside & F.regexp_like(F.coalesce("name", F.lit("")), F.lit(pattern)))


def entry_by_path(wanted: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, path, id): for each wanted path the entry of that path, of several the last, else the first entry of its name; null if neither."""
    plain = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", ""))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = wanted.select(key, "path", plain(F.col("path")).alias("plain")).withColumn("short", base(F.col("plain")))
    paths = entries.groupBy(key, plain(F.col("path")).alias("plain")).agg(F.max("id").alias("by_path"))
    names = entries.groupBy(key, F.lower("name").alias("short")).agg(F.min("id").alias("by_name"))
    return asked.join(paths, [key, "plain"], "left").join(names, [key, "short"], "left").select(key, "path", F.coalesce("by_path", "by_name").alias("id"))


def binary_map(entries: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """(key, ref, stream, name, extension, image): binary streams by their own number and by that of the reference which has them.

    entries are streams (key, name) numbered BIN0001... or BinaryData1..., refs (key,
    ref_id, data_id, extension). A stream's reference is the one, of several the
    first, whose data_id is its number, else the one of that number. Where a number is both, the
    stream with the larger own number has it. image says that the extension is a picture's.
    """
    number = F.regexp_extract("name", "(?i)^(?:BIN|BinaryData)([0-9]+)", 1).try_cast("long")
    streams = entries.select(key, "name", number.alias("stream")).where("stream is not null").groupBy(key, "stream").agg(F.max("name").alias("name"))
    direct = refs.where("data_id is not null").groupBy(key, F.col("data_id").alias("stream")).agg(F.min(F.struct("ref_id", "extension")).alias("direct"))
    own = refs.groupBy(key, F.col("ref_id").alias("stream")).agg(F.min(F.struct("ref_id", "extension")).alias("own"))
    met = streams.join(direct, [key, "stream"], "left").join(own, [key, "stream"], "left").withColumn("meta", F.when(F.col("stream") > 0, F.coalesce("direct", "own")))
    extension = F.lower(F.coalesce(F.nullif(F.col("meta.extension"), F.lit("")), F.element_at(F.split("name", r"\."), -1)))
    picture = F.regexp_like(F.col("name"), F.lit(r"(?i)\.(png|jpe?g|gif|bmp|webp)$")) | F.regexp_like(extension, F.lit("^(png|jpe?g|gif|bmp|webp)$"))
    rows = met.select(key, "stream", "name", extension.alias("extension"), picture.alias("image"), F.col("meta.ref_id").alias("ref_id"))
    both = rows.where("stream > 0").withColumn("ref", F.col("stream")).unionByName(rows.where("ref_id > 0").withColumn("ref", F.col("ref_id")))
    return both.groupBy(key, "ref").agg(F.max(F.struct("stream", "name", "extension", "image")).alias("b")).select(key, "ref", "b.*")
