"""N-gram Jaccard join by T-occurrence search.

Documents are sets of distinct n-word shingles; two link when
100 * |A & B| >= percent * |A | B|. The join is exact but for 64-bit hashes of
words, shingles and sets:

1. One pass over the texts gives each document its set's class (a 64-bit
   digest with the set's size; equal sets are one class from here on) and a
   count sketch of shingle frequency. The sketch has a fixed size and only
   fixes an order (rare shingles first): any order gives the same links.
2. Each class posts its prefix, so long that linking classes share at least
   `floor_shared` shingles of it. Postings are sorted by shingle and size and
   scanned as a stream; what is left are runs of several classes that may link.
   Classes that share too few with all others together are out.
3. Each run has a hub, its class with the most frequent shingles on average
   (of a text and its copies with changes, mostly the text). Classes go to the
   hubs of their runs, so all that may link meet, and a run costs a row a
   class, whatever its length. Runs of one group of copies mostly have one hub.
4. At a hub classes are compared with the hub's own set, which settles most of
   a large group in linear work. What stays apart is searched in inverted
   lists over the whole sets: DivideSkip merges the short lists by a heap,
   skipping what can't reach T, and probes long ones by binary search.
5. Hubs of many classes or members are split into lanes; classes that a lane
   leaves outside the hub's part then search the other lanes too.
6. Connected components over the verified links.

Nothing is capped. A class goes to as many places as its prefix has different
hubs; only a hub with many classes that no link joins to it costs more than
its classes: those outside times the lanes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.graph import components
from paperloom.llm.store import save
from paperloom.llm.textcore import distinct, mix, shingle_sets, signed

#: Cells of the frequency sketch, and the parts in which it is added up.
CELLS, PARTS = 1 << 20, 16
#: 64-bit words of the filter of candidate classes, at most (a false hit costs work, not results), and bits a class.
FILTER_WORDS, FILTER_BITS = 1 << 21, 16
#: Classes and members (in all) of a lane, long lists probed between two looks at what is left.
FAN, MEMBERS, PROBED = 512, 1 << 21, 128


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of a and b members that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """Of any k >= percent % of n members the first max(1, 4 %) of n are in a prefix of this size, whatever the order."""
    return n - -(-percent * n // 100) + max(1, n // 25)


def floor_shared(n: str, percent: int) -> str:
    """SQL for the prefix members that a set of n shares with every set it links with: what the smallest such set has to show."""
    return f"greatest(1, (({percent} * {n} + 99) div 100) div 25)"


def digest(s: np.ndarray) -> int:
    return int(mix(np.array([s.sum() if len(s) else 0, np.bitwise_xor.reduce(s) if len(s) else 0, len(s)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64))


def _survey(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)

        def rows(ids, classes, sizes, parts, data):
            return pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["doc_id", "class", "n", "part", "cells"])

        for batch in batches:
            classes, sizes = [], []
            for s in shingle_sets(batch.column(1), n):
                np.add.at(cells, s >> np.uint64(44), np.uint32(1))
                classes.append(digest(s))
                sizes.append(len(s))
            k = len(classes)
            yield rows(batch.column(0), classes, sizes, [None] * k, [None] * k)
        if cells.any():
            local = np.minimum(cells, 65535).astype("<u2").reshape(PARTS, -1)
            yield rows(pa.nulls(PARTS, pa.int64()), [0] * PARTS, [0] * PARTS, range(PARTS), [x.tobytes() for x in local])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(data.as_buffer(), "<u2").astype(np.uint64)
            total[part] = total[part] + x if part in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<u8").tobytes() for x in total.values()], pa.binary())], ["part", "cells"])


def _post(n: int, percent: int, order):
    """(token, class, n, core) for the prefix of each class; core tells how frequent its shingles are on average."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, rows = [], []
            for s in shingle_sets(batch.column(0), n):
                if len(s) and (c := digest(s)) not in seen:
                    seen.add(c)
                    often = order.value[(s >> np.uint64(44)).astype(np.int64)]
                    tokens.append(s[np.argsort(often, kind="stable")[: prefix_size(len(s), percent)]])
                    rows.append((c, len(s), int(1000 * np.log2(often + 1.0).mean()), len(tokens[-1])))
            if tokens:
                classes, sizes, cores, counts = (np.array(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), *(pa.array(np.repeat(x.astype(t), counts)) for x, t in ((classes, np.int64), (sizes, np.int32), (cores, np.int32)))], ["token", "class", "n", "core"])

    return run


def _runs(percent: int):
    """(run, class, n, core) of postings sorted by token, size and class, for runs of several classes. A gap in size that nothing can link across ends a run."""

    def run(batches):
        last, name, told = None, np.uint64(0), True  # the last row, its run, and whether it was given out
        for batch in batches:
            t, c, s, core = (batch.column(k).to_numpy() for k in range(4))
            if not len(t):
                continue
            if last is not None:
                t, c, s, core = (np.concatenate(([x], y)) for x, y in zip(last, (t, c, s, core)))
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
            t, c, s, core = t[fresh], c[fresh], s[fresh], core[fresh]
            same = np.zeros(len(t), bool)
            same[1:] = (t[1:] == t[:-1]) & (s[1:].astype(np.int64) * percent <= s[:-1].astype(np.int64) * 100)
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(t))))
            runs = mix(t[head].view(np.uint64) + mix(s[head].astype(np.uint64)))
            if last is not None:
                runs[head == 0] = name
            give = same.copy()
            give[:-1] |= same[1:]
            open_ = give[-1]
            if last is not None and told:
                give[0] = False
                open_ = open_ or len(t) == 1
            last, name, told = (t[-1], c[-1], s[-1], core[-1]), runs[-1], bool(open_)
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs[give])), pa.array(c[give]), pa.array(s[give].astype(np.int32)), pa.array(core[give].astype(np.int32))], ["run", "class", "n", "core"])

    return run


def _filter_bits(x: np.ndarray, words: int) -> np.ndarray:
    """Three places of each class in a filter of so many words, a power of two."""
    return np.stack([mix(x + np.uint64(k)) & np.uint64(64 * words - 1) for k in (1, 2, 3)])


def _marks(size: int):
    """Distinct filter words of a partition's classes."""

    def run(batches):
        words = np.zeros(size, np.uint64)
        for batch in batches:
            for bits in _filter_bits(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(words, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at].view(np.int64))], ["word", "bits"])

    return run


def _sets(n: int, marks):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            classes, sets = [], []
            for s in shingle_sets(batch.column(0), n):
                if not len(s) or (c := digest(s)) in seen:
                    continue
                bits = _filter_bits(np.array([c], np.int64).view(np.uint64), len(marks.value))[:, 0]
                if all(marks.value[int(b) >> 6] >> np.uint64(int(b) & 63) & np.uint64(1) for b in bits):
                    seen.add(c)
                    classes.append(c)
                    sets.append(s.tobytes())
                if sum(map(len, sets)) > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "members"])
                    classes, sets = [], []
            if classes:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "members"])

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0


def heap_merge(flat: list[int], ranges: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(value, times) of what occurs in at least `least` of the sorted lists flat[lo:hi]: a heap of their heads, where heads that can't reach it are skipped."""
    heap = [(flat[lo], lo, hi) for lo, hi in ranges if lo < hi]
    heapify(heap)
    out = []
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heappop(heap))
        if len(popped) >= least:
            out.append((value, len(popped)))
            for _, at, hi in popped:
                if at + 1 < hi:
                    heappush(heap, (flat[at + 1], at + 1, hi))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, at, hi in popped:
            at = bisect_left(flat, goal, at, hi)
            if at < hi:
                heappush(heap, (flat[at], at, hi))
    return out


class Lists:
    """Inverted lists over the whole sets of a shard's classes, ordered by class size."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.size = np.array([len(sets[i]) for i in self.order], np.int64)
        member = np.concatenate([sets[i] for i in self.order]) if sets else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        by = np.argsort(member, kind="stable")
        member, self.place = member[by], place[by]
        head = np.flatnonzero(np.concatenate(([True], member[1:] != member[:-1]))) if len(member) else np.zeros(0, np.int64)
        self.token, self.start = member[head], np.concatenate((head, [len(member)]))
        self.flat: list[int] | None = None

    def probe(self, found: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """In how many of the lists each place occurs, by binary search in all of them at once."""
        stop = np.broadcast_to(self.start[lists + 1], (len(found), len(lists)))
        lo, hi = np.broadcast_to(self.start[lists], stop.shape).copy(), stop.copy()
        want = found[:, None]
        for _ in range(int((hi - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.place[np.minimum(mid, len(self.place) - 1)] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        return ((lo < stop) & (self.place[np.minimum(lo, len(self.place) - 1)] == want)).sum(1)

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Places of the classes that link with query, by DivideSkip."""
        q = len(query)
        lo = int(np.searchsorted(self.size, -(-percent * q // 100)))
        hi = int(np.searchsorted(self.size, 100 * q // percent, "right"))
        if not q or lo >= hi or not len(self.token):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.token, query)
        at[at == len(self.token)] = 0
        at = at[self.token[at] == query]
        length = self.start[at + 1] - self.start[at]
        least = -(-percent * q // 100)  # T: no smaller overlap links, whatever the other's size
        if len(at) < least:
            return np.zeros(0, np.int64)
        by = np.argsort(-length, kind="stable")
        longest = int(length[by[0]])
        n_long = min(least - 1, int(least / (0.01 * np.log2(max(2, longest)) + 1)))
        long, short = at[by[:n_long]], at[by[n_long:]]
        if self.flat is None:
            self.flat = self.place.tolist()
        merged = heap_merge(self.flat, list(zip(self.start[short].tolist(), self.start[short + 1].tolist())), least - len(long))
        found, have = (np.array(x, np.int64) for x in zip(*merged)) if merged else (np.zeros(0, np.int64),) * 2
        fits = (found >= lo) & (found < hi)
        found, have = found[fits], have[fits]
        for k in range(0, len(long), PROBED):
            keep = have + len(long) - k >= least
            found, have = found[keep], have[keep]
            if not len(found):
                break
            have = have + self.probe(found, long[k : k + PROBED])
        return found[100 * have >= percent * (q + self.size[found] - have)]


#: Roles at a hub: its own set, a class held there, a class that only asks.
HUB, HELD, ASKS = 0, 1, 2


def settle(role: np.ndarray, classes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the classes of one lane, enough to join all that link; roots name parts joined already."""
    links, roots = [], roots.copy()

    def link(i: int, j: int) -> None:
        links.append((int(classes[i]), int(classes[j])))
        roots[roots == roots[i]] = roots[j]

    asks = np.flatnonzero(role == ASKS)
    for h in np.flatnonzero(role == HUB):
        for i in np.flatnonzero(role == HELD):
            k = overlap(sets[i], sets[h])
            if roots[i] != roots[h] and 100 * k >= percent * (len(sets[i]) + len(sets[h]) - k):
                link(i, h)
        asks = np.flatnonzero(roots != roots[h])
    held = np.flatnonzero(role != ASKS)
    if len(asks):
        lists = Lists([sets[i] for i in held])
        for i in asks:
            for j in held[lists.order[lists.search(sets[i], percent)]]:
                if roots[i] != roots[j]:
                    link(i, j)
    return links


def _meet(percent: int):
    """Links within each lane of a stream sorted by hub, lane and turn."""

    def run(batches):
        now, rows = None, []

        def done():
            if len(rows) < 2:
                return []
            role, classes, roots, sets = zip(*rows)
            return settle(np.array(role), np.array(classes, np.int64), np.array(roots, np.int64), list(sets), percent)

        for batch in batches:
            found = []
            for *key, role, c, root, data in zip(*(batch.column(k).to_numpy().tolist() for k in range(6)), batch.column(6)):
                if key != now:
                    found += done()
                    now, rows = key, []
                rows.append((role, c, root, np.frombuffer(data.as_buffer(), np.uint64)))
            if found:
                yield _links(found)
        if found := done():
            yield _links(found)

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, class, n, root) for every row of docs (doc_id, text): root names the row's group."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text")

    survey = save(docs.mapInArrow(_survey(words), "doc_id long, class long, n long, part int, cells binary"), "survey")
    member = survey.where("part is null").select("doc_id", "class", "n")
    cells = np.zeros((PARTS, CELLS // PARTS), np.uint64)
    for row in survey.where("part is not null").select("part", "cells").repartition(PARTS, "part").mapInArrow(_added, "part int, cells binary").collect():
        cells[row[0]] += np.frombuffer(row[1], "<u8")
    order = spark.sparkContext.broadcast(np.minimum(cells.ravel(), 2**32 - 1).astype(np.uint32))

    posted = texts.mapInArrow(_post(words, percent, order), "token long, class long, n int, core int")
    runs = posted.repartition(parts, "token").sortWithinPartitions("token", "n", "class")
    runs = save(runs.mapInArrow(_runs(percent), "run long, class long, n int, core int"), "runs")
    enough = runs.groupBy("class", "n").count().where(f"count >= {floor_shared('n', percent)}").select("class", "n")
    runs = runs.join(enough, ["class", "n"], "left_semi")
    hubs = runs.groupBy("run").agg(F.max(F.struct("core", "class")).alias("top"), F.min("class").alias("low"), F.max("class").alias("high"))
    hubs = hubs.where("low <> high").select("run", F.col("top.class").alias("hub"))
    met = save(runs.join(hubs, "run").groupBy("hub", "class").agg(F.max("n").alias("n")), "met")
    sets = _wanted(texts, met.select("class").distinct(), words)
    order.destroy()

    lanes = met.groupBy("hub").agg(F.expr(f"cast(ceil(greatest(count(*) / {FAN}, sum(n) / {MEMBERS})) as int)").alias("lanes"))
    lanes = save(lanes, "lanes")
    at = F.expr("cast(pmod(class, lanes) as int)").alias("lane")
    turn = F.lit(0).alias("turn")
    held = met.where("class <> hub").join(lanes, "hub").select("hub", at, turn, F.lit(HELD).alias("role"), "class", F.col("class").alias("root"))
    own = lanes.select("hub", F.explode(F.expr("sequence(0, lanes - 1)")).alias("lane"), turn, F.lit(HUB).alias("role"), F.col("hub").alias("class"), F.col("hub").alias("root"))

    def meet(rows: DataFrame) -> DataFrame:
        rows = rows.join(sets, "class").select("hub", "lane", "turn", "role", "class", "root", "members")
        rows = rows.repartition(parts, "hub", "lane", "turn").sortWithinPartitions("hub", "lane", "turn", "role")
        return save(rows.mapInArrow(_meet(percent), "a long, b long"), "links")

    links = meet(held.unionByName(own))
    split = lanes.where("lanes > 1")
    if not split.isEmpty():
        known = components(links, "a", "b").withColumnRenamed("node", "class")
        rows = met.join(split, "hub").join(known, "class", "left").select("hub", "class", "lanes", at, F.coalesce("component", "class").alias("root"))
        rows = save(rows, "split")
        apart = rows.join(rows.where("class = hub").select("hub", F.col("root").alias("hub_root")), "hub").where("root <> hub_root").drop("hub_root")
        turns = apart.groupBy("hub").agg(F.ceil(F.count("*") / FAN).cast("int").alias("turns"))
        held = rows.join(turns, "hub").select("hub", "lane", F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"), F.lit(HELD).alias("role"), "class", "root")
        asks = apart.join(turns, "hub").withColumn("to", F.explode(F.expr("sequence(0, lanes - 1)"))).where("to <> lane")
        asks = asks.select("hub", F.col("to").alias("lane"), F.expr("cast(pmod(xxhash64(class), turns) as int)").alias("turn"), F.lit(ASKS).alias("role"), "class", "root")
        links = links.unionByName(meet(held.unionByName(asks)))

    linked = components(links, "a", "b")
    labelled = member.join(linked.withColumnRenamed("node", "class"), "class", "left")
    return save(labelled.select("doc_id", "class", "n", F.coalesce("component", "class").alias("root")), "labelled")


def _wanted(texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(class, members) of the classes asked and of a few others: a filter spares most of those their way through a shuffle."""
    spark = texts.sparkSession
    size = min(FILTER_WORDS, 1 << max(10, (asked.count() * FILTER_BITS // 64).bit_length()))
    marks = np.zeros(size, np.uint64)
    for word, bits in asked.mapInArrow(_marks(size), "word int, bits long").groupBy("word").agg(F.bit_or("bits")).toLocalIterator():
        marks[word] = np.int64(bits).view(np.uint64)
    marked = spark.sparkContext.broadcast(marks)
    sets = texts.mapInArrow(_sets(words, marked), "class long, members binary")
    sets = save(sets.groupBy("class").agg(F.first("members").alias("members")), "sets")
    marked.destroy()
    return sets


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Lower-cases A-Z. n_shingles is the set's size; component_id is the
    smallest doc_id reachable by links, the row's own included. Null or empty
    texts have the empty set and link with nothing; a null doc_id gets the
    smallest id of what it links with. Rows that share a doc_id each count.
    Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    labelled = _labelled(docs, words, percent)
    smallest = labelled.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("first"))
    out = labelled.join(smallest, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def _classed(words: int, text: int):
    """Rows with the digest of their set, null for the empty one."""

    def run(batches):
        for batch in batches:
            classes = [digest(s) if len(s) else None for s in shingle_sets(batch.column(text), words)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, batch.schema.names), pa.array(classes, pa.int64())], ["row", "class"])

    return run


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay when of each group of near copies one row stays.

    That is the one with the smallest doc_id (of several such rows, one whose
    set has the smallest digest); rows without a doc_id come after all others.
    A row goes only with a row of its own group: rows that share a doc_id but
    not a group are judged each, of equal rows one stays. Rows without
    shingles (null or empty texts) all stay.
    """
    labelled = _labelled(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), words, percent).where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "class")
    keeper = labelled.groupBy("root").agg(F.min(place).alias("keeper"))
    # by id and set: whether its rows go, and whether the one that stays is among several
    judged = labelled.groupBy("root", "doc_id", "class").count().join(keeper, "root")
    stays = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.class") == F.col("class"))
    judged = judged.select("doc_id", F.col("class").alias("set"), stays.alias("stays"), "count").where("not stays or count > 1")
    judged = save(judged.withColumn("judged", F.lit(True)), "judged")
    row = T.StructType([T.StructField("row", docs.schema), T.StructField("class", T.LongType())])
    placed = docs.mapInArrow(_classed(words, docs.columns.index(text)), row)
    placed = placed.withColumn("id", F.col("row").getField(doc_id).cast("long")).join(judged, F.col("id").eqNullSafe(judged["doc_id"]) & (F.col("class") == judged["set"]), "left")
    plain = placed.where("judged is null").select("row.*")
    if judged.where("stays").isEmpty():
        return plain
    several = placed.where("stays").groupBy("id", "class").agg(F.first("row").alias("row"))
    return plain.unionByName(several.select("row.*"))
