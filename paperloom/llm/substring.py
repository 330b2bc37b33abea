"""Substring dedup over FM-index shards.

A window is `words` consecutive words of one document. A window is a repeat
if its words also start in a document with a smaller doc_id.

A window's anchor is the smallest hash of the runs of `anchor` words in it, so
equal windows have equal anchors. Consecutive windows with one anchor make a
fragment. The work goes by anchors, not by pairs of documents:

1. Documents are dealt into buckets of bounded bytes. Each bucket tells its
   distinct anchors; those of one bucket only need no look elsewhere.
2. Buckets send the distinct fragments whose anchor another document has too
   (each once a bucket, with its smallest and largest doc_id): a 32-bit code for
   each word and 32 bits of each window's own hash.
3. Fragments meet in shards by anchor. A shard builds FM-indexes over its
   distinct fragments and streams them as queries: backward search over
   wavelet matrices gives the places of every window by its codes, those whose
   window hash agrees are its places, and with them the smallest doc_id it
   occurs in. (Codes alone would take words for equal that share 32 bits.)
4. Buckets get back what is repeated and cut it from their texts.

A hot passage costs a row a bucket in each step, however many documents hold it.
A hot line shorter than a window has other words around it in each document, so
its anchor has a fragment a document. Anchors above a number of fragments are
split: their windows go one by one and by their own hash, which only equal
windows share, so a key again has a row a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.fm_index import FMIndex
from paperloom.llm.textcore import _PLACE, Words, _power, grams, mix, raw, signed, spans

#: Text bytes of a bucket, symbols of one FM-index, windows of a fragment.
BUCKET, INDEX, LONGEST = 6 << 20, 400_000, 32
#: Fragments, counted by bucket, above which an anchor is split.
SPLIT = 4096
NONE = np.iinfo(np.int64).max


class Fragments:
    """Fragments of consecutive rows: row, first word, windows, anchor and content hash of each."""

    def __init__(self, w: Words, words: int, anchor: int):
        self.h = h = w.hashes()
        self.first = w.first
        n = len(h) - words + 1
        if n < 1:
            self.row = self.at = self.windows = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        least_, have, want = grams(h, anchor), 1, words - anchor + 1
        while have < want:
            step = min(have, want - have)
            least_ = np.minimum(least_[: len(least_) - step], least_[step:])
            have += step
        row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        valid = row[:n] == row[words - 1 :]
        cut = np.ones(n, bool)
        cut[1:] = (least_[1:] != least_[:-1]) | (row[1:n] != row[: n - 1])
        cut[1:] |= valid[1:] & ~valid[:-1]
        head = np.flatnonzero(cut & valid)
        stop = np.flatnonzero(valid & np.append(cut[1:] | ~valid[1:], True)) + 1
        size = stop - head
        if len(size) and size.max() > LONGEST:
            parts = -(-size // LONGEST)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            head, stop = np.repeat(head, parts) + inner * LONGEST, np.repeat(stop, parts)
            size = np.minimum(stop - head, LONGEST)
        self.at, self.windows, self.row = head, size, row[head]
        self.anchor = least_[head]
        end = head + size + words - 1
        up, down = _power(len(h))
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        self.content = mix((total[end] - total[head]) * down[head] + size.astype(np.uint64))

    def starts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of the fragments chosen, and the fragment of each."""
        size = self.windows[chosen]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(self.at[chosen], size) + inner, np.repeat(chosen, size)

    def hashes(self, start: np.ndarray, words: int) -> np.ndarray:
        """Hashes of the windows that start there."""
        out = np.ones(len(start), np.uint64)
        for k in range(words):
            out += self.h[start + k] * _PLACE[k]
        return mix(out)


def _parts(table: pa.Table, words: int, anchor: int, column: str = "text") -> Iterator[tuple[int, Fragments]]:
    data, at = raw(table[column])
    for lo, hi in spans(at):
        yield lo, Fragments(Words(data, at[lo : hi + 1]), words, anchor)


def _anchors(words: int, anchor: int):
    def run(table: pa.Table) -> pa.Table:
        found = [(f.anchor, f.content) for _, f in _parts(table, words, anchor)]
        every, content = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
        a, n = np.unique(every[np.unique(content, return_index=True)[1]], return_counts=True)
        return pa.table({"anchor": signed(a), "bucket": np.full(len(a), table["bucket"][0].as_py() if len(table) else 0, np.int32), "n": n.astype(np.int32)})

    return run


def _shared(split: int):
    """Of rows sorted by anchor those whose anchor more than one bucket has, and whether it has more than split fragments."""

    def told(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        times = np.diff(np.append(head, len(a)))
        keep, hot = np.repeat(times > 1, times), np.repeat(np.add.reduceat(n.astype(np.int64), head) > split, times)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(hot[keep])], ["anchor", "bucket", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last anchor, one a bucket
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(3)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[end:] for x in rows]
            if end:
                yield told(*(x[:end] for x in rows))
        if held is not None:
            yield told(*held)

    return run


def _fragments(words: int, anchor: int):
    kept = pa.schema([("anchor", pa.int64()), ("bucket", pa.int32()), ("content", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("codes", pa.binary()), ("single", pa.bool_())])

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(table):
            return kept.empty_table()
        ids = table["doc_id"].to_numpy()
        parts = list(_parts(table, words, anchor))
        every, doc = np.concatenate([f.anchor for _, f in parts]), np.concatenate([ids[lo + f.row] for lo, f in parts])
        content = np.concatenate([f.content for _, f in parts])
        wanted = np.isin(every, np.unique(shared["anchor"].to_numpy()).view(np.uint64))
        by = np.lexsort((doc, every))
        twice = np.flatnonzero((every[by][1:] == every[by][:-1]) & (doc[by][1:] != doc[by][:-1]))
        wanted |= np.isin(every, np.unique(every[by][twice]))
        hot = wanted & np.isin(every, np.unique(shared["anchor"].to_numpy()[shared["hot"].to_numpy()]).view(np.uint64))
        singles = _singles(parts, hot, ids, table["bucket"][0].as_py(), words, kept)
        place = np.flatnonzero(wanted & ~hot)
        if not len(place):
            return singles
        by = place[np.lexsort((doc[place], content[place]))]
        head = np.flatnonzero(np.concatenate(([True], content[by][1:] != content[by][:-1])))
        tail = np.append(head[1:], len(by)) - 1
        chosen = np.sort(by[head])
        codes, low = [], 0
        for lo, f in parts:
            mine = chosen[(chosen >= low) & (chosen < low + len(f.at))] - low
            code = (f.h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
            check = np.zeros(len(f.h), "<u4")
            start = f.starts(mine)[0]
            check[start] = f.hashes(start, words) >> np.uint64(32)
            check = check.tobytes()
            codes += [code[4 * s : 4 * (s + n + words - 1)] + check[4 * s : 4 * (s + n)] for s, n in zip(f.at[mine].tolist(), f.windows[mine].tolist())]
            low += len(f.at)
        at = np.argsort(by[head], kind="stable")  # codes are in order of place
        n = len(chosen)
        whole = pa.table([pa.array(signed(every[chosen])), pa.array(np.full(n, table["bucket"][0].as_py(), np.int32)), pa.array(signed(content[chosen])), pa.array(doc[by[head]][at]), pa.array(doc[by[tail]][at]), pa.array(codes, pa.binary()), pa.array(np.zeros(n, bool))], schema=kept)
        return pa.concat_tables([whole, singles])

    return run


def _singles(parts: list, hot: np.ndarray, ids: np.ndarray, bucket: int, words: int, schema: pa.Schema) -> pa.Table:
    """The distinct windows of a bucket's hot fragments, each under its own hash."""
    if not hot.any():
        return schema.empty_table()
    found, low = [], 0
    for k, (lo, f) in enumerate(parts):
        start, of = f.starts(np.flatnonzero(hot[low : low + len(f.at)]))
        found.append((f.hashes(start, words), ids[lo + f.row[of]], np.full(len(start), k), start))
        low += len(f.at)
    content, doc, part, start = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((doc, content))
    head = np.flatnonzero(np.concatenate(([True], content[by][1:] != content[by][:-1])))
    tail, one = np.append(head[1:], len(by)) - 1, by[head]
    check = (content[one] >> np.uint64(32)).astype("<u4")
    codes = [(parts[k][1].h[s : s + words] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + check[i : i + 1].tobytes() for i, (k, s) in enumerate(zip(part[one].tolist(), start[one].tolist()))]
    name = pa.array(signed(content[one]))
    return pa.table([name, pa.array(np.full(len(one), bucket, np.int32)), name, pa.array(doc[one]), pa.array(doc[by[tail]]), pa.array(codes, pa.binary()), pa.array(np.ones(len(one), bool))], schema=schema)


def first_places(codes: list[np.ndarray], checks: list[np.ndarray], first: np.ndarray, words: int) -> list[np.ndarray]:
    """For each fragment the smallest of first over the fragments in which each of its windows occurs, with the same check."""
    size = np.array([len(c) for c in codes])
    windows = size - words + 1
    known, flat = np.unique(np.concatenate(codes), return_inverse=True)
    flat = flat.astype(np.int64) + 1
    text = np.zeros(len(flat) + len(codes), np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text[np.arange(len(flat)) + np.repeat(np.arange(len(codes)), size)] = flat
    out = np.full(int(windows.sum()), NONE, np.int64)
    group = np.cumsum(size) // INDEX  # one index, unless one anchor alone has more symbols than that
    place = np.repeat(begin, windows) + np.arange(len(out)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.repeat(np.arange(len(codes)), windows)
    want = np.concatenate(checks)
    check = np.zeros(len(text), np.uint32)
    check[place] = want
    for g in np.unique(group):
        mine = np.flatnonzero(group == g)
        lo, hi = begin[mine[0]], begin[mine[-1]] + size[mine[-1]] + 1
        index = FMIndex(text[lo:hi], len(known) + 1, words)
        of, own = first[np.repeat(mine, size[mine] + 1)][index.suffix], check[lo:hi][index.suffix]
        for a in range(0, len(out), 1 << 16):
            p = place[a : a + (1 << 16)]
            inside = group[owner[a : a + (1 << 16)]] == g
            for present in (True, False):
                ask = np.flatnonzero(inside == present)
                if len(ask):
                    l, h = index.ranges(text[p[ask][:, None] + np.arange(words)], present)
                    out[a + ask] = np.minimum(out[a + ask], least_of(of, own, l, h, want[a + ask], present))
    return np.split(out, np.cumsum(windows)[:-1])


def least_of(of: np.ndarray, check: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, present: bool) -> np.ndarray:
    """Smallest of those in each range of suffixes whose check is the one wanted, NONE without any. Ranges of several suffixes are equal or apart; the only suffix of a window that is present is its own, perhaps of its last words only."""
    out = np.full(len(lo), NONE, np.int64)
    one = np.flatnonzero(hi - lo == 1)
    at = lo[one]
    out[one] = of[at] if present else np.where(check[at] == want[one], of[at], NONE)
    many = np.flatnonzero(hi - lo > 1)
    if len(many):
        start, which = np.unique(lo[many], return_inverse=True)
        size = np.zeros(len(start), np.int64)
        size[which] = (hi - lo)[many]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.repeat(np.arange(len(start)), size) << 32 | check[at].astype(np.int64)
        by = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
        known, least = key[by][head], np.minimum.reduceat(of[at][by], head)
        ask = which << 32 | want[many].astype(np.int64)
        i = np.searchsorted(known, ask)
        i[i == len(known)] = 0
        out[many] = np.where(known[i] == ask, least[i], NONE)
    return out


def _search(words: int):
    def done(rows: list) -> pa.RecordBatch | None:
        at: dict[int, int] = {}
        codes, checks, first = [], [], []
        for _, content, low, _, data, _ in rows:
            if content in at:
                first[at[content]] = min(first[at[content]], low)
            else:
                at[content] = len(codes)
                numbers = np.frombuffer(data, "<u4")
                windows = (len(numbers) - words + 1) // 2
                codes.append(numbers[: windows + words - 1])
                checks.append(numbers[windows + words - 1 :])
                first.append(low)
        found = first_places(codes, checks, np.array(first, np.int64), words)
        under = [int(x.min()) for x in found]
        told = [(b, c, found[at[c]], single) for b, c, _, last, _, single in rows if under[at[c]] < last]
        if not told:
            return None
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in told], pa.int32()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.list_(pa.int64())), pa.array([x[3] for x in told], pa.bool_())], ["bucket", "content", "first", "single"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, symbols, last = [], 0, None
        for batch in batches:
            for a, b, c, low, high, data, single in zip(*(batch.column(k).to_numpy().tolist() for k in range(5)), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                if a != last and symbols >= INDEX // 2:
                    if out := done(rows):
                        yield out
                    rows, symbols = [], 0
                last = a
                symbols += len(data) // 4 if not rows or rows[-1][1] != c else 0
                rows.append((b, c, low, high, data, single))
        if rows and (out := done(rows)):
            yield out

    return run


def _cut(words: int, anchor: int, as_is: bool):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy() if len(table) else np.zeros(0, np.int64)
        if len(told):
            told = told.take(pa.array(np.argsort(told["content"].to_numpy().view(np.uint64))))
        alone = told.filter(told["single"])
        name, earliest = alone["content"].to_numpy().view(np.uint64), pc.list_flatten(alone["first"]).to_numpy()
        told = told.filter(pc.invert(told["single"]))
        content = told["content"].to_numpy().view(np.uint64)
        lists = told["first"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
        begin, first = lists.offsets.to_numpy(), lists.values.to_numpy()
        data, at = raw(table["text"])
        n_words, n_removed, kept = [], [], []
        for lo, f in _parts(table, words, anchor):
            covered = np.zeros(len(f.h) + 1, np.int32)
            if len(content) and len(f.at):
                i = np.searchsorted(content, f.content)
                i[i == len(content)] = 0
                hit = np.flatnonzero(content[i] == f.content)
                size = f.windows[hit]
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                repeat = first[np.repeat(begin[i[hit]], size) + inner] < np.repeat(ids[lo + f.row[hit]], size)
                start = (np.repeat(f.at[hit], size) + inner)[repeat]
                np.add.at(covered, start, 1)
                np.add.at(covered, start + words, -1)
            if len(name) and len(f.at):
                start, of = f.starts(np.arange(len(f.at)))
                hashes = f.hashes(start, words)
                i = np.searchsorted(name, hashes)
                i[i == len(name)] = 0
                start = start[(name[i] == hashes) & (earliest[i] < ids[lo + f.row[of]])]
                np.add.at(covered, start, 1)
                np.add.at(covered, start + words, -1)
            gone = np.cumsum(covered)[:-1] > 0
            for r in range(len(f.first) - 1):
                a, b = f.first[r], f.first[r + 1]
                own = data[at[lo + r] : at[lo + r + 1]].tobytes()
                cut = int(gone[a:b].sum())
                n_words.append(int(b - a))
                n_removed.append(cut)
                if cut:
                    own = b" ".join(x for x, g in zip(own.split(), gone[a:b].tolist()) if not g)
                elif not as_is:
                    own = b" ".join(own.split())
                kept.append(own)
        out = {"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out | {"rest": table["rest"]})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 13, anchor: int = 6, as_is: bool = False, split: int = SPLIT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, rest) for every row of docs.

    kept is the text without the words that a repeated window covers, its
    words joined by one space; with as_is a text that loses nothing keeps its
    own white space. rest is a struct of all columns of docs.text
    and doc_id aside, under their own names. Windows are judged on the input.
    Null and empty texts have no words; a row with a null doc_id is neither
    before nor after another and keeps all words; rows that share a doc_id
    don't repeat each other.
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, doc_id)]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    parts = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("rest"))
    # the same dealt texts serve all three passes (Spark reuses the exchange)
    dealt = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")))
    dealt = dealt.repartition(parts, "bucket")
    by_bucket = dealt.groupBy("bucket")

    fragments = _meeting(by_bucket, parts, words, anchor, split)
    told = fragments.repartition(parts, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_search(words), "bucket int, content long, first array<long>, single boolean")
    told = told.repartition(parts, "bucket").groupBy("bucket")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), dealt.schema["rest"]])
    return by_bucket.cogroup(told).applyInArrow(_cut(words, anchor, as_is), schema)


def _meeting(by_bucket, parts: int, words: int, anchor: int, split: int) -> DataFrame:
    """Fragments, and single windows of hot anchors, under the keys by which they meet."""
    anchors = by_bucket.applyInArrow(_known(_anchors(words, anchor)), "anchor long, bucket int, n int")
    shared = anchors.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_shared(split), "anchor long, bucket int, hot boolean")
    shared = shared.repartition(parts, "bucket").groupBy("bucket")
    return by_bucket.cogroup(shared).applyInArrow(_known(_fragments(words, anchor)), "anchor long, bucket int, content long, first long, last long, codes binary, single boolean")


def _known(f):
    """f over rows that have a doc_id."""

    def known(table: pa.Table) -> pa.Table:
        return table.filter(pc.is_valid(table["doc_id"])) if len(table) and table["doc_id"].null_count else table

    if f.__code__.co_argcount == 1:
        return lambda table: f(known(table))
    return lambda table, other: f(known(table), other)
