"""Token ids of documents as Parquet list columns.

Every text is encoded with a public tokenizer and ends with one more id.
Words between ASCII white space never share a token with this tokenizer's
pattern, so each worker encodes a word once and joins bytes from then on.

The files hold the documents in ascending doc_id order: `tokens` dictionary-
encoded, the other columns delta-encoded, row groups and pages of set sizes
with page indexes (which Spark's Parquet writer always adds), so a reader can
take metadata only, or the pages of some documents only.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.store import path
from paperloom.llm.textcore import kept, raw, spans

END = 2
#: Words after which a worker forgets those it hasn't met since the last time.
REMEMBERED = 250_000
#: Text bytes taken at once.
GROUP = 1 << 20
_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Text bytes for a file; ids for an Arrow batch.
FILE, BATCH = 32 << 20, 1 << 18
#: How the files are laid out.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts as little-endian bytes; each distinct word is encoded once while it is remembered."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        words = "the cat, it's 12 x . É of".split()
        for gap in " \t\n\r\x0b\x0c":
            if self._plain(gap.join(words)) != b"".join(map(self._plain, words)):
                raise ValueError(f"{file} has tokens that cross white space, so words can't be encoded one by one")
        self.new: dict[bytes, bytes] = {}  # words of late
        self.old: dict[bytes, bytes] = {}  # words from before; what is met again moves to new
        self.one = self._plain("1")
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)  # ids that end a run of letters, digits or signs
        self.last[[k for t, k in tokens.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _store(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        flat = ids.tobytes()
        self.new.update((w, flat[lo:hi]) for w, lo, hi in zip(words, (4 * starts).tolist(), (4 * ends).tolist()))

    def _learn_letters(self, words: list[bytes]) -> bool:
        """Encodes words of letters in one call. Each has an id that ends a run, and one only if there are as many as words."""
        ids = self._ids(b" ".join(words).decode())
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return False
        self._store(words, ids, np.concatenate(([0], ends[:-1])), ends)
        return True

    def _learn(self, words: set[bytes]) -> None:
        """Encodes words in few calls: those of letters, then the rest parted by the digit 1, whose id no word without that digit has."""
        if not words:
            return
        known = list(words)
        letters = [w for w, t in zip(known, b" ".join(known).decode().split(" ")) if t.isalpha()]
        if letters and self._learn_letters(letters):
            known = list(words.difference(letters))
        alone = [w for w in known if b"1" in w or b"<|" in w]
        for w in alone:
            self.new[w] = self._plain(w.decode())
        rest = list(set(known).difference(alone))
        if rest:
            ids = self._ids(b" 1 ".join(rest).decode())
            cut = np.flatnonzero(ids == np.frombuffer(self.one, "<u4")[0])
            if len(self.one) != 4 or len(cut) != len(rest) - 1:  # not with this vocabulary
                self.new |= {w: self._plain(w.decode()) for w in rest}
                return
            self._store(rest, ids, np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ids)])))

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """What neither generation has; words of the old one move."""
        missing = words.difference(self.new)
        unknown = missing.difference(self.old)  # walks the words, not the dictionary
        for w in missing.difference(unknown):
            self.new[w] = self.old[w]
        return unknown

    def _meet(self, missing: set[bytes]) -> None:
        """Learns words that new lacks."""
        ends: dict[bytes, bytes] = {}
        unknown: set[bytes] = set()
        for w in self._recall(missing):
            core = w.rstrip(b".,!?;:")
            if core != w and core and core[-1:].isalnum() and b"<|" not in w:
                ends[w] = core  # letters and digits end where punctuation begins
                unknown |= {core, w[len(core) :]}
            else:
                unknown.add(w)
        self._learn(self._recall(unknown))
        for w, core in ends.items():
            self.new[w] = self.new[core] + self.new[w[len(core) :]]

    def _of(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            self._meet({words[k] for k in missing})
            for k in missing:
                found[k] = self.new[words[k]]
        return found

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Words are told apart and numbered by Arrow, so only distinct ones are looked up."""
        # lower case as the tokenizer makes it, but not where that could spell a special token
        lower = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.binary()).view(pa.string())
        words = pc.ascii_split_whitespace(lower)
        named = words.values.dictionary_encode()
        parts = self._of(named.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, word = np.frombuffer(b"".join(parts), "<u4"), named.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[word])))
        shift = (np.cumsum(sizes) - sizes)[word] - ends[:-1]  # from places in the output to those in ids
        flat = ids[np.arange(ends[-1]) + np.repeat(shift, sizes[word])].tobytes()
        at = (4 * ends[words.offsets.to_numpy()]).tolist()
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return [flat[lo:hi] for lo, hi in zip(at, at[1:])]


def word_ids(file: str) -> WordIds:
    known = kept("token_ids")
    if file not in known:
        known[file] = WordIds(file)
    return known[file]


def _pieces(text: bytes) -> list[bytes]:
    """A long text cut at white space."""
    out, lo = [], 0
    while len(text) - lo > GROUP:
        found = _WHITE.search(text, lo + GROUP)
        if not found:
            break
        out.append(text[lo : found.start()])
        lo = found.start()
    return [*out, text[lo:]]


def encoded(column, file: str) -> Iterator[bytes]:
    """Ids of each text, the end id last, as little-endian unsigned 32-bit integers."""
    ids, end = word_ids(file), np.array([END], "<u4").tobytes()
    data, at = raw(column)
    for lo, hi in spans(at, GROUP):
        texts = [data[a:b].tobytes() for a, b in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist())]
        if len(texts) == 1 and len(texts[0]) > GROUP:
            yield b"".join(x for piece in _pieces(texts[0]) for x in ids.texts([piece])) + end
        else:
            yield from (x + end for x in ids.texts(texts))


def _encode(file: str):
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.schema.names
        rest = [k for k, n in enumerate(names) if n != "text"]

        def rows(lo: int, parts: list[bytes]) -> pa.RecordBatch:
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            return pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, len(parts)) for k in rest), pa.array(sizes), tokens], [*(names[k] for k in rest), "n_tokens", "tokens"])

        lo, parts, size = 0, [], 0
        for ids in encoded(batch.column(names.index("text")), file):
            parts.append(ids)
            size += len(ids) // 4
            if size >= BATCH:
                yield rows(lo, parts)
                lo, parts, size = lo + len(parts), [], 0
        if parts:
            yield rows(lo, parts)

    # no name here holds a batch while the next one is read
    return lambda batches: chain.from_iterable(map(work, batches))


def write_tokens(docs: DataFrame, to: str, text: str = "text", doc_id: str = "doc_id", metadata: tuple[str, ...] = ("lang", "source"), file: str | None = None) -> None:
    """Writes (doc_id, metadata columns that docs has, n_tokens, tokens) to the folder to, in ascending doc_id order over the files by their number.

    Null texts count as empty; null doc_ids come first; rows of one doc_id
    are in order of their texts.
    """
    file = file or vocabulary()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // FILE))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(c) for c in metadata if c in docs.columns], F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", n_tokens long, tokens array<int>"
    rows.mapInArrow(_encode(file), schema).write.options(**LAYOUT).parquet(to)


def _digests(batches):
    for batch in batches:
        lists = batch.column(batch.schema.names.index("tokens"))
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(at.tolist(), at[1:].tolist())]
        keep = [k for k, n in enumerate(batch.schema.names) if n != "tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], [*(batch.schema.names[k] for k in keep), "n_tokens", "ids_crc32"])


def read_digests(spark, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files: start counts the ids of all documents before."""
    files = spark.read.parquet(at)
    rows = files.select("doc_id", "tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.mapInArrow(_digests, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    whole = files.select(F.col("_metadata.file_name").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # part-100000 comes after part-99999
    before = whole.select("file", F.coalesce(F.sum("ids").over(W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    here = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("here", here).join(before, "file").select("doc_id", (F.col("before") + F.col("here")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame) -> DataFrame:
    """Encodes docs, writes the files to the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32) for every row of docs.

    Null and empty texts have the end id only; null doc_ids come first, and
    rows of one doc_id are in order of their texts, so equal rows differ in
    start only. An empty table gives an empty one; other columns than lang and
    source, which are written beside the ids, are ignored.
    """
    to = path(docs.sparkSession, "tokens")
    write_tokens(docs, to)
    return read_digests(docs.sparkSession, to)
