"""Packing by minimum bin slack.

A document's ids are cut into pieces of the sequence length; what remains is
one shorter piece. Whole pieces are sequences of their own. The others are
dealt into blocks of bounded size. In a block each sequence starts with the
longest piece left, and subset sums over the multiset of the remaining
lengths, kept as the bits of one integer, tell how close to the capacity the
rest can come; the counts of each length are then traced back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import save
from paperloom.llm.token_ids import encoded, vocabulary

LENGTH = 4096
#: Pieces of a block.
BLOCK = 16_384
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def _pieces(file: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), file)):
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n, row, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)):
                        c.append(v)
                    row += 1
            columns = [pa.array(c, pa.int64()) for c in out[:6]]
            names = [*COLUMNS, "row"]
            if with_ids:
                columns.append(pa.array(out[6], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fullest(lengths: np.ndarray, counts: np.ndarray, room: int) -> dict[int, int]:
    """How many of each length (descending, with counts left) come closest to room without passing it."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n, c in zip(lengths.tolist(), counts.tolist()):
        if not c or n > room:
            continue
        c, k = min(c, room // n), 1
        while c > 0:
            k = min(k, c)
            steps.append((reach, n, k))
            reach |= (reach << (n * k)) & mask
            c, k = c - k, 2 * k
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for before, n, k in reversed(steps):
        if not before >> left & 1:
            left -= n * k
            used[n] = used.get(n, 0) + k
    return used


def minimum_slack(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of pieces of the given sizes."""
    by = np.argsort(-sizes, kind="stable")
    lengths, head, counts = np.unique(-sizes[by], return_index=True, return_counts=True)
    lengths, left = -lengths, counts.copy()
    at = {int(n): k for k, n in enumerate(lengths)}
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    given, number, k = np.zeros(len(lengths), np.int64), 0, 0
    while k < len(lengths):
        if not left[k]:
            k += 1
            continue
        taken = {k: 1}
        left[k] -= 1
        room = length - int(lengths[k])
        for n, c in fullest(lengths[k:], left[k:], room).items() if room else ():
            taken[at[n]] = taken.get(at[n], 0) + c
            left[at[n]] -= c
        place = 0
        for i, c in taken.items():
            for j in by[head[i] + given[i] : head[i] + given[i] + c]:
                sequence[j], offset[j] = number, place
                place += int(lengths[i])
            given[i] += c
        number += 1
    return sequence, offset


def pack(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", file: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for each piece of each row of docs.

    Null and empty texts have the end id only. Rows with null or repeated
    doc_ids are packed like all others, equal rows each. Sequence numbers are
    unique, not consecutive. Which block a piece falls in also hangs on its row's
    place in its task, so other file splits give other, equally full sequences.
    An empty table gives an empty one; other columns are ignored.
    """
    file = file or vocabulary()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kept = ", ".join(f"{c} long" for c in (*COLUMNS, "row")) + (", ids array<int>" if with_ids else "")
    pieces = save(rows.mapInArrow(_pieces(file, length, with_ids), kept), "pieces")
    blocks = max(1, -(-pieces.count() // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(blocks))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*COLUMNS, "row")])
        number, offset = minimum_slack(table["length"].to_numpy(), length)
        return table.drop_columns(["block", "row"]).append_column("sequence_id", pa.array(number * blocks + table["block"].to_numpy())).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{c} long" for c in COLUMNS) + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return pieces.withColumn("block", block).groupBy("block").applyInArrow(run, schema)
