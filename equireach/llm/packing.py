"""Packing documents into sequences: shortest-pack-first over the length histogram.

The documents' tokens are cut into pieces of at most `context` ids. Only the histogram of piece lengths, `context`
numbers at most, reaches the driver. There lengths are placed longest first, each into the pack with the most room
that still takes it, by updating counts of packing patterns, not packs. Patterns are then joined back to pieces by
rank: the r-th piece of a length takes the r-th slot of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equireach.llm.common import Scratch, parts
from equireach.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
#: Chunks that a worker remembers and bytes of text that it encodes at once, fewer than elsewhere: some 60 MB less of a worker, measured alone, for a quarter to a half more time.
CACHED, SLICE = 100_000, 1_000_000
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_histogram(counts: dict[int, int], context: int) -> list[tuple[int, list[int]]]:
    """[(how many sequences, their lengths in order)] for counts of pieces by length.

    Longest lengths first; each goes to the packs with the most room left, as many at once as there are.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fresh: list[tuple[int, int, tuple[int, ...]]] = []
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room < length:
                each = context // length
                if left >= each:
                    fresh.append((context - each * length, left // each, (length,) * each))
                if left % each:
                    fresh.append((context - left % each * length, 1, (length,) * (left % each)))
                left = 0
                break
            n, pack = open_packs[room].pop()
            take = min(n, left)
            if n > take:
                open_packs[room].append((n - take, pack))
            open_packs.setdefault(room - length, []).append((take, (*pack, length)))
            left -= take
        for room, n, pack in fresh:
            open_packs.setdefault(room, []).append((n, pack))
    return [x for room in sorted(open_packs) for x in open_packs[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, pieces of that length in a sequence, first offset) of each run of slots, by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for n, lengths in patterns:
        at = 0
        for length in dict.fromkeys(lengths):  # equal lengths stand together
            m = lengths.count(length)
            rank = taken.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, m, at))
            taken[length] = rank + n * m
            at += m * length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def cut(docs: DataFrame, vocabulary: str, context: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """PIECES of every document: whole contexts first, then the rest. nth counts pieces of a length within a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part, seen = encoder(vocabulary, CACHED), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), [0] * (context + 1)
        for batch in parts(batches, uses=("encoder",)):
            out: list[list[int]] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1), SLICE), strict=True):
                ids += end
                n = len(ids) >> 2
                for start in range(0, n, context):
                    length = min(context, n - start)
                    for column, x in zip(out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seen[length]), strict=True):
                        column.append(x)
                    seen[length] += 1
            columns = [pa.array(x, pa.int64()) for x in out]
            columns.insert(5, pa.array([part] * len(out[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", context: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every document, its end id included, lies in exactly one piece; a sequence's pieces follow each other
    from offset 0 without gaps and hold `context` ids at most. A null or empty text is its end id alone. Repeated
    rows are packed each; a null id stays null; no documents give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    found = scratch.table(cut(docs, vocabulary, context, end_id, id_col, text_col), "pieces")
    by_part = scratch.table(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "by_part")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(pack_histogram(counts, context)))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                first, at, m, start = table.value[int(k)]
                run = np.searchsorted(first, rank[mine], side="right") - 1
                nth = rank[mine] - first[run]
                sequence[mine] = at[run] + nth // m[run]
                offset[mine] = start[run] + nth % m[run] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = found.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
