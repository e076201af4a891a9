"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window of a document is compared with an item of the same number of words. Only windows that hold a shingle of an
item can be like it, so only those are fingerprinted. Fingerprints have BLOCKS blocks of 8 bits. Of two fingerprints
within RADIUS at most RADIUS // (NEAR + 1) blocks differ in more than NEAR bits, so at least LEAST blocks differ in
NEAR bits or fewer: tables of near block values, one a block, count these, and every item within the radius is among
those that reach LEAST. Of random fingerprints one in thirty does. Their whole distance is taken next, and candidates
within the radius are compared exactly: weighted Jaccard of 5-word shingles, a shingle's weight being how often it
stands there.

The benchmark is a query set: it is sent to the executors in blocks of at most ITEM_BYTES, each met by all documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import Scratch, kept, mix64, parts, without
from equireach.llm.shingles import WIDTH, ordered, shingle_hashes

BLOCKS = 32
BITS = 8 * BLOCKS
#: Bits in which fingerprints of like windows may differ: at a similarity of 0.75 some 44 of 256 do, deviation 6.
RADIUS = 71
#: Bits in which near blocks differ at most, and how many blocks are near if fingerprints are within the radius.
NEAR = 2
LEAST = BLOCKS - RADIUS // (NEAR + 1)
ITEM_BYTES = 16_000_000
#: Pairs of windows and items whose near blocks are counted at once.
CELLS = 1 << 22
FOUND = "doc_id long, item_id long, similarity double, start long, n_words long"
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_IS_NEAR = (_POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)] <= NEAR).astype(np.uint8)
_LANES = mix64(np.arange(31, 31 + BITS // 64, dtype=np.uint64))


def fingerprints(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHashes, BLOCKS bytes each, from how many shingles of each window have each bit set."""
    return np.packbits(2 * votes > counts[:, None], axis=1)


def _bit_rows(h: np.ndarray) -> np.ndarray:
    """BITS bits of each shingle, from its hash."""
    return np.unpackbits(mix64(h[:, None] ^ _LANES).view(np.uint8).reshape(len(h), BLOCKS), axis=1)


class Index:
    """A block of the benchmark, ready for lookups."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float):
        self.ids, self.threshold = ids, threshold
        found = list(ordered(pa.array(texts, pa.string())))
        self.words = np.array([len(w) for w, _ in found], np.int64)
        self.weights = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for _, h in found]
        self.of: dict[int, list[int]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (n, weights) in enumerate(zip(self.words.tolist(), self.weights, strict=True)):
            for h in weights:
                if n >= WIDTH:
                    self.of[h].append(i)
                elif n:
                    self.short[n][h].append(i)
        self.known = np.array(sorted(self.of), np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.prints = fingerprints(np.array([_bit_rows(h).sum(0, dtype=np.int64) for _, h in found]).reshape(-1, BITS), np.array([len(h) for _, h in found]))
        self.sized = {int(n): np.flatnonzero(self.words == n) for n in np.unique(self.words) if n >= WIDTH}
        #: For items of a size, whether each is near each value of each block: (BLOCKS, 256, items).
        self.tables = {n: np.stack([_IS_NEAR[:, self.prints[at, b]] for b in range(BLOCKS)]) for n, at in self.sized.items()}

    def lookup(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs among items of a size that have at least LEAST near blocks."""
        windows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = self.sized[size]
        step = max(1, CELLS // len(at))
        for low in range(0, len(prints), step):
            near = np.zeros((len(prints[low : low + step]), len(at)), np.uint8)
            for b, table in enumerate(self.tables[size]):
                near += table[prints[low : low + step, b]]
            window, item = np.nonzero(near >= LEAST)
            windows.append(window + low)
            items.append(at[item])
        return np.concatenate(windows), np.concatenate(items)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS among items of a size."""
        window, item = self.lookup(prints, size)
        close = _POPCOUNT[prints[window] ^ self.prints[item]].sum(1) <= RADIUS
        return window[close], item[close]

    def similarity(self, h: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's."""
        theirs, values = self.weights[item], h.tolist()
        mine: dict[int, int] = {}
        for x in values:
            mine[x] = mine.get(x, 0) + 1
        both = sum(min(n, theirs.get(x, 0)) for x, n in mine.items())
        return both / (len(values) + sum(theirs.values()) - both)

    def search(self, words: np.ndarray, h: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window for each item that has one like it."""
        best: dict[int, tuple[float, int]] = {}
        for n, table in self.short.items():
            hashes = shingle_hashes(words, n, n)
            for i in np.flatnonzero(np.isin(hashes, np.array(list(table), np.uint64))).tolist():
                for item in table[int(hashes[i])]:
                    best.setdefault(item, (1.0, i))
        if len(words) >= WIDTH and len(self.known):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            at = at[self.known[np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)] == h[at]]
            if len(at):
                self._windows(len(words), h, at, best)
        return [(item, s, start) for item, (s, start) in best.items()]

    def _windows(self, n_words: int, h: np.ndarray, anchors: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        by_size: dict[int, list[int]] = defaultdict(list)
        for a in anchors.tolist():
            for size in {int(self.words[i]) for i in self.of[int(h[a])]}:
                by_size[size].append(a)
        for size, own in by_size.items():
            span = min(size, n_words)
            if span < self.threshold * (size - WIDTH + 1):  # too short a document for the item
                continue
            last = n_words - span
            # every window start from which an anchor is inside
            marks = np.zeros(last + 2, np.int32)
            a = np.array(own)
            np.add.at(marks, np.clip(a - (span - WIDTH), 0, last + 1), 1)
            np.add.at(marks, np.clip(a + 1, 0, last + 1), -1)
            starts = np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)
            count = span - WIDTH + 1
            for part in np.array_split(starts, len(starts) // 2000 + 1):
                if not len(part):
                    continue
                inside = np.unique((part[:, None] + np.arange(count + 1)).reshape(-1)) if len(part) * count < 8 * len(h) else np.arange(len(h) + 1)
                inside = inside[inside <= len(h)]
                place = np.searchsorted(inside, np.arange(len(h) + 1)) if len(inside) < len(h) + 1 else None
                rows = _bit_rows(h[np.minimum(inside, len(h) - 1)])
                total = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(rows, 0, dtype=np.int32)])
                low = place[part] if place is not None else part
                prints = fingerprints(total[low + count] - total[low], np.full(len(part), count))
                for w, item in zip(*(x.tolist() for x in self.candidates(prints, size)), strict=True):
                    start = int(part[w])
                    s = self.similarity(h[start : start + count], item)
                    if s >= self.threshold and s > best.get(item, (0.0, 0))[0]:
                        best[item] = (s, start)


def _index(key: str, sent, threshold: float) -> Index:
    """The index of a block of the benchmark; a worker makes it once and holds the last one."""
    return kept("index", key, lambda: Index(*sent.value, threshold))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[tuple[list[int], list[str]]]]:
    """How many blocks of at most ITEM_BYTES, about, the items make, and their ids and texts block by block."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // ITEM_BYTES + 1

    def block(b: int) -> tuple[list[int], list[str]]:
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").toPandas()
        return got["item_id"].tolist(), got["text"].tolist()

    return n, map(block, range(n))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words) for each document and item with a like window; the best window each,
    of equal ones the first.

    Null, empty and blank texts on either side match nothing; an item of fewer than five words matches as a whole
    sequence. Rows that repeat are each reported, with a null id too; of an item's several texts the best window of each
    is reported. Other columns are not read. With no items or documents, no rows. A benchmark of several blocks has the
    documents read once for each, one after another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, blocks = _blocks(benchmark, item_col, item_text_col)
    scratch, found = Scratch(spark, "benchmark") if n > 1 else None, []
    for b, (ids, texts) in enumerate(blocks):
        sent, key = spark.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent, threshold)
            for batch in parts(batches, uses=("index",)):
                out: list[list] = [[], [], [], [], []]
                for doc_id, (words, h) in zip(batch.column(0).to_pylist(), ordered(batch.column(1).fill_null("")), strict=True):
                    for item, s, start in index.search(words, h) if len(words) else ():
                        for column, x in zip(out, (doc_id, index.ids[item], s, start, min(int(index.words[item]), len(words))), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if i == 2 else pa.int64()) for i, x in enumerate(out)], ["doc_id", "item_id", "similarity", "start", "n_words"])

        here = rows.mapInArrow(run, FOUND)
        if scratch:
            here = scratch.table(here, f"block-{b}")
            sent.destroy()
        found.append(here)
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of docs, all their columns, in which no benchmark item is found; rows with a null id stay."""
    found = Scratch(docs.sparkSession, "decontaminate").table(find(docs, benchmark, threshold).select("doc_id").distinct(), "found")
    return without(docs, "doc_id", found, "doc_id")
