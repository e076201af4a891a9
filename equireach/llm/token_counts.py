"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

Tier one is a compact table, broadcast, of the lengths in tokens of frequent pre-tokens; tier two is each worker's cache,
in which pre-tokens that the table lacks are encoded. The table decides the speed only, never a count. It is taken from
about `table_docs` documents drawn by hash from all rows, counted where they lie: what comes to the driver is the most
frequent pre-tokens of each task that holds such a document.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import kept
from equireach.llm.tokens import CACHE_CHUNKS, SLICE_BYTES, Encoder, encoder, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens that a task reports of its sampled documents.
TASK_PIECES = 4000
_MARKS = ".,;:!?"


class _Lengths(dict):
    """Text -> tokens; what is not there is found by `of` and kept while there are fewer than `most`."""

    def __init__(self, table: dict[str, int], of, most: int):
        super().__init__(table)
        self.of, self.most = of, most + len(table)

    def __missing__(self, text: str) -> int:
        n = self.of(text)
        if len(self) < self.most:
            self[text] = n
        return n


class Lookup:
    """Counts of tokens by pre-tokens: the table's first, then those met before, then the vocabulary's merges."""

    def __init__(self, enc: Encoder, table: dict[str, int], cache: int = CACHE_CHUNKS):
        self.enc = enc
        self.pieces = _Lengths(table, lambda p: len(enc.merge(p)) if p else 0, cache // 2)
        self.first = _Lengths({}, self._words, cache // 8)
        self.later = _Lengths({}, lambda chunk: self._words(" " + chunk), cache)

    def _words(self, chunk: str) -> int:
        """The tokens of what stands between two spaces, the first of these included if it has one."""
        word = chunk.rstrip(_MARKS)
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):  # one pre-token, and marks after it another
            return self.pieces[word] + self.pieces[chunk[len(word) :]]
        return sum(map(self.pieces.__getitem__, self.enc.pre_tokens(chunk)))

    def count(self, text: str) -> int:
        """Of a whole text, pre-token by pre-token; one with a special string goes through the library."""
        if self.enc.has_special(text):
            return self.enc.count(text)
        return sum(map(self.pieces.__getitem__, self.enc.pre_tokens(text)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Of each text of an array without nulls; each distinct chunk of a slice is looked up once."""
        found = [np.empty(0, np.int64)]
        for part in slices(texts, SLICE_BYTES):
            slow, starts, distinct, index = self.enc.chunks(part)
            lengths = np.fromiter(map(self.later.__getitem__, distinct), np.int64, len(distinct))[index]
            lengths[starts[:-1]] = [self.first[x] if (x := distinct[i]) else 0 for i in index[starts[:-1]]]
            n = np.add.reduceat(lengths, starts[:-1])
            for i in np.flatnonzero(slow):
                n[i] = self.count(part[int(i)].as_py())
            found.append(n)
        return np.concatenate(found)


def frequent_lengths(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, table_docs: int, table_size: int) -> dict[str, int]:
    """The lengths of the pre-tokens most frequent in about table_docs documents; empty where the vocabulary has no fast way."""
    enc = encoder(vocabulary)
    total = docs.count() if enc.fast else 0
    if not total:
        return {}
    span, text = float(1 << 64), F.col(text_col).cast("string")
    drawn = docs.where(F.xxhash64(id_col, text).cast("double") <= min(1.0, table_docs / total) * span - span / 2).select(text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = encoder(vocabulary), Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x and not mine.has_special(x):
                    seen.update(mine.pre_tokens(x))
        top = seen.most_common(TASK_PIECES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    seen: Counter = Counter()
    got = drawn.mapInArrow(count, "piece string, n long").toArrow()
    for piece, n in zip(got["piece"].to_pylist(), got["n"].to_pylist(), strict=True):
        seen[piece] += n
    return {piece: len(enc.merge(piece)) for piece, n in seen.most_common(table_size) if n > 1}


def _lookup(key: str, sent, vocabulary: str) -> Lookup:
    """The lookup of a query; a worker makes it once and holds the last one."""
    return kept("lookup", key, lambda: Lookup(encoder(vocabulary), sent.value))


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text", table_docs: int = 400, table_size: int = 20_000) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit), over every whole text.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are each counted; a null id stays null; an empty table
    gives an empty result; other columns are not read. Special strings inside a text count as the library counts them.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary, id_col, text_col, table_docs, table_size)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = _lookup(key, sent, vocabulary).counts(texts) if enc.fast else np.array([enc.count(x) for x in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, SCHEMA)
