"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the byte n-grams of its words, lower-cased and with word edges marked, hashed to `1 << BITS` rows of
an embedding. Rows are averaged and a linear softmax follows; both are fitted together by Adam. An unseen misspelling
shares most n-grams with the word it comes from. N-grams that more than `common` of the training texts hold, and either
class about as often as the other, say little and are left out of the average. Once fitted, a row's part in the logit is one number, so scoring sums a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import mix64
from equireach.llm.tokens import slices

BITS = 18
GRAMS = (4, 5, 6)
#: The index of what is no n-gram; its table entries are 0.
NONE = 1 << BITS
_EDGE = 32
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else _EDGE for b in range(256)], np.uint8)
_CODES = mix64(np.arange(1000, 1256, dtype=np.uint64))
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(max(GRAMS))]


@dataclass
class Model:
    """score: each row's part in the logit of the positive class; counts: 1 for rows that the average includes."""

    score: np.ndarray
    counts: np.ndarray
    bias: float


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the folded bytes of all texts, an edge before, between and after them; where each text begins)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lengths = np.diff(ends)
    out = np.full(int(lengths.sum()) + len(texts) + 1 + max(GRAMS), _EDGE, np.uint8)
    starts = np.cumsum(lengths) - lengths + np.arange(len(texts)) + 1
    if ends[-1] > ends[0]:
        data = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
        out[np.arange(len(data)) + np.repeat(np.arange(1, len(texts) + 1), lengths)] = data
    return out, starts


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the rows at every byte (NONE where no word's n-gram begins), and where each text begins."""
    data, starts = _padded(texts)
    n = len(data) - max(GRAMS)
    edge = data == _EDGE
    code, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(max(GRAMS)):
        code += _CODES[data[k : n + k]] * _STEP[k]
        if k >= 2:
            inner |= edge[k - 1 : n + k - 1]
        if k + 1 in GRAMS:
            yield np.where(inner, NONE, (mix64(code + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)), starts


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, counts, where each text's begin): the distinct rows of each text."""
    rows, counts, at = [np.empty(0, np.int32)], [np.empty(0, np.float32)], [0]
    for text in texts:
        one = np.concatenate([i[i != NONE] for i, _ in grams(pa.array([text]))]).astype(np.int32)
        r, c = np.unique(one, return_counts=True)
        rows.append(r)
        counts.append(c.astype(np.float32))
        at.append(at[-1] + len(r))
    rows = [np.concatenate(rows)]  # the parts go before the next array comes
    counts = [np.concatenate(counts)]
    return rows[0], counts[0], np.array(at)


def fit(texts: list[str], labels: list[int], width: int = 4, epochs: int = 8, batch: int = 128, least_steps: int = 300, rate: float = 0.05, decay: float = 2e-4, common: float = 0.05, seed: int = 7) -> Model:
    """The model of texts with labels 0 and 1, after epochs passes and least_steps steps; with no texts or one class, a model that says that class's share."""
    n, share = len(texts), (sum(labels) + 0.5) / (len(labels) + 1)
    counts = np.zeros(NONE + 1, np.float32)
    if not n or len(set(labels)) < 2:
        return Model(counts.copy(), counts, float(np.log(share / (1 - share))))
    rows, held, at = bags(texts)
    positive = np.repeat(np.array(labels, bool), np.diff(at))
    of = [(np.bincount(rows[positive == c], minlength=NONE) + 0.5) / (sum(x == c for x in labels) + 1) for c in (False, True)]
    counts[:NONE] = (np.bincount(rows, minlength=NONE) <= common * n) | (np.maximum(*of) > 2 * np.minimum(*of))
    del positive, of
    kept = counts[rows] > 0
    at = np.append(0, np.cumsum(kept))[at]
    rows, held = rows[kept], held[kept]
    random = np.random.default_rng(seed)
    table = (random.standard_normal((NONE, width)) * 0.1).astype(np.float32)
    head = (random.standard_normal((width, 2)) * 0.5).astype(np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    params, step = [table, head, bias], 0
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    y, scale = np.array(labels), np.float32(20.0)  # an average over some hundred n-grams is small: the softmax sees it enlarged
    for _ in range(max(epochs, -(-least_steps * batch // n))):
        order = random.permutation(n)
        for low in range(0, n, batch):
            mine = order[low : low + batch]
            index = np.concatenate([np.arange(at[i], at[i + 1]) for i in mine])
            size = np.diff(at)[mine]
            owner = np.repeat(np.arange(len(mine)), size)
            total = np.bincount(owner, held[index], len(mine))
            share_of = (held[index] / np.maximum(total, 1)[owner]).astype(np.float32) * scale
            r = rows[index]
            mean = np.stack([np.bincount(owner, table[r, d] * share_of, len(mine)) for d in range(width)], 1).astype(np.float32)
            logits = mean @ head + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(mine)), y[mine]] -= 1
            p /= len(mine)
            back = p @ head.T
            distinct, place = np.unique(r, return_inverse=True)
            slope = np.stack([np.bincount(place, back[owner, d] * share_of, len(distinct)) for d in range(width)], 1)
            step += 1
            for k, (param, grad, at_rows) in enumerate(((table, slope + decay * table[distinct] / len(mine), distinct), (head, mean.T @ p + decay * head, slice(None)), (bias, p.sum(0), slice(None)))):
                first[k][at_rows] = 0.9 * first[k][at_rows] + 0.1 * grad
                second[k][at_rows] = 0.99 * second[k][at_rows] + 0.01 * grad**2
                param[at_rows] -= rate * (first[k][at_rows] / (1 - 0.9**step)) / (np.sqrt(second[k][at_rows] / (1 - 0.99**step)) + 1e-8)
    score = np.zeros(NONE + 1, np.float32)
    score[:NONE] = table @ (head[:, 1] - head[:, 0]) * scale * counts[:NONE]
    seen = np.zeros(NONE, bool)
    seen[rows] = True
    score[:NONE][~seen] = 0  # rows that no text trained say nothing
    return Model(score, counts, float(bias[1] - bias[0]))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of the positive class for each text of an array without nulls."""
    out = [np.empty(0)]
    for part in slices(texts):
        top, bottom = np.zeros(len(part)), np.zeros(len(part))
        for index, starts in grams(part):
            at = starts - 1  # the edge before a text is part of its first n-grams
            top += np.add.reduceat(model.score[index].astype(np.float64), at)
            bottom += np.add.reduceat(model.counts[index].astype(np.float64), at)
        out.append(1 / (1 + np.exp(-np.clip(model.bias + top / np.maximum(bottom, 1), -30, 30))))
    return np.concatenate(out)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted); only the text is an input of the score.

    The model is fitted on at most train_rows labelled rows whose crc32(id as text) mod 5 is not 0: those with the
    smallest hash of their id. Null labels do not train; of an id's several labels the larger counts, of its several
    texts the one with the smallest hash. Whole texts of these rows, and nothing else, come to the driver. A null or empty text scores as no n-grams do, by the share of
    the label; a null id is not held out. Rows that repeat are each scored; an empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold != 0))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.text", "label").toPandas().sort_values("doc_id")
    sent = spark.sparkContext.broadcast(fit([x or "" for x in got["text"]], [int(x) for x in got["label"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(batch.column(2).fill_null(""), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
