"""Token ids in files coded by a static range asymmetric numeral system (rANS).

One table of symbol frequencies, from the counts of all ids, serves every file. A file is a run of segments; a segment
holds the ids of consecutive documents and ends in a zero byte:

    b"RANS1\\0" | header, 10 unsigned 64-bit integers | blocks | document index | 0
    header: bytes of the whole segment, its number, documents, ids, ids before it, blocks, bytes of the checkpoints,
            bytes of the document index, bytes of the block data, crc32 of what follows the header
    checkpoints: for each block ids u32, offset u64, crc32 of its ids u32, then for each of LANES lanes its state u64 and words u32

Inside a block symbol i belongs to lane i mod LANES; each lane has a 64-bit state and 32-bit words of its own, so a
block decodes alone, from its checkpoint, with all lanes in step; all blocks of a segment decode at once in numpy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RANS1\0"
LANES = 128
BLOCK = 1 << 16
#: Frequencies add up to 2**SCALE; a state stays in [2**LOW, 2**(LOW + 32)).
SCALE, LOW = 20, 31
HEADER = struct.Struct("<10Q")
CHECKPOINT = np.dtype([("ids", "<u4"), ("at", "<u8"), ("crc", "<u4"), ("state", "<u8", LANES), ("words", "<u4", LANES)])


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, at least 1 for each symbol that occurs; all 0 if none does."""
    counts = counts.astype(np.float64)
    total, there = counts.sum(), counts > 0
    if there.sum() > 1 << SCALE:
        raise ValueError("more symbols than slots")
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.where(there, np.maximum(1, np.floor(counts / total * (1 << SCALE))), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE)
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for i in order:  # only the symbols raised to 1 are too many: the most frequent give
        if over <= 0:
            break
        give = min(over, int(freq[i]) - max(1, int(freq[i]) * 3 // 4))
        freq[i] -= give
        over -= give
    if over > 0:
        raise ValueError("frequencies do not fit")
    return freq.astype(np.uint64)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.most = self.freq << np.uint64(LOW - SCALE + 32)


def _encode(ids: np.ndarray, lanes: int, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, words of each lane and the words, lane after lane in reading order, of rows of `lanes` symbols; the last row may be short."""
    rows, rest = divmod(len(ids), lanes)
    state = np.full(lanes, 1 << LOW, np.uint64)
    steps = rows + bool(rest)
    words, wrote = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), bool)
    mask, s32, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    for row in range(steps - 1, -1, -1):
        s = ids[row * lanes : (row + 1) * lanes]
        k = len(s)
        x, f = state[:k], table.freq[s]
        out = x >= table.most[s]
        words[row, :k], wrote[row, :k] = x & mask, out
        x = np.where(out, x >> s32, x)
        q = x // f
        state[:k] = (q << scale) + (x - q * f) + table.cum[s]
    return state, wrote.sum(0).astype(np.uint32), words.T[wrote.T]


def _decode(n: int, lanes: int, state: np.ndarray, words: np.ndarray, first: np.ndarray, table: Table) -> np.ndarray:
    rows, rest = divmod(n, lanes)
    out = np.empty(n, np.uint32)
    at, x = first.astype(np.int64), state.astype(np.uint64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    last = len(words) - 1
    scale, low, s32, mask = np.uint64(SCALE), np.uint64(1 << LOW), np.uint64(32), np.uint64((1 << SCALE) - 1)
    for row in range(rows + bool(rest)):
        k = lanes if row < rows else rest
        y = x[:k]
        slot = y & mask
        s = table.symbol[slot]
        y = table.freq[s] * (y >> scale) + slot - table.cum[s]
        short = y < low
        x[:k] = np.where(short, (y << s32) | words[np.minimum(at[:k], last)], y)
        at[:k] += short
        out[row * lanes : row * lanes + k] = s
    return out


def encode_segment(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, number: int, before: int, table: Table) -> bytes:
    """One segment: the ids of its documents, in order, each document's length in lengths."""
    full, rest = divmod(len(ids), BLOCK)
    marks = np.zeros(full + bool(rest), CHECKPOINT)
    parts: list[bytes] = []
    at = 0
    if full:
        # row r of all blocks side by side: lane l of block b is column b * LANES + l
        side = ids[: full * BLOCK].reshape(full, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(-1)
        state, n, words = _encode(side, full * LANES, table)
        state, n = state.reshape(full, LANES), n.reshape(full, LANES)
        ends = np.cumsum(n.sum(1))
        marks["ids"][:full], marks["state"][:full], marks["words"][:full], marks["at"][:full] = BLOCK, state, n, 4 * (ends - n.sum(1))
        parts.append(words.astype("<u4").tobytes())
        at = len(parts[0])
    if rest:
        state, n, words = _encode(ids[full * BLOCK :], LANES, table)
        marks[-1]["ids"], marks[-1]["at"], marks[-1]["state"], marks[-1]["words"] = rest, at, state, n
        parts.append(words.astype("<u4").tobytes())
    for b in range(len(marks)):
        marks[b]["crc"] = zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes())
    data, index = b"".join(parts), zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)
    body = marks.tobytes() + data + index
    head = HEADER.pack(len(MAGIC) + HEADER.size + len(body) + 1, number, len(doc_ids), len(ids), before, len(marks), marks.nbytes, len(index), len(data), zlib.crc32(body))
    return MAGIC + head + body + b"\0"


def decode_segment(segment: memoryview, table: Table) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(number, ids before, ids, document ids, lengths) of one segment; ValueError where a checksum fails."""
    size, number, n_docs, n_ids, before, _, n_marks, n_index, n_data, crc = HEADER.unpack_from(segment, len(MAGIC))
    body = segment[len(MAGIC) + HEADER.size : size - 1]
    if bytes(segment[: len(MAGIC)]) != MAGIC or len(body) != n_marks + n_data + n_index or zlib.crc32(body) != crc:
        raise ValueError(f"segment {number} is damaged")
    marks = np.frombuffer(body[:n_marks], CHECKPOINT)
    words = np.frombuffer(body[n_marks : n_marks + n_data], "<u4")
    index = zlib.decompress(body[n_marks + n_data :])
    doc_ids, lengths = np.cumsum(np.frombuffer(index[: 8 * n_docs], "<i8")), np.frombuffer(index[8 * n_docs :], "<u4")
    full = int((marks["ids"] == BLOCK).sum())
    ids = np.empty(n_ids, np.uint32)
    if full:
        n = marks["words"][:full].reshape(-1)
        side = _decode(full * BLOCK, full * LANES, marks["state"][:full].reshape(-1), words, np.cumsum(n, dtype=np.int64) - n, table)
        ids[: full * BLOCK] = side.reshape(BLOCK // LANES, full, LANES).transpose(1, 0, 2).reshape(-1)
    if full < len(marks):
        m = marks[-1]
        ids[full * BLOCK :] = decode_block(m, words, table)
    for b, m in enumerate(marks):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != m["crc"]:
            raise ValueError(f"block {b} of segment {number} is damaged")
    return number, before, ids, doc_ids, lengths


def decode_block(mark: np.void, words: np.ndarray, table: Table) -> np.ndarray:
    """One block alone, from its checkpoint."""
    n = mark["words"].astype(np.int64)
    return _decode(int(mark["ids"]), LANES, mark["state"], words, int(mark["at"]) // 4 + np.cumsum(n) - n, table)


def blocks(segment: memoryview) -> Iterator[tuple[int, bytes, bytes]]:
    """(ids before it in all files, checkpoint, words) of each block of a segment: what decode_alone() takes."""
    _, _, _, _, before, _, n_marks, _, _, _ = HEADER.unpack_from(segment, len(MAGIC))
    first = len(MAGIC) + HEADER.size
    data = first + n_marks
    for mark in np.frombuffer(segment[first:data], CHECKPOINT):
        at = data + int(mark["at"])
        yield before, mark.tobytes(), bytes(segment[at : at + 4 * int(mark["words"].sum(dtype=np.int64))])
        before += int(mark["ids"])


def decode_alone(checkpoint: bytes, words: bytes, table: Table) -> np.ndarray:
    """The ids of one block from its checkpoint and words; ValueError where its checksum fails."""
    mark = np.frombuffer(checkpoint, CHECKPOINT)[0].copy()
    mark["at"] = 0
    ids = decode_block(mark, np.frombuffer(words, "<u4"), table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != mark["crc"]:
        raise ValueError("a block is damaged")
    return ids


def segments(content: bytes):
    """The segments of a file, in order."""
    view, at = memoryview(content), 0
    while at < len(view):
        size = HEADER.unpack_from(view, at + len(MAGIC))[0]
        yield view[at : at + size]
        at += size
