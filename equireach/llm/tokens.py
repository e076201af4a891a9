"""Token ids of a byte-level BPE vocabulary, exactly as the tokenizers library gives them, at a fraction of its time.

The library's file holds the vocabulary and the merges. Where its settings are the plain byte-level ones (checked on
loading), a text splits into chunks at every space that a non-space follows; no pre-token crosses such a split, so
the ids of a text are those of its chunks, and chunks repeat. Chunks found before come from the worker's cache. Any
text with a special string in it, or two spaces in a row, takes a slower way: the pre-token pattern, or the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from equireach.llm.common import kept

#: Chunks that a worker remembers, about 200 bytes each; those met later are encoded each time. Frequent chunks are met early.
CACHE_CHUNKS = 200_000
_TIGHT = re.compile(r" \s| $")
#: The same for Arrow's engine, which knows white space as separators and these controls.
_TIGHT_ARROW = r" [\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]| $"
#: Bytes of text encoded at once: enough for chunks to repeat.
SLICE_BYTES = 2_500_000


def vocabulary_path(name: str) -> str:
    """name: a file of the installed public_tokenizers, or a path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """chunk -> its ids as little-endian 32-bit integers."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str) -> bytes:
        found = self.make(chunk)
        if len(self) < self.most:
            self[chunk] = found
        return found


class Encoder:
    """Ids of texts by one vocabulary file of the tokenizers library."""

    def __init__(self, name: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary_path(name)
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        self.library = Tokenizer.from_str(raw)
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.size = self.library.get_vocab_size()
        self.fast = self._plain(spec)
        if self.fast:
            self._start(spec, cache_chunks)

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether the shortcuts hold: byte-level splitting, no normaliser, and merges numbered in their order of rank."""
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        vocab, pairs = model["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))

    def _start(self, spec: dict, cache_chunks: int) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        byte_of, special = _byte_of(), {a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if v not in special}
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        # a piece is one pre-token already: only the merges are asked of the core
        self._merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._pieces = _Chunks(lambda p: array("I", self._merge(p.encode("utf-8"))).tobytes(), cache_chunks // 4)
        self._first = _Chunks(self._chunk, cache_chunks // 8)
        self._later = _Chunks(lambda c: self._chunk(" " + c), cache_chunks)

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(".,;:!?")
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha():  # letters are one pre-token, with the space before them; marks after them are another
            if len(word) == len(chunk):
                return array("I", self._merge(word.encode("utf-8"))).tobytes()
            return (self._first[word] if bare is word else self._later[bare]) + self._pieces[chunk[len(word) :]]
        left, line, right = chunk.partition("\n")
        if line and left not in ("", " ") and right and not left[-1].isspace() and not right[0].isspace():
            return (self._later[left[1:]] if left[0] == " " else self._first[left]) + self._pieces[line] + self._first[right]
        return b"".join(map(self._pieces.__getitem__, self._pattern.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: empty) as little-endian unsigned 32-bit integers, without added special tokens."""
        if not text:
            return b""
        if not self.fast or self.has_special(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if _TIGHT.search(text):
            return b"".join(map(self._pieces.__getitem__, self._pattern.findall(text)))
        first, _, later = text.partition(" ")
        head = self._first[first] if first else b""
        return head + b"".join(map(self._later.__getitem__, later.split(" "))) if later else head

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token; for vocabularies with the fast way."""
        return self._merge(piece.encode("utf-8"))

    def pre_tokens(self, text: str) -> list[str]:
        return self._pattern.findall(text)

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(which texts need the slower way, where each text's chunks begin, the distinct chunks, the chunks as indices of those)."""
        slow = pc.match_substring_regex(texts, "|".join([_TIGHT_ARROW, *map(re.escape, self.specials)]))
        lists = pc.split_pattern(pc.if_else(slow, "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        return slow.to_numpy(zero_copy_only=False), offsets - offsets[0], coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()

    def encode_many(self, texts: pa.Array, size: int | None = None) -> list[bytes]:
        """encode() of each text of an array: each distinct chunk of a slice of `size` bytes is looked up once."""
        texts = texts.fill_null("")
        if not self.fast:
            return [self.encode(x) for x in texts.to_pylist()]
        out: list[bytes] = []
        for part in slices(texts, size or SLICE_BYTES):
            slow, starts, distinct, index = self.chunks(part)
            ids = pa.array(list(map(self._later.__getitem__, distinct)), pa.binary()).take(pa.array(index))
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else memoryview(b"")
            first = ends[np.minimum(starts[:-1] + 1, len(ids))].tolist()
            for i, (a, b, hard) in enumerate(zip(first, ends[starts[1:]].tolist(), slow.tolist(), strict=True)):
                if hard:
                    out.append(self.encode(part[i].as_py()))
                else:
                    head = distinct[index[starts[i]]]
                    out.append((self._first[head] if head else b"") + bytes(data[a:b]))
        return out


def encoder(name: str, cache_chunks: int = CACHE_CHUNKS) -> Encoder:
    """This worker's encoder, that of the vocabulary asked for last; held until a task of another kind lets go of it."""
    return kept("encoder", (name, cache_chunks), lambda: Encoder(name, cache_chunks))


def slices(texts: pa.Array, size: int = 500_000):
    """The array in slices of about `size` bytes, which bounds what numpy holds beside them; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, to - at)
        at = to
