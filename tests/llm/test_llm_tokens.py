import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equireach.llm import packing, rans, token_counts, token_files, tokens

VOCABULARY = "byte_bpe_50k.json"
TEXTS = ["", " ", "  ", "a", "Hello, world. It's\nus", "x  y", "end ", "<|endoftext|>", "a <|endoftext|> b", "don't'll", "été ÉTÉ 中文 字", "१२ ½ ²", "a b 　c", "\x1c a\x1cb", "one\n\ntwo \n three", "word.\nWord, word", "\t tab\t", "😀 x😀", " 'lead", "w" * 3000, "1234 567", None]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path(VOCABULARY))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    r = random.Random(5)
    pieces = [*"ab cd  \n\t.,'sé中१½²_-\x0b\x1c\x85\xa0　ǅʰ😀", "'s", "'ll", " '", "<|endoftext|>", "  ", "\n\n", "lor", "em"]
    texts = TEXTS + ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    enc = tokens.Encoder(VOCABULARY, cache_chunks=64)
    many = enc.encode_many(pa.array(texts, pa.string()))
    for t, m in zip(texts, many, strict=True):
        want = ids(library, t)
        assert np.frombuffer(m, "<u4").tolist() == want and np.frombuffer(enc.encode(t), "<u4").tolist() == want, t


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, length int")


def test_counts(spark, library):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(ids(library, t)) and got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 512)
    assert token_counts.count_tokens(docs(spark, TEXTS).limit(0)).count() == 0
    twice = docs(spark, ["a b"]).unionAll(docs(spark, ["a b"]))
    assert token_counts.count_tokens(twice).count() == 2


def check_packing(rows, library, texts, context):
    by_doc, by_seq = {}, {}
    for r in rows:
        whole = ids(library, texts[r["doc_id"]]) + [0]
        piece = whole[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and r["doc_tokens"] == len(whole)
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(ids(library, t)) + 1
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= context
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_packing(spark, library):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choice(["alpha", "beta", "gamma."]) for _ in range(r.randint(0, 90))) for _ in range(150)]
    n = check_packing(packing.pack(docs(spark, texts).repartition(5), context=64).collect(), library, texts, 64)
    total = sum(len(ids(library, t)) + 1 for t in texts)
    assert n <= 1.03 * total / 64 + 1
    assert packing.pack(docs(spark, []), context=64).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_histogram(seed):
    r = random.Random(seed)
    counts = Counter(r.choice([r.randint(1, 64), 64, 1, 33]) for _ in range(500))
    patterns = packing.pack_histogram(dict(counts), 64)
    held = Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            held[x] += n
    assert held == counts
    table = packing.slots(patterns)
    assert {k: int(sum(n * lengths.count(k) for n, lengths in patterns)) for k in counts} == {k: counts[k] for k in table}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 77])
def test_rans_round_trip(n):
    r = np.random.default_rng(n)
    found = np.minimum(r.zipf(1.3, n), 50256).astype(np.uint32)
    table = rans.Table(rans.quantise(np.bincount(found, minlength=50257)))
    segment = rans.encode_segment(found, np.array([3, 9]), np.array([n // 3, n - n // 3]), 4, 11, table)
    number, before, back, doc_ids, lengths = rans.decode_segment(memoryview(segment), table)
    assert (number, before, doc_ids.tolist(), lengths.tolist()) == (4, 11, [3, 9], [n // 3, n - n // 3]) and (back == found).all()
    assert [len(x) for x in rans.segments(segment + segment)] == [len(segment)] * 2
    if n > rans.BLOCK:
        marks = np.frombuffer(segment[len(rans.MAGIC) + rans.HEADER.size :][: rans.CHECKPOINT.itemsize * 2], rans.CHECKPOINT)
        head = rans.HEADER.unpack_from(segment, len(rans.MAGIC))
        start = len(rans.MAGIC) + rans.HEADER.size + head[6]
        words = np.frombuffer(segment[start : start + head[8]], "<u4")
        assert (rans.decode_block(marks[1], words, table) == found[rans.BLOCK : 2 * rans.BLOCK]).all()


def test_damage_is_seen():
    found = np.arange(1000, dtype=np.uint32) % 7
    table = rans.Table(rans.quantise(np.bincount(found, minlength=9)))
    segment = bytearray(rans.encode_segment(found, np.array([1]), np.array([1000]), 0, 0, table))
    segment[-30] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_segment(memoryview(bytes(segment)), table)


def test_one_symbol_and_rare_ones():
    assert rans.quantise(np.array([0, 5, 0])).tolist() == [0, 1 << rans.SCALE, 0]
    freq = rans.quantise(np.append(np.full(50000, 1), 10**12))
    assert freq.min() == 1 and freq.sum() == 1 << rans.SCALE


def test_token_files(spark, library):
    texts = TEXTS * 3
    frame = docs(spark, texts).repartition(4)
    got = sorted(token_files.round_trip(frame).collect())
    at = 0
    for i, t in enumerate(texts):
        whole = ids(library, t) + [2]
        assert tuple(got[i]) == (i, at, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()))
        at += len(whole)
    assert token_files.round_trip(docs(spark, [])).count() == 0


def test_files_hold_ids_in_order(spark, tmp_path):
    token_files.write(docs(spark, ["a b c"] * 50).repartition(3), f"file://{tmp_path}/out")
    freq = spark.read.parquet(f"file://{tmp_path}/out.table").toPandas()
    table = np.zeros(int(freq["id"].max()) + 1, np.uint64)
    table[freq["id"]] = freq["freq"]
    seen = []
    for path in sorted(tmp_path.glob("out/part=*/*.txt")):
        for segment in rans.segments(path.read_bytes()):
            seen += rans.decode_segment(segment, rans.Table(table))[3].tolist()
    assert seen == list(range(50))


def test_blocks_decode_apart(spark, library, tmp_path, monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma.", "delta"]) for _ in range(r.randint(0, 9000))) for _ in range(40)]
    token_files.write(docs(spark, texts).repartition(3), f"file://{tmp_path}/out")
    whole = np.concatenate([ids(library, t) + [2] for t in texts])
    got = token_files.read_blocks(spark, f"file://{tmp_path}/out", 5).collect()
    assert len(got) >= len(whole) // rans.BLOCK and sum(len(x["ids"]) for x in got) == len(whole)
    for x in got:
        assert whole[x["start"] : x["start"] + len(x["ids"])].tolist() == x["ids"]


def test_token_files_with_null_and_repeated_ids(spark, library):
    rows = [(None, "a b"), (5, "x y"), (5, "x y"), (-1, "c"), (None, "a b"), (7, "word " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("clash"), "number": F.lit(None).cast("int")})
    got = token_files.round_trip(frame.repartition(2)).collect()
    lengths = {t: len(ids(library, t)) + 1 for _, t in rows}
    at = 0
    for x, (i, t) in zip(sorted(got, key=lambda x: x["start"]), [rows[0], rows[4], rows[3], rows[1], rows[2], rows[5]], strict=True):
        assert (x["doc_id"], x["start"], x["n_tokens"]) == (i, at, lengths[t])
        at += lengths[t]
    with pytest.raises(ValueError):
        token_files.round_trip(spark.createDataFrame([(-(1 << 63), "x")], "doc_id long, text string"))


def test_counts_of_all_kinds_of_text(spark, library):
    """Every pre-token goes through the table: those in it, and those that it lacks; null and repeated ids."""
    r = random.Random(6)
    pieces = [*"ab cd  \n\t.,'s\u00e9\u4e2d1\u00bd_-\x1c\u00a0\u3000", "'s", "'ll", " '", "<|endoftext|>", "  ", "lorem", "ipsum,", " dolor"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(600)] + ["lorem ipsum " * 40_000]
    frame = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")))
    got = token_counts.count_tokens(frame.unionAll(frame.limit(3)), table_docs=300, table_size=50).collect()
    assert len(got) == len(texts) + 3 and sum(x["doc_id"] is None for x in got) >= 13
    assert all(x["n_tokens"] == len(ids(library, texts[x["doc_id"]])) for x in got if x["doc_id"] is not None)
    table = token_counts.frequent_lengths(frame, VOCABULARY, "doc_id", "text", 300, 50)
    assert len(table) == 50 and " dolor" in table and all(n == len(ids(library, p)) for p, n in table.items() if "<" not in p)


def test_packing_edges(spark, library):
    texts = ["alpha beta gamma. " * 2000, "", None, "alpha beta", "alpha beta"]
    rows = [(i if i != 4 else 3, t) for i, t in enumerate(texts)] + [(None, "alpha")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("clash"), "sequence_id": F.lit("clash")})
    got = packing.pack(frame.repartition(3), context=128).collect()
    spans = {}
    for x in got:
        spans.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in spans.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces[:-1], pieces[1:], strict=True)) and sum(n for _, n in pieces) <= 128
    held = Counter()
    for x in got:
        held[x["doc_id"]] += x["length"]
    want = Counter()
    for i, t in rows:
        want[i] += len(ids(library, t)) + 1
    assert held == want and len(spans) <= 1.1 * sum(want.values()) / 128 + 1
