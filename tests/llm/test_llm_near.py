import random
import re
from collections import Counter

import numpy as np
import pytest

from equireach.llm import common, decontaminate, ngram_join, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_list(text):
    w = words_of(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def join_twin(rows):
    sets = {i: set(shingle_list(t)) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def frame(spark, rows, n=3):
    return spark.createDataFrame([(i, t, "extra", 0) for i, t in rows], "doc_id long, text string, star string, n int").repartition(n)


def linked(spark, rows, n=3):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(frame(spark, rows, n)).collect()}


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = ["", None, "  \n", "one", "ONE", "one two three four", "one two three four five", "a b c d e f"]
    for size in (12, 30, 80, 150):
        texts += family(r, [r.choice(vocabulary) for _ in range(size)], 25, max(2, size // 20))
    texts += [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25))) for _ in range(40)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += [texts[20]] * 15 + [texts[30].upper()]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    assert linked(spark, rows) == join_twin(rows)


def test_join_with_small_blocks_and_one_vote(spark, monkeypatch):
    """Every way of the operator at work: stars and rows in several blocks, hot keys, and near sets that only prefixes can find."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 500)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 16)
    monkeypatch.setattr(ngram_join, "VOTES", 8)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "MOST_HOT", 20)
    r = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    calls, real = [], ngram_join._cross_links
    monkeypatch.setattr(ngram_join, "_cross_links", lambda *a: calls.append(a[-1]) or real(*a))
    rows = list(enumerate(family(r, base, 60, 4) + family(r, base[::-1], 20, 6)))
    assert linked(spark, rows) == join_twin(rows) and calls == ["head-links", "cross-links"]


def test_join_edges(spark):
    assert linked(spark, []) == {}
    assert linked(spark, [(4, None), (2, "")]) == {4: (0, 4), 2: (0, 2)}
    same = [(i, "a b c d e f g") for i in (5, 3, 3, 9)]
    assert linked(spark, same) == {5: (3, 3), 3: (3, 3), 9: (3, 3)}
    assert linked(spark, [(1, "x " * 30_000), (2, "x " * 20_000), (3, "x y")])[2] == (1, 1)


def test_join_of_the_driver(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_ngram_join(spark, SF).collect()}
    assert got == join_twin(rows)


def found_twin(rows, items, threshold=0.75):
    out = {}
    for d, t in rows:
        w = words_of(t)
        for i, text in items:
            iw = words_of(text)
            if not iw or not w:
                continue
            if len(iw) < 5:
                if any(w[k : k + len(iw)] == iw for k in range(len(w) - len(iw) + 1)):
                    out[d, i] = 1.0
                continue
            theirs = Counter(shingle_list(text))
            mine = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            n = min(len(iw), len(w)) - 4
            best = 0.0
            for k in range(len(mine) - n + 1):
                both = sum((Counter(mine[k : k + n]) & theirs).values())
                best = max(best, both / (n + sum(theirs.values()) - both))
            if best >= threshold:
                out[d, i] = best
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 5, 8, 20, 20, 40, 40, 59))] + [(20, ""), (21, None), (22, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = [(0, None), (1, ""), (2, "w1"), (3, "w1 " * 40)]
    for k in range(160):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if k % 2:
            piece = words_of(r.choice(items)[1])
            for _ in range(r.randint(0, 2)):
                if piece:
                    piece[r.randrange(len(piece))] = r.choice(vocabulary)
            cut = r.randint(0, len(piece) // 5)
            w[(at := r.randint(0, len(w))) : at] = piece[cut:]
        rows.append((10 + k, " ".join(w).upper() if k % 3 == 0 else " ".join(w)))
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.find(docs, bench).collect()}
    want = found_twin(rows, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 15
    kept = {x["doc_id"] for x in decontaminate.clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want} and decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 60)
    items = [(i, " ".join(f"i{i}x{k}" for k in range(8))) for i in range(6)]
    docs = frame(spark, [(i, f"before {t} after") for i, t in items])
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(6)}


def test_index_selects(capsys):
    """Every pair within the radius is found, few others are looked at, and like windows are within the radius."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"x{v}" for v in r.integers(0, 5000, 40)) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), texts, 0.75)
    bits = lambda p: np.unpackbits(p, axis=-1).astype(int)
    prints = r.integers(0, 256, (600, decontaminate.BLOCKS), np.uint8)
    for i in range(300):  # so many bits from an item: in and around the radius
        flipped = bits(index.prints[i])
        flipped[r.choice(decontaminate.BITS, decontaminate.RADIUS - 3 + i % 7, replace=False)] ^= 1
        prints[i] = np.packbits(flipped)
    window, item = index.lookup(prints, 40)
    distance = (bits(prints)[:, None] != bits(index.prints)[None]).sum(2)
    within = set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS)), strict=True))
    found = set(zip(window.tolist(), item.tolist(), strict=True))
    share = (window >= 300).mean() * len(window) / (300 * 300)
    assert within <= found and len(within) > 150 and share < 0.05
    assert set(zip(*(x.tolist() for x in index.candidates(prints, 40)), strict=True)) == within
    # pairs of shingle sets just above the threshold
    like, near = 0, 0
    for n in (7, 8, 15, 36, 60, 120):
        same = -(-6 * n // 7)
        for _ in range(300):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.append(a[:same], r.integers(0, 1 << 63, n - same).astype(np.uint64))
            p = [decontaminate.fingerprints(decontaminate._bit_rows(x).sum(0, dtype=np.int64)[None], np.array([n]))[0] for x in (a, b)]
            like += 1
            near += (bits(p[0]) != bits(p[1])).sum() <= decontaminate.RADIUS
    with capsys.disabled():
        print(f"\nindex: {share:.3f} of random pairs reach the distance, recall within the radius 1.0; {near} of {like} pairs at the threshold are within it")
    assert near == like


def test_decontamination_edges(spark):
    r = random.Random(5)
    item = " ".join(r.choice("abcdefgh") + str(k) for k in range(30))
    long = " ".join(f"f{k % 977}" for k in range(60_000))
    rows = [(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (2, f"{item} {item}"), (3, f"{long} {item} {long}"), (4, long)]
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, item, 2), (None, item, 3)], "item_id long, text string, doc_id int")
    got = sorted((x["doc_id"] or 0, x["item_id"], x["start"], x["similarity"]) for x in decontaminate.find(frame(spark, rows), bench).collect())
    assert got == sorted((d, i, s, 1.0) for d, s in ((1, 1), (1, 1), (0, 0), (2, 0), (3, 60_000)) for i in (7, 8))
