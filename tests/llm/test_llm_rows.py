import base64
import gzip
import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equireach.llm import common, components, exact_dedup, language, queries, sharding, toxicity, warc
from equireach.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, hash string, n int")


EQUAL = ["a b", "ab", "a\tb\n", None, " ", "", "xx", "x x ", "y", "ab", "é é", "éé", "a b"]


def dedup_twin(texts):
    bare = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for t in texts]
    out = {}
    for i, b in enumerate(bare):
        group = [j for j, c in enumerate(bare) if c == b]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        out[i] = (keep, len(group), i == keep, hashlib.sha256(b.encode()).hexdigest())
    return out


@pytest.mark.parametrize("weak", [None, "one hash", "first digit"])
def test_exact_dedup(spark, weak):
    hash_of = {None: F.md5, "one hash": lambda c: F.lit("z"), "first digit": lambda c: F.substring(F.md5(c), 1, 1)}[weak]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.groups(docs(spark, EQUAL).repartition(3), hash_of=hash_of).collect()}
    assert got == dedup_twin(EQUAL)


def test_exact_dedup_edges(spark):
    assert exact_dedup.groups(docs(spark, [])).count() == 0
    twice = exact_dedup.groups(docs(spark, ["a", "a"], [7, 7])).collect()
    assert len(twice) == 2 and all(r["keep_id"] == 7 and r["group_size"] == 2 and r["kept"] for r in twice)


def test_exact_dedup_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = sorted(db.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLE_SQL['op6_exact_dedup']})").fetchall())
    got = queries.op6_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(tuple(r) for r in got) == want


def test_sharding(spark):
    texts = ["", None, "é", "long " * 5000, *["same"] * 600]
    rows = sharding.assign(docs(spark, texts).repartition(4)).collect()
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 8)
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert set(by_shard) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert all(40 < len(x) < 120 for x in by_shard.values())
    alone = sharding.assign(docs(spark, ["z"], [77])).first()
    assert alone["shard"] == next(r["shard"] for r in rows if r["doc_id"] == 77)
    assert sharding.assign(docs(spark, [])).count() == 0
    assert sharding.assign(docs(spark, ["a", "a"], [None, None])).select("shard", "slot").distinct().count() == 2


def test_growth_and_weights_stay_in_their_subtree(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for n in (1, 3, 8, 9, 12):
        moved = ids.select(sharding.shard_of(F.col("doc_id"), sharding.tree(max(n, 8))).alias("a"), sharding.shard_of(F.col("doc_id"), sharding.tree(max(n, 8) + 1)).alias("b")).where("a <> b")
        assert moved.where(F.col("b") != max(n, 8)).count() == 0 < moved.count()
    now = sharding.tree(8)
    first = now.children[0]
    rack = first.children[0]
    heavy = sharding.Node("root", (sharding.Node(first.name, (sharding.Node(rack.name, (sharding.Node(rack.children[0].name, shard=0, own=3.0), rack.children[1])), first.children[1])), now.children[1]))
    pairs = ids.select(sharding.shard_of(F.col("doc_id"), now).alias("a"), sharding.shard_of(F.col("doc_id"), heavy).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    assert pairs and all(r["b"] in (0, 1, 2, 3) for r in pairs)  # rows move into the region that grew, never between others
    assert ids.select(sharding.shard_of(F.col("doc_id"), heavy).alias("s")).where("s = 0").count() > 3000 / 8 * 1.8


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")


PAGES = [(5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://b/\r\nX: y", ""), (4, "u", None), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "q" * 300_000), (6, "u", "<p>x</p>")]


def test_warc_round_trip(spark):
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark, PAGES).repartition(3)).collect()}
    payload = {p: (h or "").encode() for p, _, h in PAGES}
    for p, raw in payload.items():
        first = min(q for q, other in payload.items() if other == raw)
        r = got[p]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if p == first else ("revisit", first))
    assert {r["record_type"] for r in warc.round_trip(pages(spark, PAGES), least=10).collect()} == {"response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_files_are_gzip_members(spark, tmp_path):
    warc.write(pages(spark, PAGES), f"file://{tmp_path}/w")
    raw = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("w/*.txt")))
    assert gzip.decompress(raw).count(b"WARC-Type: ") == len(PAGES)
    found = list(warc.records(raw))
    assert len(found) == len(PAGES) and all(h["WARC-Target-URI"].isprintable() for h, _ in found if "WARC-Target-URI" in h)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(raw[:-5]))


def test_warc_closes_a_run_that_ends_in_a_large_member(monkeypatch, spark):
    real = warc.page_record
    monkeypatch.setattr(warc, "page_record", lambda *a: real(*a)[:-1] + b"\x01")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "html": ["x"], "of": pa.array([None], pa.int64())})
    out = b"".join(b.column(0)[0].as_py() + b"\0" for b in warc._members(iter([batch])))
    assert b"metadata" in zlib.decompressobj(31).decompress(out[out.rindex(b"\x1f\x8b\x08") :])


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (4, 3), (10, 11), (11, 12), (12, 10), (20, 20), *[(i, i + 1) for i in range(100, 130)]], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(links, Scratch(spark, "t")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and {got[i] for i in range(100, 131)} == {100} and 20 not in got
    assert components.components(links.limit(0), Scratch(spark, "t")).count() == 0


def test_toxicity_learns_subwords(spark):
    import random

    r = random.Random(1)
    clean = ["garden", "river", "window", "music", "letter", "bread", "silver", "cloud"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(clean) + r.choice(["", "s", "ing"]) for _ in range(r.randint(10, 60))]
        if bad := i % 4 == 0:
            words[r.randrange(len(words))] = r.choice(["nastygram", "nastyface", "vileperson"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(900, "garden river nastyfaces music"), (901, None), (902, ""), (903, "river window")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(d, lab).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    right = sum(got[i]["predicted"] == labels[i][1] for i in held)
    assert right / len(held) > 0.93 and got[900]["predicted"] == 1 and got[903]["predicted"] == 0 and got[901]["score"] == got[902]["score"]
    none = toxicity.score(d, lab.limit(0)).collect()
    assert len(none) == len(rows) and toxicity.score(d.limit(0), lab).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    high, low = scored["score"][scored["toxic"] == 1], scored["score"][scored["toxic"] == 0]
    assert sum((low < h).mean() for h in high) / len(high) > 0.85


def test_language(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then it goes home ", "der schnelle braune fuchs springt über den faulen hund und geht nach hause "
    rows = [(i, f"http://h{i % 2}.{'de' if i % 2 else 'com'}/", f"<html lang='{'de' if i % 2 else 'en'}'><script>var x</script><p>{(de if i % 2 else en) * 3}</p></html>") for i in range(40)]
    rows += [(100, None, f"<p>{de * 2}</p>"), (101, "x", None), (102, "http://h0.com/", "<html lang=de><p>" + en * 4), (103, "http://h0.com/", "<p>%%% ### 123 456 789 &&&</p>")]
    got = {r["id"]: r for r in language.of_pages(pages(spark, rows)).collect()}
    assert len(got) == 44 and all(got[i]["language"] == ("de" if i % 2 else "en") for i in range(40))
    assert got[100]["language"] == "de" and got[102]["language"] == "en" and not got[101]["accepted"] and not got[103]["accepted"] and got[103]["language"] == "und"
    bare = spark.createDataFrame([(1, "text here", None, None)], "doc_id long, text string, lang string, source string")
    assert [r["accepted"] for r in language.of_documents(bare).collect()] == [True] and language.of_documents(bare.limit(0)).count() == 0


def test_host_shares_decide_where_text_says_little(spark):
    en, de = "the and of that with this have from ", "der die und das mit nicht ein eine "
    rows = [(i, (de if i % 2 else en) * 4, "de" if i % 2 else "en", "sued.example" if i % 2 else "north.example") for i in range(80)]
    rows += [(200, "xyz", None, "sued.example"), (201, "xyz", None, "north.example")]
    got = {r["id"]: r["language"] for r in language.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[200] == "de" and got[201] == "en"


def test_pages_of_the_driver(spark):
    got = queries.op5_language_id(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and sum(r["accepted"] for r in got) > 0.95 * len(got)


def test_visible_text():
    page = "a<!-- x > --><b title='1'>c</b><SCRIPT>if (a<b) d()</Script >e<style>f</style>&#252;&uuml;&amp;<script>g<!--h"
    assert language.visible(page).split() == ["a", "c", "e", "\u00fc\u00fc&", "g<!--h"]
    assert language.visible(None) == "" and language.visible("1 < 2") == "1 < 2" and "\u00fc" in language.visible("&#xFC;")
    began = time.monotonic()
    for tag in ("<!--", "<script>", "<style ", "<", "<b "):
        assert language.visible("x " + tag * 100_000).startswith("x")
    assert time.monotonic() - began < 20


def fused_twin(rows, least_letters=0.4, least_probability=0.5):
    """The fusion row by row: the text's posterior from the operator's model, all other evidence counted here."""
    names = sorted({r["lang"] for r in rows if r["lang"] and r["text"]})
    texts = {n: pa.array([r["text"] for r in rows if r["lang"] == n]) for n in names}
    found = [np.unique(language.trigrams(texts[n])[0], return_counts=True) for n in names]
    model = language.Model(names, np.repeat(np.arange(len(names)), [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    logs, letters = model.score(pa.array([r["text"] or "" for r in rows]))
    p = np.exp(logs - logs.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    own = np.where((letters >= least_letters)[:, None], p, 0.0)
    base = (own.sum(0) + 1) / (own.sum() + len(names))
    out = {}
    for i, r in enumerate(rows):

        def others(test, i=i):
            return sum((own[k] for k, x in enumerate(rows) if k != i and test(x)), np.zeros(len(names)))

        def smooth(n, parent):
            return (n + language.PRIOR_ROWS * parent) / (n.sum() + language.PRIOR_ROWS)

        fused = p[i] * base
        if h := r["source"]:
            dots = h.split(".")
            parent = smooth(others(lambda x: x["source"] and x["source"].split(".")[-2:] == dots[-2:] and "." in x["source"]), base) if len(dots) > 1 else base  # noqa: B023
            fused = p[i] * smooth(others(lambda x: x["source"] == h), parent)  # noqa: B023
        if r["lang"]:
            fused = fused * smooth(others(lambda x: x["lang"] == r["lang"]), base) / base  # noqa: B023
        best = fused.max() / fused.sum()
        accepted = letters[i] >= least_letters and best >= least_probability
        out[r["doc_id"]] = (names[fused.argmax()] if accepted else "und", best if letters[i] >= least_letters else 0.0, bool(accepted))
    return out


def test_language_against_twin(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    r = np.random.default_rng(8)
    words = {"en": "the and of with from this that house water", "de": "der und mit von dieses haus wasser nicht auch", "it": "il della con questo casa acqua non anche per"}
    rows = []
    for i in range(90):
        mine = list(words)[i % 3]
        text = " ".join(r.choice(words[mine].split(), r.integers(1, 30)))
        rows.append((i, [text, "12 34 %%", None, text + " \u00e9" * 3][0 if i % 9 else i // 9 % 4], [mine, None, "en"][i % 4 % 3], [f"a{i % 3}.x.org", "b.x.org", "local", "other", None][i % 5]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("host", "logs", "own", "language", "_h")})
    got = {x["id"]: (x["language"], x["probability"], x["accepted"]) for x in language.of_documents(df.repartition(3)).collect()}
    want = fused_twin([dict(zip(("doc_id", "text", "lang", "source"), x, strict=True)) for x in rows])
    assert set(got) == set(want)
    for i, x in want.items():
        assert got[i][0] == x[0] and got[i][2] == x[2] and got[i][1] == pytest.approx(x[1], abs=1e-5), i


def test_language_edges(spark):
    schema = "page_id long, url string, html string"
    long = "<p>" + "this is the house of water and of stones " * 20_000
    rows = [(1, "http://a.org/", f"<html lang=en>{long}"), (1, "http://a.org/", "<html lang=en>the house"), (None, None, None), (2, "no address", ""), (3, "http://\u00e4.de/x", "&#116;&#104;&#101; &#104;ouse")]
    got = sorted((x["id"] or 0, x["accepted"], x["language"]) for x in language.of_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, False, "und"), (1, True, "en"), (1, True, "en"), (2, False, "und"), (3, True, "en")]
    assert language.of_pages(spark.createDataFrame([], schema)).count() == 0


def test_dedup_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    long = "word " * 200_000
    rows = [(None, "a b"), (1, "ab"), (None, "c  c"), (2, "cc"), (-(1 << 63), "ab"), (5, long), (3, long + " "), (None, "alone"), (None, "xy"), (None, "x y"), (None, "x y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("hash", "n", "g_n", "best", "chars")})
    got = sorted(exact_dedup.groups(frame.repartition(3)).select("doc_id", "keep_id", "group_size", "kept").collect(), key=repr)
    least = -(1 << 63)
    want = [(None, None, 3, True), (1, None, 3, False), (least, None, 3, False), (None, None, 2, True), (2, None, 2, False), (5, 3, 2, False), (3, 3, 2, True), (None, None, 1, True), *[(None, None, 3, True)] * 3]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_warc_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    long = "\u00fc\U0001f600" * 300_000
    rows = [(4, "u", long), (2, "v", long), (2, "w", "other"), (2, None, "other"), (9, "x", "other"), (None, "y", "other"), (7, "z", ""), (8, "z", None), *[(20 + i, "q", "same") for i in range(8)]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("sha1", "size", "of", "n")})
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(frame.repartition(3)).collect())
    n = len(long.encode())
    want = [(4, n, "revisit", 2), (2, n, "response", None), (2, 5, "response", None), (2, 5, "response", None), (9, 5, "revisit", 2), (None, 5, "response", None), (7, 0, "response", None), (8, 0, "revisit", 7), (20, 4, "response", None), *[(20 + i, 4, "revisit", 20) for i in range(1, 8)]]
    assert got == Counter(want)


def test_toxicity_edges(spark):
    rows = [(i, ("awful trash " if i % 2 else "kind words ") * 3) for i in range(60)] + [(1, "awful trash"), (1, "awful trash"), (None, None), (70, "awful trash " * 100_000), (71, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("label", "toxic", "score", "held_out")})
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(frame.repartition(3), marks).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) <= 2 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] == 70} == {1} and not [r for r in got if r["doc_id"] is None][0]["held_out"]


def draw(key, node, xxhash):
    """The tree's descent by the definition: at each node the child with the least -ln(u) / weight."""
    while node.children:
        if len(node.children) > 1:
            draws = [-np.log(((xxhash(key, c.name) % (1 << 64) >> 11) + 0.5) / (1 << 53)) / c.weight for c in node.children]
            node = node.children[int(np.argmin(draws))]
        else:
            node = node.children[0]
    return node.shard


def test_shards_against_the_definition(spark):
    ids = [*range(300), None]
    frame = spark.createDataFrame([(i, "t" * ((i or 0) % 7)) for i in ids], "doc_id long, text string")
    now, grown = sharding.tree(8), sharding.tree(9)
    names = set()

    def walk(node):
        names.add(node.name)
        for c in node.children:
            walk(c)

    walk(now)
    walk(grown)
    hashes = {(r["k"], n): r[n] for r in spark.createDataFrame([(i,) for i in ids], "k long").select("k", *(F.xxhash64("k", F.lit(n)).alias(n) for n in names)).collect() for n in names}
    got = sharding.assign(frame).collect()
    assert len(got) == len(ids)
    for r in got:
        assert r["shard"] == draw(r["doc_id"], now, lambda k, n: hashes[k, n]) and r["grown_shard"] == draw(r["doc_id"], grown, lambda k, n: hashes[k, n])
