import random

import corpus_pipeline
from equireach.llm import language, ngram_join


def test_every_declared_language_competes(spark):
    r = random.Random(3)
    codes = [a + b for a in "abcdefgh" for b in "vwxyz"]
    words = {c: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 8))) for _ in range(30)] for c in codes}

    def text(c, n=25):
        return " ".join(r.choices(words[c], k=n))

    # the first codes have 30 rows, the last ones 4; declarations that are no code stand oftener than those
    rows = [(text(c), c if i % 2 else f"{c.upper()}-XY") for k, c in enumerate(codes) for i in range(30 if k < 35 else 4)]
    rows += [(text(codes[0]), bad) for bad in ("unknown", "x", "e1", "und", "") for _ in range(40)]
    wanted = [lang[:2].lower() if lang[:2].lower() in words and lang != "und" else codes[0] for _, lang in rows]
    rows += [(text(c), None) for c in codes]
    wanted += codes
    docs = spark.createDataFrame([(i, t, lang, None) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {x["id"]: x for x in language.of_documents(docs.repartition(3)).collect()}
    assert [got[i]["language"] for i in range(len(rows))] == wanted
    assert all(x["accepted"] for x in got.values())


def test_rare_language_is_in_the_sample(spark):
    en, xx = "the quick brown fox jumps over the lazy dog ", "zarmo veltik prusna gholi dresmu tavenka "
    rows = [(i, en * 3, "en", None) for i in range(400)] + [(1000 + i, xx * 3, "xx", None) for i in range(2)] + [(2000, xx * 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["id"]: x["language"] for x in language.of_documents(docs, sample_rows=20).collect()}
    assert got[2000] == got[1000] == got[1001] == "xx" and got[5] == "en"


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def linked(spark, rows):
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr)


def test_null_ids_link(spark):
    other = LONG.upper()[::-1]
    rows = [(None, LONG + " seventeen"), (None, other), (None, other), (None, None), (8, LONG), (5, LONG), (9, "alone in this row by itself")]
    assert linked(spark, rows) == sorted([(None, 13, 5), (8, 12, 5), (5, 12, 5), (None, 12, None), (None, 12, None), (None, 0, None), (9, 2, 9)], key=repr)
    assert linked(spark, [(None, LONG), (None, LONG)]) == [(None, 12, None)] * 2


def stage(spark, name, rows, sf="/root/testdata/sf0.001"):
    docs = spark.createDataFrame([(i, t, "en", "a.example") for i, t in rows], "doc_id long, text string, lang string, source string")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.repartition(3), sf)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_pipeline_decides_rows_with_null_ids(spark):
    item = max((r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()), key=len)
    assert stage(spark, "language ID", [(None, "%%% 123"), (None, LONG), (3, LONG)]) == sorted([(None, LONG), (3, LONG)], key=repr)
    assert stage(spark, "exact dedup", [(None, LONG), (None, LONG), (None, "x y"), (None, "x y"), (7, LONG)]) == sorted([(7, LONG), (None, "x y")], key=repr)
    near = LONG + " seventeen"
    assert stage(spark, "n-gram Jaccard join", [(None, near), (None, "x y"), (7, LONG)]) == sorted([(7, LONG), (None, "x y")], key=repr)
    assert stage(spark, "benchmark decontamination", [(None, item), (None, LONG), (7, LONG)]) == sorted([(None, LONG), (7, LONG)], key=repr)


def test_pipeline_decides_rows_that_share_an_id(spark):
    item = max((r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()), key=len)
    near = LONG + " seventeen"
    assert stage(spark, "language ID", [(3, "%%% 123"), (3, LONG)]) == [(3, LONG)]
    assert stage(spark, "exact dedup", [(4, LONG), (4, LONG), (4, "x y"), (3, "x y"), (2, "z")]) == [(2, "z"), (3, "x y"), (4, LONG)]
    assert stage(spark, "n-gram Jaccard join", [(7, near), (7, "x y"), (5, LONG)]) == [(5, LONG), (7, "x y")]
    assert stage(spark, "benchmark decontamination", [(7, item), (7, LONG)]) == [(7, LONG)]
