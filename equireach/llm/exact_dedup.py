"""Exact duplicates with DataFrame functions only.

Rows group by the 128-bit hash of their normalised text. Within a group of several rows the bytes themselves are
compared: the smallest text of the group must be its largest. Rows of a hash for which it is not, collisions, group by
their whole bytes. Aggregation combines on the map side, so one text with a third of all rows is a few rows after
that; in the join that carries a group's decision back the rows of large groups stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import Scratch, join_counted, words_for

SPACE = r"[\x20\x09-\x0D]+"


def _best() -> Column:
    """What a group keeps: most code points, then the smallest id, a null one last."""
    return F.min(F.struct((-F.col("chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id")))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.md5) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    A null text counts as empty; empty texts are equal to each other. Of equal texts the one with the most code points
    stays, then the smallest id; a row with a null id stays if no row with one has as many. Rows that repeat an id and
    text, or a null id, count each in group_size and share one decision. Whole texts count, whatever their length. An empty table gives an empty result; other columns are not read. hash_of is the grouping hash.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bare = rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("bare"))
    keys = scratch.table(bare.select("doc_id", "chars", hash_of(F.col("bare")).alias("hash"), F.sha2("bare", 256).alias("text_sha256")), "keys")
    n_rows = keys.count()
    shared = scratch.table(keys.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "shared")

    # the bytes of rows whose hash may be shared, told by a filter sized by their number: smallest and largest of each hash,
    # combined on the map side, are equal unless the hash stands for different texts
    power = words_for(shared.count())
    word, bit = F.shiftrightunsigned(F.xxhash64("hash"), 64 - power), F.expr("shiftleft(1L, CAST(xxhash64(hash) & 63 AS INT))")
    words = shared.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = bare.select(hash_of(F.col("bare")).alias("hash"), "bare")
    met = texts.join(F.broadcast(words), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)
    different = met.groupBy("hash").agg(F.min("bare").alias("low"), F.max("bare").alias("high")).where("low <> high").select("hash")
    collided = scratch.table(different, "collided")
    if not collided.take(1):
        return _decide(keys, ["hash"], n_rows)
    own = keys.join(collided, "hash", "left_anti")
    apart = bare.withColumns({"hash": hash_of(F.col("bare")), "text_sha256": F.sha2("bare", 256)}).join(collided, "hash", "left_semi")
    return _decide(own, ["hash"], n_rows).unionByName(_decide(apart, ["hash", "bare"], n_rows))


def _decide(rows: DataFrame, key: list[str], n_rows: int) -> DataFrame:
    """Each row with its group's size and kept id; only groups of several rows go back by a join."""
    group = rows.groupBy(*key).agg(_best().alias("best"), F.count(F.lit(1)).alias("g_n")).where("g_n > 1")
    met = join_counted(rows, group, key, "g_n", n_rows, "left")
    keep = F.when(F.col("g_n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return met.select("doc_id", keep.alias("keep_id"), F.coalesce("g_n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
