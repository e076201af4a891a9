"""The n-gram Jaccard join: all links between documents whose 5-word shingle sets are alike, as components.

Links come from a blocked product of the document by n-gram incidence with its transpose: overlap counts of pairs of
sets are accumulated over blocks of n-grams, and pairs whose sizes, or counts so far, leave them below the bound are
discarded. What keeps the product sparse:

* Equal sets are one row of the incidence.
* Like sets are grouped in stars: by min-hash keys every set finds the set that most of its kin share keys with, its
  centre. The product of a star's rows with its centre's gives their overlaps and differences; a second product over
  these differences, in blocks, links sets of a star that the centre does not link.
* Across stars the product is taken over prefixes first. Shingles have one order, rare before frequent; two alike sets
  share one of their first n - ceil(t n) + 1. Shingles that only one star has there are dropped; counts over the others
  are accumulated, and pairs that cannot reach the needed overlap dropped. For the pairs left the product over all
  n-grams decides. Centres of large stars go first: stars that they link need no pairs between their other sets.

Pairs that are linked by others need not be formed, so a group of copies costs as its size, not its square. Grouping
and the order of shingles, which comes from a table of counts of fixed size over all documents, decide the speed only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import Scratch, hot_from, join_counted, maybe_among, mix64, partitions_for
from equireach.llm.common import parts as in_parts
from equireach.llm.components import components
from equireach.llm.shingles import sets

KEYS = 8
SKETCH_BITS, SKETCH_PARTS = 20, 16
#: The filter over shared shingles has 2**LEAST_BITS bits at least and 2**MOST_BITS, 32 MB, at most.
LEAST_BITS, MOST_BITS = 20, 28
#: Keys that a set must share with its centre to be compared with it, and the similarity in percent that keeps it there.
VOTES, KIN = 3, 50
#: Sets of a block of the product within a star, and members that meet one copy of their centre's row.
BLOCK = 256
#: Bytes of differences in a block of the product within a star, about.
BLOCK_BYTES = 16_000_000
#: N-grams of a row in one block of the product: a longer row meets its partner in several, dealt by hash.
BLOCK_GRAMS = 1 << 16
#: Bytes of packed prefixes that one task gathers, about.
BUCKET_BYTES = 12_000_000
SIGNED = "doc_id long, n long, s1 long, s2 long, keys array<long>, part int, counts binary"
_KEY_MULTIPLIERS = mix64(np.arange(101, 101 + KEYS, dtype=np.uint64)) | np.uint64(1)


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _marked(more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """What a set has beside its centre, and what it lacks, as elements of one kind."""
    a, b = (np.asarray(x, np.int64).view(np.uint64) for x in (more, less))
    return np.concatenate([a, mix64(b ^ np.uint64(0xA5A5))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the size, two sums and the min-hash keys of its set; last, this task's counts of shingles."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
    for batch in in_parts(batches):
        sizes, flat = [], []
        for h in sets(batch.column(1).fill_null("")):
            sizes.append(len(h))
            flat.append(h)
        if not sizes:
            continue
        size, all_h = np.array(sizes), np.concatenate(flat)
        there = np.flatnonzero(size)
        s1, s2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        keys = np.zeros((len(size), KEYS), np.uint64)
        if len(there):
            at = (np.cumsum(size) - size)[there]
            np.add.at(counts, (all_h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            s1[there], s2[there] = np.add.reduceat(all_h, at), np.add.reduceat(mix64(all_h ^ np.uint64(0x5DEECE66D)), at)
            for k in range(KEYS):
                keys[there, k] = np.minimum.reduceat(all_h * _KEY_MULTIPLIERS[k], at)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * len(size) + 1, KEYS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        none = pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), listed, *none], schema=schema)
    if counts.any():
        parts = [x.tobytes() for x in np.split(counts, SKETCH_PARTS)]
        nothing = pa.nulls(SKETCH_PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing] * 4 + [pa.nulls(SKETCH_PARTS, pa.list_(pa.int64())), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.frombuffer(counts, np.uint64 if len(counts) == 8 << SKETCH_BITS >> 4 else np.uint32)
            total[part] = total.get(part, 0) + c.astype(np.uint64)
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def shingle_counts(signed: DataFrame) -> np.ndarray:
    """How often shingles occur, by the first SKETCH_BITS of their hashes, over all documents."""
    rows = signed.where("part IS NOT NULL").select("part", "counts")
    schema = "part int, counts binary"
    half = rows.repartition(max(1, round(partitions_for(signed) ** 0.5))).mapInArrow(_add_counts, schema)
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint64)
    for r in half.repartition(SKETCH_PARTS, "part").mapInArrow(_add_counts, schema).collect():  # SKETCH_PARTS rows
        out[r["part"]] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(out.reshape(-1), 0xFFFFFFFF).astype(np.uint32)


def _centres(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, centre, n, n_centre) for sets that share a key with others: the centre is the leader of most of its keys'
    groups, and a group's leader is the set whose keys are shared most. Groups are aggregated before they meet their
    rows, and the rows of large ones stay where they are."""
    keyed = scratch.table(reps.select("rep", "n", F.posexplode("keys").alias("k", "key")), "all-keys")
    on, total = ["k", "key"], keyed.count()
    sizes = scratch.table(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key-sizes")
    shared = scratch.table(join_counted(keyed, sizes, on, "size", total), "keyed")
    weight = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    leaders = shared.join(weight, "rep").groupBy(*on).agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), F.col("n").alias("n_centre"))).alias("best"), F.max("size").alias("group"))
    led = join_counted(shared, scratch.table(leaders, "leaders"), on, "group", total)
    votes = led.groupBy("rep", "n", (-F.col("best.minus")).alias("centre")).agg(F.count(F.lit(1)).alias("votes"), F.max("best.weight").alias("weight"), F.max("best.n_centre").alias("n_centre"))
    own = votes.where((F.col("votes") >= VOTES) | (F.col("rep") == F.col("centre")))
    best = own.groupBy("rep", "n").agg(F.max(F.struct("votes", "weight", (-F.col("centre")).alias("minus"), "n_centre")).alias("best"))
    return best.select("rep", (-F.col("best.minus")).alias("centre"), "n", F.col("best.n_centre").alias("n_centre"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The incidence's rows of texts: their distinct shingles."""
    for batch in in_parts(batches):
        found = list(sets(batch.column(1).fill_null("")))
        grams = pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, grams)], ["id", "grams"])


def _needed(n: str, m: str, percent: int) -> Column:
    return F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))


def product(texts: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch, differences: bool = False) -> DataFrame:
    """The pairs (centre, rep, n, n_centre) whose sets are alike to percent, with their overlap: the incidence's rows of
    the reps times those of the centres, its counts added up over blocks of n-grams.

    Pairs whose sizes cannot give it are discarded before. A row travels once for each pair that it is the rep of, and
    once for each BLOCK reps of a centre. differences: also what either set has beside the other, `more` and `less`.
    """
    able = pairs.where((100 * F.col("n") >= percent * F.col("n_centre")) & (100 * F.col("n_centre") >= percent * F.col("n"))).select("centre", "rep", "n", "n_centre")
    able = scratch.table(able, "able")
    sizes = able.groupBy("centre").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.max("n_centre") / BLOCK_GRAMS).cast("int").alias("blocks"))
    dealt = join_counted(able, sizes, ["centre"], "size", able.count())

    def salts() -> Column:
        return F.ceil(F.col("size") / BLOCK).cast("int")

    members = dealt.select("centre", F.pmod(F.xxhash64("rep"), salts()).cast("int").alias("salt"), "rep", "n", "n_centre", "blocks")
    heads = sizes.select(F.col("centre").alias("c_centre"), F.explode(F.sequence(F.lit(0), salts() - 1)).alias("c_salt"), "blocks")

    def incidence(wanted: DataFrame, key: str, ids: DataFrame) -> DataFrame:
        """wanted with the rows of the sets that its key names, a row for each block of n-grams."""
        near = maybe_among(texts.select("doc_id", "text"), "doc_id", ids, ids.columns[0], "wanted").where("wanted").drop("wanted")
        met = wanted.join(near.mapInArrow(_rows, "id long, grams array<long>"), F.col(key) == F.col("id")).drop("id")
        cut = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        of = lambda x: F.shiftright(F.shiftrightunsigned(x, 33) * F.col("blocks"), 31) == F.col("block")
        return cut.withColumn("grams", F.when(F.col("blocks") == 1, F.col("grams")).otherwise(F.filter("grams", of))).drop("blocks")

    a = incidence(members, "rep", able.select("rep").distinct())
    b = incidence(heads, "c_centre", able.select("centre").distinct()).withColumnsRenamed({"grams": "c_grams", "block": "c_block"})
    met = a.join(b, (F.col("centre") == F.col("c_centre")) & (F.col("salt") == F.col("c_salt")) & (F.col("block") == F.col("c_block")))
    one = ["centre", "rep", "n", "n_centre"]
    if differences:
        met = met.select(*one, F.array_except("grams", "c_grams").alias("more"), F.array_except("c_grams", "grams").alias("less"), F.size("grams").alias("size"))
        added = [F.sum(F.col("size") - F.size("more")).alias("overlap"), F.flatten(F.collect_list("more")).alias("more"), F.flatten(F.collect_list("less")).alias("less")]
    else:
        met = met.select(*one, F.size(F.array_intersect("grams", "c_grams")).alias("size"))
        added = [F.sum("size").alias("overlap")]
    return met.groupBy(*one).agg(*added).where(F.col("overlap") >= _needed("n", "n_centre", percent))


def _within(percent: int):
    """Links of one block of a star: the product of its far sets `b` with its sets `a`, over their differences to the centre."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        far, near = rows[rows["far"]], rows[~rows["far"]]
        pieces = [_marked(m, s) for m, s in zip(near["more"], near["less"], strict=True)]
        owner = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        elements = np.concatenate(pieces) if pieces else np.empty(0, np.uint64)
        order = np.argsort(elements, kind="stable")
        elements, owner = elements[order], owner[order]
        n, lost, rep, linked = near["n"].to_numpy(), near["n_centre"].to_numpy() - near["overlap"].to_numpy(), near["rep"].to_numpy(), near["linked"].to_numpy()
        out = []
        for b in far.itertuples():
            mine = _marked(b.more, b.less)
            lo, hi = np.searchsorted(elements, mine), np.searchsorted(elements, mine, side="right")
            hit = np.flatnonzero(hi > lo)
            common = np.bincount(np.concatenate([owner[lo[i] : hi[i]] for i in hit]), minlength=len(rep)) if len(hit) else np.zeros(len(rep), np.int64)
            overlap = b.overlap - lost + common  # the centre's size less what either lacks, and what both lack or both have besides
            alike = (overlap >= needed(n, np.int64(b.n), percent)) & (rep != b.rep)
            own = rep[alike & ~linked].tolist() + rep[alike & linked][:1].tolist()  # those linked to the centre are one component
            out += [(b.rep, x) for x in own]
        return pd.DataFrame(_spanning(out), columns=["a", "b"], dtype="int64")

    return run


def _spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that keep the components of a block."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    kept = []
    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            kept.append((a, b))
    return kept


def _star_links(compared: DataFrame, percent: int) -> DataFrame:
    """The links within stars beyond those to the centre. Only stars with sets that do not link to it form blocks."""
    held = 8 * F.sum(F.size("more") + F.size("less"))
    stars = compared.groupBy("centre").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(~F.col("linked"), 1)).alias("far"), held.alias("bytes")).where("far > 0 AND all > 1")

    def blocks(n: str) -> Column:  # so many that a block has neither too many sets nor too many bytes
        return F.ceil(F.greatest(F.col(n) / BLOCK, F.col("bytes") * F.col(n) / F.col("all") / BLOCK_BYTES)).cast("int")

    stars = stars.select("centre", "all", blocks("all").alias("a_blocks"), blocks("far").alias("b_blocks"))
    rows = join_counted(compared, stars, ["centre"], "all", compared.count())
    salt = F.xxhash64("rep")
    near = rows.withColumns({"far": F.lit(False), "a": F.pmod(salt, "a_blocks").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1))})
    far = rows.where("NOT linked").withColumns({"far": F.lit(True), "b": F.pmod(salt, "b_blocks").cast("int"), "a": F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))})
    block = near.unionByName(far).select("centre", F.col("a").alias("a_block"), F.col("b").alias("b_block"), "far", "linked", "rep", "n", "n_centre", "overlap", "more", "less")
    return block.groupBy("centre", "a_block", "b_block").applyInPandas(_within(percent), "a long, b long")


def _prefix(h: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order, as many as an alike set must share one of."""
    order = np.argsort(counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return h[order[: len(h) + (-percent * len(h) // 100) + 1]]


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle's bucket, by the upper half of its hash, and below it the lower half: two shingles seldom share a key."""
    low = np.uint64(32)
    return (((h >> low) * np.uint64(buckets)) >> low) << low | (h & np.uint64(0xFFFFFFFF))


def _pack_prefixes(sent, percent: int, buckets: int):
    """(bucket, lower halves, stars) of the prefixes: each batch has one row for each star and shingle, in order of star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 5000):
            found = [_prefix(h, sent.value, percent) for h in sets(batch.column("text").fill_null(""))]
            if not found:
                continue
            key = _keys(np.concatenate(found), buckets)
            star = np.repeat(batch.column("star").to_numpy(zero_copy_only=False), [len(x) for x in found])
            order = np.lexsort((key, star))
            key, star = key[order], star[order]
            once = np.append(True, (key[1:] != key[:-1]) | (star[1:] != star[:-1]))[: len(key)]
            key, star = key[once], star[once]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, star, bucket = key[order].astype(np.uint32), star[order], bucket[order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
            columns = [pa.array([x.tobytes() for x in np.split(c, at[1:])] if len(c) else [], pa.binary()) for c in (key, star)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *columns], ["bucket", "low", "star"])

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that several stars have in prefixes. Rows come sorted by bucket."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
    for bucket, group in groupby(rows, lambda x: x[0]):
        lows, stars = zip(*((low, star) for _, low, star in group), strict=True)
        low, star = np.frombuffer(b"".join(lows), np.uint32), np.frombuffer(b"".join(stars), np.int64)
        order = np.lexsort((star, low))
        low, star = low[order], star[order]
        several = low[1:][(low[1:] == low[:-1]) & (star[1:] != star[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) + np.unique(several).astype(np.int64))], ["h"])


def _bits(found: DataFrame) -> tuple[int, np.ndarray]:
    """A filter over keys: its power of two of bits, eight a key within the bounds, and its words."""
    power = max(LEAST_BITS, min(MOST_BITS, (8 * found.count()).bit_length()))
    drop = 32 - power
    bits = found.groupBy(F.expr(f"shiftright(h & 4294967295L, {drop + 6})").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftright(h, {drop}) & 63 AS INT)))").alias("bits"))
    out = np.zeros(1 << (power - 6), np.uint64)
    got = bits.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return power, out


ENTRIES = "h long, star long, part_of long, rep long, n long, first boolean"


def _entries(sent, percent: int, buckets: int):
    """The prefixes' entries that pass the filter; first: among those that the smaller of two alike sets must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, (power, bits) = sent.value
        for batch in in_parts(batches):
            out: list[list] = [[] for _ in range(6)]
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("star", "part_of", "doc_id")), strict=True))
            for of, h in zip(ids, sets(batch.column("text").fill_null("")), strict=True):
                p = _keys(_prefix(h, counts, percent), buckets)
                bit = (p & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - power)
                kept = np.flatnonzero(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                if len(kept):
                    most = len(h) - int(needed(np.int64(len(h)), np.int64(len(h)), percent)) + 1
                    for column, x in zip(out, (p[kept].view(np.int64), *(np.full(len(kept), x) for x in (*of, len(h))), kept < most), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "star", "part_of", "rep", "n", "first"])

    return run


def _prefix_product(entry: DataFrame, percent: int) -> DataFrame:
    """Pairs (centre, rep, n, n_centre) of different stars and components that the bounds let pass: the product of the
    prefixes' incidence with its transpose, the rows of a column that many have in blocks."""
    total = entry.count()
    most = hot_from(total)
    hot = entry.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)  # MOST_HOT columns at most
    hot = hot.select(F.col("h").alias("hot_h"), F.ceil(F.col("size") / most).cast("int").alias("hot_blocks"))
    cut = entry.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left").withColumn("blocks", F.coalesce("hot_blocks", F.lit(1))) if total > most else entry.withColumn("blocks", F.lit(1))
    own, all_ = F.pmod(F.xxhash64("rep"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    fields = ["h", "star", "part_of", "rep", "n", "first"]
    a = cut.select(*(F.col(c).alias(f"a_{c}") for c in fields), own.alias("a_row"), all_.alias("a_column"))
    b = cut.select(*(F.col(c).alias(f"b_{c}") for c in fields), all_.alias("b_row"), own.alias("b_column"))
    sized = (100 * F.col("a_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("a_n"))
    apart = (F.col("a_star") != F.col("b_star")) & (F.col("a_part_of") != F.col("b_part_of")) & (F.col("a_rep") < F.col("b_rep"))
    met = a.join(b, (F.col("a_h") == F.col("b_h")) & (F.col("a_row") == F.col("b_row")) & (F.col("a_column") == F.col("b_column")) & sized & apart)
    smaller_first = F.when(F.struct("a_n", "a_rep") < F.struct("b_n", "b_rep"), F.col("a_first")).otherwise(F.col("b_first"))
    counted = met.groupBy("a_rep", "b_rep", "a_n", "b_n").agg(F.count(F.lit(1)).alias("common"), F.max(smaller_first).alias("first"))

    def rest(n: str) -> Column:  # shingles of a set beyond its prefix
        return F.ceil(percent * F.col(n) / 100) - 1

    able = F.col("first") & (F.col("common") + F.greatest(rest("a_n"), rest("b_n")) >= _needed("a_n", "b_n", percent))
    return counted.where(able).select(F.col("a_rep").alias("centre"), F.col("b_rep").alias("rep"), F.col("b_n").alias("n"), F.col("a_n").alias("n_centre"))


def _cross_links(texts: DataFrame, counts: np.ndarray, entries: int, buckets: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) between sets of different stars and components. texts: (doc_id, star, part_of, text) of each set;
    entries: how many their prefixes have, about; buckets of columns, at least. Written; what it reads may go."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(counts)
    buckets = max(buckets, entries * 12 // BUCKET_BYTES + 1)
    packed = texts.mapInArrow(_pack_prefixes(sent, percent, buckets), "bucket int, low binary, star binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = scratch.table(packed.mapInArrow(_shared_keys, "h long"), "shared")
    filtered = context.broadcast((counts, _bits(shared)))
    entry = scratch.table(texts.mapInArrow(_entries(filtered, percent, buckets), ENTRIES), "entries")
    cross = scratch.table(_prefix_product(entry, percent), "cross")
    links = scratch.table(product(texts, cross, percent, scratch).select(F.col("rep").alias("a"), F.col("centre").alias("b")), name)
    sent.destroy()
    filtered.destroy()
    return links


def _named(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int | None]:
    """texts with an id of its own for each row with a null one, above all others, and the highest that was there; those
    rows are written first, as texts are read several times. Without such rows texts as they are, and None."""
    nameless = texts.where("doc_id IS NULL")
    if not nameless.take(1):
        return texts, None
    highest = texts.agg(F.max("doc_id")).first()[0]
    highest = 0 if highest is None else highest
    last = (1 << 63) - 1
    written = scratch.table(nameless.select((F.lit(last) - F.monotonically_increasing_id()).alias("doc_id"), "text"), "nameless")
    if written.agg(F.min("doc_id")).first()[0] <= highest:
        raise ValueError("ids reach so near 2**63 that rows with a null id cannot be told from them")
    return texts.where("doc_id IS NOT NULL").unionByName(written), highest


def link(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id).

    Two texts link when 100 * intersection >= percent * union of their sets of distinct 5-word shingles; component_id is
    the smallest id that links lead to. Null, empty and blank texts have no shingles and link with nothing; a text of
    fewer than five words is one shingle. An id names one text; a row that repeats one has its results. Rows with a
    null id link like others, each by itself; their doc_id stays null, and so is the component_id of a group in which no
    row has an id. An empty table gives an empty result; other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngram-join")
    texts, highest = _named(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    parts = partitions_for(docs)
    signed = scratch.table(texts.mapInArrow(_sign, SIGNED), "signed")
    counts = shingle_counts(signed)
    rows = signed.where("part IS NULL")
    n_rows = rows.count()
    one = ["n", "s1", "s2"]
    reps = scratch.table(rows.where("n > 0").groupBy(*one).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "reps")

    centres = scratch.table(_centres(reps, scratch), "centres")
    scratch.drop("all-keys", "key-sizes", "keyed", "leaders")
    compared = product(texts, centres.where("rep <> centre"), KIN, scratch, differences=True)
    compared = scratch.table(compared.withColumn("linked", F.col("overlap") >= _needed("n", "n_centre", percent)), "compared")
    links = compared.where("linked").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    links = scratch.table(links.unionByName(_star_links(compared, percent)), "star-links")
    parts_of = components(links, scratch, "within")
    of = compared.select("rep", F.col("centre").alias("star")).unionByName(compared.select(F.col("centre").alias("rep"), F.col("centre").alias("star")).distinct())
    stars = scratch.table(of.groupBy("rep").agg(F.min("star").alias("star")).join(parts_of.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "star", F.coalesce("component", "rep").alias("part_of")), "stars")

    prefix = F.sum(F.floor((100 - percent) * F.col("n") / 100) + 1).alias("entries")
    # centres of large stars first: those whose sets would make many pairs
    heads = compared.groupBy(F.col("centre").alias("rep")).agg(F.count(F.lit(1)).alias("sets"), F.max("n_centre").alias("n")).where(F.col("sets") >= BLOCK)
    n_heads = heads.agg(prefix).first()["entries"]
    if n_heads:
        own = maybe_among(texts, "doc_id", heads, "rep", "head").where("head").drop("head").join(stars, F.col("doc_id") == F.col("rep")).where("doc_id = star").drop("rep")
        links = links.unionByName(_cross_links(scratch.table(own, "heads"), counts, int(n_heads), parts, percent, scratch, "head-links"))
        joined = components(links, scratch, "heads-joined").withColumnRenamed("id", "rep")
        stars = scratch.table(stars.join(joined, "rep", "left").select("rep", "star", F.coalesce("component", "part_of").alias("part_of")), "stars-joined")
        scratch.drop("heads")

    # texts that are the only ones of their set and star need no join to be told so
    grouped = reps.join(stars, "rep", "left").where("copies > 1 OR star IS NOT NULL").select(*one, "copies", "rep", F.coalesce("star", "rep").alias("star"), F.coalesce("part_of", "rep").alias("part_of"))
    grouped = scratch.table(grouped, "grouped")
    kin = scratch.table(join_counted(rows.select("doc_id", *one), grouped.select(*one, "copies"), one, "copies", n_rows).select("doc_id"), "kin")
    told = maybe_among(texts, "doc_id", kin, "doc_id", "kin")
    alone = told.where("NOT kin").select("doc_id", F.col("doc_id").alias("star"), F.col("doc_id").alias("part_of"), "text")
    others = reps.select("rep").join(grouped.select("rep", "star", "part_of"), "rep", "left").select("rep", F.coalesce("star", "rep").alias("star"), F.coalesce("part_of", "rep").alias("part_of"))
    met = told.where("kin").select("doc_id", "text")
    starred = alone.unionByName(met.join(others, met["doc_id"] == others["rep"]).select("doc_id", "star", "part_of", "text"))
    entries = reps.agg(prefix).first()["entries"] or 0
    found = components(links.unionByName(_cross_links(starred, counts, int(entries), 2 * parts, percent, scratch, "cross-links")), scratch)

    # sets of one row that link to nothing are their own component; the others' are joined
    of = reps.join(found.select("id", "component"), F.col("rep") == F.col("id"), "left").where("copies > 1 OR component IS NOT NULL")
    of = of.select(*one, "copies", F.coalesce("component", "rep").alias("component"))
    out = join_counted(rows.select("doc_id", *one), of, one, "copies", n_rows, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out if highest is None else out.withColumns({c: F.when(F.col(c) <= highest, F.col(c)) for c in ("doc_id", "component_id")})
