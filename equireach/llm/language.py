"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language are multiplied: the likelihood of its byte trigrams, the language that
its markup declares, the suffix of its address, and its host. The trigram model has every declared language and is
fitted on a bounded sample of each one's rows, counted on the executors. How far declarations and suffixes are to be believed, and the share of each language on a
host, come from grouped aggregation over all rows but the one at hand; a host's shares are smoothed by those of its domain,
and these by those of all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equireach.llm.common import BATCH_ROWS, Scratch, join_counted, parts
from equireach.llm.tokens import slices

BITS = 16
#: Trigrams overlap and repeat: a text counts as so many independent ones at most.
EVIDENCE = 60.0
#: Rows' worth of the parent's shares in a host's and a domain's.
PRIOR_ROWS = 20.0
#: Scores, of a row for a language, that a task holds at once.
SCORES = 1 << 21
#: Rows of each language that the model is fitted on, however many languages share sample_rows.
LEAST_ROWS = 50
#: Codes that the standards have for texts in no, several or unknown languages.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
COUNTS = "declared string, row int, n long"
TEXT_ONLY = "id long, host string, domain string, suffix string, declared string, letters double, logs array<double>"
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint64)
_LETTER = np.array([b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the model for each byte trigram, where each text's begin, letters and non-space bytes of each text)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends -= ends[0]
    n, first = len(raw), _FOLD[raw]
    second, third = np.append(first[1:], np.uint64(0))[:n], np.append(first[2:], np.zeros(2, np.uint64))[:n]
    for after, back in ((second, 1), (third, 1), (third, 2)):  # nothing follows a text's end
        after[(at := ends[1:] - back)[at >= 0]] = 0
    rows = ((first * np.uint64(0x9E3779B1) + second * np.uint64(0x85EBCA77) + third * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask[raw]))[ends])

    return rows.astype(np.int64), ends, total(_LETTER), total(~_SPACE)


def letter_share(texts: pa.Array) -> np.ndarray:
    """The share of letters among each text's non-space bytes."""
    parts_of = [letters / np.maximum(solid, 1) for _, _, letters, solid in map(trigrams, slices(texts))]
    return np.concatenate(parts_of) if parts_of else np.empty(0)


class Model:
    """Log-probabilities of trigrams for each language."""

    def __init__(self, languages: list[str], language: np.ndarray, row: np.ndarray, n: np.ndarray):
        """language (an index), row and n: counts of the sample's trigrams."""
        self.languages = languages
        self.logs = np.empty((len(languages), 1 << BITS), np.float32)
        order = np.argsort(language, kind="stable")
        ends = np.searchsorted(language[order], np.arange(len(languages) + 1))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            counts = np.bincount(row[order[a:b]], n[order[a:b]], 1 << BITS) + 0.05
            self.logs[i] = np.log(counts / counts.sum())

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods by language, of at most EVIDENCE trigrams; the share of letters among non-space bytes)."""
        logs, share = [], []
        for part in slices(texts):
            rows, ends, letters, solid = trigrams(part)
            n = np.maximum(np.diff(ends), 1)
            sums = np.stack([np.diff(np.append(0.0, np.cumsum(one[rows], dtype=np.float64))[ends]) for one in self.logs], 1)
            logs.append(sums / n[:, None] * np.minimum(n, EVIDENCE)[:, None])
            share.append(letters / np.maximum(solid, 1))
        return (np.concatenate(logs), np.concatenate(share)) if logs else (np.empty((0, len(self.languages))), np.empty(0))


def markup_language(html: Column) -> Column:
    """The language that an html element declares, without its region; null if none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def code(declared: Column) -> Column:
    """The language of a declaration, in lower case and without region or script; null where that is no code of two or
    three letters, the only ones that standards have, or names no single language."""
    found = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when((found != "") & ~found.isin(*NO_LANGUAGE), found)


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


_HIDDEN = re.compile(r"(script|style)\b", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def visible(html: str | None) -> str:
    """A page's text: without comments, tags, scripts and styles, a space for each, entities decoded; null is empty.

    Of a comment, script or style that is never closed only the tag goes; a < without > after it is text. Each end is
    looked for once, so the time is in proportion to the page, whatever is left open.
    """
    if not html:
        return ""
    out, at, ended = [], 0, set()

    def end_of(kind: str, start: int) -> int:
        """Where what ends at the next end of this kind is over; -1 if there is none."""
        if kind in ended:
            return -1
        if kind in _CLOSING:
            found = _CLOSING[kind].search(html, start)
            stop = found.end() if found else -1
        else:
            stop = html.find(kind, start)
            stop += len(kind) if stop >= 0 else 0
        if stop < 0:
            ended.add(kind)
        return stop

    while (tag := html.find("<", at)) >= 0:
        out.append(html[at:tag])
        stop = end_of("-->", tag + 4) if html.startswith("<!--", tag) else -1
        if stop < 0 and (hidden := _HIDDEN.match(html, tag + 1)):
            stop = end_of(hidden[1].lower(), tag)
        if stop < 0:
            stop = end_of(">", tag)
        if stop < 0:
            at = tag
            break
        out.append(" ")
        at = stop
    out.append(html[at:])
    return unescape("".join(out))


def identify(rows: DataFrame, id_col: str, text_col: str, declared: Column | None = None, url: Column | None = None, host_of: Column | None = None, markup: bool = False, sample_rows: int = 3000, least_letters: float = 0.4, least_probability: float = 0.5) -> DataFrame:
    """One row per row of rows: (id, language, probability, letters, accepted).

    Evidence that is null or whose column is not given says nothing. A text is rejected when too few of its non-space
    bytes are letters (so null, empty and blank ones are) or no language reaches least_probability; its language is
    then `und`. Every language that a row with text declares competes; declarations that are no code say nothing. The
    model is fitted on about sample_rows rows, shared equally by the languages but at least LEAST_ROWS each, those with
    the smallest hashes of id and text; a language with fewer gives all. If no row declares one, there is nothing to tell
    languages by: texts with enough letters are accepted as `und` with probability 0. Of languages alike probable the
    first by name is taken. Rows that repeat an id are each decided by their own text and evidence; whole texts count,
    whatever their length; other columns are not read; an empty table gives an empty result.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "language")
    none = F.lit(None).cast("string")
    url_host = host(url) if url is not None else none
    where = F.coalesce(F.lower(host_of) if host_of is not None else none, url_host)
    known = rows.select(
        F.col(id_col).cast("long").alias("id"),
        where.alias("host"),
        F.when(where.contains("."), F.regexp_extract(where, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        F.when(url_host.contains("."), F.regexp_extract(url_host, r"\.([^.]+)$", 1)).alias("suffix"),
        code(declared if declared is not None else none).alias("declared"),
        F.col(text_col).cast("string").alias("text"),
    )
    strip = visible if markup else (lambda t: t or "")
    languages, counted = _sample(known, strip, sample_rows)
    sent = spark.sparkContext.broadcast(Model(languages, *counted)) if languages else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, max(1, min(BATCH_ROWS, SCORES // max(1, len(languages))))):
            texts = pa.array([strip(t) for t in batch.column(5).to_pylist()], pa.string()) if markup else batch.column(5).fill_null("")
            logs, letters = sent.value.score(texts) if sent else (np.zeros((len(batch), 0)), letter_share(texts))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, max(1, logs.shape[1]), dtype=np.int32) if logs.shape[1] else np.zeros(len(batch) + 1, np.int32)), pa.array(logs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(letters, pa.float64()), listed], ["id", "host", "domain", "suffix", "declared", "letters", "logs"])

    scored = scratch.table(known.mapInArrow(score, TEXT_ONLY), "scored")
    if not languages:
        return scored.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("probability"), "letters", (F.col("letters") >= least_letters).alias("accepted"))
    return _fuse(scored, languages, least_letters, least_probability, scratch)


def _sample(known: DataFrame, strip, sample_rows: int) -> tuple[list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The declared languages that have trigrams, sorted, and the trigrams' counts (language, row, n) over each one's sample.

    A row is drawn by its hash against its language's share, so no task sees all rows of a language. What comes to
    the driver is a count for each trigram and language, however long the texts.
    """
    nothing = [], (np.empty(0, np.int64),) * 3
    full = known.where("declared IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = full.groupBy("declared").count().collect()
    if not sizes:
        return nothing
    each = max(LEAST_ROWS, sample_rows // len(sizes))
    span = float(1 << 64)
    limits = known.sparkSession.createDataFrame([(r["declared"], min(1.0, each / r["count"]) * span - span / 2) for r in sizes], "c_declared string, most double")
    at = F.xxhash64("id", "text").cast("double")
    chosen = full.join(F.broadcast(limits), (F.col("declared") == F.col("c_declared")) & (at <= F.col("most"))).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = pa.array([strip(t) for t in batch.column(1).to_pylist()], pa.string())
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                for part in slices(texts.filter(pa.array(names == name))):
                    row, n = np.unique(trigrams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(row), pa.string()), pa.array(row, pa.int32()), pa.array(n, pa.int64())], ["declared", "row", "n"])

    got = chosen.mapInArrow(count, COUNTS).groupBy("declared", "row").agg(F.sum("n").alias("n")).toArrow()
    if not len(got):
        return nothing
    names = got.column("declared").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    place = {x: i for i, x in enumerate(languages)}
    index = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    return languages, (index, got.column("row").to_numpy().astype(np.int64), got.column("n").to_numpy())


def _fuse(scored: DataFrame, languages: list[str], least_letters: float, least_probability: float, scratch: Scratch) -> DataFrame:
    """Posterior of each row from its text, declaration, suffix and host; arrays over languages, whatever their number.

    What a row's host, domain, declaration and suffix say is counted over the other rows: its own part is taken off.
    """
    top = F.array_max("logs")
    odds = F.transform("logs", lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    # the text's own posterior by language; rows without letters say nothing
    rows = scored.withColumn("p", F.transform(odds, lambda x: x / total)).withColumn("known", F.col("letters") >= least_letters)
    rows = rows.withColumn("own", F.transform("p", lambda x: F.when(F.col("known"), x).otherwise(0.0)))

    def sums(*keys: str) -> DataFrame:
        """(keys, i, n, size): the posteriors' sums by language, and how many rows."""
        there = rows.where(F.col(keys[0]).isNotNull()) if keys else rows
        return there.select(*keys, F.posexplode("own").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("n"), F.count(F.lit(1)).alias("size"))

    def arrays(long: DataFrame, name: str, *keys: str) -> DataFrame:
        return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("_l"), F.max("size").alias(f"{name}_size")).select(*keys, F.col("_l.n").alias(name), f"{name}_size")

    weight, n_rows = np.zeros(len(languages)), 0
    for r in sums().collect():
        weight[r["i"]], n_rows = r["n"] or 0.0, max(n_rows, r["size"])
    base_of = F.array(*(F.lit(b) for b in ((weight + 1.0) / (weight.sum() + len(languages))).tolist()))

    def smooth(counts: Column, parent: Column) -> Column:
        """Shares from the counts but this row's own, and PRIOR_ROWS of the parent's."""
        others = F.zip_with(counts, "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(others, parent, lambda x, y: (x + PRIOR_ROWS * y) / (size + PRIOR_ROWS))

    by_host = scratch.table(sums("host", "domain"), "by_host")
    hosts = scratch.table(arrays(by_host, "of_host", "host", "domain"), "hosts")
    n_hosts = hosts.count()
    domains = arrays(by_host.where("domain IS NOT NULL").groupBy("domain", "i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size")), "of_domain", "domain")
    host_table = join_counted(hosts, domains, ["domain"], "of_domain_size", n_hosts, "left").select("host", "of_host", "of_host_size", "of_domain")
    said = F.broadcast(arrays(sums("declared"), "of_declared", "declared").drop("of_declared_size"))  # codes of two or three letters
    suffixes = arrays(sums("suffix"), "of_suffix", "suffix")
    out = join_counted(rows, host_table, ["host"], "of_host_size", n_rows, "left").join(said, "declared", "left")
    out = join_counted(out, suffixes, ["suffix"], "of_suffix_size", n_rows, "left")

    def times(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x * y)

    def believed(counts: str) -> Column:
        """P(value | language) up to a factor of the value: P(language | value) / P(language), smoothed to 1."""
        one = F.array(*(F.lit(1.0) for _ in languages))
        return F.when(F.col(counts).isNull(), one).otherwise(F.zip_with(smooth(F.col(counts), base_of), base_of, lambda x, b: x / b))

    domain_share = F.when(F.col("of_domain").isNull(), base_of).otherwise(smooth(F.col("of_domain"), base_of))
    host_share = F.when(F.col("of_host").isNull(), base_of).otherwise(smooth(F.col("of_host"), domain_share))
    fused = times(times(times(F.col("p"), host_share), believed("of_declared")), believed("of_suffix"))
    out = out.select("id", "letters", "known", fused.alias("fused"))
    norm = F.aggregate("fused", F.lit(0.0), lambda a, x: a + x)
    best = F.array_max("fused") / norm
    name = F.array(*(F.lit(x) for x in languages))[F.array_position("fused", F.array_max("fused")).cast("int") - 1]
    accepted = F.col("known") & (best >= least_probability)
    return out.select("id", F.when(accepted, name).otherwise("und").alias("language"), F.when(F.col("known"), best).otherwise(0.0).alias("probability"), "letters", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def of_pages(pages: DataFrame, **limits) -> DataFrame:
    """identify() for web pages: text without markup, the html element's language, the address."""
    return identify(pages, "page_id", "html", declared=markup_language(F.col("html")), url=F.col("url"), markup=True, **limits)


def of_documents(docs: DataFrame, **limits) -> DataFrame:
    """identify() for documents: `lang` is the declaration, `source` the host."""
    return identify(docs, "doc_id", "text", declared=F.col("lang"), host_of=F.col("source"), **limits)
