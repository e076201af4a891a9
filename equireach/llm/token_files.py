"""Writing token ids as rANS files in order of document id, and reading them back.

The files go where Spark writes, through its commit protocol: one folder for each range of document ids, in order, and
in it one file of segments (see rans). Spark's text writer puts a given line end after each row; the last byte of a
segment is a zero, and that byte is the line end, so a file holds segments and nothing else. Reading takes whole files
from Spark's binary source. The table of symbol frequencies lies beside the files, as one small table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equireach.llm import rans
from equireach.llm.common import Scratch, partitions_for
from equireach.llm.tokens import encoder

#: Ids of a segment, about: enough for its blocks to code side by side, few enough to hold.
SEGMENT_IDS = 4_000_000
#: The id under which rows with a null one are written, before all others; reading gives null back.
NO_ID = -(1 << 63)
RAW = "part int, number long, before long, n long, doc_ids binary, lengths binary, ids binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _tokenise(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        width = np.dtype("<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4")
        doc_ids: list[int] = []
        held: list[np.ndarray] = []
        n = number = before = 0

        def segment() -> pa.RecordBatch:
            row = {"part": part, "number": number, "before": before, "n": n, "doc_ids": np.array(doc_ids, "<i8").tobytes(), "lengths": np.array([len(x) for x in held], "<u4").tobytes(), "ids": np.concatenate(held).tobytes()}
            return pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3), strict=True)})

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                held.append(np.append(np.frombuffer(ids, "<u4").astype(width), width.type(end_id)))
                n += len(held[-1])
                if n >= SEGMENT_IDS:
                    yield segment()
                    number, before, n, doc_ids, held = number + 1, before + n, 0, [], []
        if held:
            yield segment()

    return run


def _ids(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.uint32)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(_ids(ids, n))
            if len(found) > len(total):
                total = np.append(total, np.zeros(len(found) - len(total), np.int64))
            total[: len(found)] += found
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/part=NNNNNN/*.txt (segments) and path.table (frequencies) for all documents, in ascending id order.

    A null or empty text is its end id alone; rows that repeat are written each, in any order; rows with a null id come
    first, as NO_ID, which is no other row's id (ValueError if it is).
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "token-files")
    own = F.col(id_col).cast("long")
    if docs.where(own == NO_ID).take(1):
        raise ValueError(f"the id {NO_ID} stands for rows without one")
    rows = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions_for(docs), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_tokenise(vocabulary, end_id), RAW).write.option("compression", "zstd").parquet(scratch.path("raw"))
    raw = spark.read.schema(RAW).parquet(scratch.path("raw"))
    # vocabulary-sized and partition-sized: counts of each id, and of the ids in each range of documents
    counts = raw.select("n", "ids").mapInArrow(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    size = max(encoder(vocabulary).size, end_id + 1)
    histogram = np.zeros(size, np.int64)
    histogram[counts["id"]] = counts["n"]
    freq = rans.quantise(histogram)
    totals = raw.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    before = dict(zip(totals["part"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))
    sent = spark.sparkContext.broadcast((freq, before))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, before = sent.value
        table = rans.Table(freq)
        for batch in batches:
            for r in batch.to_pylist():
                segment = rans.encode_segment(_ids(r["ids"], r["n"]), np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<u4"), r["number"], before[r["part"]] + r["before"], table)
                yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "number": pa.array([r["number"]], pa.int64()), "segment": pa.array([segment[:-1]], pa.binary())})

    coded = raw.mapInArrow(encode, "part int, number long, segment binary").sortWithinPartitions("part", "number")
    coded.select(F.format_string("%06d", "part").alias("part"), F.col("segment").cast("string").alias("value")).write.partitionBy("part").option("lineSep", "\0").text(path)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "id long, freq long").coalesce(1).write.parquet(f"{path}.table")
    scratch.close()


def _table(spark: SparkSession, path: str) -> np.ndarray:
    freq = spark.read.parquet(f"{path}.table").toPandas()
    table = np.zeros(int(freq["id"].max()) + 1 if len(freq) else 0, np.uint64)
    table[freq["id"]] = freq["freq"]
    return table


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")


def read_blocks(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    """(start, ids) of every block, decoded apart from its neighbours: blocks are dealt to `tasks` tasks, whatever files
    they come from; start is the number of ids before it."""
    sent = spark.sparkContext.broadcast(_table(spark, path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for segment in rans.segments(content.as_py()):
                    for start, mark, words in rans.blocks(segment):
                        yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "mark": pa.array([mark]), "words": pa.array([words])})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(sent.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids = rans.decode_alone(r["mark"], r["words"], table).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["start"]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], ["start", "ids"])

    return _files(spark, path).mapInArrow(cut, "start long, mark binary, words binary").repartition(tasks).mapInArrow(decode, "start long, ids array<long>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; fails where a checksum does."""
    table = _table(spark, path)
    sent = spark.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(sent.value)
        for batch in batches:
            for content in batch.column(0):
                for segment in rans.segments(content.as_py()):
                    _, before, ids, doc_ids, lengths = rans.decode_segment(segment, table)
                    ends = np.cumsum(lengths, dtype=np.int64)
                    raw, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(before + starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = _files(spark, path).mapInArrow(decode, READ)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to the shared folder and returns what they hold. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write(docs, scratch.path("files"), vocabulary, end_id, id_col, text_col)
    return read(docs.sparkSession, scratch.path("files"))
