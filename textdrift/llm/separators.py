"""Operator 5, token counts by separator scans of flat token files.

``write_token_files`` writes documents as flat files of big-endian unsigned 16-bit token ids, each
document ended by ``EOD``; the files hold no index. ``scan_token_files`` counts the tokens of
every document in such files: a file is looked at in blocks of ``BLOCK`` tokens, numpy searches
each block for the end-of-document ids, and each block reports the tokens before its first end,
between its ends, and after its last. A prefix scan over the blocks of a file (Spark windows over
these small reports) stitches the documents that cross blocks, and numbers them.

``EOD`` lies outside the vocabulary, and its two bytes are one UTF-8 character, so that Spark's
text writer can set it as the line separator: the files are written and committed by Spark on any
file system, without a shuffle. A second file of the same name lists the doc_ids of a token file
in order. A file is read as one binary row; the writer closes it after ``FILE_SLICES`` slices of
documents, and a file over Spark's limit for binary rows raises an error.

Defined results: a null or empty text has 0 tokens; tokens after a file's last end count as a
last, unfinished document; an empty file has none; repeated rows are counted each for itself;
a file of an odd number of bytes raises an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textdrift.llm import tokens, words as W
from textdrift.session import ensure_checkpoint_dir

EOD = 0xC280
BLOCK = 1 << 16
FILE_SLICES = 8


def _ending(eod: int) -> str:
    """The end id as the character whose UTF-8 bytes it has."""
    return eod.to_bytes(2, "big").decode()


def write_token_files(documents: DataFrame, path: str, tokenizer: str | None = None, eod: int = EOD,
                      slice_bytes: int = tokens.SLICE_BYTES, file_slices: int = FILE_SLICES) -> None:
    """Write flat token files under ``path``/kind=tokens and the doc_ids of each of them, in the
    order of its documents, under ``path``/kind=owners with the same file name."""
    name = tokenizer or tokens.default_tokenizer()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(name)
        if len(encoder.closes) > eod:
            raise ValueError(f"the vocabulary has the end-of-document id {eod}")
        number = 0
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for a, b in W.slices(data, offsets, slice_bytes):
                flat, counts = encoder.encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                # the writer ends each row, so only the ends between documents are set here
                ids = np.insert(flat, np.cumsum(counts)[:-1], eod).astype(">u2").tobytes()
                owners = ",".join("" if i is None else str(i) for i in batch.column(0)[a:b].to_pylist()).encode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["tokens", "owners"]), pa.array([number] * 2, pa.int64()), pa.array([ids, owners])],
                    names=["kind", "number", "value"])
                number += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "kind string, number long, value binary")
    (rows.sortWithinPartitions("kind", "number").select("kind", F.col("value").cast("string"))
     .write.partitionBy("kind").option("lineSep", _ending(eod)).option("maxRecordsPerFile", file_slices).text(path))


def block_reports(spark: SparkSession, path: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """file, block, ends (number of end ids), before (tokens before the first, or all of them),
    after (tokens after the last), inner (lengths of the documents within the block)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % 2:
                    raise ValueError(f"{file}: an odd number of bytes, {len(raw)}")
                ids = raw.view(">u2")
                ends = np.flatnonzero(ids == eod)
                starts = np.arange(0, len(ids), block)
                sizes = np.minimum(len(ids) - starts, block)
                cut = np.searchsorted(ends, np.append(starts, len(ids)))
                rows = []
                for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
                    own = ends[cut[k]:cut[k + 1]] - start
                    rows.append((len(own), int(own[0]) if len(own) else size,
                                 size - 1 - int(own[-1]) if len(own) else 0, (np.diff(own) - 1).tolist()))
                count, before, after, inner = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()),
                     pa.array(count, pa.int64()), pa.array(before, pa.int64()), pa.array(after, pa.int64()),
                     pa.array(inner, pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "before", "after", "inner"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(
        task, "file string, block long, ends long, before long, after long, inner array<long>")


def scan_token_files(spark: SparkSession, path: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """file, place (number of the document in its file, from 0) and n_tokens of every document."""
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    reports = block_reports(spark, path, eod, block).withColumn("run", F.coalesce(F.sum("ends").over(past), F.lit(0)))
    # blocks that no end precedes since ``run`` ends: they share a run, and carry their tokens on
    within = Window.partitionBy("file", "run").orderBy("block")
    length = F.when(F.col("ends") == 0, F.col("before")).otherwise(F.lit(0))
    reports = reports.withColumn("carried", F.coalesce(F.sum(length).over(within.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "opened", F.coalesce(F.lag(F.when(F.col("ends") > 0, F.col("after"))).over(order), F.lit(0))).withColumn(
        "opened", F.max("opened").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    closed = reports.where("ends > 0").select(
        "file", F.posexplode(F.concat(F.array(F.col("before") + F.col("carried") + F.col("opened")), "inner")), "run")
    last = reports.groupBy("file").agg(
        F.sum("ends").alias("place"), F.max_by(F.when(F.col("ends") > 0, F.col("after")).otherwise(
            F.col("before") + F.col("carried") + F.col("opened")), "block").alias("n_tokens")).where("n_tokens > 0")
    return closed.select("file", (F.col("run") + F.col("pos")).alias("place"), F.col("col").alias("n_tokens")).union(
        last.select("file", "place", "n_tokens"))


def file_owners(spark: SparkSession, path: str, eod: int = EOD) -> DataFrame:
    """file, place and doc_id of every document of the token files, from the lists beside them."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lists = content.decode().split(_ending(eod))[:-1]
                ids = [int(i) if i else None for one in lists for i in one.split(",")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()),
                     pa.array(ids, pa.int64())], names=["file", "place", "doc_id"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(task, "file string, place long, doc_id long")


def _name(file: str):
    return F.element_at(F.split(F.col(file), "/"), -1).alias("name")


def token_counts(documents: DataFrame, tokenizer: str | None = None, block: int = BLOCK,
                 slice_bytes: int = tokens.SLICE_BYTES, file_slices: int = FILE_SLICES) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files written for it."""
    spark = documents.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents, path, tokenizer, slice_bytes=slice_bytes, file_slices=file_slices)
    if not documents.limit(1).count():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    counted = scan_token_files(spark, f"{path}/kind=tokens", block=block)
    owners = file_owners(spark, f"{path}/kind=owners")
    return owners.select(_name("file"), "place", "doc_id").join(
        counted.select(_name("file"), "place", "n_tokens"), ["name", "place"]).select("doc_id", "n_tokens")
