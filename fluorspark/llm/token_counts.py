"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian ids with an end-of-document id after each
document. Files are read as byte blocks in any order; within a block one vectorised comparison
finds the separators. A prefix scan over the blocks' summaries (number of separators, last
separator) then gives each block the ordinal of its first document and where that
document began, however many blocks it spans.

Defined results: an empty file has no documents, two separators in a row hold an empty one,
and ids after a file's last separator are a document that is marked as not ended. A null or
empty text is an empty document; ids that are null or repeat are counted row by row; other
columns are ignored; an empty table gives no file and an empty result. Texts are written whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SharedEncoder
from .common import cut, fields, slices, texts_of, with_new, work_folder

BLOCK_BYTES = 4 << 20
SEPARATOR = 49407


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, *, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Writes a token file for each partition below ``folder``, a store all executors share.

    Returns (file, ordinal, doc_id). A task that runs again writes another file; only files
    named in the returned rows count. In the texts, spellings of the separator are plain text.
    """
    shared = SharedEncoder(docs.sparkSession, path, special=False)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, ordinal = shared.get(), None, 0
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        done = False
        try:
            for batch in slices(batches):
                if out is None:
                    store.create_dir(base)
                    out = store.open_output_stream(f"{base}/{name}")
                for ids in encoder.encode_groups(texts_of(batch)):
                    out.write(np.append(ids, np.uint32(separator)).astype(dtype).tobytes())
                yield with_new(batch, ("doc_id",), {"file": pa.array([name] * batch.num_rows), "ordinal": np.arange(ordinal, ordinal + batch.num_rows)})
                ordinal += batch.num_rows
            done = True
        finally:
            if out is not None:
                out.close()
                if not done:  # an attempt that failed leaves no file behind
                    store.delete_file(f"{base}/{name}")

    return cut(rows.mapInArrow(run, fields(rows, "doc_id") + ", file string, ordinal long"))


def scan(spark: SparkSession, folder: str, *, separator: int = SEPARATOR, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start (ids before it), n_tokens and ended of every document in the token files of ``folder``."""
    width = np.dtype(dtype).itemsize
    step = block_bytes // width
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.floor(F.col("length") / width).alias("total"))
    blocks = files.where("total > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / step))))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in slices(batches):
            ends = []
            for name, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as file:
                    ids = np.frombuffer(file.read_at(step * width, block * step * width), dtype=np.uint8)
                ids = ids[: len(ids) // width * width].view(dtype)
                ends.append(np.flatnonzero(ids == separator) + block * step)
            yield with_new(batch, ("file", "block", "total"), {"ends": pa.array(ends, pa.list_(pa.int64()))})

    found = cut(blocks.mapInArrow(find, "file string, block long, total long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    placed = found.join(carried, ["file", "block"]).select("file", "first", "carry", "ends", F.posexplode("ends").alias("at", "end"))
    previous = F.when(F.col("at") == 0, F.col("carry")).otherwise(F.get("ends", F.col("at") - 1))
    ended = placed.select("file", (F.col("first") + F.col("at")).alias("ordinal"), (previous + 1).alias("start"), (F.col("end") - previous - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = summary.join(files, "file").groupBy("file", "total").agg(F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = totals.where("last < total - 1").select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("total") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and start of every document, read back from the token files they were written to."""
    spark = docs.sparkSession
    folder = work_folder(spark, "tokens")
    named = write_token_files(docs, folder, path)
    if named.isEmpty():
        return named.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("start"))
    return named.join(scan(spark, folder).drop("ended"), ["file", "ordinal"]).select("doc_id", "n_tokens", "start")
