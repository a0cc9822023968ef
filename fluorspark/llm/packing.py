"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n, largest
first, with as many pieces of the longest length as fit. Each piece is a training sequence
of its own, so none crosses documents and none needs padding; sequences of equal length
form a bucket and are batched together. Cutting needs no shuffle: buckets are a column,
by which ``write_buckets`` partitions its files.

Defined results: a null or empty text is one token, the separator; ids and rows that repeat
are cut row by row; null ids stay null; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SharedEncoder
from .common import fields, slices, texts_of, with_new

MAX_LENGTH = 2048
SEPARATOR = 1


def lengths(n: int, most: int = MAX_LENGTH) -> np.ndarray:
    """The piece lengths of a document of ``n`` tokens; ``most`` is a power of two."""
    bits = [1 << k for k in range(most.bit_length() - 2, -1, -1)]
    return np.array([most] * (n // most) + [bit for bit in bits if n & bit], dtype=np.int64)


def pack(docs: DataFrame, path: str | None = None, *, most: int = MAX_LENGTH, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document, place and digest, its sequence and its bucket (the length's logarithm).

    ``with_ids`` adds the token ids themselves.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    shared = SharedEncoder(docs.sparkSession, path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    last = np.uint32(separator).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in slices(batches):
            sizes, starts, digests, totals, cuts, tokens = [], [], [], [], [], []
            for ids in encoder.encode_groups(texts_of(batch)):
                raw = memoryview(ids.tobytes() + last)
                own = lengths(len(raw) // 4, most).tolist()
                begin = [0, *itertools.accumulate(own[:-1])]
                sizes += own
                starts += begin
                digests += [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin, own, strict=True)]
                totals += [len(raw) // 4] * len(own)
                cuts.append(len(own))
                if with_ids:
                    tokens += np.split(np.frombuffer(raw, dtype="<i4"), begin[1:])
            if not cuts:
                continue
            length = np.array(sizes, dtype=np.int64)
            new = {"start": np.array(starts, dtype=np.int64), "length": length, "ids_crc32": np.array(digests, dtype=np.int64), "doc_tokens": np.array(totals, dtype=np.int64), "bucket": np.log2(length).astype(np.int32)}
            yield with_new(batch, ("doc_id",), new | ({"ids": tokens} if with_ids else {}), cuts)

    pieces = rows.mapInArrow(run, fields(rows, "doc_id") + ", start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids)
    first = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rest = [c for c in pieces.columns if c not in first]
    return pieces.select(*first, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *rest)


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """The sequences as Parquet, a folder for each length; pieces of a length are one batchable set.

    Rows are dealt out by length and a hash of the sequence first, so a task writes a few large files of one
    length and no length is a single task's.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, parts // 4))))
    dealt.write.partitionBy("bucket").parquet(folder)
