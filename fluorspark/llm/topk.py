"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(64 * x), packed in blocks of the narrowest type.
Every block of queries meets every block of candidates; a pass scores all pairs and counts each
query's scores in 1024 equal bins between its bounds. A task adds up what it counts and sends the bins
from the highest to the one in which it alone reaches the wanted number: the k-th score of all rows
lies no lower. Summed over the tasks, the counts name the bin of the k-th score, which is
refined until it is one score wide. A last pass keeps what lies above, and of the ties at the
k-th score the smallest ids. Only block products meet in a task; no pair of rows is emitted
unless it is among a block's best.

Defined results: vectors that are null or hold null or non-finite components take no part, as
rows with a null id; vectors of other lengths than the query's are no candidates of it; rows
with the query's id are its own and no candidates; of queries that share an id the
one with the smallest vector is answered; a candidate row that repeats counts each time; scores
beyond 2**61 are clipped to it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BINS = 1024
CAND_BLOCK, QUERY_BLOCK = 4096, 512
#: Copies of the queries for each shuffle partition at most; several, so that partitions get about equal shares.
CELLS_A_PARTITION = 4
#: Query blocks whose counts a task holds at once, 4 MB each.
HELD_BLOCKS = 16
MOST = 1 << 61
LEAST = -MOST - 1


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, the integer vector as doubles."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # a component from 2**50 on is a whole number of 64ths, and floor() would leave the longs
    scaled = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < 2.0**50, F.floor(F.lit(64.0) * x.cast("double")).cast("double")).otherwise(F.lit(64.0) * x.cast("double")))
    return rows.where(v.isNotNull() & finite & F.col("vec_id").isNotNull()).select("vec_id", scaled.alias("v"))


def packed_numbers(v: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def unpacked_numbers(data: bytes, rows: int, dim: int) -> np.ndarray:
    """What ``packed_numbers`` packed, as doubles; the type follows from the size."""
    kind = {2: np.int16, 4: np.int32}.get(len(data) // max(1, rows * dim), np.float64)
    return np.frombuffer(data, dtype=kind).reshape(rows, dim).astype(np.float64)


def blocks(rows: DataFrame, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Vectors of equal length packed as bytes, ``size`` rows at most in a block."""
    names = ("vec_id", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            joined = [np.concatenate([p[k] for p in parts]) for k in range(len(names) + 1)]
            columns = [pa.array([x], pa.binary()) for x in (*(n.tobytes() for n in joined[:-1]), packed_numbers(joined[-1]))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns], names=["dim", *names, "data"])

        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy()
            for dim in np.unique(lengths):
                rows_of = pa.array(np.flatnonzero(lengths == dim))
                part = batch.take(rows_of)
                flat = part.column("v").flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((len(part), 0))
                for k in range(0, len(flat), size):
                    held.setdefault(int(dim), []).append([*(part.column(n).to_numpy()[k : k + size] for n in names), flat[k : k + size]])
                    if sum(len(p[0]) for p in held[int(dim)]) >= size:
                        yield packed(int(dim))
        for dim in list(held):
            yield packed(dim)

    return rows.select(*names, "v").mapInArrow(run, "dim int, " + ", ".join(f"{n} binary" for n in names) + ", data binary")


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products, clipped to 2**61."""
    bound = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(1, queries.shape[1])
    if bound < 2.0**53:
        return (queries @ candidates.T).astype(np.int64)
    whole = np.dot(np.vectorize(int, otypes=[object])(queries), np.vectorize(int, otypes=[object])(candidates).T)
    return np.clip(whole, -MOST, MOST).astype(np.int64)


def scored(queries: DataFrame, cands: DataFrame, cells: int, schema: str, use: Callable) -> DataFrame:
    """Runs ``use`` on an iterator of (query ids, lo, hi, need, candidate ids, scores), one item for every pair of blocks that a task gets.

    Query blocks are copied to every cell of candidate blocks: a stated query set against all rows. The merge join spills,
    and packed candidates travel in each pass, not the queries' scores.
    """
    left = queries.select("dim", F.col("vec_id").alias("q_ids"), "lo", "hi", "need", F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    right = cands.select("dim", "vec_id", "data", "cell")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                numbers = [np.frombuffer(row[c], dtype=np.int64) for c in ("q_ids", "lo", "hi", "need", "vec_id")]
                q, c = (unpacked_numbers(row[d], len(n), row["dim"]) for d, n in (("q_data", numbers[0]), ("data", numbers[4])))
                yield *numbers, products(q, c)

    return left.join(right.hint("merge"), ["dim", "cell"]).drop("cell").mapInArrow(lambda batches: use(pairs(batches)), schema)


def _histograms(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Each query's counts by bin over all of a task's candidates, from the highest bin to the one that reaches the wanted number."""
    held: dict[bytes, list[np.ndarray]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for ids, need, counts in held.values():
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            q, at = np.nonzero((counts > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(at), pa.array(counts[q, at])], names=["query_id", "bin", "n"])
        held.clear()

    for ids, lo, hi, need, cand, scores in pairs:
        key = ids.tobytes()
        if key not in held and len(held) >= HELD_BLOCKS:
            yield from sent()
        width = bin_width(lo, hi)[:, None]
        inside = (scores >= lo[:, None]) & (scores <= hi[:, None]) & (cand[None, :] != ids[:, None])
        bins = np.where(inside, (scores - lo[:, None]) // width, 0) + (np.arange(len(ids)) * BINS)[:, None]
        held.setdefault(key, [ids, need, np.zeros((len(ids), BINS), dtype=np.int64)])[2] += np.bincount(bins[inside], minlength=len(ids) * BINS).reshape(-1, BINS)
    yield from sent()


def _winners(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for pair in pairs:
        yield _best(*pair)


def _best(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray, cand: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    other = cand[None, :] != ids[:, None]
    q, c = np.nonzero((scores > lo[:, None]) & other)
    tied_q, tied_c = np.nonzero((scores == lo[:, None]) & other)
    order = np.lexsort((cand[tied_c], tied_q))
    tied_q, tied_c = tied_q[order], tied_c[order]
    place = np.arange(len(tied_q)) - np.searchsorted(tied_q, tied_q)
    few = place < need[tied_q]  # the k best ties of the whole table are among each block's
    q, c = np.r_[q, tied_q[few]], np.r_[c, tied_c[few]]
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(cand[c]), pa.array(scores[q, c])], names=["query_id", "vec_id", "score"])


def bin_width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(hi - lo + 1) // BINS))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query, all if there are fewer."""
    own = usable(queries, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    far, many = usable(rows, vector).agg(F.max(length), F.count("*")).first()
    far = far or 0.0
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, min(CELLS_A_PARTITION * partitions, -(-many // CAND_BLOCK)))
    dealt = blocks(usable(rows, vector), CAND_BLOCK).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int"))
    cands = cut(dealt)
    # no score is farther from 0 than the product of the lengths
    reach = F.least(F.ceil(length * F.lit(far) * (1 + 1e-9) + 1), F.lit(MOST)).cast("long")
    state = cut(own.select("vec_id", "v", (-reach).alias("lo"), reach.alias("hi"), F.lit(k).cast("long").alias("need")))
    while True:
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        open_ = blocks(open_, QUERY_BLOCK, ("lo", "hi", "need"))
        counts = scored(open_, cands, cells, "query_id long, bin long, n long", _histograms).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        reached = counts.withColumn("seen", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))))
        wanted = state.select(F.col("vec_id").alias("query_id"), "need")
        # the first bin, from above, at which the wanted number is reached; none if there are too few
        hit = reached.join(wanted, "query_id").where("seen >= need AND seen - n < need").select(F.col("query_id").alias("vec_id"), "bin", F.expr("seen - n").alias("over"))
        step = state.join(hit, "vec_id", "left").withColumn("width", F.expr(f"greatest(1L, (hi - lo + {BINS}) div {BINS})"))
        state = cut(
            step.select(
                "vec_id",
                "v",
                F.expr(f"CASE WHEN lo = hi THEN lo WHEN bin IS NULL THEN {LEAST} ELSE lo + bin * width END").alias("lo"),
                F.expr(f"CASE WHEN lo = hi THEN hi WHEN bin IS NULL THEN {LEAST} ELSE least(hi, lo + (bin + 1) * width - 1) END").alias("hi"),
                F.expr("need - coalesce(over, 0)").alias("need"),
            )
        )
    best = scored(blocks(state, QUERY_BLOCK, ("lo", "hi", "need")), cands, cells, "query_id long, vec_id long, score long", _winners)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
