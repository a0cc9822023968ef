"""Product codes of vectors by Yinyang Lloyd rounds in whole numbers.

Vectors become whole numbers, floor(256 * x), cut into equal consecutive parts; each part position has a codebook of its
own. The entries of a codebook are clustered into groups. A vector keeps, for each part, its entry, an upper bound of the
distance to it and for each group one lower bound of the distance to the group's other entries. When entries move,
the upper bound grows by the entry's drift and a group's lower bound shrinks by the group's greatest drift; only groups
whose bound does not exceed the upper bound are scanned. Bounds are rounded outwards and a group is passed
over only if its bound is truly greater, so that equal distances, which are compared as whole numbers, go to the lower index.

State is one row a vector, cut to the shared folder after each round together with the tasks' sums of their vectors by entry; Spark
adds up the sums by (part, entry, component). Only ids and vectors of the first entries and the summed codebooks, whose size does not depend on the
table, come to the driver.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, as are vectors of another length than that of
the smallest kept id, which must be a positive multiple of the number of parts (else no row is kept); rows with null ids are
coded but give no entries; of rows that share an id the smallest vector gives the entry; repeated rows count and come out each; fewer ids than entries make smaller codebooks; if
all ids are null there is none and the result is empty; components beyond 2**60 are clipped to it and errors beyond 2**63 - 1 to that;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

SCALE = 256.0
LARGEST = 2.0**60
#: Entries for each group of a codebook, about.
GROUP_SIZE = 8
#: Rows a task works on at once.
ROWS = 4096
#: Labels whose sums are sent to every task; beyond that the rows are joined by label, dealt out.
MOST_LABELS = 100_000
SALTS = 64
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """``entries`` (parts, entries, width) in whole numbers, each entry's group, and how far entries have moved in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray


def whole(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``v``, the vector as whole numbers, beside ``vec_id`` and ``label``; unusable rows go."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    limited = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(SCALE) * x.cast("double")))))
    return rows.where(v.isNotNull() & finite).select("vec_id", "label", limited.alias("v"))


def first_entries(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the ``entries`` smallest ids, ascending, as (rows, components); a bounded number of rows."""
    named = vectors.where("vec_id IS NOT NULL")
    smallest = named.orderBy("vec_id", "v").limit(1).select(F.size("v")).collect()
    if not smallest or not smallest[0][0]:
        return np.zeros((0, 0), dtype=np.int64)
    named = named.where(F.size("v") == smallest[0][0])
    ids = [r[0] for r in named.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    found = dict(tuple(r) for r in named.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v")).collect())
    return np.array([found[i] for i in ids], dtype=np.int64)


def grouped(entries: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Each entry's group, by a few Lloyd rounds over the entries of each codebook; any grouping gives the same codes."""
    parts, n, _ = entries.shape
    k = max(1, -(-n // GROUP_SIZE))
    out = np.zeros((parts, n), dtype=np.int64)
    for p in range(parts):
        x = entries[p].astype(np.float64)
        centres = x[np.linspace(0, n - 1, k).astype(int)]
        for _ in range(rounds):
            out[p] = np.square(x[:, None] - centres[None]).sum(axis=2).argmin(axis=1)
            centres = np.array([x[out[p] == g].mean(axis=0) if (out[p] == g).any() else centres[g] for g in range(k)])
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``: as doubles where they hold them, else as Python numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None] - 2 * (a @ b.T)
    a, b = x.astype(object), c.astype(object)
    return np.square(a[:, None] - b[None]).sum(axis=2)


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the same rows of ``c``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:
        return np.square(x.astype(np.float64) - c.astype(np.float64)).sum(axis=1)
    return np.square(x.astype(object) - c.astype(object)).sum(axis=1)


def _below(squares: np.ndarray) -> np.ndarray:
    """Roots, rounded down far enough for single precision."""
    return (np.sqrt(squares.astype(np.float64)) * (1 - 1e-6)).astype(np.float32)


def first_codes(x: np.ndarray, book: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, their squared distances and the groups' lower bounds, from all distances."""
    d = distances(x, book)
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    best = d[rows, code]
    d[rows, code] = float("inf")
    lower = np.stack([d[:, groups == g].min(axis=1, initial=float("inf")) for g in range(groups.max(initial=0) + 1)], axis=1)
    return code, best, _below(lower)


def next_codes(x: np.ndarray, book: np.ndarray, groups: np.ndarray, drift: np.ndarray, code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What ``first_codes`` gives after the entries moved by ``drift``, from the codes and bounds before; last, how many distances were taken."""
    best = own_distances(x, book[code])
    upper = np.sqrt(best.astype(np.float64)) * (1 + 1e-6)
    step = np.array([drift[groups == g].max(initial=0.0) for g in range(lower.shape[1])]) * (1 + 1e-6)
    lower = (lower.astype(np.float64) * (1 - 1e-6) - step[None]).astype(np.float32)
    old, old_best = code, best
    code, best, taken = code.copy(), best.copy(), len(x)
    second = np.zeros(len(x), dtype=np.float32)
    for g in range(lower.shape[1]):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(lower[:, g] <= upper)
        if not len(members) or not len(rows):
            continue
        d = distances(x[rows], book[members])
        taken += d.size
        d[members[None] == old[rows][:, None]] = float("inf")  # the entry before stands apart, with its own distance
        near = d.argmin(axis=1)
        at = d[np.arange(len(rows)), near]
        nearer = (at < best[rows]) | ((at == best[rows]) & (members[near] < code[rows]))
        lower[rows, g] = _below(at)
        won = rows[nearer]
        best[won], code[won] = at[nearer], members[near][nearer]
        d[nearer, near[nearer]] = float("inf")
        second[won] = _below(d[nearer].min(axis=1))
        upper[won] = np.sqrt(best[won].astype(np.float64)) * (1 + 1e-6)
    # bounds leave the entry itself out: the one taken goes, the one given up comes back
    changed = np.flatnonzero(code != old)
    lower[changed, groups[code[changed]]] = second[changed]
    lower[changed, groups[old[changed]]] = np.minimum(lower[changed, groups[old[changed]]], _below(old_best[changed]))
    return code, best, lower, taken


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column whose values are the rows of a matrix."""
    data = np.ascontiguousarray(rows).tobytes()
    size = len(data) // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(data)])


def _sums(x: np.ndarray, codes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the vectors' parts to the sums of their entries; whole numbers of any size."""
    parts, entries, width = sums.shape
    cut_up = x.reshape(len(x), parts, width)
    for p in range(parts):
        counts[p] += np.bincount(codes[:, p], minlength=entries)
        if np.abs(cut_up[:, p]).max(initial=0) * len(x) < 1 << 53:
            for j in range(width):
                sums[p, :, j] += np.bincount(codes[:, p], weights=cut_up[:, p, j].astype(np.float64), minlength=entries).astype(np.int64).astype(object)
        else:
            np.add.at(sums[p], codes[:, p], cut_up[:, p].astype(object))


def assigned(state: DataFrame, books: Codebooks, kinds: str) -> DataFrame:
    """One round: rows with new ``codes``, ``bounds`` and ``error``, then a task's sums as rows with ``sums``."""
    parts, entries, width = books.entries.shape
    n_groups = int(books.groups.max(initial=0)) + 1
    begun = "codes" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, like = np.zeros(books.entries.shape, dtype=object), np.zeros((parts, entries), dtype=np.int64), None
        for batch in slices(batches, ROWS):
            like = batch
            if begun:
                x = _matrix(batch.column("v"), np.int64, parts * width)
                codes, bounds = _matrix(batch.column("codes"), np.uint16, parts).astype(np.int64), _matrix(batch.column("bounds"), np.float32, parts * n_groups).reshape(-1, parts, n_groups).copy()
            else:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts * width)
                codes, bounds = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts, n_groups), dtype=np.float32)
            error = np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                if begun:
                    codes[:, p], best, bounds[:, p], _ = next_codes(part, books.entries[p], books.groups[p], books.drift[p], codes[:, p], bounds[:, p])
                else:
                    codes[:, p], best, bounds[:, p] = first_codes(part, books.entries[p], books.groups[p])
                error = error + (best.astype(np.int64) if best.dtype == np.float64 else best)  # Python numbers make the sum such
            _sums(x, codes, sums, counts)
            columns = [batch.column("vec_id"), batch.column("label"), _fixed(x), _fixed(codes.astype(np.uint16)), _fixed(bounds.reshape(len(x), -1))]
            columns += [pa.array(error if error.dtype == np.int64 else [min(e, _MOST) for e in error], pa.int64()), pa.nulls(len(x), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "codes", "bounds", "error", "sums"])
        if like is not None:
            numbers = [str(n) for n in np.concatenate([sums, counts[:, :, None].astype(object)], axis=2).ravel()]
            columns = [pa.nulls(1, like.schema.field(n).type) for n in ("vec_id", "label")] + [pa.nulls(1, pa.binary())] * 3 + [pa.nulls(1, pa.int64()), pa.array([numbers], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "codes", "bounds", "error", "sums"])

    return state.mapInArrow(run, f"{kinds}, v binary, codes binary, bounds binary, error long, sums array<string>")


def moved(books: Codebooks, state: DataFrame) -> Codebooks:
    """The entries at the floor of their parts' means; an entry without parts stays. Spark adds up the tasks' sums."""
    parts, entries, width = books.entries.shape
    numbers = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n"))
    total = np.zeros(parts * entries * (width + 1), dtype=object)
    for at, n in numbers.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # as many rows as the codebooks have numbers
        total[at] = int(n)
    total = total.reshape(parts, entries, width + 1)
    new = books.entries.copy()
    used = (total[:, :, width] > 0).astype(bool)
    new[used] = (total[used][:, :width] // total[used][:, width:]).astype(np.int64)
    step = (new.astype(object) - books.entries.astype(object)).astype(np.float64)
    return Codebooks(new, books.groups, np.sqrt(np.square(step).sum(axis=2)) * (1 + 1e-9))


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding") -> tuple[DataFrame, Codebooks] | None:
    """The coded rows (``vec_id``, ``label``, ``codes``, ``error`` and the bounds) and the codebooks after ``rounds`` rounds; none without usable rows."""
    vectors = whole(rows, vector)
    first = first_entries(vectors, entries)
    dim = first.shape[1]
    if not len(first) or not dim or dim % parts:
        return None
    vectors = vectors.where(F.size("v") == dim)
    kinds = ", ".join(f"`{n}` {t}" for n, t in vectors.select("vec_id", "label").dtypes)
    start = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    books = Codebooks(start, grouped(start), np.zeros(start.shape[:2]))
    state = vectors
    for k in range(rounds + 1):
        state = cut(assigned(state, books, kinds))
        if k < rounds:
            books = moved(books, state)
            state = state.where("sums IS NULL").drop("sums")
    return state.where("sums IS NULL").drop("sums"), books


def book_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def by_label(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy(F.col("label").alias("_l")).agg(total.alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("_l"))
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_l")
    # a label may hold a large share of all rows: its rows are dealt out, its sum is copied to each share
    dealt = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_t", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt.hint("merge"), same & (F.col("_t") == F.col("_s"))).drop("_l", "_s", "_t")


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding") -> DataFrame:
    """One row a kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256. At most 256 entries."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    made = train(rows, parts, entries, rounds, vector)
    if made is None:
        empty = rows.where(F.lit(False))
        return empty.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded, books = made
    # codes are 16-bit little-endian numbers below 256: of their hex digits the first two of every four
    code = F.lower(F.regexp_replace(F.hex("codes"), "(..)..", "$1"))
    return by_label(coded.select("vec_id", "label", "codes", code.alias("code"), "error")).select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id`` and ``approx``, the vector that a row's codes stand for, in the scale of the input."""
    entries = F.lit([[[float(x) / SCALE for x in e] for e in part] for part in books.entries.tolist()])
    parts = books.entries.shape[0]
    number = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.element_at(F.element_at(entries, p + 1), F.conv(F.hex(F.substring("codes", F.lit(1) + 2 * p, F.lit(1))), 16, 10).cast("int") + 1))
    return coded.select("vec_id", F.flatten(number).alias("approx"))


def _sql() -> str:
    parts = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, vec_id, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM kept, (SELECT unnest(range(16)) AS p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a, b, c, d FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
)"""
    near = """, near{k} AS MATERIALIZED (
  SELECT r, p, e, q FROM (
    SELECT x.r, x.p, y.e, (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2 AS q FROM cut x JOIN book{k} y USING (p)
  ) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY q, e) = 1
)"""
    book = """, book{n} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(m.a, o.a) AS a, coalesce(m.b, o.b) AS b, coalesce(m.c, o.c) AS c, coalesce(m.d, o.d) AS d FROM book{k} o LEFT JOIN (
    SELECT p, e, CAST(floor(avg(a)) AS BIGINT) AS a, CAST(floor(avg(b)) AS BIGINT) AS b, CAST(floor(avg(c)) AS BIGINT) AS c, CAST(floor(avg(d)) AS BIGINT) AS d
    FROM near{k} JOIN cut USING (r, p) GROUP BY p, e
  ) m USING (p, e)
)"""
    last = """, coded AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(q) AS BIGINT) AS error FROM near2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CONCAT_WS(',', a, b, c, d), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
    return parts + near.format(k=0) + book.format(k=0, n=1) + near.format(k=1) + book.format(k=1, n=2) + near.format(k=2) + last


ORACLE_SQL = _sql()
