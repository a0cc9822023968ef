"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A store keeps two exact tables, the postings (which document holds which line) and the
reference counts summed from them, so documents can be inserted and deleted and every
decision undone, and a third table with a cuckoo filter of the frequent keys for each shard.
Inserting and deleting documents edits the filters of the shards in which a key became
frequent or ceased to be; a filter that is full is built anew, larger, from the counts.
Postings meet their shard's filter in a co-grouped shuffle, those of a busy shard in several parts,
each with a copy of the filter; what the filters let through is confirmed against the counts.

Defined results: a null or empty text is one empty line; rows with a null id keep all lines
and are not counted; rows that share an id are one document and count once; ties cannot occur,
as the largest id keeps its lines in every row; other columns are ignored; an empty table
gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fields, numbered, restored, slices, texts_of, with_new

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Frequent keys of a shard, the most shards (beyond them shards grow), and postings that meet one copy of a filter.
SHARD_KEYS, MOST_SHARDS, PART_ROWS = 1 << 16, 1 << 20, 1 << 18
_U = np.uint64


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of a line without blanks at its ends and with A-Z lower-cased; None for a short line."""
    core = line.strip(BLANK)
    return xxhash.xxh3_128_digest(core.encode("utf-8", "surrogatepass").lower()) if len(core) >= min_chars else None


def _halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; keys are 64-bit hashes. Supports insertion and deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int) -> None:
        self.n_buckets = 1 << max(1, int(np.ceil(capacity / self.SLOTS / 0.84)) - 1).bit_length()
        self.table = np.zeros((self.n_buckets, self.SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all ``keys``, larger if the first size does not hold them."""
        capacity = max(4, len(keys))
        while True:
            made = cls(capacity)
            if made.insert_all(keys):
                return made
            capacity *= 2

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(raw, dtype="<u2").reshape(-1, cls.SLOTS).copy()
        made.n_buckets = len(made.table)
        return made

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = keys.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15)
        mark = (mixed >> _U(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = (mixed >> _U(8)).astype(np.int64) & (self.n_buckets - 1)
        return mark, first, first ^ self._shift(mark)

    def _shift(self, mark: np.ndarray | int) -> np.ndarray | int:
        return ((mark * 0x5BD1E995) >> 3) & (self.n_buckets - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)

    def insert(self, key: int) -> bool:
        """False if no place was found; the filter is then to be built larger."""
        return self.insert_all(np.array([key]))

    def insert_all(self, keys: np.ndarray) -> bool:
        """Inserts keys one after another; False if one found no place, which leaves the filter without some key."""
        return all(self._put(*at) for at in zip(*(x.tolist() for x in self._places(keys)), strict=True))

    def _put(self, mark: int, a: int, b: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = b
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= int(self._shift(mark))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Removes one copy of the key's fingerprint; only keys that were inserted may be deleted."""
        mark, a, b = (x[0] for x in self._places(np.array([key])))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, high, low: the keys that each document holds, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, keys = [], []
            for text in texts_of(batch):
                own = {key for line in text.split("\n") if (key := line_key(line, min_chars))}
                counts.append(len(own))
                keys += own
            flat = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield with_new(batch, ("doc_id",), {"high": flat[:, 0], "low": flat[:, 1]}, counts)

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, high long, low long").distinct()


def counted(rows: DataFrame) -> DataFrame:
    """The reference counts: high, low, n_docs and the largest document that holds the key."""
    return rows.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


@dataclass
class Store:
    """The exact tables of the documents inserted so far, and the filters of their frequent keys by shard."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> Store:
        held = cut(postings(docs, min_chars))
        return cls._of(held, cut(counted(held)), min_docs)

    @classmethod
    def _of(cls, held: DataFrame, counts: DataFrame, min_docs: int) -> Store:
        n = counts.where(F.col("n_docs") >= min_docs).count()
        shards = min(MOST_SHARDS, max(1, -(-n // SHARD_KEYS)))
        made = cls(held, counts, held.limit(0), shards, min_docs)
        made.filters = cut(made._built(made.frequent()))
        return made

    def insert(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> Store:
        """The store with more documents; what a document holds already is not counted twice."""
        new = cut(postings(docs, min_chars).join(self.postings, ["doc_id", "high", "low"], "left_anti"))
        counts = cut(self.counts.unionByName(counted(new)).groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")))
        return self._edited(cut(self.postings.unionByName(new)), counts, new.select("high", "low").distinct())

    def delete(self, doc_ids: DataFrame) -> Store:
        """The store without some documents: counts of the keys they held are made anew from the postings."""
        ids = doc_ids.select("doc_id").distinct()
        gone = cut(self.postings.join(ids, "doc_id", "left_semi").select("high", "low").distinct())
        rest = cut(self.postings.join(ids, "doc_id", "left_anti"))
        same = self.counts.join(gone, ["high", "low"], "left_anti")
        return self._edited(rest, cut(same.unionByName(counted(rest.join(gone, ["high", "low"], "left_semi")))), gone)

    def _edited(self, held: DataFrame, counts: DataFrame, touched: DataFrame) -> Store:
        """The store with new tables, in which only the ``touched`` keys' counts differ; filters are edited."""
        known = lambda rows, name: rows.where(F.col("n_docs") >= self.min_docs).select("high", "low", F.lit(True).alias(name))
        turned = touched.join(known(self.counts, "was"), ["high", "low"], "left").join(known(counts, "is"), ["high", "low"], "left")
        turned = turned.select("high", "low", F.col("is").isNotNull().alias("add")).where(F.col("was").isNotNull() != F.col("is").isNotNull())
        keys = cut(turned.select(self._shard(), "low", "add"))
        if counts.where(F.col("n_docs") >= self.min_docs).count() > 2 * SHARD_KEYS * self.shards and self.shards < MOST_SHARDS:
            return Store._of(held, counts, self.min_docs)
        made = Store(held, counts, self.filters, self.shards, self.min_docs)

        def edit(filters: pa.Table, keys: pa.Table) -> pa.Table:
            shard = (filters if filters.num_rows else keys).column("shard")[0].as_py()
            table = CuckooFilter.load(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter(4)
            low, add = keys.column("low").to_numpy(), keys.column("add").to_numpy(zero_copy_only=False)
            whole = all([table.delete(int(k)) for k in low[~add]]) and table.insert_all(low[add])
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([table.dump() if whole else None], pa.binary())})

        out = cut(self.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(edit, "shard int, filter binary"))
        full = out.where("filter IS NULL").select("shard")
        if not full.isEmpty():
            again = made._built(made.frequent().join(full, made._shard() == full["shard"], "left_semi"))
            out = cut(out.where("filter IS NOT NULL").unionByName(again))
        made.filters = out
        return made

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _shard(self) -> Column:
        return F.pmod("high", F.lit(self.shards)).cast("int").alias("shard")

    def _built(self, keys: DataFrame) -> DataFrame:
        """A cuckoo filter of the keys for each shard that has any: shard, filter."""

        def build(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:  # a shard holds about SHARD_KEYS keys
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.of(rows.column("low").to_numpy()).dump()], pa.binary())})

        return keys.select(self._shard(), "low").groupBy("shard").applyInArrow(build, "shard int, filter binary")

    def surplus(self, held: DataFrame | None = None) -> DataFrame:
        """doc_id, high, low of the lines to drop: frequent keys outside their largest document."""
        held = self._let_through(self.postings if held is None else held)
        return held.join(self.frequent().select("high", "low", "last_doc"), ["high", "low"]).where("doc_id != last_doc").select("doc_id", "high", "low")

    def _let_through(self, held: DataFrame) -> DataFrame:
        """The postings that pass their shard's filter.

        A shard's postings are dealt to parts of about PART_ROWS rows by document, so a key that most documents
        hold fills several parts. The numbers of parts are at most MOST_SHARDS pairs of integers: they are broadcast.
        """
        load = self.counts.groupBy(self._shard()).agg(F.ceil(F.sum("n_docs") / PART_ROWS).cast("int").alias("parts"))
        load = load.join(self.filters.select("shard"), "shard", "left_semi")
        dealt = held.withColumn("shard", self._shard()).join(F.broadcast(load), "shard")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).select("doc_id", "high", "low", "shard", "part")
        copies = self.filters.join(F.broadcast(load), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter")

        def probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
            rows = rows.select(["doc_id", "high", "low"])
            if not filters.num_rows or not rows.num_rows:
                return rows.slice(0, 0)
            return rows.filter(pa.array(CuckooFilter.load(filters.column("filter")[0].as_py()).contains(rows.column("low").to_numpy())))

        return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, held.select("doc_id", "high", "low").schema)


def kept_text(text: str, gone: set[bytes], min_chars: int = MIN_CHARS) -> tuple[int, int, str]:
    """Lines before, lines dropped and the rest of one text."""
    lines = text.split("\n")
    rest = [x for x in lines if not ((key := line_key(x, min_chars)) and key in gone)] if gone else lines
    return len(lines), len(lines) - len(rest), text if len(rest) == len(lines) else "\n".join(rest)


def _applied(docs: DataFrame, surplus: DataFrame, columns: tuple[str, ...], schema: str, new, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maps every document with the keys it is to lose."""
    gone = surplus.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("high", "low")).alias("_gone"))
    rows = docs.join(gone, docs[doc_id] == gone["_id"], "left").select(*columns, F.coalesce(docs[text], F.lit("")).alias("_text"), F.col("_gone.high").alias("_high"), F.col("_gone.low").alias("_low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for value, high, low in zip(*(texts_of(batch, c) for c in ("_text", "_high", "_low")), strict=True):
                keys = {h.to_bytes(8, "little", signed=True) + x.to_bytes(8, "little", signed=True) for h, x in zip(high or (), low or (), strict=True)}
                found.append(kept_text(value, keys))
            yield with_new(batch, columns, new(found))

    return rows.mapInArrow(run, schema)


def line_report(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    store = store or Store.build(docs)

    def new(found: list[tuple[int, int, str]]) -> dict:
        return {"n_lines": pa.array([x[0] for x in found], pa.int64()), "n_dropped": pa.array([x[1] for x in found], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in found], pa.string())}

    kind = dict(docs.dtypes)["doc_id"]
    return _applied(docs.select("doc_id", "text"), store.surplus(), ("doc_id",), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string", new)


def without_repeats(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """The documents with their surplus lines gone and ``n_chars``, if there is one, made anew."""
    store = store or Store.build(docs)
    rows, names = numbered(docs)
    text = names["text"]
    kept = tuple(c for c in rows.columns if c != text)
    out = _applied(rows, store.surplus(), kept, f"{fields(rows, *kept)}, {text} string", lambda found: {text: pa.array([x[2] for x in found], pa.string())}, names["doc_id"], text)
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return restored(out, names)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line, translate(trim(s[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT l.*, f.k IS NOT NULL AND doc_id <> last_doc AS gone FROM l LEFT JOIN f ON l.k = f.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
