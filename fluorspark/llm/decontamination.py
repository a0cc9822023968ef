"""Benchmark passages in documents, found by one Aho-Corasick automaton over the normalised test items.

A-Z become a-z and words are the runs of digits, a-z and everything beyond ASCII. An item's windows are its
runs of 10 words; an item of fewer words, but not none, is one window. Windows are written as bytes with one blank
before, between and after their words, so that a match begins and ends with whole words, and the automaton reads a
document, written the same way, once, chunk by chunk. Matches give word ranges, which are mapped to code points of
the original text.

The windows reach the tasks in shards of at most ``SHARD_BYTES`` of window text, one broadcast and one reading of the documents for each
shard, so that neither driver nor worker holds an automaton that grows with the benchmark. Test sets of some hundred
items are one shard. What several shards find is put together by the texts' digests.

Defined results: null texts have no words; documents with null ids are reported as any other; repeated rows are reported each; items with
null ids, null texts or no words take no part; an item that repeats counts once; an id with several texts has the windows of all;
an empty benchmark leaves every document clean; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, long_ids, slices

WINDOW = 10
SHARD_BYTES = 2_000_000
CHUNK = 1 << 20
#: Bytes after normalisation: A-Z in lower case, everything of ASCII that is neither letter nor digit a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPANS = "array<struct<first_word:long,n_words:long,start:long,end:long>>"
_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "n_words", "start", "end")]))


def normalised(raw: bytes) -> bytes:
    """The words of UTF-8 text, each with one blank before it, and a last blank."""
    words = raw.translate(_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def windows_of(text: str | None, width: int = WINDOW) -> set[bytes]:
    words = normalised((text or "").encode("utf-8", "surrogatepass")).split()
    if not words:
        return set()
    n = min(width, len(words))
    return {b" " + b" ".join(words[k : k + n]) + b" " for k in range(len(words) - n + 1)}


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``pattern`` (bytes), ``item`` (the id as text) and ``size``: every window of every item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(p, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in sorted(windows_of(t, width))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], names=["pattern", "item"])

    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "pattern binary, item string").distinct().withColumn("size", F.length("pattern"))


def shards(found: DataFrame, size: int | None = None) -> Iterator[list[tuple[bytes, str]]]:
    """The windows and their items in lists of at most about ``size`` bytes.

    Windows are dealt by their hash to as many shards as their bytes ask for, one shard at a time on the driver; a window's items stay together
    unless they alone are more than a shard, and are then dealt by item.
    """
    size = size or SHARD_BYTES
    found = cut(found)
    whole = found.agg(F.coalesce(F.sum(F.col("size") + F.length("item")), F.lit(0))).first()[0]
    n = -(-whole // (size // 2 + 1))  # half full on average, as hashes spread unevenly
    if n <= 1:
        if whole:
            yield [(bytes(r["pattern"]), r["item"]) for r in found.select("pattern", "item").collect()]
        return
    dealt = cut(found.withColumn("shard", F.pmod(F.xxhash64("pattern", "item"), F.lit(n))).repartition("shard"))
    for k in range(n):
        part = [(bytes(r["pattern"]), r["item"]) for r in dealt.where(F.col("shard") == k).select("pattern", "item").collect()]
        if part:
            yield part


class Automaton:
    """The automaton of one shard: patterns as text of one character a byte, values their numbers."""

    def __init__(self, shard: list[tuple[bytes, str]]) -> None:
        self.items: list[list[str]] = []
        numbers: dict[bytes, int] = {}
        for pattern, item in shard:
            k = numbers.setdefault(pattern, len(numbers))
            if k == len(self.items):
                self.items.append([])
            self.items[k].append(item)
        self.sizes = np.array([len(p) for p in numbers])
        self.words = np.array([p.count(b" ") - 1 for p in numbers])
        self.found = ahocorasick.Automaton()
        for pattern, k in numbers.items():
            self.found.add_word(pattern.decode("latin-1"), k)
        self.found.make_automaton()

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Last places and numbers of all matches in normalised text; the state passes from chunk to chunk."""
        at: list[int] = []
        which: list[int] = []
        search = None
        if not self.items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin in range(0, len(text), CHUNK):
            part = text[begin : begin + CHUNK].decode("latin-1")
            if search is None:
                search = self.found.iter(part)
            else:
                search.set(part)
            for end, k in search:  # places count on through the chunks
                at.append(end)
                which.append(k)
        return np.array(at, dtype=np.int64), np.array(which, dtype=np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges put together where they meet or overlap, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > ends[:-1]]
    return starts[first], ends[np.r_[first[1:], True]]


def places(raw: bytes, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which the word ranges begin and end in the original text."""
    data = np.frombuffer(raw.translate(_BYTES), dtype=np.uint8)
    inside = np.r_[False, data != 32, False]
    begins, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return points[begins[first]], points[ends[past - 1]]


def examine(text: str | None, automaton: Automaton) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
    """Number of words, hit ranges (first word, words, start, end) and the items found."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = normalised(raw)
    n_words = plain.count(b" ") - 1
    at, which = automaton.scan(plain) if n_words else (np.zeros(0, np.int64),) * 2
    if not len(at):
        return n_words, [], []
    # a blank stands before each word: the last blank of a match follows as many words as blanks precede it
    blanks = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
    past = np.searchsorted(blanks, at)
    first, past = merged(past - automaton.words[which], past)
    start, end = places(raw, first, past)
    items = {i for k in np.unique(which) for i in automaton.items[k]}
    return n_words, [tuple(map(int, s)) for s in zip(first, past - first, start, end, strict=True)], sorted(items)


def _scan(docs: DataFrame, shard: list[tuple[bytes, str]], all_documents: bool) -> DataFrame:
    """What one shard finds: ``key``, the columns before it, ``n_words``, ``spans`` and ``items``; of all documents or of those with hits."""
    sent = docs.sparkSession.sparkContext.broadcast(shard)
    names = [n for n in docs.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value)
        for batch in slices(batches, 100):
            found = [examine(t, automaton) for t in batch.column("text").to_pylist()]
            if not all_documents:
                rows = [k for k, f in enumerate(found) if f[1]]
                batch, found = batch.take(pa.array(rows, pa.int64())), [found[k] for k in rows]
            new = [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([[dict(zip(("first_word", "n_words", "start", "end"), s, strict=True)) for s in f[1]] for f in found], _SPAN),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, "n_words", "spans", "items"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "n_words long", f"spans {_SPANS}", "items array<string>"]))


def _together(found: DataFrame) -> DataFrame:
    """One row a text of what the shards after the first found in it: ranges and items without repeats."""
    spans = found.select("key", F.explode("spans").alias("s")).select("key", "s.*").distinct()
    items = found.select("key", F.explode("items").alias("i")).distinct()
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words", "start", "end"))).alias("more_spans")).join(items.groupBy("key").agg(F.collect_list("i").alias("more_items")), "key")


def _union(spans: Column) -> Column:
    """Sorted ranges put together where they meet or overlap."""

    def past(s: Column) -> Column:
        return s["first_word"] + s["n_words"]

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        longer = F.struct(last["first_word"].alias("first_word"), (F.greatest(past(last), past(s)) - last["first_word"]).alias("n_words"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = (F.size(a) == 0) | (s["first_word"] > past(last))
        return F.when(apart, F.concat(a, F.array(s))).otherwise(F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(F.array_sort(spans), F.expr(f"CAST(array() AS {_SPANS})"), step)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row a document: ``doc_id``, ``n_words``, ``spans`` (hit ranges in words and in code points of the text) and ``items`` (ids as text, sorted)."""
    docs = long_ids(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    parts = shards(windows(items, width))
    first = next(parts, [])
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text")
    out, rest = None, None
    for shard in parts:
        more = cut(_scan(keyed.select("key", "text"), shard, False).drop("n_words"))
        rest = more if rest is None else rest.unionByName(more)
    if rest is None:
        return _scan(docs, first, True)
    out = _scan(keyed, first, True).join(_together(rest), "key", "left")
    spans = F.when(F.col("more_spans").isNull(), F.col("spans")).otherwise(_union(F.concat("spans", F.coalesce("more_spans", F.expr(f"CAST(array() AS {_SPANS})")))))
    ids = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.expr("CAST(array() AS array<string>)")))))
    return out.select("doc_id", "n_words", spans.alias("spans"), ids.alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The figures of ``contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return digest(contamination(docs, items))


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM item_words WHERE len(w) > 0)
), grams AS (
  SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT r, p, g.k, item_id FROM grams g JOIN windows USING (k, s)
), hit_words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
