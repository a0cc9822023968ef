"""Near-duplicate detection with HyperMinHash sketches.

A document's shingle hashes fall into 128 registers by their first bits; a register keeps the
smallest value as its number of leading zeros (6 bits) and the 10 mantissa bits after the
first one. Empty registers borrow from full ones in a fixed order. Four registers packed in 64 bits
form a band. Within a bucket of equal bands every document is compared with the bucket's
smallest id. Pairs must pass the collision-corrected estimate and are then confirmed on full
shingle sets, so hashing decides only which pairs are looked at: first one pair of each document,
then the pairs that do not lie in one component by then. A bucket that is left in several components is dealt
out as pairs of blocks; blocks of sketches come first, and texts are fetched only of the documents
that have a likely partner in another component. They are fetched from those that a bitmap let
through in one scan: all that share a bucket, and few others. The bitmap has eight bits for each different text, 128 MB at most;
beyond 10^8 different texts more of the others pass, and the results stay the same. Texts
travel, not shingle sets, which are larger than compressed texts. Sketches, bucket members and texts between the steps are Parquet in the shared folder.

A pair at the threshold is lost, unless other documents link it, if it shares no band, with probability
(1 - 0.75**4)**32, about 5 in a million, or if its estimate is more than five standard deviations too low.

Documents with one shingle set are represented by the smallest id; copies are never paired.
Hot buckets and copies meet only in partial aggregates and in joins that Spark can split.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; rows
with a null id are linked with nothing, their component is null and they are kept; rows
that share an id are one document (their classes join); ties go to the smallest id; ids are whole
numbers, others are an error; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, long_ids, numbered, release, restored, slices, stored, texts_of, with_new
from .components import connected_components
from .shingles import links, shingle_set

REGISTERS, BAND = 128, 4
MANTISSA = 10
#: Expected share of registers that agree by chance at 10 mantissa bits (HyperMinHash paper, large sets).
COLLISION = 0.169919487159739093975315012348 / (1 << MANTISSA)
#: The estimate may miss the threshold by as many standard deviations; in small sets, whose registers borrow, those are up to 1.4 times as large.
DEVIATIONS, BORROWED = 5, 0.4
#: Partners that one copy of a document meets; documents and shingles of a block.
SALT_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 64, 2048, 2_000_000
#: Bits of the bitmap of documents that share a bucket: for each node, and the least and most of them (128 MB), powers of two.
BITS_A_NODE, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 30
_U = np.uint64


@functools.cache
def _donors(tries: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(0, REGISTERS, (tries, REGISTERS))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted distinct set of 64-bit hashes."""
    edges = np.arange(REGISTERS, dtype=np.uint64) << _U(57)
    at = np.searchsorted(hashes, edges)
    full = np.diff(np.r_[at, len(hashes)]) > 0
    rest = hashes[np.minimum(at, len(hashes) - 1)] << _U(7)
    zeros = 53 - np.frexp((rest >> _U(11)).astype(np.float64))[1]
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    out = ((zeros.astype(np.uint64) << _U(MANTISSA)) | mantissa).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        for tries in (64, 4096):
            donors = _donors(tries)[:, empty]
            hit = full[donors]
            first = hit.argmax(axis=0)
            found = hit[first, np.arange(len(empty))]
            out[empty[found]] = out[donors[first[found], np.flatnonzero(found)]]
            empty = empty[~found]
            if not len(empty):
                break
        out[empty] = out[np.flatnonzero(full)[0]]
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the size and 128-bit digest of its shingle set, and its bands (four registers in a long)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, high, low, bands = [], [], [], []
            for text in texts_of(batch):
                found = shingle_set(text)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                n.append(len(found))
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                bands.append(sketch(found).view("<i8") if len(found) else None)
            yield with_new(batch, ("doc_id",), {"n_shingles": pa.array(n, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, high long, low long, bands array<long>")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (rows of register matrices) that may reach the threshold, by size and corrected estimate."""
    target, small = percent / 100, np.minimum(n_a, n_b)
    agree = (a == b).mean(axis=1)
    estimate = (agree - COLLISION) / (1 - COLLISION)
    margin = DEVIATIONS * np.sqrt(target * (1 - target) / REGISTERS) * (1 + BORROWED * np.exp(-small / REGISTERS))
    return (100 * small >= percent * np.maximum(n_a, n_b)) & (estimate >= target - margin)


def _registers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view("<u2").reshape(-1, REGISTERS)


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, size) whose sketches agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                ok = likely(_registers(batch.column("bands_a")), _registers(batch.column("bands_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.select(["a", "b", "size"]).filter(pa.array(ok))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(run, "a long, b long, size long")


def bitmap_bits(nodes: int) -> int:
    """The size of the bitmap for so many nodes."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_NODE * nodes - 1).bit_length()))


def shared_texts(docs: DataFrame, members: DataFrame, bits_wanted: int) -> DataFrame:
    """node and text of all documents in ``members``, and of few others: one scan, no shuffle."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("node"), F.lit(bits_wanted))
    # the functions count values from 1
    rows = members.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bitmap = np.zeros(-(-bits_wanted // 8), dtype=np.uint8)
    for r in rows:  # at most MOST_BITS / 32768 of them
        begin = (r["bucket"] - 1) * len(r["bits"])
        bitmap[begin : begin + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: len(bitmap) - begin]
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in slices(batches):
            at = batch.column("_at").to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).select(["node", "_text"])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_at", place)
    return stored(texts.mapInArrow(run, "node long, _text string"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    Each ``a`` is streamed before its ``b``s; the rows of an ``a`` with many partners are
    spread over several groups, each with its own copy of it.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / SALT_ROWS)))
    asked = salted.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("turn")).union(salted.select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("turn")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, dtype=np.uint64)
        for batch in slices(batches):
            out = []
            for a, salt, b, turn, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = shingle_set(text)
                if turn == 0:
                    # an id that repeats with several texts stands for all of them
                    own = [*own, found] if now == (a, salt) else [found]
                    now = (a, salt)
                elif any(links(x, found, percent) for x in own):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = asked.join(texts, "node").select("a", "salt", "node", "turn", "_text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "turn").mapInArrow(run, "a long, b long").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """The rows (with band, key, block, blocks) of every bucket dealt to the pairs of its blocks: block i meets every block j in the cell (min, max)."""
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def _partners(rows: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the rows of a cell, one after another, the later rows of other labels that are likely partners and whose first equal band is the cell's."""
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    regs, n = bands.view("<u2").reshape(len(rows), -1), rows.column("n_shingles").to_numpy()
    label, block = rows.column("label").to_numpy(), rows.column("block").to_numpy()
    band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
    right = np.flatnonzero(block == j)
    for x in np.flatnonzero(block == i):
        y = right[right > x] if i == j else right
        y = y[label[y] != label[x]]
        same = bands[y] == bands[x]
        yield x, y[(same.argmax(axis=1) == band) & same[:, band] & likely(regs[x][None, :], regs[y], n[x], n[y], percent)]


def across(members: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents that share a bucket but no component yet.

    A bucket of several components is dealt out as pairs of blocks of bounded size. A pair is looked
    at in the first band it shares. Blocks of sketches name the documents that have a likely partner; in the same
    cells the full sets of those are compared, and only links that join two components leave the task.
    """
    placed = members.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = cut(placed.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key"))
    # of a bucket of two, the pair has been compared
    rows = placed.where("size > 2").join(mixed, ["band", "key"]).where("node != center")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("band", "key", "block", "blocks", "label", "node")
    cell = ["band", "key", "i", "j"]
    sketched = rows.join(nodes.select("node", "n_shingles", "bands"), "node")

    def hopeful(rows: pa.Table) -> pa.Table:
        seen = np.zeros(len(rows), dtype=bool)
        for x, y in _partners(rows, percent):
            if len(y):
                seen[x] = True
                seen[y] = True
        return rows.filter(pa.array(seen))

    kept = ", ".join(f"{c} {t}" for c, t in _cells(sketched).dtypes)
    hopes = cut(_cells(sketched).groupBy(*cell).applyInArrow(hopeful, kept))
    whole = hopes.join(texts, "node")

    def compare(rows: pa.Table) -> pa.Table:
        # an id that repeats with one text is one row
        texts = rows.column("_text").to_pylist()
        first = sorted({x: k for k, x in reversed(list(enumerate(zip(rows.column("node").to_pylist(), texts, strict=True))))}.values())
        rows, own = rows.take(pa.array(first)), [shingle_set(texts[k]) for k in first]
        label, node = rows.column("label").to_pylist(), rows.column("node").to_numpy()
        root = {x: x for x in label}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, partners in _partners(rows, percent):
            for y in partners.tolist():
                mine, other = find(label[x]), find(label[y])
                if mine != other and links(own[x], own[y], percent):
                    root[max(mine, other)] = min(mine, other)
                    out.append((node[x], node[y]))
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})

    return whole.groupBy(*cell).applyInArrow(compare, "a long, b long")


def _joined(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of links between documents, given the components found so far."""
    return connected_components(edges.union(labels.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))))


def starred(star: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Components by the likely pairs (a, b, size) of documents and their buckets' smallest ids.

    Every document is compared with its smallest partner first; of the other pairs only those between components are left.
    """
    first = cut(star.groupBy("b").agg(F.min(F.struct("a", "size")).alias("m")).select("m.a", "b", "m.size"))
    labels = connected_components(cut(verified(first, texts, percent)))
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"at_{x}"))
    rest = star.join(first.select("a", "b"), ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    more = cut(verified(rest.where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b", "size"), texts, percent))
    return labels if more.isEmpty() else _joined(more, labels)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept for every row."""
    docs = long_ids(docs)
    release(docs.sparkSession)
    seen = stored(features(docs.select("doc_id", "text")), "sketches")
    usable = seen.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = cut(usable.groupBy("high", "low").agg(F.min("doc_id").alias("node")))
    nodes = stored(usable.join(sets, ["high", "low"]).where("doc_id = node").select("node", "high", "low", "n_shingles", "bands").dropDuplicates(["node", "high", "low"]), "nodes")
    # an id seen with several sets represents or belongs to each of them
    same = usable.join(sets, ["high", "low"]).where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("center"), F.count("*").alias("size"), F.sum("n_shingles").alias("weight")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    buckets = cut(buckets.withColumn("blocks", blocks).drop("weight"))
    members = stored(banded.drop("n_shingles").join(buckets, ["band", "key"]), "members")
    release(docs.sparkSession)
    texts = shared_texts(docs, members, bitmap_bits(nodes.count()))
    star = members.where("node != center").groupBy(F.col("center").alias("a"), F.col("node").alias("b")).agg(F.max("size").alias("size"))
    hopeful_star = cut(estimated(star, nodes, percent))
    release(docs.sparkSession)
    labels = starred(hopeful_star, texts, percent)
    release(docs.sparkSession)
    more = cut(across(members, nodes, texts, labels, percent))
    release(docs.sparkSession)
    if not more.isEmpty():
        labels = _joined(more, labels)
    repeated = usable.groupBy("doc_id").agg(F.min("high").alias("h0"), F.max("high").alias("h1")).where("h0 != h1").select("doc_id")
    if not repeated.isEmpty():
        joined = same.join(repeated, same["b"] == repeated["doc_id"], "left_semi")
        labels = _joined(joined, labels)
    home = seen.join(sets, ["high", "low"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    out = home.join(labels, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group: the one with the smallest id, once; rows with a null id stay.

    Of rows that share an id the one with the smallest digest of all its columns stays.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    rows, names = numbered(docs)
    known, at = rows.where(F.col(names["doc_id"]).isNotNull()), F.col(names["doc_id"])
    out = known.join(kept, at == F.col("_id"), "left_semi")
    repeated = cut(known.groupBy(at.alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    if not repeated.isEmpty():
        marked = out.withColumn("_digest", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
        least = marked.join(repeated, at == F.col("_id"), "left_semi").groupBy(at.alias("_id")).agg(F.min("_digest").alias("_least"))
        # what is left of an id are equal rows
        out = marked.join(least, at == F.col("_id"), "left").where("_least IS NULL OR _least = _digest").select(*rows.columns).dropDuplicates([names["doc_id"]])
    return restored(out.unionByName(rows.where(at.isNull())), names)
