"""SpotSigs document fingerprints, in DataFrame functions only.

A spot signature is a common word (or a run of them), the content word it stands before and
the content word after that; common words between the two are passed over. A document's
fingerprint is the sorted set of its signatures' hashes, eight hexadecimal digits each, so two fingerprints can be
compared without the texts. A text without a signature has the hash of its whole text for one.

``near_pairs`` joins documents by set: copies of a fingerprint are represented by the smallest id, and a set's signatures, whole
numbers of four bytes, leave it once, to be counted. Most come back to no set, as only one has them; the others are ranked by
frequency, and a set's rarest (as many as a pair at the threshold must share one of) are matched. Signatures that a sample shows to be in many sets are not
counted but ranked last, by the sample.
A set's hub is the smallest hash among the sets that it shares such a signature with, so near copies have one. Sets of a hub and a range of lengths
are dealt to homes of bounded size, and a set goes once to each pair of homes in which it has a partner, never along with a signature or a pair: a group of near copies
is sent once for each of its homes. In a pair of homes sets of like length that show a common signature are confirmed by their full Jaccard likeness; pairs
are made there and nowhere else, so they are distinct and only counts leave. What is shuffled grows with a text's length and not with its square.

Defined results: a null text is an empty one; rows with a null id stand before the smallest id
and rows that share an id follow one another by a hash of the text; the document after the last is the first,
a single document is its own next; ids are whole numbers, others are an error; other columns are ignored;
an empty table gives an empty result; rows with a null id are in no pair. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, long_ids, release, stored

#: Common words of English, French, German and Spanish that anchor the signatures.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it not of on or she that the their they this to was were which with you "
    "au avec ce dans de des du elle en est et il la le les mais ne nous ou par pas pour qui que se son sur un une "
    "als auf aus das dem den der die ein eine einer für ich im ist mit nicht sich sie sind und von war wie zu zum "
    "al como con del el ella es lo los las más no para pero por si su sus y"
).split()
#: Rows of an id range, the most ranges whose bounds come from a sample (beyond them ranges are cut into equal spans of ids), and sampled rows of a range.
ROWS_A_BUCKET, MOST_BUCKETS, SAMPLE = 512, 4096, 20
#: Sets and signatures of a home, sets beyond which frequent signatures are found by a sample instead of counted, and bits by which a set shows the signatures it is matched by.
BLOCK_ROWS, BLOCK_SIGS, SETS_A_SALT, SHOWN = 1024, 1 << 19, 65536, 64
#: Sets of that sample, in how many of them a frequent signature is, and how many such signatures are taken (the others are counted).
SAMPLED_SETS, OFTEN, MOST_OFTEN = 16384, 16, 1 << 17

#: Where rows with a null id stand.
NULL_ID = -(1 << 63)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text."""
    anchor = lambda w: w.isin(ANCHORS)
    chain = lambda head, after: F.when(F.contains(head, F.lit("_")) & after.isNotNull(), F.substring(F.md5(F.concat(head, F.lit(" "), after)), 1, 8))

    def chains(words: Column) -> Column:
        # a run of anchors is glued to the word that it stands before
        glued = F.split(F.array_join(F.transform(words, lambda w: F.concat(w, F.when(anchor(w), F.lit("_")).otherwise(F.lit(" ")))), ""), " ")
        content = F.filter(words, lambda w: ~anchor(w))
        return F.array_sort(F.array_distinct(F.array_compact(F.zip_with(glued, F.slice(content, 2, 1 << 30), chain))))

    found = let(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " "), chains)
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.substring(F.md5(text), 1, 8))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def _bucket(bounds: list[tuple[int, int]], equal: bool = True) -> Column:
    """How many of the sorted bounds are below (``_id``, ``_tie``), or ``equal`` to it, by binary search."""
    if not bounds:
        return F.lit(0)
    ids, ties = _lists(bounds)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at, tie = F.get(ids, middle), F.get(ties, middle)
        over = (F.col("_id") > at) | ((F.col("_id") == at) & ((F.col("_tie") >= tie) if equal else (F.col("_tie") > tie)))
        return F.when(s["lo"] >= s["hi"], s).when(over, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step)["lo"]


def _lists(keys: list[tuple[int, int]]) -> list[Column]:
    return [F.array(*map(F.lit, x)) if len(x) < 2 else F.lit(list(x)) for x in zip(*keys, strict=True)]


def _span(seen: list[tuple[int, int]], bounds: list[tuple[int, int]], spans: int) -> Column:
    """The place of a row of range ``_range`` among the range's equal spans of ids, or of hashes where its bounds have one id; equal rows of a range with equal bounds are spread over all."""
    if spans == 1:
        return F.lit(0)
    least = next((x[0] for x in seen if x[0] > NULL_ID), NULL_ID)
    ends = [*zip([seen[0], *bounds], [*bounds, seen[-1]], strict=True)]
    # a range that begins among null ids has its spans from the least id on
    ids = [(max(lo[0], least) if hi[0] > lo[0] else lo[0], hi[0]) for lo, hi in ends]
    one_key = F.lit([0 < k < len(ends) - 1 and lo == hi for k, (lo, hi) in enumerate(ends)])
    (lo_id, hi_id), (lo_tie, hi_tie) = _lists(ids), _lists([(lo[1], hi[1]) for lo, hi in ends])
    at = lambda values: F.get(values, F.col("_range")).cast("double")
    part = lambda x, lo, hi: F.floor(F.least(F.greatest((x.cast("double") - at(lo)) / F.greatest(at(hi) - at(lo) + 1, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)) * spans)
    # the first and last range reach beyond what the sample has seen
    by_tie = F.when(F.col("_id") < F.get(lo_id, F.col("_range")), F.lit(0)).when(F.col("_id") > F.get(hi_id, F.col("_range")), F.lit(spans)).otherwise(part(F.col("_tie"), lo_tie, hi_tie))
    place = F.when(F.get(one_key, F.col("_range")), F.pmod(F.xxhash64("_spread"), F.lit(spans))).when(F.get(hi_id, F.col("_range")) > F.get(lo_id, F.col("_range")), part(F.col("_id"), lo_id, hi_id)).otherwise(by_tie)
    return F.least(place, F.lit(spans - 1))


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """doc_id, text and a window over ascending ids in which the next row is the next document.

    Rows are dealt to ranges of (id, hash of the text), whose bounds are a sample's, so ids that repeat are
    split too. A key so frequent that it is a bound several times has its rows, which are equal, spread over as many ranges. Where there are
    more rows than ``MOST_BUCKETS`` ranges should hold, every range is cut into equal spans, so ranges stay as small at every size while the
    ids between two bounds lie evenly; no key that is split less has more than two of ``MOST_BUCKETS`` shares. The first row of a range stands, marked ``ghost``, at the end of the
    range with rows before it, and the first of all after the last.
    """
    rows = long_ids(docs.select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id")).withColumns({"_tie": F.xxhash64("text"), "_spread": F.monotonically_increasing_id()})
    n = docs.count()
    wanted = max(1, min(MOST_BUCKETS, n // ROWS_A_BUCKET))
    share = int(min(1.0, wanted * SAMPLE / max(1, n)) * (1 << 30))
    # about MOST_BUCKETS * SAMPLE keys
    seen = sorted(tuple(r) for r in rows.select("_id", "_tie", "_spread").where(F.pmod(F.xxhash64("_tie", "_id", "_spread"), F.lit(1 << 30)) < share).select("_id", "_tie").collect()) if wanted > 1 else []
    bounds = [seen[k * len(seen) // wanted] for k in range(1, wanted)] if seen else []
    spans = -(-n // (wanted * ROWS_A_BUCKET)) if bounds and n > 2 * wanted * ROWS_A_BUCKET else 1
    upper = _bucket(bounds)
    if len(set(bounds)) < len(bounds):
        lower = _bucket(bounds, equal=False)
        upper = F.when(upper > lower, lower + 1 + F.pmod(F.xxhash64("_spread", F.lit(1)), upper - lower)).otherwise(upper)
    dealt = rows.withColumn("_range", upper.cast("int")).withColumn("_bucket", F.col("_range").cast("long") * spans + _span(seen, bounds, spans)).drop("_range", "_spread")
    first = cut(dealt.groupBy("_bucket").agg(F.min(F.struct("_id", "_tie", "text", "doc_id")).alias("f")).withColumn("_range", F.floor(F.col("_bucket") / spans)))
    # at most MOST_BUCKETS rows
    lasts = first.groupBy("_range").agg(F.max("_bucket").alias("last"))
    before = lasts.select("_range", F.coalesce(F.lag("last").over(Window.orderBy("_range")), F.max("last").over(Window.partitionBy())).alias("last"))
    back = F.coalesce(F.lag("_bucket").over(Window.partitionBy("_range").orderBy("_bucket")), "last")
    ghosts = first.join(before, "_range").select("f.doc_id", "f.text", "f._id", "f._tie", back.alias("_bucket"), F.lit(True).alias("ghost"))
    both = dealt.select("doc_id", "text", "_id", "_tie", "_bucket", F.lit(False).alias("ghost")).unionByName(ghosts)
    return both, Window.partitionBy("_bucket").orderBy("ghost", "_id", "_tie", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form (its second half is the next document's first), and their likeness."""
    rows, order = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "_next": F.lead("text").over(order)})
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)))
    rows = rows.withColumns({"edited_sha256": F.sha2(F.col("_edited").cast("binary"), 256), "_own": signatures(F.col("text"))})
    rows = rows.withColumns({"_new": signatures(F.col("_edited"))}).drop("_next", "_edited")
    rows = rows.withColumn("_after", F.lead("_own").over(order)).where(~F.col("ghost"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.concat_ws("", "_own").alias("fingerprint"), F.concat_ws("", "_new").alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_after")).alias("near_next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sigs (the sorted signature set) and fingerprint, for every row."""
    rows = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    return rows.withColumn("fingerprint", F.concat_ws("", "sigs"))


def _counted(each: DataFrame) -> DataFrame:
    """The rows of signatures that several sets have, ranked by how many."""
    return each.withColumn("rank", F.count("*").over(Window.partitionBy("sig"))).where("rank > 1")


def _heads(classes: DataFrame, threshold: float) -> DataFrame:
    """set, n, part (its range of lengths), head (the rarest signatures by which it is matched) and marks (which of ``SHOWN`` bits those have), of sets that can have a partner."""
    each = classes.select("set", F.explode("sigs").alias("sig"))
    total = classes.count()
    if total > SETS_A_SALT:
        share = int(min(1.0, SAMPLED_SETS / total) * (1 << 30))
        sample = classes.where(F.pmod(F.xxhash64("set"), F.lit(1 << 30)) < share).select(F.explode("sigs").alias("sig"))
        often = sample.groupBy("sig").agg((F.count("*") + (1 << 30)).alias("rank")).where(F.col("rank") >= (1 << 30) + OFTEN)
        often = F.broadcast(cut(often.orderBy(F.desc("rank"), "sig").limit(MOST_OFTEN)))
        shared = _counted(each.join(often, "sig", "left_anti")).unionByName(each.join(often, "sig"))
    else:
        shared = _counted(each)
    key = F.shiftleft(F.least("rank", F.lit((1 << 31) - 1)), 32) + F.col("sig").cast("long") + F.lit(1 << 31)
    order = shared.groupBy("set").agg(F.sort_array(F.collect_list(key)).alias("order")).join(classes.select("set", "n"), "set")
    # signatures that no other set has are the rarest of all
    length = (F.size("order") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    part = F.floor(F.log(F.col("n")) / F.lit(math.log(1 / threshold)) + 1e-9)
    heads = order.where(length > 0).select("set", "n", part.alias("part"), F.transform(F.slice("order", F.lit(1), length), lambda key: (key.bitwiseAND((1 << 32) - 1) - F.lit(1 << 31)).cast("int")).alias("head"))
    mark = lambda seen, sig: seen.bitwiseOR(F.element_at(F.lit([1 << k if k < 63 else NULL_ID for k in range(SHOWN)]), F.pmod(F.xxhash64(sig), F.lit(SHOWN)).cast("int") + 1))
    return heads.withColumn("marks", F.aggregate("head", F.lit(0).cast("long"), mark))


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of unlike fingerprints at the threshold or more, by representatives, and the
    membership (doc_id, representative) of all documents with an id."""
    spark = docs.sparkSession
    whole = F.transform("sigs", lambda x: F.conv(x, 16, 10).cast("long") - F.lit(1 << 31)).cast("array<int>")
    known = stored(fingerprints(long_ids(docs.select("doc_id", "text")).where("doc_id IS NOT NULL")).select("doc_id", F.unhex(F.md5("fingerprint")).alias("key"), whole.alias("sigs")), "known")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("sigs").alias("sigs"))
    classes = stored(classes.select("key", F.monotonically_increasing_id().alias("set"), "id", "sigs", F.size("sigs").alias("n")), "classes")
    members = known.select("doc_id", "key").join(classes.select("key", F.col("id").alias("representative")), "key").select("doc_id", "representative").distinct()
    release(spark)
    heads = stored(_heads(classes, threshold), "heads")
    release(spark)
    posts = heads.select("set", "n", "part", F.explode("head").alias("sig"))
    met = stored(posts.join(posts.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.xxhash64("set")).alias("hub")).where("m > 1"), "sig"), "met")
    hubs = met.groupBy("set", "n", "part").agg(F.min("hub").alias("hub"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SIGS))
    homes = hubs.join(hubs.groupBy("hub", "part").agg(blocks.alias("blocks")), ["hub", "part"])
    homes = cut(homes.select("set", F.xxhash64("hub", "part", F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks"))).alias("home")))
    placed = met.join(homes, "set").select("sig", "m", "set", "part", "home")
    # a frequent signature's sets are dealt out, and its homes told to each share of them
    shares = F.ceil(F.col("m") / BLOCK_ROWS)
    groups = placed.select("sig", "m", "part", F.col("home").alias("other")).distinct()
    groups = groups.select("sig", "other", F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    partners = placed.withColumn("share", F.pmod(F.xxhash64("set"), shares)).join(groups, ["sig", "share", "part"]).where("other != home").select("set", "other").distinct()
    inside = homes.withColumn("size", F.count("*").over(Window.partitionBy("home"))).where("size > 1").select("set", F.col("home").alias("other"))
    own = classes.select("set", "id", "sigs", "n").join(heads.select("set", "marks"), "set").join(homes, "set")
    cells = partners.unionByName(inside).join(own, "set")
    dealt = stored(cells.withColumns({"lo": F.least("home", "other"), "hi": F.greatest("home", "other")}).drop("other"), "dealt")
    release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = lambda x: dealt.where(F.col("home") == F.col("lo" if x == "a" else "hi")).select("lo", "hi", *(F.col(c).alias(f"{c}_{x}") for c in ("set", "id", "n", "marks", "sigs"))).repartition(parts, "lo", "hi")
    near = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a")) & (F.col("marks_a").bitwiseAND(F.col("marks_b")) != 0)
    likely = likeness(F.col("sigs_a"), F.col("sigs_b"))
    pairs = side("a").join(side("b"), ["lo", "hi"]).where(((F.col("lo") < F.col("hi")) | (F.col("set_a") < F.col("set_b"))) & near & (likely >= threshold))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), likely.alias("likeness")), members


def near_fingerprints(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, class_id (smallest id with the same fingerprint) and n_links (unlike fingerprints at the threshold or more) of every document with an id."""
    pairs, members = near_pairs(docs, threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("n_links"))
    return members.join(links, "representative", "left").select("doc_id", F.col("representative").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


_SIGS_OF = (
    "list_sort(list_distinct(list_filter(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN contains(g[i], '_') AND i < len(c) THEN md5(g[i] || ' ' || c[i + 1])[:8] END), lambda x: x IS NOT NULL)))"
)


def _sigs(name: str, source: str, text: str) -> str:
    """A SQL table of the signature sets of ``source``'s rows."""
    anchor = f" ({'|'.join(dict.fromkeys(ANCHORS))}) "
    return f"""{name} AS (
  SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [md5(t)[:8]] END AS s FROM (SELECT doc_id, t, {_SIGS_OF} AS s FROM (
    SELECT doc_id, t, string_split_regex(trim(replace(regexp_replace(w, '{anchor}', '\\1_', 'g'), '_ ', '_')), ' +') AS g,
           string_split_regex(trim(regexp_replace(w, '{anchor}', '', 'g')), ' +') AS c
    FROM (SELECT doc_id, t, ' ' || replace(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' ' AS w FROM (SELECT doc_id, {text} AS t FROM {source})))))"""


def near_sql(threshold: float = 0.75) -> str:
    """DuckDB SQL for ``near_fingerprints`` of documents with distinct ids."""
    return f"""
WITH {_sigs("a", "documents", "coalesce(text, '')")},
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM a),
c AS (SELECT doc_id, s, len(s) AS n FROM m WHERE doc_id = class_id),
e AS (SELECT doc_id, n, unnest(s) AS g FROM c),
p AS (SELECT x.doc_id AS a, count(*) / CAST(x.n + y.n - count(*) AS DOUBLE) AS likeness FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND x.n >= {threshold} * y.n AND y.n >= {threshold} * x.n GROUP BY x.doc_id, y.doc_id, x.n, y.n),
l AS (SELECT a, count(*) AS n_links FROM p WHERE likeness >= {threshold} GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l ON class_id = a
"""


def oracle_sql() -> str:
    """DuckDB SQL for ``edited_fingerprints`` of documents with distinct ids."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nt,
             coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS ni FROM d),
e AS (SELECT doc_id, ni, n, text, substr(text, 1, n - n // 2) || substr(nt, 1, n // 2) AS edited FROM o),
{_sigs("a", "e", "text")},
{_sigs("b", "e", "edited")}
SELECT e.doc_id AS doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
       len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) AS near_edited,
       len(list_intersect(a.s, x.s)) / CAST(len(a.s) + len(x.s) - len(list_intersect(a.s, x.s)) AS DOUBLE) AS near_next
FROM e JOIN a ON e.doc_id = a.doc_id JOIN b ON e.doc_id = b.doc_id JOIN a x ON e.ni = x.doc_id
"""
