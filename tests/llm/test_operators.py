"""The ten operators against brute force, the tokenizers library and held-out accuracy."""

from __future__ import annotations

import collections
import gc
import hashlib
import itertools
import json
import os
import pickle
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorspark.llm import bpe, chat_format, hyperminhash, langid, license_scan, line_dedup, packing, queries, shingles, spotsigs, token_counts, topk
from fluorspark.llm.common import table
from fluorspark.llm.components import connected_components as components_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, node long, score double, bucket int, label string, row long, _id long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 9, 0.5, 1, "y", 2, 3) for i, t in rows], SCHEMA)


LONG = " ".join(f"word{k % 977} the of" for k in range(60_000))
ODD = [(1, "The cat sat on the mat near the old red house."), (1, "The cat sat on the mat near the old red house."), (None, "A null id of the text."), (None, None), (2, None), (3, ""), (4, " \t\n\x0b "), (5, LONG), (6, "日本語 <|endoftext|> Ünïcode don't 123!?"), (7, "a"), (8, "x" * 5000), (9, "The cat sat on the mat near the old red house.")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made.no_truncation()
    made.no_padding()
    return made


# language identification


def test_language_of_held_out_documents(docs):
    rows = langid.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    letters = [r for r in held if any(map(str.isalpha, r["text"]))]
    assert np.mean([r["lang_pred"] == r["lang"] for r in letters]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_documents(odd, none, docs):
    model = langid.fit(docs)
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in langid.predict(odd, model).collect()}
    assert {i for i, u in got if u} == {None, 2, 3, 4} and langid.predict(odd, model).count() == len(ODD)
    assert langid.identify(none).count() == 0 and langid.accepted(odd).columns == odd.columns
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def naive_buckets(text):
    """The buckets of a text's n-grams, one at a time in whole numbers."""
    mask, out = (1 << 64) - 1, []
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    for n in langid.ORDERS:
        for k in range(len(letters) - n + 1):
            if letters[k + n - 1] != " " and k + n > 1:
                h = n
                for c in letters[k : k + n]:
                    h = ((h * 0x9E3779B97F4A7C15) & mask) ^ ord(c)
                out.append((((h * 0xBF58476D1CE4E5B9) & mask) >> 40) % langid.BUCKETS)
    return out


def test_language_equals_naive_counts_and_sums(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 5000)
    rows = [r for r in docs.collect() if r["text"] and len(r["text"]) < 3000][:60]
    counts, own = {}, {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5:
            own[r["lang"]] = own.get(r["lang"], 0) + 1
            counts.setdefault(r["lang"], collections.Counter()).update(naive_buckets(r["text"]))
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, docs.schema)).collect()}
    for r in rows:
        seen = collections.Counter(naive_buckets(r["text"]))
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
            logs[lang] = np.log(own[lang] / sum(own.values())) + sum(n * np.log((c[b] + langid.SMOOTHING) / total) for b, n in seen.items())
        best = max(sorted(logs), key=logs.get)
        if seen:
            assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - 1 / sum(np.exp(v - logs[best]) for v in logs.values())) < 1e-6
        else:
            assert got[r["doc_id"]]["lang_pred"] == "und"


def test_language_blocks_stay_small(texts):
    langs = 10
    rng = np.random.default_rng(3)
    rows, prior, logp = langid.sparse_rows(4 * list(texts.values()), langid.BUCKETS), np.zeros(langs), rng.normal(size=(langid.BUCKETS, langs))
    tracemalloc.start()
    got = langid.log_likelihoods(rows, prior, logp)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    begin, at, n = rows
    for k in range(0, len(got), 50):
        part = slice(begin[k], begin[k + 1])
        assert np.allclose(got[k], (n[part, None] * logp[at[part]]).sum(axis=0))
    assert begin[-1] * langs > 1 << 22 and most < 16 << 20


def test_languages_in_blocks_of_columns(spark, monkeypatch):
    """300 labels over five blocks give what one block gives; ties between blocks go to the first label."""
    rng = np.random.default_rng(31)
    kinds = [[f"{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(6)] for _ in range(300)]
    rows = [(k, " ".join(rng.choice(kinds[k % 300], 12)), f"l{k % 300:03d}") for k in range(900)] + [(900, None, "l001"), (901, "", "l002"), (902, "123", None)]
    rows += [(1000 + k, "zz top", lang) for k, lang in enumerate(("a", "zzz") * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r["doc_id"]: r for r in (monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 1000), langid.identify(docs).collect())[1]}
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 64)
    model = langid.fit(docs)
    assert len(model["langs"]) == 302 and len(model["logp"]) == 5 and all(isinstance(x, str) for x in model["logp"])
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got}) > 250
    for r in got:
        assert r["lang_pred"] == whole[r["doc_id"]]["lang_pred"] and abs(r["score"] - whole[r["doc_id"]]["score"]) < 1e-9


def test_language_runs_equal_whole():
    text = ("abc déf " * 90_000)[: langid.CHUNK * 2 + 77]
    counted = sum(np.bincount(x, minlength=langid.BUCKETS) for x in langid.bucket_runs(text))
    whole, old = None, langid.CHUNK
    try:
        langid.CHUNK = 1 << 30
        whole = sum(np.bincount(x, minlength=langid.BUCKETS) for x in langid.bucket_runs(text))
    finally:
        langid.CHUNK = old
    assert (counted == whole).all()


# byte pairs and packing


def expected_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library(docs, odd, texts, library):
    for frame, source in ((docs, list(texts.items())), (odd, ODD)):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(frame).collect())
        want = []
        for i, text in source:
            ids = expected_ids(library, text or "")
            want.append((i is None, i or 0, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)


def test_encoder_on_random_words(library):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        own = bpe.Encoder(file.read())
    rng = np.random.default_rng(4)
    pools = ["abcdefghijklmnopqrstuvwxyz", "aeinrst", "éüßñçàÉ", "0123456789", ".,!?'-_<|>", " \t\n  \x1c", "ΑΣσЖя中文한", "éä"]
    made = ["".join(rng.choice(list(itertools.chain(*rng.choice(pools, 2, replace=False))), rng.integers(1, 60))) for _ in range(4000)] + ["don't they're I'LL", "<|startoftext|>a<|endoftext|>", "aaa" * 400]
    got = list(own.encode_groups(made))
    for text, ids in zip(made, got, strict=True):
        assert ids.tolist() == expected_ids(library, text), repr(text)
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)
    own.known.update({f"<{k}>": 0 for k in range(bpe.MAX_CACHED)})  # a full cache is emptied, not exceeded
    assert next(own.encode_groups(["fresh words"])).tolist() == expected_ids(library, "fresh words") and len(own.known) < 10


def test_words_met_again_stay_cached(library, monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        own = bpe.Encoder(file.read())
    monkeypatch.setattr(bpe, "MAX_CACHED", 40)
    encode_words, asked = own.merges.encode_words, []
    monkeypatch.setattr(own.merges, "encode_words", lambda words: asked.extend(words) or encode_words(words))
    rng = np.random.default_rng(6)
    for _ in range(20):
        rare = ["".join(rng.choice(list("aeinrstßé"), 9)) for _ in range(15)]
        texts = ["Common\xa0words stay, STAY%%% <b> <|endoftext|>\u2003" + " ".join(rare), "", "\x1c stay.stay 'S\x85" + rare[0] * 20, "Σ common words İ."]
        for text, ids in zip(texts, own.encode_groups(texts), strict=True):
            assert ids.tolist() == expected_ids(library, text), repr(text)
        assert len(own.known) <= 40 and len(own.older) <= 40 and max(map(len, own.known)) <= bpe.MAX_CACHED_CHARS
    assert asked.count(b"common") == 1 and asked.count(b"words") == 1


def test_cache_is_bounded_and_stays_behind(library, monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        own = bpe.Encoder(file.read())
    monkeypatch.setattr(bpe, "MAX_CACHED", 40)
    text = " ".join(f"w{k}x <|endoftext|> Ünïcode Σ{k}" for k in range(200))  # more words than a generation holds
    for _ in range(3):
        assert next(own.encode_groups([text])).tolist() == expected_ids(library, text)
        assert len(own.known) <= 40 and len(own.older) <= 40
    sent = pickle.loads(pickle.dumps(own))
    assert own.known and not sent.known and not sent.older
    assert next(sent.encode_groups([text])).tolist() == expected_ids(library, text)


def test_workers_let_go_of_the_encoder(spark, docs):
    def held(batches):
        import pyarrow as pa

        gc.collect()
        # the class is looked up by its name: the task may be the first one of its worker
        kept = sum(type(x).__name__ == "Encoder" and type(x).__module__ == bpe.__name__ for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "kept": [kept]})

    def used(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()]})

    packing.pack(docs.repartition(8)).write.format("noop").mode("overwrite").save()
    seen = {r["pid"] for r in docs.select("doc_id").repartition(8).mapInArrow(used, "pid long").collect()}
    packing.pack(docs.repartition(8)).write.format("noop").mode("overwrite").save()
    after = docs.select("doc_id").repartition(8).mapInArrow(held, "pid long, kept long").collect()
    assert seen & {r["pid"] for r in after} and {r["kept"] for r in after} == {0}


def test_encode_decode_interface(docs):
    rows = bpe.encode(docs.limit(5), keep=("doc_id",))
    assert bpe.decode(rows).count() == 5


@pytest.mark.parametrize("source", ["docs", "odd"])
def test_pieces(request, library, texts, source):
    frame = request.getfixturevalue(source)
    pieces = packing.pack(frame).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and {p["offset"] for p in pieces} == {0}
    own = {}
    for p in pieces:
        assert p["length"] <= 2048 and p["length"] == 1 << p["bucket"]
        own.setdefault(p["doc_id"], []).append(p)
    if source == "docs":
        for i, text in texts.items():
            ids = np.array([*expected_ids(library, text), 1], dtype="<u4")
            at = 0
            for p in sorted(own[i], key=lambda p: p["start"]):
                assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    else:
        assert sum(p["doc_tokens"] == 1 for p in pieces) == 4 and set(own) == {i for i, _ in ODD}


def test_pack_of_nothing(none):
    assert packing.pack(none, with_ids=True).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, most=1000)


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 5000])
def test_lengths(n):
    own = packing.lengths(n)
    assert own.sum() == n and all(x & (x - 1) == 0 for x in own.tolist()) and sorted(own, reverse=True) == own.tolist()


# near duplicates


def shingle_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = [(i, shingle_words(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(k)
    for k, (i, a) in enumerate(sets):
        for m in {m for g in a for m in held[g] if m > k}:
            j, b = sets[m]
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(1_000_000)}" for w in words)


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    rng = np.random.default_rng(8)
    base = [[f"w{rng.integers(500)}" for _ in range(n)] for n in (4, 7, 30, 120, 400)]
    rows = [*texts.items(), *((10_000 + 100 * k + j, edited(rng, w, share)) for k, w in enumerate(base) for j, share in enumerate(rng.uniform(0, 0.06, 60)))]
    rows += [(20_000, "a b c d"), (20_001, "A  b\tC d"), (20_002, "a b c"), (20_003, ""), (20_004, None), (20_005, "")]
    want, sizes = components(rows), {i: len(shingle_words(t)) for i, t in rows}
    got = hyperminhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_with_a_hot_bucket(spark, monkeypatch):
    """Many unlike members in a bucket, dealt out in several blocks; few links and few texts leave the tasks."""
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", 16)
    counts, cut = [], hyperminhash.cut
    monkeypatch.setattr(hyperminhash, "cut", lambda df: (made := cut(df), counts.append((made.columns, made.count())))[0])
    rng = np.random.default_rng(9)
    words = [f"w{rng.integers(500)}" for _ in range(150)]
    rows = [(k, edited(rng, words, rng.uniform(0.02, 0.07))) for k in range(250)]
    want = components(rows)
    assert 1 < len(set(want.values())) < 250
    assert {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()} == want
    # links: one for each document in each of a bucket's cells at most, and no pair of documents that are joined already
    assert max(n for columns, n in counts if columns == ["a", "b"]) < 3 * len(rows)


def test_unlike_members_fetch_no_texts(spark, monkeypatch):
    """Documents that share a third of their shingles meet in buckets, but their sketches tell them apart."""
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", 16)
    counts, cut = [], hyperminhash.cut
    monkeypatch.setattr(hyperminhash, "cut", lambda df: (made := cut(df), counts.append((made.columns, made.count())))[0])
    rng = np.random.default_rng(19)
    shared = [f"s{rng.integers(5000)}" for _ in range(300)]
    rows = [(k, " ".join(shared + [f"w{rng.integers(100000)}" for _ in range(290)])) for k in range(200)]
    assert {r["component_id"] == r["doc_id"] for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()} == {True}
    fetched = [n for columns, n in counts if "block" in columns and "bands" in columns]
    assert fetched == [0] or sum(fetched) < len(rows)


def test_near_duplicates_with_a_full_bitmap(spark, monkeypatch):
    """A bitmap of 64 bits lets every text through, and the results stay the same."""
    assert [hyperminhash.bitmap_bits(n) for n in (0, 1 << 20, 10**7, 10**12)] == [1 << 20, 1 << 23, 1 << 27, 1 << 30]
    rng = np.random.default_rng(33)
    words = [f"w{rng.integers(500)}" for _ in range(120)]
    rows = [(k, edited(rng, words, rng.uniform(0.0, 0.06))) for k in range(80)] + [(k, f"alone {k} one two three four") for k in range(100, 180)]
    want = components(rows)
    monkeypatch.setattr(hyperminhash, "LEAST_BITS", 64)
    monkeypatch.setattr(hyperminhash, "MOST_BITS", 64)
    assert {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()} == want


def test_estimates_of_every_size_let_pairs_at_the_threshold_pass():
    rng = np.random.default_rng(22)
    for n in (3, 6, 12, 30, 90, 240, 600):
        a, b, m, k = [], [], [], []
        for _ in range(300):
            hashes = rng.integers(0, 1 << 63, n + n // 3, dtype=np.uint64) << np.uint64(1)
            at = n + int(rng.integers(0, n // 3 + 1))
            left, right = np.unique(hashes[:at]), np.unique(np.r_[hashes[:n], hashes[at:]])
            for held, size, own in ((a, m, left), (b, k, right)):
                held.append(hyperminhash.sketch(own))
                size.append(len(own))
        assert hyperminhash.likely(np.array(a), np.array(b), np.array(m), np.array(k), 75).all()
    # unlike small sets are told apart by the estimate too
    one, two = (np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(2))
    assert not hyperminhash.likely(hyperminhash.sketch(one)[None], hyperminhash.sketch(two)[None], np.array([40]), np.array([40]), 75).any()


def test_components_of_odd_edges(spark):
    edges = [(1, 2), (2, 1), (2, 2), (9, 9), (None, 3), (5, 4), (4, 6), (7, 8), (8, 5), *((k, k + 1) for k in range(100, 160))]
    got = {r["node"]: r["component"] for r in components_of(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, **dict.fromkeys((4, 5, 6, 7, 8), 4), **dict.fromkeys(range(100, 161), 100)}
    assert components_of(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, none, spark):
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD) and got.count((1, 1, True)) == 2 and (9, 1, False) in got
    assert all(k for i, c, k in got if i is None) and (None, None, True) in got
    assert hyperminhash.near_duplicates(none).count() == 0
    kept = hyperminhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 9").count() == 0
    # an id with two texts joins their classes
    two = documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "k l m n o p"), (3, "k l m n o p")])
    assert {r["component_id"] for r in hyperminhash.near_duplicates(two).collect()} == {1}


def test_ids_of_other_types_and_choice_among_repeats(spark, odd):
    with pytest.raises(TypeError):
        hyperminhash.near_duplicates(odd.withColumn("doc_id", F.col("doc_id").cast("string")))
    ints = odd.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert hyperminhash.near_duplicates(ints).count() == len(ODD) and hyperminhash.deduplicated(ints).schema == ints.schema
    two = spark.createDataFrame([(1, t, {"k": t}) for t in ("b c", "a c", "d e", "d e")], "doc_id long, text string, _id map<string,string>")
    assert {hyperminhash.deduplicated(x).first()["text"] for x in (two, two.orderBy("text"), two.repartition(3))} == {hyperminhash.deduplicated(two).first()["text"]} and hyperminhash.deduplicated(two).count() == 1


def test_words_made_to_collide(spark):
    odd = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in odd) for flip in (0, 1))
    assert shingles.word_hashes(a) != shingles.word_hashes(b)


def test_word_hashes_over_chunks(monkeypatch):
    text = " ".join(f"Word{k}\t{k % 7}" for k in range(3000)) + " " + "y" * 900
    whole = shingles.word_hashes(text)
    assert len(whole) == 6001
    monkeypatch.setattr(shingles, "CHUNK", 1000)
    assert (shingles.word_hashes(text) == whole).all()
    assert len(shingles.word_hashes("z" * 5000 + " a " + "z" * 5000)) == 3


# separator scan


def test_token_counts(docs, odd, none, texts, library):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: len(expected_ids(library, t)) for i, t in texts.items()}
    assert token_counts.count_tokens(odd).count() == len(ODD) and token_counts.count_tokens(none).count() == 0


def test_scan_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(10)
    for name, ids in (("a.bin", rng.integers(0, 6, 997)), ("b.bin", np.array([5, 5, 1])), ("c.bin", np.array([1, 2, 3])), ("d.bin", np.zeros(0, dtype=int))):
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    got = sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in token_counts.scan(spark, f"file://{tmp_path}", separator=5, block_bytes=14).collect())
    want = []
    for path in sorted(tmp_path.iterdir()):
        ids, start, k = np.frombuffer(path.read_bytes(), dtype="<u2"), 0, 0
        for end in np.flatnonzero(ids == 5).tolist():
            want.append((path.name, k, start, end - start, True))
            start, k = end + 1, k + 1
        if start < len(ids):
            want.append((path.name, k, start, len(ids) - start, False))
    assert got == want


# tool calls


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True)}}
    calls = [(1, 0, "x", "add", '{"b":1.5, "a":2}', []), (1, 1, "y", "add", '{"a":"2","c":1}', ["x", "gone"]), (1, 2, "z", "say", "no json", ["y", "x"]), (1, 3, "y", "say", '{"text":"t"}', []), (1, 4, "p", "say", '{"text":"t"}', ["q"]), (1, 5, "q", "nix", "{}", ["p"]), (2, 0, "x", "say", None, []), (None, 0, "x", "say", '{"text":null}', [])]
    results = [(1, 9, "x", "3"), (1, 8, "x", 'say "three"'), (1, 9, "lost", "r"), (2, 1, None, "r2")]
    rows = chat_format.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schemas).collect()
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in rows}
    assert len(rows) == 10
    first = got[1, "x", "linked"]
    assert (first["level"], first["errors"]) == (0, "") and first["record"] == '{"arguments":{"a":2,"b":1.5},"id":"x","level":0,"name":"add","result":"say \\"three\\""}'
    assert got[1, "y", "unanswered"]["level"] == 1 and got[1, "y", "unanswered"]["errors"] == "a is no integer; unknown parameter c"
    assert got[1, "z", "unanswered"]["level"] == 2 and got[1, "z", "unanswered"]["errors"] == "arguments are no JSON object"
    assert got[1, "p", "unanswered"]["level"] is None and got[1, "q", "unanswered"]["errors"] == "unknown tool nix"
    assert got[2, "x", "unanswered"]["errors"] == "arguments are no JSON object" and got[None, "x", "unanswered"]["errors"] == "text is no string"
    assert (1, "y", "repeated") in got and (1, "lost", "orphan") in got and (2, None, "orphan") in got
    assert all(json.loads(r["record"]) for r in rows)


def test_repeated_calls_and_results(spark):
    schemas = {"say": {"text": ("string", True)}, "sing": {"text": ("string", True)}}
    said = '{"text":"t"}'
    calls = [(1, 0, "x", "say", said, [])] * 3 + [(1, 0, "x", "sing", said, []), (1, 0, "x", "say", said, ["w"]), (1, 4, "w", "say", said, []), (None, 0, "x", "say", said, []), (None, 0, "x", "say", said, [])]
    results = [(1, 1, "x", "a")] * 2 + [(1, 2, "x", "b"), (1, 2, "lost", "c"), (1, 2, "lost", "c"), (1, 2, None, "d"), (1, 2, None, "d")]
    rows = chat_format.link_all(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schemas).collect()
    # every call has a row, and every result but the linked one
    got = collections.Counter((r["conv_id"], r["call_id"], r["status"], json.loads(r["record"])["name"], json.loads(r["record"])["result"], r["errors"]) for r in rows)
    assert got == {
        (1, "x", "linked", "say", "a", ""): 1, (1, "x", "repeated", "say", None, ""): 3, (1, "x", "repeated", "sing", None, ""): 1, (1, "w", "unanswered", "say", None, ""): 1, (None, "x", "unanswered", "say", None, ""): 2,
        (1, "x", "repeated", None, "a", ""): 1, (1, "x", "repeated", None, "b", ""): 1, (1, "lost", "orphan", None, "c", ""): 1, (1, "lost", "repeated", None, "c", ""): 1, (1, None, "orphan", None, "d", ""): 2,
    }


def test_calls_and_results_come_out_once(spark):
    """Random calls and results with repeats, equal repeats and null ids, beside columns of any name and type, against brute force."""
    rng = np.random.default_rng(23)
    name = lambda: rng.choice(["a", "b", "c", "d", None])
    calls = [(rng.choice([1, 2, None]), int(rng.integers(0, 4)), name(), "say", f'{{"text":"{rng.integers(3)}"}}', [x for x in (name() for _ in range(2)) if x]) for _ in range(80)]
    results = [(rng.choice([1, 2, None]), int(rng.integers(0, 4)), name(), str(rng.integers(3))) for _ in range(60)]
    extra = lambda df: df.withColumns({"kept": F.lit(1), "first": F.create_map(F.lit("k"), F.lit(1)), "_row": F.lit("x"), "n": F.lit(None), "status": F.lit("s"), "level": F.lit(0.5), "record": F.array(F.lit(1)), "errors": F.lit(1)})
    rows = chat_format.link_all(extra(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")), extra(spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")), {"say": {"text": ("string", True)}}).collect()
    want = collections.Counter()
    known = lambda r: r[0] is not None and r[2] is not None
    ids = {(r[0], r[2]) for r in calls + results if known(r)}
    for key in ids:
        own, answers = (sorted((r for r in x if known(r) and (r[0], r[2]) == key), key=lambda r: (r[1], r[at])) for x, at in ((calls, 4), (results, 3)))
        want[(*key, "orphan" if not own else "linked" if answers else "unanswered", own[0][4] if own else None, answers[0][3] if answers else None)] += 1
        for r in own[1:]:
            want[(*key, "repeated", r[4], None)] += 1
        for r in answers[1:]:
            want[(*key, "repeated", None, r[3])] += 1
    for r in calls:
        if not known(r):
            want[(r[0], r[2], "unanswered", r[4], None)] += 1
    for r in results:
        if not known(r):
            want[(r[0], r[2], "orphan", None, r[3])] += 1
    compact = lambda a: None if a is None else json.dumps(a, separators=(",", ":"))
    got = collections.Counter((r["conv_id"], r["call_id"], r["status"], compact(json.loads(r["record"])["arguments"]), json.loads(r["record"])["result"]) for r in rows)
    assert got == want


def test_levels_of_a_random_graph(spark):
    rng = np.random.default_rng(13)
    after = {k: sorted({int(x) for x in rng.integers(0, k, rng.choice([0, 1, 1, 1, 2, 3]))}) if k else [] for k in range(120)}
    after |= {120: []} | {k: [k - 1] for k in range(121, 300)} | {300: [301], 301: [302], 302: [300], 303: [302], 304: [303, 5]}
    rows = [(1, f"c{k}", [f"c{x}" for x in own]) for k, own in after.items()]
    want = {}
    for k, own in after.items():
        want[k] = None if k >= 300 else max((want[x] + 1 for x in own), default=0)
    got = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>"))
    assert {int(r["call_id"][1:]): r["level"] for r in got.collect()} == want


def test_every_status_and_error_occurs(spark):
    rows = queries.op5_tool_calls(spark, SF.replace("0.001", "0.01")).collect()
    assert {r["status"] for r in rows} == {"linked", "unanswered", "orphan", "repeated"} and any(r["call_id"] is None for r in rows)
    assert {e for r in rows for e in r["errors"].split("; ")} >= {"unknown tool shout"} | {e for *_, x in chat_format.SEARCHES for e in x.split("; ")}
    assert {r["level"] for r in rows if r["status"] == "linked"} >= {None, 0, 1, 2, 3}


def test_nested_rules(spark):
    rules = {"t": {"a": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0.5, "required": True}, "k": {"type": "array", "items": ("boolean", True)}}}}, "e": {"type": "integer", "enum": [1, 2]}}}
    cases = {
        '{"a":[{"x":1},{"x":0.25,"k":[true,1]},{"k":[]},3]}': "a[1].k[1] is no boolean; a[1].x is below 0.5; a[2].x is missing; a[3] is no object",
        '{"a":[],"e":3}': "a has less than 1 items; e is none of its values",
        '{"e":2}': "", '{"e":null}': "e is no integer", '{"a":{"x":1}}': "a is no array", '{"a":[{"x":1,"y":{}}]}': "unknown parameter a[0].y", "[]": "arguments are no JSON object",
    }
    calls = spark.createDataFrame([(1, k, str(k), "t", a, []) for k, a in enumerate(cases)], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    got = chat_format.link_all(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), rules).collect()
    assert {int(r["call_id"]): r["errors"] for r in got} == dict(enumerate(cases.values()))


def test_embedded_calls(spark):
    messages = [(1, 0, "assistant", json.dumps({"tool_calls": [{"id": "k", "name": "say", "arguments": '{"text":"x"}'}]})), (1, 1, "tool", json.dumps({"tool_call_id": "k", "content": "done"})), (1, 2, "assistant", "plain"), (1, 3, "assistant", None)]
    rows = chat_format.link(*chat_format.embedded(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")), {"say": {"text": ("string", True)}}).collect()
    assert [(r["call_id"], r["status"], r["errors"]) for r in rows] == [("k", "linked", "")]
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.link(*chat_format.turns_as_calls(nothing), chat_format.REPLY).count() == 0


# top-k


def best(vectors, queries, k):
    out = set()
    whole = {i: np.floor(64 * np.array(v, dtype=np.float64)) for i, v in vectors}
    for q in queries:
        ranked = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)}
    return out


def test_topk_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CAND_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "HELD_BLOCKS", 2)
    rng = np.random.default_rng(11)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(100)] + [(k, [1.0] * 8) for k in range(100, 160)] + [(200, [0.5, -0.25])]
    bad = [(300, None), (301, [float("nan")] * 8), (302, [float("inf")] + [0.0] * 7), (303, [None] + [0.0] * 7), (None, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    got = topk.search(df, df.where("vec_id % 20 = 0"), 5)
    assert {tuple(r) for r in got.collect()} == best(rows, [i for i, _ in rows if i % 20 == 0], 5)
    few = df.where("vec_id < 4")
    assert {tuple(r) for r in topk.search(few, few, 20).collect()} == best(rows[:4], range(4), 20)
    assert topk.search(df.limit(0), df.limit(0), 20).count() == 0


def test_topk_with_large_components(spark):
    df = spark.createDataFrame([(1, [3e38, 1.0]), (2, [1.0, 2.0]), (3, [-3e38, 5.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in topk.search(df, df.where("vec_id = 2"), 5).orderBy("rank").collect()] == [(2, 1), (2, 3)]


# licences


def test_licences(spark, docs, odd, none):
    model = license_scan.fit(spark)
    notices = [(k, f"Some words.\n{t}\nMore words.") for k, t in enumerate(t for _, own in license_scan.TEMPLATES.items() for t in own)]
    families = [f for f, own in license_scan.TEMPLATES.items() for _ in own]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(documents(spark, notices), model).collect()}
    assert np.mean([got[k] == f for k, f in enumerate(families)]) > 0.95
    others = [(k, t) for k, t in enumerate(license_scan.OTHERS)] + [(90, "Licensed under the Moon License, Version 9."), (91, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(documents(spark, others), model).collect()}
    assert got.pop(91) == "Apache-2.0,MIT" and got.pop(90) in ("none", "unknown") and set(got.values()) <= {"none", "unknown"}
    assert license_scan.scan(odd, model).count() == len(ODD) and {r["licence"] for r in license_scan.scan(odd, model).collect()} == {"none"}
    assert license_scan.scan(none, model).count() == 0
    marked = {"Apache License, Version 2.0.": "Apache-2.0", "CC BY-NC 4.0.": "CC-BY-NC", "GNU General Public License, version 3.": "GPL", "the MIT License.": "MIT"}
    for r in license_scan.scan(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["licence"] == (",".join(sorted(v for k, v in marked.items() if k in r["text"])) or "none")


@pytest.mark.parametrize("width", [32, 50, 72])
def test_wrapped_licences(spark, width):
    wrapped = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, width))
    long = [(f, t) for f, own in license_scan.TEMPLATES.items() for t in own if len(t) > width]
    rows = [(k, f"Some words about nothing.\n\n{wrapped(t, ' * ' if k % 2 else '')}\n\nMore words.") for k, (_, t) in enumerate(long)]
    both = f"{wrapped(license_scan.TEMPLATES['MIT'][2])}\n\n{wrapped(license_scan.TEMPLATES['Apache-2.0'][1])}\n\n{wrapped(license_scan.TEMPLATES['MIT'][2])}"
    short = {"MIT License": "MIT", "# SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: (GPL-2.0-or-later OR Apache-2.0)": "Apache-2.0,GPL", "    GNU AFFERO GENERAL PUBLIC LICENSE": "AGPL-3.0", "The studio of MIT has no license": "", "A license\n\nof MIT": "", "SPDX-License-Identifier: Zlib": "Zlib", "SPDX-License-Identifier: NASA-1.3": ""}
    model = license_scan.fit(spark)
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, [*rows, (100, both), *((200 + k, t) for k, t in enumerate(short)), *((300 + k, t) for k, (_, t) in enumerate(long))]), model).collect()}
    # wrapped notices are found as they are in one line
    assert [(got[k]["licence"], got[k]["n_notices"]) for k in range(len(long))] == [(got[300 + k]["licence"], got[300 + k]["n_notices"]) for k in range(len(long))]
    assert np.mean([(got[k]["licence"], got[k]["n_notices"]) == (f, 1) for k, (f, _) in enumerate(long)]) > 0.9
    assert (got[100]["licence"], got[100]["n_notices"]) == ("Apache-2.0,MIT", 3)
    for k, want in enumerate(short.values()):
        assert got[200 + k]["licence"] == want if want else got[200 + k]["licence"] in ("none", "unknown")


#: Texts written for the test, none a copy of a template: a licence granted, and licences denied, mentioned or unknown.
GRANTED = {
    "MIT": ("The code in this repository is distributed under the MIT license.", "This module, like the rest of the project,\nis released under the MIT License (see LICENSE.txt)."),
    "Apache-2.0": ("All source files are licensed under the Apache License, Version 2.0; see NOTICE.", "# Licensed to the project under the Apache\n# License, Version 2.0. You may obtain a copy of the License at\n# http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL": ("The tool is free software, licensed under the GNU General Public License, version 3 or later.", " * This file is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License"),
    "LGPL": ("The bindings are licensed under the GNU Lesser General Public License, version 2.1.", "// SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL-3.0": ("The server is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License v3"),
    "BSD": ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "Copyright 2020 the authors. Released under the BSD 3-Clause License."),
    "CC-BY": ("The photographs are licensed under CC BY 4.0.", "Text is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Our course notes are licensed under CC BY-SA 4.0.", "The map data is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Slides: licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-ND": ("The essay is licensed under CC BY-ND 4.0.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "CC0": ("The tables are released under CC0 1.0 Universal.", "CC0 1.0 Universal"),
    "ISC": ("The driver is released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears"),
    "MPL-2.0": ("The browser is licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not distributed, get one."),
    "EPL-2.0": ("The plug-in is licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0"),
    "EUPL-1.2": ("Files are licensed under the EUPL, Version 1.2.", "EUPL v 1.2"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See the file.)", "Boost Software License - Version 1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.\nAnyone is free to use it.", "The Unlicense"),
    "WTFPL": ("The script is licensed under the WTFPL, version 2.", "SPDX-License-Identifier: WTFPL"),
    "Zlib": ("The archive code is licensed under the zlib License.", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    "Artistic-2.0": ("The package is licensed under the Artistic License 2.0.", "Artistic License 2.0"),
}
NOT_GRANTED = (
    "This software is not licensed under the MIT License.", "The firmware is no longer released under\nthe GNU General Public License.", "Our data are not, and never were, published.", "She gave a lecture on the Apache License and software law.",
    "The journal reviewed the GNU General Public License in March.", "A comparison of the MIT License with the BSD License fills chapter two.", "Students at MIT released a study.", "The licence office is open until five.", "All rights reserved.",
    "Licensed under the Moon Treaty, Version 9.", "A driving license is required.", "The public domain was the subject of the debate.", "It was never distributed under the Mozilla Public\nLicense.", "The foundation renewed its mission.", "Permission to enter was granted by the guard.",
)


def test_licences_of_other_texts(spark):
    """Precision and recall on texts that are no copies of the training rows."""
    rows = [(k, f, t) for k, (f, t) in enumerate((f, t) for f, own in GRANTED.items() for t in own)]
    others = [(1000 + k, "", t) for k, t in enumerate(NOT_GRANTED)]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(documents(spark, [(k, f"First words.\n\n{t}\n\nLast words.") for k, _, t in rows + others])).collect()}
    found = [k for k, v in got.items() if v not in ("none", "unknown")]
    right = [k for k, f, _ in rows if got[k] == f]
    precision, recall = len(right) / len(found), len(right) / len(rows)
    wrong = [(t, got[k]) for k, f, t in rows + others if got[k] != f and (f or got[k] not in ("none", "unknown"))]
    print("precision", precision, "recall", recall)
    assert precision >= 0.95 and recall >= 0.9, wrong


#: Texts that speak of a licence and do not grant it, and grants of licences that are no family's and not among the learned names.
NO_GRANTS = (
    "You cannot use this under the Apache License, Version 2.0.", "The library was formerly licensed under the MIT License, but is now proprietary.", "Unlike projects released under the MIT License, ours is closed source.",
    "Is this licensed under the MIT License? No.", "Are the files\nreleased under the BSD 3-Clause License?", "It used to be distributed under the Mozilla Public License, version 2.0.", "You may not redistribute this work under the ISC License.",
)
OTHER_GRANTS = ("Licensed under the OpenSSL License.", "This software is distributed under the terms of the PostgreSQL License.", "Released under the NASA Open Source Agreement License, version 2.", "# SPDX-License-Identifier: OpenSSL", "Licensed under the Moon License.")


def test_licences_not_granted_and_unlisted(spark):
    said = {"Use of this source code is governed by an MIT-style license": "MIT", "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0"}
    texts = [*NO_GRANTS, *OTHER_GRANTS, *said, "SPDX-License-Identifier: NONE"]
    got = [r["licence"] for r in license_scan.scan(documents(spark, [(k, f"First words.\n\n{t}\n\nLast words.") for k, t in enumerate(texts)])).orderBy("doc_id").collect()]
    a, b = len(NO_GRANTS), len(NO_GRANTS) + len(OTHER_GRANTS)
    assert set(got[:a]) <= {"none", "unknown"}, got[:a]
    assert set(got[a:b]) == {"unknown"}, got[a:b]
    assert got[b:-1] == list(said.values()) and got[-1] in ("none", "unknown")


def test_licence_scores_equal_brute_force(spark):
    """Scores of one-line texts from the learned numbers, one text at a time; and the held-out copies are as right as they are sure."""
    model = license_scan.fit(spark)
    weights = {r["gram"]: np.array(r["w"]) for r in model.weights.collect()}
    marks = set(license_scan.licence_words())
    texts = [t for own in GRANTED.values() for t in own if "\n" not in t]
    got = {(r["doc_id"], r["line"]): r for r in license_scan.classified(documents(spark, list(enumerate(texts))), model).where("line = last").collect() if not (r["confirmed"] and r["score"] == 1.0)}
    assert len(got) > 15
    for (k, _), r in got.items():
        w = re.findall("[a-z0-9]+", texts[k].lower())
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        total = np.array(model.intercepts) + sum(weights[g] for g in grams if g in weights and set(g.split()) & marks)
        total[-2:] += model.offset
        share = np.exp(total - total.max())
        assert abs(r["score"] - share.max() / share.sum()) < 1e-9
    table = {r["tenth"]: r for r in license_scan.calibration(spark, model).collect()}
    assert sum(r["n"] for r in table.values()) > 100 and sum(r["n"] * r["right"] for k, r in table.items() if k >= 9) > 0.95 * sum(r["n"] for k, r in table.items() if k >= 9)


# spot signatures


def test_spot_signatures_of_odd_rows(odd, none, spark):
    rows = spotsigs.edited_fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    alone = spotsigs.edited_fingerprints(documents(spark, [(5, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone["near_next"] == 1.0
    assert spotsigs.edited_fingerprints(none).count() == 0


def test_edited_texts_over_buckets(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_A_BUCKET", 7)
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(docs).collect()}
    order = sorted(texts)
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["near_next"] == 1.0 or got[i]["fingerprint"] != got[order[(k + 1) % len(order)]]["fingerprint"]


@pytest.mark.parametrize("block", [1024, 3])
def test_spot_pairs_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", block)
    if block == 3:
        monkeypatch.setattr(spotsigs, "SETS_A_SALT", 7)
        monkeypatch.setattr(spotsigs, "SHOWN", 2)
    rng = np.random.default_rng(14)
    words = [str(w) for w in rng.choice(["the", "of", "in", *(f"w{k}" for k in range(40))], 300)]
    more = documents(spark, [(50_000 + k, edited(rng, words, share)) for k, share in enumerate(rng.uniform(0, 0.08, 40))] + [(None, "a cat sat"), (60_000, ""), (60_001, None)])
    docs = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    known = {r["doc_id"]: set(r["sigs"]) for r in spotsigs.fingerprints(docs).collect() if r["doc_id"] is not None}
    pairs, members = spotsigs.near_pairs(docs, 0.6)
    first = {r["doc_id"]: r["representative"] for r in members.collect()}
    assert all(first[i] == min(j for j in known if known[j] == known[i]) for i in known) and len(first) == len(known)
    tops = sorted(set(first.values()))
    want = {(a, b) for a, b in itertools.combinations(tops, 2) if len(known[a] & known[b]) >= 0.6 * len(known[a] | known[b])}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 100


def shuffled(spark):
    """Bytes that each stage so far has written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s := stages.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(stages.size())}


@pytest.mark.parametrize("small", [False, True])
def test_spot_links_of_a_group_of_near_copies(spark, monkeypatch, small):
    """Sets of a large group go to pairs of homes and not to their pairs, and most signatures are counted only."""
    if small:  # several homes, and frequent signatures by a sample
        for name, value in (("BLOCK_ROWS", 100), ("BLOCK_SIGS", 9000), ("SETS_A_SALT", 100), ("SAMPLED_SETS", 200)):
            monkeypatch.setattr(spotsigs, name, value)
    rng = np.random.default_rng(23)
    words = [x for k in range(150) for x in ("the", f"word{k}")]
    rows = [(k, " ".join(f"own{k}x{j}" if j % 2 and rng.random() < share else w for j, w in enumerate(words))) for k, share in enumerate(rng.uniform(0, 0.1, 300))]
    rows += [(1000 + k, " ".join(f"the other{k}y{j}" for j in range(100))) for k in range(200)] + [(2000, rows[7][1])]
    docs = documents(spark, rows)
    known = {r["doc_id"]: frozenset(r["sigs"]) for r in spotsigs.fingerprints(docs).collect()}
    first = {s: i for i, s in sorted(known.items(), reverse=True)}
    links = collections.Counter(i for a, b in itertools.combinations(first, 2) if 4 * len(a & b) >= 3 * len(a | b) for i in (first[a], first[b]))
    before = shuffled(spark)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spotsigs.near_fingerprints(docs).collect()}
    assert got == {i: (first[s], links[first[s]]) for i, s in known.items()} and sum(links.values()) > 20_000
    assert 0 < sum(b for k, b in shuffled(spark).items() if k not in before) < 4 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [4096, 4])
def test_spot_ids_that_repeat(spark, none, monkeypatch, most):
    """Null ids, one id on many rows and many equal rows are split over ranges, and few ranges into spans; every row has the next one's first half."""
    monkeypatch.setattr(spotsigs, "ROWS_A_BUCKET", 3)
    monkeypatch.setattr(spotsigs, "MOST_BUCKETS", most)
    rows = [(None, f"null text {k}") for k in range(25)] + [(7, f"text of seven {k}") for k in range(25)] + [(9, "nine nine nine")] * 60 + [(10 + 3 * k, f"spread {k}") for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, False) for i, t in rows], "doc_id long, text string, _bucket int, ghost boolean")
    ties = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in spotsigs.edited_fingerprints(df).collect()) == collections.Counter(want)
    dealt, _ = spotsigs.with_next(df)
    sizes = [r["count"] for r in dealt.where("doc_id IS NULL OR doc_id != 9").groupBy("_bucket").count().collect()]
    # spans have their range's rows at most, and a key that is one bound of few ranges those of two
    hot = max(r["count"] for r in dealt.where("doc_id = 9").groupBy("_bucket").count().collect())
    assert len(sizes) > 10 and max(*sizes, hot) < (20 if most > 4 else 2 * len(rows) / most)
    with pytest.raises(TypeError):
        spotsigs.edited_fingerprints(df.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert spotsigs.near_fingerprints(none).count() == 0


# line dedup


def without(rows, least=5, chars=40):
    blank = " \t\n\x0b\x0c\r"
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            core = line.strip(blank).translate(LOWER)
            if i is not None and len(core) >= chars:
                held.setdefault(core, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(own := held.get(x.strip(blank).translate(LOWER), ())) >= least and max(own) != i)]
        out.append((i is None, i or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def shared_lines(n):
    a, b = "A line that many documents hold, of forty and more letters", "Another line of the same kind, long enough to count as one"
    return [(k, f"own {k}\n  {a if k % 2 else a.upper()}\t\n{b if k < 5 else 'short'}\n{a}\n") for k in range(n)]


def report(frame, store=None):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_report(frame, store).collect())


@pytest.mark.parametrize("small", [False, True])
def test_lines_equal_brute_force(spark, odd, none, monkeypatch, small):
    if small:  # several shards, and several parts of each
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
        monkeypatch.setattr(line_dedup, "PART_ROWS", 4)
    rows = shared_lines(12) + ODD + [(11, shared_lines(12)[11][1]), (None, shared_lines(1)[0][1])]
    assert report(documents(spark, rows)) == without(rows)
    assert report(none) == []


def test_line_store_is_reversible(spark):
    rows = shared_lines(9)
    store = line_dedup.Store.build(documents(spark, rows[:4]))
    more = store.insert(documents(spark, rows[2:]))
    assert report(documents(spark, rows), more) == without(rows)
    back = more.delete(documents(spark, rows[4:]))
    key = lambda s: sorted(tuple(r) for r in s.counts.select("high", "low", "n_docs", "last_doc").collect())
    assert key(back) == key(store)


@pytest.mark.parametrize("shard_keys", [1 << 16, 60])
def test_edited_filters_answer_as_rebuilt_ones(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    rng = np.random.default_rng(21)
    lines = [f"line number {k} which has forty letters or more in it" for k in range(300)]
    rows = [(i, "\n".join(rng.choice(lines, 40, replace=False))) for i in range(90)]
    store = line_dedup.Store.build(documents(spark, rows[:40]))
    held = set(range(40))
    for step in range(4):
        if step % 2:
            gone = set(rng.choice(sorted(held), 25, replace=False).tolist())
            store, held = store.delete(documents(spark, [(i, "") for i in gone])), held - gone
        else:
            more = set(rng.choice(90, 35, replace=False).tolist()) - held
            store, held = store.insert(documents(spark, [rows[i] for i in more])), held | more
        frequent = store.frequent().collect()
        tables = {r["shard"]: line_dedup.CuckooFilter.load(bytes(r["filter"])) for r in store.filters.collect()}
        # a place for every frequent key and none for another
        assert sum(int((t.table > 0).sum()) for t in tables.values()) == len(frequent)
        assert all(tables[r["high"] % store.shards].contains(np.array([r["low"]])).all() for r in frequent)
        own = [rows[i] for i in sorted(held)]
        assert report(documents(spark, own), store) == without(own)


def test_cuckoo_filter():
    rng = np.random.default_rng(12)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    made = line_dedup.CuckooFilter.load(line_dedup.CuckooFilter.of(keys).dump())
    assert made.contains(keys).all() and made.contains(rng.integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.01
    assert all(made.delete(int(k)) for k in keys[:2500]) and made.contains(keys[2500:]).all()
    assert made.contains(keys[:2500]).mean() < 0.02


# all queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries.queries()[name](spark, SF).write.parquet(str(tmp_path / "o"))
    got, want = con.sql(f"SELECT * FROM '{tmp_path}/o/*.parquet'").df(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    key = lambda f: sorted(map(str, f[columns].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and key(got) == key(want)


def test_pipeline(spark, docs, library):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SF).collect()
    known = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if known[r["doc_id"]]["lang_pred"] != "und" and known[r["doc_id"]]["score"] >= 0.5)
    lines = {i: (t, h) for (i, t), (_, _, _, _, h) in zip(rows, without(rows), strict=True)}
    cut = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs.join(spark.createDataFrame([(i,) for i in lines], "doc_id long"), "doc_id")).collect()}
    assert all(hashlib.sha256(cut[i].encode()).hexdigest() == h for i, (_, h) in lines.items())
    kept = {i for i, c in components(sorted(cut.items())).items() if i == c}
    assert {p["doc_id"] for p in pieces} == kept
    assert all(p["doc_tokens"] == len(expected_ids(library, cut[p["doc_id"]])) + 1 for p in pieces)


def test_pipeline_stages_on_odd_tables(spark, docs, none):
    """Odd, repeated and clashing rows pass every stage; all but the last keep the columns; an empty table stays one."""
    import corpus_pipeline

    rows = ODD + [(i, t) for i, t in shared_lines(9)] + [(30, "The same words of a long enough text stand here twice over."), (31, "The same words of a long enough text stand here twice over.")]
    frame = documents(spark, rows).withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"), "a.b": F.create_map(F.lit("k"), F.col("doc_id"))})
    texts, seen = None, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).columns == none.columns and stage(spark, none, SF).count() == 0, name
        seen = spark.createDataFrame(stage(spark, seen, SF).collect(), frame.schema)
        assert seen.columns == frame.columns
        texts = [(r["doc_id"], r["text"]) for r in seen.collect()]
        if name == "language ID":
            letters = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
            assert {i for i, _ in texts} <= {i for i, _ in letters} and {5, 6, 9, 30, 31, None} <= {i for i, _ in texts}
            kept = texts
        if name == "line dedup":
            assert sorted((i or 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts) == sorted((i, h) for _, i, _, _, h in without(kept))
            kept = texts
    # one row of an id, and one document of a group
    same = components([(i, t) for i, t in kept])
    want = {i for i, c in same.items() if i == c}
    assert sorted(i for i, _ in texts if i is not None) == sorted(want) and any(i is None for i, _ in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert collections.Counter(p["doc_id"] for p in pieces if p["start"] == 0) == collections.Counter(i for i, _ in texts)
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0
