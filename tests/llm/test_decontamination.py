"""Benchmark passages against brute force over word lists."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from fluorspark.llm import decontamination as dc
from fluorspark.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "s", "i") for r in rows], "doc_id long, text string, key string, n_words int, spans string, items string")


def items(spark, rows):
    return spark.createDataFrame([(*r, "p", 3) for r in rows], "item_id long, text string, pattern string, size int")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, tests, width=10):
    wanted = {}
    for i, t in tests:
        w = words(t)
        if i is not None and w:
            n = min(width, len(w))
            for k in range(len(w) - n + 1):
                wanted.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                ids = wanted.get(tuple(w[k : k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(spark, docs, tests):
    return sorted(map(tuple, dc.report(documents(spark, docs), items(spark, tests)).collect()), key=str)


def corpus(seed, n=40):
    """Few words, so that windows overlap, repeat and share words."""
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "naïve", "日本", "x1", "B", "and"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", "\x00", ", "]) for _ in range(k))
    tests = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for k in range(12)]
    docs = [(k, text(rng.randrange(0, 60)) + (rng.choice(tests)[1] if rng.random() < 0.5 else "")) for k in range(n)]
    return docs, tests


@pytest.mark.parametrize(("seed", "shard", "chunk"), [(1, 2_000_000, 1 << 20), (2, 300, 16), (3, 60, 7), (4, 100_000, 5)])
def test_report_equals_brute_force(spark, monkeypatch, seed, shard, chunk):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    monkeypatch.setattr(dc, "CHUNK", chunk)
    docs, tests = corpus(seed)
    assert made(spark, docs, tests) == brute(docs, tests)


@pytest.mark.parametrize("shard", [2_000_000, 20_000])
def test_report_of_the_table(spark, monkeypatch, shard):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    docs, tests = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = dc.report(docs, tests).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in tests.collect()])
    assert sorted(map(tuple, got), key=str) == want and any(r["contaminated"] for r in got)


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_odd_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, passage), (1, passage), (None, "x " + passage.upper()), (2, None), (3, ""), (4, " \n\x7f~"), (5, "word " * 200_000 + passage), (6, "ÉCOLE école Straße"), (7, "two three"), (8, "at wo threes")]
    tests = [(10, passage), (9, passage), (9, "two three"), (None, "école"), (11, None), (12, "--"), (13, "É\u0000COLE"), (13, "É\u0000COLE")]
    assert made(spark, docs, tests) == brute(docs, tests)


def test_nothing_to_find_and_nothing_to_search(spark):
    docs = [(1, "some text"), (2, None)]
    assert made(spark, docs, []) == brute(docs, [])
    assert made(spark, [], [(1, "some text")]) == []


@pytest.mark.parametrize("shard", [2_000_000, 30])
def test_spans_point_into_the_original_text(spark, monkeypatch, shard):
    monkeypatch.setattr(dc, "SHARD_BYTES", shard)
    docs, tests = corpus(9)
    wanted = dict(docs)
    for r in dc.contamination(documents(spark, docs), items(spark, tests)).collect():
        text, whole = wanted[r["doc_id"]], words(wanted[r["doc_id"]])
        last = -1
        for s in r["spans"]:
            assert s["first_word"] > last
            last = s["first_word"] + s["n_words"]
            assert words(text[s["start"] : s["end"]]) == whole[s["first_word"] : last]
            assert WORD.match(text[s["start"]].translate(LOWER)) and WORD.match(text[s["end"] - 1].translate(LOWER))
