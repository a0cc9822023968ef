"""Vector codes against plain Lloyd rounds over Python numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, v string, codes string, bounds int, error int, sums long, _l int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2, 3, 4) for r in rows], SCHEMA)


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    dim = len(first[min(first)])
    kept = [r for r in kept if len(r[1]) == dim]
    width = dim // parts
    books = [[first[i][p * width : (p + 1) * width] for i in sorted(i for i in first if len(first[i]) == dim)[:entries]] for p in range(parts)]
    for k in range(rounds + 1):
        coded = []
        for _, v, _ in kept:
            pieces = [v[p * width : (p + 1) * width] for p in range(parts)]
            coded.append([min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p])) for p, x in enumerate(pieces)])
        if k < rounds:
            for p in range(parts):
                for n in range(len(books[p])):
                    own = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(kept, coded, strict=True) if c[p][1] == n]
                    if own:
                        books[p][n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in coded]
    of = {}
    for (_, _, l), e in zip(kept, errors, strict=True):
        of[l] = of.get(l, 0) + e
    return sorted(((i, "".join(f"{n:02x}" for _, n in c), min(e, 2**63 - 1), min(of[l], 2**63 - 1), sha) for (i, _, l), c, e in zip(kept, coded, errors, strict=True)), key=str)


def made(spark, rows, *sizes):
    return sorted(map(tuple, vc.compress(table(spark, rows), *sizes).collect()), key=str)


def vectors(seed, n, dim, scale=1.0, coarse=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, scale, (n, dim))
    x = np.round(x * 4) / 4 if coarse else x
    return [(int(i), [float(a) for a in v], int(l) if l else None) for i, v, l in zip(rng.permutation(n), x, rng.integers(0, 4, n), strict=True)]


@pytest.mark.parametrize(("n", "dim", "sizes", "coarse"), [(400, 32, (16, 64, 2), False), (300, 12, (4, 20, 5), True), (30, 16, (16, 64, 2), True), (200, 6, (2, 9, 3), False)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dim, sizes, coarse):
    monkeypatch.setattr(vc, "ROWS", 37)
    rows = vectors(n, n, dim, coarse=coarse)
    assert made(spark, rows, *sizes) == brute(rows, *sizes)


def test_odd_vectors(spark):
    good = vectors(1, 40, 8)
    odd = [(None, [0.5] * 8, 3), (100, None, 1), (101, [None] * 8, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] * 8, 1), (104, [0.1] * 7, 1), (105, [], 1), (3, [-9.0] * 8, 2), (3, [-9.0] * 8, 2), (106, [-1e-9] * 8, None)]
    assert made(spark, good + odd, 4, 8, 2) == brute(good + odd, 4, 8, 2)


def test_large_components(spark):
    rows = [(k, [x * (-1) ** k for x in (2.0**40 + k * 2.0**20, 3.0 + k, 2.0**50, k / 7)], k % 3) for k in range(30)]
    assert made(spark, rows, 2, 5, 2) == brute(rows, 2, 5, 2)
    assert len(made(spark, [(k, [1e300, -1e300], 1) for k in range(3)], 1, 2, 1)) == 3


def test_no_vectors_and_no_codebook(spark):
    want = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for rows in ([], [(None, [1.0] * 4, 1)], [(1, [], 1)], [(1, [1.0] * 5, 1)]):
        frame = vc.compress(table(spark, rows), 2, 4, 1)
        assert frame.collect() == [] and frame.columns == want


def test_many_labels(spark, monkeypatch):
    rows = vectors(5, 90, 8)
    want = made(spark, rows, 4, 8, 1)
    monkeypatch.setattr(vc, "MOST_LABELS", 1)
    assert made(spark, rows, 4, 8, 1) == want == brute(rows, 4, 8, 1)


def test_groups_are_passed_over():
    rng = np.random.default_rng(2)
    centres = rng.integers(-20_000, 20_000, (64, 4))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-300, 300, (3000, 4))
    book = x[:64].copy()
    groups = vc.grouped(book[None])[0]
    code, _, lower = vc.first_codes(x, book, groups)
    share = []
    for _ in range(4):
        new = np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(64)])
        drift = np.sqrt(np.square((new - book).astype(float)).sum(axis=1))
        book = new
        code, best, lower, taken = vc.next_codes(x, book, groups, drift, code, lower)
        whole = np.square((x[:, None] - book[None]).astype(float)).sum(axis=2)
        assert (code == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()
        share.append(taken / whole.size)
    assert share[-1] < 0.3


def test_decoded_vectors_are_the_entries(spark):
    rows = vectors(6, 60, 8)
    coded, books = vc.train(table(spark, rows), 4, 16, 2)
    got = {r["vec_id"]: r["approx"] for r in vc.decoded(coded, books).collect()}
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    for i, v, _ in rows:
        assert sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(v, got[i], strict=True)) == errors[i]


def test_floats_and_clashing_columns(spark):
    rows = [(k, [k / 3, -k / 7], None) for k in range(20)]
    frame = table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    exact = [(i, [float(np.float32(a)) for a in v], l) for i, v, l in rows]
    assert sorted(map(tuple, vc.compress(frame, 2, 4, 2).collect()), key=str) == brute(exact, 2, 4, 2)
