"""The prefix trie against a trie of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from fluorspark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, parent long, size long, label string, part int, shard string, left string"


def table(spark, rows):
    """Turns with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "n", 1, 2, 3, "l", 4, "s", "x") for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        leader = c - int(np.fmod(c, 100))
        path = own.get(leader, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    out = []
    for path, found in members.items():
        inside = [q for q in members if q[: len(path)] == path]
        has_child = {q[:-1] for q in inside if q}
        ends = ",".join(map(str, sorted(c for c, e in found if e)))
        out.append((
            min(c for c, _ in found), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(found), sum(len(q) == len(path) + 1 for q in inside),
            sum(q not in has_child for q in inside), sum((len(members[q]) - 1) * len(q[-1][1]) if q else 0 for q in inside), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(spark, rows):
    return sorted(map(tuple, ct.report(table(spark, rows)).collect()), key=str)


def random_rows(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(0, 9)):
            rows.append((c * 7, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc é😀"])))
    return rows


@pytest.mark.parametrize(("seed", "shard", "batch", "piece"), [(1, 50_000, 20_000, 4096), (2, 5, 1, 2), (3, 20, 30, 3), (4, 0, 10, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, shard, batch, piece):
    monkeypatch.setattr(ct, "SHARD_ROWS", shard)
    monkeypatch.setattr(ct, "TRIE_ROWS", batch)
    monkeypatch.setattr(ct, "PIECE", piece)
    rows = random_rows(seed)
    assert made(spark, rows) == brute(rows)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD_ROWS", 50)
    rows = [(c, t, "user", f"turn {t}") for c in range(300, 400) for t in range(7)]
    rows += [(1100, t, "user", f"step {t % 3}") for t in range(150)]
    assert made(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, None, None), (1, None, None, None), (1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "assistant", "z"), (1, -2, "user", ""),
        (-250, 0, "user", "under zero"), (-200, 0, "u", "leads"), (9_223_372_036_854_775_807, 0, "u", "last"), (5, 0, "ab", "c"), (6, 0, "a", "bc"), (7, 0, "u", "x" * 200_000), (100, 1, "u", "y"),
    ]
    assert made(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert made(spark, []) == [] and ct.report(table(spark, [])).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_bitvector_of_a_small_forest():
    # shards 1 (children 3, 4; 5 under 4) and 2 (child 6), given out of order, the second one starting deeper
    keys = np.array([(0, k) for k in range(8)], dtype=[("hi", np.uint64), ("lo", np.uint64)])
    node, parent, depth = [5, 1, 6, 2, 4, 3], [4, 0, 2, 7, 1, 1], [3, 1, 4, 3, 2, 2]
    trie = ct.Louds(np.array(depth), keys[node], keys[parent], np.array([False, True, False, True, False, False]))
    assert [node[k] for k in trie.order] == [1, 2, 3, 4, 6, 5]
    assert "".join("01"[int(b)] for b in trie.bits) == "110" "110" "10" "0" "10" "0" "0"
    assert trie.parents().tolist() == [0, 0, 1, 1, 2, 4] and trie.degrees().tolist() == [2, 2, 1, 0, 1, 0, 0]
    assert trie.rolled(np.ones(6, np.int64)).tolist() == [4, 2, 1, 2, 1, 1]
