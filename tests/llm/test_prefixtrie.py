"""The burst trie against a plain trie of tuples."""

import hashlib
import random
import re
import zlib

import pytest

from cellweave.llm import prefixtrie


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    new = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, seq in new.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    count = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        mine = [below[q] for q in kids.get(p, [])]
        below[p] = (sum(x for x, _ in mine) or 1, sum(y for _, y in mine) + ((len(nodes[p]) - 1) * count(p[-1][1]) if p else 0))
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if new[c] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), *below[p], ends(p)) for p, m in nodes.items())


def check(spark, rows, limit):
    df = spark.createDataFrame([(*r, b"", "x", 1) for r in rows], "conv_id long, turn long, role string, text string, head binary, heads string, n int")
    got = prefixtrie.trie(df, limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect())
    assert got == plain(rows)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(130):
        long = rng.random() < 0.3
        for turn in range(30 if long and rng.random() < 0.3 else rng.randint(1, 7)):
            role = ("user", "assistant")[turn % 2]
            text = f"shared turn {turn} of many" if long and turn < 25 or rng.random() < 0.4 else rng.choice(["a b", "c", "", None, "d \t e f"])
            rows.append((c, turn, role, text))
    rows += [(c, t, "user", "same words here") for c in range(300, 360) for t in range(4)]
    rows += [(41, None, None, "null turn"), (41, None, "", "null turn"), (None, 1, "user", "x"), (500, 0, "user", "alone"), (517, 1, "a", "b"), (517, 1, "a", "b"), (17, 3, "r", "t")]
    return rows


@pytest.mark.parametrize("limit", [1, 12, 150, 50_000])
def test_equal_to_a_plain_trie(spark, limit):
    check(spark, corpus(1), limit)


def test_many_members_of_one_string_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    check(spark, [(c, t, "u", f"t{t}") for c in range(0, 400) for t in range(2)], 5)


def test_chains_and_no_shared_root_turn(spark):
    check(spark, [(c, t, "u", f"turn {min(t, c)}") for c in range(20, 40) for t in range(c % 20)], 3)


def test_turnless_and_empty(spark):
    check(spark, [(c, 0, "u", "only") for c in range(41, 60)], 1)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(df).count() == 0
