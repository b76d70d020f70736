"""Substring dedup against a brute-force search for earlier windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from cellweave.llm import recompress, substring


def brute(rows, width):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for a in range(len(w) - width + 1):
                g = tuple(w[a:a + width])
                low[g] = min(low.get(g, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(w) - width + 1):
            if d is not None and low[tuple(w[a:a + width])] < d:
                gone |= set(range(a, a + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed, vocab, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocab)] + ["é", "日本", "\x00", "W0"]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.randint(8, 70)) for _ in range(6)] + [["na"] * 60, ["x", "y"] * 40]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += rng.choice([text(rng.randint(0, 40)), p, p[a:], p[:len(p) - a]])
        rows.append((rng.choice([k, k, k, 7]), rng.choice([" ", "\n", "\t \r"]).join(parts)))
    return rows + [(100, None), (None, rows[5][1]), (101, ""), (102, " \n"), (0, rows[5][1]), (103, rows[5][1]), (103, rows[5][1]), (104, rows[9][1] + " tail")]


@pytest.mark.parametrize(("seed", "vocab", "width"), [(1, 400, 20), (2, 3, 20), (3, 400, 50), (4, 1, 30), (5, 12, 2)])
def test_equal_to_brute_force(spark, seed, vocab, width):
    rows = corpus(seed, vocab)
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, doc int, th string, spans int")
    want = brute(rows, width)
    got = substring.report(df, width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    cut = substring.remove_repeats(df, width)
    assert cut.columns == df.columns
    expect = [(d, t if not gone else kept) for (d, t), (_, _, gone, _, kept) in zip(rows, want, strict=True)]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(expect, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.report(df).count() == 0 and substring.remove_repeats(df).count() == 0


def test_more_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring, "FEW_KEYS", 0)
    rows = corpus(6, 50)
    got = substring.report(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted((w[:4] for w in brute(rows, 20)), key=repr)


def windows_of(texts, width):
    text, at, n, name, _ = recompress.window_groups(recompress.Words(texts), width)
    return {(t, a + k): x for t, a, c, x in zip(text, at, n, name, strict=True) for k in range(c)}


@pytest.mark.parametrize("vocab", [1, 2, 5, 300])
def test_equal_windows_have_equal_names(vocab):
    rng = random.Random(vocab)
    texts = [[f"t{rng.randrange(vocab)}" for _ in range(rng.randint(0, 300))] for _ in range(12)]
    texts += [a[:len(a) // 2] + b[len(b) // 2:] for a, b in zip(texts, texts[1:], strict=False)] + [["a", "b", "c"] * 60, ["b", "c", "a"] * 60 + ["q"] * 90]
    names = windows_of([" ".join(t).encode() for t in texts], 25)
    assert len(names) == sum(max(0, len(t) - 24) for t in texts)
    by_words = {}
    for (t, a), name in names.items():
        assert by_words.setdefault(tuple(texts[t][a:a + 25]), name) == name


def test_pieces_of_a_long_text_give_the_same_names(monkeypatch):
    rng = random.Random(8)
    text = " ".join(f"t{rng.randrange(40)}" for _ in range(3000)).encode()
    whole = windows_of([text], 50)
    monkeypatch.setattr(substring, "PIECE", 1000)
    parts = {}
    for first, piece in substring.pieces(text, 50):
        got = windows_of([piece], 50)
        assert not parts.keys() & {(0, first + a) for _, a in got}
        parts |= {(0, first + a): x for (_, a), x in got.items()}
    assert parts == whole


def test_names_follow_the_words():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(5000)]
    w = recompress.Words([b" ".join(words)])
    names = w.names[1:-1]
    by_word = {}
    for x, n in zip(words, names.tolist(), strict=True):
        assert by_word.setdefault(x, n) == n
    assert len(set(by_word.values())) == len(by_word)
