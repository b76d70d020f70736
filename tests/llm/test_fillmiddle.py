"""Boundary sets against sorted lists, cuts against a plain version, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from cellweave.llm import fillmiddle as fim

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@pytest.mark.parametrize(("kind", "offsets"), [
    ("array", lambda r: r.choice(1 << 16, 300, replace=False)), ("bitmap", lambda r: r.choice(1 << 16, 30_000, replace=False)),
    ("run", lambda r: np.concatenate([np.arange(5, 900), np.arange(2000, 60_000)])), ("run", lambda r: np.arange(1 << 16)),
    ("array", lambda r: np.arange(0, 8000, 2)), ("bitmap", lambda r: np.arange(0, 1 << 16, 2))])
def test_containers(kind, offsets):
    members = np.sort(offsets(np.random.default_rng(1)))
    box = fim.Container(members)
    assert box.kind == kind
    assert [box.select(k) for k in range(0, len(members), 37)] == members[::37].tolist()


def test_sets_over_many_containers():
    rng = np.random.default_rng(2)
    offsets = np.unique(np.concatenate([[0], rng.integers(0, 1 << 20, 900), np.arange(70_000, 150_000), rng.integers(200_000, 262_144, 50_000), [1 << 21]]))
    places = fim.BoundarySet(offsets)
    assert len(places) == len(offsets) and {c.kind for c in places.containers} == {"array", "bitmap", "run"}
    assert [places.select(k) for k in range(0, len(offsets), 101)] == offsets[::101].tolist() and places.select(len(offsets) - 1) == 1 << 21


def plain_version(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(UNIT, text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equal_to_a_plain_version(spark):
    rng = random.Random(3)
    bits = ["a", "bc", " ", "\n", "\t ", "é", "日本", "𝄞", "<", "<P", "P>", "<S>", "\x00", " ", " ", "{}", "<<M"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    rows += [(400, None), (401, ""), (None, "x y z"), (402, "   "), (403, "a "), (404, "w " * 200_000), (405, "x" * 300_000), (7, "b"), (7, "b"), (-5, "a b c d")]
    df = spark.createDataFrame([(d, t, "o", "f", 1, "c") for d, t in rows], "doc_id long, text string, output string, form string, n int, __cut string")
    got = fim.transform(df).collect()
    want = sorted(((d, *plain_version(d, t)) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    back = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.report(df).collect()), key=repr)
    assert back == sorted(((d, digest(plain_version(d, t)[4]), digest(t or "")) for d, t in rows), key=repr)


@pytest.mark.parametrize("units", ["chars", "lines"])
def test_other_units_come_back_whole(spark, units):
    rows = [(k, "line one\nline two\n\nend" * k) for k in range(40)]
    mix = fim.Mix(seed=7, rate=100, suffix_first=50, units=units)
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), mix)
    back = {r.doc_id: (r.n, r.form, r.t) for r in got.withColumn("t", fim.restored(got["form"], got["output"])).collect()}
    for k, text in rows:
        n = len(text) if units == "chars" else len(re.findall(r"[^\n]*\n|[^\n]+$", text))
        assert back[k][0] == n and back[k][2] == text
    assert {f for _, f, _ in back.values()} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
