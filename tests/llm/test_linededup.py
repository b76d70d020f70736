"""Line dedup against a brute-force search for earlier copies."""

import hashlib
import random

from cellweave.llm import linededup


def brute(rows, least):
    """Deleted line numbers of each (doc_id, text), by trying all earlier starts."""
    docs = sorted({(d is not None, d, hashlib.md5(t.encode()).digest(), t) for d, t in rows if t is not None}, key=lambda x: (x[0], x[1] or 0, x[2]))
    lines = [t.split("\n") for *_, t in docs]
    starts = [(a, i) for a in range(len(lines)) for i in range(len(lines[a]))]
    gone = {(d[1], d[3]): set() for d in docs}
    for n, (a, i) in enumerate(starts):
        best = 0
        for b, j in starts[:n]:
            k = 0
            while i + k < len(lines[a]) and j + k < len(lines[b]) and lines[a][i + k] == lines[b][j + k]:
                k += 1
            best = max(best, k)
        if best and sum(len(x.split()) for x in lines[a][i:i + best]) >= least:
            gone[docs[a][1], docs[a][3]] |= set(range(i, i + best))
    return gone


def check(spark, rows, least):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    want = brute(rows, least)
    got = linededup.report(df, least).collect()
    assert len(got) == len(rows)
    digests = {}
    for d, t in rows:
        kept = [] if t is None else [x for k, x in enumerate(t.split("\n")) if k not in want[d, t]]
        digests.setdefault(d, set()).add((0 if t is None else len(t.split("\n")), 0 if t is None else len(want[d, t]), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    for r in got:
        assert (r.n_lines, r.n_deleted, r.kept_sha256) in digests[r.doc_id]
    kept = linededup.delete_repeated_lines(df, least)
    assert kept.columns == ["doc_id", "text", "spans"]
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    expect = []
    for d, t in rows:
        left = t if t is None or not want[d, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d, t])
        if t is None or not want[d, t] or left.strip():
            expect.append((d is not None, d or 0, left or ""))
    assert texts == sorted(expect)


def test_runs_of_any_length(spark):
    rng = random.Random(3)
    words = ["a b c", "d", "e f", "", "g h i j", "k"]
    rows = [(k, "\n".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for k in range(14)]
    rows += [(20, rows[3][1]), (21, rows[3][1] + "\nnew line here"), (22, "\n".join(["d"] * 11)), (22, rows[0][1]), (20, rows[3][1])]
    check(spark, rows, 5)


def test_nulls_empty_and_repeated_rows(spark):
    check(spark, [(1, None), (None, "one two three\nfour"), (2, "one two three\nfour"), (3, ""), (4, ""), (2, "one two three\nfour")], 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert linededup.report(df).count() == 0
    assert linededup.delete_repeated_lines(df).count() == 0


def test_many_runs_in_one_document(spark):
    lines = [f"one two three four five six {k}" for k in range(12_000)]
    mixed = [x for k, line in enumerate(lines) for x in ((line, f"own {k}") if k % 2 else (line,))]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(mixed))], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.report(df, 6).collect()}
    assert (got[1].n_deleted, got[2].n_lines, got[2].n_deleted) == (0, 18_000, 12_000)
    assert got[2].spans.count(":") == 6_000 and got[2].kept_sha256 == hashlib.sha256("\n".join(x for x in mixed if x[:3] == "own").encode()).hexdigest()
