"""The pipeline over a small table against plain versions of its stages."""

import random
import re

import corpus_pipeline
from cellweave.llm import packing
from cellweave.llm.queries import byte_bpe

from test_linededup import brute
from test_operators import brute_components


def test_run(spark, tmp_path):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "klmn" for b in "aeio" for c in ("r", "st", "nd")]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(14)) for _ in range(n))
    passage = " ".join(rng.choice(vocab) for _ in range(12))
    rows = [(k, text(5)) for k in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1].replace("\n", " ")), (42, text(1) + " " + passage), (43, None), (44, "12 34"), (45, rows[5][1] + "\n" + text(3)), (46, rows[4][1].replace("\n", "  "))]
    docs = [(k, t, "xx", "s", len(t or ""), 0.5, "r", "p", "k", 1, "d", "n", 2, 3, None) for k, t in rows]
    clashing = "score double, rejected string, lang_pred string, key string, node int, digest string, name string, pos int, rank int, spans string"
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(k, t) for k, t in rows if t and re.search("[a-z]", t)]
    gone = brute(left, 10)
    cut = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t])) for k, t in left]
    cut = [(k, t) for k, t in cut if t.strip()]
    alone = {k for k, _, c in brute_components(cut, 5, 80) if k == c}
    windows = {" ".join(passage.split()[a:a + 10]) for a in range(3)}
    clean = [(k, t) for k, t in cut if k in alone and not any(w in " ".join(re.findall("[a-z]+", t)) for w in windows)]
    assert {40, 42, 43, 44}.isdisjoint(k for k, _ in clean) and 46 not in dict(clean) and 45 in dict(clean)
    encode = packing.Encoder(byte_bpe()[0])
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(encode(t)) + 1 for k, t in clean}
    assert got.groupby("sequence_id").length.sum().max() <= 2048
