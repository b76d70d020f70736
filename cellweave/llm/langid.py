"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed character n-grams (1 to 3, letters only, lower case, words apart), normalised to
length one. Document frequencies cover all training texts; the centroids are spherical k-means clusters of a bounded
sample, ``CLUSTERS`` per language from ``SAMPLE`` distinct texts each, or all if there are fewer. A text takes the language of the centroid
with the largest cosine. It is *rejected* if it is null or has no letter, or if the cosine falls below the floor of
the language for texts of its length: ``FLOOR`` times the cosine that all but the share ``LOW`` of the language's sampled texts reach
when cut to that length and held against centroids they have no part in. So a few odd texts don't lower it.

Only the text enters a prediction. Training rows with a null text or language are left out; without training rows every
text is ``und`` with score 0 and none is rejected but those without letters. Repeated rows weigh in the frequencies as
often as they occur, and once in the sample. Ties go to the first language in sorted order. Other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 13
DIMS = 1 << BITS
CLUSTERS = 4
SAMPLE = 1000
FLOOR, LOW = 0.6, 0.05
CUTS = (25, 50, 100, 200, 400)  # characters; the last class of lengths is the whole text
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

_spaces = np.arange(128, dtype=np.uint32)
for _c in range(128):
    if not chr(_c).isalpha():
        _spaces[_c] = 32


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a text's letters; runs of anything else in ASCII are one blank."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(code < 128, _spaces[np.minimum(code, 127)], code)
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    one = code * np.uint32(2654435761)
    two = (one[:-1] ^ (code[1:] + np.uint32(0x9E37))) * np.uint32(2246822519)
    three = (two[:-1] ^ (code[2:] + np.uint32(0x79B9))) * np.uint32(3266489917)
    return np.bincount(np.concatenate([one, two, three]) >> np.uint32(32 - BITS), minlength=DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for k, t in enumerate(texts):
        n = counts(t)
        at = np.flatnonzero(n)
        v = (1 + np.log(n[at])) * idf[at]
        length = np.sqrt((v * v).sum())
        if length > 0:
            out[k, at] = v / length
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are drawn with a row's distance from all starts so far as its weight, so where texts are many."""
    rng = np.random.default_rng(len(x))
    starts = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        weight = np.maximum(1 - near.astype(float), 1e-9)
        weight[starts] = 0
        starts.append(int(rng.choice(len(x), p=weight / weight.sum())))
        near = np.maximum(near, x @ x[starts[-1]])
    centre = x[starts]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32)


def floors(texts: list[str], x: np.ndarray, centre: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each of ``CUTS`` and for whole texts, what is asked of a text of that length."""
    own = (x @ centre.T).argmax(axis=1)
    sums = np.stack([x[own == j].sum(axis=0) for j in range(len(centre))])
    rest = sums[own] - x  # a text's own cluster without it
    length = np.linalg.norm(rest, axis=1)
    out = []
    for cut in (*CUTS, None):
        v = x if cut is None else vectors([t[:cut] for t in texts], idf)
        cos = v @ centre.T
        cos[np.arange(len(v)), own] = (v * rest).sum(axis=1) / np.where(length > 1e-3, length, np.inf)
        known = [k for k, t in enumerate(texts) if cut is None or LETTER.search(t[:cut])]
        out.append(FLOOR * max(0.0, float(np.quantile(cos[known].max(axis=1), LOW))) if known else 0.0)
    return np.minimum.accumulate(out[::-1])[::-1]  # never more of a shorter text


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray  # one row for each entry of langs
    floors: np.ndarray  # for each entry of langs, by length: CUTS, then whole texts

    def floor(self, k: int, text: str) -> float:
        """That of the longest cut the text reaches; below the first cut it falls with the root of the length."""
        n = len(text)
        return float(self.floors[k, max(0, sum(n >= c for c in CUTS) - 1 + (n >= 2 * CUTS[-1]))]) * min(1.0, n / CUTS[0]) ** 0.5

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        known = [t for t in texts if t and LETTER.search(t)]
        lang, score, rejected = [], [], []
        if known and self.langs:
            cos = vectors(known, self.idf) @ self.centroids.T
            top = cos.argmax(axis=1)
            found = iter(zip(top, cos[np.arange(len(top)), top], strict=True))
        for t in texts:
            if not (t and LETTER.search(t)):
                lang.append(UNKNOWN), score.append(0.0), rejected.append(True)
            elif not self.langs:
                lang.append(UNKNOWN), score.append(0.0), rejected.append(False)
            else:
                k, c = next(found)
                lang.append(self.langs[k]), score.append(min(1.0, max(0.0, float(c))))
                rejected.append(bool(c < self.floor(k, t)))
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per n-gram bin and task: in how many texts it occurs. Bin -1 counts the texts."""
    seen, n = np.zeros(DIMS, dtype=np.int64), 0
    for b in batches:
        for t in b["text"]:
            seen += counts(t) > 0
            n += 1
    yield pd.DataFrame({"bin": np.arange(-1, DIMS), "n": np.concatenate([[n], seen])})


def fit(labelled: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Model of the rows ``(text, lang)`` whose text and language are not null."""
    spark = labelled.sparkSession
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    found = rows.select("text").mapInPandas(_frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1)
    for r in found:
        df[r.bin + 1] = r.n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    # Distinct texts are counted, so a copy changes nothing. A share a little above SAMPLE (ten standard deviations) is drawn by
    # the place of a text's hash; the SAMPLE smallest places go on, so no language has fewer while it has the texts.
    lettered = rows.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]")).withColumn("h", F.xxhash64("text"))
    sizes = lettered.select("lang", "h").distinct().groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(sample + 10 * sample ** 0.5 + 100) / F.col("count"))
    drawn = lettered.withColumn("place", F.pmod("h", F.lit(1 << 40))).join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(
        F.col("place") < F.col("share") * (1 << 40)).groupBy("lang", "place", "h").agg(F.first("text").alias("text"))
    shared = spark.sparkContext.broadcast(idf)

    def one_language(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf.sort_values(["place", "h"])["text"] if LETTER.search(t)][:sample]
        if not texts:
            return pd.DataFrame({"lang": [], "k": [], "centroid": [], "floors": []})
        x = vectors(texts, shared.value)
        centre = cluster(x, clusters)
        asked = floors(texts, x, centre, shared.value).tolist()
        return pd.DataFrame([(pdf["lang"].iloc[0], j, c.tobytes(), asked) for j, c in enumerate(centre)], columns=["lang", "k", "centroid", "floors"])

    got = drawn.groupBy("lang").applyInPandas(one_language, "lang string, k int, centroid binary, floors array<double>").collect()
    got.sort(key=lambda r: (r.lang, r.k))
    centre = np.stack([np.frombuffer(r.centroid, dtype=np.float32) for r in got]) if got else np.zeros((0, DIMS), np.float32)
    return Model(idf, [r.lang for r in got], centre, np.array([r.floors for r in got]))


def _found(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        values = [None if t is None else str(t) for t in texts]
        return pd.concat([shared.value.predict(values[k:k + 256]) for k in range(0, len(values), 256)] or [shared.value.predict([])])

    return docs.withColumn("__found", predicted("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` at the end; they replace columns of the same names."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return _found(docs, model).select(
        *own, F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"), F.col("__found.rejected").alias("rejected"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not rejected."""
    return _found(docs, model).where("not __found.rejected").drop("__found")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out()).select("text", "lang")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(training_rows(docs))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).drop("text")
