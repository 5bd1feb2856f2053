"""Language identification: nearest of several centroids per language, over TF-IDF n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm.common import hash_sample

DIMS = 1 << 12            # hashed n-grams
SAMPLE_PER_LANG = 1500    # rows that a language's centroids are fitted on, at most
CENTROIDS = 4
KMEANS_ROUNDS = 12
REJECT_AT = 0.12          # a cosine below it is too far from every centroid
UNKNOWN = "und"
CHUNK = 1 << 20           # characters whose n-grams are hashed at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of a text; None if it has no letter.

    Case is ignored, runs of other characters count as one blank. The whole text is read, in chunks
    that overlap by two characters.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]                        # the first other character after a letter stays, as a blank
    points = np.where(letter, points, 32)[kept]
    points = np.concatenate(([32], points, [32] if points[-1] != 32 else [])).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    shift, m1, m2, m3 = np.uint32(20), np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    for i in range(0, len(points), CHUNK):
        p = points[i:i + CHUNK + 2]
        own = min(CHUNK, len(points) - i)
        one = p * m1
        two = one[:-1] ^ (p[1:] * m2 + np.uint32(1))
        three = two[:-1] ^ (p[2:] * m3 + np.uint32(2))
        for grams in (one, two, three):
            counts += np.bincount(((grams[:own] ^ (grams[:own] >> np.uint32(15))) * m1) >> shift, minlength=DIMS)
    return counts


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.linalg.norm(v) or 1.0)


@dataclass
class LanguageModel:
    """Centroids (rows of unit length) and the language of each; bounded by languages x CENTROIDS."""
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid (0 to 1), and whether it is too far away."""
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        near = self.centroids @ _vector(counts, self.idf)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.langs[best], score, score < REJECT_AT


def _document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n = np.zeros(DIMS + 1, np.int64), 0
    for rows in batches:
        for text in rows["text"]:
            counts = ngram_counts(text)
            if counts is not None:
                df[:-1] += counts > 0
                n += 1
    df[-1] = n
    yield pd.DataFrame({"gram": np.arange(DIMS + 1), "df": df})


def _sparse(texts: pd.Series) -> pd.DataFrame:
    """Counts of each text's n-grams, ``DIMS`` at most however long it is; none without a letter."""
    rows = []
    for counts in map(ngram_counts, texts):
        at = np.zeros(0, np.int64) if counts is None else np.flatnonzero(counts)
        rows.append((at.astype(np.int32), counts[at] if len(at) else at))
    return pd.DataFrame(rows, columns=["at", "n"])


def _centroids(idf: np.ndarray):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over one language's sample; starts far apart, so the result is fixed."""
        rows = rows.sort_values("doc_id")
        x = np.zeros((len(rows), DIMS), np.float32)
        for k, (at, n) in enumerate(zip(rows["at"], rows["n"])):
            counts = np.zeros(DIMS, np.int64)
            counts[at] = n
            x[k] = _vector(counts, idf)
        centers = [x.mean(axis=0)]
        for _ in range(min(CENTROIDS, len(x)) - 1):
            centers.append(x[np.max(x @ np.array(centers).T, axis=1).argmin()])
        c = np.array(centers)
        for _ in range(KMEANS_ROUNDS):
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            own = (x @ c.T).argmax(axis=1)
            for k in set(own.tolist()):
                c[k] = x[own == k].mean(axis=0)
        c = c[sorted(set(own.tolist()))]
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": range(len(c)), "vector": list(c.astype(float))})
    return fit


def _sample(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, lang, at, n of the rows whose doc_id is in ``ids``: at most SAMPLE_PER_LANG numbers for each language, a bounded table.

    To the planner the counts are not deterministic: else it would count in the filter and again after it, with two workers a task.
    """
    counted = F.pandas_udf(_sparse, "at array<int>, n array<bigint>").asNondeterministic()("text")
    return (rows.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", F.xxhash64("text").alias("h"), counted.alias("f"))
            .filter("size(f.at) > 0").groupBy("doc_id", "lang").agg(F.min_by("f", "h").alias("f")).select("doc_id", "lang", "f.*"))


def fit_languages(rows: DataFrame) -> LanguageModel:
    """Learn from ``rows`` (doc_id, text, lang); rows without lang or text are left out.

    Document frequencies cover all rows. Centroids are fitted on ``SAMPLE_PER_LANG`` rows of each
    language, those with the smallest hash of doc_id; one task fits one language and gets the sample's
    counts, not its texts. Of rows that share doc_id and lang, the one whose text has the smallest hash counts.
    The driver gets DIMS frequencies and CENTROIDS vectors per language.
    """
    rows = rows.filter("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = (rows.select("text").mapInPandas(_document_frequency, "gram int, df long")
              .groupBy("gram").agg(F.sum("df").alias("df")).collect())
    df = np.zeros(DIMS + 1)
    for r in counts:
        df[r.gram] = r.df
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = hash_sample(rows.select("doc_id", "lang"), "doc_id", SAMPLE_PER_LANG, ["lang"]).withColumn("n", F.row_number().over(first)).filter(
        F.col("n") <= SAMPLE_PER_LANG).select("doc_id").distinct()
    sample = _sample(rows, ids)
    fitted = sample.groupBy("lang").applyInPandas(
        _centroids(idf), "lang string, centroid int, vector array<double>").collect()
    fitted = sorted(fitted, key=lambda r: (r.lang, r.centroid))
    vectors = np.array([r.vector for r in fitted]).reshape(len(fitted), DIMS)
    return LanguageModel(idf, vectors, [r.lang for r in fitted])


def predict_languages(docs: DataFrame, model: LanguageModel, into: str = "prediction") -> DataFrame:
    """All columns of ``docs`` and ``into``: struct(lang_pred, score, rejected).

    Null texts and texts without a letter are ``und`` with score 0 and rejected. A text whose cosine
    to all centroids is below ``REJECT_AT`` keeps its nearest language and is rejected. Ties go to
    the language first in order. An empty model predicts ``und``.
    """
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])
    return docs.withColumn(into, F.pandas_udf(of, "lang_pred string, score double, rejected boolean")("text"))
