"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import hash_sample

WORD_DIMS = 1 << 13       # hashed words
STATS = ("bias_length", "upper", "digit", "symbol", "space", "word_length", "long_word", "distinct_words",
         "top_word", "distinct_lines", "line_length", "stop_end", "capital_start", "short", "repeat_next", "pipes")
SIZE_BINS = 24            # metadata: powers of two of characters and of lines
DIMS = WORD_DIMS + len(STATS) + 2 * SIZE_BINS
FACTORS = 8
TRAIN_ROWS = 4000         # labelled rows the model is fitted on, at most
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.02, 1e-5
PREDICT_AT = 0.7


def _structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares between 0 and 1 that describe the form of a text."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    upper, digit = sum(map(str.isupper, text)), sum(map(str.isdigit, text))
    space, letter = sum(map(str.isspace, text)), sum(map(str.isalpha, text))
    ends = sum(x[-1] in ".!?" for x in words)
    return [min(1.0, np.log1p(n) / 14), upper / n, digit / n, max(0, n - letter - digit - space) / n, space / n,
            min(1.0, letter / w / 12), sum(len(x) > 25 for x in words) / w, len(counts) / w,
            max(counts.values(), default=0) / w, len(set(lines)) / len(lines),
            min(1.0, np.log1p(n / len(lines)) / 10), ends / w, sum(x[0].isupper() for x in words) / w,
            float(len(words) < 8), sum(a == b for a, b in zip(words, words[1:])) / w, text.count("|") / w]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's features, indexes ascending. Word values have length 1 together."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    hashed = np.zeros(WORD_DIMS)
    crc = zlib.crc32
    slots = np.fromiter((crc(x.encode("utf-8", "surrogatepass")) for x in counts), np.int64, len(counts)) % WORD_DIMS
    np.add.at(hashed, slots, np.log1p(np.fromiter(counts.values(), np.float64, len(counts))))
    hashed /= np.linalg.norm(hashed) or 1.0
    stats = np.array(_structure(text, words, counts))
    sizes = np.zeros(2 * SIZE_BINS)
    sizes[min(SIZE_BINS - 1, len(text).bit_length())] = 1
    sizes[SIZE_BINS + min(SIZE_BINS - 1, (text.count("\n") + 1).bit_length())] = 1
    x = np.concatenate([hashed, stats, sizes])
    at = np.flatnonzero(x)
    return at.astype(np.int32), x[at].astype(np.float32)


@dataclass
class FactorisationMachine:
    """bias + w.x + sum of pairwise <v_i, v_j> x_i x_j, the last in linear time:
    half of (the square of the sum minus the sum of the squares), for each factor."""
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        parts = self.factors[at] * x[:, None]
        pairs = (parts.sum(axis=0) ** 2 - (parts ** 2).sum(axis=0)).sum() / 2
        return float(self.bias + self.weights[at] @ x + pairs)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 17) -> FactorisationMachine:
    """Logistic loss, Adam steps over shuffled batches; without both labels a constant model."""
    y = np.array(labels, np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    theta = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(DIMS), "v": rng.normal(0, 0.05, (DIMS, FACTORS))}
    if len(set(labels)) < 2:
        return FactorisationMachine(float(theta["b"][0]), theta["w"], np.zeros((DIMS, FACTORS)))
    m, s = ({k: np.zeros_like(t) for k, t in theta.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            own = order[i:i + BATCH]
            x = np.zeros((len(own), DIMS))
            for k, j in enumerate(own):
                x[k, rows[j][0]] = rows[j][1]
            inner = x @ theta["v"]
            pairs = (inner ** 2 - (x ** 2) @ (theta["v"] ** 2)).sum(axis=1) / 2
            error = 1 / (1 + np.exp(-np.clip(theta["b"][0] + x @ theta["w"] + pairs, -30, 30))) - y[own]
            error /= len(own)
            gradient = {"b": np.array([error.sum()]), "w": x.T @ error + DECAY * theta["w"],
                        "v": x.T @ (error[:, None] * inner) - ((x ** 2).T @ error)[:, None] * theta["v"] + DECAY * theta["v"]}
            step += 1
            for k, g in gradient.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                theta[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return FactorisationMachine(float(theta["b"][0]), theta["w"], theta["v"])


def fit_quality(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    """Fit on the ``TRAIN_ROWS`` labelled rows of ``docs`` whose doc_id has the smallest hash.

    ``labels``: doc_id, quality. Several labels of a document are averaged, null ones are ignored. Of rows that
    share a doc_id, the one whose text has the smallest hash is learnt from.
    Features are computed in the tasks; the driver gets TRAIN_ROWS x WORD_DIMS values at most.
    """
    own = (labels.filter("quality is not null and doc_id is not null").groupBy("doc_id")
           .agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    own = hash_sample(own, "doc_id", TRAIN_ROWS).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t) for t in texts], columns=["at", "x"])

    # The limit bounds the broadcast table.
    rows = (docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
            .select("doc_id", "label", F.xxhash64("text").alias("h"), F.pandas_udf(of, "at array<int>, x array<float>")("text").alias("f"))
            .groupBy("doc_id", "label").agg(F.min_by("f", "h").alias("f")).collect())
    rows.sort(key=lambda r: r.doc_id)
    return fit([(np.array(r.f.at, np.int32), np.array(r.f.x, np.float32)) for r in rows], [r.label for r in rows])


def score_quality(docs: DataFrame, model: FactorisationMachine, into: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``into`` (0 to 1; higher: good likelier).

    Only ``text`` is read. Null and empty texts are scored by their structure alone. Equal texts
    have equal scores.
    """
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")
    return docs.withColumn(into, F.pandas_udf(of, "double")("text"))
