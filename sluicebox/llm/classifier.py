"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

Every text becomes a short vector of statistics (lengths, shares of kinds of characters, repetition). For each class
the mean and covariance are computed from sums over all labelled training rows; the sums are added up by Spark, and
only they (a few hundred numbers) reach the driver. A covariance is shrunk towards the pooled one and towards a
diagonal, its Cholesky factor is computed once and shipped with the scoring function. The score is the logistic of
the difference of the log densities: half the difference of the Mahalanobis distances, plus log determinants and log
priors.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1; the others are held out. doc_id, language, source
and labels are no part of the vector. Null texts count as empty and are scored; null labels are not used; a null
doc_id is never held out and never labelled. Without training rows of one class, every score is 0 or 1 after the class
there is, and 0.5 without any. Repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches, text_of, utf8
from sluicebox.llm.quality_rules import repeated_words
from sluicebox.scratch import written

FEATURES = [
    "log_words", "log_chars", "word_length", "word_spread", "symbols", "digits", "upper", "marks", "shouts", "bars", "beyond_ascii",
    "capital_words", "odd_words", "same_lines", "repeated", "distinct_words", "log_lines", "line_words",
]
#: Weight of the pooled covariance, and of its diagonal, in the covariance of a class.
TOWARDS_POOLED = 0.1
TOWARDS_DIAGONAL = 0.05
FLOOR = 1e-3

_SYMBOLS = list(b"#*$%&<>@^~_=+{}[]\\/")
_MARKS = list(b".,;:?\"'()-")
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_UPPER = frozenset(range(65, 91))


def document_vector(text: bytes) -> list[float]:
    """The transformed statistics of a text, in the order of ``FEATURES``."""
    words = text.split()
    n = len(words)
    at = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    points = int(at.sum() - at[128:192].sum())
    inside = max(1, points - int(at[[32, 9, 10, 11, 12, 13]].sum()))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    capital = sum(w[0] in _UPPER for w in words)
    odd = sum(not (w.isalpha() or w[:-1].isalpha() or w[0] > 127) for w in words)
    share = lambda x, of: float(np.log1p(100.0 * x / max(1, of)))
    return [
        float(np.log1p(n)), float(np.log1p(points)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        share(at[_SYMBOLS].sum(), inside), share(at[48:58].sum(), inside), share(at[65:91].sum(), inside),
        share(at[_MARKS].sum(), inside), share(at[33], inside), share(at[124], inside), share(at[192:].sum(), inside),
        share(capital, n), share(odd, n), share(len(lines) - len(set(lines)), len(lines)), share(repeated_words(words), n),
        len(set(words)) / max(1, n), float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))),
    ]


def _vectors(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        yield {
            "doc_id": batch["doc_id"], "held_out": batch["held_out"],
            "vector": [document_vector(text) for text in utf8(batch["text"])],
        }


def vectors(docs: DataFrame) -> DataFrame:
    """Written rows (doc_id, held_out, vector) of every document."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    texts = docs.select("doc_id", held_out.alias("held_out"), text_of("text").alias("text"))
    return written(map_batches(texts, _vectors, "doc_id bigint, held_out boolean, vector array<double>"), "vectors")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray
    only: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = [
            c - 0.5 * np.square((x - m) @ inverse.T).sum(axis=1)
            for m, inverse, c in zip(self.means, self.inverses, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From the classes' row counts, sums of vectors and sums of their outer products."""
    if counts.min() < 1:
        only = 0.5 if counts.max() < 1 else float(counts.argmax())
        return Discriminant(sums, products, counts, only)
    means = sums / counts[:, None]
    scatter = products - np.einsum("c,ci,cj->cij", counts, means, means)
    pooled = scatter.sum(axis=0) / counts.sum()
    diagonal = np.diag(np.diag(pooled) + FLOOR)
    inverses, constants = [], []
    for n, own in zip(counts, scatter, strict=True):
        mixed = (1 - TOWARDS_POOLED) * own / n + TOWARDS_POOLED * pooled
        lower = np.linalg.cholesky((1 - TOWARDS_DIAGONAL) * mixed + TOWARDS_DIAGONAL * diagonal + FLOOR * np.eye(len(pooled)))
        inverses.append(np.linalg.inv(lower))
        constants.append(np.log(n / counts.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(inverses), np.array(constants))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the rows that are not held out; the sums of all moments are made by Spark."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where("label IN (0, 1)")
    training = rows.where("NOT held_out").join(known, F.col("doc_id") == F.col("id")).select("label", "vector")

    def moments(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch["vector"].flatten(), dtype=np.float64).reshape(-1, d)
            y = np.asarray(batch["label"])
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield {"place": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())}

    sums = map_batches(training, moments, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(2 * (1 + d + d * d))
    for row in sums.collect():  # as many rows as moments
        total[row["place"]] = row["value"]
    total = total.reshape(2, -1)
    return discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = vectors(docs)
    model = fit(rows, labels)

    def scored(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x = np.asarray(batch["vector"].flatten(), dtype=np.float64).reshape(-1, len(FEATURES))
            scores = model.scores(x)
            yield {
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32),
            }

    return map_batches(rows, scored, "doc_id bigint, held_out boolean, score double, predicted int")
