"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Class covariances are shrunk towards the pooled covariance and then towards a multiple of the identity; the score is
the logistic of the difference of the classes' log densities, with Mahalanobis terms from cached Cholesky factors.
The shrinkage is chosen on a part of the training sample. At most ``limit`` labelled documents outside the held-out fold
are used to fit; every whole text is scored.

Null text is the empty text. Without labelled documents of both classes, the score is the share of label 1 (0.5 if
there are no labels at all). Repeated rows are all scored; a null doc_id counts in the fold of the empty text; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fitted, fold, id_text, in_arrow, labelled
from .textbuf import SPACE, U64, Hashes, byte_set, chunks, mix64, per_doc, spans, words

LIMIT = 20_000
UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
CLASSES = (UPPER, LOWER + bytes(range(128, 256)), DIGIT, SPACE, b"#*$%&<>", b"|", b"!?", b".,;:'\"", b"\n")
N_FEATURES = len(CLASSES) + 6


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each document: logarithms of counts, logits of shares."""
    size = np.diff(offsets)
    counts = np.stack([per_doc(byte_set(c)[data], offsets) for c in CLASSES], 1)
    starts, stops = words(data, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(size))
    hashes = Hashes(data)

    def distinct(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
        key = mix64(hashes.of(begin, end) + (owner.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        return np.bincount(owner[first], minlength=len(size))

    line_start, line_stop = spans(data != 10, offsets)
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=len(size))
    lengths = stops - starts
    squares = np.bincount(doc, lengths.astype(float) ** 2, minlength=len(size))
    total = np.bincount(doc, lengths.astype(float), minlength=len(size))
    mean = total / np.maximum(n_words, 1)
    share = lambda x, n: np.log((x + 0.5) / (n - x + 0.5).clip(0.5))
    return np.column_stack([
        np.log1p(n_words), np.log1p(mean), np.log1p((squares / np.maximum(n_words, 1) - mean**2).clip(0)),
        share(distinct(starts, stops, doc), n_words), share(distinct(line_start, line_stop, line_doc), n_lines),
        np.log1p(n_words / np.maximum(n_lines, 1)), *[share(counts[:, i], size) for i in range(len(CLASSES))],
    ])


class Discriminant:
    """Scores log(p1/p0) from two Gaussians; ``fit`` chooses the shrinkage that predicts a part of the sample best."""

    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: float, gamma: float) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
        self.classes = []
        for c in (0, 1):
            cov = (1 - alpha) * np.cov(z[y == c].T, bias=True) + alpha * pooled
            cov = (1 - gamma) * cov + gamma * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-6 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((z[y == c].mean(0), np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log((y == c).mean())))
        self.slope, self.shift = 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        low, high = [bias - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, bias in self.classes]
        return high - low

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -35, 35)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> float:
        """Platt scaling by Newton steps; returns the log loss."""
        m, ridge = self.margin(x).clip(-60, 60), 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -35, 35)))
            g = np.array([((p - y) * m).mean() + ridge * (self.slope - 1), (p - y).mean() + ridge * self.shift])
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * m * m).mean(), (w * m).mean()], [(w * m).mean(), w.mean()]]) + ridge * np.eye(2)
            step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
            self.slope, self.shift = max(1e-3, self.slope - step[0]), self.shift - step[1]
        p = np.clip(self.score(x), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """The discriminant, or the share of label 1 if a class has too few rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return float(y.mean()) if len(y) else 0.5
    part = np.arange(len(y)) % 4 == 0
    tune, rest = (part, ~part) if min((y[p] == c).sum() for p in (part, ~part) for c in (0, 1)) >= 2 else (np.ones(len(y), bool),) * 2
    best = min(((d := Discriminant(x[rest], y[rest], a, g)).calibrate(x[tune], y[tune]), a, g, d.slope, d.shift) for a in (0.0, 0.1, 0.3, 0.6, 0.9) for g in (0.0, 0.05, 0.2))
    model = Discriminant(x, y, best[1], best[2])
    model.slope, model.shift = best[3:]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LIMIT) -> Discriminant | float:
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    def learn(got: pa.Table) -> Discriminant | float:
        got = got.sort_by("doc_id")
        return fit(np.array(got["x"].to_pylist(), float).reshape(-1, N_FEATURES), got["y"].to_numpy().astype(int))

    return fitted(in_arrow(labelled(docs, labels, label, limit), rows, "doc_id long, y int, x array<double>"), learn)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LIMIT, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, label, limit)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            p = model.score(features(data, offsets)) if isinstance(model, Discriminant) else np.full(part.num_rows, model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = id_text(docs).withColumn("held_out", fold() == F.lit(0))
    return in_arrow(held, rows, "doc_id long, held_out boolean, score double, predicted int")
