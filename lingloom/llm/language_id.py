"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-case characters in grams of one to three, other characters than letters folded to one space, are hashed into
``DIM`` dimensions. The model is trained by follow-the-regularised-leader with elastic-net penalties, which leaves
most weights at zero, and then calibrated by a temperature on a part of the sample that took no part in training.
To fit, at most ``limit`` labelled documents outside the held-out fold are used, shared out over the labels so that a rare
language keeps as many as ``limit`` allows each; document frequencies are of all of them. Every whole text is predicted.

Null text and text without a letter: ``und`` with score 0, as is everything when there are no labelled documents.
Repeated rows are all predicted; a null doc_id counts in the fold of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import fitted, fold, id_text, in_arrow
from .textbuf import chunks

LIMIT, DIM, BLOCK = 2_000, 1 << 13, 64
UND = "und"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (one character) and whether it is a letter, for the basic plane."""
    lower, letter = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        s = chr(c)
        letter[c] = s.isalpha()
        if len(s.lower()) == 1:
            lower[c] = ord(s.lower())
    return lower, letter


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and the documents' offsets in them."""
    lead = (data & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=at[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(points) == at[-1]:
        return points, at[offsets]
    parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By blocks of documents: gram counts (documents x DIM) and the number of letters."""
    points, at = characters(data, offsets)
    lower, letter = _tables()
    low = np.minimum(points, 0xFFFF)
    is_letter = letter[low]
    for i in np.flatnonzero(points > 0xFFFF):
        is_letter[i] = chr(points[i]).isalpha()
    c = np.where(is_letter, np.where(points <= 0xFFFF, lower[low], points), 32).astype(np.uint32)
    a, b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    one = c * a
    two = (one[:-1] ^ b) * a + c[1:] * b if len(c) > 1 else one[:0]
    three = (two[:-1] ^ a) * b + c[2:] * a if len(c) > 2 else one[:0]
    grams = [((x ^ (x >> np.uint32(15))) * b) >> shift for x in (one, two, three)]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(at))
    space = c == 32
    for start in range(0, len(offsets) - 1, BLOCK):
        stop = min(start + BLOCK, len(offsets) - 1)
        x = np.zeros((stop - start) * DIM, np.int64)
        for k, gram in enumerate(grams):
            lo, hi = int(at[start]), min(int(at[stop]), len(gram))
            if hi <= lo:
                continue
            doc = owner[lo:hi]
            ok = (owner[lo + k : hi + k] == doc) & ~(space[lo:hi] & space[lo + k : hi + k])
            x += np.bincount(((doc - start) * DIM + gram[lo:hi])[ok], minlength=len(x))
        letters = np.bincount(owner[at[start] : at[stop]] - start, is_letter[at[start] : at[stop]], minlength=stop - start)
        yield x.reshape(stop - start, DIM), letters


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = x * self.idf
        return z @ self.weights / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9) + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights ((DIM + 1) x classes, the last row the bias) by follow-the-regularised-leader, elastic net."""
    z, n = np.zeros((DIM + 1, n_classes)), np.zeros((DIM + 1, n_classes))

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            index, value, y = rows[r]
            w = weights(index)
            p = softmax((value @ w)[None])[0]
            p[y] -= 1
            g = value[:, None] * p[None]
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(np.arange(DIM + 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray | None = None, total: int = 0) -> Model | None:
    """From (gram indices, counts, language) of the sample, and the grams' frequencies in ``total`` documents, by default
    the sample; None without any."""
    languages = sorted({y for _, _, y in rows})
    if not languages:
        return None
    if df is None:
        df, total = np.zeros(DIM), len(rows)
        for index, _, _ in rows:
            df[index] += 1
    idf = np.log((1 + total) / (1 + df)) + 1
    scaled = []
    for index, count, y in rows:
        v = count * idf[index]
        scaled.append((np.append(index, DIM), np.append(v / max(np.sqrt((v * v).sum()), 1e-9), 1.0), languages.index(y)))
    seen = [0] * len(languages)
    tune, rest = [], []
    for row in scaled:  # every fifth of a language, so that even one with a single document is trained
        seen[row[2]] += 1
        (rest if seen[row[2]] % 5 else tune).append(row)
    tune = tune or rest
    w = ftrl(rest, len(languages))
    logits, y = np.array([v @ w[i] for i, v, _ in tune]), np.array([c for _, _, c in tune])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y].clip(1e-12)).mean() + 1e-4 * np.log(t) ** 2
    temperature = min(np.geomspace(0.02, 5, 60), key=loss)
    return Model(languages, idf, w[:DIM], w[DIM], float(temperature))


def shares(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """Rows of each label, ``limit`` together: small labels whole, the rest alike; at least one of each."""
    out, left = {}, limit
    for k, (label, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(size, max(1, left // (len(sizes) - k)))
        left -= out[label]
    return out


def train(docs: DataFrame, limit: int = LIMIT) -> Model | None:
    """Fitted on at most ``limit`` documents that have a label and are not held out, of each label those with the smallest id hashes.

    Labels are counted over all rows; only a text without a letter is no document of its label.
    """
    letters = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("\\p{L}")
    known = docs.where((fold(of=4) != 2) & F.col("lang").isNotNull() & letters)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    wanted = shares(sizes, limit)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # A little more than each label's rows, by the hash; labels differ in size, so each has its own bound.
    bound = {label: int(min(1.0, (1.25 * n + 20) / sizes[label]) * (1 << 30)) for label, n in wanted.items()}
    bounds = docs.sparkSession.createDataFrame(list(bound.items()), "lang_ string, bound_ long")
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(bounds), F.col("lang") == F.col("lang_")).where(hashed < F.col("bound_"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            index, count, keep, i = [], [], [], 0
            for x, letters in counts(data, offsets):
                for row, n in zip(x, letters, strict=True):
                    at = np.flatnonzero(row)
                    index.append(at.astype(np.int32))
                    count.append(row[at].astype(np.int32))
                    keep.append(bool(n))
                    i += 1
            made = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], ["doc_id", "lang", "i", "n"])
            yield made.filter(pa.array(keep))

    grams = in_arrow(id_text(sample, "lang"), rows, "doc_id long, lang string, i array<int>, n array<int>")
    of_label = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    amounts = docs.sparkSession.createDataFrame(list(wanted.items()), "lang_ string, wanted_ int")
    # The sample holds little more than ``limit`` rows, so the ranks are of few.
    ranked = grams.withColumn("rank_", F.row_number().over(of_label)).join(F.broadcast(amounts), F.col("lang") == F.col("lang_"))
    df, total = frequencies(known)

    def learn(got: pa.Table) -> Model | None:
        got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        return fit([(np.array(i), np.array(n, float), y) for i, n, y in zip(got["i"].to_pylist(), got["n"].to_pylist(), got["lang"].to_pylist(), strict=True)], df, total)

    return fitted(ranked.where(F.col("rank_") <= F.col("wanted_")).select("doc_id", "lang", "i", "n"), learn)


def frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each gram, and all documents; summed by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, data, offsets in chunks(batch):
                for x, letters in counts(data, offsets):
                    df += (x[letters > 0] > 0).sum(0)
                    total += int((letters > 0).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([total, *df[at]], pa.int64())], ["gram", "n"])

    df, total = np.zeros(DIM), 0
    for row in id_text(known).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        if row["gram"] < 0:
            total = row["n"]
        else:
            df[row["gram"]] = row["n"]
    return df, total


def predict(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(docs, limit)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            names, scores = [], []
            for x, letters in counts(data, offsets):
                if model is None:
                    best, top = [UND] * len(x), np.zeros(len(x))
                else:
                    p = model.probabilities(x)
                    best, top = [model.languages[k] for k in p.argmax(1)], p.max(1)
                names += [b if n else UND for b, n in zip(best, letters, strict=True)]
                scores.append(np.where(letters > 0, top, 0.0))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

    held = id_text(docs).withColumn("held_out", fold(of=4) == F.lit(2))
    return in_arrow(held, rows, "doc_id long, held_out boolean, lang_pred string, score double")
