"""Quality selection by ordinal cumulative-link regression.

Graded ratings g_0 < g_1 < ... are modelled by one weight vector shared by all
grades and ordered thresholds:  P(grade > g_k | x) = sigmoid(w.x - t_k), t_0 < t_1 < ...
x is hashed text: word frequencies in WORDS cells and square roots of frequencies of
neighbouring sign classes.  A document gets its expected grade and the tail
probability of at least a wanted grade, by which it is selected.
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .labelled import labelled, labelled_sample

WORDS = 1 << 18
PER_CLASS = 5_000
CHUNK = 256
STEPS, RATE, RIDGE = 200, 0.05, 1e-5


def sign_classes() -> np.ndarray:
    """The class of each byte: small, capital, digit, space, line end, other control,
    beyond ASCII, and every ASCII sign for itself."""
    out, n = np.zeros(256, np.int64), 7
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 6
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == " ":
            out[b] = 3
        elif c == "\n":
            out[b] = 4
        elif b < 32 or b == 127:
            out[b] = 5
        else:
            out[b], n = n, n + 1
    return out


CLASSES = sign_classes()
KINDS = int(CLASSES.max()) + 1
SIGNS = KINDS * KINDS


def featurize(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word cells of all texts, words per text, and each text's sign features."""
    raw = [t.encode("utf-8") if t else b"" for t in texts]
    split = [b.lower().split() for b in raw]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(crc32, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    flat = (flat * 0x9E3779B1 >> 9) % WORDS
    signs = np.zeros((len(raw), SIGNS))
    for i, b in enumerate(raw):
        if len(b) > 1:
            c = CLASSES[np.frombuffer(b, np.uint8)]
            signs[i] = np.sqrt(np.bincount(c[:-1] * KINDS + c[1:], minlength=SIGNS) / (len(b) - 1))
    return flat, sizes, signs


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class CumulativeLink:
    """grades: the distinct ratings in order; with one or none, every document gets it (or 0)."""

    def __init__(self, grades: list[float]):
        self.grades = np.array(sorted(grades), float)
        self.words, self.signs = np.zeros(WORDS), np.zeros(SIGNS)
        self.first, self.gaps = 0.0, np.zeros(max(0, len(grades) - 2))

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.exp(self.gaps))))

    def latent(self, flat: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> np.ndarray:
        sums, ends = np.concatenate(([0.0], np.cumsum(self.words[flat]))), np.cumsum(sizes)
        return (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1) + signs @ self.signs

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > g_k), one column for each k but the last."""
        return sigmoid(z[:, None] - self.thresholds()) if len(self.grades) > 1 else np.zeros((len(z), 0))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        base = self.grades[0] if len(self.grades) else 0.0
        return base + tails @ np.diff(self.grades) if tails.shape[1] else np.full(len(tails), base)

    def at_least(self, tails: np.ndarray, grade: float) -> np.ndarray:
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(tails))
        return tails[:, k - 1] if k <= tails.shape[1] else np.zeros(len(tails))

    def fit(self, flat: np.ndarray, sizes: np.ndarray, signs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Full-batch Adam on the weighted ordinal likelihood; y holds indexes of grades."""
        if len(self.grades) < 2 or not len(y):
            return
        weight, row = weight / weight.sum(), np.repeat(np.arange(len(y)), sizes)
        value = 1 / np.maximum(sizes, 1)[row]
        params = [self.words, self.signs, np.zeros(1), self.gaps]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        k = len(self.grades) - 1
        share = np.clip([weight[y > i].sum() for i in range(k)], 1e-3, 1 - 1e-3)
        start = np.log((1 - share) / share)
        params[2][0] = start[0]
        self.gaps[:] = np.log(np.maximum(np.diff(start), 1e-2))
        for step in range(1, STEPS + 1):
            self.first = params[2][0]
            t = np.concatenate(([-np.inf], self.thresholds(), [np.inf]))
            z = self.latent(flat, sizes, signs)
            up, down = sigmoid(z - t[y]), sigmoid(z - t[y + 1])
            p = np.maximum(up - down, 1e-9)
            gu, gd = weight * up * (1 - up) / p, weight * down * (1 - down) / p
            dz = -(gu - gd)
            dt = np.zeros(k)
            np.add.at(dt, y[y > 0] - 1, gu[y > 0])
            np.add.at(dt, y[y < k], -gd[y < k])
            grads = [
                np.bincount(flat, dz[row] * value, WORDS) + RIDGE * self.words,
                signs.T @ dz + RIDGE * self.signs,
                np.array([dt.sum()]),
                np.exp(self.gaps) * np.cumsum(dt[::-1])[::-1][1:],
            ]
            for w, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        self.first = params[2][0]


def fit(docs: DataFrame, ratings: DataFrame, rating: str = "quality", per_class: int = PER_CLASS, max_grades: int = 32) -> CumulativeLink:
    """Fit on at most per_class documents of each grade (of the smallest id hash); the
    likelihood weighs them by the inverse of their grade's sampled share, so each grade
    counts as often as the labels hold it, at every size.  ratings:
    doc_id and an integer rating; rows with a null are left out."""
    grades = [r[0] for r in ratings.where(F.col(rating).isNotNull()).select(F.col(rating).cast("int")).distinct().limit(max_grades + 1).collect()]
    if len(grades) > max_grades:
        raise ValueError(f"more than {max_grades} grades")
    model = CumulativeLink(grades)
    if len(grades) < 2:
        return model

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                flat, sizes, signs = featurize(b.column(0).to_pylist())
                parts = np.split(flat.astype(np.uint32), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in signs], pa.binary())], ["y", "w", "s"])

    share = {r[0]: max(1.0, r[1] / per_class) for r in labelled(ratings, rating).groupBy("y").count().collect()}
    sample = labelled_sample(docs, ratings, rating, per_class, sorted(grades)).select("text", F.col("y").cast("long"))
    ys, words, signs = [], [], []
    for r in sample.mapInArrow(C.frugal(run), "y long, w binary, s binary").toLocalIterator():
        ys.append(r[0])
        words.append(np.frombuffer(r[1], np.uint32))
        signs.append(np.frombuffer(r[2], np.float32))
    if ys:
        sizes = np.array([len(w) for w in words])
        weight = np.array([share[y] for y in ys])
        model.fit(np.concatenate(words).astype(np.int32), sizes, np.stack(signs), np.searchsorted(model.grades, np.array(ys, float)), weight)
    return model


def with_quality(docs: DataFrame, model: CumulativeLink, wanted: float, text_col: str = "text") -> DataFrame:
    """docs with expected_grade and tail (the probability of at least grade wanted).
    Every row stays, null texts count as empty, columns of these names are replaced.
    No shuffle; the broadcast is the weight vector."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("expected_grade", "tail")
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                m = held.value
                tails = m.tails(m.latent(*featurize(b.column(at).to_pylist())))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.expected(tails)), pa.array(m.at_least(tails, wanted))], [*b.schema.names, "expected_grade", "tail"])

    schema = T.StructType([*docs.schema.fields]).add("expected_grade", "double").add("tail", "double")
    return docs.mapInArrow(C.frugal(run), schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels.quality of rows whose crc32(doc_id) mod 5 isn't 0; every row
    of documents gets its expected grade, the probability of grade 1 and keep; null texts
    count as empty, repeated rows fare alike, very long texts count whole."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 5) != 0))
    return with_quality(docs, model, 1).select(
        F.col("doc_id").cast("long"), (C.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", F.col("tail").alias("p_good"), (F.col("tail") >= 0.5).cast("int").alias("keep")
    )
