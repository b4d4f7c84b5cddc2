"""Toxicity by class-conditional Kneser-Ney models.

One interpolated bigram model for toxic and one for ordinary labelled documents:

    P_c(w | h) = (n_c(h w) - D(n)) / n_c(h) + rest_c(h) * P_c(w)
    P_c(w)     = (N1+_c(. w) - D(N1+)) / N1+_c(. .) + rest_c * P(w)
    P(w)       = (N1+(. w) + 1/2) / sum over all words

N1+(. w) is the number of distinct words that w follows: a copied document or a repeated
phrase adds nothing to it.  P(w) pools the continuation counts of both classes, so what
is rare in a class is smoothed by shared backoff counts.  Discounts are the modified ones
(of 1, 2, and 3 or more), estimated from each class's own counts of counts; bigrams seen
once give their whole mass to the backoff.  Nothing depends on how large the classes are
beside each other: each is normalised by itself.

A document is scored by the length-normalised difference of its two log-likelihoods, by
words and by bigrams.  The classes' mix of languages and topics moves all words of a text
alike; the median difference of a text's words measures that, and the mean differences
over the median, in all and beyond EXCESS, are given to a logistic function beside the plain
mean.  It is fitted by two-fold cross-scoring: each half is scored by the other half's
counts.  Counts come from at most PER_CLASS documents of each class and live in tables of
fixed size, so the broadcast is bounded.

Null and empty texts have no words: all their differences are 0.  Very long texts are
scored whole; repeated rows each get their score.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .labelled import labelled_sample

WORDS, SLICES = 1 << 19, 32
SPAN = WORDS * WORDS
EXCESS = (1.0, 2.0, 3.0)
PER_CLASS = 10_000
CHUNK = 512  # texts in one array pass
#: ASCII signs that part words; letters beyond ASCII stay.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
PART = bytes.maketrans(SIGNS, b" " * len(SIGNS))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all texts in one array, and each text's number of words."""
    split = [t.encode("utf-8").lower().translate(PART).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(crc32, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    return (flat * 0x9E3779B1 >> 7) % (WORDS - 1), sizes


def histories(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each word; WORDS - 1 stands for a text's start."""
    h = np.empty_like(flat)
    h[1:] = flat[:-1]
    h[(np.cumsum(sizes) - sizes)[sizes > 0]] = WORDS - 1
    return h


class Counts:
    """One class: each word's distinct predecessors, each history's occurrences, the bigrams
    (h * WORDS + w) seen twice or more with their counts, and how many bigrams were
    seen once, twice, three and four times."""

    def __init__(self, words: np.ndarray, after: np.ndarray, keys: np.ndarray, n: np.ndarray, often: np.ndarray):
        self.words, self.after, self.keys, self.n, self.often = words, after, keys, n, often


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].astype(float)


def discounts(often: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more (modified Kneser-Ney); at least
    a tenth, so that the backoff has mass in the smallest corpus."""
    n = np.maximum(often, 1)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) for k in (1, 2, 3))])


class KneserNey:
    def __init__(self, toxic: Counts, plain: Counts):
        pool = toxic.words + plain.words + 0.5
        shared = pool / pool.sum()
        self.keys = np.unique(np.concatenate([toxic.keys, plain.keys]))
        self.sides = []
        for c in (toxic, plain):
            less = discounts(counts_of_counts(c.words))[np.minimum(c.words, 3).astype(np.int64)]
            total = max(1.0, c.words.sum())
            one = (c.words - less) / total + (1 - (c.words - less).sum() / total) * shared
            less = discounts(c.often)
            part = (c.n - less[np.minimum(c.n, 3)]) / np.maximum(c.after[c.keys // WORDS], 1)
            rest = 1 - np.bincount(c.keys // WORDS, part, WORDS)
            share = np.zeros(len(self.keys), np.float32)
            share[np.searchsorted(self.keys, c.keys)] = part
            self.sides.append((share, rest.astype(np.float32), one.astype(np.float32)))
        self.step = np.log(self.sides[0][2]) - np.log(self.sides[1][2])
        # Histories with a kept bigram in either class; after all others words decide alone.
        self.open = (self.sides[0][1] < 1) | (self.sides[1][1] < 1)

    def differences(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(w | toxic) - log P(w | ordinary) of each word, by words and by bigrams."""
        by_word, h = self.step[flat], histories(flat, sizes)
        by_pair, at = by_word.copy(), np.flatnonzero(self.open[h])
        if len(at):
            key, logs = h[at] * WORDS + flat[at], []
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key if len(self.keys) else np.zeros(len(at), bool)
            for share, rest, one in self.sides:
                p = np.where(hit, share[i], 0.0) if len(share) else 0.0
                logs.append(np.log(p + rest[h[at]] * one[flat[at]]))
            by_pair[at] = logs[0] - logs[1]
        return by_word, by_pair

    def inputs(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What the logistic function sees of each text; a 1 and zeros without words."""
        n, ends = np.maximum(sizes, 1), np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        cols = [np.ones(len(sizes))]
        for d in self.differences(flat, sizes):
            d = d.astype(float)
            ordered = np.append(d[np.lexsort((d, text))], 0.0)
            middle = np.where(sizes > 0, ordered[ends - sizes + (sizes - 1) // 2 * (sizes > 0)], 0.0)
            over = d - middle[text]
            for x in (d, over, *(np.maximum(over - t, 0.0) for t in EXCESS)):
                cols.append(10 * np.bincount(text, x, len(sizes)) / n)
        return np.stack(cols, 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, lm: KneserNey, weights: np.ndarray):
        self.lm, self.weights = lm, weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), CHUNK):
            out.append(1 / (1 + np.exp(-np.clip(self.lm.inputs(*tokens(texts[i : i + CHUNK])) @ self.weights, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def half() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("long")


def squeezed(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a, np.int64).tobytes(), 1)


def opened(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.int64)


def gather(sample: DataFrame) -> dict[tuple[int, int], Counts]:
    """Counts by (label, half) of the sample (text, y, half); half 2 stands for both."""

    def rows(s, keys, n):
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([squeezed(keys)]), pa.array([squeezed(n)])], ["s", "k", "n"])

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                flat, sizes = tokens(b.column(0).to_pylist())
                cls = np.repeat(np.array(b.column(1)) * 2 + np.array(b.column(2)), sizes)
                h = histories(flat, sizes)
                yield rows(-1, *np.unique(cls * WORDS + h, return_counts=True))
                key, n = np.unique(cls * SPAN + h * WORDS + flat, return_counts=True)
                s = key % SLICES  # all predecessors of a word meet in one slice
                for j in np.unique(s).tolist():
                    yield rows(j, key[s == j], n[s == j])

    def add(t):
        s = t.column("s")[0].as_py()
        key, at = np.unique(np.concatenate([opened(x) for x in t.column("k").to_pylist()]), return_inverse=True)
        n = np.bincount(at, np.concatenate([opened(x) for x in t.column("n").to_pylist()]), len(key)).astype(np.int64)
        out = []
        if s < 0:
            out.append((-1, 0, key, n, key[:0], n[:0], n[:0]))
        else:
            for y in (0, 1):
                mine = [(key[m] % SPAN, n[m]) for m in (key // SPAN == 2 * y, key // SPAN == 2 * y + 1)]
                pair, at = np.unique(np.concatenate([k for k, _ in mine]), return_inverse=True)
                mine.append((pair, np.bincount(at, np.concatenate([m for _, m in mine]), len(pair)).astype(np.int64)))
                for part, (k, m) in enumerate(mine):
                    words, before = np.unique(k % WORDS, return_counts=True)
                    out.append((y, part, words, before, k[m > 1], m[m > 1], counts_of_counts(m)))
        y, part, *cols = zip(*out)
        return pa.Table.from_arrays([pa.array(y, pa.int32()), pa.array(part, pa.int32()), *(pa.array(list(map(squeezed, c)), pa.binary()) for c in cols)], ["y", "half", "w", "wn", "k", "n", "often"])

    sums = sample.mapInArrow(C.frugal(run), "s int, k binary, n binary").groupBy("s").applyInArrow(C.frugal_group(add), "y int, half int, w binary, wn binary, k binary, n binary, often binary")
    ids = [(y, part) for y in (0, 1) for part in (0, 1, 2)]
    words, pairs, often, after = {i: np.zeros(WORDS) for i in ids}, {i: [] for i in ids}, {i: np.zeros(4) for i in ids}, np.zeros(4 * WORDS)
    for r in sums.toLocalIterator():
        w, wn, k, n, o = map(opened, r[2:])
        if r[0] < 0:
            after[w] += wn
        else:
            words[r[0], r[1]][w] += wn
            pairs[r[0], r[1]].append((k, n))
            often[r[0], r[1]] += o
    out = {}
    for y, part in ids:
        k, n = (np.concatenate([x[j] for x in pairs[y, part]] or [np.zeros(0, np.int64)]) for j in (0, 1))
        order = np.argsort(k)
        seen = sum(after[(2 * y + f) * WORDS : (2 * y + f + 1) * WORDS] for f in ((0, 1) if part == 2 else (part,)))
        out[y, part] = Counts(words[y, part], seen, k[order], n[order], often[y, part])
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labels (doc_id, toxic 0/1).  The sample takes at most per_class
    rows of each class; the calibration weighs them back to the labels' own shares.
    Without labels of both classes the model is indifferent and its prior is the
    share of toxic labels (a half without any)."""
    share = {r[0]: r[1] for r in labels.where("toxic is not null").groupBy(F.col("toxic").cast("int")).count().collect()}
    picked = labelled_sample(docs, labels, "toxic", per_class, [0, 1]).select("text", F.col("y").cast("long").alias("y"), half().alias("half"))
    sample = C.materialize(picked, "toxic-sample")
    held = gather(sample)
    halves = docs.sparkSession.sparkContext.broadcast([KneserNey(held[1, 1 - f], held[0, 1 - f]) for f in (0, 1)])

    def cross(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                flat, sizes = tokens(b.column(0).to_pylist())
                x, y = (m.inputs(flat, sizes) for m in halves.value)
                x = np.where(np.array(b.column(2))[:, None] == 0, x, y)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    seen = sample.mapInArrow(C.frugal(cross), "y long, x array<double>").toPandas()
    y = seen["y"].to_numpy(float)
    if len(set(y)) == 2:
        n = [(y == 0).sum(), (y == 1).sum()]
        weight = np.where(y == 1, share[1] / n[1], share[0] / n[0])
        weights = logistic(np.stack(seen["x"].to_numpy()), y, weight * len(y) / weight.sum())
    else:
        p = min(max(share.get(1, 0) / max(1, sum(share.values())), 1e-3), 1 - 1e-3) if share else 0.5
        weights = np.array([math.log(p / (1 - p)), *[0.0] * (2 * (2 + len(EXCESS)))])
    return Model(KneserNey(held[1, 2], held[0, 2]), weights)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out: the score (0 to 1) of every whole text; null and
    empty texts score what the model says of no words.  A column of that name in
    docs is replaced; rows and other columns stay as they are.  No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            s = held.value.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, out])

    return docs.mapInArrow(C.frugal(run), T.StructType([*docs.schema.fields]).add(out, "double"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 5 isn't 0; scores every row
    of documents (repeated rows, null ids and texts included)."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, C.table(spark, sf_dir, "labels").where(C.fold(F.col("doc_id"), 5) != 0))
    return with_score(docs, model).select(
        F.col("doc_id").cast("long"), (C.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
