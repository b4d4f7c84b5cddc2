"""Language-model scores from a log-frequency Bloom filter.

Counts of words are exact.  Counts of bigrams are gathered over the whole training part,
quantised to 1 + floor(log2 count) levels, and every level up to an entry's own is
inserted in a Bloom filter; a probe climbs the levels until the first miss.  With the
quantised count q (never more than either word's own count),

    p(w | h) = (q(h w) + WEIGHT * p1(w)) / (c(h) + WEIGHT),    p1(w) = (c(w) + 1) / (N + V + 1)

and p1(w) after a word that is not known.  Levels round counts down, so a history's
probabilities sum to at most 1 (but for false positives).  The end token stands before
each text's first word.

Nothing that is gathered is cut: every word and every bigram of the training part is in,
and the filter has BITS_EACH bits or more for each insertion at every size.  Such a filter
grows with the corpus, so it isn't broadcast whole: it lives in slices, as many as the
corpus needs, each in the task that gets both its counts and its probes.  A block of texts
sends each of its different words and bigrams once, with how often its training texts hold
it; a slice sums the counts, fills its part of the filter and answers every block; a block
is scored where its answers meet its texts.  No group grows with the corpus: a slice holds
SLICE tokens' share of keys, a frequent word comes once a block, and a block is a few MB of
texts or one longer text.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END = b"\n"  # the end token; no word holds white space
HASHES, BITS_EACH = 4, 8
LEVELS = 48
WEIGHT = 4.0
SLICE = 2_000_000  # tokens for each slice
BLOCK = 600_000  # tokens of a block of texts
WORD = np.dtype([("a", "<u8"), ("b", "<u4")])  # the 96-bit name of a word
PAIR_BITS = 48  # of a bigram's name
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ as bytes."""
    return text.encode("utf-8").lower().split() if text else []


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def probes(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions (HASHES x keys) of (key, level) in a filter of that many bits, a
    power of two."""
    a = mix(keys, level)
    b = (a >> U(32)) | U(1)
    return np.stack([(a + U(i) * b) & U(bits - 1) for i in range(HASHES)]).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A filter of all keys with their levels, as bytes."""
    q = levels(counts)
    bits = 1 << max(6, math.ceil(math.log2(max(1, int(q.sum()) * BITS_EACH))))
    out = np.zeros(bits, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        out[probes(keys[q >= j], j, bits).ravel()] = True
    return np.packbits(out, bitorder="little")


def levels_held(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key by repeated membership probes, 0 if it isn't held."""
    got, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    if not len(filter_):
        return got
    for j in range(1, LEVELS):
        at = probes(keys[live], j, len(filter_) * 8)
        live = live[((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)]
        if not len(live):
            break
        got[live] = j
    return got


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """slices: a power of two."""
    return (mix(keys, 99) % U(slices)).astype(np.int64)


class Bundle:
    """The tokens of some texts: their different words and bigrams, in a fixed order."""

    def __init__(self, texts: list[str | None]):
        split = [words_of(t) for t in texts]
        for w in split:
            w.append(END)
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        index = {w: i for i, w in enumerate(dict.fromkeys(flat, 0))}
        self.ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        del split, flat  # a block's words as objects need more room than all its arrays
        name = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, index)), "<u8").reshape(-1, 2)
        self.words = np.zeros(len(name), WORD)
        self.words["a"], self.words["b"] = name[:, 0], name[:, 1] >> U(32)
        h = np.empty_like(self.ids)
        h[1:] = self.ids[:-1]
        h[np.cumsum(self.sizes) - self.sizes] = index.get(END, 0)
        kinds = max(1, len(index))
        del index

        self.pair, self.back = np.unique(h * kinds + self.ids, return_inverse=True)
        self.h, self.w = np.divmod(self.pair, kinds)
        self.keys = mix(self.words["a"][self.h] * U(0x9E3779B97F4A7C15) + self.words["a"][self.w], 7) >> U(64 - PAIR_BITS)

    def dealt(self, slices: int):
        """(slice, words, bigrams) with the numbers of those that go to the slice, in the
        order of their names: the same whenever the same texts are bundled."""
        (i, a), (j, b) = (dealt(x, slices) for x in (self.words["a"], self.keys))
        for s in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
            yield s, i[a[s] : a[s + 1]], j[b[s] : b[s + 1]]


def planes(a: np.ndarray) -> bytes:
    """Bytes of numbers, the first bytes first: numbers of one size compress better so."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""


def unplanes(x: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T.tobytes(), kind)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts as unsigned integers as small as they allow."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def sized(x: bytes, n: int) -> np.ndarray:
    """n counts from what small() and planes() made of them."""
    return unplanes(x, f"<u{len(x) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def dealt(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by slice and key, and where each slice begins in it."""
    s = slice_of(keys, slices)
    order = np.lexsort((keys, s))
    return order, np.searchsorted(s[order], np.arange(slices + 1))


def gaps(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U(0)))


def ungap(x: bytes) -> np.ndarray:
    return np.cumsum(unplanes(x, "<u8"), dtype=np.uint64) if x else np.zeros(0, np.uint64)


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, texts): documents (doc_id, train, text) in compressed blocks of BLOCK tokens."""

    def run(batches):
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(b)
                size += b.column(2).nbytes
            if held and (b is None or size >= BLOCK * 6):  # a token is some six bytes
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(pa.Table.from_batches(held))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])
                block, held, size = block + 1, [], 0

    return docs.mapInArrow(C.frugal(run), "block long, texts binary")


def opened(texts) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(texts)).read_all()


def lm_scores(docs: DataFrame, slice_tokens: int = SLICE) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of
    docs (doc_id long, train boolean, text): the model learns from the rows with train.

    Null texts are empty, repeated rows and null ids are scored each on their own, texts
    are scored whole however long; an empty table gives an empty one; without training
    rows N = V = 0.  base_score is the sum of log10 p1 over all tokens, score the model's
    log10 probability of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "train", F.col("text").cast("string"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 << max(4, math.ceil(math.log2(max(1, chars / 6 / slice_tokens))))
    blocks = C.materialize(in_blocks(docs), "lm-blocks")

    def ask(batches):
        for batch in batches:
            for block, texts in zip(*(c.to_pylist() for c in batch.columns)):
                t = opened(texts)
                x = Bundle(t.column(2).to_pylist())
                train = np.repeat(np.array(t.column(1)), x.sizes)
                n, m = np.bincount(x.ids[train], minlength=len(x.words)), np.bincount(x.back[train], minlength=len(x.pair))
                rows = [(block, s, gaps(x.words["a"][u]), planes(x.words["b"][u]), planes(small(n[u])), gaps(x.keys[v]), planes(small(m[v]))) for s, u, v in x.dealt(slices)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.binary()] * 5))], ["block", "s", "a", "b", "n", "k", "m"])

    def answer(t):
        a, b, n, k, m = (t.column(c).to_pylist() for c in "abnkm")
        nw, np_ = [len(x) // 8 for x in a], [len(x) // 8 for x in k]
        a, b = np.concatenate(list(map(ungap, a))), np.concatenate([unplanes(x, "<u4") if x else np.zeros(0, "<u4") for x in b])
        n, m = (np.concatenate([sized(x, z) for x, z in zip(y, sizes)]) for y, sizes in ((n, nw), (m, np_)))
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, n).astype(np.int64) if len(a) else np.zeros(0, np.int64)
        c = total[group]
        keys = np.concatenate(list(map(ungap, k)))
        own = m > 0
        known, back = np.unique(keys[own], return_inverse=True)
        q = levels_held(fill(known, np.bincount(back, m[own], len(known))), keys)
        wa, pa_ = np.cumsum([0, *nw]).tolist(), np.cumsum([0, *np_]).tolist()
        first = np.arange(len(nw)) == 0
        cols = [
            t.column("block"), t.column("s"), pa.array([planes(small(c[i:j])) for i, j in zip(wa, wa[1:])], pa.binary()), pa.array([q[i:j].tobytes() for i, j in zip(pa_, pa_[1:])], pa.binary()),
            pa.array(first * int(total.sum())), pa.array(first * int((total > 0).sum())),
        ]
        return pa.Table.from_arrays(cols, ["block", "s", "c", "q", "total", "kinds"])

    asked = blocks.mapInArrow(C.frugal(ask), "block long, s int, a binary, b binary, n binary, k binary, m binary")
    answers = C.materialize(asked.groupBy("s").applyInArrow(C.frugal_group(answer), "block long, s int, c binary, q binary, total long, kinds long"), "lm-answers")
    total, kinds = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    log_all = math.log10(total + kinds + 1)

    def finish(t):
        s, got, level = (t.column(c).to_pylist() for c in ("s", "c", "q"))
        rows = opened(t.column("texts")[s.index(None)].as_py())
        x = Bundle(rows.column(2).to_pylist())
        c, q = np.zeros(len(x.words), np.int64), np.zeros(len(x.pair), np.int64)
        at = {i: n for n, i in enumerate(s)}
        for i, u, v in x.dealt(slices):
            c[u], q[v] = sized(got[at[i]], len(u)), np.frombuffer(level[at[i]], np.uint8)
        base = np.log10(c + 1.0) - log_all
        count = np.minimum(np.where(q > 0, 2.0 ** (q - 1.0), 0.0), np.minimum(c[x.h], c[x.w]))
        step = np.where(c[x.h] > 0, np.log10((count + WEIGHT * 10.0 ** base[x.w]) / (c[x.h] + WEIGHT)), base[x.w])
        first = np.cumsum(x.sizes) - x.sizes
        sums = [np.add.reduceat(y, first) for y in ((c > 0).astype(np.int64)[x.ids], base[x.ids], step[x.back])]
        cols = [rows.column(0), rows.column(1), pa.array(x.sizes), pa.array(sums[0]), pa.array(np.full(len(x.sizes), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(cols, ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = F.lit(None)
    every = blocks.select("block", none.cast("int").alias("s"), none.cast("binary").alias("c"), none.cast("binary").alias("q"), "texts")
    every = every.unionByName(answers.select("block", "s", "c", "q", none.cast("binary").alias("texts")))
    return every.groupBy("block").applyInArrow(C.frugal_group(finish), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 7 isn't 2; scores every row.

    Null texts are empty: one end token.  A null doc_id counts as the text ''.
    Repeated rows are scored each on their own.  Without training rows N = V = 0.
    """
    docs = C.table(spark, sf_dir, "documents")
    fold = C.fold(F.col("doc_id"), 7)
    scored = lm_scores(docs.select("doc_id", (fold != 2).alias("train"), "text"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
