"""A tagger of error spans trained on the spot: a structured perceptron over hashed pieces.

Each round, every shard of the training sequences walks on from the round's weights in a task of
its own; the walks' averages are then averaged by block of weights, again in tasks.  What passes
the driver is one vector of a size set by the settings, whatever the number of sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T

BITS, BLOCK = 15, 1 << 12  # hashed features, and rows of weights that are averaged together
SHARD = 2000  # sequences a task walks through in a round
ROUNDS = 5
LABELS = ["O"] + [f"{b}-{t[0]}" for t in T.ERROR_TYPES for b in "BI"]


def features(pieces: list[str], bits: int = BITS) -> np.ndarray:
    """Hashed features of each piece: itself and its neighbours, pairs, and how its sequence begins."""
    p = ["^^", "^", *pieces, "$", "$$"]
    head = "|".join(pieces[:3])
    rows = []
    for i in range(2, len(p) - 2):
        a, b, c, d, e = p[i - 2 : i + 3]
        named = (f"c{c}", f"b{b}", f"d{d}", f"a{a}", f"e{e}", f"bc{b}|{c}", f"cd{c}|{d}", f"abc{a}|{b}|{c}", f"cde{c}|{d}|{e}", f"h{head}", f"hc{pieces[0]}|{c}|{d}", f"hh{head}|{b}|{c}|{d}")
        rows.append([zlib.crc32(x.encode()) & ((1 << bits) - 1) for x in named])
    return np.array(rows, np.int64).reshape(len(rows), -1)


def allowed(labels: list[str]) -> np.ndarray:
    """Penalties of steps: I- only behind B- or I- of its type."""
    kind = [x[2:] for x in labels]
    return np.array([[-1e9 if y[0] == "I" and kind[i] != kind[j] else 0.0 for j, y in enumerate(labels)] for i, _ in enumerate(labels)])


def viterbi(scores: np.ndarray, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best path through scores (pieces x labels) with steps (label x label)."""
    n, back = len(scores), np.zeros(scores.shape, np.int64)
    best = scores[0] + first
    for i in range(1, n):
        all_ = best[:, None] + steps
        back[i] = all_.argmax(0)
        best = all_.max(0) + scores[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return np.array(path[::-1])


def walk(weights: np.ndarray, rows: list[tuple[list[str], list[int]]], n_labels: int) -> np.ndarray:
    """The average of the weights over one pass; the last n_labels rows are steps."""
    bits, illegal = (len(weights) - n_labels).bit_length() - 1, allowed(LABELS)
    w, late, t, right = weights.copy(), np.zeros_like(weights), 1.0, None
    for pieces, gold in rows:
        if right == (pieces, gold):  # the weights are as they were when it was found right
            t += 1
            continue
        right = (pieces, gold)
        f, gold = features(pieces, bits), np.array(gold)
        found = viterbi(w[f].sum(1), w[-n_labels:] + illegal, illegal[0])
        if (wrong := found != gold).any():
            right = None
            for y, by in ((gold, 1.0), (found, -1.0)):
                np.add.at(w, (f[wrong], y[wrong][:, None]), by)
                np.add.at(late, (f[wrong], y[wrong][:, None]), by * t)
                np.add.at(w[-n_labels:], (y[:-1], y[1:]), by)
                np.add.at(late[-n_labels:], (y[:-1], y[1:]), by * t)
        t += 1
    return w - late / t


def sequences(tokens: DataFrame, key: str) -> DataFrame:
    """(key, win, pieces, labels, starts, ends): a row a window of labelled pieces, in order."""
    item = F.struct("pos", "piece", "label" if "label" in tokens.columns else F.lit("O").alias("label"), "start", "end")
    rows = tokens.where("not masked").groupBy(key, "win").agg(F.array_sort(F.collect_list(item)).alias("_a"))  # a window is bounded
    return rows.select(key, "win", *(F.col(f"_a.{c}").alias(f"{c}s") for c in ("piece", "label", "start", "end")))


def train(rows: DataFrame, rounds: int = ROUNDS, shard: int = SHARD, bits: int = BITS) -> np.ndarray:
    """Weights ((2^bits + labels) x labels) from sequences(): key, win, pieces, labels.

    Shards are dealt by a hash of the pieces and sorted within, so repeated runs agree.  Without
    sequences the weights are zero, and everything is O."""
    spark, n = rows.sparkSession, len(LABELS)
    dealt = rows.select("pieces", "labels").withColumn("h", F.xxhash64("pieces", "labels"))
    shards = max(1, -(-dealt.count() // shard))
    dealt = dealt.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    number = {x: i for i, x in enumerate(LABELS)}
    weights = np.zeros(((1 << bits) + n, n))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(weights.astype(np.float32))

        def run(table):
            table = table.sort_by("h")
            pairs = [(p, [number[x] for x in y]) for p, y in zip(table.column("pieces").to_pylist(), table.column("labels").to_pylist())]
            w = walk(held.value.astype(np.float64), pairs, n)
            at = range(0, len(w), BLOCK)
            return pa.table({"block": pa.array(at, pa.int32()), "w": pa.array([w[i : i + BLOCK].tobytes() for i in at], pa.binary())})

        def mean(table):
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("w")) / table.num_rows
            return pa.table({"block": table.column("block").slice(0, 1), "w": pa.array([total.tobytes()], pa.binary())})

        made = dealt.groupBy("shard").applyInArrow(run, "block int, w binary").groupBy("block").applyInArrow(mean, "block int, w binary")
        for r in made.collect():  # the weights: a size set by bits and labels
            weights[r[0] : r[0] + BLOCK] = np.frombuffer(r[1], np.float64).reshape(-1, n)
        held.unpersist()
    return weights.astype(np.float32)


def tag(rows: DataFrame, weights: np.ndarray, key: str) -> DataFrame:
    """tokens (key, win, pos, start, end, masked, label) of sequences(), labelled by Viterbi."""
    held, illegal = rows.sparkSession.sparkContext.broadcast(weights), allowed(LABELS)
    out = rows.select(key, "win", "pieces", "starts", "ends")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        w, n = held.value, len(LABELS)
        bits = (len(w) - n).bit_length() - 1
        for b in batches:
            rows = [tuple(p) for p in b.column("pieces").to_pylist()]
            told = {p: [LABELS[i] for i in viterbi(w[features(list(p), bits)].sum(1), w[-n:] + illegal, illegal[0])] for p in set(rows)}
            found = [told[p] for p in rows]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("win"), b.column("starts"), b.column("ends"), pa.array(found, pa.list_(pa.string()))], [key, "win", "starts", "ends", "labels"])

    got = out.mapInArrow(run, f"{key} {kind}, win int, starts array<int>, ends array<int>, labels array<string>")
    flat = got.select(key, "win", F.posexplode(F.arrays_zip("starts", "ends", "labels")).alias("pos", "x"))
    return flat.select(key, "win", "pos", F.col("x.starts").alias("start"), F.col("x.ends").alias("end"), F.lit(False).alias("masked"), F.col("x.labels").alias("label"))


def scores(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """type: n (gold spans), found, located (gold spans met by a span of the type): recall and precision."""
    g = gold.select(key, "start", "end", "type")
    f = found.select(key, "start", "end", "type")
    meets = lambda a, b: a.alias("a").join(b.alias("b"), (F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))) & (F.col("a.type") == F.col("b.type")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")), "left_semi")
    n = g.groupBy("type").agg(F.count("*").alias("n"))
    hit = meets(g, f).groupBy("type").agg(F.count("*").alias("located"))
    many = f.groupBy("type").agg(F.count("*").alias("found"))
    right = meets(f, g).groupBy("type").agg(F.count("*").alias("right"))
    out = n.join(hit, "type", "full").join(many, "type", "full").join(right, "type", "full").na.fill(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("type", "n", "found", share("located", "n").alias("recall"), share("right", "found").alias("precision"))
