"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt by hash into shards of about SHARD rows.  Each shard builds its
own graph: vectors enter in batches, a greedy beam search over what is already in
proposes neighbours, and relaxed distance pruning (a neighbour goes when a kept one
is ALPHA times nearer to it) keeps diverse edges, also for the edges back.  A query
searches the graph of every shard; the best of all shards are ranked by exact
double-precision distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARD = 4096
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 48, 96, 1.2
EXPAND = 4  # nodes expanded in one step of a beam
BATCH = 256
BLOCK = 16_384  # queries that meet a shard in one task


def search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of q at once: ids (-1 where fewer are met) and squared
    distances (float32 arithmetic), nearest first."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n), bool)
    stamp = np.zeros((b, n), np.int32)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    new = np.broadcast_to(starts.astype(np.int32), (b, len(starts)))
    qn = (q * q).sum(1)[:, None]
    while True:
        live = new >= 0
        at = np.where(live, new, 0)
        order = np.broadcast_to(np.arange(at.shape[1], dtype=np.int32), at.shape)
        stamp[rows, np.where(live, at, at[:, :1])] = -1
        r, c = np.nonzero(live)
        stamp[r, at[r, c]] = c
        live &= ~seen[rows, at] & (stamp[rows, at] == order)
        r, c = np.nonzero(live)
        seen[r, at[r, c]] = True
        d = np.full(at.shape, np.inf, np.float32)
        hit = at[r, c]
        d[r, c] = norms[hit] - 2 * np.einsum("ij,ij->i", x[hit], q[r]) + qn[r, 0]
        all_d = np.concatenate([dist, d], 1)
        all_i = np.concatenate([ids, np.where(live, at, -1)], 1)
        all_f = np.concatenate([done, ~live], 1)
        pick = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.broadcast_to(np.arange(all_d.shape[1]), all_d.shape)
        dist, ids, done = all_d[rows, pick], all_i[rows, pick], all_f[rows, pick]
        todo = np.where(done, np.inf, dist)
        e = min(EXPAND, todo.shape[1])
        best = np.argpartition(todo, e - 1, axis=1)[:, :e]
        ok = np.isfinite(todo[rows, best])
        if not ok.any():
            break
        done[rows, best] = True
        chosen = np.where(ok, ids[rows, best], 0)
        new = np.where(ok[:, :, None], graph[chosen], -1).reshape(b, -1)
    order = np.argsort(dist, axis=1, kind="stable")
    return ids[rows, order], dist[rows, order]


def prune(x: np.ndarray, norms: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each row's candidates (-1: none), at most degree stay."""
    b = len(own)
    rows = np.arange(b)
    alive = (cand >= 0) & (cand != own[:, None])
    at = np.where(alive, cand, 0)
    order = np.argsort(np.where(alive, at, -1), axis=1, kind="stable")
    line = np.take_along_axis(np.where(alive, at, -1), order, 1)
    twice = np.zeros_like(alive)
    np.put_along_axis(twice, order[:, 1:], line[:, 1:] == line[:, :-1], 1)
    alive &= ~twice
    v = x[at]
    d = np.maximum(norms[at] - 2 * np.einsum("bcd,bd->bc", v, x[own]) + norms[own][:, None], 0)
    out = np.full((b, degree), -1, np.int32)
    a2 = np.float32(alpha * alpha)
    for k in range(degree):
        near = np.where(alive, d, np.inf)
        best = near.argmin(1)
        ok = np.isfinite(near[rows, best])
        if not ok.any():
            break
        chosen = at[rows, best]
        out[ok, k] = chosen[ok]
        between = norms[at] - 2 * np.einsum("bcd,bd->bc", v, x[chosen]) + norms[chosen][:, None]
        alive &= ~(ok[:, None] & (a2 * between <= d))
        alive[rows[ok], best[ok]] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, starts) of distinct vectors x (float32): graph holds degree neighbours
    a row (-1: none); from starts every vector can be reached."""
    n = len(x)
    norms = (x * x).sum(1)
    graph = np.full((n, degree), -1, np.int32)
    middle = int((norms - 2 * x @ x.mean(0)).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([middle], order[order != middle]))
    starts, inside = np.array([middle]), 1
    while inside < n:
        new = order[inside : inside + min(inside, BATCH)]
        cand = search(x, norms, graph, starts, x[new], beam)[0]
        graph[new] = prune(x, norms, new, cand, degree, alpha)
        inside += len(new)
        # Edges back: those that find room are added, full lists are pruned anew.
        src, dst = np.repeat(new, degree), graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, many = np.unique(dst, return_index=True, return_counts=True)
        for i in range(0, len(to), BATCH):
            t, f, m = to[i : i + BATCH], first[i : i + BATCH], many[i : i + BATCH]
            more = np.full((len(t), int(m.max())), -1, np.int32)
            r = np.repeat(np.arange(len(t)), m)
            c = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            more[r, c] = src[f[0] : f[-1] + m[-1]]
            graph[t] = prune(x, norms, t, np.concatenate([graph[t], more], 1), degree, alpha)
    reached = np.zeros(n, bool)
    while not reached.all():
        seeds = starts[~reached[starts]]
        if not len(seeds):
            seeds = np.flatnonzero(~reached)[:1]
            starts = np.append(starts, seeds)
        front = seeds
        while len(front):
            reached[front] = True
            nxt = np.unique(graph[front])
            nxt = nxt[nxt >= 0]
            front = nxt[~reached[nxt]]
    return graph, starts


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Without null and zero vectors and those with null or non-finite components."""
    c = F.col(vec)
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0)
    return vectors.where(c.isNotNull() & (F.size(c) > 0)).where(F.coalesce(good, F.lit(False)))


def index(vectors: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", shard_rows: int = SHARD) -> tuple[DataFrame, int]:
    """(index, number of shards): one row a shard with its vectors, ids and graph.

    Every usable row is indexed.  Equal vectors share a node, which lists their k + 1
    smallest ids: with ties going to smaller ids no other one can be among k nearest.
    Rows of a null id are left out, as are those of another length than most (the
    longer one where equal).
    """
    clean = usable(vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col(key).isNotNull()), "v")
    sizes = sorted(((r[1], r[0]) for r in clean.groupBy(F.size("v")).count().collect()), reverse=True)
    clean = clean.where(F.size("v") == (sizes[0][1] if sizes else 0))
    first = clean.withColumn("nth", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = C.materialize(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def run(t):
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        ids = t.column("ids").to_pylist()
        ends = np.cumsum([len(i) for i in ids])
        flat = np.array([i for x in ids for i in x], np.int64)
        graph, starts = build(v.astype(np.float32))
        blobs = [v.tobytes(), flat.tobytes(), ends.astype(np.int64).tobytes(), graph.tobytes(), starts.astype(np.int64).tobytes()]
        return pa.Table.from_arrays([t.column("shard").slice(0, 1), *(pa.array([x], pa.binary()) for x in blobs)], ["shard", "v", "ids", "ends", "graph", "starts"])

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    made = dealt.groupBy("shard").applyInArrow(C.frugal_group(run), "shard int, v binary, ids binary, ends binary, graph binary, starts binary")
    return C.materialize(made, "ann-index"), shards


def nearest(queries: DataFrame, held: DataFrame, shards: int, k: int, vec: str = "embedding", key: str = "vec_id", beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each usable query's k nearest found,
    itself (its id) excepted; fewer where the index holds fewer."""
    q = usable(queries.select(F.col(key).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("q")).where(F.col(key).isNotNull()), "q").dropDuplicates(["query_id"])
    blocks = max(1, -(-q.count() // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    many = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left, right):
        empty = out.empty_table()
        if not left.num_rows or not right.num_rows:
            return empty
        v_, ids_, ends_, graph_, starts_ = (left.column(c)[0].as_py() for c in ("v", "ids", "ends", "graph", "starts"))
        flat, ends, starts = (np.frombuffer(b, np.int64) for b in (ids_, ends_, starts_))
        n = len(ends)
        v, graph = np.frombuffer(v_, np.float64).reshape(n, -1), np.frombuffer(graph_, np.int32).reshape(n, -1)
        x = v.astype(np.float32)
        norms = (x * x).sum(1)
        same = right.filter(pa.compute.equal(pa.compute.list_value_length(right.column("q")), v.shape[1]))
        if not same.num_rows:
            return empty
        qid = np.array(same.column("query_id"))
        q = np.array(same.column("q").combine_chunks().flatten()).reshape(len(qid), -1)
        parts = []
        for i in range(0, len(qid), BATCH):
            part = q[i : i + BATCH]
            found, _ = search(x, norms, graph, starts, part.astype(np.float32), beam)
            for j, row in enumerate(found):
                row = row[row >= 0]
                d = np.sqrt(((v[row] - part[j]) ** 2).sum(1))
                if len(d) > k + 1:  # all nodes as near as the (k + 1)-th: ids decide among ties
                    near = d <= np.partition(d, k)[k]
                    row, d = row[near], d[near]
                count = ends[row] - np.where(row > 0, ends[row - 1], 0)
                ids = np.concatenate([flat[ends[r] - c : ends[r]] for r, c in zip(row, count)])
                d = np.repeat(d, count)
                own = ids != qid[i + j]
                ids, d = ids[own], d[own]
                best = np.lexsort((ids, d))[:k]
                parts.append((np.full(len(best), qid[i + j]), ids[best], d[best]))
        return pa.table([np.concatenate(c) for c in zip(*parts)], schema=out)

    hits = many.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(C.frugal_pair(run), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row of embeddings whose vec_id is divisible by 100.  Vectors
    null, zero or with null or non-finite components take no part, nor do null ids; equal
    vectors are told apart by their ids, ties go to the smaller one."""
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    held, shards = index(vectors, 10)
    return nearest(vectors.where(F.col("vec_id") % 100 == 0), held, shards, 10)
