"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct n-word shingles (its tokens).
Tokens have one global order: by frequency level, rare ones first, then by hash.
Two sets with |x & y| >= r |x | y| share tokens in their prefixes; a rare token is
indexed by itself.  For frequent tokens the prefixes are extended by g tokens and cut
into g hash segments: more than g shared ones put two into one segment, so pairs of
frequent tokens of a segment are indexed, never the single ones.  Groups under one
index key stay as small as the frequency bound; candidates are verified on whole sets.

Classes come from a count table of fixed size over all documents, so any order it
gives is a right one and only the speed hangs on it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

CELL_BITS = 24  # the table of frequencies has no more cells (bytes) than this many bits name
FREQUENT = 32  # a cell with as many sets, and twice the mean, is of the frequent class
STEPS = 160  # sizes up to it are planned one by one
SALTS = 8  # parts of a node of many links
CHUNK, FLUSH = 256, 1_000_000
U = np.uint64
LOW = U(1 << 62)


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte (capitals as small letters), and which are white."""
    values = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)
    values[65:91] = values[97:123]
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    return values, white


VALUES, WHITE = byte_tables()
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U(pow(base, filled, 1 << 64))
        filled += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and words per text.  A word's hash is a polynomial
    in its bytes, read off one running sum over all texts."""
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    white = WHITE[b]
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    ends = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[b] * powers(BASE, len(b)), dtype=np.uint64)))
    h = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(b))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(x) + 1 for x in raw])
    cut = np.searchsorted(starts, bounds)
    return h, np.diff(np.concatenate(([0], cut)))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for the whole sequence where
    it has fewer than n words; none without words."""
    raw = [t.encode("utf-8") if t else b"" for t in texts]
    if not raw:
        return []
    h, counts = word_hashes(raw)
    many = np.zeros(len(h), np.uint64)
    size = len(h) - n + 1
    if size > 0:
        acc = np.zeros(size, np.uint64)
        for i in range(n):
            acc = acc * U(BASE) + h[i : i + size]
        many[:size] = mix(acc)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(many[at : at + c - n + 1]))
        elif c:
            acc = c
            for x in h[at : at + c].tolist():
                acc = (acc * BASE + x) & MASK
            out.append(mix(np.array([acc], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    if not len(s):
        return 0
    x = mix(s + U(len(s)))
    both = int(x.sum(dtype=np.uint64)) * BASE ^ int(mix(x ^ U(INVERSE)).sum(dtype=np.uint64))
    return int(np.array([both & MASK], np.uint64).astype(np.int64)[0])


class Plan:
    """Thresholds for linked: den * |x & y| >= num * |x | y|."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def least(self, size: int) -> int:
        """The least overlap of a set of that size with any it links to."""
        return -(-self.num * size // self.den)

    def segments(self, size: int) -> int:
        """Segments where size is the larger set's: fewer than the tokens that a link
        needs.  0 (single tokens of both classes) only where one common token can be a link."""
        least = self.least(size)
        return 0 if least < 2 else 1 << int(math.log2(max(1, min((size - least) / 2, least - 1))))

    def reach(self, size: int) -> set[int]:
        """Segments that a pair with a set of that size may use (its own size, or
        that of a larger partner)."""
        top = size * self.den // self.num
        # A pair's overlap is the larger set's least at the least, the smaller set's size at most.
        out, s = set(), size
        while s <= top:
            out.add(self.segments(s))
            s = s + 1 if s < STEPS else max(s + 1, min(top, s + s // 64) if s < top else top + 1)
        out.add(self.segments(top))
        return out

    def keys(self, s: np.ndarray, levels: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(single keys, combination keys, all tokens of the prefix) of set s.
        levels: a small number for each cell of hashes; tokens are ordered by it."""
        size = len(s)
        lack = size - self.least(size)
        level = levels[(s >> U(64 - len(levels).bit_length() + 1)).astype(np.int64)]
        order = np.argsort(level, kind="stable")
        s, level = s[order], level[order]
        rare, often = s[level < frequent], s[level >= frequent]
        single = rare[: lack + 1]
        if len(single) > lack:
            return single, np.zeros(0, np.uint64), single
        pairs, used = [], 0
        for g in self.reach(size):
            part = often[: lack + 1 - len(rare) + g]
            used = max(used, len(part))
            if not g:
                pairs.append(mix(part ^ U(BASE)))
                continue
            seg = (mix(part) % U(g)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            p, seg = part[order], seg[order]
            for d in range(1, len(p)):
                same = seg[d:] == seg[:-d]
                if not same.any():
                    break
                pairs.append(mix(p[:-d][same] * U(BASE) + mix(p[d:][same] + U(g))))
        return single, np.concatenate(pairs), np.concatenate([rare, often[:used]])


def named_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """(node, size, low, doc_id, copy) of every row: its set's name and size, how many
    of its tokens are in the low quarter of all hashes, and the text's hash."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                sets = shingle_sets(b.column(1).to_pylist(), plan.n)
                low = [int(np.searchsorted(s, LOW)) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(low, pa.int64()), b.column(0), b.column(2)], ["node", "size", "low", "doc_id", "copy"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(C.frugal(run), "node long, size long, low long, doc_id long, copy long")


def shared_tokens(rows: DataFrame, slices: int, tokens_of) -> DataFrame:
    """(node, shared): how many of a set's tokens other sets have, too (more where a set is
    read by several tasks).  tokens_of makes
    (node, tokens) of a batch's rows.  Tokens go to slices by their last bits, a slice
    holds four bytes of each: as good as never are two taken for one, and then a set
    only seems to share more."""

    def run(batches):
        keep, names, n, seen = [], [], 0, set()
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                for k, s in tokens_of(whole.slice(i, CHUNK)):
                    if len(s) and k not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(k)
                        keep.append(s)
                        names.append(k)
                        n += len(s)
                        if n >= FLUSH or len(names) > 60_000:
                            yield emit(keep, names)
                            keep, names, n = [], [], 0
        if keep:
            yield emit(keep, names)

    def emit(keep, names):
        flat = np.concatenate(keep)
        who = np.repeat(np.arange(len(keep), dtype=np.uint16), [len(s) for s in keep])
        order = np.lexsort((who, flat))
        flat, who = flat[order], who[order]
        same, edge = flat[1:] == flat[:-1], np.zeros(1, bool)
        after = np.concatenate((edge, same))
        many = after | np.concatenate((same, edge))
        # Tokens that several of these sets have are counted here; of each, one entry of no
        # set goes on.  So a token's group has at most one entry of every flush.
        mine = np.bincount(who[many], minlength=len(keep))
        who = np.where(many, len(keep), who).astype(np.uint16)[~after]
        flat = flat[~after]
        part = (flat % U(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        flat, who = (flat[order] >> U(28)).astype(np.uint32), who[order]
        at = np.searchsorted(part[order], np.arange(slices + 1))
        full = [i for i in range(slices) if at[i] < at[i + 1]]
        rows, names = [[], [], []], np.array([*names, 0], np.int64)
        for i in full:
            used, back = np.unique(who[at[i] : at[i + 1]], return_inverse=True)
            for r, x in zip(rows, (names[used], back.astype(np.uint16), flat[at[i] : at[i + 1]])):
                r.append(x.tobytes())
        own = np.flatnonzero(mine)
        for r, x in zip(rows, (names[own], mine[own].astype(np.int64), own[:0])):
            r.append(x.tobytes())
        where = -1 - int(names[:-1].sum() % slices)
        return pa.RecordBatch.from_arrays([pa.array([*full, where], pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], ["s", "names", "who", "token"])

    def count(t):
        if t.column("s")[0].as_py() < 0:
            node, n = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("names", "who"))
            node, back = np.unique(node, return_inverse=True)
            return pa.Table.from_arrays([pa.array(node), pa.array(np.bincount(back, n, len(node)).astype(np.int64))], ["node", "n"])
        node, token = [], []
        for names, who, tok in zip(*(t.column(c).to_pylist() for c in ("names", "who", "token"))):
            node.append(np.frombuffer(names, np.int64)[np.frombuffer(who, np.uint16)])
            token.append(np.frombuffer(tok, np.uint32))
        node, token = np.concatenate(node), np.concatenate(token)
        order = np.lexsort((node, token))
        node, token = node[order], token[order]
        own = np.concatenate(([True], (node[1:] != node[:-1]) | (token[1:] != token[:-1])))
        node, token = node[own], token[own]
        group = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
        many = np.bincount(group, np.where(node == 0, 2, 1))[group] > 1
        node, n = np.unique(node[many & (node != 0)], return_counts=True)
        return pa.Table.from_arrays([pa.array(node), pa.array(n.astype(np.int64))], ["node", "n"])

    rows = rows.mapInArrow(C.frugal(run), "s int, names binary, who binary, token binary")
    return rows.groupBy("s").applyInArrow(C.frugal_group(count), "node long, n long").groupBy("node").agg(F.sum("n").alias("shared"))


def classes(sets: DataFrame, cells: int) -> tuple[np.ndarray, int]:
    """The frequency level (log2) of each cell of token hashes, by their first bits, and
    the level from which on tokens are of the frequent class."""
    shift, slices = U(64 - cells.bit_length() + 1), 32

    def run(batches):
        keep, n = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                keep.append(np.frombuffer(x, np.uint64) >> shift)
                n += len(keep[-1])
                if n >= 2 * FLUSH:
                    yield pack(keep)
                    keep, n = [], 0
        if keep:
            yield pack(keep)

    def pack(keep):
        at, n = np.unique(np.concatenate(keep), return_counts=True)
        cut = np.searchsorted(at, np.arange(slices + 1, dtype=np.uint64) * U(cells // slices))
        full = [i for i in range(slices) if cut[i] < cut[i + 1]]
        parts = [[zlib.compress(x[cut[i] : cut[i + 1]].astype(np.uint32).tobytes(), 1) for i in full] for x in (at, n)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["s", "at", "n"])

    def add(t):
        s, total = t.column("s")[0].as_py(), np.zeros(cells // slices, np.int64)
        for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist()):
            total[np.frombuffer(zlib.decompress(at), np.uint32) - s * (cells // slices)] += np.frombuffer(zlib.decompress(n), np.uint32)
        level = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.Table.from_arrays([t.column("s").slice(0, 1), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([int(total.sum())])], ["s", "level", "n"])

    levels, tokens = np.zeros((slices, cells // slices), np.uint8), 0
    rows = sets.select("set").mapInArrow(C.frugal(run), "s int, at binary, n binary").groupBy("s").applyInArrow(C.frugal_group(add), "s int, level binary, n long")
    for r in rows.toLocalIterator():
        levels[r[0]] = np.frombuffer(zlib.decompress(r[1]), np.uint8)
        tokens += r[2]
    return levels.ravel(), int(math.log2(max(FREQUENT, 2 * tokens / cells)))


def signatures(sets: DataFrame, plan: Plan, levels: np.ndarray, frequent: int) -> DataFrame:
    """(node, size, own, key): a row for every index key of every set."""
    held = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                rows = []
                for k, x, own in zip(*(c.slice(i, CHUNK).to_pylist() for c in b.columns)):
                    s = np.frombuffer(x, np.uint64)
                    one, two, _ = plan.keys(s, held.value, frequent)
                    rows.append((k, len(s), own, np.concatenate((one, two))))
                m = [len(r[3]) for r in rows]
                keys = np.concatenate([r[3] for r in rows]).astype(np.int64)
                cols = [np.repeat(np.array([r[j] for r in rows], np.int64), m) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(keys)], ["node", "size", "own", "key"])

    return sets.select("node", "set", "own").mapInArrow(C.frugal(run), "node long, size long, own long, key long")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits of tokens by their last bits, as longs: four to eight times as many as tokens, 1,024 at least."""
    size = 1 << max(10, 2 + max(len(tokens) - 1, 0).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(tokens % U(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def sketches(sets: DataFrame, plan: Plan, levels: np.ndarray, frequent: int) -> DataFrame:
    """(node, n, spare, bits): how many tokens each set's prefix has, how many of them have no bit
    to themselves, and the sketch of its bits."""
    held = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            rows = [plan.keys(np.frombuffer(x, np.uint64), held.value, frequent)[2] for x in b.column(1).to_pylist()]
            bits = [sketch(r) for r in rows]
            spare = [len(r) - int(np.unpackbits(x.view(np.uint8)).sum()) for r, x in zip(rows, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(spare, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["node", "n", "spare", "bits"])

    return sets.select("node", "set").mapInArrow(C.frugal(run), "node long, n long, spare long, bits array<long>")


def may_share(short, x: str = "x", y: str = "y"):
    """By the sketches of x and y: their prefixes can have as many tokens in common as short.  A
    bit that the other hasn't stands for a token at least that the other hasn't; the smaller
    sketch is repeated, as a token's place in it is that in the larger one, cut off."""
    a, b = F.col(f"{x}.bits"), F.col(f"{y}.bits")
    both = lambda a, b: F.aggregate(F.zip_with(a, b, lambda m, n: F.bit_count(m.bitwiseAND(n))), F.lit(0), lambda acc, n: acc + n)
    wide = lambda c, other: F.flatten(F.array_repeat(c, (F.size(other) / F.size(c)).cast("int")))
    most = (
        F.when(F.size(a) == F.size(b), both(a, b) + F.least(f"{x}.spare", f"{y}.spare"))
        .when(F.size(a) > F.size(b), both(a, wide(b, a)) + F.col(f"{x}.spare"))
        .otherwise(both(wide(a, b), b) + F.col(f"{y}.spare"))
    )
    return most >= short


def verify(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The linked ones of pairs (a, b), by their whole sets."""
    num, den = plan.num, plan.den

    def run(batches):
        for t in batches:
            good = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(den * common >= num * (len(both) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    wide = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return wide.select("a", "b", "x", "y").mapInArrow(C.frugal(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (a, b).
    Smallest labels spread and labels are looked up again each round (so a chain of d
    links takes about log d rounds); every round is a written table."""
    both = C.materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-links").withColumn("salt", salt("a"))
    labels = C.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "cc")
    while True:
        near = both.join(salted(labels), (F.col("b") == F.col("node")) & (F.col("salt") == F.col("part"))).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = C.materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-step")
        # Only labels are looked up again, and a label of many nodes by several tasks.
        roots = step.select("label").distinct().join(step.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        jump = salted(roots)
        new = step.withColumn("salt", salt("node")).join(jump.withColumnRenamed("part", "salt"), ["label", "salt"], "left")
        new = C.materialize(new.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "cc")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def salted(rows: DataFrame) -> DataFrame:
    """rows once for each part."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def star_links(shared: DataFrame, size_of: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The links of each node of shared (node, size, centre) with the centre that it has
    most keys in common with."""
    star = shared.groupBy(F.col("centre").alias("a"), F.col("node").alias("b"), "size", "own").count()
    star = star.withColumn("nth", F.row_number().over(W.partitionBy("b").orderBy(F.desc("count"), "a"))).where("nth = 1")
    star = star.join(size_of.select(F.col("node").alias("a"), F.col("size").alias("size_"), F.col("own").alias("own_")), "a")
    return C.materialize(verify(star.where(may_link(plan)).select("a", "b"), sets, plan), "jaccard-links")


def may_link(plan: Plan, size: str = "size", own: str = "own", size_: str = "size_", own_: str = "own_"):
    """By sizes and own tokens: the overlap can be as large as a link needs."""
    most = F.least(F.col(size) - F.col(own), F.col(size_) - F.col(own_))
    return most * (plan.num + plan.den) >= (F.col(size) + F.col(size_)) * plan.num


def unlike(rows: DataFrame) -> DataFrame:
    """rows (key, node) of one key for each list of nodes: keys of equal lists pair the same nodes.
    A list is known by its length and 128 bits."""
    lists = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q"))
    return rows.join(lists.where("n > 1").groupBy("n", "p", "q").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def meetings(named: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): all pairs of different components that share a key of named (key, node) and may link
    by sizes, own tokens and sketches.  nodes: each node's size, own, label, crowd (how many
    of nodes are in its component) and sketch.

    A node of a component meets the larger component of a node that it shares a key with once, whatever
    the number of such keys and nodes, and then all of that component's nodes.  So a pair is
    made once; only two that are alone in their components meet by the keys themselves."""
    least = F.expr(f"cast(ceil(cast({plan.num} * (x.size + y.size) as decimal(20,0)) / {plan.num + plan.den}) as long)")
    short = F.least(F.col("x.n") - F.col("x.size"), F.col("y.n") - F.col("y.size")) + least
    may = may_link(plan, "x.size", "x.own", "y.size", "y.own") & may_share(short)
    held = named.select("key", "node").join(nodes.select("node", "label", "crowd"), "node")
    alone = unlike(held.where("crowd = 1").select("key", "node")).join(nodes, "node")
    met = alone.alias("x").join(alone.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & may)
    groups = held.where("crowd > 1").select("key", "label", "crowd").distinct()
    larger = F.struct("x.crowd", "x.label") < F.struct("y.crowd", "y.label")
    far = held.alias("x").join(groups.alias("y"), (F.col("x.key") == F.col("y.key")) & larger).select("x.node", F.col("y.label").alias("group"))
    far = salted(C.materialize(far.distinct(), "jaccard-far").join(nodes, "node"))
    members = nodes.where("crowd > 1").withColumn("part", salt("node"))
    more = far.alias("x").join(members.alias("y"), (F.col("x.group") == F.col("y.label")) & (F.col("x.part") == F.col("y.part")) & may)
    pair = lambda m: m.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pair(met).unionByName(pair(more))


def joined(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, copy, node, n_shingles, label) for every row of docs (doc_id, text).

    copy is the text's hash, node names the shingle set (rows of one set link), label
    is the same for all rows reachable over links.  Rows without words or text have
    n_shingles 0, node 0 and link with nothing, in spite of their common label.
    Copies are never expanded into pairs.
    """
    plan = Plan(n, num, den)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = C.materialize(named_sets(docs, plan), "jaccard-named")
    # A set shares all but least - size of its tokens with any it links to, so of its low
    # tokens all but as many; sets that don't share so many with all others together go.
    slices = 1 << max(7, (base.count() // 4000).bit_length())
    kinds = base.where("size > 0").groupBy("node").agg(F.max("size").alias("size"), F.max("low").alias("low"), F.min("doc_id").alias("doc_id"))
    lack = F.col("size") - F.expr(f"cast(ceil(cast({num} * size as decimal(20,0)) / {den}) as long)")
    low = shared_tokens(docs.select("text"), slices, lambda b: [(node_of(s), s[: np.searchsorted(s, LOW)]) for s in shingle_sets(b.column(0).to_pylist(), n)])
    alive = kinds.join(low, "node", "left").where((F.col("low") <= lack) | (F.coalesce("shared", F.lit(0)) >= F.col("low") - lack))
    owners = C.materialize(alive.select("node", "doc_id"), "jaccard-owners")
    sets = C.materialize(sets_of(docs, owners, plan), "jaccard-sets")
    # The same again with all tokens: own counts those that no other of these sets has.
    # None of them can be common to a pair, which also bounds the overlap of each pair.
    common = shared_tokens(sets, slices, lambda b: [(k, np.frombuffer(x, np.uint64)) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
    size = (F.octet_length("set") / 8).cast("long")
    lack = size - F.expr(f"cast(ceil(cast({num} * octet_length(set) / 8 as decimal(20,0)) / {den}) as long)")
    sets = sets.join(C.maybe_broadcast(C.materialize(common, "jaccard-common")), "node").withColumn("own", F.greatest(size - F.col("shared"), F.lit(0))).where(F.col("own") <= lack)
    sets = C.materialize(sets.select("node", "set", "own"), "jaccard-sets")
    tokens = sets.agg(F.coalesce(F.sum(F.octet_length("set")) / 8, F.lit(1))).first()[0]
    cells = 1 << min(CELL_BITS, max(16, int(tokens).bit_length()))
    order = classes(sets, cells)
    keyed = signatures(sets, plan, *order).distinct()
    # Keys that one set alone has lead nowhere.  A key's centre is its set with the
    # fewest tokens of its own, the likeliest to be what the others are copies of.
    by = W.partitionBy("key")
    shared = C.materialize(
        keyed.withColumn("n", F.count("*").over(by)).where("n > 1").withColumn("centre", F.min(F.struct("own", "size", "node")).over(by)["node"]), "jaccard-keys"
    )
    # First every set meets the centre it shares most keys with, twice: most sets of a
    # large group are then in one component, and nothing in it needs to meet again.
    size_of = shared.groupBy("node").agg(F.max("size").alias("size"), F.max("own").alias("own"))
    linked = star_links(shared.where("node <> centre"), size_of, sets, plan)
    labels = components(linked)
    apart = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = W.partitionBy("key")
    apart = apart.withColumn("lo", F.min("label").over(own)).withColumn("hi", F.max("label").over(own)).where("lo <> hi")
    apart = apart.withColumn("centre", F.min(F.struct("label", "own", "size", "node")).over(own)["node"]).where("label <> lo").drop("label", "lo", "hi")
    linked = C.materialize(linked.union(star_links(apart, size_of, sets, plan)), "jaccard-links")
    labels = components(linked)
    # Then all pairs of different components that share a key: the join is complete.
    # The prefixes of linked sets have at least as many tokens in common as the one that
    # ends first has beyond those that its set may lack.
    named = shared.join(labels, "node", "left").select("key", "node", "size", "own", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    named = C.materialize(named.join(mixed, "key", "left_semi"), "jaccard-mixed")
    some = sets.join(C.maybe_broadcast(named.select("node").distinct()), "node", "left_semi")
    crowd = named.select("node", "label").distinct().groupBy("label").agg(F.count("*").alias("crowd"))
    nodes = named.select("node", "size", "own", "label").distinct().join(crowd, "label")
    nodes = C.materialize(nodes.join(C.materialize(sketches(some, plan, *order), "jaccard-sketches"), "node"), "jaccard-nodes")
    late = C.materialize(meetings(named, nodes, plan).distinct(), "jaccard-late")
    more = C.materialize(verify(late, sets, plan), "jaccard-links")
    if more.limit(1).count():
        labels = components(linked.union(more))
    return base.join(C.maybe_broadcast(labels), "node", "left").select("doc_id", "copy", "node", F.col("size").alias("n_shingles"), F.coalesce("label", "node").alias("label"))


def classes_of(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, node, n_shingles, component_id) for every row: component_id is the
    smallest doc_id reachable over links, the row's own where nothing links.  A null
    doc_id is linked like others and counts as the largest."""
    named = joined(docs, n, num, den)
    groups = named.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("label", "least")
    out = named.join(C.maybe_broadcast(C.materialize(groups, "jaccard-groups")), "label", "left")
    return out.select("doc_id", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked rows, that of the smallest doc_id
    (null is the largest; then of the smallest text hash).  All columns stay, and all
    rows that link with nothing, those without words among them."""
    named = C.materialize(joined(docs, n, num, den).where("n_shingles > 0").select("doc_id", "copy", "label"), "jaccard-named")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    groups = named.groupBy("label").agg(F.min(who).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = C.materialize(groups, "jaccard-groups")
    # Names that are no columns of docs.
    d, c, x, y = (C.free_name(docs, n) for n in ("d of row", "c of row", "x of row", "y of row"))
    gone = named.join(C.maybe_broadcast(groups), "label").where(~(who.eqNullSafe(F.col("first")))).select(F.col("doc_id").alias(d), F.col("copy").alias(c)).distinct()
    # A kept row that is there twice, word for word, stays once.
    twice = named.groupBy("doc_id", "copy").count().where("count > 1").select(F.col("doc_id").alias(d), F.col("copy").alias(c))
    named_docs = docs.withColumn(x, F.col("doc_id").cast("long")).withColumn(y, F.xxhash64("text"))
    same = F.col(x).eqNullSafe(F.col(d)) & (F.col(y) == F.col(c))
    kept = named_docs.join(C.maybe_broadcast(C.materialize(gone, "jaccard-gone")), same, "left_anti")
    twice = C.materialize(twice, "jaccard-twice")
    if twice.limit(1).count():
        twice = C.maybe_broadcast(twice)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([x, y]))
    return kept.select(*docs.columns)


def sets_of(docs: DataFrame, owners: DataFrame, plan: Plan) -> DataFrame:
    """(node, set) for the sets named by owners (node, doc_id): little-endian sorted hashes."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                sets = shingle_sets(b.column(1).to_pylist(), plan.n)
                keep = [j for j, (s, k) in enumerate(zip(sets, b.column(0).to_pylist())) if node_of(s) == k]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[j].as_py() for j in keep], pa.int64()), pa.array([sets[j].tobytes() for j in keep], pa.binary())], ["node", "set"])

    own = C.maybe_broadcast(owners.withColumnRenamed("doc_id", "own"))
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "text").mapInArrow(C.frugal(run), "node long, set binary").dropDuplicates(["node"])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, Jaccard similarity of at least 85/100, every whole text.  Null and
    empty texts have no shingles and link with nothing, repeated rows link, null ids stay."""
    return classes_of(C.table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")
