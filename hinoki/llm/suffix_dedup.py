"""Removal of repeated byte strings by a distributed merge sort of sparse suffixes.

A 200-byte string holds 153 48-byte grams; the one of the smallest hash is its anchor
(the leftmost of equal ones), wherever the string stands.  So it is enough to sort the
suffixes that start at anchors, about one of 77 bytes, and of these the ones whose gram
occurs more than once.  Grams are counted from sums that each task has made of its own;
their places are then looked up block by block, never gathered by gram.

Every task sorts the suffixes it meets and front-codes them (length of the prefix
shared with the one before, then the rest); the runs are exchanged by gram, so all
suffixes of a gram meet.  A loser tree merges the runs: it compares two suffixes only
behind the prefix that both are known to share with the last one out, and yields the
shared prefix lengths of the whole order.  A string at offset -o of its anchor is
repeated iff another suffix shares at least 200 - o bytes to the right and the text
before both anchors at least o bytes; the latter comes from the same lengths of the
reversed left texts.

Equal contexts of a task collapse into one before the exchange.  The suffixes of a gram
with more than HOT places (a passage in countless documents) would not fit one task;
its single strings are compared by 128-bit digests instead.  A task settles those it
meets twice itself and hands on each digest once, so that a digest's group holds at most
one entry of a task, however many documents share the string.  Both ways find the same
strings; texts are named by their 128-bit digests as well.  Verdicts travel in blocks and
become one row a text.

Null texts are empty; empty texts and those shorter than the strings have nothing
repeated; very long texts are searched whole; copies of a text are searched once and cut
alike; an empty table gives an empty one.  Columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .jaccard import BASE, INVERSE, mix, powers

LENGTH, GRAM = 200, 48
POSITION = 28  # bits of a place in one array pass
CHUNK, FLUSH = 1 << 20, 1 << 24  # bytes of text in one array pass, and before a task hands on
RUN = 60_000  # suffixes of one sorted run
HOT = 20_000
SALTS = 4  # parts of a slice's blocks
STRINGS = 1_000_000  # single strings of hot grams that a task holds
U = np.uint64
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])  # the name of a text
COPIES = 10_000  # rows of one text that may meet in a task
VALUES = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)
OTHER = np.random.default_rng(2).integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)


def window_hashes(b: np.ndarray, width: int, values: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of every string of that width; up and down: powers of BASE and INVERSE."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[b] * up[: len(b)], dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * down[: len(b) - width + 1])


class Anchors:
    """Finds anchors in joined texts; keeps the power tables between passes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)

    def find(self, raw: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of texts of at least length bytes each: (text, place, hash, lo, hi) of every
        anchor; lo..hi are the offsets -o of the strings it is the anchor of."""
        b = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes)
        self.grow(len(b))
        grams = window_hashes(b, self.gram, VALUES, self.up, self.down)
        low = (grams >> U(POSITION) << U(POSITION)) | np.arange(len(grams), dtype=np.uint64)
        width, want = 1, self.length - self.gram + 1
        while width < want:
            step = min(width, want - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        inside = np.zeros(len(b) + 1, np.int32)
        np.add.at(inside, ends - sizes, 1)
        np.add.at(inside, ends - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside)[: len(low)] > 0)
        place = (low[at] & U((1 << POSITION) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        place, i0, i1 = place[first], at[first], at[last]
        text = np.searchsorted(ends, place, "right")
        return text, place - (ends - sizes)[text], grams[place], place - i1, place - i0


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least at."""
    n = min(len(a), len(b))
    while at + 16 <= n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_code(sorted_: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths with the string before, and the joined rests."""
    lcp = np.zeros(len(sorted_), np.int32)
    lcp[1:] = prefixes(sorted_)
    return lcp, b"".join([s[n:] for s, n in zip(sorted_, lcp.tolist())])


def prefixes(strings: list[bytes]) -> np.ndarray:
    """Common prefix lengths of neighbours."""
    out = []
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    for i in range(0, len(strings) - 1, 8192):
        part = strings[i : i + 8193]
        wide = max(1, int(size[i : i + 8193].max()))
        m = np.frombuffer(b"".join([s.ljust(wide, b"\0") for s in part]), np.uint8).reshape(len(part), wide)
        differ = m[1:] != m[:-1]
        hit = differ.argmax(1)
        hit[~differ.any(1)] = wide
        out.append(np.minimum(hit, np.minimum(size[i : i + len(part) - 1], size[i + 1 : i + len(part)])))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def unfold(lcp: list[int], sizes: list[int], rest: bytes):
    """The strings of a front-coded run, one after another."""
    last, at = b"", 0
    for n, size in zip(lcp, sizes):
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        yield last


class LoserTree:
    """Merges front-coded runs.  Each contender keeps the length of the prefix that it
    shares with the last string out; of two, the one that shares more comes first, and
    only where both share as much are they compared, behind that prefix."""

    def __init__(self, runs: list[tuple[list[int], list[int], bytes]]):
        self.n = 1 << max(0, (len(runs) - 1).bit_length())
        self.feeds = [unfold(*r) for r in runs]
        self.lcps = [iter(r[0]) for r in runs]
        self.now: list[bytes | None] = [None] * self.n
        self.known = [0] * self.n
        for i in range(len(runs)):
            self.pull(i)
        self.losers = [0] * self.n
        self.winner = self.seed(1) if self.n > 1 else 0

    def pull(self, i: int) -> None:
        self.now[i] = next(self.feeds[i], None)
        self.known[i] = next(self.lcps[i], 0)

    def seed(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self.seed(2 * node), self.seed(2 * node + 1)
        win, lose = self.play(a, b)
        self.losers[node] = lose
        return win

    def play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.now[a], self.now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        known = self.known
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def __iter__(self):
        """(run, shared prefix with the string before) in order; the strings of a run
        come in the run's order."""
        losers, play, n = self.losers, self.play, self.n
        while self.now[w := self.winner] is not None:
            yield w, self.known[w]
            self.pull(w)
            node = (w + n) >> 1
            while node:
                w, losers[node] = play(w, losers[node])
                node >>= 1
            self.winner = w


def repeated_offsets(lcp: np.ndarray, left: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(element, o1, o2): the strings at offsets -o1..-o2 of the element's anchor also
    start elsewhere.  Elements stand in suffix order with shared prefixes lcp."""
    n = len(left)
    back = [s[::-1] for s in left]
    order = sorted(range(n), key=back.__getitem__)
    shared = np.concatenate(([0], prefixes([back[i] for i in order])))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    hit: list[tuple[np.ndarray, int]] = []
    for o in range(int(lo.min(initial=0)), int(hi.max(initial=-1)) + 1):
        who = np.flatnonzero((lo <= o) & (o <= hi))
        right_class = np.cumsum(lcp < length - o)[who]
        left_class = np.cumsum(shared < o)[rank[who]]
        _, back_, count = np.unique(right_class * (n + 1) + left_class, return_inverse=True, return_counts=True)
        twice = who[count[back_] > 1]
        if len(twice):
            hit.append((twice, o))
    if not hit:
        return []
    who = np.concatenate([a for a, _ in hit])
    off = np.concatenate([np.full(len(a), o) for a, o in hit])
    by = np.lexsort((off, who))
    who, off = who[by], off[by]
    new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1))))
    end = np.concatenate((new[1:], [len(who)])) - 1
    return list(zip(who[new].tolist(), off[new].tolist(), off[end].tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def pack(*arrays) -> bytes:
    """Arrays and byte strings in one compressed block."""
    parts = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else a.tobytes()
        parts.append(len(raw).to_bytes(8, "little") + raw)
    return zlib.compress(b"".join(parts), 1)


def unpack(block: bytes, *kinds) -> list:
    raw, at, out = zlib.decompress(block), 0, []
    for k in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + n]
        out.append(part if k is bytes else np.frombuffer(part, k))
        at += 8 + n
    return out


def blocks_by(of: np.ndarray, n: int, cols: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Columns dealt by the number of (0..n-1), as packed blocks."""
    order = np.argsort(of, kind="stable")
    at = np.searchsorted(of[order], np.arange(n + 1))
    return [(i, pack(*(c[order[at[i] : at[i + 1]]] for c in cols))) for i in range(n) if at[i] < at[i + 1]]


def block_rows(rows: list[tuple[int, bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names)


def first_of(seen: set, key: bytes) -> bool:
    """Whether a task meets a text for the first time; a full memory forgets, and the text
    is taken again, which changes no result."""
    if key in seen:
        return False
    if len(seen) > 300_000:
        seen.clear()
    seen.add(key)
    return True


ANCHORS = (KEY, np.int32, np.uint64, np.uint8, np.uint8)
PLACE = np.dtype([("place", "<i4"), ("h", "<u8"), ("lo", "u1"), ("hi", "u1"), ("hot", "u1")])


def anchors(texts: DataFrame, slices: int, length: int) -> DataFrame:
    """(s, block): the anchors of all texts (key, text), dealt by gram."""

    def run(batches):
        find, rows, size, seen = Anchors(length, GRAM), [], 0, set()
        pend, raw, n = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not first_of(seen, key):
                    continue
                pend.append(key)
                raw.append(text.encode("utf-8"))
                n += len(raw[-1])
                if n >= CHUNK:
                    rows.append(one(find, pend, raw))
                    size += n
                    pend, raw, n = [], [], 0
                if size >= FLUSH:
                    yield emit(rows)
                    rows, size = [], 0
        if raw:
            rows.append(one(find, pend, raw))
        if rows:
            yield emit(rows)

    def one(find, keys, raw):
        text, place, h, lo, hi = find.find(raw)
        return np.frombuffer(b"".join(keys), KEY)[text], place.astype(np.int32), h, lo.astype(np.uint8), hi.astype(np.uint8)

    def emit(rows):
        cols = [np.concatenate(c) for c in zip(*rows)]
        return block_rows(blocks_by(((cols[2] >> U(40)) % U(slices)).astype(np.int64), slices, cols), ["s", "block"])

    return texts.mapInArrow(C.frugal(run), "s int, block binary")


def repeated_grams(blocks: DataFrame) -> DataFrame:
    """(s, grams): the grams of a slice that stand at more than one place, and which are hot."""

    def sums(batches):
        for b in batches:
            out = []
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, place, h, _, _ = unpack(x, *ANCHORS)
                # Two tasks may have read one text; its places are told apart by their names.
                mark = mix(key["a"] + place.astype(np.uint64) * BASE)
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                out.append((s, pack(h, n.astype(np.int64), mark[first])))
            yield block_rows(out, ["s", "block"])

    def add(t):
        h, n, mark = (np.concatenate(c) for c in zip(*(unpack(x, np.uint64, np.int64, np.uint64) for x in t.column("block").to_pylist())))
        order = np.lexsort((mark, h))
        h, n, mark = h[order], n[order], mark[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        group = np.cumsum(new) - 1
        total = np.bincount(group, n).astype(np.int64)
        # One place that was read by several tasks is no repeat.
        unlike = np.bincount(group, (n > 1) | np.concatenate(([False], (mark[1:] != mark[:-1]) & ~new[1:])))
        many = (total > 1) & (unlike > 0)
        return pa.Table.from_arrays([t.column("s").slice(0, 1), pa.array([pack(h[new][many], (total[many] > HOT).astype(np.uint8))], pa.binary())], ["s", "grams"])

    return blocks.mapInArrow(C.frugal(sums), "s int, block binary").groupBy("s").applyInArrow(C.frugal_group(add), "s int, grams binary")


def places_of(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, places): each text's anchors of repeated grams.  A slice's grams go to each of
    its SALTS parts, so the blocks of a hot gram are read by several tasks."""

    def run(batches):
        for b in batches:
            key, place = [], []
            for block, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (k, *cols), (h, hot) = unpack(block, *ANCHORS), unpack(grams, np.uint64, np.uint8)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(h, cols[1]), len(h) - 1)
                mine = np.flatnonzero(h[at] == cols[1])
                mine = mine[np.lexsort((k["b"][mine], k["a"][mine]))]
                rec = np.zeros(len(mine), PLACE)
                for name, c in zip(PLACE.names, (*cols, hot[at])):
                    rec[name] = c[mine]
                k = k[mine]
                if len(k):
                    cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
                    raw, names = rec.tobytes(), k.tobytes()
                    key += [names[16 * a : 16 * a + 16] for a in cut[:-1]]
                    place += [raw[PLACE.itemsize * a : PLACE.itemsize * z] for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(place, pa.binary())], ["key", "places"])

    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")
    grams = grams.select("s", "grams", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = blocks.withColumn("salt", salt).join(grams, ["s", "salt"])
    return met.select("block", "grams").mapInArrow(C.frugal(run), "key binary, places binary")


def suffix_runs(texts: DataFrame, parts: int, buckets: int, length: int) -> DataFrame:
    """(part, block) of texts (key, text, places): sorted front-coded runs of the suffixes
    at anchors, cut by gram; part -1 - i: slices of string digests of hot grams;
    part -1 - parts - i: verdicts that a task found itself."""

    def run(batches):
        seen, held, hot = set(), {}, []
        find = Anchors(length, GRAM)
        n = m = 0
        for b in batches:
            for key, text, places in zip(*(c.to_pylist() for c in b.columns)):
                if not first_of(seen, key):
                    continue
                raw = text.encode("utf-8")
                rec = np.frombuffer(b"".join(places), PLACE)
                if rec["hot"].any():
                    own = rec[rec["hot"] == 1]
                    bytes_ = np.frombuffer(raw, np.uint8)
                    find.grow(len(raw))
                    starts = np.unique(np.concatenate([np.arange(p - h, p - l + 1) for p, l, h in zip(own["place"].tolist(), own["lo"].tolist(), own["hi"].tolist())]))
                    two = [window_hashes(bytes_, length, v, find.up, find.down)[starts] for v in (VALUES, OTHER)]
                    hot.append((np.repeat(np.frombuffer(key, KEY), len(starts)), starts.astype(np.int64), *two))
                    m += len(starts)
                    rec = rec[rec["hot"] == 0]
                for p, h, lo, hi in zip(rec["place"].tolist(), rec["h"].tolist(), rec["lo"].tolist(), rec["hi"].tolist()):
                    # The right text reaches to the end of the last string, the left to the start of the first.
                    same = held.setdefault((raw[p : p - lo + length], raw[p - hi : p]), [])
                    same.append((h, key, p, lo, hi))
                    n += 1
                if n >= RUN:
                    yield emit(held)
                    held, n = {}, 0
                if m >= STRINGS:
                    yield digests(hot)
                    hot, m = [], 0
        if held:
            yield emit(held)
        if hot:
            yield digests(hot)

    def emit(held):
        by: dict[int, tuple[list, list]] = {}
        for (right, left), same in held.items():
            h = same[0][0]
            suffixes, done = by.setdefault((h >> 20) % parts, ([], []))
            suffixes.append((right, left, *same[0][1:]))
            if len(same) > 1:  # all its strings are repeated here already
                done.extend((k, p - hi, p - lo + length) for _, k, p, lo, hi in same)
        out = []
        for part, (suffixes, done) in by.items():
            suffixes.sort()
            lcp, rest = front_code([s[0] for s in suffixes])
            cols = list(zip(*suffixes))
            sizes, lefts = ([len(x) for x in c] for c in cols[:2])
            who, a, z = zip(*done) if done else ((), (), ())
            out.append((part, pack(lcp.astype(np.uint8), np.array(sizes, np.uint8), rest, np.array(lefts, np.uint8), b"".join(cols[1]), b"".join(cols[2]), np.array(cols[3], np.int32), np.array(cols[4], np.uint8), np.array(cols[5], np.uint8), b"".join(who), np.array(a, np.int64), np.array(z, np.int64))))
        return block_rows(out, ["part", "block"])

    def digests(hot):
        key, start, a, b = (np.concatenate(c) for c in zip(*hot))
        order = np.lexsort((b, a))
        key, start, a, b = (x[order] for x in (key, start, a, b))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        count = np.diff(np.flatnonzero(new), append=len(a))
        twice = np.repeat(count > 1, count)
        rows = [(-1 - parts - i, x) for i, x in verdicts(*runs_of(key[twice], start[twice], length), buckets)]
        # Of a string that is settled here the others need to know only that it is there.
        start = np.where(twice, -1, start)
        cols = [x[new] for x in (key, start, a, b)]
        rows += [(-1 - i, x) for i, x in blocks_by((cols[2] % U(parts)).astype(np.int64), parts, cols)]
        return block_rows(rows, ["part", "block"])

    return texts.mapInArrow(C.frugal(run), "part int, block binary")


def runs_of(key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, z) of starts of repeated strings, neighbouring ones joined."""
    order = np.lexsort((start, key["b"], key["a"]))
    key, start = key[order], start[order]
    if not len(key):
        return key, start, start
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1))))
    end = np.concatenate((new[1:], [len(key)])) - 1
    return key[new], start[new], start[end] + length


def verdicts(key: np.ndarray, a: np.ndarray, z: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Spans as blocks, dealt by text."""
    return blocks_by((key["a"] % U(buckets)).astype(np.int64), buckets, [key, a.astype(np.int64), z.astype(np.int64)])


def repeated_spans(runs: DataFrame, parts: int, buckets: int, length: int) -> DataFrame:
    """(key, spans): for each text the disjoint spans of bytes that repeated strings cover."""

    def run(t):
        part = t.column("part")[0].as_py()
        if part < -parts:  # found by a task already
            return block_table([(-1 - parts - part, x) for x in t.column("block").to_pylist()])
        return block_table(verdicts(*(by_digest(t) if part < 0 else by_merge(t)), buckets))

    def block_table(rows):
        return pa.Table.from_batches([block_rows(rows, ["bucket", "block"])])

    def by_digest(t):
        key, start, a, b = (np.concatenate(c) for c in zip(*(unpack(x, KEY, np.int64, np.uint64, np.uint64) for x in t.column("block").to_pylist())))
        # A text that two tasks read meets itself; one of the two is left out.
        order = np.lexsort((start, key["b"], key["a"], b, a))
        key, start, a, b = (x[order] for x in (key, start, a, b))
        own = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) | (start < 0)
        key, start, a, b = (x[own] for x in (key, start, a, b))
        group = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
        count = np.bincount(group, np.where(start < 0, 2, 1))[group]
        hit = (count > 1) & (start >= 0)
        return runs_of(key[hit], start[hit], length)

    def by_merge(t):
        blocks = [unpack(x, np.uint8, np.uint8, bytes, np.uint8, bytes, KEY, np.int32, np.uint8, np.uint8, KEY, np.int64, np.int64) for x in t.column("block").to_pylist()]
        tree = LoserTree([(b[0].tolist(), b[1].tolist(), b[2]) for b in blocks])
        which, lcp = [], []
        for w, n in tree:
            which.append(w)
            lcp.append(n)
        which = np.array(which, np.int64)
        at = np.empty(len(which), np.int64)  # the element's place in its run
        for i in range(len(blocks)):
            m = which == i
            at[m] = np.arange(int(m.sum()))
        offset = np.cumsum([0, *(len(b[0]) for b in blocks)])[:-1][which] + at
        lefts = []
        for b in blocks:
            ends = np.cumsum(b[3].astype(np.int64)).tolist()
            lefts.extend(b[4][z - n : z] for z, n in zip(ends, b[3].tolist()))
        key = np.concatenate([b[5] for b in blocks])[offset]
        place, lo, hi = (np.concatenate([b[j] for b in blocks]).astype(np.int64)[offset] for j in (6, 7, 8))
        # The same anchor handed on by two tasks counts once.
        order = np.lexsort((place, key["b"], key["a"]))
        again = (key[order][1:] == key[order][:-1]) & (place[order][1:] == place[order][:-1])
        if again.any():
            keep = np.ones(len(key), bool)
            keep[order[1:][again]] = False
            lcp = thinned(np.array(lcp), keep)
            key, place, lo, hi, offset = (x[keep] for x in (key, place, lo, hi, offset))
        found = repeated_offsets(np.array(lcp), [lefts[i] for i in offset.tolist()], lo, hi, length)
        who, o1, o2 = (np.array(c, np.int64) for c in (zip(*found) if found else ((), (), ())))
        more = [b[9:] for b in blocks]
        return (np.concatenate([key[who], *(m[0] for m in more)]), *(np.concatenate([x, *(m[j] for m in more)]) for j, x in ((1, place[who] - o2), (2, place[who] - o1 + length))))

    def join(t):
        key, a, z = (np.concatenate(c) for c in zip(*(unpack(x, KEY, np.int64, np.int64) for x in t.column("block").to_pylist())))
        order = np.lexsort((z, a, key["b"], key["a"]))
        key, a, z = key[order], a[order], z[order]
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        a, z, names = a.tolist(), z.tolist(), key.tobytes()
        spans = [[{"a": x, "z": y} for x, y in merged(list(zip(a[i:j], z[i:j])))] for i, j in zip(cut, cut[1:])]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        return pa.Table.from_arrays([pa.array([names[16 * i : 16 * i + 16] for i in cut[:-1]], pa.binary()), pa.array(spans, kind)], ["key", "spans"])

    by_part = runs.groupBy("part").applyInArrow(C.frugal_group(run), "bucket int, block binary")
    return by_part.groupBy("bucket").applyInArrow(C.frugal_group(join), "key binary, spans array<struct<a:bigint,z:bigint>>")


def thinned(lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Shared prefixes with the string before, where only the kept ones are left."""
    at = np.flatnonzero(keep)
    return np.minimum.reduceat(lcp, np.concatenate(([0], at[:-1] + 1))) if len(at) else lcp[:0]


def coverage(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frame, spans, often): frame has row (a struct of docs' columns), text (not null), key
    and size; spans (key, spans): for each text that has any, the bytes covered by strings
    of length bytes that also start elsewhere in docs, copies of the text included; often
    (key, n): the texts of many copies.  Texts shorter than length have none."""
    if length <= GRAM or length > 250:
        raise ValueError(f"strings of {GRAM + 1} to 250 bytes")
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.octet_length(text).cast("long").alias("size"))
    long_ = frame.where(F.col("size") >= length)
    kinds = C.materialize(long_.groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size")), "suffix-keys")
    often = kinds.where(F.col("n") > COPIES).select("key", "n")
    total = kinds.agg(F.sum("size")).first()[0] or 0
    slices = 1 << max(4, (total // 16_000_000).bit_length())
    blocks = C.materialize(anchors(long_.select("key", "text"), slices, length), "suffix-blocks")
    grams = repeated_grams(blocks)
    places = C.materialize(places_of(blocks, grams).groupBy("key").agg(F.collect_set("places").alias("places")), "suffix-anchors")
    many = int(places.agg(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)))).first()[0] or 0)
    parts = max(12, many // (PLACE.itemsize * 60_000))
    buckets = max(12, total // 64_000_000)
    kept = long_.select("key", "text").join(C.maybe_broadcast(places.select("key")), "key", "left_semi")
    texts = with_spans(kept, places, often)
    spans = repeated_spans(suffix_runs(texts, parts, buckets, length), parts, buckets, length)
    whole = kinds.where("n > 1").select("key", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("z"))).alias("spans"))
    spans = C.materialize(spans.join(whole.select("key"), "key", "left_anti").unionByName(whole), "suffix-spans")
    return frame, spans, often


def with_spans(frame: DataFrame, held: DataFrame, often: DataFrame, how: str = "inner") -> DataFrame:
    """frame joined to held by key.  The keys of many rows (often: key, n) are dealt to as
    many parts as leave about COPIES rows in each."""
    often = C.maybe_broadcast(often.select("key", F.ceil(F.col("n") / COPIES).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)).cast("int")
    frame = frame.join(often, "key", "left").withColumn("part", part).drop("parts")
    last = F.coalesce(F.col("parts"), F.lit(1)) - 1
    held = held.join(often, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("parts")
    return frame.join(held, ["key", "part"], how).drop("part")


def split_covered(frame: DataFrame, spans: DataFrame, often: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of frame without covered bytes, and those with, with their spans."""
    keys = spans.select("key")
    small = C.maybe_broadcast(keys)
    if small is not keys:  # few enough: only the texts that are cut travel
        return frame.join(small, "key", "left_anti"), with_spans(frame.join(small, "key", "left_semi"), spans, often)
    every = with_spans(frame, spans, often, "left")
    return every.where("spans is null"), every.where("spans is not null")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id,
    text); null texts are empty, repeated rows repeat each other."""
    frame, spans, often = coverage(docs.select(F.col("doc_id").cast("long"), "text"), length)
    clean, hit = split_covered(frame, spans, often)

    def run(batches):
        for t in batches:
            n, gone, count, sha = [], [], [], []
            for text, cut in zip(t.column(1).to_pylist(), t.column(2).to_pylist()):
                raw = text.encode("utf-8")
                h, at = hashlib.sha256(), 0
                for s in cut:
                    h.update(raw[at : s["a"]])
                    at = s["z"]
                h.update(raw[at:])
                n.append(len(raw))
                gone.append(sum(s["z"] - s["a"] for s in cut))
                count.append(len(cut))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([t.column(0), *(pa.array(c, pa.int64()) for c in (n, gone, count)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    none = F.lit(0).cast("long")
    whole = clean.select("row.doc_id", F.col("size").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return whole.unionByName(hit.select("row.doc_id", "text", "spans").mapInArrow(C.frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings taken out of text, all rows and columns kept, null texts
    too.  A character stays whole: it goes only with all its bytes."""
    columns = docs.columns
    frame, spans, often = coverage(docs, length)
    clean, hit = split_covered(frame, spans, often)

    def run(batches):
        for t in batches:
            out = []
            for text, cut in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                raw, kept, last = text.encode("utf-8"), [], 0
                for s in cut:
                    a, z = s["a"], s["z"]
                    while a < z and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while z < len(raw) and z > a and raw[z] & 0xC0 == 0x80:
                        z -= 1
                    kept.append(raw[last:a])
                    last = z
                kept.append(raw[last:])
                out.append(b"".join(kept).decode("utf-8"))
            cols = dict(zip(columns, t.columns[2:]))
            cols["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), columns)

    schema = T.StructType([docs.schema[c] for c in columns])
    cut = hit.select("text", "spans", *(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(C.frugal(run), schema)
    return clean.select(*(F.col("row").getField(c).alias(c) for c in columns)).unionByName(cut)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents by its whole text; nulls, empty, long and repeated texts as
    the module says, null document ids stay null."""
    return digest(C.table(spark, sf_dir, "documents"))
