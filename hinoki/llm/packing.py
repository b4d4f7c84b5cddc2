"""Token ids packed into fixed-length rows.

Texts are encoded by a byte-level rank file, split losslessly where they exceed a
row, and packed best-fit-decreasing: a segment tree over the rows' free capacity
finds the row with the least sufficient room.  Every packed row carries its ids as
one line of a matrix, the cumulative segment lengths and where positions restart.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
#: Tokens and texts packed together; a bound on a worker's memory, not on the input.
WINDOW_TOKENS, WINDOW_ROWS = 4_000_000, 20_000
#: Words whose ids a worker keeps, and their greatest length; a task of 26 MB has some 550,000 different ones.
CACHE, CACHED_CHARS = 500_000, 48
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class RoomTree:
    """Rows counted by free capacity 0..size; a segment tree of sums over them finds
    the least capacity >= n that some row has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the tightest row with room >= need, taken out; None without one."""
        room = self._least(need)
        if room is None:
            return None
        self._add(room, -1)
        return self.rows[room].pop(), room

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def _least(self, need: int) -> int | None:
        i, count = need + self.leaves, self.count
        if count[i]:
            return need
        while i > 1:  # up to the first right sibling that holds a row
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: lists of indexes whose lengths fit capacity together.
    Ties go to the earlier piece; pieces of length 0 take no part."""
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i))
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for i in order:
        got = tree.take(lengths[i])
        row, room = got if got else (len(rows), capacity)
        if not got:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.put(row, room - lengths[i])
    return rows


class Encoder:
    """encode_ordinary of a rank file, by pieces that its pattern always parts."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.inner = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        # A space before a word belongs to it, other white space stands alone.
        self.pieces = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.adjacent = re.compile(f"[{SPACE}]{{2}}")
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def after_space(self, s: str) -> bytes:
        got = np.array(self.inner.encode_ordinary(" " + s), "<u4").tobytes()
        if len(s) <= CACHED_CHARS:
            if len(self.spaced) >= CACHE:
                self.spaced.clear()
            self.spaced[s] = got
        return got

    def piece(self, s: str) -> bytes:
        got = np.array(self.inner.encode_ordinary(s), "<u4").tobytes()
        if len(s) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[s] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not self.adjacent.search(text):  # then every space begins a piece
            head, *rest = text.split(" ")
            get = self.spaced.get
            return b"".join([self.cache.get(head) or self.piece(head), *[get(w) or self.after_space(w) for w in rest]])
        get = self.cache.get
        return b"".join([get(p) or self.piece(p) for p in self.pieces.findall(text)])


OUT = "pack_id string, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, offsets array<bigint>"


def packed(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, pad: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of every whole text.

    ids: capacity little-endian 32-bit integers, pad behind the n_tokens used ones.
    cu_seqlens: 0 and each segment's end; resets: where each segment's positions
    start again from 0; doc_ids and offsets: each segment's document and its first
    token there, so that documents can be put together again (a document longer than
    a row is cut at multiples of capacity, nothing is lost).  Null and empty texts
    have no tokens and so no segment.  Repeated rows are packed each on their own, a
    null id stays null.  Narrow: no shuffle; windows of a scan's rows are packed
    together, so that memory is bounded; pack_id names partition, window and row.
    """
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder(*held.value)
        part, window, size = TaskContext.get().partitionId(), 0, 0
        who, ids = [], []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = encoder.encode(text) if text else b""
                who.append(doc)
                ids.append(got)
                size += len(got) // 4
                if size >= WINDOW_TOKENS or len(who) >= WINDOW_ROWS:
                    yield from emit(part, window, who, ids)
                    window, size, who, ids = window + 1, 0, [], []
        yield from emit(part, window, who, ids)

    def emit(part, window, who, ids):
        pieces = [(i, a, min(a + capacity, len(x) // 4)) for i, x in enumerate(ids) for a in range(0, len(x) // 4, capacity)]
        rows = pack([z - a for _, a, z in pieces], capacity)
        filler = np.array([pad], "<u4").tobytes()
        for at in range(0, len(rows), 256):
            cols = [[] for _ in range(7)]
            for k, row in enumerate(rows[at : at + 256], at):
                parts = [pieces[j] for j in row]
                ends = np.cumsum([z - a for _, a, z in parts]).tolist()
                line = b"".join(ids[i][4 * a : 4 * z] for i, a, z in parts) + filler * (capacity - ends[-1])
                for c, v in zip(cols, (f"{part}-{window}-{k}", ends[-1], line, [0, *ends], [0, *ends[:-1]], [who[i] for i, _, _ in parts], [a for _, a, _ in parts])):
                    c.append(v)
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["pack_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "offsets"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(C.frugal(run), OUT)


MATRIX = "n_rows int, ids binary, cu_seqlens binary, segments binary, resets binary"


def matrices(rows: DataFrame, lines: int = 256) -> DataFrame:
    """Packed rows as matrices of at most lines rows: ids (n_rows x capacity), cu_seqlens
    (those of all rows, one after another), segments (where each row's part of it begins,
    and its end), resets (as cu_seqlens, one less a row); all little-endian 32-bit
    integers.  An empty table has no matrix.  No shuffle."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, lines):
                b = whole.slice(i, lines)
                ids, cu, resets = (b.column(k).to_pylist() for k in (0, 1, 2))
                ends = np.cumsum([0, *map(len, cu)])
                blobs = [b"".join(ids), *(np.concatenate([np.array(x, "<i4") for x in c]).tobytes() for c in (cu,)), ends.astype("<i4").tobytes(), np.concatenate([np.array(x, "<i4") for x in resets]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["n_rows", "ids", "cu_seqlens", "segments", "resets"])

    return rows.select("ids", "cu_seqlens", "resets").mapInArrow(C.frugal(run), MATRIX)


def write_binary(rows: DataFrame, path: str, lines: int = 256) -> None:
    """matrices(rows) as Parquet files under path, a record a matrix."""
    matrices(rows, lines).write.parquet(path)


def read_matrix(record) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(id matrix, cu_seqlens of each row, resets of each row) of a record of write_binary."""
    ids = np.frombuffer(record["ids"], "<u4").reshape(record["n_rows"], -1)
    cu, at, resets = (np.frombuffer(record[c], "<i4") for c in ("cu_seqlens", "segments", "resets"))
    rows = range(record["n_rows"])
    return ids, [cu[at[i] : at[i + 1]] for i in rows], [resets[at[i] - i : at[i + 1] - i - 1] for i in rows]


def positions(cu_seqlens: list[int], capacity: int) -> np.ndarray:
    """Position ids of one packed row: each segment counts from 0, padding is 0."""
    out = np.zeros(capacity, np.int32)
    for a, z in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:z] = np.arange(z - a)
    return out


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="ascii") as f:
        return f.read(), public_tokenizers.PATTERN


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in packed rows; null and empty texts have no segment, very
    long texts are cut at the capacity and lose nothing, repeated rows are packed each."""
    return packed(C.table(spark, sf_dir, "documents"), *rank_file())
