"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand side by side inside no vocabulary token can
never end up in one token, so the text is cut there for certain; the fragments
are merged independently and their ids concatenated.  All new words of a block of
texts are merged together: fragments of like length are the rows of one matrix, and
each step merges every row's pair of lowest rank.  Works on the tokenizer files of
kind BPE with word ends (NFC, white space, lower case; no decoder).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import common as C

#: Characters that Unicode calls White_Space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters on whose classes and cases all Unicode versions agree; texts with others
#: are normalized and pre-split by the tokenizers library, whose tables may be newer.
RARE = regex.compile("[^\\x00-\\u024f\\u2000-\\u206e\\u20a0-\\u20bd\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5]")
SEPARATORS = regex.compile("[\x1c-\x1f]")
NEVER = np.int32(1 << 30)
CACHE, CACHED_CHARS = 200_000, 128  # words, and the longest one kept; a full cache is emptied, which changes no result
WIDE = 64  # symbols of a fragment that is merged in a matrix; longer ones are merged one by one
BLOCK = 256  # texts encoded together


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 for itself, the other bytes from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder made from the JSON text of a tokenizer file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        model, kinds = d["model"], [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or d.get("decoder") or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("only BPE files with word ends, NFC + white space + lower case and no decoder")
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(f"(?:{pattern})|\\n")
        self.space = regex.compile(f"[{SPACE}]+")
        self.words: dict[str, bytes] = {}
        # Symbols have numbers of their own: each byte, each byte with the word end, then what merges make.
        self.symbols = byte_symbols()
        self.number = {t: i for i, t in enumerate([*self.symbols, *(t + self.end for t in self.symbols)])}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        for a, b in pairs:
            for t in (a, b, a + b):
                self.number.setdefault(t, len(self.number))
        get = self.number.__getitem__
        self.ids = np.array([self.vocab.get(t, -1) for t in self.number], np.int64)
        self.size = len(self.number)
        # A pair given twice has its last rank, as a dictionary would hold it.
        self.ranks = {(get(a), get(b)): i for i, (a, b) in enumerate(pairs)}
        self.made = np.array([get(a + b) for a, b in pairs] or [0], np.int32)
        keys = np.array([a * self.size + b for a, b in self.ranks] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], np.array(list(self.ranks.values()) or [0], np.int32)[order]
        self.inside = np.zeros((512, 512), bool)
        for token in self.vocab:
            n = [self.number[x] for x in self._atoms(token) if x in self.number]
            self.inside[n[:-1], n[1:]] = True
        a, b = np.divmod(np.arange(512 * 512, dtype=np.int64), 512)
        self.first = self.lookup(a, b).reshape(512, 512)

    def __reduce__(self):
        return Codec, (self.spec,)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NEVER where they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NEVER)

    def _atoms(self, token: str) -> list[str]:
        """A token's symbols: its characters, the last one with the word end."""
        if token.endswith(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1:] + self.end]
        return list(token)

    def merge(self, rows: np.ndarray) -> np.ndarray:
        """Merges fragments of one length (rows x symbols), lowest rank first, leftmost
        first among equals; the symbols left of each, then -1."""
        out = np.full(rows.shape, -1, np.int32)
        who, s = np.arange(len(rows)), rows.copy()
        r = self.first[s[:, :-1], s[:, 1:]]
        while s.shape[1] > 1:
            j = r.argmin(1)
            low = r[np.arange(len(s)), j]
            live = low < NEVER
            if not live.all():
                out[who[~live], : s.shape[1]] = s[~live]
                s, r, who, j, low = s[live], r[live], who[live], j[live], low[live]
            if not len(s):
                return out
            # What stands behind the merged pair moves up by one place.
            s[np.arange(len(s)), j] = self.made[low]
            s = s[np.arange(s.shape[1]) != (j + 1)[:, None]].reshape(len(s), -1)
            if s.shape[1] > 1:
                r = r[np.arange(r.shape[1]) != j[:, None]].reshape(len(s), -1)
                m = np.flatnonzero(j > 0)
                r[m, j[m] - 1] = self.lookup(s[m, j[m] - 1], s[m, j[m]])
                m = np.flatnonzero(j < s.shape[1] - 1)
                r[m, j[m]] = self.lookup(s[m, j[m]], s[m, j[m] + 1])
        out[who, : s.shape[1]] = s
        return out

    def merge_long(self, fragment: list[int]) -> list[int]:
        """merge() of one fragment in n log n steps, with a heap over a linked list."""
        s, n, get, made = list(fragment), len(fragment), self.ranks.get, self.made
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], nxt[i] = int(made[r]), False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (r := get((s[left], s[right]))) is not None:
                    heapq.heappush(heap, (r, left, s[left], s[right]))
        return [s[i] for i in range(n) if alive[i]]

    def fragments(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all pre-tokens in one array, where fragments begin, and the piece of each."""
        raw = [p.encode("utf-8") for p in pieces]
        s = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        s[ends - 1] += 256
        cut = np.ones(len(s), bool)
        cut[1:] = ~self.inside[s[:-1], s[1:]]
        cut[ends[:-1]] = True
        begin = np.flatnonzero(cut)
        return s, begin, np.searchsorted(ends, begin, "right")

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids (little-endian 32 bit) of words without white space.  Those of short words go
        in the cache, the others (a text without spaces is one) are returned alone."""
        longer: dict[str, bytes] = {}
        pieces: list[str] = []
        sizes: list[int] = []
        joined, plain, odd = "\n".join(words), words, []
        if RARE.search(joined):
            plain = [w for w in words if not RARE.search(w)]
            odd = [w for w in words if RARE.search(w)]
            joined = "\n".join(plain)
        for p in self.pieces.findall(joined + "\n") if plain else ():
            if p == "\n":
                sizes.append(len(pieces))
            else:
                pieces.append(p)
        back = {t: b for b, t in enumerate(self.symbols)} if odd else {}
        for w in odd:
            pieces += [bytes(map(back.__getitem__, p)).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(w)]
            sizes.append(len(pieces))
        ids, ends = np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        if pieces:
            s, begin, piece = self.fragments(pieces)
            length = np.diff(begin, append=len(s))
            left = s.copy()  # a fragment's symbols after merging, -1 where there are fewer
            for n in np.unique(length).tolist():
                at = begin[length == n]
                if n > WIDE:
                    for b in at.tolist():
                        got = self.merge_long(s[b : b + n].tolist())
                        left[b : b + n] = got + [-1] * (n - len(got))
                elif n > 1:
                    at = at[:, None] + np.arange(n)
                    left[at] = self.merge(s[at])
            ids = np.where(left >= 0, self.ids[left], -1)
            word = np.repeat(np.searchsorted(np.array(sizes), piece, "right"), length)[ids >= 0]
            ends = np.cumsum(np.bincount(word, minlength=len(words)))
        blob, a = ids[ids >= 0].astype("<u4").tobytes(), 0
        for w, z in zip(chain(plain, odd), (4 * ends).tolist()):
            (self.words if len(w) <= CACHED_CHARS else longer)[w] = blob[a:z]
            a = z
        return longer

    def normal(self, text: str) -> list[str]:
        """The words of a normalized text: its runs without white space."""
        if not text.isascii():
            if RARE.search(text):
                return self.library.normalizer.normalize_str(text).split(" ")
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if SEPARATORS.search(text):  # white to Python alone
            return self.space.sub(" ", text).lower().split(" ")
        return text.lower().split()

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a whole text; a special token has a newline before it."""
        if self.split_special is None or not any(t in text for t in self.special):
            return self.normal(text) if text else []
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append("\n" + part)
            elif part:
                out += self.normal(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        split = [[w for w in self.split(t) if w] if t else [] for t in texts]
        words = self.words
        new = set().union(*split).difference(words)
        if len(words) + len(new) > CACHE:  # bounded but for the words of one block
            words.clear()
            new = set().union(*split)
        special = {w for w in new if w[0] == "\n"}
        longer = self.learn([*(new - special)])
        for w in special:
            words[w] = struct.pack("<I", self.special[w[1:]])
        if not longer:
            return [b"".join(map(words.__getitem__, w)) for w in split]
        return [b"".join([longer[w] if w in longer else words[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes | None) -> str:
        """The text that ids stand for; unknown ids are left out."""
        get = self.names.get
        return " ".join([t for t in map(get, np.frombuffer(ids or b"", "<u4").tolist()) if t is not None])


def encoded(docs: DataFrame, spec: str, id_col: str, text_col: str, columns: str, make) -> DataFrame:
    """make(codec, ids of a block of texts) gives the columns behind the id."""
    held = docs.sparkSession.sparkContext.broadcast(Codec(spec))

    def run(batches):
        codec = held.value  # one for all tasks of a worker, with its cache
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                ids = codec.encode(b.column(1).to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                cols = [b.column(0), n, *make(codec, ids)]
                yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in columns.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(C.frugal(run), columns)


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids (little-endian 32-bit integers).

    spec is the JSON text of the tokenizer file: a fixed vocabulary, broadcast once.
    Whole texts of any length; null and empty texts have no ids; repeated rows and null
    document ids are kept as they come; an empty table gives an empty one; other columns
    are not used.  Narrow: no shuffle, one small block of texts in memory at a time.
    """
    return encoded(docs, spec, id_col, text_col, "doc_id long, n_tokens long, ids binary", lambda codec, ids: [pa.array(ids, pa.binary())])


def decode(tokens: DataFrame, spec: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with a column out: the text that ids_col (little-endian 32-bit integers)
    stands for, special tokens included.  Null and empty ids give the empty text, unknown
    ids are left out; a column named out is replaced, all rows and other columns stay."""
    held = tokens.sparkSession.sparkContext.broadcast(Codec(spec))
    kept = [c for c in tokens.columns if c != out]
    frame = tokens.select(*kept, F.col(ids_col).alias("ids of all")) if ids_col == out else tokens.select(*kept)
    at = len(kept) if ids_col == out else kept.index(ids_col)

    def run(batches):
        for b in batches:
            text = pa.array([held.value.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], text], [*kept, out])

    schema = T.StructType([tokens.schema[c] for c in kept]).add(out, "string")
    return frame.mapInArrow(C.frugal(run), schema)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def round_trip(docs: DataFrame, spec: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass: doc_id, n_tokens, ids or ids_sha256, and the
    SHA-256 of the text decoded from those ids (decoded_sha256), both in lowercase hex.
    Rows and odd texts as for encode()."""

    def make(codec, ids):
        first = pa.array(ids, pa.binary()) if with_ids else pa.array(map(sha, ids), pa.string())
        return [first, pa.array([sha(codec.decode(x).encode("utf-8")) for x in ids], pa.string())]

    return encoded(docs, spec, id_col, text_col, f"doc_id long, n_tokens long, {'ids binary' if with_ids else 'ids_sha256 string'}, decoded_sha256 string", make)


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: ids and the text decoded from them, as digests; null texts
    are empty, repeated rows repeat, null ids stay null, very long texts are whole."""
    return round_trip(C.table(spark, sf_dir, "documents"), tokenizer_json())
