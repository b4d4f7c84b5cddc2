"""Each operator on small tables: against brute force, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hinoki.llm import ann, bpe, decontaminate, lm_score, packing, quality, toxicity, url_filter

DOCS = "doc_id long, text string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS)


ODD = [None, "", " \n\t", "a", "word " * 30_000, "x" * 20_000, "日本語 🙂 é", "a\x00b \x1c c", "İSTANBUL ΣΑΣ ﬁ"]


# --- 7


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://Sub.EXAMPLE.com/en/7x?q#f", "https://example.com/en/8", "http://a.com", "http://com/en/", "http://xcom/en/", "http://example.net/de/8#t", "ftp://a.b.net/de/", "http://net/de", "http://", "http:///en/", "a://b://org/es/", "http://org/es/x", "http://org/es/x", "http://a..org/es/", "http://u:p@x.org:80/es/", "http://x.org/ES/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/x", "block"), ("com", "/en/", "block")], "rule_host string, rule_path string, rule_verdict string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert url_filter.url_filter(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_url_filter_on_a_long_host(spark):
    host = "a." * 500_000 + "example.com"
    pages = spark.createDataFrame([(0, f"http://{host}/en/7"), (1, "http://com" + "/en/" * 250_000)], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, rule_verdict string")
    got = {r.page_id: (len(r.host), r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {0: (len(host), "example.com/en/7", "allow"), 1: (3, "com/en/", "block")}


def test_url_filter_has_the_verdicts_of_the_contract(spark):
    said = {"http://a.com/en/1": "block", "http://example.com/en/7": "allow", "http://a.net/de/1": "allow", "http://example.net/de/8": "block", "http://a.org/es/1": "block"}
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "rule_host string, rule_path string, rule_verdict string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages, rules).collect()} == dict(enumerate(said.values()))


# --- 4


def test_bpe_keeps_no_long_words():
    from tokenizers import Tokenizer

    spec = bpe.tokenizer_json()
    codec, lib = bpe.Codec(spec), Tokenizer.from_str(spec)
    lib.no_truncation()
    texts = ["x" * 300_000, "short " + "yz" * 200 + " word", "short", "yz" * 200]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in codec.encode(texts)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(codec.words) == {"short", "word"}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    spec = bpe.tokenizer_json()
    lib = Tokenizer.from_str(spec)
    lib.no_truncation()
    lib.no_padding()
    r = random.Random(3)
    rows = [*ODD, "a<|endoftext|>B <|startoftext|>", "don't WE'LL 123 !!!'s", *("".join(r.choice("abcdeth'!<|> ÉÈ中ꟋΣ") for _ in range(80)) for _ in range(200))]
    coded = bpe.encode(docs(spark, enumerate(rows)), spec)
    got = {r.doc_id: r for r in coded.collect()}
    text = {r.doc_id: r.decoded for r in bpe.decode(coded, spec).collect()}
    assert bpe.decode(coded, spec, "ids", "ids").columns == ["doc_id", "n_tokens", "ids"]
    sums = {r.doc_id: r for r in bpe.round_trip(docs(spark, enumerate(rows)), spec).collect()}
    for i, t in enumerate(rows):
        want = lib.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(want)}I", *want)
        assert got[i].n_tokens == len(want) and bytes(got[i].ids) == raw, repr(t)[:80]
        assert text[i] == lib.decode(want, skip_special_tokens=False)
        assert (sums[i].ids_sha256, sums[i].decoded_sha256) == (hashlib.sha256(raw).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest())
    assert bpe.encode(docs(spark, []), spec).count() == 0
    odd = spark.createDataFrame([(1, None), (2, b""), (3, struct.pack("<2I", 320, 999_999))], "k long, ids binary")
    assert [r.decoded for r in bpe.decode(odd, spec).orderBy("k").collect()] == ["", "", codec_name(spec, 320)]


def codec_name(spec, i):
    return bpe.Codec(spec).names[i]


def test_bpe_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 6)
    codec, r = bpe.Codec(bpe.tokenizer_json()), random.Random(1)
    texts = [" ".join("".join(r.choice("abcé1!") for _ in range(r.randrange(1, 9))) for _ in range(n)) for n in (0, 3, 40, 5, 1)] + ["<|endoftext|> x" * 9, None]
    want = [codec.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want


def test_fragments_are_independent():
    codec, r = bpe.Codec(bpe.tokenizer_json()), random.Random(4)
    for n in (1, 2, 3, 7, 30):
        rows = np.array([[r.randrange(256) if r.random() < 0.2 else ord(r.choice("aeinrst")) for _ in range(n)] for _ in range(60)], np.int32)
        text = [codec.symbols[b] for b in range(256)]
        whole = [codec.merge_long([codec.number[text[b]] for b in row.tolist()]) for row in rows]
        assert [[i for i in x.tolist() if i >= 0] for x in codec.merge(rows)] == whole
        for row, want in zip(rows, whole):
            cut = [0, *(np.flatnonzero(~codec.inside[row[:-1], row[1:]]) + 1).tolist(), n]
            assert [x for a, z in zip(cut, cut[1:]) for x in codec.merge_long(row[a:z].tolist())] == want


# --- 2


def test_packing_keeps_the_words_of_a_task(monkeypatch):
    """300,000 different words are encoded once each, not again after the cache was emptied."""
    enc = packing.Encoder(*packing.rank_file())
    text, made, after = " ".join(f"w{i}" for i in range(300_000)), [], enc.after_space
    monkeypatch.setattr(enc, "after_space", lambda s: made.append(s) or after(s))
    first = enc.encode(text)
    assert enc.encode(text) == first and len(made) == 299_999
    for s in ("a  b", "a\u3000\u2028b", " \x85x", "a\x1c\x1cb", "w1 \nw2", "x" * 500 + " " + "y" * 500):
        assert np.frombuffer(enc.encode(s), "<u4").tolist() == enc.inner.encode_ordinary(s)


def test_packing_round_trip(spark, tmp_path):
    rows = list(enumerate([*ODD, *("tok " * n for n in range(1, 60))])) + [(3, "a"), (None, "null id")]
    out = packing.packed(docs(spark, rows).coalesce(1), *packing.rank_file(), capacity=64).collect()
    enc = packing.Encoder(*packing.rank_file())
    parts = {}
    for r in out:
        line = np.frombuffer(r.ids, "<u4")
        assert len(line) == 64 and r.n_tokens == r.cu_seqlens[-1] <= 64 and list(r.resets) == list(r.cu_seqlens[:-1]) and (line[r.n_tokens :] == 50256).all()
        assert all(packing.positions(r.cu_seqlens, 64)[a] == 0 for a in r.resets)
        for a, z, d, o in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.offsets):
            parts.setdefault(d, []).append((o, line[a:z].tolist()))
    packing.write_binary(packing.packed(docs(spark, rows).coalesce(1), *packing.rank_file(), capacity=64), str(tmp_path / "m"), 7)
    back = []
    for rec in spark.read.parquet(str(tmp_path / "m")).collect():
        back += [(line.tobytes(), cu.tolist(), resets.tolist()) for line, cu, resets in zip(*packing.read_matrix(rec))]
    assert sorted(back) == sorted((bytes(r.ids), list(r.cu_seqlens), list(r.resets)) for r in out)
    want = Counter()
    for d, t in rows:
        want[d] += len(enc.inner.encode_ordinary(t or ""))
    assert {d: sum(len(x) for _, x in p) for d, p in parts.items()} == {d: n for d, n in want.items() if n}
    for d, t in rows:
        if d not in (3, None) and t:
            assert [i for _, x in sorted(parts[d]) for i in x] == enc.inner.encode_ordinary(t)
    assert packing.packed(docs(spark, []), *packing.rank_file()).count() == 0


def test_pack_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(50):
        cap = r.randrange(1, 40)
        lengths = [r.randrange(0, cap + 1) for _ in range(r.randrange(0, 60))]
        got = packing.pack(lengths, cap)
        rows: list[list[int]] = []
        for n in sorted((n for n in lengths if n), reverse=True):
            fit = [x for x in rows if sum(x) + n <= cap]
            (max(fit, key=sum) if fit else rows.append([]) or rows[-1]).append(n)
        assert sorted(sum(lengths[i] for i in x) for x in got) == sorted(map(sum, rows))
        assert sorted(i for x in got for i in x) == [i for i, n in enumerate(lengths) if n]


# --- 9


ALL64 = (1 << 64) - 1


def plain_mix(x, seed):
    x ^= seed * 0x9E3779B97F4A7C15 & ALL64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL64
    return x ^ (x >> 31)


def pair_key(h, y):
    a, b = (int.from_bytes(xxhash.xxh3_128_digest(w)[:8], "little") for w in (h, y))
    return plain_mix((a * 0x9E3779B97F4A7C15 + b) & ALL64, 7) >> 16


def pair_slice(h, y, slices):
    return plain_mix(pair_key(h, y), 99) % slices


def plain_filter(counts):
    """A Bloom filter of (key, level) for all levels up to a count's, and the probe of a key."""
    levels = {k: int(math.log2(c)) + 1 for k, c in counts.items()}
    bits = 1 << max(6, math.ceil(math.log2(max(1, 8 * sum(levels.values())))))

    def places(k, j):
        a = plain_mix(k, j)
        return {(a + i * (a >> 32 | 1)) % bits for i in range(4)}

    on = {p for k, n in levels.items() for j in range(1, n + 1) for p in places(k, j)}
    return lambda k: next(j for j in range(48) if not places(k, j + 1) <= on) if on else 0


def test_lm_score(spark, monkeypatch):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    rows = list(enumerate([*ODD, *(" ".join(r.choice(vocab[: r.randrange(2, 40)]).upper() for _ in range(r.randrange(1, 60))) for _ in range(120))]))
    df = docs(spark, rows)
    df = df.withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).repartition(3)
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    uni, big = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = words(t)
            uni.update(w)
            big.update(zip([b"\n", *w], w))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    weight = lm_score.WEIGHT
    for tokens, block in ((lm_score.SLICE, lm_score.BLOCK), (2000, 300)):
        monkeypatch.setattr(lm_score, "BLOCK", block)
        out = lm_score.lm_scores(df, tokens).collect()
        got = {x.doc_id: x for x in out}
        near = []
        size = sum(len((t or "").encode()) for _, t in rows)
        slices = 1 << max(4, math.ceil(math.log2(max(1, size / 6 / tokens))))
        parts = [Counter() for _ in range(slices)]
        for (h, y), c in big.items():
            parts[pair_slice(h, y, slices)][pair_key(h, y)] += c
        held_in = [plain_filter(c) for c in parts]
        assert len(out) == len(got) == len(rows)
        for i, t in rows:
            w = words(t)
            x = got[i]
            assert (not x.train, x.n_tokens, x.n_known, x.train_tokens) == (held(i), len(w), sum(uni[y] > 0 for y in w), n)
            assert x.base_score == pytest.approx(sum(math.log10(p1(y)) for y in w))
            exact, s = 0.0, 0.0
            for h, y in zip([b"\n", *w], w):
                for q, into in ((big[h, y] and int(math.log2(big[h, y])) + 1, 0), (held_in[pair_slice(h, y, slices)](pair_key(h, y)), 1)):
                    count = min(2.0 ** (q - 1) if q else 0.0, uni[h], uni[y])
                    step = math.log10((count + weight * p1(y)) / (uni[h] + weight)) if uni[h] else math.log10(p1(y))
                    exact, s = (exact + step, s) if not into else (exact, s + step)
            assert x.score == pytest.approx(s, rel=1e-9)  # the filter written plainly, false positives and all
            assert x.score >= exact - 1e-6 * abs(exact)  # a false positive can only lift a probability
            near.append(x.score <= exact + 0.02 * abs(exact))
        assert np.mean(near) > 0.7
    assert lm_score.lm_scores(df.limit(0)).count() == 0
    empty = lm_score.lm_scores(df.withColumn("train", F.lit(False))).collect()
    assert len(empty) == len(rows) and all(x.train_tokens == x.n_known == 0 and x.score == x.base_score for x in empty)


def test_filter_holds_every_key():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 60, 60_000).astype(np.uint64))
    for n in (1, 10, 30_000):
        counts = r.integers(1, 5000, n)
        bits = lm_score.fill(keys[:n], counts)
        assert (lm_score.levels_held(bits, keys[:n]) >= lm_score.levels(counts)).all()
        assert (lm_score.levels_held(bits, keys[30_000:]) > 0).mean() < 0.05
    assert not lm_score.levels_held(np.zeros(0, np.uint8), keys).any()
    assert lm_score.levels(np.array([1, 2, 3, 4, 1023, 1024])).tolist() == [1, 2, 2, 3, 10, 11]


# --- 3, 10


def labelled(seed=5, n=500):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    bad = ["nasty", "vile", "foul"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randrange(10, 80))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        grade = r.randrange(4)
        w = [x + "%" * 3 if r.random() < (3 - grade) / 3 else x for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, grade, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark):
    rows, labels = labelled()
    df = docs(spark, rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (0, rows[0][1])])
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (9999, 1, 1)], LABELS)
    out = toxicity.with_score(df, toxicity.fit(df, lab.where("doc_id < 400 or doc_id is null"))).collect()
    assert len(out) == len(rows) + len(ODD) + 2 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    held = [(by[i], t) for i, _, t in labels if i >= 400]
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.95 * len(held)
    one = toxicity.fit(df, lab.where("toxic = 0"))
    assert all(s < 0.5 for s in one.score(["nasty", "", None]))
    assert toxicity.with_score(df.limit(0), one).count() == 0
    assert len(toxicity.fit(df, lab.limit(0)).score(["x"])) == 1


def test_toxicity_with_equal_classes(spark):
    r = random.Random(8)
    plain = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(plain) if i % 2 == 0 or r.random() < 0.7 else r.choice(["nasty", "vile"]) for _ in range(30))) for i in range(800)]
    df = docs(spark, rows)
    lab = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], LABELS)
    m = toxicity.fit(df, lab.where("doc_id < 600"))
    got = m.score([t for _, t in rows[600:]]) >= 0.5
    assert (got == np.arange(600, 800) % 2).mean() > 0.95


@pytest.mark.parametrize("toxic,plain", [(400, 400), (60, 600), (600, 60)])
def test_toxicity_at_any_balance(spark, toxic, plain):
    r = random.Random(toxic)
    by_lang = [[f"{p}{i}" for i in range(80)] for p in "xy"]
    rows = []
    for i in range(toxic + plain):
        bad = i < toxic
        # The classes' languages are mixed unlike, which is no evidence.
        lang = by_lang[r.random() < (0.8 if bad else 0.3)]
        rows.append((i, " ".join(r.choice(["nasty", "vile"]) if bad and r.random() < 0.1 else r.choice(lang) for _ in range(r.randrange(20, 60)))))
    held = lambda i: i % 4 == 0
    df = docs(spark, rows)
    lab = spark.createDataFrame([(i, 0, int(i < toxic)) for i, _ in rows if not held(i)], LABELS)
    got = toxicity.fit(df, lab).score([t for i, t in rows if held(i)])
    want = np.array([i < toxic and ("nasty" in t or "vile" in t) for i, t in rows if held(i)])
    assert (got[want][:, None] > got[~want]).mean() > 0.97
    assert toxic > plain or (got[want] >= 0.5).mean() >= 0.85 and (got[~want] < 0.5).mean() >= 0.95


def test_toxicity_probabilities_against_brute_force(spark):
    rows, labels = labelled(9, 60)
    df, lab = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    lm = toxicity.fit(df, lab).lm
    bucket = lambda t: toxicity.tokens([t])[0].tolist()
    grams = [Counter(), Counter()]
    for (_, t), (_, _, y) in zip(rows, labels):
        w = bucket(t)
        grams[y].update(zip([toxicity.WORDS - 1, *w], w))
    left = [Counter(w for _, w in g) for g in grams]

    def discount(n, counts):
        c = [max(1, sum(x == k for x in counts)) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        k = min(n, 3)
        return min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.1), k)

    def p(y, h, w):
        shared = (left[0][w] + left[1][w] + 0.5) / (sum(map(len, grams)) + 0.5 * toxicity.WORDS)
        counts = left[y].values()
        off = {n: discount(n, counts) for n in set(counts)}
        one = ((left[y][w] - off[left[y][w]]) if left[y][w] else 0) / len(grams[y]) + sum(off[n] for n in counts) / len(grams[y]) * shared
        after = {k[1]: n for k, n in grams[y].items() if k[0] == h}
        if not after:
            return one, one
        less = {n: 1 if n == 1 else discount(n, grams[y].values()) for n in set(after.values())}
        total, n = sum(after.values()), after.get(w, 0)
        return one, (n - less[n] if n else 0) / total + sum(less[x] for x in after.values()) / total * one

    flat, sizes = toxicity.tokens([rows[0][1], None, "vile unseen nasty", ""])
    by_word, by_pair = lm.differences(flat, sizes)
    for h, w, a, b in zip(toxicity.histories(flat, sizes).tolist(), flat.tolist(), by_word, by_pair):
        t, o = p(1, h, w), p(0, h, w)
        assert a == pytest.approx(math.log(t[0] / o[0]), abs=1e-4) and b == pytest.approx(math.log(t[1] / o[1]), abs=1e-4)
    assert lm.inputs(flat, sizes)[1].tolist() == [1.0] + [0.0] * 10


def test_quality_orders_grades(spark):
    rows, labels = labelled(6)
    df = docs(spark, rows + [(1000 + i, t) for i, t in enumerate(ODD)])
    lab = spark.createDataFrame([*labels, (3, None, 0)], LABELS)
    m = quality.fit(df, lab.where("doc_id < 400"))
    assert (np.diff(m.thresholds()) > 0).all() and len(m.thresholds()) == 3
    by = {r.doc_id: r for r in quality.with_quality(df, m, 2).collect()}
    assert len(by) == len(rows) + len(ODD)
    held = [(by[i].expected_grade, g) for i, g, _ in labels if i >= 400]
    mean = [np.mean([e for e, g in held if g == k]) for k in range(4)]
    assert mean == sorted(mean) and np.corrcoef(*zip(*held))[0, 1] > 0.8
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 3 for r in by.values())
    assert {r.expected_grade for r in quality.with_quality(df, quality.fit(df, lab.where("quality = 2")), 2).collect()} == {2.0}
    assert quality.with_quality(df, quality.fit(df, lab.limit(0)), 1).count() == len(by)


def test_quality_prior_does_not_depend_on_the_cap(spark):
    # A text that says nothing of its grade must get the labels' share whatever per_class.
    rows = [(i, f"same words {i // 6 % 3}") for i in range(1200)]
    lab = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i, _ in rows], LABELS)
    df = docs(spark, rows)
    for cap in (5000, 100):
        tails = [r.tail for r in quality.with_quality(df.limit(9), quality.fit(df, lab, per_class=cap), 1).collect()]
        assert tails == pytest.approx([5 / 6] * 9, abs=0.08)


# --- 5


@pytest.mark.parametrize("shard", [4096, 300])
def test_ann_recall_ties_and_odd_vectors(spark, shard):
    r = np.random.default_rng(1)
    v = r.normal(size=(1500, 16)).round(3)
    v[200:420] = v[7]  # a large group of copies
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    rows += [(5000, None, "c"), (5100, [], "c"), (5200, [0.0] * 16, "c"), (5300, [float("nan")] + [1.0] * 15, "c"), (5400, [None] + [1.0] * 15, "c"), (5500, [float("inf")] + [1.0] * 15, "c"), (5600, [1.0] * 3, "c"), (None, v[0].tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    held, shards = ann.index(df, 10, shard_rows=shard)
    got = ann.nearest(df.where("vec_id % 50 = 0"), held, shards, 10).collect()
    hit, by = 0, {}
    for x in got:
        by.setdefault(x.query_id, []).append(x)
    assert set(by) == {i for i in range(0, 1500, 50)}
    for q, found in by.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(v)), d))[:10]
        found.sort(key=lambda x: x.rank)
        assert [x.rank for x in found] == list(range(1, 11)) and all(abs(x.score - d[x.vec_id]) < 1e-12 for x in found)
        hit += len({x.vec_id for x in found} & set(best.tolist()))
        if q in (200, 250, 300, 350, 400):
            assert [x.vec_id for x in found] == best.tolist()
    assert hit >= 0.9 * 10 * len(by)
    held, shards = ann.index(df.limit(0), 10)
    assert ann.nearest(df, held, shards, 10).count() == 0
    held, shards = ann.index(df.where("vec_id < 3"), 10)
    assert ann.nearest(df.where("vec_id < 3"), held, shards, 10).count() == 6


def test_ann_ties_go_to_smaller_ids(spark):
    """32 nodes at exactly the same distance: more than k + 1, in the beam together."""
    unit = [[float(s * (i == j)) for j in range(16)] for i in range(16) for s in (1, -1)]
    origin = [1e-300] + [0.0] * 15  # not zero, and at distance 1 from all of them in double precision
    rows = [(100, origin)] + [(232 - i, v) for i, v in enumerate(unit)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held, shards = ann.index(df, 10)
    got = sorted(ann.nearest(df.where("vec_id = 100"), held, shards, 10).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(201, 211)) and {r.score for r in got} == {1.0}


# --- 8


def test_contamination(spark):
    r = random.Random(8)
    word = lambda: r.choice("abcde") + str(r.randrange(500))
    items = [" ".join(word() for _ in range(n)) for n in (1, 3, 5, 9, 20, 40, 80)] + [None, "", "a b c d e a b c d e"]
    rows = []
    for i in range(150):
        w = [word() for _ in range(r.randrange(0, 300))]
        it = r.choice(items)
        if it and r.random() < 0.6:
            x = it.split()
            for _ in range(r.choice([0, 0, 1, len(x) // 20])):
                x[r.randrange(len(x))] = word()
            w[len(w) // 2 : len(w) // 2] = x
        rows.append((i, " ".join(w).upper()))
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(300, items[5]), (300, items[5]), (None, items[4])]

    def shingles(t):
        w = (t or "").lower().split() if t is None or t.isascii() else (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, t in rows:
        a = shingles(t)
        for k, it in enumerate(items):
            b = shingles(it)
            if b and len(a & b) >= math.ceil(0.8 * len(b) - 1e-9):
                want.add((t, it))
    df, bench = docs(spark, rows), spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    found = decontaminate.contamination(df, bench)
    keys = {x.k: x.t for x in df.select(decontaminate.text_key(F.col("text")).alias("k"), F.col("text").alias("t")).collect()}
    names = {x.k: x.t for x in bench.where("text is not null").select(decontaminate.text_key(F.col("text")).alias("k"), F.col("text").alias("t")).collect()}
    assert {(keys[x.doc_key], names[x.item_key]) for x in found.collect()} == want and len(want) > 20
    left = decontaminate.decontaminated(df, bench)
    bad = {t for t, _ in want}
    assert left.columns == df.columns and left.count() == sum(t not in bad for _, t in rows)
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == len(rows) and decontaminate.contamination(df.limit(0), bench).count() == 0
