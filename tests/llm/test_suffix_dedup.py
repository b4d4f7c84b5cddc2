import hashlib
import random
from collections import Counter

import pytest

from hinoki.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, length):
    raw = {k: (t or "").encode() for k, (_, t) in enumerate(rows)}
    count = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = []
    for k, (doc, _) in enumerate(rows):
        b = raw[k]
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ß") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randrange(20, 80)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [text(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, len(p) // 2)
            parts += [p[a : r.randrange(a + 1, len(p) + 1)], text(r.randrange(0, 20))]
        rows.append((i, r.choice([" ", ""]).join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[5][1]), (102, None), (103, ""), (104, "ab" * 400), (105, "x" * 700), (106, passages[0] * 2), (107, "y" * 199), (108, "y" * 199), (109, "z" * 200), (110, "z" * 200)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,length,hot,run", [(1, 200, 20_000, 60_000), (2, 64, 20_000, 40), (3, 200, 3, 50), (4, 100, 1, 60_000)])
def test_against_brute_force(spark, monkeypatch, seed, length, hot, run):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "RUN", run)
    monkeypatch.setattr(S, "STRINGS", 900)
    monkeypatch.setattr(S, "COPIES", 2)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in S.digest(df, length).collect()), key=repr)
    assert got == brute(rows, length)


def test_hot_grams_make_one_row_a_text(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    passage = " ".join(word() for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(30)) + passage + " ".join(word() for _ in range(30)), "x") for i in range(120)]
    df, found = spark.createDataFrame(rows, SCHEMA).repartition(6), []
    for hot in (20_000, 10):
        monkeypatch.setattr(S, "HOT", hot)
        frame, spans, _ = S.coverage(df)
        assert spans.count() == 120
        found.append(sorted((bytes(x.key), x.spans) for x in spans.collect()))
    assert found[0] == found[1] and all(len(x) == 1 for _, x in found[0])


def test_texts_stay_whole_characters(spark):
    p = "é" * 150
    rows = [(1, "a" + p + "ü", "x"), (2, "bb" + p + "é ö", "y"), (3, None, None), (4, "short", "z")]
    got = {r.doc_id: r for r in S.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4 and got[3].text is None and got[4].text == "short" and got[1].spans == "x"
    assert got[1].text == "aü" and got[2].text.replace("é", "") == "bb ö"


def test_empty_table(spark):
    assert S.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(0, 12))).encode() for _ in range(400)]
    for n in (1, 2, 3, 7, 16):
        runs = [sorted(strings[i::n]) for i in range(n)]
        coded = [(lcp.tolist(), [len(s) for s in run], rest) for run in runs for lcp, rest in [S.front_code(run)]]
        feeds = [iter(x) for x in runs]
        out = [(next(feeds[w]), n) for w, n in S.LoserTree(coded)]
        assert [s for s, _ in out] == sorted(strings)
        for (a, _), (b, n) in zip(out, out[1:]):
            assert n == S.common(a, b, 0)
