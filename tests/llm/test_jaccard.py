import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinoki.llm import common as C
from hinoki.llm import jaccard

SCHEMA = "doc_id long, text string, node string"


def corpus(seed, groups=12, copies=25):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(400))
    hot = [word() for _ in range(60)]
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.choice([5, 9, 30, 60, 150, 400]))]
        for _ in range(r.randrange(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, len(w) // 30])):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w += hot[: r.randrange(len(hot))]
            rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
            i += 1
    for text in ("", None, "  \n", "one", "One ", "one two three", " ".join(hot), " ".join(hot[:-1]), "é É", "É é"):
        rows.append((i, text))
        i += 1
    r.shuffle(rows)
    return rows


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i, _ in rows}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a] | sets[b])):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,frequent,n,num,den", [(1, 32, 4, 85, 100), (2, 2, 4, 85, 100), (3, 3, 5, 80, 100), (4, 2, 5, 80, 100)])
def test_against_brute_force(spark, monkeypatch, seed, frequent, n, num, den):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(seed)
    got = jaccard.classes_of(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), n, num, den).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num, den)


def test_empty_repeated_and_null_rows(spark):
    assert jaccard.classes_of(spark.createDataFrame([], SCHEMA), 4, 85, 100).collect() == []
    got = jaccard.classes_of(spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "x"), (3, None, None)], SCHEMA), 4, 85, 100).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (3, 0, 3)]


def test_sketches_bound_what_prefixes_share(spark):
    """Never under the true number, and far under the set's size where nothing is shared; a sketch
    is an eighth of its tokens at most (a prefix of its own stood in every row before)."""
    rng, rows = np.random.default_rng(7), []
    for i, (n, m, common) in enumerate([(1, 1, 1), (100, 130, 90), (250, 260, 200), (1000, 1030, 600), (1030, 1000, 0), (600, 2100, 500), (5000, 5000, 0)]):
        x, y = (rng.integers(0, 1 << 63, k, np.uint64) for k in (n, m))
        y[:common] = x[:common]
        for s in (x, y):
            if len(s) >= 512:
                assert jaccard.sketch(s).nbytes <= s.nbytes / 8
        side = lambda s: (len(s), len(s) - int(np.unpackbits(jaccard.sketch(s).view(np.uint8)).sum()), jaccard.sketch(s).tolist())
        rows.append((i, common, side(x), side(y)))
    kind = "struct<n long, spare long, bits array<long>>"
    pairs = spark.createDataFrame(rows, f"i int, common int, x {kind}, y {kind}")
    told = pairs.select("i", jaccard.may_share(F.col("common")).alias("all"), jaccard.may_share(F.lit(0.45) * F.least("x.n", "y.n") + 1).alias("half")).collect()
    assert all(r["all"] for r in told)
    assert [r["half"] for r in told if r["i"] in (4, 6)] == [False, False]


def test_shuffle_files_go_with_the_write(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, held = files(), spark.conf.get(C.CLEANUP, None)
    out = C.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert out.count() == 7 and spark.conf.get(C.CLEANUP, None) == held
    assert files() <= before + 2  # the count's own


def test_an_outsider_meets_a_component_once(spark):
    """Forty keys shared by a component of fifty sets and two outsiders: a row a pair (there were
    forty), and two that are alone meet once where their keys list the same nodes."""
    plan = jaccard.Plan(4, 85, 100)
    nodes = [(i, 0 if i < 50 else i, 50 if i < 50 else 1) for i in range(52)]
    tokens = np.arange(200, dtype=np.uint64)
    side = (len(tokens), len(tokens) - int(np.unpackbits(jaccard.sketch(tokens).view(np.uint8)).sum()), jaccard.sketch(tokens).tolist())
    nodes = spark.createDataFrame([(i, 200, 0, label, crowd, *side) for i, label, crowd in nodes], "node long, size long, own long, label long, crowd long, n long, spare long, bits array<long>")
    named = spark.range(40).withColumnRenamed("id", "key").crossJoin(nodes.select("node"))
    got = [tuple(sorted(r)) for r in jaccard.meetings(named, nodes, plan).collect()]
    assert sorted(got) == sorted([(i, o) for i in range(50) for o in (50, 51)] + [(50, 51)])
