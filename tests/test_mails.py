"""Mails of threads, their errors, labels and what is trained on them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinoki.llm import common as C
from hinoki.operators import detect as D
from hinoki.operators import evaluate as E
from hinoki.operators import labels as LB
from hinoki.operators import mails as MA
from hinoki.operators import report as RP
from hinoki.operators import tagger as TG
from hinoki.plans import mail_catalog as MC

THREADS = [(i, t, "user" if t % 2 == 0 else "assistant", f"text {i} {t}") for i in range(40) for t in range(2 + i % 8)] + [(None, 0, "user", None), (None, None, None, "x")]


@pytest.fixture(scope="module")
def mails(spark):
    return MA.Mails(spark, spark.createDataFrame(THREADS, "conv_id long, turn long, role string, text string"))


def test_one_sentence_a_turn_and_persons_alike(mails):
    rows = mails.sentences.collect()
    assert len(rows) == len(THREADS)
    for r in rows:
        assert r.text[r.start : r.end_] == r.predicate and r.text.endswith("。")
    named = {(r.conv_id, r.actor, r.person) for r in rows if r.person}
    assert len({(c, a) for c, a, _ in named}) == len(named)  # a side has one person in a mail
    assert {r.function for r in rows} == set(MA.PLAN)


def test_every_span_of_every_mail_verifies(mails):
    clean = {r.conv_id: r.text for r in mails.texts().collect()}
    broken = {r.conv_id: r.text for r in mails.damaged().collect()}
    log: dict = {}
    for r in mails.edit_log().collect():
        log.setdefault(r.conv_id, []).append(r)
    assert set(log) == set(broken) and max(len(v) for v in log.values()) == MA.MOST
    for key, edits in log.items():
        text = clean[key]
        for e in sorted(edits, key=lambda e: -e.old_start):
            assert text[e.old_start : e.old_end] == e.gold
            text = text[: e.old_start] + e.new + text[e.old_end :]
        assert text == broken[key]
        assert all(text[e.start : e.end] == e.new for e in edits)
        assert len({e.mode for e in edits}) == 1


def test_rules_find_nothing_in_clean_mails_and_the_errors_in_others(mails, spark):
    who = mails.persons().where("conv_id is not null")
    clean = mails.texts().join(who, "conv_id").withColumnRenamed("conv_id", "doc_id")
    assert D.detect(clean).where("verdict = 'norm_divergence'").count() == 0
    inv = mails.inversions().withColumnRenamed("conv_id", "doc_id")
    assert inv.where(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("surface")).count() == 0
    found = D.detect(inv.select(clean.columns).dropDuplicates(["doc_id"]))
    got = {r.type: r for r in E.recall(E.matched(inv.select("doc_id", "start", "end", F.lit("rank_inversion").alias("type")), found, "doc_id")).collect()}
    assert got["rank_inversion"].type_recall == 1.0


def test_no_source_text_in_two_splits(spark):
    rows = [(i, f"text {i % 50} {i}", f"text {i % 50}", i % 3) for i in range(400)]
    one = spark.createDataFrame(rows, "id long, text string, source_text string, n_errors int")
    more = spark.createDataFrame([(1, "text 1 1", "other", 9), (2, None, "x", 0)], one.schema)
    out = MA.dataset([("a", one), ("b", more)])
    got = out.collect()
    assert len(got) == 400 and {r.source for r in got} == {"a"}
    assert len({(r.source_text, r.split) for r in got}) == 50 and {r.split for r in got} == {"train", "validation", "test"}
    total = [r for r in MA.card(out).collect() if r.source is None]
    assert total[0].n == 400 and total[0].n_chars == sum(len(r.text) for r in got)


def test_labels_decode_back_to_the_spans(spark):
    text = "弊社のＡＢＣがおっしゃいました。サーーバーを\n見ます。" * 30
    spans = [(m.start(), m.end(), ("x", "y")[i % 2]) for i, m in enumerate(re.finditer("おっしゃいました|見", text))]
    docs = spark.createDataFrame([(1, text, "[external] "), (2, "", "p"), (3, None, None), (4, " 　", "p")], "id long, text string, prefix string")
    errors = spark.createDataFrame([(1, *s) for s in spans] + [(1, 3, 3, "x"), (1, 0, 2, "none"), (9, 0, 1, "x")], "id long, start int, end int, type string")
    for window in (7, 64, 4096):
        t = LB.labelled(LB.pieces(docs, "id", prefix="prefix", window=window), errors, "id")
        rows = t.orderBy("win", "pos").collect()
        assert {r.id for r in rows} == {1}
        assert all((r.label is None) == r.masked == (r.start < 0) for r in rows)
        body = [r for r in rows if not r.masked]
        assert "".join(text[r.start : r.end] for r in body) == re.sub(r"\s", "", text)  # nothing is cut off
        assert max(r.pos for r in rows) < window
        got = sorted((r.start, r.end, r.type) for r in LB.spans(t, "id").collect())
        assert got == spans
    piece = {r.piece for r in rows}
    assert "abc" in piece and "サーバー" in piece and "。" not in piece


def test_spans_below_a_confidence_go(spark):
    rows = [(1, 0, i, i, i + 1, False, x, c) for i, (x, c) in enumerate([("B-a", 0.9), ("I-a", 0.4), ("I-a", 0.8), ("B-a", 0.7), ("I-b", 0.9)])]
    t = spark.createDataFrame(rows, "id long, win int, pos int, start int, end int, masked boolean, label string, confidence double")
    got = sorted((r.start, r.end, r.type, round(r.confidence, 3)) for r in LB.spans(t, "id", 0.5).collect())
    assert got == [(0, 1, "a", 0.9), (2, 3, "a", 0.8), (3, 4, "a", 0.7), (4, 5, "b", 0.9)]


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(20):
        n, k = int(r.integers(1, 6)), 4
        scores, steps, first = r.normal(size=(n, k)), r.normal(size=(k, k)), r.normal(size=k)
        value = lambda p: first[p[0]] + sum(scores[i, y] for i, y in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(k), repeat=n), key=value)
        assert tuple(TG.viterbi(scores, steps, first)) == best


def test_a_trained_tagger_finds_held_out_errors(spark):
    types = ["go_sareru", "double_keigo"]
    words = {"go_sareru": "利用される", "double_keigo": "読みになられる"}
    rows, gold = [], []
    for i in range(600):
        t = types[i % 2] if i % 3 else None
        head, tail = f"{'弊社貴社先方'[i % 3 * 2 : i % 3 * 2 + 2]}の{'田中鈴木木村'[i % 5 % 3 * 2 :][:2]}が", "。"
        mid = ("ご" if t == "go_sareru" else "お") + words[t] if t else "確認する"
        rows.append((i, head + mid + tail))
        if t:
            gold.append((i, len(head), len(head + mid), t))
    docs, spans = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(gold, "id long, start int, end int, type string")
    seqs = TG.sequences(LB.labelled(LB.pieces(docs, "id"), spans, "id"), "id")
    weights = TG.train(seqs.where("id < 400"), rounds=3, shard=100)
    again = TG.train(seqs.where("id < 400"), rounds=3, shard=100)
    assert (weights == again).all()
    found = LB.spans(TG.tag(seqs.where("id >= 400"), weights, "id"), "id")
    for r in TG.scores(spans.where("id >= 400"), found, "id").collect():
        assert r.recall > 0.95 and r.precision > 0.95
    assert not TG.train(seqs.limit(0), rounds=1).any()


def test_report_lines(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("b", None)], "type string, source string")
    lines = [r.line for r in RP.pivot(rows, "type", "source", ["x", "y"]).orderBy("part", "at").collect()]
    assert lines == ["| type | x | y | all |", "| - | - | - | - |", "| a | 1 | 1 | 2 |", "| b | 1 | 0 | 2 |", "| all | 2 | 1 | 4 |"]


def test_steps_of_mails_are_written_once(spark):
    threads = spark.createDataFrame([(i, j, "user", f"t{i}{j}") for i in range(3) for j in range(4)], "conv_id long, turn long, role string, text string")
    m = MA.Mails(spark, threads)
    for df, name in ((m.sentences, "mail-sentences"), (m.proposals, "mail-proposals"), (m.errors, "mail-errors"), (m.damaged(), "mail-damaged")):
        assert all(name in f for f in df.inputFiles()) and df.inputFiles()


def test_repeated_sequences_are_walked_once(monkeypatch):
    class Never(list):
        __eq__ = lambda self, other: False
        __hash__ = None

    kinds = [(["a", "b", "c"], [0, 1, 2]), (["d", "e"], [0, 0]), (["a", "e", "f", "b"], [3, 0, 1, 2])]
    rows = [(list(p), list(y)) for p, y in kinds for _ in range(40)]
    n = len(TG.LABELS)
    weights = np.zeros(((1 << 8) + n, n))
    plain = TG.walk(weights, [(Never(p), Never(y)) for p, y in rows], n)
    calls, real = [], TG.features
    monkeypatch.setattr(TG, "features", lambda *a: calls.append(1) or real(*a))
    assert np.array_equal(TG.walk(weights, rows, n), plain) and len(calls) < 40


def test_labels_in_the_row_are_those_of_the_joins(spark):
    texts = ["弊社のＡＢＣがおっしゃいました。サーーバーを\n見ます。" * 9, "見ます。", "", None]
    spans = [[(28 * i + 3, 28 * i + 9, "y"), (28 * i + 3, 28 * i + 15, "x"), (28 * i + 12, 28 * i + 22, "x"), (28 * i + 22, 28 * i + 23, "x")] for i in range(9)]
    spans = [sum(spans, []) + [(5, 5, "x"), (0, 2, "none"), (3, 200, "z")], None, [(0, 1, "x")], []]
    docs = spark.createDataFrame([(i, t, "[external] ", s) for i, (t, s) in enumerate(zip(texts, spans))], "id long, text string, prefix string, spans array<struct<start: int, end: int, type: string>>")
    errors = docs.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    for window in (3, 8, 4096):
        joined = LB.labelled(LB.pieces(docs, "id", prefix="prefix", window=window), errors, "id").where("not masked")
        want = sorted((r.id, r.win, r.pos, r.start, r.end, texts[r.id][r.start : r.end], r.label) for r in joined.collect())
        got = sorted(map(tuple, LB.labelled_texts(docs, "id", "spans", prefix="prefix", window=window).collect()))
        assert got == want and {x[0] for x in got} == {0, 1}
    assert {x[-1] for x in got} == {"O", "B-y", "I-y", "B-x", "I-x", "B-z", "I-z"}


def broadcast_files(plan) -> list[str]:
    """What a plan's joins broadcast of what stands in files."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    found = [x for p in below for x in broadcast_files(p)]
    if plan.nodeName().startswith("Broadcast") and "Join" in plan.nodeName():
        built = below[0 if "Left" in plan.buildSide().toString() else 1].toString()
        found += [built] * ("parquet" in built.lower())
    return found


def test_subword_labels_broadcast_no_table_that_grows(spark, tmp_path, monkeypatch):
    # Enough of them that the rule tables are the smaller ones.
    rows = [(i or None, t, "user", f"text {i} {t}") for i in range(500) for t in range(1 + i % 9)]
    rows += [(None, t, "user", f"text {t}") for t in range(1, 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plans, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, tag: plans.append(df) or write(df, tag))
    out = MC.subword_labels(spark, str(tmp_path))
    for df in [*plans, out]:  # by the sizes of files, a small part of what their rows take in the driver
        assert broadcast_files(df._jdf.queryExecution().sparkPlan()) == []
    labels = [(r.conv_id, r.label) for r in out.collect()]
    m = MC.mails(spark, str(tmp_path))
    begun = [(k, x) for k, x in labels if x.startswith("B-")]
    assert None in {k for k, _ in begun}  # the mail without a key has its labels, too
    assert len(begun) >= m.errors.count() and {k for k, _ in labels} == {r.conv_id for r in m.damaged().collect()}


def test_plain_stages_hold_for_the_step_alone(spark):
    key = "spark.sql.codegen.wholeStage"
    before, stages = spark.conf.get(key), lambda: "*(" in spark.range(9).where("id > 3")._jdf.queryExecution().executedPlan().treeString()
    with pytest.raises(ValueError):
        with C.plain_stages(spark):
            assert not stages()
            raise ValueError
    assert spark.conf.get(key) == before and stages() == (before == "true")
