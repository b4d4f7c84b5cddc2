import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hinoki.functions import tables as T
from hinoki.operators import detect as D
from hinoki.operators import evaluate as E
from hinoki.operators import roles as R
from hinoki.operators import spans as S
from hinoki.operators import text as X
from hinoki.plans import catalog
from hinoki.plans.checker import Checker
from hinoki.sources import records
from hinoki.streaming.adapter import check_stream

PERSONS = [("佐藤", "self_group"), ("田中", "addressee"), ("鈴木", "addressee_group")]
SCHEMA = "doc_id long, text string, audience string, writer string, recipient string, persons array<struct<name:string,side:string>>"


def frame(spark, texts, audience="external", persons=PERSONS):
    return spark.createDataFrame([(i, t, audience, "山田", "", persons) for i, t in enumerate(texts)], SCHEMA)


def test_roles(spark):
    cases = [
        ("弊社の田中がご説明いたします。", "self_group", None), ("田中様がおっしゃいました。", "addressee", "sonkeigo"), ("明日、貴社に伺います。", "self", "kenjougo_1"),
        ("担当者に伺ってください。", "addressee", "kenjougo_1"), ("資料をお送りいただき、ありがとうございました。", "self", "kenjougo_1"),
        ("弊社の佐藤社長がおっしゃっておりました。", "self_group", "sonkeigo"), ("私が資料をお持ちします。", "self", "kenjougo_1"), ("鈴木様がご覧になりました。", "addressee_group", "sonkeigo"),
    ]
    rows = Checker(spark).roles(frame(spark, [c[0] for c in cases])).orderBy("doc_id", "start").collect()
    first = {}
    for r in rows:
        first.setdefault(r.doc_id, r)
    for i, (text, actor, cls) in enumerate(cases):
        assert first[i].actor == actor, text
        assert cls is None or first[i].cls == cls, text


def test_sentences(spark):
    got = X.sentences(spark.createDataFrame([(1, "一つ目です。二つ目です。\n三つ目です。")], "id int, text string")).orderBy("sent_idx").collect()
    assert [(r.sent_start, r.sentence) for r in got] == [(0, "一つ目です。"), (6, "二つ目です。\n"), (13, "三つ目です。")]


CANONICAL = [
    ("担当者に伺ってください。", "bad_keigo_link"), ("鈴木様がお持ちします。", "direction_swap"), ("本サービスはご利用されますか。", "go_sareru"), ("この電車にはご乗車できません。", "ogo_dekiru"),
    ("資料をお読みになられました。", "double_keigo"), ("弊社の佐藤がおっしゃいました。", "uchi_sonkeigo"), ("明日は休まさせていただきます。", "sa_insertion"), ("私が資料をお持ちになります。", "self_sonkeigo"),
]


def test_canonical_examples(spark):
    found = D.detect(frame(spark, [c[0] for c in CANONICAL])).where("verdict = 'norm_divergence'").collect()
    got = {(r.doc_id, r.error_type) for r in found}
    assert all((i, t) in got for i, (_, t) in enumerate(CANONICAL)), got
    for r in found:
        assert CANONICAL[r.doc_id][0][r.start : r.end] == r.surface


def test_audience_flips_the_verdict(spark):
    text = ["佐藤社長がおっしゃいました。"]
    out = D.detect(frame(spark, text)).collect()
    assert [(r.error_type, r.verdict, r.citation_key) for r in out] == [("uchi_sonkeigo", "norm_divergence", "uchi_soto.q25")]
    assert [r.verdict for r in D.detect(frame(spark, text, "internal")).collect()] == ["variation"]


VARIED = ["明日十四時に御社へお伺いいたします。", "温かいうちにお召し上がりになるとよろしいかと存じます。", "先ほど佐藤様がお見えになりました。", "いつも当社のサービスをご利用いただき、ありがとうございます。",
          "当日は筆記用具をご持参ください。", "その旨、担当者に申し伝えます。", "ご連絡をお待ちしております。", "今回のお見積りは、当初の想定より少し高いです。", "お送りいただいた企画書を拝見させていただきました。", "ご依頼の件、了解しました。"]


def test_divided_usage_is_not_reported(spark):
    assert D.detect(frame(spark, VARIED, persons=[])).where("verdict = 'norm_divergence'").count() == 0


def test_corpus_has_no_false_positive_and_errors_are_found(spark):
    assert catalog.corpus_false_positives(spark, "").first().docs_with_fp <= 0.02 * 3924
    recall = {r.type: r.type_recall for r in catalog.corpus_recall(spark, "").collect()}
    assert recall["__all__"] >= 0.9 and min(recall.values()) >= 0.5


def test_nulls_and_empty(spark):
    m = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "ご利用されます。")], "doc_id long, text string")
    c = Checker(spark)
    assert [(r.doc_id, r.error_type) for r in c.check(m).collect()] == [(4, "go_sareru")]
    assert c.check(m.limit(0)).count() == 0
    out = {r.doc_id: json.loads(r.result) for r in c.results(m).collect()}
    assert out[4]["reportable_count"] == 1 and out[1]["findings"] == []


def test_suggestions_clear_the_finding(spark):
    m = frame(spark, [c[0] for c in CANONICAL])
    c = Checker(spark)
    best = c.suggest(m).where("nth = 1").join(m.select("doc_id", "text"), "doc_id")
    fixed = best.withColumn("text", S.overlay("text", "start", "end_", "suggestion")).select("doc_id", "text")
    assert best.count() >= 7
    again = D.detect(fixed.join(m.drop("text"), "doc_id").select(*m.columns)).where("verdict = 'norm_divergence'").count()
    assert again <= 1


def test_explain_and_forms(spark):
    c = Checker(spark)
    assert c.explain("go_sareru")["page"] == "p.36" and c.explain("uchi")["error_type"] == "uchi_sonkeigo"
    with pytest.raises(KeyError):
        c.explain("keigo")
    with pytest.raises(KeyError):
        c.forms("走る")
    assert "お読みになります" in {r.text for r in c.forms("読む").where("label = 'reader'").collect()}


def test_merge_and_records(spark, tmp_path):
    rows = [(1, 0, 5, "a", "go_sareru", "norm_divergence", 0.8), (1, 2, 6, "b", "double_keigo", "variation", 0.5), (1, 8, 9, "c", "go_sareru", "norm_divergence", 0.4)]
    f = spark.createDataFrame(rows, "doc_id long, start int, end int, surface string, error_type string, verdict string, confidence double")
    assert sorted((r.start, r.verdict) for r in D.merge(f).collect()) == [(0, "variation"), (8, "norm_divergence")]
    assert records.read_records(spark, str(tmp_path / "none")).count() == 0
    one = spark.createDataFrame([("x", "本文", "external")], "id string, text string, audience string").withColumn("split", F.lit("train"))
    records.write_records(one, str(tmp_path / "d"))
    back = records.read_records(spark, str(tmp_path / "d"))
    assert [(r.id, r.split) for r in back.collect()] == [("x", "train")]
    assert records.decode_context(back).first().persons == []


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "ご利用されます。")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = check_stream(s, Checker(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_bio_decode(spark):
    rows = [("a", i, l, 1.0) for i, l in enumerate(["O", "B-x", "I-x", "I-y", "O", "I-y", "B-y"])]
    got = E.bio_decode(spark.createDataFrame(rows, "id string, pos int, label string, confidence double")).orderBy("start").collect()
    assert [(r.type, r.start, r.end) for r in got] == [("x", 1, 3), ("y", 3, 4), ("y", 5, 6), ("y", 6, 7)]


def test_core_keeps_sentences_and_matches(spark):
    """Within the lines that hold the script all sentences, their numbers and all matches of the
    whole text are found, whatever stands at its lines' ends."""
    r = random.Random(5)
    odd = [None, "", "\n", "です", "plain\ntext? yes!\n", "a? ?\n\n \nb\nです\n？\n\nc", "?\nです", "a\n?です。\u2028", "\u2028\nです\u2028", "🙂a。\r\nお読みになられ🙂\nご利用されます\nz"]
    rows = odd + ["".join(r.choice("ab 　\n\n\r?。！\u2028\u0085🙂です行くだ") for _ in range(r.randrange(40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    cols = ["doc_id", "sent_idx", "sent_start", "sentence"]
    whole = X.sentences(df).where(F.col("sentence").rlike(X.SCRIPT)).select(*cols)
    got = X.script_sentences(df)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, whole.collect()))
    assert "text" in got.columns and not [c for c in got.columns if c.startswith("_") and c != "_nth"]
    for p in ("[いで][^\n]{0,3}[すだ]", "です|行く"):
        hits = X.finditer(X.core(df), p).select("doc_id", F.col("_at") + F.col("start"), "surface")
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, X.finditer(df, p).select("doc_id", "start", "surface").collect()))


def test_text_outside_the_script_is_not_searched(spark):
    """The families, scans and folds see a few lines of a long text; nothing is made twice."""
    df = spark.createDataFrame([(1, "x? y\n" * 1000 + "ご利用されます。\n" + "z!\n" * 1000)], "doc_id int, text string")
    assert X.core(df).select("text", "_at").collect() == [("ご利用されます。\n", 5000)]
    plan = X.script_sentences(df).select("sent_start")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and X.script_sentences(df).first()["sent_idx"] == 2000


def test_cut_reads_a_text_once(spark):
    """One pattern over the whole text, and the same lines as by splitting it (it took seven functions of the text before)."""
    texts = [None, "", "x\ny", "a\n。。あい。\n！b\nう\n\nz", "あ", "\r\n？ああb\r\n！\nc", "😀\n 😀かき。😀\n" * 2 + "z" * 5000, "x\n" * 5000 + "さ\u2028\u0085y\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    script, ends = re.compile(X.SCRIPT), set(T.SENTENCE_ENDS)
    want = []
    for i, t in enumerate(texts):
        held = [m.start() for m in script.finditer(t or "")]
        if held:
            a, z = t.rfind("\n", 0, held[0]) + 1, (t.find("\n", held[-1]) + 1 or len(t) + 1) - 1
            while t[a] in ends:
                a += 1
            while z < len(t) and t[z] in ends:
                z += 1
            want.append((i, t[a:z], a))
    cut = X.cut(df)
    assert sorted(tuple(r) for r in cut.select("doc_id", "text", "_at").collect()) == want
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and not any(f in plan for f in ("split(", "reverse(", "RLIKE"))


def test_roles_are_made_once_for_findings_and_their_roles(spark):
    m = frame(spark, ["弊社の佐藤がおっしゃいました。"])
    found, roles = catalog.found_and_roles(m)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("_head")
    assert scans(found) == scans(roles) == 0 and scans(D.detect(m)) > 0
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(found) == key(D.detect(m)) and found.count() > 0


def test_equal_lines_are_tagged_once(spark):
    """Messages with the same lines and context share one text, whatever stands around them; what is
    found there has each message's own places and sentence numbers."""
    line = "弊社の田中がお越しになります。鈴木様は十時に参ります。"
    rows = [(0, f"abc\n{line}\nxyz", "external"), (1, f"One. Two.\n\nthree\n{line}\n", "external"), (2, f"\n{line}\n", "internal"), (3, f"a\n{line}ご持参ください。", "external"), (4, "none", "external"), (5, None, "external"), (6, line, "external")]
    m = spark.createDataFrame(rows, "doc_id long, text string, audience string").selectExpr("*", "'山田' as writer", "'佐藤' as recipient", "array(struct('田中' as name, 'self_group' as side)) as persons")
    texts, places = catalog.texts_of(X.cut(m, numbered=True))
    assert sorted(r.doc_id for r in places.collect()) == [0, 1, 2, 3, 6] and texts.count() < 5
    columns = ["doc_id", "sent_idx", "start", "end", "surface", "actor", "target"]
    got = catalog.everywhere(R.tag(texts), places).withColumn("sent_idx", F.col("_before") + F.col("sent_idx"))
    want = R.tag(m).select(columns).collect()
    assert len(want) >= 6 and sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want))
