"""Core operators against plain Python and literal rows."""

import random
import re

from pyspark.sql import functions as F

from hinoki.operators import correct as CO
from hinoki.operators import detect as D
from hinoki.operators import evaluate as E
from hinoki.operators import roles as R
from hinoki.operators import spans as S
from hinoki.operators import text as X
from tests.test_check import frame


def test_offsets_of_long_texts(spark):
    r = random.Random(1)
    texts = ["", "a", *("".join(r.choice("ab。\n") for _ in range(n)) for n in (5, 16, 17, 300, 3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for x in X.finditer(df, "a+b?").collect():
        got.setdefault(x.id, []).append((x.start, x.end, x.surface))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?", t)]
    lines = {}
    for x in X.line_starts(df, "id").collect():
        lines.setdefault(x.id, []).append((x.start, x.length))
    for i, t in enumerate(texts):
        want, at = [], 0
        for s in t.split("\n"):
            want.append((at, len(s)))
            at += len(s) + 1
        assert sorted(lines[i]) == sorted(want)


def test_positions(spark):
    df = spark.createDataFrame([(1, "ab\ncde\n", 2, 1, 2, 3), (2, "ab\ncde", 2, 9, 2, 9), (3, "ab", 4, 1, 4, 2), (4, "ab\ncd", 1, 2, 2, 1), (5, "ab", 1, 1, None, None), (6, None, 1, 1, 1, 2)], "id int, text string, from_line int, from_column int, to_line int, to_column int")
    got = {x.id: (x.start, x.end, x.surface) for x in X.ranges(df, "id").collect()}
    assert got == {1: (3, 5, "cd"), 2: (6, 6, ""), 4: (1, 3, "b\n"), 5: (0, 1, "a")}


def test_nms_of_a_hot_key(spark):
    r = random.Random(2)
    rows = [(1 if i % 3 else i, i, r.randrange(3000), r.random()) for i in range(600)]
    rows = [(k, i, s, s + r.randrange(1, 9), v) for k, i, s, v in rows]
    df = spark.createDataFrame(rows, "k int, id int, start int, end int, v double")
    got = {x.id for x in S.nms(df, ["k"], [-F.col("v"), F.col("id")], ["id", "start", "end"]).collect()}
    want, held = set(), {}
    for k, i, s, e, v in sorted(rows, key=lambda x: (-x[4], x[1])):
        if all(e <= a or z <= s for a, z in held.setdefault(k, [])):
            held[k].append((s, e))
            want.add(i)
    assert got == want


def test_binned_overlap_join(spark):
    r = random.Random(3)
    a = [(r.randrange(2), i, s, s + r.randrange(0, 8)) for i, s in enumerate(r.randrange(200) for _ in range(150))]
    b = [(r.randrange(2), i, s, s + r.randrange(0, 90)) for i, s in enumerate(r.randrange(200) for _ in range(150))]
    left, right = spark.createDataFrame(a, "k int, id int, start int, end int"), spark.createDataFrame(b, "k int, id2 int, start2 int, end2 int")
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    pairs = S.overlap_join(left, right, "k", longest=8).select("id", "id2").collect()
    assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want
    met = {x for x, _ in want}
    assert {x.id for x in S.overlap_join(left, right, "k", "left_anti", 8).collect()} == set(range(150)) - met
    assert S.overlap_join(left, right, "k", "left", 8).count() == len(want) + 150 - len(met)


def test_percentiles(spark):
    r = random.Random(4)
    rows = [("one", 5.0), ("two", 1.0), ("two", 4.0), *(("same", 2.0) for _ in range(50)), *(("far", r.choice([0.0, 1e9, r.random()])) for _ in range(333)), ("none", None)]
    got = {x.g: x for x in E.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", "g", 64).collect()}
    for g in ("one", "two", "same", "far"):
        v = sorted(x for k, x in rows if k == g)
        n = len(v)
        assert (got[g].n, got[g].median, got[g].p95) == (n, (v[(n - 1) // 2] + v[n // 2]) / 2, v[int(0.95 * n)])
    assert "none" not in got


def test_edits(spark):
    df = spark.createDataFrame([(1, "abcdef", [(0, 1, "XY"), (2, 4, ""), (6, 6, "!")]), (2, "x", [])], "id int, text string, edits array<struct<start:int,end:int,new:string>>")
    assert [x.t for x in df.orderBy("id").select(S.apply_edits("text", "edits").alias("t")).collect()] == ["XYbef!", "x"]


#: What the norms name as the forms in place of each.
FORMS = [
    ("この電車にはご乗車できません。", "ogo_dekiru", {"ご乗車になれません", "ご乗車いただけません", "乗車はできません"}),
    ("本サービスはご利用されます。", "go_sareru", {"利用されます", "利用なさいます", "ご利用になります", "ご利用なさいます"}),
    ("担当者に伺ってください。", "bad_keigo_link", {"お聞きください", "お尋ねください"}),
    ("弊社の佐藤がおっしゃいました。", "uchi_sonkeigo", {"申しました", "申しておりました"}),
    ("明日は休まさせていただきます。", "sa_insertion", {"休ませ"}),
    ("資料をお読みになられました。", "double_keigo", {"お読みになり"}),
    ("私が資料をお持ちになります。", "self_sonkeigo", {"お持ちします"}),
    ("鈴木様がお持ちします。", "direction_swap", {"お持ちになります"}),
    ("資料を送りました。内容を確認します。会議は明日だ。よろしくお願いいたします。", "style_mixing", {"会議は明日です"}),
]


def test_corrections_by_type(spark):
    m = frame(spark, [t for t, _, _ in FORMS])
    got = {}
    for x in CO.suggest(spark, D.detect(m), R.tag(m), m, most=None).collect():
        got.setdefault((x.doc_id, x.error_type), set()).add(x.suggestion)
    for i, (text, kind, want) in enumerate(FORMS):
        have = got.get((i, kind), set())
        assert all(any(w in h or h in w for h in have) for w in want), (text, kind, have)


def test_majority_and_plain_statements(spark):
    df = spark.createDataFrame([("終わった。行きます。",), ("終わった。行く。",), (None,), ("",)], "t string")
    assert [x.p for x in df.select(CO.majority_is_polite(F.col("t")).alias("p")).collect()][:2] == [True, False]
    s = spark.createDataFrame([("確認させていただきました",), ("送らさせていただく",)], "t string").select(CO.plain_statement(F.col("t")).alias("x")).collect()
    assert [f.text for f in s[0].x] == ["確認いたしました", "確認しました"] and s[1].x is None
