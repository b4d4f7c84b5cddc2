"""Surfaces taken apart: every surface of the lexicon gives back its own entry."""

import re

from pyspark.sql import functions as F

from hinoki.functions import lexicon as L
from hinoki.functions import morph as M
from hinoki.functions import tables as T
from hinoki.operators import analyse as A
from hinoki.operators import detect as D

FIELDS = ["surface", "form", "kind", "cls", "origin", "base", "hint"]


def test_every_surface_of_the_lexicon_is_found_again(spark):
    lex = L.lexicon(spark).select(FIELDS)
    found = A.analyse(lex).cache()
    assert found.count() == lex.count() and found.where("not known or inflection is null").count() == 0
    assert lex.exceptAll(found.select(FIELDS)).count() == 0


def test_literal_surfaces(spark):
    want = {
        "おっしゃいました": ("おっしゃる", "polite_past"), "ご存じです": ("ご存じだ", "polite"), "来られます": ("来る", "potential_polite"),
        "行って": ("行く", "te"), "読んだ": ("読む", "past"), "お読みになりません": ("お読みになる", "polite_neg"),
    }
    rows = {r.surface: (r.form, r.inflection) for r in A.analyse(spark.createDataFrame([(w,) for w in want], "surface string")).collect()}
    assert {w: rows[w][0] for w in want} == {w: f for w, (f, _) in want.items()}
    assert all(rows[w][1] == i for w, (_, i) in want.items() if w != "来られます")


def test_unknown_empty_null_and_repeated_surfaces(spark):
    rows = spark.createDataFrame([("泳いで", 1), ("泳いで", 2), ("走らない", 3), ("", 4), (None, 5), ("abc", 6), ("あ" * 100_000 + "きました", 7)], "surface string, known int")
    got = {r.surface: r for r in A.analyse(rows).collect()}
    assert len(got) == 5 and not any(r.known for r in got.values())
    assert (got["泳いで"].form, got["泳いで"].kind, got["泳いで"].inflection) == ("泳ぐ", "godan", "te")
    assert got["走らない"].form == "走る" and got[""].form is None and got["abc"].form is None
    assert got["あ" * 100_000 + "きました"].form == "あ" * 100_000 + "く"
    assert A.analyse(rows.limit(0)).count() == 0


def plain_tail(s):
    for t in T.POLITE_TAILS:
        if s.find(t) > 0:
            return s[: s.find(t)], s[s.find(t) :]
    return s, ""


def test_polite_tail_and_irregular_tail(spark):
    words = [r.surface for r in L.lexicon(spark).where("surface like '%ま%'").select("surface").collect()] + ["ます", "いただけますでしょうか", "ますますか", "", "ませんました"]
    rows = spark.createDataFrame([(w,) for w in words], "s string").select("s", A.polite_tail(F.col("s")).alias("t")).collect()
    assert all(tuple(r.t) == plain_tail(r.s) for r in rows) and len(rows) > 10_000
    cut = spark.createDataFrame([("お送りくださる",), ("くださる",), ("読む",), ("ご覧なさる",)], "s string").select(A.irregular_tail(F.col("s")).alias("t")).collect()
    assert [tuple(r.t) for r in cut] == [("お送り", "くださる"), ("", "くださる"), ("", "読む"), ("ご覧", "なさる")]


def test_general_forms_give_back_their_rule(spark):
    made = spark.sql(f"select f.*, v.kind, v.ogo from ({M.forms_sql(M.SONKEIGO)}) as f join {M.verbs_sql()} on v.plain = f.plain")
    assert made.where(A.sonkeigo_origin("form") != F.col("origin")).count() == 0
    odd = spark.sql("select '死ぬ' as plain, 'godan' as kind, 'お' as ogo, '死なれる' as form").select(A.sonkeigo_origin("form")).first()[0]
    assert odd == "sonkeigo_rareru"


def plain_minority(text):
    """The rarer style by a walk over the sentences, in plain Python."""
    polite, plain = re.compile(T.POLITE_END), re.compile(T.BASELINE_PLAIN_END)
    out, pos = [], 0
    for part in re.findall(r"[^。！？\n]*[。！？\n]|[^。！？\n]+", text):
        body = part.rstrip("。！？\n 　")
        kind = "polite" if polite.search(body) else "plain" if plain.search(body) else None
        if body and kind:
            out.append((pos, pos + len(body), kind))
        pos += len(part)
    n = [k for *_, k in out]
    if len(n) < 3 or len(set(n)) < 2:
        return []
    rare = "plain" if n.count("plain") <= n.count("polite") else "polite"
    return [(max(s, e - 8), e, text[max(s, e - 8) : e]) for s, e, k in out if k == rare]


def test_the_rarer_style(spark):
    ends = ["参ります。", "来た。", "行くことにした。", "です！？\n", "なる", "確認する。\n\n", "ません。 ", "abc\n", "　", "本日は晴天である。"]
    texts = ["".join(ends[(i * 7 + j * (i % 5 + 1)) % len(ends)] for j in range(i % 9)) for i in range(60)] + [None, "", "行きます。" * 3000 + "行くことにした。"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, D.style_minority(rows).collect()))
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in plain_minority(t or "")) and len(got) > 30
    assert D.style_minority(rows.limit(0)).count() == 0
