import pytest

from hinoki.functions import lexicon, morph as M, tables as T


@pytest.mark.parametrize(
    "fn,form,kind,expected",
    [
        ("masu_stem", "読む", "godan", "読み"), ("masu_stem", "届ける", "ichidan", "届け"), ("masu_stem", "利用する", "sahen", "利用し"),
        ("masu_stem", "おっしゃる", "godan", "おっしゃい"), ("masu_stem", "くださる", "godan", "ください"), ("masu_stem", "なさる", "godan", "なさい"),
        ("masu_stem", "お送りくださる", "godan", "お送りください"), ("a_stem", "読む", "godan", "読ま"), ("a_stem", "休む", "godan", "休ま"),
        ("a_stem", "伺う", "godan", "伺わ"), ("potential", "お読みになる", "godan", "お読みになれる"), ("potential", "お届けする", "sahen", "お届けできる"),
        ("te_form", "行く", "godan", "行って"), ("te_form", "急ぐ", "godan", "急いで"), ("polite", "ご存じだ", "copula", "ご存じです"), ("past_plain", "読む", "godan", "読んだ"),
    ],
)
def test_conjugation(spark, fn, form, kind, expected):
    assert spark.sql(f"select {getattr(M, fn)(M.quote(form), M.quote(kind))}").first()[0] == expected


def test_constraints(spark):
    son = {(r.plain, r.form) for r in spark.sql(M.forms_sql(M.SONKEIGO)).collect()}
    assert ("読む", "お読みになる") in son and ("利用する", "ご利用なさる") in son
    assert not any(f.endswith("になる") for p, f in son if p in ("死ぬ", "失敗する", "運転する"))
    ken = {r.plain for r in spark.sql(M.forms_sql(M.KENJOUGO1)).collect()}
    assert not ken & {"乗車する", "利用する", "休む"}


def test_every_error_type_has_a_citation():
    keys = {c[0] for c in T.CITATIONS}
    assert all(t[3] in keys for t in T.ERROR_TYPES)
    assert all(v[3] in keys for v in T.VARIATIONS if v[3])


def test_lexicon(spark):
    lex = lexicon.lexicon(spark)
    assert lex.count() == lex.select("surface").distinct().count() == 65125
    rows = {r.surface: r for r in lex.where("surface in ('伺います', 'おっしゃいました', 'ご説明いたします', '読みます', '伺ってください')").collect()}
    assert rows["伺います"].cls == "kenjougo_1" and rows["おっしゃいました"].cls == "sonkeigo"
    assert rows["ご説明いたします"].cls == "kenjougo_1_and_2" and rows["読みます"].cls == "plain" and rows["伺ってください"].origin == "link"


def test_variation_surfaces_are_unique():
    s = [w for v in T.VARIATIONS for w in v[1].split(" ")]
    assert len(s) == len(set(s)) == 125
    assert all(any(w in x for w in s) for x in T.SPLIT_SURFACES)
    assert not any(w in x for w in s for x in T.NOT_VARIATIONS)
