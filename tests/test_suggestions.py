import os

import duckdb
import pytest
from pyspark.sql import functions as F

from hinoki.functions.morph import values
from hinoki.operators import correct as CO
from hinoki.plans import catalog
from hinoki.plans import sql_suggestions as QS

#: (error type, text of the finding, forms wanted)
CASES = [
    ("sa_insertion", "休まさせて", ["休ませて"]),
    ("sa_insertion", "行かさせていただきます", ["行かせていただきます"]),
    ("sa_insertion", "食べます", ["食べます"]),
    ("sasete_itadaku_overuse", "確認させていただきました", ["確認いたしました", "確認しました"]),
    # An ending that isn't listed stays behind the polite form.
    ("sasete_itadaku_overuse", "確認させていただきたい", ["確認いたしますきたい", "確認しますきたい"]),
    ("sasete_itadaku_overuse", "させていただきます", []),
    ("double_keigo", "お読みになられました", ["お読みになりました"]),
    ("double_keigo", "読みます", []),
    ("style_mixing", "会議は明日だ。", ["会議は明日です。"]),
    ("style_mixing", "", []),
    ("style_mixing", "予約した。．", ["予約しました。．"]),
]


def test_forms_made_by_hand_agree_in_both_engines(spark):
    """What no table of replacements holds, as literal rows, expressions and SQL."""
    text, kind = F.col("surface"), F.col("error_type")
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "k long, error_type string, surface string")
    made = (
        F.when(kind == "sa_insertion", CO.without_sa(text)).when(kind == "sasete_itadaku_overuse", CO.plain_statement(text)).when(kind == "double_keigo", CO.undone(text))
        .when(kind == "style_mixing", CO.made_polite(text))
    )
    ours = {r["k"]: [(x["text"], x["cls"]) for x in r["m"] or []] for r in rows.select("k", made.alias("m")).collect()}
    asked = values([(i, t, s, True) for i, (t, s, _) in enumerate(CASES)], "k, error_type, surface, polite", "c")
    theirs = {i: [] for i in range(len(CASES))}
    for k, x, c in duckdb.sql(f"with asked as (select * from {asked}), {QS.by_hand()} select k, text, cls from byhand order by k, i").fetchall():
        theirs[k].append((x, c))
    assert ours == theirs
    for i, (_, _, want) in enumerate(CASES):
        assert [x for x, _ in ours[i]] == want, CASES[i]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_every_lookup_has_its_column():
    """The column that a document looks up by is one of the query's own."""
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    for name, column in catalog.LOOKUPS.items():
        assert column in [r[0] for r in con.execute(f"describe {catalog.ORACLES[name]}").fetchall()], name
