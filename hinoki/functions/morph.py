"""Conjugation and form generation as SQL expressions.

Each function takes SQL texts (a form, its kind) and gives the SQL text of the
conjugated form; the texts mean the same to Spark and to other SQL engines, and run
as one CASE inside generated code.  A form that a function has no rule for is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as T


def quote(v) -> str:
    if v is None:
        return "cast(null as string)"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], names: str, alias: str = "t") -> str:
    """An inline table; every engine with VALUES reads it."""
    return "(values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") as {alias}({names})"


def inline(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small rule table as a DataFrame (a local relation: its size is fixed by this package)."""
    return spark.sql(f"select * from {values(rows, names)}")


def cut(f: str, n: int) -> str:
    return f"substring({f}, 1, length({f}) - {n})"


def last(f: str) -> str:
    return f"right({f}, 1)"


def godan(f: str, column: int) -> str:
    cases = " ".join(f"when '{r[0]}' then '{r[column]}'" for r in T.GODAN)
    return f"concat({cut(f, 1)}, case {last(f)} {cases} end)"


def masu_stem(f: str, k: str) -> str:
    """Continuative form; the irregular verbs also at the end of compounds."""
    odd = " ".join(f"when {f} like '%{a}' then concat({cut(f, len(a))}, '{b}')" for a, b in T.IRREGULAR)
    return (
        f"(case {odd} when {k} = 'ichidan' or {k} = 'copula' then {cut(f, 1)} when {k} = 'kahen' then '来' "
        f"when {k} = 'sahen' then case when {f} like '%する' then concat({cut(f, 2)}, 'し') else {f} end when {k} = 'godan' then {godan(f, 1)} end)"
    )


def a_stem(f: str, k: str) -> str:
    return (
        f"(case when {k} = 'ichidan' then {cut(f, 1)} when {k} = 'kahen' then '来' "
        f"when {k} = 'sahen' then case when {f} like '%する' then concat({cut(f, 2)}, 'さ') else {f} end when {k} = 'godan' then {godan(f, 2)} end)"
    )


def e_stem(f: str, k: str) -> str:
    return f"(case when {k} = 'godan' then {godan(f, 3)} end)"


def te_form(f: str, k: str) -> str:
    return (
        f"(case when {f} = '行く' then '行って' when {k} = 'ichidan' then concat({cut(f, 1)}, 'て') when {k} = 'kahen' then '来て' "
        f"when {k} = 'sahen' then case when {f} like '%する' then concat({cut(f, 2)}, 'して') else concat({f}, 'て') end when {k} = 'godan' then {godan(f, 4)} end)"
    )


def polite(f: str, k: str) -> str:
    return f"(case when {k} = 'copula' then concat({cut(f, 1)}, 'です') else concat({masu_stem(f, k)}, 'ます') end)"


def negative_polite(f: str, k: str) -> str:
    return f"concat({masu_stem(f, k)}, 'ません')"


def potential(f: str, k: str) -> str:
    return (
        f"(case when {k} = 'godan' then concat({e_stem(f, k)}, 'る') when {k} = 'ichidan' then concat({cut(f, 1)}, 'られる') when {k} = 'kahen' then '来られる' "
        f"when {k} = 'sahen' then case when {f} like '%する' then concat({cut(f, 2)}, 'できる') else {f} end end)"
    )


def past_plain(f: str, k: str) -> str:
    te = te_form(f, k)
    return f"(case when {te} like '%て' then concat({cut(te, 1)}, 'た') else concat({cut(te, 1)}, 'だ') end)"


def ogo_stem(f: str, k: str) -> str:
    """What stands between the prefix and its ending."""
    return f"(case when {k} = 'sahen' then {cut(f, 2)} else {masu_stem(f, k)} end)"


def rareru(f: str, k: str) -> str:
    return (
        f"(case when {k} = 'godan' then concat({a_stem(f, k)}, 'れる') when {k} = 'ichidan' then concat({cut(f, 1)}, 'られる') "
        f"when {k} = 'sahen' then concat({cut(f, 2)}, 'される') else '来られる' end)"
    )


def kind_of(f: str) -> str:
    """Kind of a generated form by its ending."""
    odd = " or ".join(f"{f} like '%{a}'" for a, _ in T.IRREGULAR)
    return (
        f"(case when {f} like '%だ' then 'copula' when {f} like '%いたす' then 'godan' when {f} like '%する' then 'sahen' when {f} like '%来る' then 'kahen' "
        f"when {odd} then 'godan' when {f} like '%れる' then 'ichidan' when {f} like '%上げる' then 'ichidan' when {f} like '%いただく' then 'godan' "
        f"when {f} like '%なる' then 'godan' when {f} like '%できる' then 'ichidan' when {last(f)} in ('う','く','ぐ','す','つ','ぬ','ぶ','む','る') then 'godan' else 'ichidan' end)"
    )


#: General forms of a verb row (plain, kind, ogo, target, naru): (order, class, origin, SQL form, SQL condition)
_O = ogo_stem("plain", "kind")
SONKEIGO = [
    (1, "sonkeigo_ogo_ni_naru", f"concat(ogo, {_O}, 'になる')", "ogo <> '' and naru"),
    (2, "sonkeigo_rareru", rareru("plain", "kind"), "true"),
    (3, "sonkeigo_nasaru", f"concat({cut('plain', 2)}, 'なさる')", "kind = 'sahen'"),
    (4, "sonkeigo_nasaru", f"concat('ご', {cut('plain', 2)}, 'なさる')", "kind = 'sahen' and ogo = 'ご'"),
    (5, "sonkeigo_ogo_da", f"concat(ogo, {_O}, 'だ')", "ogo <> '' and naru"),
    (6, "sonkeigo_kudasaru", f"concat(ogo, {_O}, 'くださる')", "ogo <> '' and naru"),
]
KENJOUGO1 = [
    (1, "kenjougo1_ogo_suru", f"concat(ogo, {_O}, 'する')", "ogo <> '' and target"),
    (2, "kenjougo1_ogo_moushiageru", f"concat(ogo, {_O}, '申し上げる')", "ogo <> '' and target"),
    (3, "kenjougo1_ogo_itadaku", f"concat(ogo, {_O}, 'いただく')", "ogo <> '' and target"),
]
KENJOUGO2 = [
    (1, "kenjougo2_itasu", f"concat({cut('plain', 2)}, 'いたす')", "kind = 'sahen'"),
    (2, "kenjougo1and2_ogo_itasu", f"concat(ogo, {cut('plain', 2)}, 'いたす')", "kind = 'sahen' and ogo <> '' and target"),
]


def verbs_sql() -> str:
    return values(T.VERBS, "plain, kind, ogo, target, naru", "v")


def forms_sql(rules: list[tuple]) -> str:
    """(plain, nth, origin, form) of every verb that the rules apply to."""
    return " union all ".join(f"select plain, {n} as nth, '{o}' as origin, {f} as form from {verbs_sql()} where {c}" for n, o, f, c in rules)


def register(spark: SparkSession) -> None:
    """SQL functions keigo_<name>(form, kind) for use in spark.sql."""
    for fn in (masu_stem, a_stem, te_form, polite, negative_polite, potential, past_plain, rareru, ogo_stem):
        spark.sql(f"create or replace temporary function keigo_{fn.__name__}(f string, k string) returns string return {fn('f', 'k')}")
    spark.sql(f"create or replace temporary function keigo_kind(f string) returns string return {kind_of('f')}")


def col(fn, form: str, kind: str) -> Column:
    return F.expr(fn(form, kind))
