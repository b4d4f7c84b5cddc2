"""The predicate lexicon, built in SQL: verbs and forms by rules, crossed with
inflections, one entry a surface (highest priority, then first)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import morph as M
from . import tables as T


def heads_sql() -> str:
    """(seq, form, kind, class, origin, base, hint, is_head): dictionary forms in order."""
    hint = "case " + " ".join(f"when form like '%{a}' then '{b}'" for a, b in T.GIVE_RECEIVE) + " else '' end"
    special = []
    seen: dict[str, int] = {}
    for i, (base, form, cls, kind) in enumerate(T.SPECIAL_FORMS):
        if form not in seen:
            seen[form] = i
            special.append((i, form, kind, cls, "special", base))
    fixed = special + [(100 + i, f, k, c, "established", b) for i, (f, b, k, c) in enumerate(T.ESTABLISHED)]
    parts = [f"select seq, form, kind, cls, origin, base, {hint} as hint, true as is_head from {M.values(fixed, 'seq, form, kind, cls, origin, base', 'f')}"]
    numbered = [(i, *v) for i, v in enumerate(T.VERBS)]
    verbs = M.values(numbered, "i, plain, kind, ogo, target, naru", "v")
    rules = [(n, "sonkeigo", f, c) for n, _, f, c in M.SONKEIGO]
    rules += [(10 + n, "kenjougo_1", f, c) for n, _, f, c in M.KENJOUGO1]
    rules += [(20 + n, "kenjougo_2" if n == 1 else "kenjougo_1_and_2", f, c) for n, _, f, c in M.KENJOUGO2]
    for n, cls, f, c in rules:
        inner = f"select 1000 + i * 100 + {n} as seq, {f} as form, '{cls}' as cls, plain as base from {verbs} where {c}"
        parts.append(f"select seq, form, {M.kind_of('form')} as kind, cls, 'general' as origin, base, {hint} as hint, true as is_head from ({inner}) as g{n}")
    parts.append(f"select 1000 + i * 100 + 50 as seq, form, kind, 'plain' as cls, 'plain' as origin, form as base, {hint} as hint, true as is_head from (select i, plain as form, kind from {verbs}) as p")
    o = M.ogo_stem("plain", "kind")
    parts.append(f"select 10000 + i as seq, concat(ogo, {o}, 'できる') as form, 'ichidan' as kind, 'kenjougo_1' as cls, 'ogo_potential' as origin, plain as base, '' as hint, false as is_head from {verbs} where ogo <> '' and target")
    tail = "case when kind in ('godan', 'sahen') then 'せていただく' else 'させていただく' end"
    parts.append(f"select 11000 + i * 2 as seq, concat({M.a_stem('plain', 'kind')}, {tail}) as form, 'godan' as kind, 'kenjougo_1' as cls, 'sasete' as origin, plain as base, 'self' as hint, false as is_head from {verbs}")
    parts.append(f"select 11001 + i * 2 as seq, concat(ogo, {o}, 'させていただく') as form, 'godan' as kind, 'kenjougo_1' as cls, 'sasete' as origin, plain as base, 'self' as hint, false as is_head from {verbs} where ogo <> '' and kind = 'sahen'")
    heads = " union all ".join(parts)
    return heads


def links_sql(heads: str) -> str:
    """heads and their te links; heads: a table of heads_sql with te."""
    aux = M.values([(i, *a) for i, a in enumerate(T.AUXILIARIES)], "j, aux, aux_kind, aux_cls, aux_hint", "a")
    links = (
        f"select 20000 + seq * 10 + j as seq, concat(te, aux) as form, aux_kind as kind, case when cls = 'plain' then aux_cls else cls end as cls, "
        f"'link' as origin, base, aux_hint as hint from {heads} cross join {aux} where is_head and te is not null"
    )
    return f"select seq, form, kind, cls, origin, base, hint from {heads} union all {links}"


def stems_sql(heads: str) -> str:
    """With the stems that inflections are put together from."""
    f, k = "form", "kind"
    a = M.a_stem(f, k)
    return f"select *, {M.masu_stem(f, k)} as s, {M.te_form(f, k)} as te, {a} as a, {M.potential(f, k)} as p from {heads}"


def inflections() -> list[tuple[int, str, str, str]]:
    """(order, SQL surface, SQL condition) over form, kind, cls."""
    verb, copula = "kind <> 'copula'", "kind = 'copula'"
    past = f"concat({M.cut('te', 1)}, case when te like '%て' then 'た' else 'だ' end)"
    out = [(0, "form", "true")]
    out += [(i, f"concat({M.cut('form', 1)}, '{e}')", copula) for i, e in enumerate(T.COPULA_ENDINGS, 1)]
    out += [(i, f"concat(s, '{e}')", verb) for i, e in enumerate(T.MASU_ENDINGS, 11)]
    out += [(20, "s", f"{verb} and cls <> 'plain'"), (21, "te", verb), (22, past, verb), (23, "concat(a, 'ない')", verb), (24, "p", verb)]
    out += [(i, f"concat({M.cut('p', 1)}, '{e}')", verb) for i, e in enumerate(T.POTENTIAL_ENDINGS, 25)]
    return out


def rank_sql() -> str:
    """Of the entries of a surface the largest counts; over origin and nth."""
    rank = "case origin " + " ".join(f"when '{o}' then {p}" for o, p in T.PRIORITY) + " end"
    return f"cast({rank} as bigint) * 100000000 - nth"


def lexicon_sql(stems: str) -> str:
    """One row a surface out of a table of stems_sql."""
    rows = " union all ".join(f"select {s} as surface, cast(seq as bigint) * 100 + {n} as nth, form, kind, cls, origin, base, hint from {stems} where {c}" for n, s, c in inflections())
    pick = ", ".join(f"max_by({c}, {rank_sql()}) as {c}" for c in ("form", "kind", "cls", "origin", "base", "hint"))
    return f"select surface, {pick} from ({rows}) as r where surface is not null and length(surface) >= 2 group by surface"


def lexicon(spark: SparkSession) -> DataFrame:
    """surface, form, kind, cls, origin, base, hint: about 65,000 rows, fixed by the
    rule tables whatever the input, so it is held as a local relation.  The stages are
    cut there, too, which keeps the generated expressions small."""
    if not spark.catalog.tableExists("hinoki_lexicon"):
        spark.createDataFrame(spark.sql(f"select *, {M.te_form('form', 'kind')} as te from ({heads_sql()}) as h").collect()).createOrReplaceTempView("hinoki_heads")
        spark.createDataFrame(spark.sql(links_sql("hinoki_heads")).collect()).createOrReplaceTempView("hinoki_links")
        spark.createDataFrame(spark.sql(stems_sql("hinoki_links")).collect()).createOrReplaceTempView("hinoki_stems")
        spark.createDataFrame(spark.sql(lexicon_sql("hinoki_stems")).toPandas()).createOrReplaceTempView("hinoki_lexicon")
    return spark.table("hinoki_lexicon")


def oracle_ctes() -> str:
    """The lexicon for another SQL engine: CTEs ending in lexicon."""
    return (
        f"heads as (select *, {M.te_form('form', 'kind')} as te from ({heads_sql()}) as h), links as ({links_sql('heads')}), "
        f"stems as ({stems_sql('links')}), lexicon as ({lexicon_sql('stems')})"
    )
