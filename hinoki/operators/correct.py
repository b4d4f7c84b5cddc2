"""Replacement forms for findings, all of them rule-generated.

What may replace what is a table of fixed size, made from the verb and form tables:
(family, surface, variant) -> replacements in order.  A finding looks up the longest
stretch of its text that a family knows; the variant follows from its type and from who
acts towards whom.  So a correction is one lookup and one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import morph as M
from ..functions import tables as T
from . import generate as G
from . import roles as R
from . import spans as S

MOST = 4
OWN, OTHER, NONE = ("kenjougo_1", "kenjougo_1_and_2", "kenjougo_2"), ("sonkeigo",), ("kenjougo_2", "teineigo")
REASONS = [
    ("sonkeigo", "a respectful form for the one who acts"), ("kenjougo_1", "a humble form that raises the one acted towards"), ("kenjougo_1_and_2", "a humble form that raises the one acted towards"),
    ("kenjougo_2", "a courteous form for an act of one's own side"), ("teineigo", "a polite form"), ("plain", "the form without the added part"),
]


def lemmas_sql() -> str:
    """(seq, base, lemma, kind, cls, origin): all dictionary forms that the tables give."""
    special = [(i, b, f, k, c) for i, (b, f, c, k) in enumerate(T.SPECIAL_FORMS)]
    parts = [f"select seq, base, lemma, kind, cls, 'special' as origin from {M.values(special, 'seq, base, lemma, kind, cls', 's')}"]
    verbs = M.values([(i, *v) for i, v in enumerate(T.VERBS)], "i, plain, kind, ogo, target, naru", "v")
    parts.append(f"select 1000 + i * 100 as seq, plain as base, plain as lemma, kind, 'plain' as cls, 'plain' as origin from {verbs}")
    rules = [(n, "sonkeigo", f, c) for n, _, f, c in M.SONKEIGO] + [(20 + n, "kenjougo_1", f, c) for n, _, f, c in M.KENJOUGO1]
    rules += [(40 + n, "kenjougo_2" if n == 1 else "kenjougo_1_and_2", f, c) for n, _, f, c in M.KENJOUGO2]
    for n, cls, f, c in rules:
        inner = f"select 1000 + i * 100 + {n} as seq, plain as base, {f} as lemma from {verbs} where {c}"
        parts.append(f"select seq, base, lemma, {M.kind_of('lemma')} as kind, '{cls}' as cls, 'general' as origin from ({inner}) as g{n}")
    return " union all ".join(parts)


def inflected_sql(lemmas: str) -> str:
    """The columns of lemmas with infl and surface."""
    stem, te = M.masu_stem("lemma", "kind"), M.te_form("lemma", "kind")
    verb, copula = "kind <> 'copula'", "kind = 'copula'"
    rows = [("plain", "lemma", "true"), ("te", te, verb), ("plain_past", M.past_plain("lemma", "kind"), verb), ("kudasai", f"concat({M.cut('lemma', 4)}, 'ください')", "lemma like '%くださる'")]
    rows += [(n, f"concat({stem}, '{e}')", verb) for n, e in (("polite", "ます"), ("polite_past", "ました"), ("polite_neg", "ません"), ("polite_neg_past", "ませんでした"))]
    rows += [(n, f"concat({M.cut('lemma', 1)}, '{e}')", copula) for n, e in (("polite", "です"), ("polite_past", "でした"), ("plain_past", "だった"))]
    return "select * from (" + " union all ".join(f"select *, '{n}' as infl, {x} as surface from {lemmas} where {c}" for n, x, c in rows) + ") as i where surface is not null"


def class_forms_sql(lemmas: str) -> str:
    """(seq, base, lemma, kind, cls): forms of each honorific class of a base verb."""
    known = {v[0] for v in T.VERBS}
    rest = M.values([(9000 + i, b, b, k) for i, (b, k) in enumerate(T.BASE_KINDS) if b not in known], "seq, base, lemma, kind", "r")
    return (
        f"select seq, base, lemma, kind, cls from {lemmas} where cls <> 'plain' union all select seq, base, lemma, kind, 'teineigo' as cls from {lemmas} where cls = 'plain' "
        f"union all select seq, base, lemma, kind, 'teineigo' as cls from {rest}"
    )


def doubled_sql(lemmas: str) -> str:
    """Honorific forms with one more (ra)reru; inner_lemma is the form without it."""
    fixed = ", ".join(M.quote(x) for x in [*(e[0] for e in T.ESTABLISHED), *T.SPLIT_SURFACES])
    rows = f"select seq, base, lemma as inner_lemma, kind as inner_kind, cls, {M.rareru('lemma', 'kind')} as lemma, 'ichidan' as kind from {lemmas} where cls <> 'plain' and kind <> 'copula'"
    return f"select * from ({rows}) as d where lemma not in ({fixed})"


def prefixed_sql() -> str:
    """(family, seq, base, lemma, kind, cls): o/go + stem + sareru or dekiru of each verb."""
    verbs = M.values([(i, *v) for i, v in enumerate(T.VERBS)], "i, plain, ikind, ogo, target, naru", "v")
    part = lambda family, end: f"select '{family}' as family, i as seq, plain as base, concat(ogo, {M.ogo_stem('plain', 'ikind')}, '{end}') as lemma, 'ichidan' as kind, 'kenjougo_1' as cls from {verbs} where ogo <> ''"
    return part("go_sareru", "される") + " union all " + part("ogo_dekiru", "できる")


def index_sql(inflected: str, doubled: str, prefixed: str) -> str:
    """(family, surface, seq, base, lemma, kind, cls, infl): what can be found in a text."""
    fixed = ", ".join(M.quote(x) for x in [*(e[0] for e in T.ESTABLISHED), *T.SPLIT_SURFACES])
    return (
        f"select 'surface' as family, surface, seq, base, lemma, kind, cls, infl from {inflected} "
        f"union all select 'double', surface, seq, base, inner_lemma, inner_kind, cls, infl from ({inflected_sql(doubled)}) as x where surface not in ({fixed}) and surface not in (select surface from {inflected}) "
        f"union all select family, surface, seq, base, lemma, kind, cls, infl from ({inflected_sql(prefixed)}) as y"
    )


def linked_sql(inflected: str) -> str:
    """(te, aux, i, nth, lemma, kind, want): humble te forms with an auxiliary, and what the
    other side's act is called."""
    aux = [(i, s, a, infl) for i, (s, a, infl) in enumerate(T.LINK_AUXILIARIES)]
    known = {v[0] for v in T.VERBS}
    stems = {v[0]: (v[0], v[1], v[2]) for v in T.VERBS if v[2] and v[4]} | {b: (b, k, "お") for b, k in T.BASE_KINDS if b not in known}
    order = M.values([(i, *stems[b]) for i, b in enumerate(sorted(stems))], "nth, stem_base, stem_kind, prefix", "b")
    return (
        f"select te.surface as te, a.aux, a.i, b.nth, concat(b.prefix, {M.ogo_stem('b.stem_base', 'b.stem_kind')}, a.lemma) as lemma, 'godan' as kind, a.want "
        f"from (select distinct base, surface from {inflected} where infl = 'te' and cls = 'kenjougo_1' and origin = 'special') as te join {order} on b.stem_base = te.base cross join {M.values(aux, 'i, aux, lemma, want', 'a')}"
    )


def able_sql() -> str:
    """(base, nth, lemma, kind, fcls): what the other side's ability is called."""
    verbs = M.values(T.VERBS, "plain, vkind, ogo, target, naru", "v")
    stem = f"concat(ogo, {M.ogo_stem('plain', 'vkind')})"
    rows = [(0, "になれる", "sonkeigo", "naru"), (1, "いただける", "kenjougo_1", "true"), (2, "はできる", "plain", "vkind = 'sahen'")]
    parts = [f"select plain as base, {n} as nth, concat({stem}, '{end}') as lemma, 'ichidan' as kind, '{c}' as fcls from {verbs} where ogo <> '' and {w}" for n, end, c, w in rows]
    return " union all ".join(parts)


def fixes_sql(index: str, forms: str, inflected: str, linked: str, able: str) -> str:
    """(family, surface, variant, rank, text, cls).  forms: inflected class forms."""
    rule = lambda family, variant, rank, cond, text="f.surface", cls="f.cls": (
        f"select x.family, x.surface, '{variant}' as variant, x.seq * 100000 + {rank} + f.seq as rank, {text} as text, {cls} as cls from {index} as x join {forms} as f on f.base = x.base and f.infl = x.infl where x.family = '{family}' and {cond}"
    )
    inner = lambda variant: f"select x.family, x.surface, '{variant}' as variant, x.seq * 100000 as rank, i.surface as text, x.cls from {index} as x join {inflected} as i on i.seq = x.seq and i.lemma = x.lemma and i.infl = x.infl where x.family = 'double'"
    listed = lambda classes: "(case f.cls " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(classes)) + " end * 10000)"
    within = lambda classes: "f.cls in (" + ", ".join(f"'{c}'" for c in classes) + ")"
    parts = [inner("double_keigo"), rule("double", "double_keigo", 1, "f.cls = x.cls and f.lemma <> x.lemma"), inner("self_sonkeigo")]
    for variant, classes in (("own", OWN), ("other", OTHER), ("alone", NONE)):
        parts.append(rule("surface", variant, listed(classes), f"{within(classes)} and f.cls <> x.cls"))
    parts.append(rule("surface", "unknown", 0, "x.cls in ('kenjougo_1', 'kenjougo_1_and_2') and f.cls = 'sonkeigo'"))
    parts.append(rule("surface", "unknown", listed(OWN), f"x.cls = 'sonkeigo' and {within(OWN)}"))
    uchi = ("kenjougo_2", "kenjougo_1_and_2", "teineigo")
    for family in ("surface", "double"):
        parts.append(rule(family, "uchi", listed(uchi), within(uchi)))
        # te + oru: the way a report of one's own side is put
        te = f"(select seq, base, cls, surface as te from {inflected} where infl = 'te' and cls = 'kenjougo_2')"
        parts.append(
            f"select x.family, x.surface, 'uchi' as variant, x.seq * 100000 + f.seq + 0.5 as rank, concat(f.te, case x.infl when 'polite' then 'おります' else 'おりました' end) as text, 'kenjougo_2' as cls "
            f"from {index} as x join {te} as f on f.base = x.base where x.family = '{family}' and x.infl in ('polite', 'polite_past')"
        )
    mine = ("kenjougo_1", "kenjougo_2", "teineigo")
    parts.append(rule("surface", "self_sonkeigo", listed(mine), f"x.cls = 'sonkeigo' and {within(mine)}"))
    shape = "(case when f.lemma like '%れる' then 0 when f.lemma like '%なさる' and f.lemma not like 'お%' and f.lemma not like 'ご%' then 10000 when f.lemma like '%になる' then 20000 else 30000 end)"
    parts.append(rule("go_sareru", "go_sareru", shape, "f.cls = 'sonkeigo' and f.origin = 'general' and f.lemma not like '%だ' and f.lemma not like '%くださる'"))
    parts.append(f"select x.family, x.surface, 'ogo_dekiru' as variant, x.seq * 100000 + f.nth as rank, f.surface as text, f.fcls as cls from {index} as x join ({inflected_sql(able)}) as f on f.base = x.base and f.infl = x.infl where x.family = 'ogo_dekiru'")
    for variant, pairs in (("polite_style", (("plain", "polite"), ("plain_past", "polite_past"))), ("plain_style", (("polite", "plain"), ("polite_past", "plain_past")))):
        for a, b in pairs:
            parts.append(f"select x.family, x.surface, '{variant}' as variant, x.seq * 100000 as rank, i.surface as text, x.cls from {index} as x join {inflected} as i on i.seq = x.seq and i.lemma = x.lemma where x.family = 'surface' and x.infl = '{a}' and i.infl = '{b}'")
    tails = M.values([(i, e, n) for i, (e, n) in enumerate(T.ITADAKU_TAILS)], "i, tail, want", "w")
    heads = M.values([(n, *h) for n, h in enumerate(heads_of_verbs())], "n, stem, hbase", "h")
    sasete = "(case i.cls when 'kenjougo_1' then 1 when 'plain' then 2 else 0 end)"
    parts.append(
        f"select 'sasete' as family, concat(h.stem, 'せていただ', w.tail) as surface, 'sasete_itadaku_overuse' as variant, h.n * 1000000 + {sasete} * 10000 + i.seq as rank, i.surface as text, case i.cls when 'plain' then 'teineigo' else i.cls end as cls "
        f"from {heads} cross join {tails} join {inflected} as i on i.base = h.hbase and i.infl = w.want where i.origin <> 'special' and i.cls in ('kenjougo_1', 'kenjougo_2', 'kenjougo_1_and_2', 'plain')"
    )
    parts.append(f"select 'link' as family, concat(te, aux) as surface, 'bad_keigo_link' as variant, i * 100 + nth as rank, surface as text, case when surface like '%くだ%' then 'sonkeigo' else 'kenjougo_1' end as cls from ({inflected_sql(linked)}) as q where infl = want")
    return " union all ".join(f"select family, surface, variant, cast(rank as double) as rank, text, cls from ({p}) as p{i}" for i, p in enumerate(parts))


def fixes(spark: SparkSession) -> DataFrame:
    """The table of replacements; its size is fixed by the rule tables, so it is held as a
    local relation, cut at its stages to keep the generated expressions small."""
    def hold(name: str, sql: str) -> None:
        spark.createDataFrame(spark.sql(sql).toPandas()).createOrReplaceTempView(name)

    if not spark.catalog.tableExists("hinoki_fixes"):
        hold("hinoki_c_lemmas", lemmas_sql())
        hold("hinoki_c_infl", inflected_sql("hinoki_c_lemmas"))
        hold("hinoki_c_class", class_forms_sql("hinoki_c_lemmas"))
        hold("hinoki_c_forms", f"select f.*, coalesce(l.origin, 'general') as origin from ({inflected_sql('hinoki_c_class')}) as f left join hinoki_c_lemmas as l on l.seq = f.seq and l.lemma = f.lemma")
        hold("hinoki_c_doubled", doubled_sql("hinoki_c_lemmas"))
        hold("hinoki_c_prefixed", prefixed_sql())
        hold("hinoki_c_index", index_sql("hinoki_c_infl", "hinoki_c_doubled", "hinoki_c_prefixed"))
        hold("hinoki_c_linked", linked_sql("hinoki_c_infl"))
        hold("hinoki_c_able", able_sql())
        hold("hinoki_fixes", fixes_sql("hinoki_c_index", "hinoki_c_forms", "hinoki_c_infl", "hinoki_c_linked", "hinoki_c_able"))
    return spark.table("hinoki_fixes")


def first_role(findings: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """findings with actor, target and base of the first role that overlaps them; null without."""
    r = roles.select(key, F.col("start").alias("start2"), F.col("end").alias("end2"), "actor", "target", "base")
    who = F.when(F.col("start2").isNotNull(), F.struct(F.col("start2").alias("n"), "actor", "target", "base"))
    met = S.overlap_join(findings, r, key, "left").groupBy(*findings.columns).agg(F.min(who).alias("_w"))
    return met.select(*findings.columns, "_w.actor", "_w.target", "_w.base")


def majority_is_polite(text: Column) -> Column:
    """Whether a text's sentences end politely at least as often as plainly."""
    ends = F.transform(F.split(F.regexp_replace(text, "\n", "。"), "。"), lambda s: F.regexp_replace(F.trim(s), "[！？!?、，,]+$", ""))
    of = lambda words: F.size(F.filter(ends, lambda s: s.rlike("(?:" + "|".join(words) + ")$")))
    plain = F.size(F.filter(ends, lambda s: s.rlike("(?:" + "|".join(T.MAJORITY_PLAIN) + ")$") & ~s.rlike("(?:" + "|".join(T.MAJORITY_POLITE) + ")$")))
    return of(T.MAJORITY_POLITE) >= plain


def variant_of() -> Column:
    """Which rules a finding takes, by its type, actor and target."""
    own, other = R.is_in(F.col("actor"), 1), R.is_in(F.col("actor"), 2)
    direction = F.when(other, "other").when(own & R.is_in(F.col("target"), 2), "own").when(own, "alone").otherwise("unknown")
    kind = F.col("error_type")
    return (
        F.when(kind == "direction_swap", direction).when(kind.isin("uchi_sonkeigo", "rank_inversion"), "uchi")
        .when(kind == "style_mixing", F.when(F.col("polite"), "polite_style").otherwise("plain_style")).otherwise(kind)
    )


def heads_of_verbs() -> list[tuple[str, str]]:
    """(stem before sete itada-, base) of the table's verbs."""
    out, ends = [], {r[0]: r[2] for r in T.GODAN}
    for v in T.VERBS:
        if v[1] == "godan":
            out.append((v[0][:-1] + ends[v[0][-1]], v[0]))
        if v[1] == "ichidan":
            out.append((v[0][:-1] + "さ", v[0]))
    return out


FORM = "array<struct<text:string,cls:string>>"


def form(text: Column, cls: str) -> Column:
    return F.struct(text.alias("text"), F.lit(cls).alias("cls"))


def plain_statement(text: Column) -> Column:
    """Of a Sino-Japanese noun with sasete itadaku its two regular forms; else none."""
    row = "".join(r[2] for r in T.GODAN if r[2] != "さ")
    noun, rest = F.regexp_extract(text, "^(.+?)させていただ", 1), F.regexp_extract(text, "させていただ(.*)$", 1)
    ends = [("きませんでした", "しませんでした"), ("きました", "しました"), ("きません", "しません"), ("きます", "します"), ("いた", "した"), ("く", "する"), ("", "します")]
    out = F.lit(None).cast(FORM)
    for tail, verb in reversed(ends):
        more = F.substr(rest, F.lit(len(tail) + 1))
        humble = {"した": "いたした", "する": "いたす"}.get(verb, "いた" + verb)
        out = F.when(rest.startswith(tail), F.array(form(F.concat(noun, F.lit(humble), more), "kenjougo_2"), form(F.concat(noun, F.lit(verb), more), "teineigo"))).otherwise(out)
    return F.when((noun != "") & ~noun.rlike(f"[{row}]$"), out)


def without_sa(text: Column) -> Column:
    """Inserted syllables taken out: of the table's verbs, else behind any a-row kana."""
    ends = {r[0]: r[2] for r in T.GODAN}
    stems = [v[0][:-1] + ends[v[0][-1]] for v in T.VERBS if v[1] == "godan"]
    row = "".join(sorted({x[-1] for x in stems} - {"さ"}))
    known = F.array_compact(F.array(*(F.when(text.contains(x + "させ"), form(F.replace(text, F.lit(x + "させ"), F.lit(x + "せ")), "plain")) for x in stems)))
    return F.when(F.size(known) > 0, known).otherwise(F.array(form(F.regexp_replace(text, f"^(.*?[{row}])させ", "$1せ"), "plain")))


def undone(text: Column) -> Column:
    """A doubled ending made single by a table."""
    out = F.lit(None).cast("string")
    for bad, good in reversed(T.DOUBLE_UNDO):
        out = F.when(text.contains(bad), F.regexp_replace(text, f"^(.*?){bad}", f"$1{good}")).otherwise(out)
    return F.when(out.isNotNull(), F.array(form(out, "sonkeigo")))


def made_polite(text: Column) -> Column:
    """A plain sentence end made polite by a table."""
    bare = F.regexp_replace(text, "[。．]+$", "")
    point, out = F.substr(text, F.length(bare) + 1), F.lit(None).cast("string")
    for plain, polite in reversed(T.STYLE_ENDS):
        out = F.when(bare.endswith(plain), F.concat(F.substr(bare, F.lit(1), F.length(bare) - len(plain)), F.lit(polite), point)).otherwise(out)
    return F.when(out.isNotNull(), F.array(form(out, "teineigo")))


def suggested(spark: SparkSession, findings: DataFrame, roles: DataFrame, texts: DataFrame, key: str = "doc_id", most: int | None = MOST) -> DataFrame:
    """The reportable findings (key, start, end, surface, error_type, actor, target, base)
    with suggestions array<struct<text, cls>>: distinct forms, best first, at most most
    (all with None), none where no rule knows the finding.  texts: key, text.

    A finding's stretches meet the table of replacements in one broadcast join, and all of
    its hits in one row; what no table can hold is an expression of the row."""
    f = findings.where("verdict = 'norm_divergence'").select(key, "start", "end", "surface", "error_type")
    f = first_role(f, roles, key).join(texts.select(key, majority_is_polite(F.col("text")).alias("polite")), key)
    f = f.withColumn("variant", variant_of())
    own = [c for c in f.columns]
    one = F.struct("rank", "text", "cls")
    table = fixes(spark).groupBy("family", F.col("surface").alias("found"), F.col("variant").alias("v")).agg(F.sort_array(F.collect_list(one)).alias("fix"))
    table = table.groupBy("family", "found").agg(F.map_from_entries(F.collect_list(F.struct("v", "fix"))).alias("by"))
    starts = f.withColumn("at", F.explode_outer(F.when(F.length("surface") > 0, F.sequence(F.lit(0), F.length("surface") - 1))))
    cand = starts.withColumn("_n", F.explode_outer(F.sequence(F.lit(1), F.length("surface") - F.col("at")))).withColumn("found", F.substr("surface", F.col("at") + 1, F.col("_n")))
    met = cand.join(F.broadcast(table), "found", "left")
    hit = F.when(F.col("family").isNotNull(), F.struct((-F.col("_n")).alias("o"), "at", "family", F.try_element_at("by", F.col("variant")).alias("fix")))
    rows = met.groupBy(*own).agg(F.array_sort(F.collect_list(hit)).alias("_h"))
    # Of each family the longest stretch, the first of equally long ones.
    known = lambda family: F.try_element_at(F.filter("_h", lambda h: h["family"] == family), F.lit(1))
    kind = F.col("error_type")
    surface, double = known("surface"), known("double")
    chosen = (
        F.when(kind.isin("uchi_sonkeigo", "rank_inversion"), F.array(F.coalesce(surface, double))).when(kind == "self_sonkeigo", F.array(double, surface))
        .when(kind.isin("direction_swap", "style_mixing"), F.array(surface)).when(kind == "double_keigo", F.array(double)).when(kind == "bad_keigo_link", F.array(known("link")))
        .when(kind == "sasete_itadaku_overuse", F.array(known("sasete"))).otherwise(F.array(known("go_sareru"), known("ogo_dekiru")))
    )
    text = F.col("surface")
    put = lambda h: F.transform(h["fix"], lambda x: F.struct(F.concat(F.substr(text, F.lit(1), h["at"]), x["text"], F.substr(text, h["at"] - h["o"] + 1)).alias("text"), x["cls"].alias("cls")))
    ruled = F.flatten(F.transform(F.filter(F.array_compact(chosen), lambda h: h["fix"].isNotNull()), put))
    # A prefix on a noun of one's own goes; a predicate is no noun.
    noun = (kind == "self_sonkeigo") & text.rlike("^[おご御].") & ~text.rlike("になり|になる|なさ|れます|られ") & surface.isNull()
    none = F.array().cast(FORM)
    rest = F.coalesce(F.when(kind == "sa_insertion", without_sa(text)).when(kind == "sasete_itadaku_overuse", plain_statement(text)).when(kind == "double_keigo", undone(text)).when((kind == "style_mixing") & F.col("polite"), made_polite(text)), none)
    rows = rows.withColumn("_r", F.concat(ruled, F.when(noun, F.array(form(F.substr(text, F.lit(2)), "plain"))).otherwise(none)))
    rows = rows.withColumn("_r", F.when(F.size("_r") > 0, F.col("_r")).otherwise(rest))
    names = F.array_distinct(F.filter(F.transform("_r", lambda x: x["text"]), lambda x: (x != "") & (x != text)))
    names = names if most is None else F.slice(names, 1, most)
    first = F.transform(names, lambda n: F.element_at(F.filter("_r", lambda x: x["text"] == n), 1))
    return rows.withColumn("suggestions", first).select(key, "start", "end", "surface", "error_type", "actor", "target", "base", "suggestions")


def suggest(spark: SparkSession, findings: DataFrame, roles: DataFrame, texts: DataFrame, key: str = "doc_id", most: int | None = MOST) -> DataFrame:
    """key, start, end_, error_type, nth, suggestion, cls, reason: suggested(), a row each."""
    rows = suggested(spark, findings, roles, texts, key, most).select(key, "start", F.col("end").alias("end_"), "error_type", F.posexplode("suggestions").alias("nth", "s"))
    reasons = F.broadcast(M.inline(spark, REASONS, "cls, reason"))
    out = rows.select(key, "start", "end_", "error_type", (F.col("nth") + 1).alias("nth"), F.col("s.text").alias("suggestion"), F.col("s.cls").alias("cls"))
    return out.join(reasons, "cls", "left").select(key, "start", "end_", "error_type", "nth", "suggestion", "cls", "reason")


def validity(gold: DataFrame, mended: DataFrame, key: str = "doc_id") -> DataFrame:
    """error_type, n, valid over gold (key, start, end, type, text, source_text, gold) that a
    finding of mended (see suggested) overlaps: valid where a suggestion is the gold form,
    restores the source text, or leaves the gold form in the text."""
    m = mended.select(key, F.col("start").alias("start2"), F.col("end").alias("end2"), "suggestions")
    met = S.overlap_join(gold, m, key)
    fixed = lambda x: F.concat(F.substr(F.col("text"), F.lit(1), F.col("start2")), x["text"], F.substr(F.col("text"), F.col("end2") + 1))
    good = F.exists("suggestions", lambda x: (x["text"] == F.col("gold")) | (fixed(x) == F.col("source_text")) | fixed(x).contains(F.col("gold")))
    per = met.groupBy(key, "start", "end", "type").agg(F.coalesce(F.max(good), F.lit(False)).alias("valid"))
    return per.groupBy(F.col("type").alias("error_type")).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


def cite(findings: DataFrame, key: str = "doc_id", roles: DataFrame | None = None) -> DataFrame:
    """findings with the citation that their type, audience, actor and class call for in
    cited; without roles or audience the type's own one.  Needs audience for insiders."""
    f = findings if roles is None else first_role(findings, roles.withColumn("base", F.col("cls")), key).withColumnRenamed("base", "cls")
    own = dict((t[0], t[3]) for t in T.ERROR_TYPES)
    out = F.create_map(*(F.lit(x) for p in own.items() for x in p))[F.col("error_type")]
    if "audience" in findings.columns:
        out = F.when(F.col("error_type") == "uchi_sonkeigo", F.when(F.col("audience") == "external", "uchi_soto.q25").otherwise("uchi_soto.q26")).otherwise(out)
    if roles is not None:
        turned = F.when(R.is_in(F.col("actor"), 1), "principle.self_not_raised").when(F.col("cls") == "kenjougo_2", "direction.q13").otherwise("direction.q11")
        out = F.when((F.col("error_type") == "direction_swap") & F.col("actor").isNotNull(), turned).otherwise(out)
    return f.withColumn("cited", F.coalesce(out, F.lit("principle.self_expression")))


def explain(findings: DataFrame, language: str = "en") -> DataFrame:
    """findings with name, section, page and a neutral message in English or Japanese (ja)."""
    spark = findings.sparkSession
    cited = findings.join(F.broadcast(M.inline(spark, T.CITATIONS, "citation_key, section, page")), "citation_key", "left")
    names = T.NAMES_JA if language == "ja" else [(t[0], t[4]) for t in T.ERROR_TYPES]
    named = cited.join(F.broadcast(M.inline(spark, names, "error_type, name")), "error_type", "left")
    lit = F.lit
    if language == "ja":
        text = F.when(F.col("verdict") == "variation", F.concat(lit("「"), "surface", lit("」は人によって受け止め方が分かれています"))).otherwise(F.concat(lit("「"), "surface", lit("」："), "name"))
        source = F.concat(lit("（"), "section", lit("、"), "page", lit("）"))
    else:
        text = F.when(F.col("verdict") == "variation", F.concat(lit("Usage is divided on this form: "), "surface")).otherwise(F.concat("name", lit(": "), "surface"))
        source = F.concat(lit(" ("), "section", lit(", "), "page", lit(")"))
    return named.withColumn("message", F.concat(text, F.when(F.col("section").isNotNull(), source).otherwise("")))


def teach(spark: SparkSession, language: str = "en") -> DataFrame:
    """(error_type, name, cls, definition): the classes that an error type involves."""
    involved = [
        ("direction_swap", "sonkeigo kenjougo_1"), ("uchi_sonkeigo", "sonkeigo kenjougo_2"), ("self_sonkeigo", "sonkeigo kenjougo_1"), ("rank_inversion", "sonkeigo kenjougo_2"), ("double_keigo", "sonkeigo"),
        ("go_sareru", "sonkeigo"), ("ogo_dekiru", "kenjougo_1 sonkeigo"), ("bad_keigo_link", "kenjougo_1 sonkeigo"), ("sasete_itadaku_overuse", "kenjougo_1 kenjougo_2"), ("style_mixing", "teineigo plain"), ("sa_insertion", "plain"),
    ]
    names = dict(T.NAMES_JA if language == "ja" else [(t[0], t[4]) for t in T.ERROR_TYPES])
    what = {c: ja if language == "ja" else en for c, en, ja in T.DEFINITIONS}
    return M.inline(spark, [(t, names[t], c, what[c]) for t, cs in involved for c in cs.split(" ")], "error_type, name, cls, definition")


def admissible(spark: SparkSession) -> DataFrame:
    """(base, side, cls, nth, text): polite forms of each base verb for either side."""
    return spark.sql(G.forms_sql([("self", "self", "addressee"), ("other", "addressee", "self")], (1,), G.candidates_view(spark))).select("base", F.col("label").alias("side"), "cls", "nth", "text")
