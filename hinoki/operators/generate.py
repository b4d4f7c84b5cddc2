"""Rule-generated forms, a sentence corpus and injected errors.

All of it is joins of rule tables; choices that would be random are made by the md5
of a key, so every engine and every run makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import morph as M
from ..functions import tables as T

# Standpoints of an act, (label, actor, target)
STANDPOINTS = [("self_to_reader", "self", "addressee"), ("group_to_reader", "self_group", "addressee"), ("reader", "addressee", "self"), ("third_party", "third_party", "addressee")]
#: Openings and closings of mails by audience, in our own words; and default contexts
OPENINGS = [("external", "いつもお世話になっております。山田です。"), ("internal", "お疲れ様です。山田です。"), ("public", "日頃よりありがとうございます。")]
CLOSING = "どうぞよろしくお願いいたします。"
CONTEXTS = [("external", "", "", "", "", ""), ("internal", "山田", "営業部", "佐藤", "さん", "開発部"), ("public", "山田", "弊社", "お客様", "", "")]  # fixed values
EXTRA_VERBS = [("詫びる", "ichidan", "お", True, True)]
#: Sentence frames: (function, side, before the predicate, after it); a request names no subject
FRAMES = [
    ("report", "self", "本日、", "。"), ("report", "other", "その後、", "。"), ("inquiry", "other", "恐れ入りますが、こちらを", "か。"),
    ("scheduling", "self", "来週の会議の件で", "。"), ("scheduling", "other", "来週の会議の件で", "。"), ("notice", "self", "このたび、", "。"),
    ("request", "other", "お手数ですが、", "ようお願い申し上げます。"), ("refusal", "self", "誠に恐縮ですが、今回は", "。"), ("apology", "self", "このたびの件につきまして、", "。"),
    ("thanks", "other", "いつも迅速に", "、ありがとうございます。"), ("greeting", "self", "今後とも、", "。"), ("giving", "self", "ご希望でしたら、", "。"),
    ("receiving", "other", "先日の件で", "。"),
]
SUBJECTS = [("self", "私が"), ("self_group", "弊社の田中が"), ("addressee", "佐藤様が"), ("addressee_group", "貴社の鈴木様が"), ("third_party", "先方の木村様が")]


def bases_sql() -> str:
    """(base, kind, ogo, target, naru, is_verb) of all base verbs."""
    verbs = [(*v, True) for v in [*T.VERBS, *EXTRA_VERBS]]
    known = {v[0] for v in verbs}
    kinds = dict(T.BASE_KINDS)
    rest = [(b, kinds.get(b), "", False, False, False) for b in dict.fromkeys(s[0] for s in T.SPECIAL_FORMS) if b not in known]
    return M.values(verbs + rest, "base, kind, ogo, target, naru, is_verb", "b")


def candidates_sql() -> str:
    """(base, side, for_other, seq, origin, form, kind, cls): for_other: only where the
    target is on the other side.  seq: order of mention, before ranking."""
    b = f"(select base as plain, * from {bases_sql()}) as b"
    out = []

    def add(side, for_other, seq, origin, form, cls, where, kind=None):
        out.append(f"select base, '{side}' as side, {str(for_other).lower()} as for_other, {seq} as seq, '{origin}' as origin, {form} as form, {kind or M.kind_of(form)} as kind, '{cls}' as cls from {b} where {where}")

    for n, origin, form, cond in M.KENJOUGO1[:2]:
        add("self", True, 10 + n, origin, form, "kenjougo_1", f"is_verb and {cond}")
    o = M.ogo_stem("plain", "kind")
    add("self", True, 20, "te_sashiageru", f"concat(ogo, {o}, 'して差し上げる')", "kenjougo_1", "is_verb and ogo <> '' and target", "'ichidan'")
    for cls, side, for_other, seq in (("kenjougo_1", "self", True, 30), ("kenjougo_2", "self", False, 40), ("sonkeigo", "other", False, 10)):
        rows = [(i, *s) for i, s in enumerate(T.SPECIAL_FORMS) if s[2] == cls]
        origin = {"kenjougo_1": "kenjougo1_special", "kenjougo_2": "kenjougo2_special", "sonkeigo": "sonkeigo_special"}[cls]
        out.append(f"select base, '{side}' as side, {str(for_other).lower()} as for_other, {seq} + i as seq, '{origin}' as origin, form, kind, cls from {M.values(rows, 'i, base, form, cls, kind', 's')}")
    for n, origin, form, cond in M.KENJOUGO2:
        add("self", False, 80 + n, origin, form, "kenjougo_2" if n == 1 else "kenjougo_1_and_2", f"is_verb and {cond}", "'godan'")
    for n, origin, form, cond in M.SONKEIGO:
        add("other", False, 60 + n, origin, form, "sonkeigo", f"is_verb and {cond}")
    add("other", False, 70, "kenjougo1_ogo_itadaku", f"concat(ogo, {o}, 'いただく')", "kenjougo_1", "is_verb and ogo <> '' and naru", "'godan'")
    te = M.te_form("base", "kind")
    add("other", False, 71, "te_kudasaru", f"concat({te}, 'くださる')", "sonkeigo", "kind is not null", "'godan'")
    add("other", False, 72, "te_itadaku", f"concat({te}, 'いただく')", "kenjougo_1", "kind is not null", "'godan'")
    for side in ("self", "other", "none"):
        add(side, False, 99, "teineigo_plain", "base", "teineigo", "kind is not null", "kind")
    return " union all ".join(out)


def rank_sql(origin: str, side: str, politeness: str) -> str:
    pick = lambda names: f"case {origin} " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(names)) + f" else {len(names)} end"
    return f"(case when {side} = 'self' then {pick(T.RANK_SELF)} when {side} = 'other' and {politeness} >= 2 then {pick(T.RANK_FORMAL)} when {side} = 'other' then {pick(T.RANK_OTHER)} else 0 end)"


def final_sql(form: str, kind: str, cls: str, origin: str, side: str, politeness: str) -> str:
    """The form at a politeness of 0 (plain), 1 (polite), 2 (formal)."""
    polite, te = M.polite(form, kind), M.te_form(form, kind)
    return (
        f"(case when {politeness} <= 0 then {form} when {politeness} = 1 or {kind} = 'copula' then {polite} "
        f"when {cls} = 'sonkeigo' and {origin} = 'sonkeigo_ogo_ni_naru' then concat({te}, 'いらっしゃいます') when {cls} = 'sonkeigo' then {polite} "
        f"when {origin} = 'teineigo_plain' and {side} <> 'self' then {polite} when {form} like '%おる%' or {form} like '%いらっしゃ%' then {polite} else concat({te}, 'おります') end)"
    )


def class_sql(cls: str, origin: str, side: str, politeness: str) -> str:
    return f"(case when {origin} <> 'teineigo_plain' then {cls} when {politeness} <= 0 then 'plain' when {politeness} >= 2 and {side} = 'self' then 'kenjougo_2' else 'teineigo' end)"


def side_sql(party: str) -> str:
    own = ", ".join(f"'{p[0]}'" for p in T.PARTIES if p[1])
    other = ", ".join(f"'{p[0]}'" for p in T.PARTIES if p[2])
    return f"(case when {party} in ({own}) then 'self' when {party} in ({other}) then 'other' else 'none' end)"


def forms_sql(standpoints: list[tuple] = STANDPOINTS, politeness: tuple[int, ...] = (1,), candidates: str | None = None) -> str:
    """(base, label, actor, politeness, nth, form, text, cls, origin): admissible forms,
    best first, each text once."""
    rows = [(label, actor, target, p) for label, actor, target in standpoints for p in politeness]
    s = M.values(rows, "label, actor, target, politeness", "s")
    texts = (
        f"select c.base, s.label, s.actor, s.politeness, c.form, c.origin, c.seq, {class_sql('c.cls', 'c.origin', 'c.side', 's.politeness')} as cls, "
        f"{final_sql('c.form', 'c.kind', 'c.cls', 'c.origin', 'c.side', 's.politeness')} as text, {rank_sql('c.origin', 'c.side', 's.politeness')} as rk "
        f"from {candidates or '(' + candidates_sql() + ')'} as c join {s} on c.side = {side_sql('s.actor')} and (not c.for_other or {side_sql('s.target')} = 'other')"
    )
    once = f"select *, row_number() over (partition by base, label, actor, politeness, text order by rk, seq) as dup from ({texts}) as t"
    return (
        f"select base, label, actor, politeness, cast(row_number() over (partition by base, label, actor, politeness order by rk, seq) as int) as nth, form, text, cls, origin "
        f"from ({once}) as o where dup = 1"
    )


def candidates_view(spark: SparkSession) -> str:
    """The candidates as a local relation under a view name (fixed by the rule tables)."""
    if not spark.catalog.tableExists("hinoki_candidates"):
        spark.createDataFrame(spark.sql(candidates_sql()).collect()).createOrReplaceTempView("hinoki_candidates")
    return "hinoki_candidates"


def forms(spark: SparkSession, base: str | None = None, politeness: tuple[int, ...] = (1,)) -> DataFrame:
    """Admissible forms for the four standpoints; KeyError for an unknown verb."""
    view = candidates_view(spark)
    if base is not None and not spark.table(view).where(f"base = {M.quote(base)}").limit(1).count():
        raise KeyError(base)
    out = spark.sql(forms_sql(STANDPOINTS, politeness, view))
    return out if base is None else out.where(f"base = {M.quote(base)}")


def corpus_sql(candidates: str, md5: str = "md5") -> str:
    """(id, function, actor, audience, politeness, base, subject, text, start, end_,
    predicate, cls, origin): function x actor x politeness x base verb, the best form of
    each, audience by the md5 of the key, each text once."""
    points = [(a, a, "self" if a in ("addressee", "addressee_group") else "addressee") for a, _ in SUBJECTS]
    f = forms_sql(points, (1, 2), candidates)
    key = "concat(fr.fn, '|', f.actor, '|', cast(f.politeness as varchar(2)), '|', f.base)"
    rows = (
        f"select {md5}({key}) as id, fr.fn as function, f.actor, f.politeness, f.base, su.subject, case when fr.fn = 'request' then fr.pre else concat(su.subject, fr.pre) end as head, f.text as predicate, fr.post, f.cls, f.origin "
        f"from ({f}) as f join {M.values(FRAMES, 'fn, side, pre, post', 'fr')} on fr.side = {side_sql('f.actor')} join {M.values(SUBJECTS, 'actor, subject', 'su')} on su.actor = f.actor where f.nth = 1"
    )
    pick = " ".join(f"when substring(id, 1, 1) in ({', '.join(repr(c) for c in cs)}) then '{a}'" for a, cs in (("external", "012345"), ("internal", "6789a"), ("public", "bcdef")))
    text = f"select *, concat(head, predicate, post) as text, case {pick} end as audience, length(head) as start, length(head) + length(predicate) as end_ from ({rows}) as r"
    once = f"select *, row_number() over (partition by text order by id) as dup from ({text}) as t"
    return f"select id, function, actor, audience, politeness, base, subject, text, start, end_, predicate, cls, origin from ({once}) as o where dup = 1"


def injected_sql(corpus: str, candidates: str) -> str:
    """(id, error_type, text, source_text, start, end_, surface, gold): each corpus
    sentence crossed with the error types that apply, the predicate replaced."""
    v = f"(select base as v_base, kind, ogo, target, naru, is_verb from {bases_sql()}) as v"
    k1 = f"(select base as k_base, min_by(form, seq) as k_form, min_by(kind, seq) as k_kind from {candidates} where side = 'self' and cls = 'kenjougo_1' group by base) as k1"
    so = f"(select base as s_base, min_by(form, seq) as s_form, min_by(kind, seq) as s_kind from {candidates} where side = 'other' and cls = 'sonkeigo' group by base) as so"
    side = side_sql("c.actor")
    stem = M.ogo_stem("c.base", "v.kind")
    builders = [
        ("go_sareru", f"concat('ご', {M.cut('c.base', 2)}, 'されます')", f"{side} = 'other' and v.is_verb and v.kind = 'sahen' and v.ogo = 'ご'"),
        ("ogo_dekiru", f"concat(v.ogo, {stem}, 'できます')", f"{side} = 'other' and v.is_verb and v.kind = 'sahen' and v.ogo <> ''"),
        ("double_keigo", "concat(" + M.cut("c.predicate", 3) + ", 'られます')", "c.predicate like 'お%になります' or c.predicate like 'ご%になります'"),
        ("direction_swap", M.polite("k1.k_form", "k1.k_kind"), f"{side} = 'other' and c.cls = 'sonkeigo' and k1.k_form is not null"),
        ("uchi_sonkeigo", M.polite("so.s_form", "so.s_kind"), "c.actor = 'self_group' and c.audience = 'external' and c.cls <> 'sonkeigo' and so.s_form is not null"),
        ("self_sonkeigo", M.polite("so.s_form", "so.s_kind"), "c.actor = 'self' and c.cls <> 'sonkeigo' and so.s_form is not null"),
        ("sa_insertion", f"concat({M.a_stem('c.base', 'v.kind')}, 'させていただきます')", f"{side} = 'self' and v.is_verb and v.kind = 'godan'"),
        ("bad_keigo_link", "'伺ってください'", f"{side} = 'other' and c.function = 'request' and c.base in ('尋ねる', '聞く', '訪ねる')"),
    ]
    new = "case e.error_type " + " ".join(f"when '{t}' then {x}" for t, x, _ in builders) + " end"
    ok = " or ".join(f"(e.error_type = '{t}' and ({c}))" for t, _, c in builders)
    types = M.values([(t,) for t, _, _ in builders], "error_type", "e")
    rows = (
        f"select c.id, e.error_type, c.actor, c.audience, c.text as source_text, c.predicate as gold, c.start, {new} as surface, c.end_ as old_end "
        f"from {corpus} as c left join {v} on v.v_base = c.base left join {k1} on k1.k_base = c.base left join {so} on so.s_base = c.base cross join {types} where {ok}"
    )
    return (
        "select id, error_type, actor, audience, concat(substring(source_text, 1, start), surface, substring(source_text, old_end + 1)) as text, source_text, "
        f"start, start + length(surface) as end_, surface, gold from ({rows}) as r where surface is not null and surface <> gold"
    )


def split_sql(rows: str, share: tuple[int, int] = (80, 10)) -> str:
    """rows with split: train, validation or test by a threshold on the hash of source_text, so
    the variants of a sentence are in one split and a row's split needs no other row."""
    digit = lambda i: f"(instr('0123456789abcdef', substring(md5(source_text), {i}, 1)) - 1)"
    at = f"({digit(1)} * 16 + {digit(2)}) * 100"
    return f"select *, case when {at} < {share[0]} * 256 then 'train' when {at} < {sum(share)} * 256 then 'validation' else 'test' end as split from {rows} as p"


def mail_pieces_sql(corpus: str, most: int = 3) -> str:
    """(mail_id, audience, nth, piece): mails of an opening, up to most sentences of one
    audience and subject's base verb, and a closing, each piece on a line of its own."""
    numbered = f"select concat(audience, '|', base) as mail_id, audience, text, row_number() over (partition by audience, base order by id) as n from {corpus}"
    opening = " ".join(f"when '{a}' then '{t}'" for a, t in OPENINGS)
    return (
        f"select mail_id, audience, cast(n as int) as nth, text as piece from ({numbered}) as x where n <= {most} "
        f"union all select distinct mail_id, audience, 0 as nth, case audience {opening} end as piece from ({numbered}) as y "
        f"union all select distinct mail_id, audience, {most + 1} as nth, '{CLOSING}' as piece from ({numbered}) as z"
    )
