"""The choice of replacements once more, as SQL of another engine: the rules of
operators/correct.py written independently, for comparison.

The table of replacements is the one SQL text of operators/correct.py on both sides; which
rows a finding takes, in which order, and what no table holds are written apart.
"""

from __future__ import annotations

from ..functions import tables as T
from ..functions.morph import values
from ..operators import correct as CO

OWN, OTHER = "('self', 'self_group')", "('addressee', 'addressee_group', 'third_party')"


def replacements() -> str:
    """fix_: the table of replacements, cut at the same stages."""
    stages = [
        ("c_lemmas", CO.lemmas_sql()), ("c_infl", CO.inflected_sql("c_lemmas")), ("c_class", CO.class_forms_sql("c_lemmas")),
        ("c_forms", f"select f.*, coalesce(l.origin, 'general') as origin from ({CO.inflected_sql('c_class')}) as f left join c_lemmas as l on l.seq = f.seq and l.lemma = f.lemma"),
        ("c_doubled", CO.doubled_sql("c_lemmas")), ("c_prefixed", CO.prefixed_sql()), ("c_index", CO.index_sql("c_infl", "c_doubled", "c_prefixed")), ("c_linked", CO.linked_sql("c_infl")), ("c_able", CO.able_sql()),
        ("fix_", CO.fixes_sql("c_index", "c_forms", "c_infl", "c_linked", "c_able")),
    ]
    return ", ".join(f"{name} as materialized ({sql})" for name, sql in stages)


def by_hand() -> str:
    """byhand: what is made of a finding's own text where the table gives nothing."""
    a_row = {r[0]: r[2] for r in T.GODAN}
    stems = values([(i, v[0][:-1] + a_row[v[0][-1]]) for i, v in enumerate(v for v in T.VERBS if v[1] == "godan")], "i, stem", "s")
    verb_row = "".join(sorted({a_row[v[0][-1]] for v in T.VERBS if v[1] == "godan"} - {"さ"}))
    whole_row = "".join(x for x in a_row.values() if x != "さ")
    tails = values([(0, "きませんでした", "いたしませんでした", "しませんでした"), (1, "きました", "いたしました", "しました"), (2, "きません", "いたしません", "しません"), (3, "きます", "いたします", "します"), (4, "いた", "いたした", "した"), (5, "く", "いたす", "する"), (6, "", "いたします", "します")], "i, tail, humble, bare", "e")
    undo = values([(i, *p) for i, p in enumerate(T.DOUBLE_UNDO)], "i, bad, good", "u")
    ends = values([(i, *p) for i, p in enumerate(T.STYLE_ENDS)], "i, tail, better", "e")
    return (
        f"sa_known as (select k, i, replace(surface, stem || 'させ', stem || 'せ') as text from asked join {stems} on contains(surface, stem || 'させ') where error_type = 'sa_insertion'), "
        f"sa_any as (select k, 0 as i, regexp_replace(surface, '^(.*?[{verb_row}])させ', '\\1せ') as text from asked where error_type = 'sa_insertion' and k not in (select k from sa_known)), "
        "nouns as (select k, split_part(surface, 'させていただ', 1) as noun, substring(surface, strpos(surface, 'させていただ') + 6) as rest from asked where error_type = 'sasete_itadaku_overuse' and strpos(surface, 'させていただ') > 1), "
        f"stated as (select k, noun, humble, bare, substring(rest, length(tail) + 1) as more from nouns join {tails} on starts_with(rest, tail) where not regexp_matches(noun, '[{whole_row}]$') qualify row_number() over (partition by k order by i) = 1), "
        f"single as (select k, substring(surface, 1, strpos(surface, bad) - 1) || good || substring(surface, strpos(surface, bad) + length(bad)) as text from asked join {undo} on contains(surface, bad) where error_type = 'double_keigo' qualify row_number() over (partition by k order by i) = 1), "
        "bared as (select k, surface, rtrim(surface, '。．') as bare from asked where error_type = 'style_mixing' and polite), "
        f"styled_ as (select k, left(bare, length(bare) - length(tail)) || better || substring(surface, length(bare) + 1) as text from bared join {ends} on ends_with(bare, tail) qualify row_number() over (partition by k order by i) = 1), "
        "byhand as (select k, i, text, 'plain' as cls from (select * from sa_known union all select * from sa_any) as s "
        "union all select k, 0, noun || humble || more, 'kenjougo_2' from stated union all select k, 1, noun || bare || more, 'teineigo' from stated "
        "union all select k, 0, text, 'sonkeigo' from single union all select k, 0, text, 'teineigo' from styled_)"
    )


def offered(most: int = CO.MOST) -> str:
    """offered (doc_id, start, end_, error_type, nth, suggestion, cls); follows found, tagged
    and src."""
    of = lambda words: f"regexp_matches(s, '(?:{'|'.join(words)})$')"
    # Which families a type asks, in order; where two are listed as one, the first that is met.
    asks = [(t, 0, f) for t in ("uchi_sonkeigo", "rank_inversion", "direction_swap", "style_mixing") for f in ("surface",)]
    asks += [(t, 1, "double") for t in ("uchi_sonkeigo", "rank_inversion")]
    asks += [("self_sonkeigo", 0, "double"), ("self_sonkeigo", 1, "surface"), ("double_keigo", 0, "double"), ("bad_keigo_link", 0, "link"), ("sasete_itadaku_overuse", 0, "sasete")]
    asks += [(t, i, f) for t in ("go_sareru", "ogo_dekiru") for i, f in enumerate(("go_sareru", "ogo_dekiru"))]
    return (
        f"{replacements()}, sentence_ends as (select doc_id, regexp_replace(trim(x), '[！？!?、，,]+$', '') as s from (select doc_id, unnest(string_split(replace(text, chr(10), '。'), '。')) as x from src) as q), "
        f"manner as (select doc_id, count(*) filter ({of(T.MAJORITY_POLITE)}) >= count(*) filter ({of(T.MAJORITY_PLAIN)} and not {of(T.MAJORITY_POLITE)}) as polite from sentence_ends group by doc_id), "
        "asked_ as (select f.doc_id, f.start, f.end_, f.surface, f.error_type, arg_min(r.actor, r.start) as actor, arg_min(r.target, r.start) as target from (select distinct doc_id, start, end_, surface, error_type from found where verdict = 'norm_divergence') as f "
        "left join tagged r on r.doc_id = f.doc_id and r.start < f.end_ and f.start < r.end_ group by all), "
        "asked as materialized (select row_number() over (order by a.doc_id, start, end_, error_type) as k, a.*, m.polite, "
        f"case when error_type = 'direction_swap' then case when actor in {OTHER} then 'other' when actor in {OWN} and target in {OTHER} then 'own' when actor in {OWN} then 'alone' else 'unknown' end "
        "when error_type in ('uchi_sonkeigo', 'rank_inversion') then 'uchi' when error_type = 'style_mixing' then case when polite then 'polite_style' else 'plain_style' end else error_type end as variant "
        "from asked_ a join manner m on m.doc_id = a.doc_id), "
        "stretch as (select k, a.p, b.n, substring(surface, (a.p + 1)::int, b.n::int) as found_ from asked, unnest(range(0, length(surface))) as a(p), unnest(range(1, length(surface) + 1)) as b(n) where a.p + b.n <= length(surface)), "
        "known_ as (select s.k, s.p, s.n, x.family from stretch s join (select distinct family, surface from fix_) as x on x.surface = s.found_ qualify row_number() over (partition by s.k, x.family order by s.n desc, s.p) = 1), "
        f"turn as (select q.k, q.p, q.n, q.family, t.o from known_ q join asked a on a.k = q.k join {values(asks, 'kind, o, family', 't')} on t.kind = a.error_type and t.family = q.family "
        "qualify a.error_type not in ('uchi_sonkeigo', 'rank_inversion') or t.o = min(t.o) over (partition by q.k)), "
        "ruled as (select a.k, t.o, x.rank, substring(a.surface, 1, t.p::int) || x.text || substring(a.surface, (t.p + t.n + 1)::int) as text, x.cls, x.text as bare from turn t join asked a on a.k = t.k "
        "join fix_ x on x.family = t.family and x.variant = a.variant and x.surface = substring(a.surface, (t.p + 1)::int, t.n::int) "
        "union all select k, 2, 0, substring(surface, 2), 'plain', '' from asked where error_type = 'self_sonkeigo' and regexp_matches(surface, '^[おご御].') and not regexp_matches(surface, 'になり|になる|なさ|れます|られ') and k not in (select k from known_ where family = 'surface')), "
        f"{by_hand()}, listed_ as (select k, text, cls, row_number() over (partition by k order by o, rank, bare, cls) as r from ruled "
        "union all select k, text, cls, row_number() over (partition by k order by i) from byhand where k not in (select k from ruled)), "
        "once as (select k, text, min(r) as r, arg_min(cls, r) as cls from listed_ group by k, text), "
        "kept_forms as (select o.k, o.text, o.cls, row_number() over (partition by o.k order by o.r) as nth from once o join asked a on a.k = o.k where o.text <> '' and o.text <> a.surface), "
        f"offered as (select a.doc_id, a.start, a.end_, a.error_type, f.nth::int as nth, f.text as suggestion, f.cls from kept_forms f join asked a on a.k = f.k where f.nth <= {most})"
    )
