"""Role tagging and detection once more, as SQL of another engine: the rules of
operators/roles.py and operators/detect.py written independently, for comparison.

All functions return CTEs that follow a CTE src (doc_id, text, audience); texts that
occur often are worked on once.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import tables as T
from ..functions.morph import quote, values
from ..operators import detect as D
from ..operators import text as X

PERSONS = [("田中", "self_group"), ("鈴木", "addressee_group")]
WRITER, RECIPIENT = "山田", "佐藤"


def listed(items) -> str:
    return ", ".join(quote(i) for i in items)


def sentences(source: str, key: str) -> str:
    return (
        f"parts as (select *, regexp_extract_all(text, {quote(X.SENTENCE)}) as p from {source}), "
        "cut as (select *, p[i] as sentence, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0)::int as sent_start, i from parts, unnest(range(1, len(p) + 1)) as u(i)), "
        f"sents as (select *, (row_number() over (partition by {key} order by i) - 1)::int as sent_idx from cut where not regexp_matches(sentence, '^[\\s　]*$'))"
    )


def scan() -> str:
    """walk: the dictionary's leftmost-longest matches of each distinct text (tid)."""
    rest = "substring(sentence, p_start + n + 1)"
    return (
        f"{L.oracle_ctes()}, texts as (select min(doc_id) as tid, text from src group by text), {sentences('texts', 'tid')}, "
        "pieces_ as (select tid, sent_idx, sent_start, s as p_start, n, substring(sentence, s + 1, n) as surface, sentence from sents, unnest(range(0, length(sentence) - 1)) as a(s), unnest(range(2, 23)) as b(n) where s + n <= length(sentence) and regexp_matches(sentence, '[ぁ-んァ-ヶ一-龥]')), "
        f"hit as (select c.*, l.form, l.kind, l.cls, l.origin, l.base, l.hint from pieces_ as c join lexicon as l on c.surface = l.surface where ({rest} = '' or regexp_matches({rest}, {quote(X.BOUNDARY)})) and not (l.cls = 'plain' and p_start > 0 and regexp_matches(substring(sentence, p_start, 1), {quote(X.VETO)}))), "
        "best as (select *, p_start + n as p_end from hit qualify row_number() over (partition by tid, sent_idx, p_start order by n desc) = 1), "
        "firsts as (select tid, sent_idx, min(p_start) as p_start from best group by all), "
        "walk as (select b.* from best b join firsts f on b.tid = f.tid and b.sent_idx = f.sent_idx and b.p_start = f.p_start "
        "union all (select b.* from walk w join best b on b.tid = w.tid and b.sent_idx = w.sent_idx and b.p_start >= w.p_end qualify row_number() over (partition by b.tid, b.sent_idx order by b.p_start) = 1))"
    )


def party(p: str, persons) -> str:
    """party and conf of a noun phrase."""
    named = [*persons, (WRITER, "self"), (RECIPIENT, "addressee")]
    ctx = "case " + " ".join(f"when contains({p}, {quote(n)}) then '{s}'" for n, s in named) + " else 'unknown' end"
    mark = "case " + " ".join(f"when contains({p}, '{w}') then '{s}'" for w, s in sorted(T.MARKERS, key=lambda m: -len(m[0]))) + " else 'unknown' end"
    own, other = "('self', 'self_group')", "('addressee', 'addressee_group', 'third_party')"
    same = "((ctx in {0} and mark in {0}) or (ctx in {1} and mark in {1}))".format(own, other)
    tail = " or ".join(f"ends_with({p}, '{s}')" for s in T.HONORIFIC_SUFFIXES)
    return (
        f"select *, case when ctx <> 'unknown' and mark <> 'unknown' then case when {same} then ctx else mark end when ctx <> 'unknown' then ctx when mark <> 'unknown' then mark when {tail} then 'addressee_group' else 'unknown' end as party, "
        f"case when ctx <> 'unknown' and mark <> 'unknown' then case when {same} then 0.95 else 0.6 end when ctx <> 'unknown' then 0.9 when mark <> 'unknown' then 0.85 when {tail} then 0.6 else 0.0 end::double as conf "
        f"from (select *, {ctx} as ctx, {mark} as mark from noun)"
    )


def roles(persons=PERSONS) -> str:
    """tagged: a row a predicate and document, with actor, target, function and link."""
    cue = lambda cues: " or ".join(f"contains(sentence, '{c}')" for c in cues)
    own, other = "('self', 'self_group')", "('addressee', 'addressee_group', 'third_party')"
    return (
        f"{scan()}, pre as (select *, regexp_extract_all(substring(sentence, 1, p_start), {quote(X.PHRASE)}, 1) as bodies, regexp_extract_all(substring(sentence, 1, p_start), {quote(X.PHRASE)}, 2) as parts_ from walk), "
        "noun as (select tid, sent_idx, p_start, i, trim(bodies[i]) as phrase, parts_[i] as particle from pre, unnest(range(1, len(bodies) + 1)) as u(i) where bodies[i] <> ''), "
        f"who as ({party('phrase', persons)}), known as (select * from who where party <> 'unknown'), "
        f"heard as (select tid, sent_idx, p_start, arg_max(party, i) filter (particle in ({listed(T.ACTOR_PARTICLES)})) as subject, arg_max(conf, i) filter (particle in ({listed(T.ACTOR_PARTICLES)})) as subject_conf, "
        f"arg_max(party, i) filter (particle in ({listed(T.SOURCE_PARTICLES)})) as source, arg_max(party, i) filter (particle in ({listed(T.TARGET_PARTICLES)})) as goal from known group by all), "
        "opened as (select w.*, coalesce(h.subject, case w.hint when 'self' then 'self' when 'other' then 'addressee' end) as open, coalesce(h.subject_conf, case when w.hint in ('self', 'other') then 0.8 end) as open_conf, h.source, h.goal, "
        f"case when {cue(T.REQUEST_CUES)} then 'request' when {cue(T.QUESTION_CUES)} then 'question' else 'report' end as function "
        "from walk w left join heard h on h.tid = w.tid and h.sent_idx = w.sent_idx and h.p_start = w.p_start), "
        "per as (select tid, sent_idx, arg_max(open, p_start) filter (open_conf >= 0.7) as strong from opened group by all), "
        "carry as (select tid, sent_idx, last_value(strong ignore nulls) over (partition by tid order by sent_idx rows between unbounded preceding and 1 preceding) as carried from per), "
        "acted as (select o.*, coalesce(o.open, o.source, c.carried, case when function in ('request', 'question') then 'addressee' else 'self' end) as actor, "
        "round(coalesce(o.open_conf, case when o.source is not null then 0.6 end, case when c.carried is not null then 0.55 end, 0.5), 2) as actor_conf from opened o join carry c on c.tid = o.tid and c.sent_idx = o.sent_idx), "
        f"tagged as (select s.doc_id, s.audience, a.sent_idx, (a.sent_start + a.p_start)::int as start, (a.sent_start + a.p_end)::int as end_, a.surface, a.form, a.cls, a.origin, a.base, a.actor, a.actor_conf, "
        f"coalesce(a.goal, case when a.hint = 'self' and a.actor in {own} then 'addressee' when a.hint = 'other' and a.actor in {other} then 'self' end, 'unknown') as target, a.function, "
        f"case when a.origin = 'link' and a.form in ({listed(T.GOOD_LINKS)}) then 'acceptable' when a.origin = 'link' and (a.form in ({listed(T.BAD_LINKS)}) or a.surface in ({listed(T.BAD_LINKS)})) then 'inappropriate' else '' end as link "
        "from acted a join texts t on t.tid = a.tid join src s on s.text = t.text)"
    )


HIT = "doc_id, start, end_, surface, error_type, confidence, citation_key, forced, seq, inside"


def direction() -> str:
    """directed: hits of predicates whose act points the wrong way."""
    own, other = "('self', 'self_group')", "('addressee', 'addressee_group', 'third_party')"
    raised = f"actor in {own} and cls = 'sonkeigo'"
    humbled = f"actor in {other} and cls = 'kenjougo_1'"
    link = f"regexp_matches(surface, {quote(T.BAD_LINK)})"
    return (
        f"directed as (select doc_id, start, end_, surface, case when {raised} then case when actor = 'self_group' then 'uchi_sonkeigo' else 'self_sonkeigo' end when {humbled} then case when {link} then 'bad_keigo_link' else 'direction_swap' end else 'direction_swap' end as error_type, "
        f"(case when {raised} and actor = 'self_group' then case when audience = 'external' then 0.9 else 0.5 end when ({raised}) or ({humbled}) then 0.85 else 0.6 end * actor_conf)::double as confidence, "
        f"case when {raised} then case when actor = 'self_group' then case when audience = 'external' then 'uchi_soto.q25' else 'uchi_soto.q26' end else 'self_sonkeigo.q16' end when {humbled} then case when {link} then 'keigo_link.bad' else 'direction.q11' end else 'direction.q13' end as citation_key, "
        f"({raised}) and actor = 'self_group' and audience <> 'external' as forced, start * 1e-6 as seq, false as inside from tagged "
        f"where actor_conf >= 0.7 and link <> 'acceptable' and (({raised}) or ({humbled}) or (actor in {other} and cls = 'kenjougo_2' and actor <> 'addressee')))"
    )


def inversion() -> str:
    """inverted: in external messages, the highest of either side where one's own stands higher."""
    level = "case cls " + " ".join(f"when '{c}' then {n}" for c, n in T.CLASSES) + " else 0 end"
    return (
        f"sided as (select *, {level} as lv, case when audience = 'external' and actor_conf >= 0.5 then case when actor = 'self_group' then 'in' when actor in ('addressee', 'addressee_group') then 'out' end end as side from tagged), "
        "tops as (select doc_id, max(lv) filter (side = 'in') as top_in, max(lv) filter (side = 'out') as top_out from sided group by doc_id), "
        "inverted as (select s.doc_id, start, end_, surface, 'rank_inversion' as error_type, (case when side = 'in' then 0.8 else 0.7 end * actor_conf)::double as confidence, 'rank_inversion' as citation_key, false as forced, "
        "case when side = 'in' then 8 else 9 end + start * 1e-6 as seq, side = 'in' as inside from sided s join tops t on t.doc_id = s.doc_id where top_in > top_out and ((side = 'in' and lv = top_in) or (side = 'out' and lv = top_out)))"
    )


def regex_rows(pattern: str, source: str) -> str:
    """doc_id, text, start, end_ of a regex's matches: gaps and matches, summed."""
    p = quote(pattern)
    before = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"select doc_id, text, m[i] as surface, ({before})::int as start, ({before} + length(m[i]))::int as end_ from (select *, regexp_extract_all(text, {p}) as m, regexp_split_to_array(text, {p}) as gaps from {source}) as q, unnest(range(1, len(m) + 1)) as u(i)"


def patterns() -> str:
    """patterned: hits of the regex families."""
    fine = " or ".join(f"contains(substring(text, greatest(start - 2, 0) + 1, end_ + 4 - greatest(start - 2, 0)), '{e[0]}')" for e in T.ESTABLISHED)
    stretch = lambda stop: f"length(regexp_extract(substring(text, end_ + 1), '^[^{stop}]*'))"
    many = f"(select * from src where len(regexp_extract_all(text, {quote(T.SASETE)})) >= 3)"
    rows = [(p, "double_keigo", 0.9, "double_keigo", 1 + i * 0.01, "end_", f"not ({fine})", "src") for i, p in enumerate(T.DOUBLE_PATTERNS)]
    rows += [
        ("|".join(D.sa_literals()), "sa_insertion", 0.9, "sa_insertion", 2, "end_", "true", "src"),
        (T.GO_SARERU, "go_sareru", 0.8, "go_sareru.q7", 3, "end_", "true", "src"),
        (T.OGO_DEKIRU, "ogo_dekiru", 0.7, "ogo_dekiru.q8", 4, "end_", "true", "src"),
        (T.BAD_LINK, "bad_keigo_link", 0.75, "keigo_link.bad", 5, f"least(end_ + {stretch('。\\n、')}, start + 12)", "true", "src"),
        (T.SASETE, "sasete_itadaku_overuse", 0.6, "sasete_itadaku", 6, f"least(end_ + {stretch('。\\n')}, end_ + 6)", "true", many),
    ]
    parts = [
        f"select doc_id, start, e::int as end_, substring(text, start + 1, e - start) as surface, '{kind}' as error_type, {conf}::double as confidence, '{cite}' as citation_key, false as forced, {seq} + start * 1e-6 as seq, false as inside from (select *, {end} as e from ({regex_rows(p, source)}) as x where {where}) as y"
        for p, kind, conf, cite, seq, end, where, source in rows
    ]
    return "patterned as (" + " union all ".join(parts) + ")"


def styles() -> str:
    """styled_hits: the sentences of the minority style."""
    own = sentences("src", "doc_id").replace("parts as", "s_parts as").replace("from parts,", "from s_parts,").replace("cut as", "s_cut as").replace("from cut ", "from s_cut ").replace("sents as", "s_sents as")
    return (
        f"{own}, bodies_ as (select *, regexp_replace(sentence, '[。！？\\n 　]+$', '') as body from s_sents), "
        f"style_of as (select *, case when regexp_matches(body, {quote(T.POLITE_END)}) then 'polite' when regexp_matches(body, {quote(T.PLAIN_END)}) then 'plain' end as style from bodies_), "
        "counted as (select doc_id, count(*) as n, count(*) filter (style = 'polite') as n1, count(*) filter (style = 'plain') as n2, arg_min(style, sent_idx) filter (style is not null) as first from style_of group by doc_id), "
        "major as (select doc_id, case when n1 > n2 then 'polite' when n1 < n2 then 'plain' else first end as majority from counted where n >= 3 and n1 + n2 >= 3 and n1 > 0 and n2 > 0), "
        "styled_hits as (select s.doc_id, (sent_start + length(body) - least(length(body), 8))::int as start, (sent_start + length(body))::int as end_, right(body, 8) as surface, 'style_mixing' as error_type, 0.6::double as confidence, 'style_mixing' as citation_key, false as forced, "
        "7 + (sent_start + length(body) - least(length(body), 8)) * 1e-6 as seq, false as inside from style_of s join major m on s.doc_id = m.doc_id where style <> majority and body <> '')"
    )


def findings(persons=PERSONS) -> str:
    """found: what is left after greedy suppression, with the verdict (src: unique doc_id)."""
    words = "|".join(sorted((s for v in T.VARIATIONS for s in v[1].split(" ")), key=lambda s: -len(s)))
    varied = values([(s, v[0], v[2], v[4]) for v in T.VARIATIONS if not v[6] for s in v[1].split(" ")], "v_surface, v_key, suppressed, acceptability", "t")
    rank = "case error_type " + " ".join(f"when '{t[0]}' then {t[1]}" for t in T.ERROR_TYPES) + " end"
    iou = "(least(f.end_, v.end_) - greatest(f.start, v.start))::double / ((f.end_ - f.start) + (v.end_ - v.start) - (least(f.end_, v.end_) - greatest(f.start, v.start)))"
    return (
        f"{roles(persons)}, {direction()}, {inversion()}, {patterns()}, {styles()}, "
        f"every as (select {HIT} from directed union all select {HIT} from inverted union all select {HIT} from patterned union all select {HIT} from styled_hits), "
        "open_ as (select * from every e where error_type = 'rank_inversion' or not exists (select 1 from every i where i.inside and i.doc_id = e.doc_id and i.start = e.start and i.end_ = e.end_)), "
        f"ranked as (select *, row_number() over (partition by doc_id order by {rank} desc, confidence desc, seq, start, end_) as r from open_), "
        "kept_ as (select doc_id, r, [{'r': r, 's': start, 't': end_}] as kept from ranked where r = 1 union all select e.doc_id, e.r, case when len(list_filter(g.kept, lambda o: o.s < e.end_ and e.start < o.t)) > 0 then g.kept else list_append(g.kept, {'r': e.r, 's': e.start, 't': e.end_}) end from kept_ g join ranked e on e.doc_id = g.doc_id and e.r = g.r + 1), "
        "last_ as (select doc_id, arg_max(kept, r) as kept from kept_ group by doc_id), "
        "final as (select k.* from ranked k join (select doc_id, x.r as r from last_, unnest(kept) as u(x)) as y on y.doc_id = k.doc_id and y.r = k.r), "
        f"spots as (select v.doc_id, v.start, v.end_, t.* from ({regex_rows(words, 'src')}) as v join {varied} on v.surface = t.v_surface), "
        f"met as (select f.doc_id, f.start, f.end_, arg_max(v.acceptability, ({iou}, -v.start, v.acceptability)) as acceptability from final f join spots v on v.doc_id = f.doc_id and f.start < v.end_ and v.start < f.end_ and (v.suppressed = '' or list_contains(string_split(v.suppressed, ' '), f.error_type)) group by all), "
        "found as (select f.*, m.acceptability, case when m.acceptability is not null or f.forced then 'variation' else 'norm_divergence' end as verdict from final f left join met m on m.doc_id = f.doc_id and m.start = f.start and m.end_ = f.end_)"
    )


def messages_src(messages: str) -> str:
    """src: one message of each text and audience; all_: the documents of each."""
    return f"{messages}, src as (select min(doc_id) as doc_id, text, audience from messages group by text, audience), all_ as (select m.doc_id, s.doc_id as sid, m.text, m.audience from messages m join src s on s.text = m.text and s.audience = m.audience)"
