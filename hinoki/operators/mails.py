"""Whole mails made from threads: a plan of sentences, persons named alike throughout, errors of
several kinds in one mail with their spans re-based, and a dataset of all sources.

A thread (key, turn, role, text) gives a mail, each of its turns a sentence: its place in the
mail picks the function, the md5 of thread and turn the rest, so every engine and every run
makes the same.  The work grows with the table; no step sees more than one mail at a time.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import morph as M
from ..llm import common as C
from . import generate as G
from . import spans as S

#: Functions of a mail's sentences, in turn.
PLAN = ["report", "request", "notice", "thanks", "inquiry", "giving", "scheduling", "refusal"]
#: (function, side, whether the subject is named, before, after, ending, preferred origins)
TEMPLATES = [
    ("report", "self", True, "先ほど", "。", "as_is", ""),
    ("report", "self", True, "本件につき、", "。", "as_is", "kenjougo2_itasu kenjougo2_special"),
    ("report", "other", True, "昨日こちらに", "。", "as_is", "sonkeigo_special sonkeigo_ogo_ni_naru"),
    ("request", "other", False, "お時間のあるときに", "。", "asked", "kenjougo1_ogo_itadaku te_itadaku"),
    ("notice", "self", True, "来月から", "。", "as_is", ""),
    ("thanks", "other", False, "早々に", "、感謝しております。", "renyou", "kenjougo1_ogo_itadaku te_itadaku"),
    ("inquiry", "other", True, "当日も", "か。", "as_is", "sonkeigo_special sonkeigo_ogo_ni_naru"),
    ("giving", "self", True, "必要に応じて", "。", "as_is", "kenjougo1_ogo_suru kenjougo1_special"),
    ("scheduling", "other", True, "次回の打ち合わせで", "。", "as_is", "sonkeigo_ogo_ni_naru sonkeigo_special"),
    ("scheduling", "self", True, "次回の打ち合わせで", "。", "as_is", ""),
    ("refusal", "self", True, "あいにく今月は", "。", "kane", "kenjougo2_itasu kenjougo2_special"),
]
ENDINGS = ["as_is", "asked", "renyou", "kane"]
#: Names by party, and how a subject is said.
PEOPLE = [("self_group", ["田中", "中村", "高木"]), ("addressee_group", ["鈴木", "小川", "松本"]), ("third_party", ["木村", "石井", "大野"])]
SUBJECTS = [("self", "私が", ""), ("self_group", "弊社の", "が"), ("addressee", "佐藤様が", ""), ("addressee_group", "貴社の", "様が"), ("third_party", "先方の", "様が")]
ACTORS = [("self", ["self", "self_group"]), ("other", ["addressee", "addressee_group", "third_party"])]
SALUTATIONS = [("external", "株式会社ベータ\n佐藤様"), ("internal", "佐藤さん"), ("public", "お客様各位")]
WRITER, RECIPIENT = "山田", "佐藤"
#: Most errors of a mail, and the least that make a density.
MOST = 3


def draw(m: str, at: int, n: str) -> str:
    """SQL: a number from 0 to n - 1 out of two digits of an md5."""
    return f"((ascii(substring({m}, {at}, 1)) * 31 + ascii(substring({m}, {at + 1}, 1))) % ({n}))"


def templates_sql() -> str:
    """(tid, nth, of, fn, side, named, pre, post, ending): templates, numbered within a function."""
    rows, count = [], {f: sum(t[0] == f for t in TEMPLATES) for f in PLAN}
    seen: dict[str, int] = {}
    for tid, t in enumerate(TEMPLATES):
        rows.append((tid, seen.setdefault(t[0], 0), count[t[0]], *t[:6]))
        seen[t[0]] += 1
    return M.values(rows, "tid, nth, of_, fn, side, named, pre, post, ending", "t")


def preferences_sql() -> str:
    """(tid, origin, pref): the origins a template prefers, best first."""
    return M.values([(tid, o, i) for tid, t in enumerate(TEMPLATES) for i, o in enumerate(t[6].split())], "tid, origin, pref", "p")


def ended_sql(text: str, form: str, kind: str, ending: str) -> str:
    """SQL: a form with a template's ending."""
    able = M.polite(M.potential(form, kind), "'ichidan'")
    return f"case {ending} when 'as_is' then {text} when 'asked' then concat({able}, 'か') when 'renyou' then {M.masu_stem(form, kind)} else concat({M.masu_stem(form, kind)}, 'かねます') end"


def choices_sql(candidates: str) -> str:
    """(tid, actor, politeness, base, predicate, cls, i, n): for each template and verb the form of
    the first preferred origin that there is, else the best one; numbered by verb."""
    points = [(a, a, "self" if a.startswith("addressee") else "addressee") for _, actors in ACTORS for a in actors]
    forms = f"select *, {M.kind_of('form')} as kind from ({G.forms_sql(points, (1, 2), candidates)}) as f0"
    best = (
        f"select t.tid, t.ending, f.*, row_number() over (partition by t.tid, f.actor, f.politeness, f.base order by coalesce(p.pref, 99), f.nth) as r "
        f"from ({forms}) as f join {templates_sql()} on t.side = {G.side_sql('f.actor')} left join {preferences_sql()} on p.tid = t.tid and p.origin = f.origin"
    )
    ended = f"select tid, actor, politeness, base, cls, origin, {ended_sql('text', 'form', 'kind', 'ending')} as predicate from ({best}) as b where r = 1 and kind <> 'copula'"
    return (
        f"select *, cast(row_number() over (partition by tid, actor, politeness order by base) - 1 as int) as i, cast(count(*) over (partition by tid, actor, politeness) as int) as n "
        f"from ({ended}) as e where predicate is not null"
    )


def planned_sql(threads: str, key: str = "conv_id") -> str:
    """(key, nth, fn, tid, side, named, pre, post, actor, politeness, audience, m): the plan."""
    order = " ".join(f"when {i} then '{f}'" for i, f in enumerate(PLAN))
    text = lambda c: f"coalesce(cast({c} as string), '')"
    turns = f"select {key}, cast(row_number() over (partition by {key} order by turn, role, text) as int) as nth, md5(concat({text(key)}, '|', {text('turn')})) as m, md5({text(key)}) as k from {threads}"
    fns = f"select *, case (nth - 1) % {len(PLAN)} {order} end as fn, case {draw('k', 1, '3')} when 0 then 'external' when 1 then 'internal' else 'public' end as audience from ({turns}) as x"
    actor = "case t.side " + " ".join(
        f"when '{side}' then case {draw('q.m', 5, str(len(actors)))} " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(actors)) + " end" for side, actors in ACTORS
    ) + " end"
    return (
        f"select q.{key}, q.nth, q.fn, q.m, q.audience, case when q.audience = 'internal' then 1 else 2 end as politeness, t.tid, t.named, t.pre, t.post, {actor} as actor "
        f"from ({fns}) as q join {templates_sql()} on t.fn = q.fn and t.nth = {draw('q.m', 3, 't.of_')}"
    )


def sentences_sql(planned: str, choices: str, key: str = "conv_id") -> str:
    """(key, nth, id, function, actor, person, audience, base, cls, predicate, text, start, end_):
    the sentences of all mails.  A party's person is chosen where it first acts in a mail and
    handed on from there."""
    name = "case p.actor " + " ".join(f"when '{party}' then case {draw('p.m', 9, str(len(names)))} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end" for party, names in PEOPLE) + " end"
    said = "case actor " + " ".join(f"when '{a}' then " + (f"concat('{x}', coalesce(person, ''), '{y}')" if y else f"'{x}'") for a, x, y in SUBJECTS) + " end"
    rows = (
        f"select p.{key}, p.nth, p.fn, p.actor, p.audience, p.pre, p.post, p.named, c.base, c.cls, c.origin, c.predicate, "
        f"first_value({name}) over (partition by p.{key}, p.actor order by p.nth rows between unbounded preceding and unbounded following) as person "
        f"from {planned} as p join {choices} as c on c.tid = p.tid and c.actor = p.actor and c.politeness = p.politeness and c.i = {draw('p.m', 7, 'c.n')}"
    )
    head = f"select *, concat(case when named then {said} else '' end, pre) as head from ({rows}) as r"
    return (
        f"select {key}, nth, concat(coalesce(cast({key} as string), ''), '|', cast(nth as string)) as id, fn as function, actor, case when named then person end as person, audience, base, cls, origin, predicate, "
        f"concat(head, predicate, post) as text, cast(length(head) as int) as start, cast(length(head) + length(predicate) as int) as end_ from ({head}) as h"
    )


def by_audience(rows: list[tuple[str, str]], column: str = "audience") -> str:
    return f"case {column} " + " ".join(f"when '{a}' then {M.quote(t)}" for a, t in rows) + " end"


def pieces_sql(sentences: str, key: str = "conv_id") -> str:
    """(key, nth, piece, id): salutation, greeting, sentences, closing; id where it is a sentence."""
    once = f"select distinct {key}, audience from {sentences}"
    return (
        f"select {key}, nth, text as piece, id from {sentences} union all select {key}, -1 as nth, {by_audience(SALUTATIONS)} as piece, null as id from ({once}) as a "
        f"union all select {key}, 0 as nth, {by_audience(G.OPENINGS)} as piece, null as id from ({once}) as b union all select {key}, {1 << 30} as nth, {M.quote(G.CLOSING)} as piece, null as id from ({once}) as c"
    )


def proposals_sql(sentences: str, candidates: str, key: str = "conv_id", hint: str = "") -> str:
    """(key, nth, mode, error_type, start, end_, new, gold): every error that a sentence may get,
    in its own offsets.  mode 'one' replaces a predicate, 'sasete' and 'style' damage a mail as a
    whole: a density of させていただく, a sentence of the minority style.  hint: how the sentences s are joined."""
    verbs = f"(select base as v_base, kind, ogo, is_verb from {G.bases_sql()}) as v"
    ones = f"select i.id, i.error_type, i.surface as new, 'one' as mode from ({G.injected_sql(sentences, candidates)}) as i"
    own = f"{G.side_sql('s.actor')} = 'self'"
    whole = (
        f"select s.id, 'sasete_itadaku_overuse' as error_type, concat(case v.kind when 'sahen' then concat(v.ogo, {M.cut('s.base', 2)}) else {M.cut('s.base', 1)} end, 'させていただいております') as new, 'sasete' as mode "
        f"from {sentences} as s join {verbs} on v.v_base = s.base where v.kind in ('sahen', 'ichidan') and {own} and s.function <> 'refusal' "
        f"union all select s.id, 'style_mixing' as error_type, s.base as new, 'style' as mode from {sentences} as s where {own} and s.function in ('report', 'notice', 'scheduling', 'giving')"
    )
    return (
        f"select {hint}s.{key}, s.nth, e.mode, e.error_type, s.start, s.end_, e.new, s.predicate as gold, md5(concat(s.id, e.error_type)) as m "
        f"from ({ones} union all {whole}) as e join {sentences} as s on s.id = e.id where e.new <> s.predicate"
    )


def chosen_sql(proposals: str, sentences: str, key: str = "conv_id") -> str:
    """The errors of each mail: all of one mode, one a sentence.  sasete is taken where a mail has
    three sentences for it, style in a third of the other mails of three sentences or more."""
    sizes = f"select {key}, count(*) as n from {sentences} group by {key}"
    can = f"select {key}, count(distinct case when mode = 'sasete' then nth end) as n_sasete, count(distinct case when mode = 'style' then nth end) as n_style from {proposals} group by {key}"
    mode = f"case when n_sasete >= {MOST} then 'sasete' when {draw('z.k', 3, '3')} = 0 and n_style >= 1 and n >= 3 then 'style' else 'one' end"
    modes = f"select z.{key}, {mode} as mode from (select c.*, s.n, md5(coalesce(cast(c.{key} as string), '')) as k from ({can}) as c join ({sizes}) as s on c.{key} is not distinct from s.{key}) as z"
    kept = f"select p.*, row_number() over (partition by p.{key}, p.nth order by p.m) as r from {proposals} as p join ({modes}) as w on w.{key} is not distinct from p.{key} and w.mode = p.mode"
    ranked = f"select *, row_number() over (partition by {key} order by m) as o from ({kept}) as x where r = 1"
    return f"select {key}, nth, mode, error_type, start, end_, new, gold from ({ranked}) as y where o <= case when mode = 'style' then 1 else {MOST} end"


def choices_table(spark: SparkSession) -> DataFrame:
    """choices_sql() as a local relation, made once a session: its size is fixed by the rule
    tables (templates x actors x verbs)."""
    if not spark.catalog.tableExists("hinoki_choices"):
        with C.plain_stages(spark):
            spark.createDataFrame(spark.sql(choices_sql(G.candidates_view(spark))).collect()).createOrReplaceTempView("hinoki_choices")
    return spark.table("hinoki_choices")


class Mails:
    """The steps above on a table of threads, each a DataFrame.  Sentences, proposals, errors and the
    damaged mails are written once: every other step reads some of them several times.

    Their files are a small part of what the rows take in memory, so Spark would broadcast them by
    the files' sizes, and the driver would hold a whole table: those that grow are merged."""

    def __init__(self, spark: SparkSession, threads: DataFrame, key: str = "conv_id"):
        self.spark, self.key = spark, key
        choices = F.broadcast(choices_table(spark))
        planned = spark.sql(planned_sql("{t}", key), t=threads.select(key, "turn", "role", "text"))
        self.sentences = C.materialize(spark.sql(sentences_sql("{p}", "{c}", key), p=planned, c=choices), "mail-sentences")

    @cached_property
    def pieces(self) -> DataFrame:
        return self.spark.sql(pieces_sql("{s}", self.key), s=self.sentences)

    @cached_property
    def proposals(self) -> DataFrame:
        view = G.candidates_view(self.spark)
        with C.plain_stages(self.spark):
            return C.materialize(self.spark.sql(proposals_sql("{s}", view, self.key, "/*+ merge(s) */ "), s=self.sentences), "mail-proposals").hint("merge")

    @cached_property
    def errors(self) -> DataFrame:
        return C.materialize(self.spark.sql(chosen_sql("{p}", "{s}", self.key), p=self.proposals, s=self.sentences), "mail-errors").hint("merge")

    def placed(self) -> DataFrame:
        """Pieces with start and end in the mail."""
        return S.placed(self.pieces, self.key, "nth", "piece", 1)

    def texts(self) -> DataFrame:
        """(key, text): whole mails, each piece on lines of its own."""
        return whole(self.pieces, self.key)

    def edit_log(self) -> DataFrame:
        """The chosen errors with start and end in the clean mail (old_start, old_end) and in the
        damaged one (start, end): what the edits to the left add or take shifts a span."""
        at = self.placed().where("id is not null").select(F.col(self.key).alias("_k"), F.col("nth").alias("_n"), F.col("start").alias("at"))
        e = self.errors.join(at, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col("nth") == F.col("_n"))).drop("_k", "_n")
        e = e.withColumns({"old_start": F.col("at") + F.col("start"), "old_end": F.col("at") + F.col("end_")})
        return rebased(e.select(self.key, "nth", "mode", "error_type", "old_start", "old_end", "new", "gold"), self.key)

    def damaged(self) -> DataFrame:
        """(key, text): the mails that have errors, with all of them in."""
        return self._damaged

    @cached_property
    def _damaged(self) -> DataFrame:
        log = self.errors.select(F.col(self.key).alias("_k"), F.col("nth").alias("_n"), F.col("start").alias("s"), F.col("end_").alias("e"), "new")
        p = self.pieces.join(log, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col("nth") == F.col("_n")), "left")
        cut = F.concat(F.substr("piece", F.lit(1), F.col("s")), F.col("new"), F.substr("piece", F.col("e") + 1))
        p = p.select(self.key, "nth", F.coalesce(cut, F.col("piece")).alias("piece"), F.col("_n").isNotNull().alias("hit"))
        return C.materialize(whole(p, self.key, F.max("hit")).where("extra").drop("extra"), "mail-damaged").hint("merge")

    def persons(self) -> DataFrame:
        """(key, audience, writer, recipient, persons): the context of each mail."""
        one = F.when(F.col("person").isNotNull(), F.struct(F.col("person").alias("name"), F.col("actor").alias("side")))
        return self.sentences.groupBy(self.key, "audience").agg(F.lit(WRITER).alias("writer"), F.lit(RECIPIENT).alias("recipient"), F.array_sort(F.collect_set(one)).alias("persons"))

    def inversions(self) -> DataFrame:
        """External mails in which one's own side stands higher than the other: (key, text,
        start, end of both spans as rows, surface, gold, persons).  The persons are the mail's own
        where it has some."""
        who = lambda side, other: F.coalesce(F.get(F.filter("persons", lambda p: p["side"] == side), F.lit(0))["name"], F.lit(other))
        c = self.persons().where("audience = 'external'").withColumns({"own": who("self_group", PEOPLE[0][1][0]), "other": who("addressee_group", PEOPLE[1][1][0])})
        opening = F.lit(SALUTATIONS[0][1] + "\n" + G.OPENINGS[0][1] + "\n")
        first, second = F.concat(F.lit("弊社の"), "own", F.lit("が")), F.concat(F.lit("。\n貴社の"), "other", F.lit("様が"))
        high, low = F.lit("おっしゃいました"), F.lit("申しました")
        text = F.concat(opening, first, high, second, low, F.lit("。\n" + G.CLOSING))
        s1 = F.length(opening) + F.length(first)
        s2 = s1 + F.length(high) + F.length(second)
        span = lambda s, w, gold: F.struct(s.alias("start"), (s + F.length(w)).alias("end"), w.alias("surface"), gold.alias("gold"))
        return c.select(self.key, text.alias("text"), "audience", "writer", "recipient", "persons", F.explode(F.array(span(s1, high, low), span(s2, low, high))).alias("e")).select("*", "e.*").drop("e")


def whole(pieces: DataFrame, key: str, extra=None) -> DataFrame:
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "piece"))), lambda x: x["piece"]), "\n").alias("text")
    return pieces.groupBy(key).agg(parts, *([extra.alias("extra")] if extra is not None else []))


def rebased(log: DataFrame, key: str) -> DataFrame:
    """log (key, old_start, old_end, new, ...) with start and end after all edits of the key are
    made: running sums of the length changes before a span.  Spans don't overlap."""
    before = W.partitionBy(key).orderBy("old_start").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("new") - (F.col("old_end") - F.col("old_start"))).over(before), F.lit(0))
    return log.withColumn("start", (F.col("old_start") + shift).cast("int")).withColumn("end", (F.col("start") + F.length("new")).cast("int"))


def dataset(sources: list[tuple[str, DataFrame]], share: tuple[int, int] = (80, 10)) -> DataFrame:
    """The union of sources (id, text, source_text, n_errors), each text once (that of the first
    source, then of the smallest id), with its source's name and a split.

    The split is a threshold on the hash of source_text, so all variants of a text are in one
    split, and a row's split needs no other row."""
    every = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(F.lit(rank).alias("rank"), F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "text", "source_text", F.col("n_errors").cast("int").alias("n_errors"))
        every = part if every is None else every.unionByName(part)
    once = every.where("text is not null").groupBy("text").agg(F.min(F.struct("rank", "id", "source", "source_text", "n_errors")).alias("r")).select("text", "r.*")
    # Equal source texts share a place between 0 and 99.
    at = F.pmod(F.conv(F.substring(F.md5(F.coalesce("source_text", F.lit(""))), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    split = F.when(at < share[0], "train").when(at < sum(share), "validation").otherwise("test")
    return once.select("id", "source", "text", "source_text", "n_errors", split.alias("split"))


def card(rows: DataFrame) -> DataFrame:
    """Rows, errors and characters by source and split, with totals (null stands for all)."""
    return rows.rollup("source", "split").agg(F.count("*").alias("n"), F.sum("n_errors").alias("n_errors"), F.sum(F.length("text")).alias("n_chars"))
