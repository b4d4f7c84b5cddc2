"""Queries over mails made from the threads of conversations, and their SQL.

The making of sentences (operators/mails.py) is one SQL text for both engines; everything behind
it (offsets, re-basing, persons, pieces, labels, splits) is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morph as M
from ..llm import common as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import generate as G
from ..operators import labels as LB
from ..operators import mails as MA
from ..operators import report as RP
from ..operators import tagger as TG
from ..operators import text as X

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle.replace("as string)", "as varchar)")
        return f

    return put


def mails(spark: SparkSession, sf_dir: str) -> MA.Mails:
    return MA.Mails(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


MADE = (
    f"cand as materialized ({G.candidates_sql()}), choices as materialized ({MA.choices_sql('cand')}), planned as ({MA.planned_sql('conversations')}), "
    f"sentences as materialized ({MA.sentences_sql('planned', 'choices')}), pieces as ({MA.pieces_sql('sentences')}), "
    "placed as (select p.*, (select coalesce(sum(length(q.piece) + 1), 0) from pieces q where q.conv_id is not distinct from p.conv_id and q.nth < p.nth)::int as at from pieces p), "
    f"proposals as materialized ({MA.proposals_sql('sentences', 'cand')}), errors as materialized ({MA.chosen_sql('proposals', 'sentences')}), "
    "log as (select e.*, p.at + e.start as old_start, p.at + e.end_ as old_end from errors e join placed p on p.conv_id is not distinct from e.conv_id and p.nth = e.nth), "
    "moved as (select l.*, (l.old_start + (select coalesce(sum(length(o.new) - (o.old_end - o.old_start)), 0) from log o where o.conv_id is not distinct from l.conv_id and o.old_start < l.old_start))::int as at from log l), "
    "damaged as (select p.conv_id, string_agg(case when e.nth is null then p.piece else substring(p.piece, 1, e.start) || e.new || substring(p.piece, e.end_ + 1) end, chr(10) order by p.nth) as text "
    "from pieces p left join errors e on e.conv_id is not distinct from p.conv_id and e.nth = p.nth group by p.conv_id having count(e.nth) > 0)"
)


@query(f"with {MADE} select conv_id, nth, function, actor, person, audience, base, cls, origin, text, start, end_, predicate from sentences")
def mail_sentences(spark, sf_dir):
    """The sentences of a mail for each thread: a plan, preferred forms, endings, persons."""
    return mails(spark, sf_dir).sentences.drop("id")


@query(f"with {MADE} select conv_id, string_agg(piece, chr(10) order by nth) as text, count(*) as n_pieces from pieces group by conv_id")
def mail_texts(spark, sf_dir):
    m = mails(spark, sf_dir)
    return m.texts().join(m.pieces.groupBy(F.col("conv_id").alias("k")).agg(F.count("*").alias("n_pieces")), F.col("conv_id").eqNullSafe(F.col("k"))).drop("k")


@query(f"with {MADE}, p as (select distinct conv_id, actor as side, person as name from sentences where person is not null) select conv_id, side, name, (select min(nth) from sentences s where s.conv_id is not distinct from p.conv_id and s.actor = p.side and s.person = p.name)::int as since from p")
def mail_persons(spark, sf_dir):
    """The persons of each mail, and the sentence that brings each in: one a side."""
    s = mails(spark, sf_dir).sentences.where("person is not null")
    return s.groupBy("conv_id", F.col("actor").alias("side"), F.col("person").alias("name")).agg(F.min("nth").cast("int").alias("since"))


@query(f"with {MADE} select m.conv_id, m.nth, m.mode, m.error_type, m.at as start, (m.at + length(m.new))::int as end_, m.new as surface, m.gold, substring(d.text, m.at + 1, length(m.new)) = m.new as verified from moved m join damaged d on d.conv_id is not distinct from m.conv_id")
def mail_errors(spark, sf_dir):
    """The edit log of each damaged mail, spans re-based onto the damaged text."""
    m = mails(spark, sf_dir)
    log = m.edit_log().withColumnRenamed("conv_id", "k")
    out = log.join(m.damaged(), F.col("k").eqNullSafe(F.col("conv_id")))
    return out.select("conv_id", "nth", "mode", "error_type", "start", F.col("end").alias("end_"), F.col("new").alias("surface"), "gold", (F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("new")).alias("verified"))


INVERTED = (
    f"who as (select conv_id, audience, coalesce(min(person) filter (actor = 'self_group'), '{MA.PEOPLE[0][1][0]}') as own, coalesce(min(person) filter (actor = 'addressee_group'), '{MA.PEOPLE[1][1][0]}') as other from sentences where audience = 'external' group by all), "
    f"inv as (select conv_id, concat({M.quote(MA.SALUTATIONS[0][1] + chr(10) + G.OPENINGS[0][1] + chr(10))}, '弊社の', own, 'が') as a, concat('。', chr(10), '貴社の', other, '様が') as b from who), "
    f"inv_text as (select conv_id, concat(a, 'おっしゃいました', b, '申しました', '。', chr(10), {M.quote(G.CLOSING)}) as text, length(a) as s1, length(a) + 8 + length(b) as s2 from inv)"
)


@query(f"with {MADE}, {INVERTED} select conv_id, text, s1::int as start, (s1 + 8)::int as end_, 'おっしゃいました' as surface, '申しました' as gold from inv_text union all select conv_id, text, s2::int, (s2 + 5)::int, '申しました', 'おっしゃいました' from inv_text")
def inversion_mails(spark, sf_dir):
    """Mails in which one's own side stands above the other."""
    return mails(spark, sf_dir).inversions().select("conv_id", "text", "start", F.col("end").alias("end_"), "surface", "gold")


def dataset(spark, sf_dir) -> DataFrame:
    m = mails(spark, sf_dir)
    clean = m.texts().withColumnRenamed("text", "source_text")
    broken = m.damaged().withColumnRenamed("conv_id", "k").join(clean, F.col("k").eqNullSafe(F.col("conv_id"))).drop("k")
    sizes = m.errors.groupBy(F.col("conv_id").alias("k")).agg(F.count("*").alias("n_errors"))
    broken = broken.join(sizes, F.col("k").eqNullSafe(F.col("conv_id"))).drop("k")
    one = lambda df, source, n: df.select(F.col("conv_id").alias("id"), "text", F.expr(source).alias("source_text"), F.expr(n).alias("n_errors"))
    single = m.sentences.select(F.col("id"), "text", F.col("text").alias("source_text"), F.lit(0).alias("n_errors"))
    inverted = m.inversions().groupBy("conv_id", "text").agg(F.count("*").alias("n_errors"))
    return MA.dataset([("sentence", single), ("mail", one(clean.withColumn("text", F.col("source_text")), "source_text", "0")), ("errors", one(broken, "source_text", "n_errors")), ("inversion", one(inverted, "text", "n_errors"))])


ROWS = (
    f"{MADE}, {INVERTED}, whole as (select conv_id, string_agg(piece, chr(10) order by nth) as text from pieces group by conv_id), "
    "every as (select 0 as rank, id, 'sentence' as source, text, text as source_text, 0 as n_errors from sentences union all select 1, conv_id::varchar, 'mail', text, text, 0 from whole "
    "union all select 2, d.conv_id::varchar, 'errors', d.text, w.text, (select count(*) from errors e where e.conv_id is not distinct from d.conv_id) from damaged d join whole w on w.conv_id is not distinct from d.conv_id "
    "union all select 3, conv_id::varchar, 'inversion', text, text, 2 from inv_text), "
    "once as (select * from every qualify row_number() over (partition by text order by rank, id) = 1), "
    "data as (select id, source, text, source_text, n_errors::int as n_errors, case when place < 80 then 'train' when place < 90 then 'validation' else 'test' end as split from (select *, ('0x' || md5(source_text)[1:8])::bigint % 100 as place from once))"
)


@query(f"with {ROWS} select * from data")
def mail_dataset(spark, sf_dir):
    """All sources, each text once, with a split that keeps the variants of a text together."""
    return dataset(spark, sf_dir)


@query(f"with {ROWS} select source, split, count(*) as n, sum(n_errors)::bigint as n_errors, sum(length(text))::bigint as n_chars from data group by rollup (source, split)")
def mail_dataset_card(spark, sf_dir):
    return MA.card(dataset(spark, sf_dir))


DUCK_PIECE = M.quote(LB.PIECE)


@query(
    f"with {MADE}, who as (select conv_id, audience, coalesce(string_agg(distinct person, '/' order by person) filter (actor = 'self_group'), '') as own, "
    "coalesce((select string_agg(name, '/' order by name, side) from (select distinct person as name, actor as side from sentences t where t.conv_id is not distinct from s.conv_id and actor in ('addressee_group', 'third_party'))), '') as other from sentences s group by all), "
    "pre as (select conv_id, '[' || audience || ']' || case when own <> '' then '[own:' || own || ']' else '' end || case when other <> '' then '[other:' || other || ']' else '' end || ' ' as prefix from who), "
    "body as (select d.conv_id, d.text, p.prefix, len(regexp_extract_all(p.prefix, {0})) as k from damaged d join pre p on p.conv_id is not distinct from d.conv_id), "
    "cut as (select conv_id, k, regexp_extract_all(text, {0}) as m, regexp_split_to_array(text, {0}) as gaps from body), "
    "own_ as (select conv_id, k, i, m[i] as raw, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::int as start from cut, unnest(range(1, len(m) + 1)) as u(i)), "
    "placed_ as (select conv_id, ((i - 1) // greatest(64 - k, 1))::int as win, (k + (i - 1) % greatest(64 - k, 1))::int as pos, start, (start + length(raw))::int as end_, raw from own_), "
    "hit as (select t.conv_id, t.win, t.pos, m.at as e_start, m.error_type, row_number() over (partition by t.conv_id, t.win, t.pos order by m.at) as r from placed_ t join moved m on m.conv_id is not distinct from t.conv_id and t.start < m.at + length(m.new) and m.at < t.end_), "
    "named as (select *, row_number() over (partition by conv_id, win, e_start order by pos) as b from hit where r = 1) "
    "select t.conv_id, t.win, t.pos, t.start, t.end_, t.raw as surface, case when n.r is null then 'O' when n.b = 1 then 'B-' || n.error_type else 'I-' || n.error_type end as label "
    "from placed_ t left join named n on n.conv_id is not distinct from t.conv_id and n.win = t.win and n.pos = t.pos".replace("{0}", DUCK_PIECE)
)
def subword_labels(spark, sf_dir):
    """Pieces of the damaged mails with BIO labels; those of the context, masked before them, go."""
    m = mails(spark, sf_dir)
    who = m.persons().select(F.col("conv_id").alias("k"), LB.context(F.col("audience"), F.col("persons")).alias("prefix"))
    span = F.struct("start", "end", F.col("error_type").alias("type"))
    log = m.edit_log().groupBy(F.col("conv_id").alias("c")).agg(F.collect_list(span).alias("spans"))
    texts = m.damaged().join(who, F.col("conv_id").eqNullSafe(F.col("k"))).join(log.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return LB.labelled_texts(texts, "conv_id", "spans", prefix="prefix", window=64).withColumnRenamed("end", "end_")


@query()
def tagger_scores(spark, sf_dir):
    """A tagger trained on the sentences of four mails in five, scored on the others."""
    m = mails(spark, sf_dir)
    rows, gold = sentence_examples(m)
    marked = LB.labelled(C.materialize(LB.pieces(rows, "sid"), "mail-pieces"), gold, "sid")
    held = F.pmod(F.xxhash64(F.substring_index("sid", "|", 1)), F.lit(5)) == 0
    seqs = C.materialize(TG.sequences(marked, "sid"), "mail-sequences")  # read once a round
    weights = TG.train(seqs.where(~held))
    found = LB.spans(TG.tag(seqs.where(held), weights, "sid"), "sid")
    return TG.scores(gold.where(held), found, "sid")


def sentence_examples(m: MA.Mails) -> tuple[DataFrame, DataFrame]:
    """Clean sentences and every error a sentence may get: (sid, text) and the gold spans."""
    p = m.proposals.withColumnRenamed("conv_id", "k").withColumnRenamed("nth", "n").select("k", "n", "error_type", "new")
    s = m.sentences
    bad = s.join(p, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("nth") == F.col("n")))
    sid = F.concat_ws("|", "id", "error_type")
    text = F.concat(F.substr("text", F.lit(1), F.col("start")), F.col("new"), F.substr("text", F.col("end_") + 1))
    bad = bad.where("error_type not in ('style_mixing', 'sasete_itadaku_overuse')")  # those are errors of a whole mail
    gold = bad.select(sid.alias("sid"), "start", (F.col("start") + F.length("new")).alias("end"), F.col("error_type").alias("type"))
    return bad.select(sid.alias("sid"), text.alias("text")).unionByName(s.select(F.concat_ws("|", "id", F.lit("clean")).alias("sid"), "text")), gold


@query()
def mail_recall(spark, sf_dir):
    """Recall by type of the detector on damaged and inverted mails, whole-text errors included."""
    found, gold = judged(spark, sf_dir)
    return E.recall(E.matched(gold, found, "doc_id"))


def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = mails(spark, sf_dir)
    who = m.persons().withColumnRenamed("conv_id", "k")
    docs = m.damaged().join(who, F.col("conv_id").eqNullSafe(F.col("k"))).select(F.concat_ws("|", "conv_id", F.lit("e")).alias("doc_id"), "text", "audience", "writer", "recipient", "persons")
    inv = m.inversions().withColumn("doc_id", F.concat_ws("|", "conv_id", F.lit("i")))
    every = docs.unionByName(inv.select(docs.columns).dropDuplicates(["doc_id"]))
    gold = m.edit_log().select(F.concat_ws("|", "conv_id", F.lit("e")).alias("doc_id"), "start", "end", F.col("error_type").alias("type"))
    gold = gold.unionByName(inv.select("doc_id", "start", "end", F.lit("rank_inversion").alias("type")))
    return D.detect(C.materialize(X.cut(every), "mail-lines")), gold


@query(f"with {MADE}, " + RP.pivot_sql("(select error_type as type, mode as source from moved)", "type", "source", ["one", "sasete", "style"]))
def mail_error_report(spark, sf_dir):
    """Errors by type and kind of damage as the lines of a Markdown table, with totals."""
    log = mails(spark, sf_dir).errors
    return RP.pivot(log.select(F.col("error_type").alias("type"), F.col("mode").alias("source")), "type", "source", ["one", "sasete", "style"])
