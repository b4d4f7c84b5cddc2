"""Who acts in each predicate, and towards whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.lexicon import lexicon
from . import text as X

STRONG = 0.7


def is_in(c: Column, side: int) -> Column:
    """side 1: the writer's side, 2: the other side."""
    return c.isin([p[0] for p in T.PARTIES if p[side]])


def marker_party(phrase: Column) -> Column:
    """The party of the longest marker contained, else unknown."""
    ranked = sorted(T.MARKERS, key=lambda m: -len(m[0]))  # stable: the first of equally long ones
    out = F.when(phrase.contains(ranked[0][0]), ranked[0][1])
    for word, party in ranked[1:]:
        out = out.when(phrase.contains(word), party)
    return out.otherwise("unknown")


def context_party(phrase: Column) -> Column:
    """By name: persons first, then the writer, then the recipient."""
    named = F.try_element_at(F.filter("persons", lambda p: (p["name"] != "") & phrase.contains(p["name"])), F.lit(1))["side"]
    by = lambda c, party: F.when((F.col(c) != "") & phrase.contains(F.col(c)), F.lit(party))
    return F.coalesce(named, by("writer", "self"), by("recipient", "addressee"), F.lit("unknown"))


def resolve(phrase: Column) -> Column:
    """struct<party, conf> of a noun phrase."""
    p = F.trim(phrase)
    who = lambda party, conf: F.struct(party.alias("party"), F.lit(conf).cast("double").alias("conf"))
    c, m = context_party(p), marker_party(p)
    same = (is_in(c, 1) & is_in(m, 1)) | (is_in(c, 2) & is_in(m, 2))
    titled = F.lit(False)
    for s in T.HONORIFIC_SUFFIXES:
        titled = titled | p.endswith(s)
    return (
        F.when(p == "", who(F.lit("unknown"), 0.0))
        .when((c != "unknown") & (m != "unknown"), F.when(same, who(c, 0.95)).otherwise(who(m, 0.6)))
        .when(c != "unknown", who(c, 0.9))
        .when(m != "unknown", who(m, 0.85))
        .when(titled, who(F.lit("addressee_group"), 0.6))
        .otherwise(who(F.lit("unknown"), 0.0))
    )


def sentence_function(s: Column) -> Column:
    has = lambda cues: F.array_contains(F.array(*(s.contains(c) for c in cues)), True)
    return F.when(has(T.REQUEST_CUES), "request").when(has(T.QUESTION_CUES), "question").otherwise("report")


def tag(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a predicate: key, sent_idx, start, end, surface, form, cls, origin, base,
    actor, actor_conf, target, function, link.

    messages: key (unique), text, audience, writer, recipient, persons
    array<struct<name, side>>.  The actor is the nearest subject that resolves, else
    what a giving or receiving verb implies, else a source phrase, else the actor of
    the last strong predicate of an earlier sentence, else the sentence function's
    default.  All regrouping is by key, so the steps share one partitioning.
    """
    sents = X.script_sentences(messages).select(key, "audience", "writer", "recipient", "persons", "_nth", "sent_idx", "sent_start", "sentence")
    found = X.scan(sents, lexicon(messages.sparkSession), [key, "_nth"])
    rows = found.join(sents, [key, "_nth"])
    heard = F.transform(X.phrases(F.substr("sentence", F.lit(1), F.col("p_start"))), lambda p: F.struct(p["particle"].alias("particle"), resolve(p["body"]).alias("who")))
    rows = rows.withColumn("heard", heard)
    last = lambda particles: F.try_element_at(F.filter("heard", lambda p: p["particle"].isin(particles) & (p["who"]["party"] != "unknown")), F.lit(-1))["who"]
    who = lambda party, conf: F.struct(F.lit(party).alias("party"), F.lit(conf).cast("double").alias("conf"))
    given = F.when(F.col("hint") == "self", who("self", 0.8)).when(F.col("hint") == "other", who("addressee", 0.8))
    rows = rows.withColumn("open", F.coalesce(last(T.ACTOR_PARTICLES), given)).withColumn("source", last(T.SOURCE_PARTICLES)["party"]).withColumn("goal", last(T.TARGET_PARTICLES))
    rows = rows.withColumn("function", sentence_function(F.col("sentence")))
    strong = F.when(F.col("open.conf") >= STRONG, F.col("open.party"))
    per = rows.groupBy(key, "_nth").agg(F.max_by(strong, F.when(strong.isNotNull(), F.col("p_start"))).alias("strong"))
    before = W.partitionBy(key).orderBy("_nth").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select(key, "_nth", F.last("strong", ignorenulls=True).over(before).alias("carried"))
    rows = rows.join(carried, [key, "_nth"])
    default = F.when(F.col("function").isin("request", "question"), F.lit("addressee")).otherwise("self")
    actor = F.coalesce(F.col("open.party"), F.col("source"), F.col("carried"), default)
    conf = F.coalesce(F.col("open.conf"), F.when(F.col("source").isNotNull(), 0.6), F.when(F.col("carried").isNotNull(), 0.55), F.lit(0.5))
    rows = rows.withColumn("actor", actor).withColumn("actor_conf", F.round(conf, 2))
    target = F.coalesce(
        F.col("goal.party"),
        F.when((F.col("hint") == "self") & is_in(F.col("actor"), 1), "addressee").when((F.col("hint") == "other") & is_in(F.col("actor"), 2), "self"),
        F.lit("unknown"),
    )
    link = F.when((F.col("origin") == "link") & F.col("form").isin(T.GOOD_LINKS), "acceptable").when((F.col("origin") == "link") & (F.col("form").isin(T.BAD_LINKS) | F.col("surface").isin(T.BAD_LINKS)), "inappropriate").otherwise("")
    return rows.select(
        key, "audience", "sent_idx", (F.col("sent_start") + F.col("p_start")).alias("start"), (F.col("sent_start") + F.col("p_end")).alias("end"),
        "surface", "form", "cls", "origin", "base", "actor", "actor_conf", target.alias("target"), "function", link.alias("link"),
    )


def audience_meta(roles: DataFrame) -> DataFrame:
    """roles with self_side_raisable (may one's own senior be raised before this reader),
    uchi_soto and citations; nothing is judged here."""
    own, inside = is_in(F.col("actor"), 1), F.col("audience") == "internal"
    keys = F.when(~own, F.array(F.lit("principle.self_not_raised"))).when(inside, F.array(F.lit("uchi_soto.q26"), F.lit("uchi_soto.q25"))).otherwise(F.array(F.lit("uchi_soto.q25"), F.lit("principle.self_not_raised")))
    state = F.when(own, F.when(inside, "internal_own_senior_may_be_raised").otherwise("external_self_side_not_raised"))
    return roles.withColumns({"self_side_raisable": own & inside, "uchi_soto": state, "citations": F.array_join(keys, ",")})
