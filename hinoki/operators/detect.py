"""Detection of divergent honorific usage, told apart from divided usage.

Each family of hits is a DataFrame of one shape; their union is suppressed greedily
in a fold per message, and a hit on registered divided usage gets that verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import morph as M
from ..functions import tables as T
from . import roles as R
from . import spans as S
from . import text as X

FIELDS = ["start", "end", "surface", "error_type", "confidence", "citation_key", "forced", "seq"]


def shape(df: DataFrame, key: str, kind, conf, cite, seq, forced=None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(key, "start", "end", "surface", lit(kind).alias("error_type"), lit(conf).cast("double").alias("confidence"), lit(cite).alias("citation_key"), (F.lit(False) if forced is None else forced).alias("forced"), lit(seq).cast("double").alias("seq"))


def direction(key: str = "doc_id") -> tuple[Column, Column, Column, Column]:
    """(error type or null, confidence, citation, forced variation) of a role: respect
    or humility pointing the wrong way, for predicates whose actor is clear."""
    own, other = R.is_in(F.col("actor"), 1), R.is_in(F.col("actor"), 2)
    clear = (F.col("actor_conf") >= R.STRONG) & (F.col("link") != "acceptable")
    outside = F.col("audience") == "external"
    raised, humble1, humble2 = (F.col("cls") == c for c in ("sonkeigo", "kenjougo_1", "kenjougo_2"))
    group = F.col("actor") == "self_group"
    kind = (
        F.when(own & raised, F.when(group, "uchi_sonkeigo").otherwise("self_sonkeigo"))
        .when(other & humble1, F.when(F.col("surface").rlike(T.BAD_LINK), "bad_keigo_link").otherwise("direction_swap"))
        .when(other & humble2 & (F.col("actor") != "addressee"), "direction_swap")
    )
    base = F.when(own & raised & group, F.when(outside, 0.9).otherwise(0.5)).when((own & raised) | (other & humble1), 0.85).otherwise(0.6)
    cite = (
        F.when(own & raised, F.when(group, F.when(outside, "uchi_soto.q25").otherwise("uchi_soto.q26")).otherwise("self_sonkeigo.q16"))
        .when(other & humble1, F.when(F.col("surface").rlike(T.BAD_LINK), "keigo_link.bad").otherwise("direction.q11"))
        .otherwise("direction.q13")
    )
    return F.when(clear, kind), base * F.col("actor_conf"), cite, own & raised & group & ~outside


def direction_hits(roles: DataFrame, key: str = "doc_id") -> DataFrame:
    kind, conf, cite, forced = direction(key)
    return shape(roles.where(kind.isNotNull()), key, kind, conf, cite, F.col("start") * 1e-6, forced)


def sa_literals() -> list[str]:
    """Irrealis + させ of every godan verb of the table."""
    ends = {r[0]: r[2] for r in T.GODAN}
    return [v[0][:-1] + ends[v[0][-1]] + "させ" for v in T.VERBS if v[1] == "godan"]


def double_hits(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Doubled honorifics but the established ones (by a window around the match)."""
    out = []
    for i, p in enumerate(T.DOUBLE_PATTERNS):
        hit = X.finditer(messages, p)
        near = F.substr("text", F.greatest(F.col("start") - 2, F.lit(0)) + 1, F.col("end") + 4 - F.greatest(F.col("start") - 2, F.lit(0)))
        fine = reduce(lambda a, b: a | b, [near.contains(e[0]) for e in T.ESTABLISHED])
        out.append(shape(hit.where(~fine), key, "double_keigo", 0.9, "double_keigo", 1 + i * 0.01 + F.col("start") * 1e-6))
    return reduce(DataFrame.unionByName, out)


def sa_hits(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The literals never overlap, so one alternation finds what one pattern each would."""
    return shape(X.finditer(messages, X.any_of(sa_literals())), key, "sa_insertion", 0.9, "sa_insertion", 2 + F.col("start") * 1e-6)


def go_sareru_hits(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    return shape(X.finditer(messages, T.GO_SARERU), key, "go_sareru", 0.8, "go_sareru.q7", 3 + F.col("start") * 1e-6)


def ogo_dekiru_hits(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    return shape(X.finditer(messages, T.OGO_DEKIRU), key, "ogo_dekiru", 0.7, "ogo_dekiru.q8", 4 + F.col("start") * 1e-6)


def stretched(df: DataFrame, stop: str, to: Column) -> DataFrame:
    """Spans prolonged to the next stop character, no farther than to."""
    more = F.length(F.regexp_extract(F.substr(F.col("text"), F.col("end") + 1), f"^[^{stop}]*", 0))
    out = df.withColumn("end", F.least(F.col("end") + more, to))
    return out.withColumn("surface", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))


def bad_link_hits(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    hit = stretched(X.finditer(messages, T.BAD_LINK), "。\\n、", F.col("start") + 12)
    return shape(hit, key, "bad_keigo_link", 0.75, "keigo_link.bad", 5 + F.col("start") * 1e-6)


def sasete_hits(messages: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Overuse, only in messages with at least that many."""
    dense = messages.where(F.size(F.regexp_extract_all("text", F.lit(T.SASETE), F.lit(0))) >= least)
    hit = stretched(X.finditer(dense, T.SASETE), "。\\n", F.col("end") + 6)
    return shape(hit, key, "sasete_itadaku_overuse", 0.6, "sasete_itadaku", 6 + F.col("start") * 1e-6)


def styles(messages: DataFrame, key: str = "doc_id", split=X.sentences) -> DataFrame:
    """(key, sent_start, body, style): polite or plain sentences; split: X.script_sentences for
    those alone that can have a style."""
    s = split(messages).select(key, "sent_start", F.regexp_replace("sentence", "[。！？\\n 　]+$", "").alias("body"))
    style = F.when(F.col("body").rlike(T.POLITE_END), "polite").when(F.col("body").rlike(T.PLAIN_END), "plain")
    return s.withColumn("style", style)


def style_majority(messages: DataFrame, key: str = "doc_id", split=X.sentences) -> DataFrame:
    """(key, n_sentences, n_polite, n_plain, majority): of messages with three sentences
    and three classified ones; a tie goes to the style seen first."""
    counts = styles(messages, key, split).groupBy(key).agg(
        F.count("*").alias("n_sentences"), F.count_if(F.col("style") == "polite").alias("n_polite"), F.count_if(F.col("style") == "plain").alias("n_plain"),
        F.min_by("style", F.when(F.col("style").isNotNull(), F.col("sent_start"))).alias("first"),
    )
    major = F.when(F.col("n_polite") > F.col("n_plain"), "polite").when(F.col("n_polite") < F.col("n_plain"), "plain").otherwise(F.col("first"))
    return counts.where("n_sentences >= 3 and n_polite + n_plain >= 3").withColumn("majority", major).drop("first")


def style_minority(messages: DataFrame, key: str = "doc_id", polite: str = T.POLITE_END, plain: str = T.BASELINE_PLAIN_END) -> DataFrame:
    """(key, start, end, surface): the last eight characters of each sentence in the rarer style
    (plain ones on a tie), where both styles and three classified sentences are there.  All of it
    in the row: no shuffle.  Null and empty texts have none."""
    style = lambda b: F.when(b.rlike(polite), "polite").when(b.rlike(plain), "plain")
    body = lambda s, n: F.struct(n.alias("start"), F.regexp_replace(s, "[。！？\\n 　]+$", "").alias("body"))
    told = lambda x: F.struct(x["start"].alias("start"), x["body"].alias("body"), style(x["body"]).alias("style"))
    parts = F.regexp_extract_all("text", F.lit(X.SENTENCE), F.lit(0))
    all_ = X.let(parts, lambda p: F.transform(F.zip_with(p, X.offsets(F.transform(p, F.length)), body), told))

    def rarer(a):
        n = {s: F.size(F.filter(a, lambda x: x["style"] == s)) for s in ("polite", "plain")}
        odd = F.filter(a, lambda x: x["style"] == F.when(n["plain"] <= n["polite"], "plain").otherwise("polite"))
        return F.when((n["polite"] > 0) & (n["plain"] > 0) & (n["polite"] + n["plain"] >= 3), odd)

    found = X.exploded(X.core(messages), X.let(all_, rarer), "x")
    end = F.col("_at") + F.col("x.start") + F.length("x.body")
    return found.select(key, (end - F.least(F.length("x.body"), F.lit(8))).alias("start"), end.alias("end"), F.expr("right(x.body, 8)").alias("surface"))


def style_hits(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    mixed = style_majority(messages, key, X.script_sentences).where("n_polite > 0 and n_plain > 0").select(key, "majority")
    odd = styles(messages, key, X.script_sentences).join(mixed, key).where("style <> majority and body <> ''")
    n = F.length("body")
    odd = odd.withColumn("end", F.col("sent_start") + n).withColumn("start", F.col("end") - F.least(n, F.lit(8))).withColumn("surface", F.expr("right(body, 8)"))
    return shape(odd, key, "style_mixing", 0.6, "style_mixing", 7 + F.col("start") * 1e-6)


def inversion(roles: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Column, Column]:
    """(roles with level and side, inside, outside): predicates of external messages
    whose own side stands higher than the reader's, the highest of either side."""
    level = F.lit(0)
    for c, n in T.CLASSES:
        level = F.when(F.col("cls") == c, n).otherwise(level)
    side = F.when(F.col("actor") == "self_group", "in").when(F.col("actor").isin("addressee", "addressee_group"), "out")
    side = F.when((F.col("audience") == "external") & (F.col("actor_conf") >= 0.5), side)
    r = roles.withColumn("level", level).withColumn("side", side)
    top = lambda s: F.max(F.when(F.col("side") == s, F.col("level"))).over(W.partitionBy(key))
    r = r.withColumn("top_in", top("in")).withColumn("top_out", top("out"))
    on = F.coalesce(F.col("top_in") > F.col("top_out"), F.lit(False))
    return r, on & (F.col("side") == "in") & (F.col("level") == F.col("top_in")), on & (F.col("side") == "out") & (F.col("level") == F.col("top_out"))


def inversion_hits(roles: DataFrame, key: str = "doc_id") -> DataFrame:
    r, inside, outside = inversion(roles, key)
    conf = F.when(inside, 0.8).otherwise(0.7) * F.col("actor_conf")
    hit = r.withColumn("inside", inside).where(inside | outside)
    return shape(hit, key, "rank_inversion", conf, "rank_inversion", F.when(F.col("inside"), 8).otherwise(9) + F.col("start") * 1e-6)


def variation_table(spark: SparkSession) -> DataFrame:
    rows = [(s, k, sup, cite, acc, scope, aud) for k, ss, sup, cite, acc, scope, aud in T.VARIATIONS for s in ss.split(" ")]
    return M.inline(spark, rows, "v_surface, v_key, suppressed, v_citation, acceptability, scope, only_for")


def variation_scan(messages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leftmost-longest registered surfaces: key, start2, end2, v_surface, v_key, ...
    Entries bound to an audience take their text but are not applied here."""
    words = sorted((s for v in T.VARIATIONS for s in v[1].split(" ")), key=lambda s: -len(s))
    hit = X.finditer(X.core(messages), X.any_of(words)).select(key, (F.col("_at") + F.col("start")).alias("start2"), (F.col("_at") + F.col("end")).alias("end2"), F.col("surface").alias("v_surface"))
    return hit.join(F.broadcast(variation_table(messages.sparkSession)), "v_surface").where("only_for = ''")


def refuted(text: str = "text") -> Column:
    """True where a regex hit no longer holds in a window around its span."""
    near = lambda a, b: F.substr(F.col(text), F.greatest(F.col("start") - a, F.lit(0)) + 1, F.col("end") + b - F.greatest(F.col("start") - a, F.lit(0)))
    tests = {"sa_insertion": ("|".join(sa_literals()), 4, 4), "go_sareru": (T.GO_SARERU, 2, 6), "ogo_dekiru": (T.OGO_DEKIRU, 2, 8), "double_keigo": ("|".join(T.DOUBLE_PATTERNS), 2, 6)}
    out = F.lit(False)
    for kind, (p, a, b) in tests.items():
        out = out | ((F.col("error_type") == kind) & ~near(a, b).rlike(p))
    return out


def hit_struct(start, end, surface, kind, conf, cite, forced, seq, inside) -> Column:
    cast = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    vals = ((start, "int"), (end, "int"), (surface, "string"), (kind, "string"), (conf, "double"), (cite, "string"), (forced, "boolean"), (seq, "double"), (inside, "boolean"))
    return F.struct(*(cast(v, t).alias(n) for (v, t), n in zip(vals, [*FIELDS, "inside"])))


def role_hits(roles: DataFrame, key: str) -> DataFrame:
    """Direction and inversion hits of all roles in one pass: (key, hit)."""
    r, inside, outside = inversion(roles, key)
    kind, conf, cite, forced = direction(key)
    at = (F.col("start"), F.col("end"), F.col("surface"))
    one = F.when(kind.isNotNull(), hit_struct(*at, kind, conf, cite, forced, F.col("start") * 1e-6, False))
    level = F.when(inside, 0.8).otherwise(0.7) * F.col("actor_conf")
    two = F.when(inside | outside, hit_struct(*at, "rank_inversion", level, "rank_inversion", False, F.when(inside, 8).otherwise(9) + F.col("start") * 1e-6, inside))
    return r.select(key, F.explode(F.array_compact(F.array(one, two))).alias("hit"))


def pattern_hits(messages: DataFrame, key: str) -> DataFrame:
    """The regex families in one pass over the texts: (key, hit)."""
    text = F.col("text")
    families = [(p, "double_keigo", 0.9, "double_keigo", 1 + i * 0.01) for i, p in enumerate(T.DOUBLE_PATTERNS)]
    families += [(X.any_of(sa_literals()), "sa_insertion", 0.9, "sa_insertion", 2), (T.GO_SARERU, "go_sareru", 0.8, "go_sareru.q7", 3), (T.OGO_DEKIRU, "ogo_dekiru", 0.7, "ogo_dekiru.q8", 4)]
    families += [(T.BAD_LINK, "bad_keigo_link", 0.75, "keigo_link.bad", 5), (T.SASETE, "sasete_itadaku_overuse", 0.6, "sasete_itadaku", 6)]

    found = F.array(*(F.when(text.rlike(p), F.struct(*(F.lit(v).alias(n) for v, n in zip((kind, conf, cite, float(seq)), ("kind", "conf", "cite", "seq"))), X.gaps(text, p).alias("found"))) for p, kind, conf, cite, seq in families))
    rows = X.exploded(X.core(messages), F.array_compact(found), "f")
    rows = rows.where((F.col("f.kind") != "sasete_itadaku_overuse") | (F.size("f.found") >= 3))
    rows = X.exploded(rows.select(key, "text", "_at", "f.*"), X.placed(F.col("found")), "m").withColumn("start", F.col("m.start")).withColumn("end", F.col("m.end"))
    first = F.greatest(F.col("start") - 2, F.lit(0))
    near = F.substr(text, first + 1, F.col("end") + 4 - first)
    fine = reduce(lambda a, b: a | b, [near.contains(e[0]) for e in T.ESTABLISHED])
    rows = rows.where(~((F.col("kind") == "double_keigo") & fine))
    more = lambda stop: F.length(F.regexp_extract(F.substr(text, F.col("end") + 1), f"^[^{stop}]*", 0))
    end = (
        F.when(F.col("kind") == "bad_keigo_link", F.least(F.col("end") + more("。\\n、"), F.col("start") + 12))
        .when(F.col("kind") == "sasete_itadaku_overuse", F.least(F.col("end") + more("。\\n"), F.col("end") + 6))
        .otherwise(F.col("end"))
    )
    rows = rows.withColumn("end", end).withColumn("surface", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    rows = rows.withColumns({c: F.col("_at") + F.col(c) for c in ("start", "end")})
    return rows.select(key, hit_struct(*(F.col(c) for c in ("start", "end", "surface", "kind", "conf", "cite")), False, F.col("seq") + F.col("start") * 1e-6, False).alias("hit"))


def detect(messages: DataFrame, key: str = "doc_id", roles: DataFrame | None = None) -> DataFrame:
    """Findings: key, start, end, surface, error_type, verdict (norm_divergence or
    variation), confidence, citation_key, acceptability (of the divided usage).

    All hits of a message meet in one row by key: hits at a span of the own side that
    an inversion names go, the rest are suppressed greedily by specificity, confidence
    and order.  roles: R.tag of the messages, where the caller has them.
    """
    roles = R.tag(messages, key) if roles is None else roles
    style = style_hits(messages, key)
    style = style.select(key, hit_struct(*map(F.col, FIELDS), False).alias("hit"))
    hits = role_hits(roles, key).unionByName(pattern_hits(messages, key)).unionByName(style)
    rank = F.lit(0)
    for code, n, *_ in T.ERROR_TYPES:
        rank = F.when(F.col("hit.error_type") == code, n).otherwise(rank)
    item = F.struct((-rank).alias("_r"), (-F.col("hit.confidence")).alias("_c"), F.col("hit.seq").alias("_s"), *(F.col(f"hit.{f}").alias(f) for f in [*FIELDS, "inside"]))
    grouped = hits.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    taken = lambda x: F.exists("_a", lambda o: o["inside"] & (o["start"] == x["start"]) & (o["end"] == x["end"]))
    grouped = grouped.withColumn("_a", F.filter("_a", lambda x: (x["error_type"] == "rank_inversion") | ~taken(x)))
    kept = grouped.select(key, F.explode(S.suppress(F.col("_a"))).alias("_x")).select(key, *(f"_x.{f}" for f in FIELDS))
    seen = S.overlap_join(kept, variation_scan(messages, key), key, "left")
    applies = (F.col("suppressed") == "") | F.array_contains(F.split("suppressed", " "), F.col("error_type"))
    score = F.when(F.col("v_key").isNotNull() & applies, F.struct(S.iou("start", "end", "start2", "end2").alias("iou"), (-F.col("start2")).alias("n"), "acceptability"))
    # A kept span is unique in its message: suppression leaves no two that overlap.
    judged = seen.groupBy(key, *FIELDS).agg(F.max(score).alias("best"))
    verdict = F.when(F.col("best").isNotNull() | F.col("forced"), "variation").otherwise("norm_divergence")
    return judged.select(key, "start", "end", "surface", "error_type", verdict.alias("verdict"), "confidence", "citation_key", F.col("best.acceptability").alias("acceptability"))


def merge(findings: DataFrame, key: str = "doc_id", texts: DataFrame | None = None) -> DataFrame:
    """Findings of several detectors into one: the more confident first (then by start),
    overlapping ones go; one that a variation overlaps becomes a variation.  With texts
    (key, text), pattern findings that a window around their span no longer bears out go
    first (see refuted)."""
    if texts is not None:
        seen = findings.join(texts.select(key, "text"), key)
        findings = seen.where(~refuted()).select(*findings.columns)
    twin = findings.where("verdict = 'variation'").select(key, F.col("start").alias("start2"), F.col("end").alias("end2"))
    touched = S.overlap_join(findings, twin, key, "left_semi").select(key, "start", "end", "error_type").distinct().withColumn("touched", F.lit(True))
    fields = [c for c in findings.columns if c != key]
    kept = S.nms(findings, [key], [-F.col("confidence"), F.col("start"), F.col("error_type")], fields)
    out = kept.join(touched, [key, "start", "end", "error_type"], "left")
    return out.withColumn("verdict", F.when(F.col("touched"), "variation").otherwise(F.col("verdict"))).select(key, *fields)
