"""Taking surfaces apart: from an inflected predicate back to its dictionary form.

The rules of inflection are turned round into a table of endings (some three hundred rows made
from the conjugation rules): each end of a surface is looked up there, what stands before it and
the restored ending are looked up among the dictionary forms, and a form counts only if inflecting
it gives the surface again.  Of several forms the lexicon's ranks choose, so every surface of the
lexicon gets its own entry back without the lexicon itself, whose surfaces are twenty times as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import morph as M
from ..functions import tables as T

#: Names of the inflections by their number in the lexicon
MASU_NAMES = ["polite", "polite_past", "polite_neg", "polite_neg_past", "polite_te", "polite_tara", "polite_volitional"]
COPULA_NAMES = ["stem", "polite", "polite_past", "polite_te", "polite_presumptive", "neg"]
POTENTIAL_NAMES = ["potential_polite", "potential_polite_past", "potential_polite_neg", "potential_polite_neg_past", "potential_neg"]
NAMES = {0: "plain", 20: "stem", 21: "te", 22: "past", 23: "neg", 24: "potential"}
NAMES |= {i: n for start, names in ((1, COPULA_NAMES), (11, MASU_NAMES), (25, POTENTIAL_NAMES)) for i, n in enumerate(names, start)}


def stem_rows() -> list[tuple[str, str, str, str, str, str]]:
    """(kind, end of the dictionary form, and what the continuative, negative, te and potential
    forms have in its place)."""
    rows = [("godan", r[0], r[1], r[2], r[4], r[3] + "る") for r in T.GODAN]
    rows += [("godan", "行く", "行き", "行か", "行って", "行ける")]
    rows += [("", a, b, a[:-1] + "ら", a[:-1] + "って", a[:-1] + "れる") for a, b in T.IRREGULAR]
    return rows + [("ichidan", "る", "", "", "て", "られる"), ("kahen", "来る", "来", "来", "来て", "来られる"), ("sahen", "する", "し", "さ", "して", "できる"), ("sahen", "", "", "", "て", "")]


def endings() -> list[tuple[int, str, str, str]]:
    """(number of the inflection, kind or '' for any, ending, what the dictionary form has there)."""
    out = [(0, "", "", "")] + [(i, "copula", e, "だ") for i, e in enumerate(T.COPULA_ENDINGS, 1)]
    for kind, end, s, a, te, p in stem_rows():
        past = te[:-1] + ("た" if te.endswith("て") else "だ")
        out += [(i, kind, s + e, end) for i, e in enumerate(T.MASU_ENDINGS, 11)]
        out += [(20, kind, s, end), (21, kind, te, end), (22, kind, past, end), (23, kind, a + "ない", end)]
        if p:
            out += [(24, kind, p, end)] + [(i, kind, p[:-1] + e, end) for i, e in enumerate(T.POTENTIAL_ENDINGS, 25)]
    return list(dict.fromkeys(out))


def analyse(df: DataFrame, column: str = "surface") -> DataFrame:
    """(surface, form, kind, cls, origin, base, hint, inflection, known) of each distinct surface.

    known: the form is one of the lexicon's dictionary forms.  Other surfaces get form, kind and
    inflection of their longest ending of two characters or more, or nulls without one; nulls are
    left out, an empty surface has nulls.  Surfaces are made distinct before anything else, with
    partial sums, so a frequent one costs no more than a rare one; the table of endings and the
    dictionary forms are broadcast, their size being fixed by the rule tables.
    """
    spark, table = df.sparkSession, endings()
    L.lexicon(spark)
    longest = max(len(e[2]) for e in table)
    s = df.select(F.col(column).cast("string").alias("surface")).where("surface is not null").distinct()
    cuts = s.select("surface", F.explode(F.sequence(F.lit(0), F.least(F.length("surface"), F.lit(longest)))).alias("k"))
    rules = F.broadcast(M.inline(spark, table, "n, of_kind, ending, restored"))
    made = cuts.withColumn("ending", F.expr("right(surface, k)")).join(rules, "ending")
    made = made.select("surface", "k", "n", "of_kind", "restored", F.expr("concat(left(surface, length(surface) - k), restored)").alias("form"))
    heads = F.broadcast(spark.table("hinoki_stems"))
    again = "case n " + " ".join(f"when {n} then ({c}) and {f} = surface" for n, f, c in L.inflections()) + " end"
    met = made.join(heads, "form", "left").withColumn("nth", F.expr("cast(seq as bigint) * 100 + n"))
    fits = F.expr(f"(of_kind = '' or of_kind = kind) and ({again})")
    entry = F.struct("form", "kind", "cls", "origin", "base", "hint", "n")
    guess = F.when(F.expr("k >= 2 and n not in (0, 20) and of_kind <> '' and length(form) >= 2"), F.struct("k", (-F.col("n")).alias("n"), "of_kind", "restored"))
    best = met.groupBy("surface").agg(
        F.max_by(entry, F.when(fits, F.expr(L.rank_sql()))).alias("e"), F.max_by(F.struct("form", F.col("of_kind").alias("kind"), "n"), guess).alias("g")
    )
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    either = lambda c: F.coalesce(F.col("e")[c], F.col("g")[c])
    return best.select(
        "surface", either("form").alias("form"), either("kind").alias("kind"), *(F.col("e")[c].alias(c) for c in ("cls", "origin", "base", "hint")), names[either("n")].alias("inflection"), F.col("e").isNotNull().alias("known")
    )


def polite_tail(surface: Column) -> Column:
    """struct<stem, tail>: cut before the first polite tail, in the order of the list, that stands
    anywhere but at the beginning; an empty tail without one."""
    at = F.coalesce(*(F.when(F.instr(surface, t) > 1, F.instr(surface, t)) for t in T.POLITE_TAILS), F.length(surface) + 1)
    return F.struct(F.substr(surface, F.lit(1), at - 1).alias("stem"), F.substr(surface, at).alias("tail"))


def irregular_tail(form: Column) -> Column:
    """struct<head, tail>: a compound cut before the irregular verb at its end; an empty head for
    the verb alone and for other forms."""
    size = F.coalesce(*(F.when(form.endswith(a) & (form != a), len(a)) for a, _ in T.IRREGULAR), F.length(form))
    return F.struct(F.substr(form, F.lit(1), F.length(form) - size).alias("head"), F.substr(form, F.length(form) - size + 1).alias("tail"))


def sonkeigo_origin(form: str) -> Column:
    """The general rule that made a raised form of the verb row (plain, kind, ogo); the forms are
    made again and compared.  What none of them makes counts as a form with rareru."""
    rules = " ".join(f"when ({c.replace(' and naru', '')}) and {f} = {form} then '{o}'" for _, o, f, c in M.SONKEIGO)
    return F.expr(f"case {rules} when {form} like '%なさる' then 'sonkeigo_nasaru' when {form} is not null then 'sonkeigo_rareru' end")
