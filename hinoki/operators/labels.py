"""Subword pieces that know their place, BIO labels for them, and back to spans.

Pieces are matches on the text itself and are normalised one by one, so a piece's offsets are
those of the text whatever normalising does to its length.  Spans and pieces meet in an interval
join on key and bin, so a text of any length and any number of spans is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spans as S
from . import text as X

LONGEST = 8  # characters of a piece
#: A run of letters, digits or katakana, or any other sign alone.
PIECE = f"[A-Za-zＡ-Ｚａ-ｚ]{{1,{LONGEST}}}|[0-9０-９]{{1,{LONGEST}}}|[ァ-ヴー]{{1,{LONGEST}}}|[^\\s　]"
WIDE, NARROW = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F))
WINDOW = 256  # pieces that a tagger sees at once, those of the context among them


def normal(piece: Column) -> Column:
    """Full-width signs as ASCII, small letters, the ideographic stop and comma as ASCII, and a long
    vowel mark repeated as one: the length may change."""
    return F.regexp_replace(F.lower(F.translate(piece, WIDE + "。、", NARROW + ".,")), "ー+", "ー")


def context(audience: Column, persons: Column) -> Column:
    """The context as a text before the text: audience and who stands on which side."""
    names = lambda sides: F.array_join(F.transform(F.filter(persons, lambda p: p["side"].isin(*sides)), lambda p: p["name"]), "/")
    own, other = names(["self", "self_group"]), names(["addressee", "addressee_group", "third_party"])
    part = lambda tag, c: F.when(c != "", F.concat(F.lit(f"[{tag}:"), c, F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), F.coalesce(audience, F.lit("unknown")), F.lit("]"), part("own", own), part("other", other), F.lit(" "))


def windows(df: DataFrame, key: str, text: str, prefix: str | None, window: int, *more: str) -> DataFrame:
    """(key, _n, _p, win, _w, more): a row a window, with the pieces _w of the text there, those of the
    prefix in _p and the prefix's length in _n."""
    of = lambda c: X.matches(c, PIECE)
    head = F.coalesce(F.col(prefix), F.lit("")) if prefix else F.lit("")
    rows = df.where(F.length(text) > 0).select(key, F.length(head).alias("_n"), of(head).alias("_p"), of(F.col(text)).alias("_t"), *more)
    room = F.greatest(F.lit(window) - F.size("_p"), F.lit(1))
    wins = F.transform(F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / room).cast("int")), lambda i: F.slice("_t", i * room + 1, room))
    wins = F.when(F.size("_t") > 0, wins)  # outer, since a filter is inferred for the inner one that matches all once more
    return rows.select(key, "_n", "_p", *more, F.posexplode_outer(wins).alias("win", "_w")).where("_w is not null")


def pieces(df: DataFrame, key: str, text: str = "text", prefix: str | None = None, window: int = WINDOW) -> DataFrame:
    """(key, win, pos, start, end, piece, masked): pieces of prefix and text, in windows.

    Offsets are those of text; the prefix's pieces stand masked before those of every window,
    at offsets below 0.  A long text is cut into windows, nothing of it is left out; null and
    empty texts have no pieces.  Rows of one key are told apart by their key alone."""
    rows = windows(df, key, text, prefix, window)
    shifted = F.transform("_p", lambda p: F.struct((p["start"] - F.col("_n")).alias("start"), (p["end"] - F.col("_n")).alias("end"), p["text"].alias("text")))
    rows = rows.select(key, "win", F.size("_p").alias("_k"), F.posexplode(F.concat(shifted, "_w")).alias("pos", "_x"))
    return rows.select(key, "win", "pos", "_x.start", "_x.end", normal(F.col("_x.text")).alias("piece"), (F.col("pos") < F.col("_k")).alias("masked"))


def labelled_texts(df: DataFrame, key: str, spans: str, text: str = "text", prefix: str | None = None, window: int = WINDOW) -> DataFrame:
    """(key, win, pos, start, end, surface, label): the pieces of pieces() that aren't masked, as they
    stand in the text, with the labels of labelled().

    spans: array<struct<start, end, type>> of a text, in any order.  All is done in the row, so no
    piece passes a shuffle or a join; each piece is held against all spans of its text, hence for
    few spans a text (labelled() spreads many)."""
    mine = F.array_sort(F.filter(F.coalesce(F.col(spans), F.array()), lambda e: (e["end"] > e["start"]) & (e["type"] != "none")))
    rows = windows(df.withColumn("_s", mine), key, text, prefix, window, "_s")
    first = lambda x: F.get(F.filter("_s", lambda e: (x["start"] < e["end"]) & (e["start"] < x["end"])), F.lit(0))
    here = lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("surface"), i.alias("at"), first(x).alias("e"))
    # The pieces that have a span as their first stand side by side.
    old = lambda met, x: F.get(met, x["at"] - 1)["e"] == x["e"]
    name = lambda met, x: F.when(x["e"].isNull(), "O").otherwise(F.concat(F.when(old(met, x), "I-").otherwise("B-"), x["e"]["type"]))
    out = X.let(F.transform("_w", here), lambda met: F.transform(met, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["surface"].alias("surface"), name(met, x).alias("label"))))
    # Outer, since a filter is inferred for the inner one that labels all once more; no window is empty.
    rows = rows.select(key, "win", F.size("_p").alias("_k"), F.posexplode_outer(out).alias("pos", "_x"))
    return rows.select(key, "win", (F.col("_k") + F.col("pos")).alias("pos"), "_x.*")


def labelled(tokens: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """tokens with label: null where masked, else B-, I- of the first span (by order of start)
    that a piece meets, or O.  errors: key, start, end, type; empty spans and the type 'none' are
    no errors.  A span begins once a window, at its first piece there."""
    e = errors.where("end > start and type <> 'none'")
    e = e.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("start", "end", "type"))).select(key, F.col("start").alias("start2"), F.col("end").alias("end2"), "nth", "type")
    met = S.overlap_join(tokens.where("not masked").select(key, "win", "pos", "start", "end"), e, key, "inner", LONGEST)
    first = met.groupBy(key, "win", "pos").agg(F.min(F.struct("nth", "type")).alias("_e"))
    begins = F.row_number().over(W.partitionBy(key, "win", "_e.nth").orderBy("pos")) == 1
    first = first.withColumn("_l", F.concat(F.when(begins, "B-").otherwise("I-"), F.col("_e.type"))).drop("_e")
    out = tokens.join(first, [key, "win", "pos"], "left")
    return out.withColumn("label", F.when(~F.col("masked"), F.coalesce("_l", F.lit("O")))).drop("_l")


def spans(tokens: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """(key, type, start, end, confidence) out of labels: a span goes on at I- of its own type, a
    label below the confidence least counts as O; confidence is the mean (1 where there is none).
    Runs that a window's edge parts are put together again."""
    sure = F.coalesce("confidence", F.lit(1.0)) if "confidence" in tokens.columns else F.lit(1.0)
    t = tokens.where("not masked").select(key, "win", "pos", "start", "end", F.when(sure >= least, F.col("label")).otherwise("O").alias("label"), sure.alias("confidence"))
    by = W.partitionBy(key).orderBy("win", "pos")
    t = t.withColumn("type", F.when(F.col("label") != "O", F.regexp_replace("label", "^[BI]-", "")))
    edge = F.lag("win").over(by) != F.col("win")
    goes_on = (F.lag("type").over(by) == F.col("type")) & (F.col("label").startswith("I-") | edge)
    t = t.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(by))
    return t.where("type is not null").groupBy(key, "_run", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence")).drop("_run")
