"""Sentence splitting, dictionary scan, phrases and regex matches with offsets.

Offsets are half-open code points from 0.  All in-row: no operator here shuffles,
apart from the scan's regrouping by row.  Null and empty texts have no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T


def klass(chars: str) -> str:
    """The inside of a regex character class."""
    return "".join("\\" + c if c in "\\]^-[&" else {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c) for c in chars)


def any_of(words: list[str]) -> str:
    """A regex of literal words, in order: one look at a character rules out most places before
    the words are tried one by one."""
    return f"(?=[{klass(''.join(sorted({w[0] for w in words})))}])(?:{'|'.join(words)})"


ENDS = klass(T.SENTENCE_ENDS)
SENTENCE = f"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+"
BREAKS = klass(T.PHRASE_BREAKS)
PHRASE = f"([^{BREAKS}]*?)(" + "|".join(sorted(T.PARTICLES, key=len, reverse=True)) + ")"
BOUNDARY = f"^(?:[{klass(T.BOUNDARIES)}]|" + "|".join(map(re.escape, T.CONTINUATIONS)) + ")"
VETO = "[一-鿿々゠-ヿA-Za-z0-9０-９]"
BLANK = "^[\\s　]*$"
SCRIPT = "[ぁ-んァ-ヶ一-龥]"  # every entry of the lexicon and every particle has such a character
#: Group 1: from the first line that holds the script, behind the ends that it begins with, to the
#: last such line and the ends behind it.  Classes aren't negated: those are slow here.
CORE = f"(?dm)^[{ENDS}]*+(.*{SCRIPT}(?s:.*{SCRIPT})?.*[{ENDS}]*+)"


def let(value: Column, make) -> Column:
    """make(value), with value computed once in the row."""
    return F.element_at(F.transform(F.array(value), make), 1)


def running(sizes: Column, start: Column) -> Column:
    """array<int> of start plus the sum of all sizes before each."""
    zero = F.struct(start.cast("int").alias("n"), F.array().cast("array<int>").alias("a"))
    step = lambda acc, x: F.struct((acc["n"] + x).alias("n"), F.concat(acc["a"], F.array(acc["n"])).alias("a"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["a"])


def offsets(sizes: Column) -> Column:
    """array<int> of the sum of all sizes before each.  A fold copies its array at each
    step, so blocks of about the root of the count are summed, then folded: a text of
    ten thousand sentences costs a hundred small folds."""

    def of(sizes):
        block = F.ceil(F.sqrt(F.size(sizes))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / block).cast("int") - 1), lambda i: F.slice(sizes, i * block + 1, block))
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
        return let(cut, lambda cut: F.flatten(F.zip_with(cut, running(F.transform(cut, total), F.lit(0)), running)))

    return let(sizes, lambda sizes: F.when(F.size(sizes) > 16, of(sizes)).otherwise(running(sizes, F.lit(0))))


def gaps(text: Column, pattern: str) -> Column:
    """array<struct<g, m>>: each match of a regex with the length of what lies between it
    and the one before."""
    pair = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    return F.filter(pair, lambda p: p["m"].isNotNull())


def placed(found: Column) -> Column:
    """gaps() as array<struct<start, end, text>>: gaps and matches alternate, so their
    lengths add up to the offsets."""
    one = lambda p, n: F.struct((n + p["g"]).alias("start"), (n + p["g"] + F.length(p["m"])).alias("end"), p["m"].alias("text"))
    return let(found, lambda found: F.zip_with(found, offsets(F.transform(found, lambda p: p["g"] + F.length(p["m"]))), one))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a regex's matches, left to right."""
    return placed(gaps(text, pattern))


def exploded(df: DataFrame, items: Column, name: str) -> DataFrame:
    """A row an item; rows without one go.  Outer, since a filter is inferred for the inner one
    that makes the whole array once more."""
    return df.withColumn(name, F.explode_outer(items)).where(F.col(name).isNotNull())


def finditer(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """A row a match with start, end, surface; rows without a match go."""
    found = F.when(F.col(text).rlike(pattern), matches(F.col(text), pattern))
    hit = exploded(df, found, "_m")
    return hit.withColumns({"start": F.col("_m.start"), "end": F.col("_m.end"), "surface": F.col("_m.text")}).drop("_m")


def kept_sentences(text: Column) -> Column:
    """array<struct<start, s>> of a text's sentences but the blank ones."""
    parts = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    pair = lambda s, n: F.struct(n.alias("start"), s.alias("s"))
    spans = let(parts, lambda parts: F.zip_with(parts, offsets(F.transform(parts, F.length)), pair))
    return F.filter(spans, lambda x: ~x["s"].rlike(BLANK))


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a sentence with sent_idx (from 0 among those kept), sent_start, sentence.
    A run of end characters stays with its sentence; blank ones go; null texts have none."""
    out = df.select("*", F.posexplode_outer(kept_sentences(F.col(text))).alias("sent_idx", "_s")).where("_s is not null")
    return out.withColumns({"sent_start": F.col("_s.start"), "sentence": F.col("_s.s")}).drop("_s")


def core(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text holds the script, with the text cut to the lines from the first to the last
    that do; _at: its offset.  Patterns that match within such lines alone find there all that
    they find in the whole text.  It starts behind the ends of the sentence before and keeps those
    of its last one, so its sentences are the whole text's, too.  One pattern takes it out, far
    cheaper than the patterns and folds that it spares the rest of the text; the text holds no
    script before it, so the first place where it stands is its own.  Texts that cut() made are left as they are."""
    if "_at" in df.columns:
        return df
    found = F.filter(F.array(F.regexp_extract(text, CORE, 1)), lambda c: c != "")
    df = exploded(df, found, "_core").withColumnsRenamed({text: "_whole", "_core": text})
    return df.withColumn("_at", F.instr("_whole", F.col(text)) - 1)


def count_sentences(text: Column) -> Column:
    """How many sentences sentences() keeps of a text that is empty or ends with an end character.
    Lines without another end are one or, blank, none; only others are cut by the pattern."""
    other = klass("".join(c for c in T.SENTENCE_ENDS if c != "\n"))
    inked = lambda s: s.rlike("[^\\s　]")
    cut = lambda s: F.size(F.filter(F.regexp_extract_all(s, F.lit(SENTENCE), F.lit(0)), inked))
    one = lambda s: F.when(s.rlike(f"[{other}]"), cut(F.concat(s, F.lit("\n")))).otherwise(inked(s).cast("int"))
    lines = F.aggregate(F.split(text, "\n", -1), F.lit(0), lambda n, s: n + one(s))
    return F.when(text.rlike(f"\n[{other}]"), cut(text)).otherwise(lines)  # ends at a line's start belong to the sentence before


def cut(df: DataFrame, text: str = "text", numbered: bool = False) -> DataFrame:
    """core() to be kept for several steps: without the whole texts, and with the number of
    sentences before (null unless numbered; sent_idx is null then)."""
    before = count_sentences(F.substr("_whole", F.lit(1), F.col("_at"))) if numbered else F.lit(None).cast("int")
    return core(df, text).withColumn("_before", before).drop("_whole")


def script_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of sentences() whose sentence holds the script, found within core(); _nth numbers a
    text's sentences, too, without a count of those before (made only where sent_idx is asked for)."""
    c = core(df, text)
    if "_before" not in c.columns:
        c = c.withColumn("_before", count_sentences(F.substr("_whole", F.lit(1), F.col("_at"))))
    c = c.withColumn("_k", kept_sentences(F.col(text)))
    c = c.withColumn(text, F.col("_whole")).drop("_whole") if "_whole" in c.columns else c
    c = c.select("*", F.posexplode_outer("_k").alias("_nth", "_s")).where(F.col("_s.s").rlike(SCRIPT))
    return c.withColumns({"sent_idx": F.col("_before") + F.col("_nth"), "sent_start": F.col("_at") + F.col("_s.start"), "sentence": F.col("_s.s")}).drop("_k", "_s", "_at", "_before")


def greedy(items: Column, start: str, end: str) -> Column:
    """Leftmost non-overlapping ones of an array of structs sorted by start."""
    empty = F.slice(items, 1, 0)
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)[end] <= x[start]), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(items, empty, keep)


def scan(df: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "sentence", boundary: str | None = BOUNDARY, veto: str | None = VETO, longest: int = 22, script: str | None = SCRIPT) -> DataFrame:
    """Leftmost-longest, non-overlapping dictionary match.

    lexicon: surface and any columns; with cls = 'plain' an entry is vetoed behind a
    kanji, katakana or alphanumeric character.  Boundary and veto come before the
    longest match is picked.  script: a pattern that every entry has a match of.  Returns keys, p_start, p_end, surface and the lexicon's
    columns.  Substrings meet the lexicon by an equi-join (its size is fixed by the
    rule tables, hence the broadcast), after their first two characters have met an index of
    its beginnings; one regrouping by keys picks the matches.
    """
    c = F.col(text)
    if script:  # a text without such a character holds no entry
        df = df.where(c.rlike(script))
    # Only places whose first two characters begin an entry are looked at further, and only
    # at the lengths that entries of this beginning have.
    heads = lexicon.groupBy(F.substring("surface", 1, 2).alias("_head")).agg(F.collect_set(F.length("surface")).alias("_sizes"))
    starts = df.where(F.length(c) >= 2).select(*keys, c.alias("_t"), F.explode(F.sequence(F.lit(0), F.length(c) - 2)).alias("p_start"))
    met = starts.withColumn("_head", F.substr("_t", F.col("p_start") + 1, F.lit(2))).join(F.broadcast(heads), "_head").drop("_head")
    fits = F.filter("_sizes", lambda n: (n <= longest) & (n <= F.length("_t") - F.col("p_start")))
    cand = met.withColumn("_n", F.explode(fits)).drop("_sizes")
    cand = cand.withColumn("surface", F.substr("_t", F.col("p_start") + 1, F.col("_n")))
    hit = cand.join(F.broadcast(lexicon), "surface")
    if boundary:
        rest = F.substr("_t", F.col("p_start") + F.col("_n") + 1)
        hit = hit.where((rest == "") | rest.rlike(boundary))
    if veto:
        before = F.when(F.col("p_start") > 0, F.substr("_t", F.col("p_start"), F.lit(1))).otherwise("")
        hit = hit.where(~((F.col("cls") == "plain") & before.rlike(veto)))
    fields = [f for f in lexicon.columns if f != "surface"]
    item = F.struct("p_start", (-F.col("_n")).alias("_m"), (F.col("p_start") + F.col("_n")).alias("p_end"), "surface", *fields)
    grouped = hit.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_a"))
    return grouped.select(*keys, F.explode(greedy(F.col("_a"), "p_start", "p_end")).alias("_x")).select(*keys, "_x.p_start", "_x.p_end", "_x.surface", *(f"_x.{f}" for f in fields))


def phrases(text: Column) -> Column:
    """array<struct<body, particle>> of the noun phrases that a particle closes."""
    pattern = f"([^{BREAKS}]*?)({any_of(sorted(T.PARTICLES, key=len, reverse=True))})"  # PHRASE, which any engine reads
    body, particle = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.filter(F.arrays_zip(body.alias("body"), particle.alias("particle")), lambda p: p["body"] != "")


def segments(messages: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end_, segment, label): a message cut into found and other stretches,
    in order; label is the error type or null.  A finding that overlaps an earlier one
    is left out; a message without findings is one stretch, an empty one has none."""
    item = F.struct("start", "end", "error_type")
    found = findings.groupBy(key).agg(greedy(F.array_sort(F.collect_list(item)), "start", "end").alias("_f"))
    rows = messages.select(key, "text").join(found, key, "left").withColumn("_f", F.coalesce("_f", F.array().cast("array<struct<start:int,end:int,error_type:string>>")))
    ends = F.concat(F.array(F.lit(0)), F.transform("_f", lambda f: f["end"]))
    starts = F.concat(F.transform("_f", lambda f: f["start"]), F.array(F.length("text")))
    gaps = F.zip_with(ends, starts, lambda a, z: F.struct(a.alias("start"), z.alias("end"), F.lit(None).cast("string").alias("error_type")))
    parts = F.array_sort(F.filter(F.concat(gaps, "_f"), lambda p: p["start"] < p["end"]))
    out = rows.select(key, "text", F.explode(parts).alias("_p"))
    return out.select(key, "_p.start", F.col("_p.end").alias("end_"), F.substr("text", F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start")).alias("segment"), F.col("_p.error_type").alias("label"))


def line_starts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, start, length): lines from 1 with their offsets; with a column from 1
    the absolute offset is start + column - 1."""
    one = lambda s, n: F.struct(n.alias("start"), F.length(s).alias("length"))
    lines = let(F.split(F.col(text), "\n", -1), lambda parts: F.zip_with(parts, offsets(F.transform(parts, lambda s: F.length(s) + 1)), one))
    return df.select(key, F.posexplode(lines).alias("_i", "_l")).select(key, (F.col("_i") + 1).alias("line"), "_l.start", "_l.length")


def position(line: Column, column: Column, starts: Column, lengths: Column) -> Column:
    """The offset of a line and column from 1, in a text whose lines have these starts and
    lengths; a column beyond its line's end stands for the end, null for an unknown line."""
    at = F.try_element_at(starts, line)
    return F.when((line >= 1) & (column >= 1), at + F.least(column - 1, F.try_element_at(lengths, line)))


def ranges(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, start, end, surface) of rows with from_line, from_column, to_line, to_column
    (from 1, the last one excluded).  Without an end a range is one character, an empty
    range four (as far as the text goes); ranges with an unknown line or an end before their start go."""
    parts = F.split(F.col(text), "\n", -1)
    rows = df.withColumn("_n", F.transform(parts, F.length)).withColumn("_o", offsets(F.transform("_n", lambda n: n + 1)))
    start = position(F.col("from_line"), F.col("from_column"), F.col("_o"), F.col("_n"))
    end = F.coalesce(position(F.col("to_line"), F.col("to_column"), F.col("_o"), F.col("_n")), start + 1)
    rows = rows.withColumn("start", start).withColumn("end", F.when(end == start, F.least(start + F.when(F.col("to_line").isNull(), 1).otherwise(4), F.length(text))).otherwise(end)).where("start is not null and end >= start")
    return rows.select(key, "start", "end", F.substr(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"))


def forbidden(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column holds a phrase that messages must not hold."""
    return df.where(F.col(column).rlike("|".join(re.escape(p) for _, p in T.FORBIDDEN)))
