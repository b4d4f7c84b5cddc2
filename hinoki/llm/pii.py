"""Personal data in texts (native DataFrame code).

Regular expressions propose spans, checksums (Luhn, mod 97) and number plans confirm them, and
words nearby raise the score of what a pattern alone can't tell.  Everything is an expression
over one row: no shuffle, no Python worker.

Every pattern runs in linear time: possessive repetition, and a look behind that lets a run of
characters be entered at its start only.  So a text of a million letters is read once a kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base kinds.  Greedy runs of disjoint classes leave nothing to backtrack to, so these
#: equal the plain patterns named in base_spans(); \G enters a run where the last match ended.
BASE = [
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    ("phone", r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])"),
]
#: Further proposals: kind, pattern, words that speak for it, score as it stands.
GROUPED = r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([\x20-])[0-9]{6}\2[0-9]{5}"
EXTRA = [
    ("card", rf"(?<![0-9])(?:[0-9]{{13,19}}+|{GROUPED})(?![0-9])", r"\b(?:card|credit|debit|visa|master|amex|karte|kreditkarte|carte|tarjeta)", 0.3),
    (
        "phone",
        r"(?=[+(0-9])(?:(?<![0-9+])\+1[\x20.-]?\(?[2-9][0-9]{2}\)?[\x20.-]{0,2}[2-9][0-9]{2}[\x20.-]?[0-9]{4}(?![0-9])"
        r"|\+[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])"
        r"|(?<![0-9+])(?<![0-9][\x20.-])\([2-9][0-9]{2}\)\x20?[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9])"
        r"|(?<![0-9+])(?<![0-9][\x20.-])[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9]))",
        r"\b(?:phone|tel|call|mobile|fax|handy|rufnummer|portable|llam|m[oó]vil|t[eé]l[eé]f)", 0.3,
    ),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"\b(?:iban|account|konto|compte|cuenta)", 0.3),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"\b(?:ssn|social security|sozialversicherung|s[eé]curit[eé] sociale|seguro social)", 0.3),
]
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
CHECKED, NEARBY, LEAST = 0.4, 0.3, 0.6  # what a checksum or number plan adds, what a word adds, and the score asked for
BEFORE, AFTER = 48, 24  # characters in which a word counts
BLOCK = 256
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def let(value: str, name: str, body: str) -> str:
    """SQL of body with name standing for value, which is computed once in the row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sums_before(sizes: str) -> str:
    """SQL: the sum of all sizes (a name) before each.  Blocks are summed by themselves and
    their totals likewise, so that a hundred thousand matches cost no square of their number."""
    plain = lambda x: f"transform({x}, (v, i) -> aggregate(slice({x}, 1, i), 0, (a, n) -> a + n))"
    blocks = let(
        f"transform(sequence(0, cast(floor((size({sizes}) - 1) / {BLOCK}) as int)), k -> slice({sizes}, k * {BLOCK} + 1, {BLOCK}))", "cut",
        let("transform(cut, c -> aggregate(c, 0, (a, n) -> a + n))", "totals", f"flatten(zip_with(cut, {plain('totals')}, (c, by) -> transform({plain('c')}, n -> n + by)))"),
    )
    return f"if(size({sizes}) > {BLOCK}, {blocks}, {plain(sizes)})"


def proposals(text: str, pattern: str, context: bool) -> str:
    """SQL: array<struct<start, end, m, near>> of a pattern's matches; near is the text around
    one, as far as the matches next to it.  Gaps and matches alternate, so their lengths add up
    to the offsets."""
    near = f"concat(right(gaps[i], {BEFORE}), ' ', left(gaps[i + 1], {AFTER}))" if context else "''"
    one = f"named_struct('start', n + length(gaps[i]), 'end', n + length(gaps[i]) + length(found[i]), 'm', found[i], 'near', {near})"
    sizes = "zip_with(slice(gaps, 1, size(found)), found, (g, m) -> length(g) + length(m))"
    placed = let(sizes, "sizes", f"transform({sums_before('sizes')}, (n, i) -> {one})")
    whole = let(f"regexp_extract_all({text}, r'{pattern}', 0)", "found", let(f"split({text}, r'{pattern}', -1)", "gaps", placed))
    return f"if(regexp_like({text}, r'{pattern}'), {whole}, cast(array() as array<struct<start:int,end:int,m:string,near:string>>))"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    value = "cast(substr(r, i, 1) as int) * if(i % 2 = 0, 2, 1)"
    return let(f"reverse({number})", "r", f"aggregate(sequence(1, length(r)), 0, (a, i) -> a + {let(value, 'v', 'v - if(v > 9, 9, 0)')})") + " % 10 = 0"


def mod97(iban: str) -> str:
    """SQL: the remainder of an IBAN (capital letters and digits) by 97; a right one has 1."""
    step = "if(substr(s, i, 1) >= 'A', (a * 100 + ascii(substr(s, i, 1)) - 55) % 97, (a * 10 + ascii(substr(s, i, 1)) - 48) % 97)"
    return let(f"concat(substr({iban}, 5), substr({iban}, 1, 4))", "s", f"aggregate(sequence(1, length(s)), 0, (a, i) -> {step})")


def small_parts(ip: str) -> str:
    """SQL: whether each part of a dotted number is at most 255, leading zeros aside."""
    return f"forall(split({ip}, '[.]'), p -> {let('ltrim(chr(48), p)', 'v', 'length(v) < 3 or (length(v) = 3 and v <= chr(50) || chr(53) || chr(53))')})"


def spans_of(found: str, kind: str, score: str) -> str:
    """SQL: proposals p as spans with a score; they sort by start, then kind as listed."""
    return f"transform({found}, p -> named_struct('start', p.start, 'rank', {KINDS.index(kind)}, 'end', p.end, 'kind', '{kind}', 'score', cast({score} as double)))"


def base_spans(text: str) -> str:
    """SQL: array of spans of the base kinds, each leftmost and not overlapping:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 12 to 19 digits that pass Luhn's check
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits
    """
    right = {"ip": small_parts("p.m"), "card": luhn(digits("p.m"))}
    found = []
    for kind, pattern in BASE:
        kept = proposals(text, pattern, False)
        found.append(spans_of(f"filter({kept}, p -> {right[kind]})" if kind in right else kept, kind, "1"))
    return f"concat({', '.join(found)})"


def score(kind: str, words: str, prior: float) -> str:
    """SQL: prior, plus what the checks and the words nearby add; 0 where a check speaks against p."""
    d = digits("p.m")
    if kind == "card":  # of an issuer's range, and Luhn
        fits = sure = f"({d} rlike '^(?:4|5[1-5]|2[2-7]|3[4-9]|6)' and {luhn(d)})"
    elif kind == "iban":
        fits = sure = let("replace(p.m, ' ', '')", "t", f"length(t) between 15 and 34 and {mod97('t')} = 1")
    elif kind == "phone":  # a country code or an area code in brackets says more than three groups
        fits, sure = f"length({d}) between 9 and 15", "p.m rlike '^[+(]'"
    else:
        fits, sure = "true", "false"
    return f"if({fits}, round({prior} + if({sure}, {CHECKED}, 0.0) + if(p.near rlike r'(?iU){words}', {NEARBY}, 0.0), 2), 0.0)"


def extra_spans(text: str) -> str:
    """SQL: the method's own, where the score is high enough: what the base patterns lose because
    two things stand side by side, IBANs, national phone and social security numbers."""
    found = (f"filter({spans_of(proposals(text, pattern, True), kind, score(kind, words, prior))}, s -> s.score >= {LEAST})" for kind, pattern, words, prior in EXTRA)
    return f"concat({', '.join(found)})"


def of_kind(spans: str, kind: str) -> str:
    return f"filter({spans}, s -> s.kind = '{kind}')"


def fresh(extra: str, base: str) -> str:
    """SQL: those of extra that overlap no base span of their kind.  Base spans of a kind don't
    overlap, so only the last one that starts before a span's end can; halvings find it."""
    at = "least(low + step, size(held))"
    last = f"aggregate(array({', '.join(str(1 << i) for i in range(24, -1, -1))}), 0, (low, step) -> if(try_element_at(held, {at}).start < s.end, {at}, low))"
    apart = let(f"try_element_at(held, greatest({last}, 1))", "b", "b.start >= s.end or b.end <= s.start")
    based = {k for k, _ in BASE}
    keep = []
    for kind in sorted({k for k, *_ in EXTRA}):
        own = of_kind(extra, kind)
        keep.append(let(of_kind(base, kind), "held", f"if(size(held) = 0, {own}, filter({own}, s -> {apart}))") if kind in based else own)
    return f"concat({', '.join(keep)})"


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with two more columns (underscores are added where docs has their names):
    base_spans and spans, arrays of struct<start, rank, end, kind, score> by start, then kind; offsets
    are code points, the end excluded.  spans holds the base ones and, of the others, those that
    overlap none of their kind.

    Null and empty texts have no spans, repeated rows fare alike, very long texts are searched
    whole; no row goes, and an empty table gives an empty one."""
    base, extra = C.free_name(docs, "base_spans"), C.free_name(docs, "spans")
    text, seen = (C.free_name(docs, c) for c in ("text to search", "personal"))
    # Most texts hold no digit and no @: they meet one look instead of eight patterns.
    some = f"`{text}` rlike '[0-9@]'"
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    held = f"named_struct('base', array_sort({base_spans(f'`{text}`')}), 'extra', {extra_spans(f'`{text}`')})"
    rows = rows.withColumn(seen, F.expr(f"if({some}, {held}, null)"))
    none = f"cast(array() as {SPANS})"
    both = let(f"`{seen}`", "x", f"if(size(x.extra) = 0, x.base, array_sort(concat(x.base, {fresh('x.extra', 'x.base')})))")
    return rows.select(*docs.columns, F.expr(f"coalesce(`{seen}`.base, {none})").alias(base), F.expr(f"if(`{seen}` is null, {none}, {both})").alias(extra))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the counts of its base spans by kind, the digest of those
    spans, and all spans; null, empty, long and repeated texts as in find()."""
    rows = find(C.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base_spans", "spans")
    count = lambda kind: F.expr(f"cast(size({of_kind('base_spans', kind)}) as bigint)").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k) for k, _ in BASE), F.sha2(written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
