"""Fill-in-middle against Python's own regex, and round trips."""

import hashlib
import random
import re

from hinoki.llm import fim
from pyspark.sql import functions as F


def plain(doc_id, text, rate=50, spm=80):
    units = re.findall(fim.UNITS, text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    parts = ["a", "é", "日本", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "😀", "é", "<", "<P", ">", "S>", "\x00"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    return made + ["", None, " ", "<P>x", "a <M> b", "word " * 60_000, "x" * 200_000, " " * 100_000 + "é", "same", "same"]


def test_equals_plain_python(spark):
    rows = list(enumerate(texts())) + [(None, "a b c d"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h0", "2 as id", "'x' as output")
    for rate, spm in ((50, 80), (100, 0), (100, 100)):
        out = fim.fill_in_middle(df, rate=rate, spm=spm).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        got = sorted(([r.doc_id is not None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back] for r in out.collect()), key=repr)
        want = sorted(([i is not None, i or 0, *plain(i, t or "", rate, spm), t or ""] for i, t in rows), key=repr)
        assert got == want


def test_windows_cut_where_words_end():
    units = fim.Units()
    for text in texts():
        text = text or ""
        want, at = [], 0
        for u in re.findall(fim.UNITS, text):
            at += len(u)
            want.append(at)
        for window in (1, 2, 7, fim.WINDOW):
            if len(text) < 1000 or window > 7:
                assert units.ends(text, window).tolist() == want


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
