"""Fill-in-middle transformation.

The Split pre-tokenizer of the tokenizers library, with isolated matches of a regex, gives the
code-point offsets of a text's units; nothing is trained.  Their count is n; hashes of the
document's id choose two ranks, and the offsets there cut the text in three.  Narrow: no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80  # per cent of the texts, and of those transformed
WINDOW = 1 << 16  # code points that are split at once


class Units:
    """Ends of a text's units, in code points."""

    #: A unit ends where white space follows other characters, so windows may end there.
    edge = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")

    def __init__(self, pattern: str = UNITS):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(pattern), behavior="isolated")

    def ends(self, text: str, window: int = WINDOW) -> np.ndarray:
        found, at = [], 0
        while at < len(text):
            cut = self.edge.search(text, at + window - 1) if at + window < len(text) else None
            to = cut.end() if cut else len(text)
            pieces = self.split.pre_tokenize_str(text[at:to])
            found.append(np.fromiter((e for _, (_, e) in pieces), np.int64, len(pieces)) + at)
            at = to
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def transformed(text: str, ends: np.ndarray, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple:
    """(form, prefix_chars, middle_chars, output)"""
    if not text or h[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    n = len(ends)
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    rate per cent of the texts are transformed, spm per cent of those suffix first.  The choice
    hangs on seed and id alone, so repeated rows fare alike; a null id counts as ''.  Null texts
    are empty; empty texts and those that hold a mark stay plain.  Very long texts are split in
    windows, cut where a word ends, with the same units.  Other columns are not used; an empty
    table gives an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("_h")).select("id", "text", *map(group, range(4)))
    out = f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    schema = docs.sparkSession.createDataFrame([], out).toArrow().schema

    def cut(batches):
        units = Units()
        for b in batches:
            texts, hashes = b.column("text").to_pylist(), zip(*(b.column(f"h{i}").to_pylist() for i in range(4)))
            n, rest = [], []
            for text, h in zip(texts, hashes):
                ends = units.ends(text)
                n.append(len(ends))
                rest.append(transformed(text, ends, h, rate, spm))
            columns = [b.column("id"), pa.array(n, pa.int64())]
            columns += [pa.array([r[i] for r in rest], schema.field(i + 2).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(C.frugal(cut), out).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  A mark can't stand in a part, nor over the seam
    of a part and a mark, so the first of each kind is the true one."""
    at = lambda mark: F.instr(output, mark)
    piece = lambda a, b: F.substr(output, a + 3, b - a - 3)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    middle = F.substr(output, m + 3)
    return F.when(form == "psm", F.concat(piece(p, s), middle, piece(s, m))).when(form == "spm", F.concat(piece(p, m), middle, piece(s, p))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; null, empty, long and repeated texts as in fill_in_middle()."""
    out = fill_in_middle(C.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
             ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
v as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
x as (select *, case when a > 0 then array_to_string(w[1:a], '') else '' end as prefix, case when b > a then array_to_string(w[a+1:b], '') else '' end as middle,
             case when n > b then array_to_string(w[b+1:n], '') else '' end as suffix from v)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end) as output_sha256,
       sha256(t) as restored_sha256
from x
"""
