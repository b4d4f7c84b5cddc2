"""Benchmark decontamination by size-partitioned MinHash containment (native code).

A test item is short and a document long, so what counts is how much of the item's
five-word shingles the document contains.  Items are partitioned by size; each gets
a bottom-k MinHash sketch, k being one more than the shingles a document may lack at
the wanted containment, so that every containing document meets the sketch at least
once.  Each size partition has its own cut, the largest value of its sketches: only a
document's hashes up to it are its probes there, and only documents with as many shingles
as the partition's smallest need probe it at all.  The equi-join is on partition and hash.
Candidates are then verified by the exact containment of shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

N, CONTAINMENT = 5, 0.8
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+; none for null."""
    return F.filter(F.split(C.ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def shingles(w: Column, n: int, make) -> Column:
    """make(words of a shingle) of every n consecutive words; of all the words where
    they are fewer; none without words.  Repeats are kept."""
    size = F.size(w)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: make(F.slice(w, i, n)))
    return F.when(size > 0, many).otherwise(F.slice(many, 1, 0))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, containment: float = CONTAINMENT, text_col: str = "text") -> DataFrame:
    """Pairs (doc_key, item_key, n_shared, n_item): the distinct document and item
    texts (by digest, see text_key) where the document contains at least containment
    of the item's distinct n-word shingles.

    Null, empty and white texts have no shingles and are in no pair; copies of a text
    are judged once; other columns are not used.  The result is materialized.
    """
    spark = docs.sparkSession
    items = (
        benchmark.select(F.col("text").alias("t")).where("t is not null").distinct()
        .select(text_key(F.col("t")).alias("item_key"), words(F.col("t")).alias("w"))
        .select("item_key", F.explode(F.array_distinct(shingles(F.col("w"), n, lambda s: F.array_join(s, " ")))).alias("shingle"))
        .withColumn("h", F.xxhash64("shingle"))
    )
    own = W.partitionBy("item_key")
    items = (
        items.withColumn("n_item", F.count("*").over(own))
        .withColumn("need", F.ceil(F.col("n_item") * containment - 1e-9).cast("int"))
        .withColumn("nth", F.row_number().over(own.orderBy("h", "shingle")))
        .withColumn("part", F.floor(F.log2("n_item")).cast("int"))
    )
    items = C.materialize(items, "bench")
    sketch = items.where("nth <= n_item - need + 1")
    cuts = sorted(((r[1], r[0], r[2]) for r in sketch.groupBy("part").agg(F.max("h"), F.min("need")).collect()), reverse=True)
    if not cuts:
        return spark.createDataFrame([], "doc_key string, item_key string, n_shared long, n_item long")
    hashed = docs.select(F.col(text_col).alias("t")).where("t is not null").select(text_key(F.col("t")).alias("doc_key"), words(F.col("t")).alias("w"))
    room = F.greatest(F.col("n_words") - (n - 1), F.lit(1))
    hashed = hashed.select("doc_key", F.size("w").alias("n_words"), shingles(F.col("w"), n, lambda s: F.xxhash64(F.array_join(s, " "))).alias("hs"))
    # Each size partition is probed by the hashes up to its own cut, and only by documents
    # that have room for its smallest need.  Cuts fall, so each is taken from what the last one left.
    left, found = "hs", []
    for i, (high, part, need) in enumerate(cuts):
        hashed = hashed.withColumn(f"low{i}", F.filter(left, lambda h: h <= F.lit(high).cast("bigint")))
        left = f"low{i}"
        own = F.transform(left, lambda h: F.struct(F.lit(part).alias("part"), h.alias("h")))
        found.append(F.when(room >= need, own).otherwise(F.slice(own, 1, 0)))
    probes = hashed.select("doc_key", room.alias("room"), F.explode(F.concat(*found)).alias("p")).select("doc_key", "room", "p.part", "p.h")
    small = C.maybe_broadcast(sketch.select("part", "h", "item_key", "need"))
    candidates = C.materialize(probes.join(small, ["part", "h"]).where("room >= need").select("doc_key", "item_key").distinct(), "bench-pairs")
    keys = C.maybe_broadcast(candidates.select("doc_key").distinct())
    texts = docs.select(F.col(text_col).alias("t")).where("t is not null").withColumn("doc_key", text_key(F.col("t"))).join(keys, "doc_key")
    # The words come from a project of their own: inside the shingles' lambda they would be split anew for each.
    held = texts.select("doc_key", words(F.col("t")).alias("w")).select("doc_key", F.explode(F.array_distinct(shingles(F.col("w"), n, lambda s: F.array_join(s, " ")))).alias("shingle"))
    wanted = C.maybe_broadcast(items.select("shingle", "item_key", "n_item", "need"))
    shared = held.join(wanted, "shingle").join(candidates, ["doc_key", "item_key"], "left_semi").distinct()
    found = shared.groupBy("doc_key", "item_key").agg(F.count("*").alias("n_shared"), F.max("n_item").alias("n_item"), F.max("need").alias("need"))
    return C.materialize(found.where("n_shared >= need").drop("need"), "bench-found")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without the rows whose text contains a test item; all columns and all
    other rows stay, those with a null text too."""
    key = C.free_name(docs, "key of bad text")
    bad = C.maybe_broadcast(contamination(docs, benchmark, **settings).select(F.col("doc_key").alias(key)).distinct())
    return docs.join(bad, text_key(F.col("text")) == F.col(key), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document row and test item it contains.  Null, empty and white texts
    contain nothing, repeated rows and items give a row each, very long texts are searched
    whole, null ids stay null; without documents or items there are no rows."""
    docs, bench = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")
    found = contamination(docs, bench)
    items = bench.where("text is not null").select("item_id", text_key(F.col("text")).alias("item_key"))
    named = C.maybe_broadcast(found.join(items, "item_key"))
    return (
        docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("doc_key")).join(named, "doc_key")
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


ORACLE = r"""
with d as (select row_number() over () as k, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where text is not null),
b as (select row_number() over () as k, item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark where text is not null),
ds as (select distinct k, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as s from d where len(w) > 0),
bs as (select distinct k, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as s from b where len(w) > 0),
n as (select k, count(*) as n_item from bs group by k),
m as (select ds.k as dk, bs.k as bk, count(*) as n_shared from ds join bs using (s) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment
from m join n on m.bk = n.k join d on d.k = m.dk join b on b.k = m.bk
where n_shared >= ceil(n_item * 0.8 - 1e-9)
"""
