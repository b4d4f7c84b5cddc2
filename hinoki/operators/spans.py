"""Joins and folds over spans (half-open, code points)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(s1, e1, s2, e2) -> Column:
    return (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))


def iou(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Overlap over union, 0 without overlap."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    union = (F.col(e1) - F.col(s1)) + (F.col(e2) - F.col(s2)) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner", longest: int | None = None) -> DataFrame:
    """a (key, start, end) with b (key, start2, end2) where spans of a key overlap: an
    equi-join on the key with the range as residual condition.  Where no span of a is
    longer than longest, the join is on key and bin: each span of b stands in all bins
    where one of a that meets it can start, so a key of many spans is spread and its
    pairs aren't all looked at."""
    b = b.withColumnRenamed(key, "_k")
    if longest is None:
        return a.join(b, (F.col(key) == F.col("_k")) & overlaps("start", "end", "start2", "end2"), how).drop("_k")
    bin_of = lambda c: F.floor(c / (4 * longest)).cast("int")
    b = b.withColumn("_b", F.explode(F.sequence(bin_of(F.col("start2") - longest), bin_of(F.col("end2") - 1))))
    a = a.withColumn("_a", bin_of(F.col("start")))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("_a") == F.col("_b")) & overlaps("start", "end", "start2", "end2"), how).drop("_k", "_a", "_b")


def best_match(a: DataFrame, b: DataFrame, key: str, by: list[str], order: list[str], longest: int | None = None) -> DataFrame:
    """For each row of a (named by the columns by) the row of b of the largest
    overlap-over-union; ties go to the first by order.  Rows without one go."""
    met = overlap_join(a, b, key, longest=longest).withColumn("iou", iou("start", "end", "start2", "end2"))
    first = W.partitionBy(*by).orderBy(F.desc("iou"), *order)
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suppress(items: Column, start: str = "start", end: str = "end") -> Column:
    """Greedy suppression: of an array of structs in order of preference, those that
    overlap no earlier kept one.  A fold inside the row: no shuffle."""
    clash = lambda acc, x: F.exists(acc, lambda o: (o[start] < x[end]) & (x[start] < o[end]))
    return F.aggregate(items, F.slice(items, 1, 0), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def nms(df: DataFrame, keys: list[str], order: list[Column], fields: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Greedy suppression within keys; order: sort columns, ascending.  Spans that no
    chain of overlaps connects can't suppress each other, so each key is cut into islands
    where no span reaches over, and an island's spans are one row."""
    by = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) >= before).cast("int"), F.lit(0))
    df = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *fields)
    grouped = df.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(item)).alias("_a"))
    return grouped.select(*keys, F.explode(suppress(F.col("_a"), start, end)).alias("_x")).select(*keys, *(f"_x.{f}" for f in fields))


def overlay(text: str, start: str, end: str, new: str) -> Column:
    """text with start..end replaced; null where the span is outside."""
    ok = (F.col(start) >= 0) & (F.col(end) >= F.col(start)) & (F.col(end) <= F.length(text))
    return F.when(ok, F.concat(F.substr(text, F.lit(1), F.col(start)), F.col(new), F.substr(F.col(text), F.col(end) + 1)))


def apply_edits(text: str, edits: str) -> Column:
    """text with all edits (array<struct<start, end, new>>, none overlapping) made, the
    rightmost first, so that each offset still holds when its turn comes."""
    order = F.reverse(F.array_sort(F.col(edits)))
    put = lambda acc, e: F.concat(F.substr(acc, F.lit(1), e["start"]), e["new"], F.substr(acc, e["end"] + 1))
    return F.aggregate(order, F.col(text), put)


def placed(pieces: DataFrame, key: str, order: str, text: str, between: int = 0) -> DataFrame:
    """pieces of a whole with start and end in it: running sums of the lengths before, with
    between characters after each piece."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + between).over(before), F.lit(0)).cast("int")
    return pieces.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))
