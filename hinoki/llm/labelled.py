"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): every labelled id once, with its largest label; rows with a null
    label or id are left out."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, classes: list[int]) -> DataFrame:
    """(doc_id, text, y): for each class at most per_class labelled rows, those of
    the smallest id hash.  Rows with a null label or id are left out; an id
    labelled twice counts with its largest label.  At most len(classes) *
    per_class ids are broadcast, so the texts are not shuffled."""
    known = labelled(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for y in classes:
        part = known.where(F.col("y") == y).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
