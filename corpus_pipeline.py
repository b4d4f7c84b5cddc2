"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
between stages the rows are written as Parquet and read again.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinoki.llm import bpe, decontaminate, jaccard, suffix_dedup, toxicity
from hinoki.llm import common as C


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is at least a half go; the models learn from labels.  Null
    and empty texts are judged by the labels' prior; repeated rows fare alike."""
    model = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    score = C.free_name(docs, "toxicity")
    return toxicity.with_score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles
    of 0.8 or more stays, that of the smallest doc_id."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte covered by a 200-byte string that also stands elsewhere goes from the
    texts; the rows stay, and n_chars follows the text."""
    out = suffix_dedup.deduplicated(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a test item's five-word shingles go; null and
    empty texts contain nothing and stay."""
    return decontaminate.decontaminated(docs, C.table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and the SHA-256 of the text decoded
    from them; null texts are empty, every row stays."""
    return bpe.round_trip(docs, bpe.tokenizer_json(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("benchmark", drop_contaminated),
    ("tokens", encode_tokens),
]
ORACLE_SQL = None  # the trained models and the tokenizer are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
