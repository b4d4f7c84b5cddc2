"""Readers and writers: texts, JSONL records, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERRORS = "array<struct<start:int,end:int,text:string,type:string,original:string,gold:array<string>>>"
PERSONS = "array<struct<name:string,side:string,title:string>>"
RECORD = (
    "id string, text string, source_text string, audience string, writer_org string, recipient_org string, persons string, errors string, "
    "n_errors int, error_types string, has_direction_error boolean, char_labels string, is_variation boolean, variation_reason string, function string, "
    "industry string, kind string, focus_start int, focus_end int, focus_text string, acceptability string, related_error_type string, split string"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a UTF-8 file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSONL records by an explicit schema; an empty table where the path is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(RECORD).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)


def write_records(df: DataFrame, path: str) -> None:
    """JSONL, a folder for each split."""
    df.write.partitionBy("split").json(path)


def encode(samples: DataFrame) -> DataFrame:
    """Injected samples with errors as a JSON text."""
    e = F.struct(F.col("start"), F.col("end_").alias("end"), F.col("surface").alias("text"), F.col("error_type").alias("type"), F.col("gold").alias("original"), F.array("gold").alias("gold"))
    return samples.withColumn("errors", F.to_json(F.array(e))).withColumn("n_errors", F.lit(1))


def decode_errors(records: DataFrame) -> DataFrame:
    """A row a gold error, as struct e; records without errors go."""
    return records.withColumn("e", F.explode(F.from_json("errors", ERRORS)))


def decode_context(records: DataFrame, writer: str = "山田", recipient: str = "佐藤") -> DataFrame:
    """Records as messages: names of writer and recipient are not stored, so defaults come back."""
    persons = F.coalesce(F.from_json("persons", PERSONS), F.array().cast(PERSONS))
    return records.select(F.col("id").alias("doc_id"), "text", F.coalesce("audience", F.lit("external")).alias("audience"), F.lit(writer).alias("writer"), F.lit(recipient).alias("recipient"), persons.alias("persons"))


def results_json(findings: DataFrame, key: str = "doc_id", roles: DataFrame | None = None) -> DataFrame:
    """One JSON text a message: findings by position, with both counts; with roles (a row a
    predicate with its key) also their count, and messages that have roles alone."""
    item = F.struct(*(c for c in findings.columns if c != key))
    first = ["start", "end"]
    item = F.struct(*first, *(c for c in findings.columns if c not in (key, *first)))
    g = findings.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("findings"), F.count_if(F.col("verdict") == "norm_divergence").alias("reportable_count"), F.count_if(F.col("verdict") == "variation").alias("variation_count"))
    if roles is None:
        return g.select(key, F.to_json(F.struct("findings", "reportable_count", "variation_count")).alias("result"))
    g = g.join(roles.groupBy(key).agg(F.count("*").alias("n_roles")), key, "full")
    none = F.coalesce("findings", F.array().cast(g.schema["findings"].dataType))
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("reportable_count", "variation_count", "n_roles"))
    return g.select(key, F.to_json(F.struct(none.alias("findings"), *counts)).alias("result"))
