"""The public face: check messages, list forms, explain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morph as M
from ..functions import tables as T
from ..operators import correct, detect, generate, roles
from ..sources import records

AUDIENCE_ALIASES = {"internal": "internal", "社内": "internal", "external": "external", "社外": "external", "public": "public", "不特定多数": "public"}


class Checker:
    """Honorific usage of messages: doc_id (unique), text and, where present, audience,
    writer, recipient, persons array<struct<name, side>>; the defaults stand for what
    is missing or null.  Rows with a null text have no findings."""

    def __init__(self, spark: SparkSession, audience: str = "external", writer: str = "山田", recipient: str = "佐藤"):
        self.spark, self.defaults = spark, {"audience": self.audience(audience), "writer": writer, "recipient": recipient}
        M.register(spark)

    @staticmethod
    def audience(name: str) -> str:
        return AUDIENCE_ALIASES[name.strip().lower()]

    def prepare(self, messages: DataFrame) -> DataFrame:
        cols = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in messages.columns else F.lit(v).alias(c) for c, v in self.defaults.items()]
        none = F.array().cast("array<struct<name:string,side:string>>")
        persons = F.coalesce(F.transform("persons", lambda p: F.struct(p["name"].alias("name"), p["side"].alias("side"))), none) if "persons" in messages.columns else none
        return messages.select("doc_id", "text", *cols, persons.alias("persons"))

    def roles(self, messages: DataFrame) -> DataFrame:
        return roles.tag(self.prepare(messages))

    def check(self, messages: DataFrame, language: str = "en") -> DataFrame:
        """Findings with source and message (see operators.detect and correct.explain)."""
        return correct.explain(detect.detect(self.prepare(messages)), language)

    def report(self, messages: DataFrame, language: str = "en") -> DataFrame:
        """check() with the first predicate's actor and target and the suggestions of each
        reportable finding (array<struct<text, cls>>, null for divided usage)."""
        m = self.prepare(messages)
        found, tagged = detect.detect(m), roles.tag(m)
        mended = correct.suggested(self.spark, found, tagged, m).select("doc_id", "start", "end", "error_type", "actor", "target", "suggestions")
        return correct.explain(found, language).join(mended, ["doc_id", "start", "end", "error_type"], "left")

    def teach(self, language: str = "en") -> DataFrame:
        return correct.teach(self.spark, language)

    def suggest(self, messages: DataFrame) -> DataFrame:
        m = self.prepare(messages)
        return correct.suggest(self.spark, detect.detect(m), roles.tag(m), m)

    def check_texts(self, texts: list[str], audience: str | None = None) -> DataFrame:
        rows = [(i, t, self.audience(audience) if audience else self.defaults["audience"]) for i, t in enumerate(texts)]
        return self.check(self.spark.createDataFrame(rows, "doc_id long, text string, audience string"))

    def check_files(self, path: str) -> DataFrame:
        return self.check(records.read_texts(self.spark, path).withColumnRenamed("path", "doc_id"))

    def results(self, messages: DataFrame) -> DataFrame:
        """A JSON text a message, also for messages without findings."""
        found = records.results_json(self.check(messages))
        none = '{"findings":[],"reportable_count":0,"variation_count":0}'
        return messages.select("doc_id").join(found, "doc_id", "left").withColumn("result", F.coalesce("result", F.lit(none)))

    def forms(self, base: str, politeness: int = 1) -> DataFrame:
        return generate.forms(self.spark, base, (politeness,))

    def explain(self, key: str) -> dict:
        """One error type by its code or by a part of code or name that only one has."""
        rows = [t for t in T.ERROR_TYPES if t[0] == key] or [t for t in T.ERROR_TYPES if key in t[0] or key.lower() in t[4].lower()]
        if len(rows) != 1:
            raise KeyError(key)
        t = rows[0]
        cite = next(c for c in T.CITATIONS if c[0] == t[3])
        return {"error_type": t[0], "name": t[4], "section": cite[1], "page": cite[2], "direction": t[2]}
