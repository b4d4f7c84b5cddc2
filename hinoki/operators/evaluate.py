"""Scoring detectors against gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from . import spans as S

# Confidence thresholds of the sweep
THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def reportable(findings: DataFrame, least: float = 0.0) -> DataFrame:
    return findings.where((F.col("verdict") == "norm_divergence") & (F.col("confidence") >= least))


def matched(gold: DataFrame, findings: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """gold (key, start, end, type) with located, typed and the type of the finding of
    the best overlap (the first of equals), '__missed__' without one; longest as for
    overlap_join()."""
    f = reportable(findings).select(key, F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("error_type").alias("found"))
    met = S.overlap_join(gold, f, key, "left", longest).withColumn("iou", S.iou("start", "end", "start2", "end2"))
    best = F.max(F.when(F.col("found").isNotNull(), F.struct("iou", (-F.col("start2")).alias("n"), "found")))["found"]
    return met.groupBy(key, "start", "end", "type").agg(
        F.max(F.col("found").isNotNull()).alias("located"), F.coalesce(F.max(F.col("found") == F.col("type")), F.lit(False)).alias("typed"), F.coalesce(best, F.lit("__missed__")).alias("predicted")
    )


def recall(matches: DataFrame) -> DataFrame:
    """type (and '__all__', '__direction__'): n, location_recall, type_recall."""
    directed = [t[0] for t in T.ERROR_TYPES if t[2]]
    groups = F.array_compact(F.array(F.col("type"), F.lit("__all__"), F.when(F.col("type").isin(directed), "__direction__")))
    return matches.select(F.explode(groups).alias("type"), "located", "typed").groupBy("type").agg(
        F.count("*").alias("n"), F.avg(F.col("located").cast("double")).alias("location_recall"), F.avg(F.col("typed").cast("double")).alias("type_recall")
    )


def confusion(matches: DataFrame) -> DataFrame:
    return matches.groupBy("type", "predicted").count().withColumnRenamed("count", "n")


def false_positives(docs: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """One row: n_docs, docs_with_fp, fp_count over texts that should have none."""
    per = reportable(findings).groupBy(key).agg(F.count("*").alias("c"))
    return docs.select(key).join(per, key, "left").agg(F.count("*").alias("n_docs"), F.count("c").alias("docs_with_fp"), F.coalesce(F.sum("c"), F.lit(0)).alias("fp_count"))


def tops(spans: DataFrame, findings: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """(key, start, end, type, top): the best confidence of a reportable finding that meets the span."""
    f = reportable(findings).select(key, F.col("start").alias("start2"), F.col("end").alias("end2"), "confidence")
    return S.overlap_join(spans, f, key, "left", longest).groupBy(key, "start", "end", "type").agg(F.max("confidence").alias("top"))


def overflag(focus: DataFrame, findings: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """(type, threshold, n, flagged, no_overflag_rate) over stretches of divided usage (key, start,
    end, type), '__all__' for all types: flagged where a finding of that confidence or more meets
    the stretch; at threshold 0 whatever is reported.  Equal spans count once."""
    return curve(tops(focus, findings, key, longest))


def curve(top: DataFrame) -> DataFrame:
    """overflag() of stretches with the best confidence that met each (type, top)."""
    types, steps = F.explode(F.array(F.col("type"), F.lit("__all__"))).alias("type"), F.array(*map(F.lit, [0.0, *THRESHOLDS]))
    rows = top.select(types, "top").select("type", "top", F.explode(steps).alias("threshold"))
    out = rows.groupBy("type", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= F.col("threshold")).alias("flagged"))
    return out.withColumn("no_overflag_rate", 1 - F.col("flagged") / F.col("n"))


def sweep(gold: DataFrame, findings: DataFrame, key: str, longest: int | None = None) -> DataFrame:
    """threshold, n, detected: gold spans met at each confidence threshold.  A span's
    best confidence is found once; the thresholds then only compare."""
    top = tops(gold, findings, key, longest)
    at = F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")
    return top.select(at, "top").groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= F.col("threshold")).alias("detected"))


def percentiles(df: DataFrame, value: str, group: str, cells: int = 4096) -> DataFrame:
    """group: n, median, mean and p95, the latter the value of rank floor(0.95 n), from 0.

    Values are counted in cells of equal width first; only the few cells that hold a
    wanted rank are then ranked, so a group isn't gathered in one task unless nearly all
    its values are in one cell (equal values there are counted, not ranked).
    Null values are left out."""
    v = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    span = v.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (cells - 1))).otherwise(0)
    placed = v.join(F.broadcast(span.select("g", "lo", "hi")), "g").select("g", "v", cell.alias("c"))
    sizes = placed.groupBy("g", "c").agg(F.count("*").alias("k"))
    below = sizes.withColumn("upto", F.sum("k").over(W.partitionBy("g").orderBy("c")))
    ranks = F.array((F.col("n") - 1).cast("long") / 2, F.col("n") / 2, F.floor(F.col("n") * 0.95))
    wanted = span.select("g", F.posexplode(F.transform(ranks, lambda x: F.floor(x))).alias("which", "rank"))
    found = wanted.join(below, "g").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
    found = F.broadcast(found.select("g", "c", "which", (F.col("rank") - F.col("upto") + F.col("k")).alias("inner")))
    values = placed.join(F.broadcast(found.select("g", "c").distinct()), ["g", "c"]).groupBy("g", "c", "v").agg(F.count("*").alias("k"))
    values = values.withColumn("upto", F.sum("k").over(W.partitionBy("g", "c").orderBy("v")))
    hit = values.join(found, ["g", "c"]).where((F.col("inner") < F.col("upto")) & (F.col("inner") >= F.col("upto") - F.col("k")))
    pick = lambda i: F.max(F.when(F.col("which") == i, F.col("v")))
    at = hit.groupBy("g").agg(((pick(0) + pick(1)) / 2).alias("median"), pick(2).alias("p95"))
    return span.join(at, "g").select(F.col("g").alias(group), "n", "median", "mean", "p95")


def token_scores(labels: DataFrame) -> DataFrame:
    """labels (gold, predicted: BIO label or 'O'; B and I of a type count as one):
    type, tp, fp, fn, precision, recall, f1, with '__micro__' over all and '__direction__'
    over the direction errors."""
    bare = lambda c: F.regexp_replace(c, "^[BI]-", "")
    x = labels.select(bare("gold").alias("g"), bare("predicted").alias("p"))
    seen = x.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("t"), "g", "p").where("t <> 'O'")
    directed = F.col("t").isin([t[0] for t in T.ERROR_TYPES if t[2]])
    both = seen.select(F.explode(F.array_compact(F.array(F.col("t"), F.lit("__micro__"), F.when(directed, "__direction__")))).alias("type"), "t", "g", "p")
    tp, fp, fn = (F.count_if(c) for c in ((F.col("g") == F.col("t")) & (F.col("p") == F.col("t")), (F.col("p") == F.col("t")) & (F.col("g") != F.col("t")), (F.col("g") == F.col("t")) & (F.col("p") != F.col("t"))))
    out = both.groupBy("type").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def evaluation_rows(test: DataFrame, more: DataFrame, limit: int, key: list[str]) -> DataFrame:
    """Up to limit rows of test in key order, then up to limit rows of more that aren't
    among them; source says which."""
    first = test.orderBy(*key).limit(limit)
    rest = more.join(first.select(*key), key, "left_anti").orderBy(*key).limit(limit)
    return first.withColumn("source", F.lit("test")).unionByName(rest.withColumn("source", F.lit("direction")))


def bio_labels(text: str, errors: str):
    """array<string> of a BIO label a character; errors: array<struct<start, end, type>>
    in order, later ones over earlier; ends are clipped."""
    def label(i):
        hit = F.filter(errors, lambda e: (e["start"] <= i) & (i < e["end"]))
        last = F.try_element_at(hit, F.lit(-1))
        return F.when(last.isNull(), "O").when(last["start"] == i, F.concat(F.lit("B-"), last["type"])).otherwise(F.concat(F.lit("I-"), last["type"]))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text), F.lit(1)) - 1), label)


def bio_decode(tokens: DataFrame, key: str = "id", threshold: float | None = None) -> DataFrame:
    """tokens (key, pos, label, confidence) to spans: key, type, start, end, confidence
    (the mean).  A span goes on at I- of its own type; any other label ends it, and I-
    of another type begins one.  A token below the threshold, or of unknown confidence where
    there is a threshold, counts as outside and ends the span before it."""
    if threshold is not None:
        tokens = tokens.withColumn("label", F.when(F.col("confidence") >= threshold, F.col("label")).otherwise("O"))
    by = W.partitionBy(key).orderBy("pos")
    t = tokens.withColumn("type", F.when(F.col("label") != "O", F.regexp_replace("label", "^[BI]-", "")))
    goes_on = F.col("label").startswith("I-") & (F.lag("type").over(by) == F.col("type")) & (F.lag("pos").over(by) == F.col("pos") - 1)
    t = t.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(by))
    return t.where("type is not null").groupBy(key, "run", "type").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.avg("confidence").alias("confidence")).drop("run")
