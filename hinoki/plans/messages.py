"""A message corpus keyed by documents.doc_id, the same in every SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.morph import quote

MESSAGES = [
    "弊社の田中がご説明いたします。ご不明な点は担当者に伺ってください。",
    "田中社長がおっしゃいました。明日、貴社に伺います。",
    "本サービスはどなたでもご利用されます。ご乗車できません。",
    "資料をお読みになられましたか。お返事をお待ちしております。",
    "弊社の田中がお越しになります。鈴木様は十時に参ります。",
    "明日は休まさせていただきます。資料は読まさせていただきました。",
    "ご説明させていただきます。ご案内させていただきまして、確認させていただきました。送付させていただきたいです。",
    "資料を送りました。内容を確認します。会議は明日だ。よろしくお願いいたします。",
    "鈴木様がご覧になりました。私が資料をお持ちになります。",
    "貴社の鈴木様が資料をお送りします。弊社の田中が拝見しました。",
    "お客様がお見えになりました。お召し上がりになる方は、こちらへどうぞ。",
    "ご利用いただき、ありがとうございます。ご持参ください。",
    "私がご連絡いたします。先方の木村様が参ります。",
    "了解しました。取り急ぎ、ご報告まで。",
    "社長がおっしゃられたとおりです。部長がご覧になられました。",
    "弊社の田中がおっしゃっておりました。佐藤様が申しました。",
    "資料をお届けできます。ご記入できない場合は、お知らせください。",
    "貴社に伺っていただけますか。伺ってくださるとのことです。",
    "お忙しい中、原稿をお読みになってくださり、ありがとうございました。高いです。",
    "当社では、新しいプランをご用意しました。ご出席される方は、ご連絡ください。",
    "佐藤様から資料をいただきました。確認しております。後ほどご報告いたします。",
    "鈴木様がおっしゃいました。そのように伺っております。弊社で対応いたします。",
    "会議室を予約した。資料を印刷した。明日の会議に出席します。",
    "いつもお世話になっております。株式会社アルファの山田です。資料をお送りいたします。",
]
AUDIENCES = ["external", "internal", "public"]
WRITER, RECIPIENT = "山田", "佐藤"
PERSONS = [("田中", "self_group"), ("鈴木", "addressee_group")]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, audience, writer, recipient, persons for every document: its own whole text,
    with a message on lines of its own in the middle (a null text is empty)."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("doc_id") % len(MESSAGES) + 1).cast("int"))
    half = F.floor(F.length("t") / 2).cast("int")
    text = F.concat(F.substr("t", F.lit(1), half), F.lit("\n"), message, F.lit("\n"), F.substr("t", half + 1))
    audience = F.element_at(F.array(*map(F.lit, AUDIENCES)), (F.col("doc_id") % 3 + 1).cast("int"))
    persons = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("side")) for n, s in PERSONS))
    return ids.select("doc_id", text.alias("text"), audience.alias("audience"), F.lit(WRITER).alias("writer"), F.lit(RECIPIENT).alias("recipient"), persons.alias("persons"))


def oracle_cte() -> str:
    """The same view, without the context, as a CTE of other engines."""
    pick = lambda rows: f"list_extract([{', '.join(map(quote, rows))}], (doc_id % {len(rows)})::int + 1)"
    text = f"substring(t, 1, (length(t) // 2)::int) || chr(10) || {pick(MESSAGES)} || chr(10) || substring(t, (length(t) // 2)::int + 1)"
    return f"messages as (select doc_id, {text} as text, {pick(AUDIENCES)} as audience from (select doc_id, coalesce(text, '') as t from documents) as own)"
