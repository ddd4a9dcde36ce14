"""The driver's tables seen as cues, tokens, speech, lines and artifacts: as DataFrames and as SQL with the same rows.

Times come from whole milliseconds, so both sides compute the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


EPOCH_US = 1_704_067_200_000_000
DURATION = 4400.0
TOKEN_KEYS = ["media_id", "window_index"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) media_id", "cast(turn + 1 as int) id", "(turn * 4250 + conv_id % 7 * 100) / 1000.0D start", "(turn * 4250 + conv_id % 7 * 100 + 3000 + turn % 3 * 700) / 1000.0D end",
        "text", "case turn % 4 when 0 then concat('P: ', text) when 1 then '' end proofread", "case turn % 2 when 0 then concat('T: ', text) end translation",
    )


CUES = """cues as (select cast(conv_id as varchar) media_id, cast(turn + 1 as int) id, (turn * 4250 + conv_id % 7 * 100) / 1000.0::double as start, (turn * 4250 + conv_id % 7 * 100 + 3000 + turn % 3 * 700) / 1000.0::double as "end",
  text, case turn % 4 when 0 then concat('P: ', text) when 1 then '' end proofread, case turn % 2 when 0 then concat('T: ', text) end translation from conversations)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("pos", "text"))
    at = "(pos * 400 + pos % 5 * 80 + pos div 9 * 900)"
    return words.selectExpr("cast(conv_id as string) media_id", "cast(turn as int) window_index", "pos", "text", f"{at} / 1000.0D start", f"({at} + 250 + pos % 4 * 30) / 1000.0D end")


TOKENS = """words as (select conv_id, turn, unnest(w) as text, unnest(range(len(w))) pos from (select conv_id, turn, regexp_extract_all(text, '[^ \\n]+') w from conversations)),
tokens as (select cast(conv_id as varchar) media_id, cast(turn as int) window_index, cast(pos as int) pos, text, (pos * 400 + pos % 5 * 80 + pos // 9 * 900) / 1000.0::double as start,
  (pos * 400 + pos % 5 * 80 + pos // 9 * 900 + 250 + pos % 4 * 30) / 1000.0::double as "end" from words)"""


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div 600000 / 1000.0D"
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) media_id", f"{at} start", f"{at} + 1.0D + value end")


SPEECH = f"""speech as (select cast(user_id as varchar) media_id, (epoch_us(ts) - {EPOCH_US}) // 600000 / 1000.0::double as start, (epoch_us(ts) - {EPOCH_US}) // 600000 / 1000.0::double + 1.0::double + value as "end" from events),
media as (select distinct media_id, {DURATION}::double duration from speech)"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("media_id"), F.lit(DURATION).alias("duration")).distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations with a span; every third has none and every seventh one without length."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) media_id", "cast(turn + 1 as int) line_no", "text",
        "case when (conv_id + turn) % 3 <> 0 then (turn * 3000 + conv_id % 5 * 211) / 1000.0D end start",
        "case when (conv_id + turn) % 3 <> 0 then (turn * 3000 + conv_id % 5 * 211 + case when (conv_id + turn) % 7 = 0 then 0 else 3500 end) / 1000.0D end end",
    )


LINES = """lines as (select cast(conv_id as varchar) media_id, cast(turn + 1 as int) line_no, text,
  case when (conv_id + turn) % 3 <> 0 then (turn * 3000 + conv_id % 5 * 211) / 1000.0::double end as start,
  case when (conv_id + turn) % 3 <> 0 then (turn * 3000 + conv_id % 5 * 211 + case when (conv_id + turn) % 7 = 0 then 0 else 3500 end) / 1000.0::double end as "end" from conversations)"""


def line_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).selectExpr("cast(conv_id as string) media_id", "last * 3.0D + 2.0D duration")


LINE_MEDIA = "line_media as (select cast(conv_id as varchar) media_id, max(turn) * 3.0::double + 2.0::double duration from conversations group by conv_id)"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of labelled documents: the transcript, and of those that are not toxic the alignment too; media are sources."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    asr = docs.selectExpr(*_COMMON, "'asr' kind", "lang language", "cast(null as string) transcript_sha1", "concat('said ', doc_id) payload")
    placed = docs.where("toxic = 0").selectExpr(*_COMMON, "'alignment' kind", "lang language", "sha1(text) transcript_sha1", "concat('placed ', doc_id) payload")
    return asr.unionByName(placed)


_COMMON = ["source media_id", "cast(doc_id as int) window_index", "doc_id * 1.5D start", "doc_id * 1.5D + 2.25D end", "1 version", "case when quality = 1 then 'large' else 'small' end model_id", "1700000000 + doc_id * 17 % 100000 mtime"]
ARTIFACTS = """docs as (select * from documents join (select doc_id, quality, toxic from labels) using (doc_id)),
artifacts as (select source media_id, cast(doc_id as int) window_index, doc_id * 1.5::double as start, doc_id * 1.5::double + 2.25::double as "end", 1 as version, case when quality = 1 then 'large' else 'small' end model_id,
  1700000000 + doc_id * 17 % 100000 mtime, 'asr' kind, lang as language, null::varchar transcript_sha1, concat('said ', doc_id) payload from docs
  union all select source, cast(doc_id as int), doc_id * 1.5::double, doc_id * 1.5::double + 2.25::double, 1, case when quality = 1 then 'large' else 'small' end, 1700000000 + doc_id * 17 % 100000, 'alignment', lang, sha1(text), concat('placed ', doc_id) from docs where toxic = 0)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window per document; every fifth has other bounds than its artifacts, every third another language."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source media_id", "cast(doc_id as int) window_index", "doc_id * 1.5D start", "doc_id * 1.5D + case when doc_id % 5 = 0 then 2.5D else 2.25D end end",
        "case when doc_id % 3 = 0 then 'xx' else lang end hint", "case when doc_id % 3 = 0 then 'xx' else lang end language", "case when doc_id % 4 = 3 then concat(text, '!') else text end transcript",
    )


WINDOWS = """windows as (select source media_id, cast(doc_id as int) window_index, doc_id * 1.5::double as start, doc_id * 1.5::double + case when doc_id % 5 = 0 then 2.5::double else 2.25::double end as "end",
  case when doc_id % 3 = 0 then 'xx' else lang end hint, case when doc_id % 4 = 3 then concat(text, '!') else text end transcript from documents)"""
