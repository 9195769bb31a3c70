"""Stand-ins for transcripts, maps and detections among the driver's tables.

A user's events are a recording's words: they start at ts and last value * 1000 seconds, all in whole milliseconds, and say their
type. Views are speech blocks. A conversation's turns are long utterances; its words come one after another. The first floats of
embeddings make rectangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

HOUR = 3_600_000
BASE = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i, s, e, w, event_id, value."""
    s = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("s"), (s + F.floor(F.col("value") * 1000) * 1000).alias("e"), F.col("event_type").alias("w"), "value", "ts")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")).drop("ts")


WORDS = """w AS (SELECT user_id, event_id, value, event_type AS w, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) * 1000 AS e,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of words, with all events of a type as one recording: few and long ones. user_id is the type."""
    w = words(spark, sf_dir)
    return w.withColumn("user_id", F.col("w")).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("s", "event_id")).cast("long"))


STREAMS = WORDS.replace("SELECT user_id, ", "SELECT event_type AS user_id, ").replace("PARTITION BY user_id ORDER BY ts", "PARTITION BY event_type ORDER BY epoch_us(ts) // 1000")


def blocks(w: DataFrame, kind: str = "view") -> DataFrame:
    """user_id, b, b0, b1: the events of a kind."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("s", "event_id")) - 1
    return w.where(F.col("w") == kind).select("user_id", n.cast("long").alias("b"), F.col("s").alias("b0"), F.col("e").alias("b1"))


BLOCKS = "b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS b, s AS b0, e AS b1 FROM w WHERE w = 'view')"


def _spoken_words() -> Column:
    return F.filter(F.split("text", r"\s+"), lambda x: x != "")


def _tenths(i: Column, turn: str) -> Column:
    return i * 4 + F.col(turn) * 30 + F.floor(F.col(turn) / 4) * 60


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, opens (a turn's first word), i, text, start, end (seconds): the words of a conversation, 0.3 s each, 0.1 s apart, 3 s more after a turn and 9 s after every fourth."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(_spoken_words()).alias("k", "text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "k")
    rows = turns.withColumn("i", F.row_number().over(w) - 1).withColumn("tenths", _tenths(F.col("i"), "turn"))
    return rows.select("conv_id", "turn", (F.col("k") == 0).alias("opens"), F.col("i").cast("long").alias("i"), "text", (F.col("tenths") / 10).alias("start"), ((F.col("tenths") + 3) / 10).alias("end"))


def spoken_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, duration: the end of the last word of spoken, which is the latest, by the number of words and the last turn that has any."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(_spoken_words()).cast("long").alias("n")).where("n > 0")
    whole = turns.groupBy("conv_id").agg(F.sum("n").alias("n"), F.max("turn").alias("turn"))
    return whole.select("conv_id", ((_tenths(F.col("n") - 1, "turn") + 3) / 10).alias("duration"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and a (from floats 1-4) and b (from 5-8): rectangles of whole pixels in a 1000 x 600 frame."""
    px = lambda k, lo, n: F.lit(lo).cast("long") + F.pmod(F.floor(F.abs(F.get("embedding", F.lit(k))).cast("double") * 10000).cast("long"), F.lit(n))
    rect = lambda k: F.array(px(k, 0, 500), px(k + 1, 0, 300), px(k + 2, 40, 400), px(k + 3, 40, 250)).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", rect(0).alias("a"), rect(4).alias("b"))


RECTS = """px AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 10000) AS BIGINT)) AS v FROM embeddings),
    r AS (SELECT vec_id, label, [(v[1] % 500)::DOUBLE, (v[2] % 300)::DOUBLE, (40 + v[3] % 400)::DOUBLE, (40 + v[4] % 250)::DOUBLE] AS a,
          [(v[5] % 500)::DOUBLE, (v[6] % 300)::DOUBLE, (40 + v[7] % 400)::DOUBLE, (40 + v[8] % 250)::DOUBLE] AS b FROM px)"""
