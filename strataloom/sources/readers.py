"""Scans: JSON documents and lines, logs, directories, as flat tables keyed by the file they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.media import rational


def packed(spark: SparkSession, path) -> DataFrame:
    """source_id and value of the files, or lines of files, in packs (sinks.writers.write_packs)."""
    return spark.read.schema("source_id string, value string").json(path)


def documents(spark: SparkSession, path, schema: str, packs: bool = False) -> DataFrame:
    """One row for each JSON document, with source_id (its file). packs, here and below: path holds packs of such files."""
    if packs:
        return packed(spark, path).select(F.from_json("value", schema).alias("_d"), "source_id").select("_d.*", "source_id")
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_id", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path, schema: str, packs: bool = False) -> DataFrame:
    """Rows of line-delimited JSON; blank lines are skipped, malformed ones give nulls."""
    if packs:
        return log_lines(spark, path, True).where(F.trim("value") != "").select(F.from_json("value", schema).alias("_d"), "source_id").select("_d.*", "source_id")
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).withColumn("source_id", F.col("_metadata.file_path"))


def asr_words(spark: SparkSession, path, timed_only: bool = False, packs: bool = False) -> DataFrame:
    """source_id, i (from 1), w, s, e and seg_start of every word; timed_only skips those without a start."""
    docs = documents(spark, path, schemas.ASR, packs)
    words = docs.select("source_id", F.posexplode("segments").alias("seg", "x")).select("source_id", "seg", F.col("x.start").alias("seg_start"), F.posexplode("x.words").alias("k", "y"))
    flat = words.select("source_id", "seg", "k", F.trim(F.coalesce("y.word", F.lit(""))).alias("w"), F.col("y.start").alias("s"), F.col("y.end").alias("e"), "seg_start")
    flat = flat.where("s IS NOT NULL") if timed_only else flat
    from pyspark.sql import Window

    return flat.withColumn("i", F.row_number().over(Window.partitionBy("source_id").orderBy("seg", "k")).cast("long")).select("source_id", "i", "w", "s", "e", "seg_start")


def asr_segments(spark: SparkSession, path) -> DataFrame:
    docs = documents(spark, path, schemas.ASR)
    return docs.select("source_id", F.posexplode("segments").alias("seg", "x")).select("source_id", "seg", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def transcript_words(spark: SparkSession, path) -> DataFrame:
    docs = documents(spark, path, schemas.TRANSCRIPT)
    return docs.select("source_id", "duration", F.posexplode("words").alias("i", "x")).select("source_id", "duration", "i", "x.text", "x.start", "x.end")


def speech_map(spark: SparkSession, path, packs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(header, blocks): one row for each map, and its blocks."""
    docs = documents(spark, path, schemas.SPEECH_MAP, packs)
    return docs.select("source_id", "source", "fps", "duration", "width", "height", "samplerate", "thresholds.rescued"), docs.select("source_id", F.explode("blocks").alias("b")).select("source_id", "b.*")


def candidates(spark: SparkSession, path, packs: bool = False) -> DataFrame:
    """source_id, n (from 1) and the candidates' fields."""
    return documents(spark, path, schemas.CANDIDATES, packs).select("source_id", F.posexplode("clips").alias("k", "c")).select("source_id", (F.col("k") + 1).alias("n"), "c.*")


def exploded(spark: SparkSession, path, schema: str, field: str, packs: bool = False) -> DataFrame:
    """source_id, ord, the document's other fields, and those of each entry of its list `field`: cuts, scenes, plans, probes."""
    docs = documents(spark, path, schema, packs)
    rest = [c for c in T.StructType.fromDDL(schema).names if c != field]
    return docs.select("source_id", *rest, F.posexplode(field).alias("ord", "x")).select("source_id", *rest, "ord", "x.*")


def container(spark: SparkSession, path) -> DataFrame:
    """source_id, and duration, rate, size and sample rate from probed stream descriptions."""
    return stream_facts(documents(spark, path, schemas.CONTAINER), "source_id")


def stream_facts(docs: DataFrame, *keys: str) -> DataFrame:
    first = lambda kind: F.get(F.filter("streams", lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = first("video"), first("audio")
    return docs.select(*keys, F.col("format.duration").cast("double").alias("duration"), rational(v["r_frame_rate"]).alias("fps"), v["width"].alias("width"), v["height"].alias("height"), F.coalesce(a["sample_rate"].cast("int"), F.when(a.isNotNull(), 48000)).alias("samplerate"))


def scraped(logs: DataFrame, pattern: str, column: str = "value", out: str = "x") -> DataFrame:
    """The numbers that the pattern's first group finds in each line of a log, with the log's other columns."""
    rest = [c for c in logs.columns if c != column]
    return logs.select(*rest, F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("_x")).select(*rest, F.col("_x").cast("double").alias(out))


def log_lines(spark: SparkSession, path, packs: bool = False) -> DataFrame:
    if packs:
        return packed(spark, path).select(F.explode(F.split("value", "\n")).alias("value"), "source_id")
    return spark.read.text(path).withColumn("source_id", F.col("_metadata.file_path"))


def silence_events(logs: DataFrame) -> DataFrame:
    """at and kind ('s' start, 'e' end); times before 0 aren't matched."""
    starts = scraped(logs, r"silence_start: ([\d.]+)", out="at").withColumn("kind", F.lit("s"))
    return starts.unionByName(scraped(logs, r"silence_end: ([\d.]+)", out="at").withColumn("kind", F.lit("e")))


def rms_levels(logs: DataFrame) -> DataFrame:
    return scraped(logs, MEASURES["level"], out="level")


def scene_times(logs: DataFrame) -> DataFrame:
    return scraped(logs, MEASURES["scene"], out="t")


def mean_volumes(logs: DataFrame) -> DataFrame:
    return scraped(logs, MEASURES["volume"], out="db")


#: The numbers of a measuring log by kind.
MEASURES = {"level": r"RMS_level=(-?[\d.]+)", "scene": r"pts_time:([\d.]+)", "volume": r"mean_volume:\s*(-?[\d.]+) dB"}


def measures(logs: DataFrame) -> DataFrame:
    """what (a kind of MEASURES) and x of all of them, with the log's other columns: rms_levels, scene_times and mean_volumes in one pass."""
    rest = [c for c in logs.columns if c != "value"]
    found = lambda kind, pattern: F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("what"), x.cast("double").alias("x")))
    return logs.select(*rest, F.explode(F.concat(*[found(*m) for m in MEASURES.items()])).alias("_m")).select(*rest, "_m.*")


def detections(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.DETECTIONS).option("multiLine", True).json(path).withColumn("source_id", F.col("_metadata.file_path"))


def registry(spark: SparkSession, path) -> DataFrame:
    """Registry lines with ord, their order in the log (of one file)."""
    return json_lines(spark, path, schemas.PACKAGE).withColumn("ord", F.monotonically_increasing_id())


def listing(spark: SparkSession, folder: str, glob: str = "*", packs: bool = False) -> DataFrame:
    """path, package (the folder's name), file, modified and size of the files below a folder; contents aren't read. Of packs, source_id is the path, and the pack's time the file's."""
    if packs:
        from fnmatch import translate

        entries = spark.read.schema("source_id string, length long").json(folder).select(F.col("source_id").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"), "length")
        files = entries.where(F.element_at(F.split("path", "/"), -1).rlike(translate(glob)))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "modificationTime", "length")
    parts = F.split("path", "/")
    return files.select("path", F.try_element_at(parts, F.lit(-2)).alias("package"), F.element_at(parts, -1).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
