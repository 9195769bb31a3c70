"""Package registry, settings, ranked names, and the mechanical copy rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import clip_name
from ..functions.text import slug
from ..params import SETTINGS


def latest_registry(log: DataFrame, key: str = "path", order: str = "ord", date: str = "date") -> DataFrame:
    """The last entry of each path (a missing path is "" like any other), newest date first, missing dates last."""
    from .bands import last_wins

    keyed = log.withColumn(key, F.coalesce(key, F.lit("")))
    return last_wins(keyed, [key], order).orderBy(F.desc(F.coalesce(date, F.lit(""))), key)


def settings(saved: DataFrame) -> DataFrame:
    """One row of settings: saved (column name -> value map `settings`; none or one row) over the defaults; unknown keys are left out."""
    spark = saved.sparkSession
    base = spark.range(1).select(*[F.lit(v).alias(f"_{k}") for k, v in SETTINGS.items()])
    one = saved.limit(1)
    return base.join(one, F.lit(True), "left").select(*[F.coalesce(F.col("settings")[k], F.col(f"_{k}")).alias(k) for k in SETTINGS])


def overlay(defaults: Column, given: Column) -> Column:
    """The map of defaults with the values of the same keys in given."""
    return F.transform_values(defaults, lambda k, v: F.coalesce(given[k], v))


def scan_packages(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """package, rank, score, title, file and mode of each package's ranked clips. files: package, file (a name); manifest: package, title, total_score, n.

    Clips are numbered by rank as a number, the manifest's by score, and titles are taken by place.
    """
    from .bands import zip_by_position

    clips = files.select("package", "file", *[c.alias(k) for k, c in clip_name(F.col("file")).items()]).where("rank IS NOT NULL")
    titles = manifest.select("package", F.col("title").alias("_title"), F.col("total_score").alias("_score"), F.col("n").alias("_n"))
    both = zip_by_position(clips, titles, ["package"], [F.col("rank"), F.col("file")], [F.desc("_score"), F.col("_n")])
    long = F.max((F.col("kind") == "LONG").cast("int")).over(Window.partitionBy("package")) == 1
    return both.select("package", "rank", "score", F.coalesce(F.nullif("_title", F.lit("")), "title").alias("title"), "file", F.when(long, "longform").otherwise("shorts").alias("mode"))


def ranked_name(rank: Column, score: Column, title: Column, longform: Column) -> Column:
    return F.concat(rank.cast("string"), F.when(longform, F.lit(" LONG ")).otherwise(F.lit(" CLIP ")), score.cast("string"), F.lit(" - "), slug(title))


def shortlist(windows: DataFrame, target: int, least: float = 55.0) -> DataFrame:
    """The densest windows, about two for each clip wanted."""
    return windows.where(F.col("density") >= least).orderBy(F.desc("density"), "start").limit(2 * target)


def long_form_count(seconds: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(6), F.floor(seconds / 60 / 15))).cast("int")


def copy_faults(title: Column, headline: Column, why: Column, hashtags: Column, banned: tuple[str, ...] = ()) -> Column:
    """Which of the mechanical rules of a clip's copy are broken."""
    words = F.filter(F.split(headline, r"\s+"), lambda x: x != "")
    found = reduce(lambda a, b: a | b, [F.contains(F.lower(F.concat_ws(" ", title, headline, why)), F.lit(b.lower())) for b in banned], F.lit(False))
    tests = {"title over 38": F.length(title) > 38, "headline not 3-5 words": ~F.size(words).between(3, 5), "headline not upper case": headline != F.upper(headline), "why over 80": F.length(why) > 80, "hashtags not 3-5": ~F.size(hashtags).between(3, 5), "banned phrase": found}
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def unread(windows: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that no one read."""
    return windows.join(read, keys, "left_anti")


def music_folder(configured: Column, default: Column) -> Column:
    """The configured folder ("disabled" is an answer too; blank is none), else the default folder if there is one, else "unconfigured"."""
    return F.coalesce(F.nullif(F.trim(configured), F.lit("")), default, F.lit("unconfigured"))


def pick_tracks(clips: DataFrame, tracks: DataFrame, keys: list[str], clip: str, draw: str) -> DataFrame:
    """clips with a track each, none twice in a package: tracks in the order of their draw (a seeded random number), ties by track."""
    from .bands import zip_by_position

    return zip_by_position(clips, tracks, keys, [F.col(clip)], [F.col(draw), F.col("track")])


def enough(counts: Column, target: int = 6, floor: int = 4) -> Column:
    """Whether a package has its clips: full, short or too few."""
    return F.when(counts >= target, "full").when(counts >= floor, "short").otherwise("too few")


def revived(candidates: DataFrame, number: int) -> DataFrame:
    """One candidate from the saved stage, to be compiled again."""
    return candidates.where(F.col("n") == number)
