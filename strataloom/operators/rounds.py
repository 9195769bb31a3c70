"""Sequential choices as rounds of joins, for groups too large for one task: chains of successors by pointer doubling, priorities by local winners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed
from .bands import overlap_join


def reachable(links: DataFrame) -> DataFrame:
    """_key and at of what is reached from each key's first row: links has _key, at (unique in its key), next (null at an end) and first.

    Pointer doubling: rows that are reached in under 2^k steps take the jump of 2^k steps, and the jump is joined with itself. A chain of n steps takes log2(n)
    rounds, whatever task its rows are in; a jump that leads beyond the end is dropped.
    """
    reached = links.where("first").select("_key", "at")
    jump = checkpointed(links.where("next IS NOT NULL").select("_key", "at", "next"))
    while not jump.isEmpty():
        reached = checkpointed(reached.unionByName(reached.join(jump, ["_key", "at"]).select("_key", F.col("next").alias("at"))))
        onward = jump.select("_key", F.col("at").alias("next"), F.col("next").alias("_then"))
        jump = checkpointed(jump.join(onward, ["_key", "next"]).select("_key", "at", F.col("_then").alias("next")))
    return reached


def spacing_links(points: DataFrame, spacing) -> DataFrame:
    """links (see reachable) from _key and at, distinct: the next of each point is the first that is spacing or more after it.

    Points fall into buckets of that width. A point's next is looked for in the bucket where it may begin, by one sort of points and thresholds together, and
    else is the first of the next bucket that has any; only the buckets' firsts are sorted by key.
    """
    bucket = F.floor(F.col("x") / spacing).cast("long")
    own = points.select("_key", F.col("at").alias("x"), F.lit(0).alias("probe"), "at").withColumn("bucket", bucket)
    asked = points.select("_key", (F.col("at") + spacing).alias("x"), F.lit(1).alias("probe"), "at").withColumn("bucket", bucket)
    back = Window.partitionBy("_key", "bucket").orderBy(F.desc("x"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    here = own.unionByName(asked).withColumn("here", F.last(F.when(F.col("probe") == 0, F.col("at")), ignorenulls=True).over(back)).where("probe = 1")
    firsts = own.groupBy("_key", "bucket").agg(F.min("at").alias("first"))
    looked = firsts.unionByName(here.where("here IS NULL").select("_key", "bucket", F.lit(None).cast(points.schema["at"].dataType).alias("first")).distinct())
    after = Window.partitionBy("_key").orderBy(F.desc("bucket"), F.col("first").isNotNull())
    later = looked.withColumn("later", F.last("first", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1))).where("first IS NULL").select("_key", "bucket", "later")
    least = firsts.groupBy("_key").agg(F.min("first").alias("_least"))
    linked = here.join(later, ["_key", "bucket"], "left").select("_key", "at", F.coalesce("here", "later").alias("next"))
    return linked.join(least, "_key").select("_key", "at", "next", (F.col("at") == F.col("_least")).alias("first"))


def suppress_by_rounds(clips: DataFrame, keys: list[str], score: str, number: str, start: str, end: str, width: float) -> DataFrame:
    """As greedy.suppress_overlaps, for keys with any number of clips.

    In each round a clip that is the best undecided one in every time bucket that it touches is kept (whatever overlaps it touches one of them, so nothing better can come),
    and what it overlaps goes; until all are decided. A bucket has one such clip at most, so every step is an aggregation by bucket or a join with one row of each,
    and no pair of clips is made but of a clip and those kept, which are apart from each other. The best clip left is always kept; the rounds are as many as
    the longest chain of clips that wait for each other. Clips of the same span count once: the best of them speaks for all.

    width is the buckets' size; about the clips' usual length is best.
    """
    rank = F.struct((-F.col(score)).alias("s"), F.col(number).alias("n"), F.col(start).alias("a"), F.col(end).alias("b"))
    rows = clips.withColumn("_key", F.struct(*keys)).withColumn("_rank", rank).withColumn("_fit", F.coalesce(F.col(start) <= F.col(end), F.lit(False)))
    spans = checkpointed(rows.where("_fit").groupBy("_key", F.col(start).alias("_a"), F.col(end).alias("_b")).agg(F.min("_rank").alias("_r")))
    touched = F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))
    undecided, kept = spans.withColumn("_bucket", F.explode(touched)), []
    while True:
        best = undecided.groupBy("_key", "_bucket").agg(F.min("_r").alias("_w"))
        won = checkpointed(undecided.join(best, ["_key", "_bucket"]).groupBy("_key", "_r", "_a", "_b").agg(F.min((F.col("_w") == F.col("_r")).cast("int")).alias("_won")).where("_won = 1").drop("_won"))
        kept.append(won)
        there = won.withColumn("_bucket", F.explode(touched)).select("_key", "_bucket", F.col("_a").alias("_wa"), F.col("_b").alias("_wb"))
        lost = undecided.join(there, ["_key", "_bucket"]).where((F.col("_wa") <= F.col("_b")) & (F.col("_a") <= F.col("_wb"))).select("_key", "_r").distinct()  # the winners themselves too
        undecided = checkpointed(undecided.join(lost, ["_key", "_r"], "left_anti"))
        if undecided.isEmpty():
            break
    chosen = reduce(DataFrame.unionByName, kept).select("_key", F.col("_a").alias("_wa"), F.col("_b").alias("_wb"), F.col("_r").alias("_w"))
    by = overlap_join(spans, chosen, ["_key"], ("_a", "_b"), ("_wa", "_wb"), width, closed=True).groupBy("_key", "_r").agg(F.min("_w").alias("_by"))
    decided = spans.join(by, ["_key", "_r"]).select("_key", F.col("_a").alias(start), F.col("_b").alias(end), "_by")
    fit = rows.where("_fit").join(decided, ["_key", start, end])
    again = F.row_number().over(Window.partitionBy("_key", "_rank").orderBy("_rank")) > 1
    beaten = fit.withColumn("_again", again).withColumn("winner", F.when((F.col("_rank") != F.col("_by")) | F.col("_again"), F.col("_by.n")))
    alone = rows.where("NOT _fit").withColumn("winner", F.lit(None).cast(clips.schema[number].dataType))
    return beaten.select(*clips.columns, "winner").unionByName(alone.select(*clips.columns, "winner"))
