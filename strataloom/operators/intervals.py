"""Interval algebra in closed form: window functions over ordered events, no loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def impute_times(words: DataFrame, keys: list[str], order: str, start: str = "s", end: str = "e", fallback: str = "seg_start", cap: float = 0.5, last_cap: float = 0.3) -> DataFrame:
    """words with every start and end known, from what lies around them.

    A missing start is the previous row's filled end, at first the segment's start. A missing end is the next known start, at most cap
    after the start; without one, last_cap after the start. Runs of rows with neither go on from the last row that has either (its
    anchor), so that row k of a run ends k caps after it, but never past the next known start: nothing is sequential.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    s, e = F.col(start), F.col(end)
    rows = words.withColumn("_next", F.first(start, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("_run", F.sum((s.isNotNull() | e.isNotNull()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    anchor_end = F.when(e.isNotNull(), e).when(F.col("_next").isNotNull(), F.least("_next", s + cap)).otherwise(s + last_cap)
    run = Window.partitionBy(*keys, "_run").orderBy(order)
    first_fallback = F.first(fallback).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_base", F.when(F.col("_run") == 0, first_fallback).otherwise(F.first(F.when(s.isNotNull() | e.isNotNull(), anchor_end)).over(run)))
    rows = rows.withColumn("_k", F.row_number().over(run) - F.when(F.col("_run") == 0, 0).otherwise(1))
    step = F.col("_base") + F.col("_k") * F.when(F.col("_next").isNotNull(), cap).otherwise(last_cap)
    filled = rows.withColumn("_e", F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.when(F.col("_next").isNotNull(), F.least("_next", step)).otherwise(step)))
    filled = filled.withColumn("_s", F.coalesce(s, F.lag("_e").over(w), F.col(fallback)))
    # a known start whose end is missing was capped from itself; a missing start with a known end keeps that end
    return filled.select(*[F.col("_s").alias(start) if c == start else F.col("_e").alias(end) if c == end else F.col(c) for c in words.columns])


def speech_blocks(events: DataFrame, keys: list[str], at: str, kind: str, durations: DataFrame, duration: str, least=0.05) -> DataFrame:
    """The complement of silences: keys, block (from 0), start and end.

    Events are the starts ('s') and ends ('e') of silences, in any order; at a tie an end comes first. A block runs from the last end, or 0,
    to a start that no open silence precedes, or to the duration; it must be longer than least. durations has a row for each keys.
    """
    close = durations.select(*keys, F.col(duration).alias("at"), F.lit("z").alias("kind"))
    every = events.select(*keys, F.col(at).alias("at"), F.col(kind).alias("kind")).unionByName(close)
    w = Window.partitionBy(*keys).orderBy((F.col("kind") == "z").cast("int"), "at", "kind")
    zero = F.lit(0).cast(every.schema["at"].dataType)
    seen = every.withColumn("_open", F.coalesce(F.lag("kind").over(w), F.lit("e")) == "s").withColumn("start", F.coalesce(F.last(F.when(F.col("kind") == "e", F.col("at")), ignorenulls=True).over(_before(w)), zero))
    found = seen.where((F.col("kind") != "e") & ~F.col("_open") & (F.col("at") - F.col("start") > least))
    return found.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at", "start")) - 1).alias("block"), "start", F.col("at").alias("end"))


def gap_after(blocks: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return blocks.withColumn("gap_after", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)) - F.col(end))


def degenerate(blocks: DataFrame, keys: list[str], durations: DataFrame, duration: str, most_speech: float = 0.95, tiny=0.4, tiny_share: float = 0.7, tiny_blocks: int = 10) -> DataFrame:
    """keys and degenerate: no blocks, nearly all speech, or over tiny_blocks blocks of which most are tiny. One aggregation."""
    length = F.col("end") - F.col("start")
    facts = blocks.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(length).alias("speech"), F.sum((length < tiny).cast("int")).alias("tiny"))
    out = durations.join(facts, keys, "left")
    bad = F.col("n").isNull() | (F.col("speech") > F.col(duration) * most_speech) | ((F.col("n") > tiny_blocks) & (F.col("tiny") > F.col("n") * tiny_share))
    return out.select(*keys, F.coalesce(bad, F.lit(True)).alias("degenerate"))


def choose_map(plain: DataFrame, rescued: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of the plain thresholds, or of the calibrated ones where the plain map is degenerate, with column rescued."""
    flag = verdicts.select(*keys, "degenerate")
    a = plain.join(flag, keys).where(~F.col("degenerate")).drop("degenerate").withColumn("rescued", F.lit(False))
    return a.unionByName(rescued.join(flag, keys).where(F.col("degenerate")).drop("degenerate").withColumn("rescued", F.lit(True)))


def order_statistics(values: DataFrame, keys: list[str], value: str, ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """keys, n and stats: the values at the places (from 0) that ranks give for a group of n, exactly; a place outside of 0 to n - 1 gives null.

    Counts by bucket of the values' magnitude (64 to a doubling) say which bucket has a place; only that bucket's values are counted one by one, so no task ever
    has a group's values, however many there are. Null values and NaN don't count.
    """
    v = F.col(value).cast("double")
    size = F.when(F.abs(v) == float("inf"), 1_000_000).otherwise(F.floor(F.log2(F.abs(v)) * 64) + 100_000)
    bucket = F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")
    own = values.where(F.col(value).isNotNull() & ~F.isnan(v)).select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"), bucket.alias("_bucket"))
    along, whole = Window.partitionBy("_key").orderBy("_bucket"), Window.partitionBy("_key")
    counts = own.groupBy("_key", "_bucket").agg(F.count("*").alias("_m")).withColumn("_below", F.coalesce(F.sum("_m").over(_before(along)), F.lit(0))).withColumn("n", F.sum("_m").over(whole))
    places = F.array(*[r(F.col("n")).cast("long") for r in ranks])
    wanted = counts.select("_key", "_bucket", "_below", "_m", "n", F.posexplode(places).alias("_i", "_place")).where((F.col("_place") >= F.col("_below")) & (F.col("_place") < F.col("_below") + F.col("_m")))
    inside = own.join(wanted, ["_key", "_bucket"]).groupBy("_key", "_i", "_place", "_below", "_v").agg(F.count("*").alias("_same"))
    upto = F.col("_below") + F.sum("_same").over(Window.partitionBy("_key", "_i").orderBy("_v"))
    found = inside.withColumn("_upto", upto).where((F.col("_place") < F.col("_upto")) & (F.col("_place") >= F.col("_upto") - F.col("_same")))
    stats = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_stats"))
    totals = counts.groupBy("_key").agg(F.first("n").alias("n"))
    return totals.join(stats, "_key", "left").select("_key.*", "n", F.array(*[F.try_element_at("_stats", F.lit(k)) for k in range(len(ranks))]).alias("stats"))


def thresholds(levels: DataFrame, keys: list[str], level: str, in_offset: float = 14, out_offset: float = 22, guard: float = 10) -> DataFrame:
    """keys, in_db and out_db from the 10th and 90th of a hundred ordered levels; -30 and -38 for under 20 levels."""
    at = order_statistics(levels, keys, level, [lambda n: F.floor(n * F.lit(0.9)), lambda n: F.floor(n * F.lit(0.1))])
    hi, lo = F.get("stats", F.lit(0)), F.get("stats", F.lit(1))
    out_db = F.greatest(hi - out_offset, lo + guard)
    in_db = F.greatest(hi - in_offset, out_db + 6)
    few = F.col("n") < 20
    return at.select(*keys, F.when(few, -30.0).otherwise(in_db).alias("in_db"), F.when(few, -38.0).otherwise(out_db).alias("out_db"))


def gaps(ranges: DataFrame, blocks: DataFrame, keys: list[str], range_id: str, width: float, least=0.35, margin=0.06) -> DataFrame:
    """keys, range_id, start and end of what no block covers within each range (columns t0, t1), shrunk by margin at both sides.

    Covered so far is a running maximum of block ends, so nested and overlapping blocks need no merging first.
    """
    from .bands import overlap_join

    clipped = overlap_join(ranges.select(*keys, range_id, "t0", "t1"), blocks.select(*keys, F.col("start").alias("b0"), F.col("end").alias("b1")), keys, ("t0", "t1"), ("b0", "b1"), width)
    clipped = clipped.select(*keys, range_id, "t0", "t1", F.greatest("b0", "t0").alias("b0"), F.least("b1", "t1").alias("b1"))
    ends = ranges.select(*keys, range_id, "t0", "t1", F.col("t1").alias("b0"), F.col("t1").alias("b1"))
    w = Window.partitionBy(*keys, range_id).orderBy("b0", "b1")
    seen = clipped.unionByName(ends).withColumn("cursor", F.coalesce(F.max("b1").over(_before(w)), F.col("t0")))
    wide = seen.where(F.col("b0") - F.col("cursor") >= least + 2 * margin)
    return wide.select(*keys, range_id, (F.col("cursor") + margin).alias("start"), (F.col("b0") - margin).alias("end")).distinct()


def bed_verdict(gap_levels: DataFrame, sources: DataFrame, keys: list[str], evidence=0.8, floor_db: float = -38.0) -> DataFrame:
    """keys and bed ('skip' or 'ok') from gaps with measured levels (db may be null) and each source's rescued flag.

    Too little gap time, or no measured level, leaves it to the flag; else the duration-weighted mean level decides, or the flag.
    """
    d = F.col("end") - F.col("start")
    known = F.when(F.col("db").isNotNull(), d)
    facts = gap_levels.groupBy(*keys).agg(F.sum(d).alias("total"), F.sum(known).alias("known"), F.sum(known * F.col("db")).alias("weighted"))
    out = sources.join(facts, keys, "left")
    loud = (F.coalesce("total", F.lit(0)) >= evidence) & F.coalesce(F.try_divide("weighted", "known") > floor_db, F.lit(False))
    return out.select(*keys, F.coalesce("total", F.lit(0)).alias("total"), F.try_divide("weighted", "known").alias("mean_db"), F.when(loud | F.col("rescued"), "skip").otherwise("ok").alias("bed"))


def tile(ranges: DataFrame, cuts: DataFrame, keys: list[str], range_id: str, start: str = "in_frame", end: str = "out_frame", cut: str = "cut") -> DataFrame:
    """Contiguous regions of each range between its cuts: keys, range_id, in_frame and out_frame."""
    bounds = ranges.select(*keys, range_id, F.col(start).alias("at")).unionByName(ranges.select(*keys, range_id, F.col(end).alias("at"))).unionByName(cuts.select(*keys, range_id, F.col(cut).alias("at")))
    w = Window.partitionBy(*keys, range_id).orderBy("at")
    return bounds.withColumn("out_frame", F.lead("at").over(w)).where("out_frame IS NOT NULL").select(*keys, range_id, F.col("at").alias("in_frame"), "out_frame")


def tiling_faults(regions: DataFrame, segments: DataFrame, keys: list[str], region_order: str, segment_order: str) -> DataFrame:
    """keys and fault for each plan whose regions don't tile its segments exactly and in order: none covers, starts at, crosses, extra.

    Laid end to end, the n-th region must begin where the one before ended, or at its segment's start. Regions are matched to segments by
    the running length of both, so that no loop walks them; a plan's first fault is given.
    """
    w = Window.partitionBy(*keys).orderBy(region_order)
    r = regions.select(*keys, F.col(region_order).alias("n"), F.col("in_frame").alias("a"), F.col("out_frame").alias("b")).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("n")))
    r = r.withColumn("done", F.coalesce(F.sum(F.col("b") - F.col("a")).over(_before(Window.partitionBy(*keys).orderBy("n"))), F.lit(0)))
    v = Window.partitionBy(*keys).orderBy(segment_order)
    s = segments.select(*keys, F.col("in_frame").alias("c"), F.col("out_frame").alias("d"), F.coalesce(F.sum(F.col("out_frame") - F.col("in_frame")).over(_before(v)), F.lit(0)).alias("from"))
    s = s.where("d > c").withColumn("to", F.col("from") + F.col("d") - F.col("c"))
    from .bands import band_join

    placed = band_join(r, s, keys, "done", "from", "to", 1000.0, how="left")
    expected = F.col("c") + F.col("done") - F.col("from")
    fault = F.when(F.col("c").isNull(), "extra").when(F.col("a") != expected, "starts").when(F.col("b") > F.col("d"), "crosses").when(F.col("b") <= F.col("a"), "empty")
    faults = placed.withColumn("fault", fault).where("fault IS NOT NULL").groupBy(*keys).agg(F.min_by("fault", "n").alias("fault"))
    totals = s.groupBy(*keys).agg(F.max("to").alias("need")).join(r.groupBy(*keys).agg(F.max(F.col("done") + F.col("b") - F.col("a")).alias("have")), keys, "left")
    short = totals.where(F.coalesce("have", F.lit(0)) < F.col("need")).select(*keys, F.lit("uncovered").alias("short"))
    return faults.join(short, keys, "full").select(*keys, F.coalesce("fault", "short").alias("fault"))


def running_offsets(clips: DataFrame, keys: list[str], order: str, length: Column) -> DataFrame:
    """clips with start and end on the output timeline: the running sum of the lengths before."""
    w = Window.partitionBy(*keys).orderBy(order)
    start = F.coalesce(F.sum(length).over(_before(w)), F.lit(0))
    return clips.withColumn("timeline_start", start).withColumn("timeline_end", F.col("timeline_start") + length)


def local_cues(cues: DataFrame, shorts: DataFrame, keys: list[str], width: float, shortest=0.18, least=0.02) -> DataFrame:
    """Each short's own timeline: its cues (text) and the gaps between them (text null), without spans of least or less.

    shorts has short, a and b; cues has start, end and text. A cue is shown for shortest at least.
    """
    from .bands import overlap_join

    hit = overlap_join(shorts.select(*keys, "short", "a", "b"), cues.select(*keys, "start", "end", "text"), keys, ("a", "b"), ("start", "end"), width)
    length = F.col("b") - F.col("a")
    zero = F.lit(0).cast("double")
    local = hit.withColumn("_a", F.greatest(zero, F.col("start") - F.col("a"))).withColumn("_b", F.least(length, F.greatest(F.col("_a") + shortest, F.col("end") - F.col("a")))).where((F.col("_b") > 0) & (F.col("_a") < length))
    w = Window.partitionBy(*keys, "short").orderBy("start", "end", "text")
    local = local.withColumn("_prev", F.coalesce(F.lag("_b").over(w), zero)).withColumn("_last", F.lead("_b").over(w).isNull())
    shown = local.select(*keys, "short", F.col("_a").alias("start"), F.col("_b").alias("end"), "text")
    blank = local.where(F.col("_a") > F.col("_prev")).select(*keys, "short", F.col("_prev").alias("start"), F.col("_a").alias("end"), F.lit(None).cast("string").alias("text"))
    tail = local.where(F.col("_last") & (F.col("_b") < length)).select(*keys, "short", F.col("_b").alias("start"), length.alias("end"), F.lit(None).cast("string").alias("text"))
    return shown.unionByName(blank).unionByName(tail).where(F.col("end") - F.col("start") > least)


def merge_equal(rows: DataFrame, keys: list[str], order: str, value: str, start: str, end: str) -> DataFrame:
    """Runs of rows with an equal value as one row: islands by a running count of changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    marked = rows.withColumn("_first", F.when(F.row_number().over(w) == 1, 0).otherwise(change)).withColumn("_island", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.first(value).alias(value), F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def drop_repeats(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_new", (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))).where("_new").drop("_new")


def caption_holds(words: DataFrame, keys: list[str], order: str, fps: float, hold: float = 1.0, fade: int = 6) -> DataFrame:
    """start_f, end_f and visible_f (frames): a caption stays until the next starts if that is under hold seconds away, else fades."""
    w = Window.partitionBy(*keys).orderBy(order)
    start_f = F.greatest(F.lit(0), F.floor(F.col("start") * fps))
    rows = words.withColumn("start_f", start_f.cast("long")).withColumn("end_f", F.greatest(F.col("start_f") + 1, F.floor(F.col("end") * fps + 0.5)).cast("long"))
    rows = rows.withColumn("_next", F.lead("start_f").over(w)).withColumn("_near", F.coalesce(F.lead("start").over(w) - F.col("end") < hold, F.lit(False)))
    shown = F.when(F.col("_near"), F.greatest(F.col("start_f") + 1, F.col("_next"))).otherwise(F.least(F.col("end_f") + fade, F.coalesce("_next", F.col("end_f") + fade)))
    return rows.withColumn("visible_f", shown).drop("_next", "_near")


def percentile(values: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """The value at the nearest rank round((n - 1) * share), half to even."""
    return order_statistics(values, keys, value, [lambda n: F.bround((n - 1) * F.lit(share))]).select(*keys, F.get("stats", F.lit(0)).alias(out))
