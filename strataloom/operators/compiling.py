"""Candidate clips: edges on frames, validation by stages with reasons, joins without repeated frames, scores, the manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_words, strings
from ..params import BANNED_OPENERS, BANNED_PAIRS, SCORE_KEYS, Clips
from .bands import ordered_text

RANGE = "struct<start_word:bigint,end_word:bigint>"
CANDIDATE = f"n int, title string, hook_mode string, hook_quote string, teaser {RANGE}, segments array<{RANGE}>, scores map<string,int>"


def block_edges(words: DataFrame, keys: list[str], number: str = "i", block: str = "b") -> DataFrame:
    """keys, block, and the first and last word of each block; words outside blocks (-1) don't count."""
    return words.where(F.col(block) >= 0).groupBy(*keys, block).agg(F.min(number).alias("first_word"), F.max(number).alias("last_word"))


def word_edges(words: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i and, for each word, where a cut that starts or ends with it falls: t_in, t_out and whether t_out closes a block.

    A block's first word starts at the block's onset, its last word ends with the block; within a block a cut starts just before the word
    but not in the one before, and ends just after it but short of the next. Neighbours come from a window, blocks from one join.
    words: i, s, e, b. blocks: i, onset, end.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    own = Window.partitionBy(*keys, "b").orderBy("i")
    near = words.withColumn("_prev", F.coalesce(F.lag("e").over(w), F.lit(0.0))).withColumn("_next", F.coalesce(F.lead("s").over(w), F.col("e") + 1.0))
    near = near.withColumn("_first", (F.col("b") >= 0) & (F.row_number().over(own) == 1)).withColumn("_last", (F.col("b") >= 0) & F.lead("i").over(own).isNull())
    b = blocks.select(*keys, F.col("i").alias("b"), F.col("onset").alias("_onset"), F.col("end").alias("_end"))
    p = Clips()
    t_in = F.when(F.col("_first"), F.col("_onset")).otherwise(F.greatest(F.col("s") - p.lead_in, F.col("_prev"), F.lit(0.0)))
    t_out = F.when(F.col("_last"), F.col("_end")).otherwise(F.least(F.col("e") + p.lead_out, F.greatest(F.col("_next") - p.guard, F.col("e"))))
    return near.join(b, [*keys, "b"], "left").select(*keys, "i", "w", t_in.alias("t_in"), t_out.alias("t_out"), F.col("_last").alias("closes"))


def resolve(ranges: DataFrame, edges: DataFrame, keys: list[str], fps: str = "fps") -> DataFrame:
    """ranges (start_word, end_word, fps) with in_frame and out_frame: two equality joins with word_edges."""
    a = edges.select(*keys, F.col("i").alias("start_word"), "t_in")
    b = edges.select(*keys, F.col("i").alias("end_word"), "t_out", "closes")
    out = ranges.join(a, [*keys, "start_word"]).join(b, [*keys, "end_word"])
    first = F.floor(F.col("t_in") * F.col(fps))
    last = F.ceil(F.col("t_out") * F.col(fps)) + F.col("closes").cast("int")
    return out.withColumn("in_frame", first.cast("long")).withColumn("out_frame", F.greatest(last, first + 1).cast("long")).drop("t_in", "t_out", "closes")


def range_text(ranges: DataFrame, words: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by and text: the words from start_word to end_word of each range, by an equality join on word numbers."""
    spread = ranges.select(*keys, *by, F.explode(F.sequence("start_word", "end_word")).alias("i"))
    return spread.join(words.select(*keys, "i", "w"), [*keys, "i"]).groupBy(*keys, *by).agg(ordered_text("i", "w").alias("text"))


def clamp_joins(segments: DataFrame, by: list[str], order: str = "ord", collapsed: int = 3) -> DataFrame:
    """segments with in_frame pushed up to the previous out_frame, clamped (frames), and collapsed / dropped.

    Out frames never move, so the previous one is a lag. A segment left with under `collapsed` frames by the clamp is a collapse, and it and
    all after it are dropped.
    """
    w = Window.partitionBy(*by).orderBy(order)
    pushed = F.greatest(F.col("in_frame"), F.coalesce(F.lag("out_frame").over(w), F.col("in_frame")))
    rows = segments.withColumn("_in", pushed).withColumn("clamped", F.col("_in") - F.col("in_frame"))
    rows = rows.withColumn("collapsed", (F.col("clamped") > 0) & (F.col("out_frame") - F.col("_in") < collapsed))
    rows = rows.withColumn("dropped", F.max(F.col("collapsed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return rows.withColumn("in_frame", F.col("_in")).drop("_in")


def total_score(scores: Column) -> Column:
    """The sum of the four fixed scores; a missing one counts 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.get(F.array(scores[k]), F.lit(0)), F.lit(0)) for k in SCORE_KEYS])


def _reasons(*tests: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(m) if isinstance(m, str) else m) for t, m in tests]))


def _inside(outer: Column, inner: Column) -> Column:
    return (outer["start_word"] <= inner["start_word"]) & (inner["end_word"] <= outer["end_word"])


def structural_reasons(n_words: Column, p: Clips) -> Column:
    """Why a candidate can't be looked at further: ranges out of bounds, no segments, a teaser where none may be."""
    s, teaser = F.coalesce("segments", F.array().cast(f"array<{RANGE}>")), F.col("teaser")
    bad = lambda r: F.coalesce(~((r["start_word"] >= 1) & (r["start_word"] <= r["end_word"]) & (r["end_word"] <= n_words)), F.lit(True))
    words = lambda r: F.format_string("bad word range %s-%s", r["start_word"].cast("string"), r["end_word"].cast("string"))
    each = F.transform(F.filter(F.concat(s, F.when(teaser.isNotNull(), F.array(teaser)).otherwise(F.array().cast(f"array<{RANGE}>"))), bad), words)
    return F.concat(_reasons((F.lit(p.longform) & (F.col("hook_mode") == "teaser"), "long-form takes no teaser")), each, _reasons((F.size(s) == 0, "no segments")))


def ordering_reasons() -> Column:
    """Overlapping or unordered segments; a teaser that is missing or not inside one segment. Only for structurally sound candidates."""
    s, teaser = F.col("segments"), F.col("teaser")
    pairs = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("a"), F.slice(s, 2, F.size(s)).alias("b"))
    wants = F.col("hook_mode") == "teaser"
    crossing = F.transform(F.filter(pairs, lambda x: x["b"]["start_word"] <= x["a"]["end_word"]), lambda x: F.lit("segments overlap or are out of order"))
    return F.concat(crossing, _reasons((wants & teaser.isNull(), "hook_mode=teaser but no teaser range"), (wants & teaser.isNotNull() & ~F.exists(s, lambda x: _inside(x, teaser)), "teaser must sit inside one kept segment")))


def opening_reasons(opening: Column, quote: Column) -> Column:
    """opening and quote: the normalised words that the clip starts with, and those that the candidate says it does."""
    k = F.least(F.lit(3), F.size(opening), F.size(quote))
    differ = F.when(k == 0, F.lit(True)).otherwise(F.slice(opening, 1, F.greatest(k, F.lit(1))) != F.slice(quote, 1, F.greatest(k, F.lit(1))))
    first, second = F.get(opening, F.lit(0)), F.get(opening, F.lit(1))
    pair = reduce(lambda a, b: a | b, [(first == a) & (second == b) for a, b in BANNED_PAIRS])
    return _reasons(
        (differ, F.concat(F.lit("hook_quote mismatch: clip opens '"), F.array_join(F.slice(opening, 1, 5), " "), F.lit("' but hook_quote says '"), F.array_join(F.slice(quote, 1, 5), " "), F.lit("'"))),
        (F.coalesce(F.array_contains(strings(BANNED_OPENERS), first), F.lit(False)), F.concat(F.lit("opens on continuation token '"), first, F.lit("'"))),
        (F.coalesce(pair, F.lit(False)), F.concat(F.lit("opens on '"), first, F.lit(" "), second, F.lit("'"))),
    )


def compile_candidates(candidates: DataFrame, words: DataFrame, blocks: DataFrame, sources: DataFrame, keys: list[str], p: Clips | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, cuts) of candidates (columns keys and CANDIDATE).

    manifest: keys, n, title, status (kept or rejected), reasons, warnings, total_score, core_frames, teaser_frames and the hull of the words.
    cuts: keys, n, ord (0: the teaser), in_frame, out_frame and text of the kept ones. words: i, w, s, e, b; blocks: i, onset, end;
    sources: fps. Reasons come by stages: structure, then order, then content and durations; a stage is looked at if those before found nothing.
    Ranges are looked up only for candidates that passed the first two, so nothing indexes a malformed one; the facts
    found are then joined to all candidates, of which each takes the reasons of its first failing stage.
    """
    p = p or Clips()
    by = [*keys, "n"]
    counts = words.groupBy(*keys).agg(F.count("*").alias("_words"))
    base = candidates.join(sources.select(*keys, "fps"), keys).join(counts, keys, "left").withColumn("_words", F.coalesce("_words", F.lit(0)))
    base = base.withColumn("hook_mode", F.coalesce("hook_mode", F.lit("natural"))).withColumn("_structure", structural_reasons(F.col("_words"), p))
    nothing = F.array().cast("array<string>")
    staged = base.withColumn("_order", F.when(F.size("_structure") == 0, ordering_reasons()).otherwise(nothing))
    good = staged.where((F.size("_structure") == 0) & (F.size("_order") == 0))
    teased = F.col("hook_mode") == "teaser"
    ranges = good.select(*by, "fps", F.explode(F.concat(F.when(teased, F.array(F.struct(F.lit(0).alias("ord"), F.col("teaser").alias("r")))).otherwise(F.array().cast(f"array<struct<ord:int,r:{RANGE}>>")), F.transform("segments", lambda r, k: F.struct((k + 1).alias("ord"), r.alias("r"))))).alias("x"))
    ranges = ranges.select(*by, "fps", "x.ord", F.col("x.r.start_word").alias("start_word"), F.col("x.r.end_word").alias("end_word"))
    cut = resolve(ranges, word_edges(words, blocks, keys), keys).join(range_text(ranges, words, keys, ["n", "ord"]), [*by, "ord"])
    teaser = cut.where("ord = 0").withColumns({"clamped": F.lit(0).cast("long"), "collapsed": F.lit(False), "dropped": F.lit(False)})
    every = clamp_joins(cut.where("ord > 0"), by, collapsed=p.collapsed).unionByName(teaser)
    frames = F.col("out_frame") - F.col("in_frame")
    facts = every.groupBy(*by, "fps").agg(
        F.coalesce(F.sum(F.when((F.col("ord") > 0) & ~F.col("dropped"), frames)), F.lit(0)).alias("core_frames"), F.coalesce(F.sum(F.when(F.col("ord") == 0, frames)), F.lit(0)).alias("teaser_frames"), F.min_by("text", "ord").alias("opening"),
        F.array_sort(F.collect_list(F.when(F.col("collapsed"), F.format_string("segment starting at word %d collapses after a %d-frame join clamp", "start_word", "clamped")))).alias("collapses"),
        F.array_sort(F.collect_list(F.when((F.col("clamped") > 0) & ~F.col("dropped"), F.format_string("join clamped %d frame(s): segment starting at word %d", "clamped", "start_word")))).alias("warnings"),
    )
    checked = staged.join(facts.drop("fps"), by, "left")
    core, tease = F.col("core_frames") / F.col("fps"), F.col("teaser_frames") / F.col("fps")
    content = F.concat(
        opening_reasons(norm_words(F.col("opening")), norm_words(F.col("hook_quote"))), _reasons((teased & ~tease.between(*p.teaser), F.format_string("teaser is %.1fs", tease))), F.slice("collapses", 1, 1),
        _reasons((core < p.min_dur * p.under, F.format_string("core %.1fs under min %.0fs", core, F.lit(p.min_dur))), (core > p.max_dur * p.over, F.format_string("core %.1fs over max %.0fs", core, F.lit(p.max_dur)))),
    )
    reasons = F.when(F.size("_structure") > 0, F.col("_structure")).when(F.size("_order") > 0, F.col("_order")).otherwise(content)
    hull = F.array_min(F.transform("segments", lambda r: r["start_word"])).alias("first_word"), F.array_max(F.transform("segments", lambda r: r["end_word"])).alias("last_word")
    manifest = checked.select(*by, "title", reasons.alias("reasons"), "warnings", "core_frames", "teaser_frames", total_score(F.col("scores")).alias("total_score"), *hull)
    if p.longform:
        from .greedy import suppress_overlaps

        valid = manifest.where(F.size("reasons") == 0)
        judged = suppress_overlaps(valid, keys, "total_score", "n", "first_word", "last_word")
        beaten = F.when(F.col("winner").isNotNull(), F.array(F.format_string("long-form overlap: words %d-%d share source with candidate %d", "first_word", "last_word", "winner"))).otherwise(F.col("reasons"))
        manifest = manifest.where(F.size("reasons") > 0).unionByName(judged.withColumn("reasons", beaten).drop("winner"))
    manifest = manifest.withColumn("status", F.when(F.size("reasons") == 0, "kept").otherwise("rejected"))
    cuts = every.where(~F.col("dropped")).join(manifest.where("status = 'kept'").select(*by), by, "left_semi").select(*by, "ord", "in_frame", "out_frame", "text")
    return manifest, cuts


def ranked(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The kept candidates with rank: by score, then number."""
    return manifest.where("status = 'kept'").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total_score"), "n")))


def caption_words(cuts: DataFrame, words: DataFrame, keys: list[str], by: list[str], width: float = 30.0) -> DataFrame:
    """Words on the output timeline: keys, by, ord, i, text, start, end. A word in the teaser and in its segment comes twice.

    cuts: ord, in_frame, out_frame, fps. Words are placed by their starts; one longer than no word lasts is shown for a while only.
    """
    from ..params import Captions
    from .bands import band_join
    from .intervals import running_offsets

    p = Captions()
    c = cuts.withColumns({"t_in": F.col("in_frame") / F.col("fps"), "t_out": F.col("out_frame") / F.col("fps")})
    c = running_offsets(c, [*keys, *by], "ord", F.col("t_out") - F.col("t_in"))
    lo, hi = F.col("t_in") - p.before, F.col("t_out") - p.inside
    c = c.withColumns({"_lo": lo, "_hi": hi}).select(*keys, *by, "ord", "t_in", "t_out", "timeline_start", "_lo", "_hi")
    hit = band_join(words.where("w IS NOT NULL AND w <> ''").select(*keys, "i", "w", "s", "e"), c, keys, "s", "_lo", "_hi", width)
    start = F.greatest(F.col("timeline_start") + F.col("s") - F.col("t_in"), F.col("timeline_start"))
    end = F.least(F.col("timeline_start") + F.col("e") - F.col("t_in"), F.col("timeline_start") + F.col("t_out") - F.col("t_in") - 0.001)
    shown = hit.withColumns({"start": start, "end": end}).withColumn("end", F.when(F.col("end") - F.col("start") > p.glitch, F.col("start") + p.capped).otherwise(F.col("end")))
    return shown.where(F.col("end") > F.col("start")).select(*keys, *by, "ord", "i", F.col("w").alias("text"), "start", "end")
