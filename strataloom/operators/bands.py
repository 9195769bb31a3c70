"""Interval joins: points in intervals, overlapping intervals, nearest matches.

A bare range predicate plans as a nested loop. These add an equality on time buckets instead: an interval is put in every
bucket that it touches, with the join's own tolerances, a point in the one that holds it, and the exact predicate stays. The result is
a hash or sort-merge join on (key, level, bucket), which shuffles evenly, keeps no product and leaves skew to AQE.

Buckets come in levels, each FAN times as wide as the one below. An interval uses the first level at which it touches FAN + 2 at most, however long
it is; points are looked up on the levels that some interval uses (a scalar subquery finds them), mostly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(at: Column, width) -> Column:
    return F.floor(at / width).cast("long")


#: How many times wider each level's buckets are.
FAN = 16


def _level(length: Column, width) -> Column:
    """The first level at which an interval of the length touches FAN + 2 buckets at most."""
    over = length.cast("double") / (FAN * width)
    return F.when(over > 1, F.ceil(F.log2(over) / F.log2(F.lit(FAN)))).otherwise(0).cast("int")


def _at(x: Column, width, level: Column) -> Column:
    """The bucket of x on a level. Dividing keeps the order, so an interval's buckets are those between its ends'."""
    return F.floor(x / (F.lit(float(width)) * F.pow(F.lit(float(FAN)), level))).cast("long")


def _used(*levels: DataFrame) -> Column:
    """The levels (column _own) in use, as an array from a scalar subquery."""
    every = levels[0].select("_own")
    for d in levels[1:]:
        every = every.unionByName(d.select("_own"))
    return F.coalesce(every.agg(F.array_sort(F.collect_set("_own")).alias("levels")).scalar(), F.array(F.lit(0)))


def _leveled(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, before: float, after: float, closed: bool, how: str) -> DataFrame:
    """The join of band_join on every level in use: of the rows that a point gets on its levels, only those of a match mean something if how is left."""
    lo, hi = F.col(start) - F.lit(before), F.col(end) + F.lit(after)
    own = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (lo <= hi)).withColumn("_own", _level(hi - lo, width))
    spread = own.withColumn("_bucket", F.explode(F.sequence(_at(lo, width, F.col("_own")), _at(hi, width, F.col("_own"))))).withColumnRenamed("_own", "_level")
    p = points.withColumn("_level", F.explode(_used(own))).withColumn("_bucket", _at(F.col(at), width, F.col("_level"))).alias("p")
    inside = (F.col(at) >= lo) & (F.col(at) <= hi if closed else F.col(at) < hi)
    same = (F.col("p._level") == F.col("q._level")) & (F.col("p._bucket") == F.col("q._bucket")) & inside
    for k in keys:
        same = same & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    out = p.join(spread.alias("q"), same, how)
    return out.select(*[F.col(f"p.{c}") for c in points.columns], *([] if how == "left_semi" else [F.col(f"q.{c}") for c in intervals.columns if c not in keys]), *([] if how == "left_semi" else [F.col("q._bucket").isNotNull().alias("_met")]))


def band_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, before: float = 0, after: float = 0, closed: bool = False, how: str = "inner") -> DataFrame:
    """Each point with every interval of its keys where start - before <= at < end + after (<= if closed).

    width is the narrowest buckets' size; about the intervals' usual length is best. Columns other than keys must differ. how: inner,
    left, left_semi or left_anti. An interval with a null bound, like a point without a time, meets nothing.
    """
    find = lambda p, kind: _leveled(p, intervals, keys, at, start, end, width, before, after, closed, kind)
    if how == "inner":
        return find(points, "inner").drop("_met")
    tagged = points.withColumn("_point", F.monotonically_increasing_id())
    point = F.struct(*points.columns)
    if how == "left_semi":
        return find(tagged, "left_semi").groupBy("_point").agg(F.first(point).alias("_row")).select("_row.*")
    others = [c for c in intervals.columns if c not in keys]
    met = find(tagged, "left").groupBy("_point").agg(F.first(point).alias("_row"), F.collect_list(F.when(F.col("_met"), F.struct(*others) if others else F.struct("_met"))).alias("_hits"))
    if how == "left_anti":
        return met.where(F.size("_hits") == 0).select("_row.*")
    return met.select("_row", F.explode_outer("_hits").alias("_hit")).select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in others])


def first_block(points: DataFrame, blocks: DataFrame, keys: list[str], at: str, start: str, end: str, number: str, out: str, width: float, before: float = 0.15, after: float = 0.05) -> DataFrame:
    """points with column out: the least number of the blocks that hold them, or -1. Repeated points are rows of their own."""
    tagged = points.withColumn("_point", F.monotonically_increasing_id())
    hit = _leveled(tagged, blocks.select(*keys, start, end, number), keys, at, start, end, width, before, after, False, "left")
    best = hit.groupBy("_point").agg(F.first(F.struct(*points.columns)).alias("_row"), F.coalesce(F.min(number), F.lit(-1)).alias(out))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in points.columns], out)


def block_text(points: DataFrame, blocks: DataFrame, keys: list[str], at: str, order: str, word: str, start: str, end: str, number: str, width: float, before: float = 0.15, after: float = 0.05) -> DataFrame:
    """keys, number and text for every block: the words of all points in it, in order; a word may be in several."""
    hits = band_join(points.select(*keys, at, order, word), blocks.select(*keys, start, end, number), keys, at, start, end, width, before, after)
    texts = hits.groupBy(*keys, number).agg(ordered_text(order, word).alias("text"))
    return blocks.select(*keys, number).join(texts, [*keys, number], "left").select(*keys, number, F.coalesce("text", F.lit("")).alias("text"))


def ordered_text(order: str, word: str) -> Column:
    """An aggregate: the words in the given order, joined by spaces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w")))), lambda x: x["w"]), " ")


def first_onset(blocks: DataFrame, onsets: DataFrame, keys: list[str], start: str, end: str, onset: str, width: float, before: float = 0.05) -> DataFrame:
    """blocks with column onset: the first within [start - before, end], else the block's start."""
    hits = band_join(onsets.select(*keys, onset), blocks, keys, onset, start, end, width, before, 0, closed=True)
    first = hits.groupBy(*blocks.columns).agg(F.min(onset).alias("_first"))
    return blocks.join(first, blocks.columns, "left").select(*blocks.columns, F.coalesce("_first", start).alias(onset))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, closed: bool = False) -> DataFrame:
    """Pairs of overlapping intervals (b ends after a starts and starts before a ends; if closed, touching ones too), each once.

    Both sides are put in the buckets of their own level and of those above it that are in use, two or so on each. A pair is kept on the higher of its two levels, and there in the
    first bucket that it shares. Intervals with a null bound, or that end before they start, meet nothing.
    """
    leveled = [(d.where(F.col(x) <= F.col(y)).withColumn("_own", _level(F.col(y) - F.col(x), width)), x, y) for d, (x, y) in ((a, a_span), (b, b_span))]
    levels = _used(*[d for d, _, _ in leveled])

    def spread(d: DataFrame, x: str, y: str) -> DataFrame:
        on = d.withColumn("_level", F.explode(levels)).where(F.col("_level") >= F.col("_own"))
        return on.withColumn("_bucket", F.explode(F.sequence(_at(F.col(x), width, F.col("_level")), _at(F.col(y), width, F.col("_level")))))

    p, q = (spread(*t).alias(n) for t, n in zip(leveled, "pq", strict=True))
    over = (F.col(b_span[1]) >= F.col(a_span[0])) & (F.col(b_span[0]) <= F.col(a_span[1])) if closed else (F.col(b_span[1]) > F.col(a_span[0])) & (F.col(b_span[0]) < F.col(a_span[1]))
    meets = (F.col("p._level") == F.col("q._level")) & (F.col("p._bucket") == F.col("q._bucket")) & over & (F.col("p._level") == F.greatest(F.col("p._own"), F.col("q._own")))
    meets = meets & (F.col("p._bucket") == F.greatest(_at(F.col(a_span[0]), width, F.col("p._level")), _at(F.col(b_span[0]), width, F.col("q._level"))))
    for k in keys:
        meets = meets & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    return p.join(q, meets).select(*[F.col(f"p.{c}") for c in a.columns], *[F.col(f"q.{c}") for c in b.columns if c not in keys])


def nearest(a: DataFrame, b: DataFrame, keys: list[str], a_at: str, b_at: str, tolerance: float, tie: str, value: str) -> DataFrame:
    """a with value and distance of the row of b nearest in time within tolerance; of equally near rows, the least tie. Null if none.

    An as-of lookup by union: no pair is made. Rows of a and b fall into wide time buckets, a row of b also into the neighbour that it is within tolerance of; in
    each bucket one order in time gives the last row of b before each row of a and the first after it. A row of a without a time has no nearest.
    """
    width = 32 * tolerance if tolerance else 1.0
    at = F.col("_at")
    of_a = a.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(a_at).alias("_at"), F.struct(*a.columns).alias("_row"))
    timed = of_a.where(at.isNotNull()).withColumn("_bucket", _bucket(at, width))
    of_b = b.where(F.col(b_at).isNotNull()).groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(b_at).alias("_at")).agg(F.min(F.struct(F.col(tie).alias("tie"), F.col(value).alias("value"))).alias("_b"))
    of_b = of_b.withColumn("_bucket", F.explode(F.array_distinct(F.array(_bucket(at - tolerance, width), _bucket(at, width), _bucket(at + tolerance, width)))))
    both = timed.select("*", F.lit(None).cast(of_b.schema["_b"].dataType).alias("_b")).unionByName(of_b.select("*", F.lit(None).cast(of_a.schema["_row"].dataType).alias("_row")))
    part = Window.partitionBy(*[f"_k{n}" for n in range(len(keys))], "_bucket")
    seen = F.last(F.when(F.col("_b").isNotNull(), F.struct(at.alias("at"), "_b")), ignorenulls=True)
    rows = both.withColumn("_back", seen.over(part.orderBy("_at", F.col("_b").isNull()).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_on", seen.over(part.orderBy(F.desc("_at"), F.col("_b").isNull()).rowsBetween(Window.unboundedPreceding, 0))).where("_row IS NOT NULL")
    near = lambda c: F.when(F.abs(at - F.col(c)["at"]) <= tolerance, F.struct(F.abs(at - F.col(c)["at"]).alias("distance"), F.col(c)["_b"].alias("b")))
    best = F.array_min(F.array_compact(F.array(near("_back"), near("_on"))))
    found = rows.select("_row", best.alias("_best")).unionByName(of_a.where(at.isNull()).select("_row", F.lit(None).cast(rows.select(best.alias("x")).schema["x"].dataType).alias("_best")))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in a.columns], F.col("_best.b.value").alias(value), F.col("_best.distance").alias("distance"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each keys: that with the greatest order. A pre-aggregated maximum, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def zip_by_position(a: DataFrame, b: DataFrame, keys: list[str], a_order: list[Column], b_order: list[Column]) -> DataFrame:
    """a with the columns of the row of b at the same place in its order; null beyond b's end."""
    number = lambda d, o: d.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)))
    return number(a, a_order).join(number(b, b_order), [*keys, "_place"], "left").drop("_place")


def as_of_segment(points: DataFrame, track: DataFrame, keys: list[str], at: str, start: str, end: str, value: str, order: str, width: float) -> DataFrame:
    """points with the value of the first track segment that holds them, else of the last segment; null without a track."""
    last = track.groupBy(*keys).agg(F.max_by(value, order).alias("_last"))
    tagged = points.withColumn("_point", F.monotonically_increasing_id())
    met = _leveled(tagged, track.select(*keys, start, end, F.col(value).alias("_value"), F.col(order).alias("_order")), keys, at, start, end, width, 0, 0, False, "left")
    hits = met.groupBy("_point").agg(F.first(F.struct(*points.columns)).alias("_row"), F.min_by("_value", F.when(F.col("_met"), F.col("_order"))).alias("_hit"), F.max("_met").alias("_any"))
    return hits.select("_row.*", "_hit", "_any").join(last, keys, "left").select(*points.columns, F.when(F.col("_any"), F.col("_hit")).otherwise(F.col("_last")).alias(value))
