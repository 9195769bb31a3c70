"""Framing of recordings of any length: plan_framing as scans in pieces (see scans).

The subject is followed, the crop's targets are set and the camera's spring is run by three scans, each over the rows of the one before; what is between them are
aggregates, exact order statistics and expressions. The path comes as rows, since an array of it would have no bound.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Framing
from ..shared import checkpointed
from . import scans
from .intervals import order_statistics
from .tracking import LOOSE, NOBODY, cluster_of, follow_on, framing_stats, is_wide, retargets_on, spring

FACTS = ["_w", "_h", "_jumps"]


def _subjects(p: Framing) -> scans.Step:
    """(t, centre, epoch, own) of the frames in which somebody is followed."""

    def step(state, columns, last):
        t, c, s, g, jumps = columns
        count = [len(x) for x in c]
        flat = lambda v, kind: np.array([y for x in v for y in x], kind)
        picked, epoch, state = follow_on(np.array(t, float), np.concatenate(([0], np.cumsum(count))), flat(s, float), flat(g, np.int64), bool(jumps[0]), p, tuple(state) if state else NOBODY)
        centre = flat(c, float)
        return [(t[n], float(centre[picked[n]]), int(epoch[n])) for n in np.flatnonzero(picked >= 0)], state

    return step


def _targets(p: Framing) -> scans.Step:
    """(t, x, None) of the crop's moves and (t, None, speed) of neighbouring frames that are far enough apart."""

    def step(state, columns, last):
        t, c, e, w, h = columns
        crop_w = h[0] * 9 / 16
        (before, loose) = state or (None, LOOSE)
        goals, loose = retargets_on(np.array(t, float), np.array(c, float), np.array(e, np.int64), w[0], crop_w, p, loose)
        rows = [(a, x, None) for a, x in goals]
        for a, x in zip(t, c, strict=True):
            if before is not None:
                dt, moved = 0.0 if before[0] == 0 else a - before[0], abs(x - before[1])
                if dt >= 0.25 and moved >= p.dead_zone * crop_w:
                    rows.append((a, None, moved / dt))
            before = a, x
        return rows, (before, loose)

    return step


def _camera(p: Framing) -> scans.Step:
    """(t, x) wherever the crop's x changes on the camera's grid. Rows are goals (at, x) and instants of the grid (at null), each goal well before the instant at which it counts.

    The state: the time and the x of the last instant, position and speed, the goal, and goals that don't count yet.
    """
    dt = 1 / p.camera_fps

    def step(state, columns, last):
        at, x, first, w, h, ends = columns
        move = spring(w[0], h[0] * 9 / 16, p)
        now, shown, place, goal, waiting = state or (0.0, None, (float(first[0]), 0.0), float(first[0]), [])
        place = tuple(place)
        out = []
        for a, b in zip(at, x, strict=True):
            if not math.isnan(a):
                waiting = [*waiting, (a, float(b))]
                continue
            if now > ends[0] + 1e-6:
                continue
            while waiting and max(0.0, waiting[0][0]) <= now:
                goal, waiting = waiting[0][1], waiting[1:]
            place = move(place, goal)
            told = int(np.rint(place[0]))
            if told != shown:
                out.append((round(now, 3), told))
                shown = told
            now += dt
        if last and shown is not None:
            out.append((None, shown))
        return out, (now, shown, place, goal, waiting)

    return step


def plan_long(sampled: DataFrame, keys: list[str], durations: DataFrame, p: Framing | None = None, piece: int = scans.PIECE) -> tuple[DataFrame, DataFrame]:
    """(plans, paths) of recordings with samples: plan_framing's columns but for crop_keys, and the crop's path as rows (keys, t, x). Sampled times of a recording are distinct."""
    p = p or Framing()
    stats = framing_stats(sampled, keys, p)
    wide = is_wide(F.col("src_w"), F.col("src_h"))
    early = F.when(wide & (F.col("hit_rate") < 0.28), "few-faces").when(wide & (F.col("three_share") >= 0.22), "crowd").when(wide & (F.col("wide_share") >= 0.45) & (F.col("multi_share") >= 0.5), "wide-action")
    jumps = wide & (F.col("multi_share") >= 0.32) & (F.col("mean_clusters") >= 1.25)
    key = F.struct(*keys).alias("_id")
    facts = stats.select(key, wide.alias("_wide"), early.alias("_early"), jumps.alias("_jumps"), F.col("mean_clusters").alias("_mean"), F.col("src_w").cast("double").alias("_w"), F.col("src_h").cast("double").alias("_h"))
    any_own = sampled.groupBy(key).agg(F.max((F.size("own") > 0)).alias("_any"))
    lengths = durations.select(key, F.greatest(F.lit(0.2), F.col("duration").cast("double")).alias("_duration"))
    facts = checkpointed(facts.join(any_own, "_id").join(lengths, "_id"))

    each = lambda f: F.transform("_faces", f)
    heads = F.when(F.col("_any") & (F.size("own") == 0), F.array().cast(sampled.schema["faces"].dataType)).otherwise(F.col("faces"))  # of bodies: only where there is no face at all
    frames = sampled.withColumn("_id", F.struct(*keys)).join(facts.where("_early IS NULL"), "_id").withColumn("_faces", heads)
    frames = frames.select("_id", "t", each(lambda f: f["x"] + f["w"] / 2).alias("c"), each(lambda f: F.greatest(F.lit(1.0), f["w"] * f["h"])).alias("s"), each(lambda f: cluster_of(f, F.col("src_w"), p.cluster)).alias("g"), "_jumps")
    seen = checkpointed(scans.scan(frames, ["_id"], ["t"], ["t", "c", "s", "g", "_jumps"], _subjects(p), "t double, centre double, epoch long", None, piece))
    moves = checkpointed(scans.scan(seen.join(facts.select("_id", "_w", "_h"), "_id"), ["_id"], ["t"], ["t", "centre", "epoch", "_w", "_h"], _targets(p), "t double, x int, speed double", None, piece))

    changes = seen.groupBy("_id").agg(F.max("epoch").alias("_changes"))
    goals = moves.where("x IS NOT NULL").groupBy("_id").agg(F.count("*").alias("_goals"), F.min_by("x", "t").alias("_first"))
    rank = lambda share: lambda n: F.bround((n - 1) * F.lit(share))
    fast = order_statistics(moves.where("speed IS NOT NULL").join(facts.where("_any").select("_id"), "_id", "left_semi"), ["_id"], "speed", [rank(0.5), rank(0.9)])
    rows = facts.join(changes, "_id", "left").join(goals, "_id", "left").join(fast.select("_id", F.get("stats", F.lit(0)).alias("_med"), F.get("stats", F.lit(1)).alias("_p90")), "_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    crop_w = F.col("_h") * 9 / 16
    reason = F.coalesce(
        "_early", F.when(F.col("_wide") & ((zero("_med") > p.fast_median * crop_w) | (zero("_p90") > p.fast_p90 * crop_w)), "too-fast"), F.when(F.col("_jumps") & (zero("_changes") / F.col("_duration") > p.jumps), "jump-too-often"),
    )
    rows = checkpointed(rows.withColumn("_why", reason))
    told = F.when(F.col("_jumps"), F.concat(F.lit("two-faces-"), zero("_changes"), F.lit("jumps"))).when(F.col("_mean") < 1.2, "one-face").otherwise("primary-face")
    told = F.coalesce("_why", F.when(F.col("_wide"), told).otherwise(F.concat(F.lit("portrait-"), told)))
    mode = F.when(F.col("_why").isNotNull(), "letterbox").when(F.col("_jumps"), "jump").otherwise("track")
    late = F.col("_early").isNull()
    number = lambda c, kind: F.when(late, zero(c)).otherwise(0).cast(kind)
    plans = rows.select("_id.*", mode.alias("mode"), told.alias("reason"), number("_changes", "int").alias("switches"), number("_goals", "int").alias("retargets"), number("_med", "double").alias("median_px_s"), number("_p90", "double").alias("p90_px_s"))
    return plans, _paths(rows.where("_why IS NULL"), moves, p, piece).select("_id.*", "t", "x")


def _paths(rows: DataFrame, moves: DataFrame, p: Framing, piece: int) -> DataFrame:
    """_id, t and x: a goalless recording's crop stands in the middle; else the camera's path over goals and grid, and its end."""
    facts = rows.select("_id", "_first", "_w", "_h", "_duration")
    still = facts.where("_first IS NULL").select("_id", F.lit(0.0).alias("t"), ((F.col("_w") - F.col("_h") * 9 / 16) / 2).cast("int").alias("x"))
    moving = facts.where("_first IS NOT NULL")
    block, none = 4096, F.lit(None).cast("double")
    steps = F.floor((F.col("_duration") + 1e-6) * p.camera_fps).cast("long") + 2  # the scan counts time by its own additions, and stops at the end
    grid = moving.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(steps / block)))).withColumn("_n", F.explode(F.sequence(F.col("_b") * block, F.least(steps, F.col("_b") * block + block - 1))))
    place: Column = F.floor(F.greatest(F.lit(0.0), F.col("t")) * p.camera_fps).cast("long") - 2
    goals = moves.where("x IS NOT NULL").join(moving, "_id").select("_id", place.alias("_n"), F.col("t").alias("_at"), F.col("x").cast("double").alias("_x"), "_first", "_w", "_h", "_duration")
    every = grid.select("_id", "_n", none.alias("_at"), none.alias("_x"), "_first", "_w", "_h", "_duration").unionByName(goals).withColumn("_order", F.coalesce("_at", F.lit(-1.0)))
    path = scans.scan(every, ["_id"], ["_n", "_order"], ["_at", "_x", "_first", "_w", "_h", "_duration"], _camera(p), "t double, x int", None, piece)
    end = F.round("_duration", 3)
    ends = path.where("t IS NULL").join(moving.select("_id", "_duration"), "_id").select("_id", end.alias("t"), "x")
    told = path.where("t IS NOT NULL").groupBy("_id").agg(F.max("t").alias("_last"))
    ends = ends.join(told, "_id").where(F.col("_last") < F.col("t")).select("_id", "t", "x")
    return path.where("t IS NOT NULL").unionByName(ends).unionByName(still)
