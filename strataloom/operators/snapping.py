"""Snapped windows of recordings of any length: every segment's window and next segment by lookups over pieces, then the chain from the first by pointer doubling.

Where a window begins depends on the window before, and two chains of windows that begin apart may never meet, so a scan with a carried state would pass it from piece to piece, with all
segments of the open window. Here nothing is passed on: a lookup asks for the first segment from some number on whose value is far enough above another. Most of what a piece asks lies in
itself or in the few pieces that its maxima lead to, so a lookup is two passes of the rows, whatever a window's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed
from . import rounds, scans


def first_reaching(values: np.ndarray, start: np.ndarray, x: np.ndarray, gap) -> np.ndarray:
    """For each start and x the first number from start on whose value is gap or more above x; len(values) if there is none."""
    at, n = np.array(start, np.int64), len(values)
    if not n or not len(at):
        return at if n else np.zeros_like(at)
    levels, h = [values], 1  # levels[k][i] is the largest of the 2^k values from i on
    while 2 * h <= n:
        levels.append(np.maximum(levels[-1][:-h], levels[-1][h:]))
        h *= 2
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        none = (at + size <= n) & ~(levels[k][np.minimum(at, n - size)] - x >= gap)
        at += none.astype(np.int64) << k
    return at


def _routes(pieces: pd.DataFrame, gap, back) -> pd.DataFrame:
    """Of one recording's pieces (lo and hi of what each asks, most of what it holds): the later pieces that hold what a piece asks, each with the most that is in pieces so far."""
    pieces = pieces.sort_values("_piece")
    number, most, lo, hi = (pieces[c].to_numpy() for c in ("_piece", "most", "lo", "hi"))
    n, greater, rising = len(pieces), np.full(len(pieces), len(pieces)), []
    for k in range(n - 1, -1, -1):
        while rising and most[rising[-1]] <= most[k]:
            rising.pop()
        greater[k] = rising[-1] if rising else n
        rising.append(k)
    own = np.arange(n)
    to = first_reaching(most, own + 1, lo - back, gap)
    found = []
    while True:
        held = to < n
        own, to = own[held], to[held]
        if not len(own):
            break
        found.append((number[own], number[to], most[to]))
        more = ~(most[to] - (hi[own] - back) >= gap)
        own, to = own[more], greater[to[more]]
    of, at, reach = (np.concatenate(c) if c else [] for c in (zip(*found, strict=True) if found else ([], [], [])))
    return pd.DataFrame({"_k": pieces["_k"].iloc[0], "_piece": of, "_to": at, "_reach": reach})


def _routed(routes: pd.DataFrame, x: np.ndarray, gap) -> np.ndarray:
    """The piece to ask for each x; -1 if none holds it."""
    routes = routes.sort_values("_to")
    return np.append(routes["_to"].to_numpy(np.int64), -1)[first_reaching(routes["_reach"].to_numpy(), np.zeros(len(x), np.int64), x, gap)]


def snapped_by_links(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, length, overlap, stretch: float, size: int) -> DataFrame:
    """keys, window, start and end, as greedy.snap_windows of each recording (times not null, numbers but no decimals; stretch 1 or more), for recordings of any length in pieces of size rows."""
    kind = rows.schema[start].dataType.simpleString(), rows.schema[end].dataType.simpleString()
    laid = scans.dealt(rows.select(*dict.fromkeys([*keys, *order, start, end])), keys, order, max(size, scans.PIECE))
    laid = laid.select(F.to_json(F.struct("_key")).alias("_k"), "_key", F.col("_piece").alias("_part"), *dict.fromkeys(order), F.col(start).alias("s"), F.col(end).alias("e"))
    along, within = Window.partitionBy("_k").orderBy("_part"), Window.partitionBy("_k", "_part").orderBy(*order)
    laid = checkpointed(laid.withColumns({"_n": F.row_number().over(within), "_prev": F.lag("e").over(within)}).drop(*order))
    parts = laid.groupBy("_k", "_part").agg(F.count("*").alias("_rows"), F.max_by("e", "_n").alias("_last"), F.first("_key").alias("_key"))
    parts = checkpointed(parts.withColumns({"_off": F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_then": F.lag("_last").over(along)}))
    whole = checkpointed(parts.groupBy("_k").agg(F.sum("_rows").alias("n"), F.max_by("_last", "_part").alias("last"), F.first("_key").alias("_key")))
    at = F.col("_off") + F.col("_n")
    laid = checkpointed(laid.join(parts.select("_k", "_part", "_off", "_then"), ["_k", "_part"]).select("_k", F.floor((at - 1) / size).alias("_piece"), at.alias("at"), "s", "e", F.coalesce("_prev", "_then").alias("before")))

    def routes(pieces: DataFrame, held: str, gap, back) -> DataFrame:
        return pieces.groupBy("_k").applyInPandas(lambda pieces: _routes(pieces, gap, back), f"_k string, _piece long, _to long, _reach {held}")

    def frame(schema: str, **columns) -> pd.DataFrame:
        return pd.DataFrame(columns)[[f.split()[0] for f in schema.split(", ")]]

    def asked(found: DataFrame) -> DataFrame:
        return found.where("_to >= 0")

    # A window's last segment: the first that is length or more after its begin, or the one before if that one goes too far.
    last_of = f"_k string, _piece long, at long, s {kind[0]}, j long, z {kind[1]}, _to long"

    def lasts(s: np.ndarray, at: np.ndarray, reached: np.ndarray, e: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (reached > at) & (e - s > length * stretch)
        return np.where(far, reached - 1, reached), np.where(far, before, e)

    def near(part: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        n, s, e, number = len(part), part["s"].to_numpy(), part["e"].to_numpy(), part["at"].to_numpy()
        if not n:
            return frame(last_of, **{c: [] for c in ("_k", "_piece", "at", "s", "j", "z", "_to")})
        k = first_reaching(e, np.arange(n), s, length)
        here, at = k < n, np.minimum(k, n - 1)
        j, z = lasts(s, number, number[at], e[at], e[np.maximum(at - 1, 0)])
        to = np.where(here, -1, _routed(routes, s, length))
        return frame(last_of, _k=part["_k"].iloc[0], _piece=part["_piece"].iloc[0], at=number, s=s, j=pd.Series(j, dtype="Int64").where(here), z=pd.Series(z).astype(object).where(here, None), _to=to)

    def later(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        s, own, e, number = asked["s"].to_numpy(), asked["at"].to_numpy(), part["e"].to_numpy(), part["at"].to_numpy()
        k = first_reaching(e, np.zeros(len(s), np.int64), s, length)
        before = np.append(part["before"].to_numpy()[:1], e[:-1])[k] if len(s) else e[:0]
        j, z = lasts(s, own, number[k], e[k], before) if len(s) else (own, e[:0])
        return frame(last_of, _k=asked["_k"], _piece=asked["_piece"], at=own, s=s, j=j, z=z, _to=np.full(len(s), -1))

    pieces = laid.groupBy("_k", "_piece").agg(F.max("e").alias("most"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    found = checkpointed(laid.groupBy("_k", "_piece").cogroup(routes(pieces, kind[1], length, 0).groupBy("_k", "_piece")).applyInPandas(near, last_of))
    far = laid.groupBy("_k", "_piece").cogroup(asked(found).groupBy("_k", "_to")).applyInPandas(later, last_of)
    spans = found.where("_to < 0").unionByName(far).join(F.broadcast(whole.select("_k", "n", "last")), "_k")
    spans = checkpointed(spans.select("_k", "_piece", "at", "s", F.coalesce("j", "n").alias("j"), F.coalesce("z", "last").alias("z"), "n"))

    # The next window's first segment: the first later one that starts overlap before the end or after, else the one after the last.
    next_of = "_k string, _piece long, at long, z " + kind[1] + ", next long, _to long"

    def onward(part: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        n, s, z, number = len(part), part["s"].to_numpy(), part["z"].to_numpy(), part["at"].to_numpy()
        if not n:
            return frame(next_of, **{c: [] for c in ("_k", "_piece", "at", "z", "next", "_to")})
        k = first_reaching(s, np.arange(1, n + 1), z - overlap, 0)
        here = k < n
        to = np.where(here, -1, _routed(routes, z - overlap, 0))
        return frame(next_of, _k=part["_k"].iloc[0], _piece=part["_piece"].iloc[0], at=number, z=z, next=pd.Series(number[np.minimum(k, n - 1)], dtype="Int64").where(here), _to=to)

    def onward_later(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        z, number = asked["z"].to_numpy(), part["at"].to_numpy()
        k = first_reaching(part["s"].to_numpy(), np.zeros(len(z), np.int64), z - overlap, 0)
        return frame(next_of, _k=asked["_k"], _piece=asked["_piece"], at=asked["at"], z=z, next=number[k] if len(z) else number[:0], _to=np.full(len(z), -1))

    pieces = spans.groupBy("_k", "_piece").agg(F.max("s").alias("most"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    found = checkpointed(spans.groupBy("_k", "_piece").cogroup(routes(pieces, kind[0], 0, overlap).groupBy("_k", "_piece")).applyInPandas(onward, next_of))
    far = laid.groupBy("_k", "_piece").cogroup(asked(found).groupBy("_k", "_to")).applyInPandas(onward_later, next_of)
    ahead = found.where("_to < 0").unionByName(far).select("_k", "at", "next")
    links = checkpointed(spans.join(ahead, ["_k", "at"]).select(F.col("_k").alias("_key"), "_piece", "at", "s", "z", F.when(F.col("j") < F.col("n"), F.coalesce("next", F.col("j") + 1)).alias("next"), (F.col("at") == 1).alias("first")))
    shown = checkpointed(rounds.reachable(links.select("_key", "at", "next", "first")).join(links.select("_key", "_piece", "at", "s", "z"), ["_key", "at"]).withColumnRenamed("_key", "_k"))
    counts = shown.groupBy("_k", "_piece").agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_off", F.coalesce(F.sum("_rows").over(Window.partitionBy("_k").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("_off") + F.row_number().over(Window.partitionBy("_k", "_piece").orderBy("at"))
    result = shown.join(counts.select("_k", "_piece", "_off"), ["_k", "_piece"]).withColumn("window", number.cast("int")).join(F.broadcast(whole.select("_k", "_key")), "_k")
    return result.select(*[F.col(f"_key.{k}").alias(k) for k in keys], "window", F.col("s").alias("start"), F.col("z").alias("end"))
