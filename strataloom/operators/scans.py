"""Sequential operators over recordings of any length: a scan with a carried state over pieces of a recording.

Rows are dealt by range of (keys, order), so a piece is a run of neighbouring rows, and a long recording has many. Each piece is worked on as if a state were known:
at first as if its recording began there. A piece's last state is what the next one must begin with; where a piece began with another, it is done again with
that, until none is left. A step that soon forgets how it began (a cue, a thought, a window ends) gives the same last state from either beginning, so
that the first correction is mostly the last, and all pieces work at once; at worst the state passes from piece to piece, a round for each. The result is that of one
pass over the whole in any case. Only small tables of pieces and states are sorted by recording.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import checkpointed

#: Rows of a piece, about.
PIECE = 100_000
#: step(state or None, columns, last) -> (rows, state): the rows that the given ones decide, and what to go on with. States are JSON values.
Step = Callable[[object, list[list], bool], tuple[Iterable[tuple], object]]


def tail(fn: Callable[..., tuple[list[tuple], int]]) -> Step:
    """A step from fn(*columns, last) -> (rows, first row that is still needed): the state is those rows."""

    def step(state, columns: list[list], last: bool):
        columns = [a + b for a, b in zip(state, columns, strict=True)] if state else columns
        rows, start = fn(*columns, last)
        return rows, [c[start:] for c in columns] if start < len(columns[0]) else None

    return step


def dealt(rows: DataFrame, keys: list[str], order: list[str], size: int = PIECE) -> DataFrame:
    """rows with columns _key (a struct of the keys, so that null is a key too) and _piece, about size rows of neighbours each. (keys, order) should be unique."""
    rows = checkpointed(rows)
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // size))
    return checkpointed(rows.repartitionByRange(n, *keys, *order).withColumn("_key", F.struct(*keys)).withColumn("_piece", F.spark_partition_id()))


def scan(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Step, fields: str, number: str | None = None, size: int = PIECE) -> DataFrame:
    """keys, number (from 1 within the keys, if a name is given) and fields: what step gives for each recording, its rows in order.

    Equal to one call of step with all rows of a recording; step's rows must come in order. Null keys are a recording. An empty table gives none.
    """
    laid = dealt(rows.select(*keys, *dict.fromkeys([*order, *columns])), keys, order, size)
    along = Window.partitionBy("_key").orderBy("_piece")
    pieces = laid.select("_key", "_piece").distinct().withColumn("_last", F.lead("_piece").over(along).isNull())
    pieces = checkpointed(pieces)
    key_type = laid.schema["_key"].dataType
    own = T.StructType.fromDDL(fields)
    out = T.StructType([T.StructField("_k", T.StringType()), T.StructField("_at", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_state", T.StringType()), *own.fields])
    names = [f.name for f in own.fields]

    def run(part: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(state):
            return pd.DataFrame(columns=out.names)
        part = part.sort_values(order, kind="stable")
        s = state.iloc[0]
        found, left = step(json.loads(s["_entry"]) if s["_entry"] is not None else None, [part[c].tolist() for c in columns], bool(s["_final"]))
        got = [(s["_k2"], s["_at2"], n, None, *r) for n, r in enumerate(found, 1)]
        got.append((s["_k2"], s["_at2"], 0, json.dumps(left), *[None] * len(names)))  # JSON null: nothing to go on with
        return pd.DataFrame(got, columns=out.names).astype({"_n": "int64"}).astype(dict.fromkeys(names, object))

    def done(begun: DataFrame) -> DataFrame:
        """step on the pieces of begun (_key, _piece, _last, _entry)."""
        states = begun.select(F.to_json(F.struct("_key")).alias("_k2"), F.col("_piece").alias("_at2"), F.col("_last").alias("_final"), "_entry")
        mine = laid.join(begun.select(F.col("_piece").alias("_p")).distinct(), F.col("_piece") == F.col("_p"), "left_semi").withColumn("_k1", F.to_json(F.struct("_key")))
        return checkpointed(mine.select("_k1", "_piece", *dict.fromkeys([*order, *columns])).groupBy("_k1", "_piece").cogroup(states.groupBy("_k2", "_at2")).applyInPandas(run, out))

    exits = lambda d: d.where("_n = 0").select("_k", "_at", "_state")
    begun = pieces.withColumn("_entry", F.lit(None).cast("string"))
    rounds = [done(begun)]
    known = begun.select(F.to_json(F.struct("_key")).alias("_k"), F.col("_piece").alias("_at"), "_key", "_last", "_entry").join(exits(rounds[0]), ["_k", "_at"]).withColumn("_round", F.lit(0))
    while True:
        before = F.lag("_state").over(Window.partitionBy("_k").orderBy("_at"))
        needed = F.when(before != "null", before)
        checked = checkpointed(known.withColumn("_needed", needed).withColumn("_again", ~F.col("_needed").eqNullSafe(F.col("_entry"))))
        if checked.where("_again").isEmpty():
            break
        again = checked.where("_again").select("_key", F.col("_at").alias("_piece"), "_last", F.col("_needed").alias("_entry"))
        rounds.append(done(again))
        fresh = checked.where("_again").select("_k", "_at", "_key", "_last", F.col("_needed").alias("_entry")).join(exits(rounds[-1]), ["_k", "_at"]).withColumn("_round", F.lit(len(rounds) - 1))
        known = checked.where("NOT _again").drop("_needed", "_again").unionByName(fresh)
    rowsof = lambda k: rounds[k].where("_n > 0").drop("_state").withColumn("_round", F.lit(k))
    every = rowsof(0)
    for k in range(1, len(rounds)):
        every = every.unionByName(rowsof(k))
    counts = every.groupBy("_k", "_at", "_round").agg(F.count("*").alias("_rows"))
    valid = checked.select("_k", "_at", "_key", "_round").join(counts, ["_k", "_at", "_round"])
    offset = F.coalesce(F.sum("_rows").over(Window.partitionBy("_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    result = every.join(valid.withColumn("_before", offset), ["_k", "_at", "_round"])
    numbered = [] if number is None else [(F.col("_before") + F.col("_n")).cast("int").alias(number)]
    return result.select(*[F.col(f"_key.{f.name}").alias(f.name) for f in key_type.fields], *numbered, *names)
