"""Hard negatives by a Voronoi-partition kNN join on inner products.

A row x of integers gets one more coordinate, sqrt(M^2 - |x|^2) with M the greatest length, and an anchor q a zero: then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the greatest inner product is the least distance. Rows fall to the nearest of a few
pivots. By the triangle inequality a row at distance d of its pivot p can be within r of an anchor only if d is in
|q' - p| -+ r; the widest such range of a group of anchors, cell by cell, says which rows are sent to the group. There
blocks of rows meet the group's anchors in one exact matrix product, and the blocks' best are merged.

The join runs twice: for the positives, r is an upper bound of the k-th nearest row of the label, taken from the rows nearest
to each pivot; for the negatives it is a shell between two radii, which the positives' scores give.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_few, small_batches

#: Pivots, anchors of one group, and rows of one block: a task holds a group and a block.
PIVOTS, GROUP, BLOCK = 32, 65_536, 131_072
#: Anchors multiplied with a block at once; a label's share of the parts that positives are looked for in.
TILE, PART_ANCHORS, LEAST_BLOCK = 64, 1024, 4096
#: Squared lengths from here on aren't exact in doubles.
LONGEST = float(2**53)
#: An anchor's columns in a join, where the rows' are their own.
A_SIDE = ["part AS a_part", "sub AS a_sub", "block AS a_block", "vec_id AS a_id", "label AS a_label", "v AS a_v"]


def scaled(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float = 256) -> DataFrame:
    """vec_id, label and v, the whole parts (floor) of scale * x, of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors whose integers' squares
    add up to 2^53 or more. The id is the key: of rows that share one, that with the least (label, vector) counts.
    """
    x = F.col(vector_col)
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    own = own.where(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    own = own.withColumn("x", F.transform("x", lambda c: F.floor(c.cast("double") * scale)))
    own = own.where(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")) < LONGEST)
    one = own.groupBy("vec_id").agg(F.min(F.struct("label", F.transform("x", lambda c: c.cast("int")).alias("v"))).alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of doubles, shorter ones filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    if len(vectors):
        out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def placed(rows: DataFrame, anchor: Column, pivots: np.ndarray, longest: float) -> DataFrame:
    """rows with anchor, size (squared length), cell, d (distance to the cell's pivot) and, for anchors, ds: the distances to all pivots."""
    small_batches(rows.sparkSession)
    width = pivots.shape[1]
    up = np.sqrt(np.maximum(0, longest - (pivots * pivots).sum(1)))

    def run(batches):
        for b in batches:
            x = matrix(b.column("v"), width)
            size = (x * x).sum(1)
            near = x @ pivots.T
            d = np.sqrt(np.maximum(0, 2 * longest - 2 * near - 2 * np.sqrt(np.maximum(0, longest - size))[:, None] * up))
            cell = d.argmin(1)
            ds = np.sqrt(np.maximum(0, size[:, None] + longest - 2 * near))
            own = b.column("anchor").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array([y.tolist() if a else None for a, y in zip(own, ds, strict=True)], pa.list_(pa.float64()))], names=[*b.schema.names, "size", "cell", "d", "ds"])

    source = rows.withColumn("anchor", F.coalesce(anchor, F.lit(False)))
    return source.mapInArrow(run, "vec_id long, label " + rows.schema["label"].dataType.simpleString() + ", v array<int>, anchor boolean, size double, cell int, d double, ds array<double>")


def grouped(anchors: DataFrame) -> DataFrame:
    """anchors (with part) with column sub: by part, the cells laid end to end and cut into groups of about GROUP anchors.

    An anchor's place in its cell is taken from its id's hash, so no task sorts a part.
    """
    counts = anchors.groupBy("part", "cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.select(F.struct("part", "cell").alias("_at"), "_n", before.alias("_before"))
    laid = join_few(anchors.withColumn("_at", F.struct("part", "cell")), at, "_at")
    return laid.withColumn("sub", F.floor((F.col("_before") + F.pmod(F.xxhash64("vec_id"), F.col("_n"))) / GROUP).cast("int")).drop("_at", "_n", "_before")


def sent(rows: DataFrame, anchors: DataFrame, lo: Callable[[Column], Column], hi: Callable[[Column], Column], slack: float) -> DataFrame:
    """rows (with part) once for each sub-group of anchors that they may serve: lo and hi give, from an anchor's distance to a pivot, the range of
    distances to that pivot in which rows can serve it. slack covers the rounding of distances."""
    ranges = anchors.select("part", "sub", "near", "far", F.posexplode("ds").alias("cell", "to")).groupBy("part", "cell", "sub").agg(F.min(lo(F.col("to"))).alias("lo"), F.max(hi(F.col("to"))).alias("hi"))
    served = ranges.groupBy("part", "cell").agg(F.collect_list(F.struct("sub", "lo", "hi")).alias("_served")).select(F.struct("part", "cell").alias("_at"), "_served")
    found = join_few(rows.withColumn("_at", F.struct("part", "cell")), served, "_at")
    return found.withColumn("sub", F.explode(F.transform(F.filter("_served", lambda s: (F.col("d") >= s["lo"] - slack) & (F.col("d") <= s["hi"] + slack)), lambda s: s["sub"]))).drop("_at", "_served")


def in_blocks(rows: DataFrame, anchors: DataFrame, cores: int) -> tuple[DataFrame, DataFrame]:
    """Both with column block: each part's rows dealt to blocks of BLOCK rows or less (of less still, where there would be fewer blocks than cores), its anchors in all of them."""
    n = F.col("_n")
    counts = rows.groupBy("part").agg(F.count("*").alias("_n")).select("part", F.greatest(F.ceil(n / BLOCK), F.least(F.lit(cores), F.ceil(n / LEAST_BLOCK))).cast("int").alias("_blocks"))
    dealt = join_few(rows, counts, "part").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("_blocks")).cast("int")).drop("_blocks")
    everywhere = join_few(anchors, counts, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return dealt, everywhere


def exact_products(a: np.ndarray, x: np.ndarray, longest: float):
    """Inner products of rows of a with all of x, TILE rows of a at a time: (first row, products). Exact: in floats below 2^24, else in doubles below 2^53."""
    kind = np.float32 if longest < 2**24 else np.float64
    a, x = a.astype(kind), np.ascontiguousarray(x.astype(kind).T)
    for k in range(0, len(a), TILE):
        yield k, a[k : k + TILE] @ x


def best(scores: np.ndarray, k: int):
    """(rows, columns, scores) of each row's k greatest finite scores; of equal ones the first. Overwrites scores."""
    at = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        top = scores.argmax(1)
        value = scores[at, top]
        keep = np.isfinite(value)
        if not keep.any():
            return
        yield at[keep], top[keep], value[keep]
        scores[at, top] = -np.inf


def _sides(anchors: pa.Table, rows: pa.Table, width: int):
    """The anchors' matrix, and the rows' in order of id with ids and labels (as numbers shared with the anchors)."""
    order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
    kinds: dict = {}
    number = lambda t, c="label": np.array([kinds.setdefault(v, len(kinds)) for v in t.column(c).to_pylist()], np.int64)
    return matrix(anchors.column("a_v"), width), number(anchors, "a_label"), matrix(rows.column("v"), width)[order], rows.column("vec_id").to_numpy()[order], number(rows)[order]


def positives(rows: DataFrame, n_anchors: int, width: int, longest: float, k: int, slack: float) -> DataFrame:
    """anchor_id and found, an array of (score, positive_id): the anchor's best k other rows of its label."""
    parts = max(1, -(-n_anchors // PART_ANCHORS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int"))
    inner = Window.partitionBy("label", "cell").orderBy("d", "vec_id")
    close = rows.select("label", "cell", "d", "vec_id").withColumn("_k", F.row_number().over(inner)).where(F.col("_k") <= k + 1)  # the anchor may be one
    close = close.groupBy("label").agg(F.collect_list(F.struct("cell", "d")).alias("_close"))
    reach = F.get(F.array_sort(F.transform("_close", lambda c: F.get("ds", c["cell"]) + c["d"])), F.lit(k))
    anchors = join_few(dealt.where("anchor"), close, "label").withColumn("far", F.coalesce(reach, F.lit(float("inf")))).withColumn("near", F.lit(0.0)).drop("_close")
    anchors = checkpointed(grouped(anchors).select("vec_id", "label", "v", "ds", "part", "sub", "near", "far"))
    served = sent(dealt.drop("ds", "anchor", "size"), anchors, lambda to: to - F.col("far"), lambda to: to + F.col("far"), slack)
    served, everywhere = in_blocks(served, anchors.drop("ds", "near", "far"), rows.sparkSession.sparkContext.defaultParallelism)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        if len(left) and len(right):
            a, a_label, x, ids, label = _sides(left, right, width)
            own = left.column("a_id").to_numpy()
            for at, s in exact_products(a, x, longest):
                t = slice(at, at + len(s))
                s[(a_label[t, None] != label) | (own[t, None] == ids)] = -np.inf
                for i, j, value in best(s, k):
                    for c, y in zip(out, (own[at + i], ids[j], value.astype(np.int64)), strict=True):
                        c.append(y)
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in out], names=["anchor_id", "positive_id", "score"])

    key = ["part", "sub", "block"]
    found = everywhere.selectExpr(*A_SIDE).groupBy(*["a_" + c for c in key]).cogroup(served.select(*key, "vec_id", "label", "v").groupBy(*key)).applyInArrow(run, "anchor_id long, positive_id long, score long")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "positive_id")))
    return found.groupBy("anchor_id").agg(F.transform(F.slice(ranked, 1, k), lambda p: F.struct((-p["score"]).alias("score"), p["positive_id"].alias("positive_id"))).alias("found"))


def hard_negatives(rows: DataFrame, anchor: Column, k: int = 5, n: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows: vec_id, label and v as scaled gives them. For each anchor and each of its k best other rows of its label (all, if fewer), the n best
    rows of another label whose score is low to high percent of the positive's (all, if fewer). Scores are inner products; at equal scores the
    lower id comes first. Vectors shorter than the longest count as filled with zeros. An empty table, like one without anchors, gives no row.
    """
    rows = checkpointed(rows)
    facts = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c)).alias("longest"), F.max(F.size("v")).alias("width"), F.sum(F.coalesce(anchor, F.lit(False)).cast("long")).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.anchors:
        return rows.sparkSession.createDataFrame([], schema)
    width, longest = max(1, facts.width), float(max(1, facts.longest))
    chosen = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # PIVOTS at most
    pivots = matrix(pa.array([r.v for r in chosen], pa.list_(pa.int32())), width)
    slack = 1e-6 * longest**0.5 + 1e-6
    rows = checkpointed(placed(rows, anchor, pivots, longest))

    good = positives(rows, facts.anchors, width, longest, k, slack)
    own = rows.where("anchor").join(good.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("found", F.filter("found", lambda p: p["score"] >= 0)).where(F.size("found") > 0)
    most, least = F.floor(F.get("found", F.lit(0))["score"] * high / 100), F.element_at("found", -1)["score"] * low / 100
    shell = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("size") + longest - 2 * score.cast("double")))
    own = own.withColumn("part", F.lit(0)).withColumn("near", shell(most)).withColumn("far", shell(least))
    own = checkpointed(grouped(own).select("vec_id", "label", "v", "ds", "part", "sub", "near", "far", "found"))
    served = sent(rows.withColumn("part", F.lit(0)).drop("ds", "anchor", "size"), own, lambda to: F.greatest(F.col("near") - to, to - F.col("far")), lambda to: to + F.col("far"), slack)
    served, everywhere = in_blocks(served, own.drop("ds", "near", "far"), rows.sparkSession.sparkContext.defaultParallelism)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple = [], [], [], [], []
        if len(left) and len(right):
            a, a_label, x, ids, label = _sides(left, right, width)
            own_ids, found = left.column("a_id").to_numpy(), left.column("found").to_pylist()
            for at, s in exact_products(a, x, longest):
                s[a_label[at : at + len(s), None] == label] = -np.inf
                for p in range(k):
                    has = np.array([i for i in range(len(s)) if len(found[at + i]) > p], np.int64)
                    if not len(has):
                        break
                    score = np.array([found[at + i][p]["score"] for i in has], np.int64)
                    partner = np.array([found[at + i][p]["positive_id"] for i in has], np.int64)
                    t = s[has]
                    t[(t > (score * high // 100)[:, None]) | (t < -(-score * low // 100)[:, None])] = -np.inf
                    for i, j, value in best(t, n):
                        for c, y in zip(out, (own_ids[at + has[i]], partner[i], ids[j], score[i], value.astype(np.int64)), strict=True):
                            c.append(y)
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in out], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    key = ["part", "sub", "block"]
    got = everywhere.selectExpr(*A_SIDE, "found").groupBy(*["a_" + c for c in key]).cogroup(served.select(*key, "vec_id", "label", "v").groupBy(*key)).applyInArrow(run, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= n).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
