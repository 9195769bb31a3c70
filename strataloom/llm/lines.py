"""Exact removal of repeated lines by sharded minimal perfect hashes.

One pass counts, for each distinct line hash (128 bits), the documents that hold it and the largest of their ids. The
lines found in enough documents are indexed: each shard of their hashes gets a minimal perfect hash, a cascade of bit
arrays in which a key stands at the first level where no other key shares its place and whose index is the number of
set bits before it. The index points into arrays of fingerprints (the second half of the hash, which tells a line
that isn't in the shard), counts, and the ids that keep the line. A second pass probes the arrays for every line.

The arrays of up to WAVE_BYTES are broadcast, and every document probes them where it is. That is all of them if they are so few, which is known from a
count before anything is gathered; else those of the lines found most often. The other lines' shards are then probed where they are: the hashes
of the documents' remaining lines go to them by a shuffle, dealt to as many tasks a shard as it has lines, and only the numbers of the lines to drop
come back. Either way the texts are rewritten once, and no line is so frequent that its hashes meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, arrow_type, checkpointed, free_names, once, small_batches

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 50_000
#: Lines of a shard that one task probes, about.
TASK_LINES = 2_000_000
#: Of a key in the arrays: fingerprint, count, id, and its share of the bit arrays.
KEY_BYTES = 24
WAVE_BYTES = 48 << 20
MASK = (1 << 64) - 1


def line_key(line: bytes) -> bytes | None:
    """The line as it is compared, or None if it is shorter than MIN_CHARS code points."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode()) < MIN_CHARS:
        return None
    return key


def line_hashes(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """The lines, the numbers of those that count, and the 128-bit hashes of the latter."""
    lines = text.split(b"\n")
    at, hashes = [], []
    for k, line in enumerate(lines):
        if len(line) >= MIN_CHARS and (key := line_key(line)) is not None:
            at.append(k)
            hashes.append(xxhash.xxh3_128_intdigest(key))
    return lines, at, hashes


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([h >> 64 for h in hashes], np.uint64), np.array([h & MASK for h in hashes], np.uint64)


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A hash of h for each level (the finaliser of splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; place() gives keys that aren't among them any place, or -1."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # words of bits; set bits before each word, of all levels
        before, level = 0, 0
        while len(keys):
            size = max(64, -(-2 * len(keys) // 64) * 64)
            slot = (mixed(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size)[slot] == 1
            words = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(words, slot[alone] >> 6, np.uint64(1) << (slot[alone] & 63).astype(np.uint64))
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, before + np.cumsum(counts) - counts))
            before += int(counts.sum())
            keys, level = keys[~alone], level + 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (words, before) in enumerate(self.levels):
            if not len(rest):
                break
            slot = (mixed(keys[rest], level) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = words[slot >> 6], np.uint64(1) << (slot & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[rest[hit]] = (before[slot >> 6] + np.bitwise_count(word & (bit - np.uint64(1))))[hit]
            rest = rest[~hit]
        return out


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's hash levels and arrays as bytes."""
    keys = pdf["h1"].to_numpy().view(np.uint64)
    same, number = np.unique(keys, return_inverse=True)  # first halves that are equal by chance share a place
    mph = PerfectHash(same)
    place = mph.place(same)[number]
    extra = pd.Series(place).duplicated().to_numpy()
    order = np.empty(mph.n, np.int64)
    order[place[~extra]] = np.flatnonzero(~extra)
    levels = [x.tobytes() for pair in mph.levels for x in pair]
    pick = lambda c, kind: pdf[c].to_numpy().astype(kind)
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "levels": levels, "prints": pick("h2", np.int64)[order].tobytes(), "counts": np.minimum(pick("n", np.int64), 2**32 - 1).astype(np.uint32)[order].tobytes(),
        "keeps": pick("keep", np.int64)[order].tobytes(), "extra": [list(map(int, x)) for x in zip(pick("h1", np.int64)[extra], pick("h2", np.int64)[extra], pick("n", np.int64)[extra], pick("keep", np.int64)[extra], strict=True)],
    }])


SHARD = "shard long, levels array<binary>, prints binary, counts binary, keeps binary, extra array<array<long>>"


class Shards:
    """Shards, probed by hash."""

    def __init__(self, rows: list, n_shards: int):
        self.n_shards, self.shards, self.extra = n_shards, {}, {}
        for r in rows:
            mph = PerfectHash(np.zeros(0, np.uint64))
            parts = [bytes(x) for x in r["levels"]]
            mph.levels = [(np.frombuffer(parts[k], np.uint64), np.frombuffer(parts[k + 1], np.int64)) for k in range(0, len(parts), 2)]
            self.shards[r["shard"]] = mph, np.frombuffer(r["prints"], np.int64).view(np.uint64), np.frombuffer(r["counts"], np.uint32), np.frombuffer(r["keeps"], np.int64)
            self.extra |= {(h1, h2): (n, keep) for h1, h2, n, keep in r["extra"]}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of documents (0: not here) and the id that keeps the line, for each hash."""
        count, keep = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        shard = (h1 % np.uint64(self.n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            if (found := self.shards.get(int(shard[part[0]]))) is None:
                continue
            mph, prints, counts, keeps = found
            place = mph.place(h1[part])
            there = place >= 0
            there[there] = prints[place[there]] == h2[part][there]
            count[part[there]], keep[part[there]] = counts[place[there]], keeps[place[there]]
        if self.extra:
            signed = h1.view(np.int64).tolist(), h2.view(np.int64).tolist()
            for k, key in enumerate(zip(*signed, strict=True)):
                if key in self.extra:
                    count[k], keep[k] = self.extra[key]
        return count, keep


def common_lines(df: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """h1, h2 (halves of the hash), n (documents) and keep (the largest id) of the lines found in min_docs documents.

    A document is an id: rows that share one count once; rows with a null id don't count.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    out = T.StructType.fromDDL("h1 long, h2 long, id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[int] = []
            ids: list[int] = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t and len(t) >= MIN_CHARS:
                    own = set(line_hashes(t)[2])
                    hashes += own
                    ids += [i] * len(own)
            h1, h2 = halves(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], names=out.names)

    found = source.mapInArrow(run, out)
    return found.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs)


def shards_of(common: DataFrame, n_shards: int) -> DataFrame:
    numbered = common.withColumn("shard", F.expr(f"cast(pmod(cast(conv(hex(h1), 16, 10) as decimal(20)), {n_shards}) as long)"))
    return numbered.groupBy("shard").applyInPandas(build_shard, SHARD)


def broadcast_bound(common: DataFrame, most: int) -> int:
    """The least number of documents such that no more than `most` lines are found in so many: from the lines' numbers by size, some hundreds of rows."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    total, least = 0, 1 << 62
    for r in common.groupBy(bucket.alias("b")).agg(F.count("*").alias("lines"), F.min("n").alias("n")).orderBy(F.desc("b")).collect():
        total += r.lines
        if total > most:
            break
        least = r.n
    return least


def drop_common_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """df with its texts' common lines dropped, and two columns after its own: _lines_total and _lines_dropped (with more underscores if df has these).

    A line whose key (white space at its ends stripped, A-Z lower-cased) has MIN_CHARS code points or more and is found in
    min_docs documents stays only in the one with the largest id. A null or empty text is one empty line and stays
    as it is, and so do rows with a null id, which count for no line. Rows that share an id are one document, each with its own lines; an empty table gives none.
    Ids are whole numbers (tinyint to bigint): the largest id is the keeper, and other kinds would be cut to numbers that several
    documents share. An id column of another type raises a TypeError before any data is read; such ids can be numbered first.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {df.schema[id_col].dataType.simpleString()}")
    spark = df.sparkSession
    small_batches(spark)
    common = checkpointed(common_lines(df, id_col, text_col, min_docs))
    total, most = common.count(), WAVE_BYTES // KEY_BYTES
    least = 0 if total <= most else broadcast_bound(common, most)
    often = common.where(F.col("n") >= least)
    n_often = often.count() if least else total
    n_shards = max(1, -(-n_often // SHARD_KEYS))
    held = [r.asDict() for r in shards_of(often, n_shards).collect()] if n_often else []  # at most WAVE_BYTES, by the bound
    shared = spark.sparkContext.broadcast((held, n_shards))
    rows = df
    (gone,) = free_names(df, "_lines_gone")
    if n_often < total:
        rare = checkpointed(common.where(F.col("n") < least))
        found = probe_shards(df, id_col, text_col, shared, rare, total - n_often, rare.agg(F.sum("n")).first()[0])
        i, k = free_names(df, "_lines_id", "_lines_key")
        found = found.select(F.col("id").alias(i), F.col("key").alias(k), F.col("gone").alias(gone))
        rows = df.join(found, (df[id_col].cast("long") == F.col(i)) & (F.xxhash64(df[text_col].cast("string")) == F.col(k)), "left").select(*[df[c] for c in df.columns], gone)
    else:
        rows = df.withColumn(gone, F.lit(None).cast("array<int>"))
    return cut_lines(rows, shared, id_col, text_col, gone)


def probe_shards(df: DataFrame, id_col: str, text_col: str, shared, rare: DataFrame, n_rare: int, n_lines: int) -> DataFrame:
    """id, key (a hash of the text) and gone (numbers of lines to drop, by the shards of the rare lines) for each id and text that has any."""
    n_shards = max(1, -(-n_rare // SHARD_KEYS))
    parts = max(1, -(-n_lines // (n_shards * TASK_LINES)))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    line = T.StructType.fromDDL("id long, key long, line int, h1 long, h2 long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines that count and aren't broadcast."""
        index = once("lines", shared.value, lambda v: Shards(*v))
        for batch in batches:
            ids, keys, at, hashes = [], [], [], []
            for i, k, t in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t and len(t) >= MIN_CHARS:
                    _, own, h = line_hashes(t)
                    ids += [i] * len(own)
                    keys += [k] * len(own)
                    at += own
                    hashes += h
            h1, h2 = halves(hashes)
            rest = pa.array(index.probe(h1, h2)[0] == 0)
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=line.names).filter(rest)

    lines = source.mapInArrow(hashed, line)
    shard = F.expr(f"cast(pmod(cast(conv(hex(h1), 16, 10) as decimal(20)), {n_shards}) as long)")
    lines = lines.select(shard.alias("shard"), F.pmod(F.xxhash64("id", "key"), F.lit(parts)).cast("int").alias("part"), *line.names)
    arrays = checkpointed(shards_of(rare, n_shards)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    fields = [c.split()[0] for c in SHARD.split(", ")[1:]]
    both = arrays.unionByName(lines, allowMissingColumns=True).withColumn("is_line", F.col("h1").isNotNull().cast("int"))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards * parts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and part: the arrays, then the lines."""
        index, held = None, None
        for batch in batches:
            shard, is_line = batch.column("shard").to_pylist(), batch.column("is_line").to_pylist()
            at = 0
            while at < len(shard):
                if not is_line[at]:
                    row = batch.slice(at, 1).to_pylist()[0]
                    index, held = Shards([{"shard": 0, **{c: row[c] for c in fields}}], 1), shard[at]
                    at += 1
                    continue
                end = at
                while end < len(shard) and is_line[end] and shard[end] == shard[at]:
                    end += 1
                some = batch.slice(at, end - at)
                if held == shard[at]:
                    count, keep = index.probe(*(some.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")))
                    yield some.filter(pa.array((count > 0) & (keep != some.column("id").to_numpy()))).select(["id", "key", "line"])
                at = end

    gone = both.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "is_line").mapInArrow(probe, "id long, key long, line int")
    return gone.groupBy("id", "key").agg(F.collect_set("line").alias("gone"))


def cut_lines(rows: DataFrame, shared, id_col: str, text_col: str, gone_col: str) -> DataFrame:
    """rows without the lines that the broadcast shards drop and those numbered in gone_col, which goes; with the two counts."""
    plain = rows.drop(gone_col)
    counts = free_names(plain, "_lines_total", "_lines_dropped")
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    where = {n: rows.columns.index(n) for n in (id_col, text_col, gone_col)}
    text_type = arrow_type(rows.schema[text_col].dataType)
    others = [k for k, c in enumerate(rows.columns) if c != gone_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once("lines", shared.value, lambda v: Shards(*v))
        for batch in batches:
            ids = batch.column(where[id_col]).to_pylist()
            texts = batch.column(where[text_col]).cast(pa.binary()).to_pylist()
            numbered = batch.column(where[gone_col]).to_pylist()
            found = [line_hashes(t) if t and i is not None and len(t) >= MIN_CHARS else None for i, t in zip(ids, texts, strict=True)]
            count, keep = index.probe(*halves([h for x in found if x for h in x[2]]))
            at, totals, dropped = 0, [], []
            for k, x in enumerate(found):
                totals.append(1 if not texts[k] else texts[k].count(b"\n") + 1)
                gone: set[int] = set()
                if x:
                    n = len(x[1])
                    if (count[at : at + n] > 0).any():
                        gone = {j for j, c, d in zip(x[1], count[at : at + n].tolist(), keep[at : at + n].tolist(), strict=True) if c and d != ids[k]}
                    gone.update(numbered[k] or ())
                    at += n
                if gone:
                    texts[k] = b"\n".join([line for j, line in enumerate(x[0]) if j not in gone])
                dropped.append(len(gone))
            columns = list(batch.columns)
            columns[where[text_col]] = pa.array(texts, pa.binary()).cast(text_type)
            yield pa.RecordBatch.from_arrays([*(columns[k] for k in others), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines, n_dropped and kept_sha256 of drop_common_lines, for each row."""
    rows = drop_common_lines(df.select(id_col, text_col), id_col, text_col)
    total, dropped = rows.columns[-2:]
    return rows.select(id_col, F.col(total).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
