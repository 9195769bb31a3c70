"""What the text operators share: tables, the shared checkpoint folder, and maps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the operators' contracts: \x20 and \x09-\x0D. bytes.split(), strip() and lower() mean exactly
#: these bytes and A-Z, so texts are handled as UTF-8 bytes.
SPACE = b" \t\n\v\f\r"
#: UTF-8 continuation bytes; deleting them leaves one byte for each code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes of one Arrow batch handed to a Python worker: a bound that holds however long the texts are.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy of df in the cluster's shared folder, which survives the loss of any executor.

    The folder is the session's checkpoint folder, or that of shared_folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: on one machine (a local master, as in tests) a folder of the warehouse; on a cluster an error, since no folder is known to be shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, since one text may be as long as ten thousand others.

    The setting is read when a plan runs, so it stays set on the session; a smaller bound that the caller has set is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name) or "").rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as df has such a column (case doesn't matter to Spark)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: A key with more rows than this, and more than one in MOST_HUBS, is a hub.
HUB_ROWS, MOST_HUBS = 256, 100_000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined with the row of unique that has their key (none has it twice), with no task that gets all rows of a frequent key.

    Hubs, of which there can be MOST_HUBS at most, are broadcast, and their rows stay where they are; the others meet by a shuffle.
    n_rows: how many rows there are, about.
    """
    hub = max(HUB_ROWS, n_rows // MOST_HUBS)
    named = "_hub_" + key
    counts = rows.groupBy(key).agg(F.count("*").alias("_hub_n")).where(F.col("_hub_n") > hub)
    others = [c for c in unique.columns if c != key]
    hubs = counts.join(unique, key).select(F.col(key).alias(named), F.struct(*others).alias("_hub_row"))
    marked = rows.join(F.broadcast(hubs), F.col(key) == F.col(named), "left")
    here = marked.where(F.col(named).isNotNull()).select(*rows.columns, *[F.col(f"_hub_row.{c}").alias(c) for c in others])
    there = marked.where(F.col(named).isNull()).select(*rows.columns).join(unique, key).select(*rows.columns, *others)
    return here.unionByName(there)


def join_few(rows: DataFrame, few: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """rows left-joined with few, whose keys are distinct and each of which many rows may have: broadcast if they are MOST_HUBS at most, else salted."""
    if few.count() <= MOST_HUBS:
        return rows.join(F.broadcast(few), key, "left")
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column as UTF-8; null is the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[bytes]], Iterable[Iterable]]], fields: str) -> DataFrame:
    """id_col and what make()(texts) gives for each text: columns as in the DDL string fields.

    make runs once a task, so that a function may keep a cache while it lasts.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *T.StructType.fromDDL(fields).fields])
    kinds = [arrow_type(f.dataType) for f in out.fields[1:]]
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = list(zip(*work(texts_of(batch, "text")), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return source.mapInArrow(run, out)


def with_text_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes]], Iterable[Iterable]]], fields: str) -> DataFrame:
    """df with further columns computed from each text; the names in fields must be free."""
    small_batches(df.sparkSession)
    extra = T.StructType.fromDDL(fields)
    kinds = [arrow_type(f.dataType) for f in extra.fields]
    names = [*df.columns, *extra.names]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = list(zip(*work(texts), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra.fields]))


_made: dict[str, tuple] = {}


def once(kind: str, value, make: Callable):
    """make(value), made once in a Python worker for as long as this kind's value is the same object."""
    held = _made.get(kind)
    if held is None or held[0] is not value:
        held = _made[kind] = value, make(value)
    return held[1]
