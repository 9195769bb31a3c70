"""From documents to training tokens: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), with docs the documents that the stage before kept, and returns a DataFrame; all
but the last return the columns of documents. Every stage's result is written as Parquet in the shared folder and
read again, so that a lost executor costs a part of one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, decontam, lines, rules, simhash
from strataloom.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return rules.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay only in the document with the largest id; n_chars follows the text. No document goes."""
    out = lines.drop_common_lines(docs)
    dropped = out.columns[-1]
    n_chars = F.when(F.col(dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the least id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left: number, and digests of the ids and of the decoded text."""
    return bpe.digest_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The stages' tables lie in a folder of this run under spark.checkpoint.dir (see shared_folder)."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs


#: SimHash components and BPE can't be stated in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None
