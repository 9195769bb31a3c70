"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark's normalised words are a broadcast hash set; every window of the documents' words is
hashed where it stands, in generated code and without building it, and looked up. A hit is verified word by word. One
row for each document and one for each hit leave the map side; nothing else of the texts moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names

WINDOW = 10
#: Distinct windows that are broadcast at once (some 200 bytes each). More are looked up in waves of so many, each a pass
#: over the documents: their windows are never shuffled.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words, in order; none for null. lower() is A-Z only where all is ASCII, and much the faster there."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, BETWEEN), "")


def window_hash(words: Column, at: Column, size: int) -> Column:
    """Beyond the end there are nulls, which leave the hash as it is."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """hash, words, size and items (the ids, as strings) of each distinct window.

    An item with fewer words than a window is one window; one with none (null, empty) has none.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    cut = items.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at") + 1, window).alias("words"))
    distinct = cut.groupBy("words").agg(F.collect_set("item").alias("items"))
    return distinct.select(window_hash(F.col("words"), F.lit(0), window).alias("hash"), "words", F.size("words").alias("size"), "items")


def find_hits(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, n_words, n_hit, items (sorted strings) and hits (pos, size of each hit window) for each row of documents.

    A null or empty text has no words and no hits; repeated rows give a row each; an empty benchmark hits nothing.
    """
    known = checkpointed(benchmark_windows(benchmark, item_col, item_text, window))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # window different values at most
    waves = max(1, -(-known.count() // BROADCAST_WINDOWS))
    docs = documents.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("doc_words"))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "id", "doc_words", F.size("doc_words").alias("n_words"))
    at = docs.select("row", "id", "n_words", "doc_words", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)))).alias("pos"))
    if len(sizes) <= 1:
        seen = at.withColumn("doc_hash", window_hash(F.col("doc_words"), F.col("pos"), (sizes or [window])[0]))
    else:
        each = F.array(*[F.when(F.col("pos") + n <= F.col("n_words"), window_hash(F.col("doc_words"), F.col("pos"), n)) for n in sizes])
        seen = at.withColumn("doc_hash", F.explode(each))
    same = (F.col("doc_hash") == F.col("hash")) & (F.slice("doc_words", F.col("pos") + 1, F.col("size")) == F.col("words"))
    parts = []
    for wave in range(waves):
        some = F.broadcast(known.where(F.pmod(F.col("hash"), F.lit(waves)) == wave) if waves > 1 else known)
        looked = seen.join(some, same, "left")
        kept = looked.where(F.col("hash").isNotNull() | (F.col("pos") == 0)) if wave == 0 else looked.where(F.col("hash").isNotNull())
        parts.append(kept.select("row", "id", "n_words", "pos", "hash", "size", "items"))
    found = reduce(DataFrame.unionByName, parts)
    hit = F.when(F.col("hash").isNotNull(), F.struct("pos", "size"))
    by_doc = found.groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.collect_set("items").alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(seen: Column, x: Column) -> Column:
        stop = x["pos"] + x["size"]
        return F.struct(F.greatest(seen["end"], stop).alias("end"), (seen["n"] + F.greatest(F.lit(0), stop - F.greatest(seen["end"], x["pos"]))).cast("long").alias("n"))

    return by_doc.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.aggregate("hits", start, cover)["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "hits")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(documents, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1) -> DataFrame:
    """documents without those that hold least_words hit words or more. Rows with a null id are judged as one document."""
    found = find_hits(documents.select(id_col, text_col), benchmark, id_col, text_col)
    (hit,) = free_names(documents, "_hit_id")
    bad = found.where(F.col("n_hit") >= least_words).select(F.col(id_col).alias(hit)).distinct()
    return documents.join(bad, documents[id_col].eqNullSafe(F.col(hit)), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with their hit words, and what follows each up to the next word, cut out of the text.

    Only contaminated texts are rewritten. Ids should be distinct and not null: others keep their texts.
    """
    found = find_hits(documents.select(id_col, text_col).where(F.col(id_col).isNotNull()), benchmark, id_col, text_col).where("n_hit > 0")
    gone = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1))))
    cut_id, gone_col = free_names(documents, "_cut_id", "_cut")
    cut = found.select(F.col(id_col).alias(cut_id), gone.alias(gone_col)).dropDuplicates([cut_id])
    word, other = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({word}+{other}*)"), F.lit(1))
    lead = F.regexp_extract(F.col(text_col), f"^({other}*)", 1)
    kept = F.filter(pieces, lambda x, k: ~F.array_contains(F.col(gone_col), k))
    out = documents.join(cut, documents[id_col] == F.col(cut_id), "left")
    text = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, "")))
    return out.withColumn(text_col, text).select(*documents.columns)
