"""Quality rules with adaptive thresholds.

Each document's signals are rates per thousand (whole numbers). For every language and source, a signal's
distribution is kept as a quantile sketch: a histogram whose buckets are exact up to SUB and then keep the leading
bits, so that a quantile is off by less than one part in SUB / 2. A sketch is the counts of its buckets: sketches
merge by adding counts, in any order and with the same result, and have a few hundred buckets at most. A group with
fewer than MIN_DOCS documents takes the thresholds of its language, and a language with fewer those of all rows; those
sketches are merged from the groups'. Junk sits in a cluster of its own in the upper tail: a threshold lies in the middle of
the widest gap (by ratio, counted from one sketch's exact part on) of the group's own sketch above which TAIL of the documents
or fewer lie, if the gap's ends are GAP times apart or more; a group without such a gap has no junk of that kind and no
threshold. No cutoff is fixed. The thresholds are then joined to the documents, which are filtered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CONTINUATION, SPACE, checkpointed, free_names, map_texts, with_text_columns

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SUB = 64
MIN_DOCS = 100
#: A gap's least ratio, its ends counted from -SUB (below SUB a sketch is exact, so lesser differences are noise), and the greatest part of the documents above it, in tenths.
GAP, TAIL_TENTHS = 2, 3
#: Signals, per thousand.
SIGNALS = ("symbol_rate", "shout_rate", "upper_rate")
#: Groups whose thresholds are broadcast at most; beyond, the join is left to Spark.
BROADCAST_GROUPS = 100_000

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FIELDS = f"{BASE}, symbol_rate long, shout_rate long, upper_rate long"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v == n:
        return 0
    pair = ids[:-1] * v + ids[1:]
    if v < 2_000_000:
        code = pair[:-1] * v + ids[2:]
    else:
        code = np.unique(pair, return_inverse=True)[1][:-1] * v + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def signals(text: bytes) -> tuple[int, ...]:
    """One text's columns of FIELDS; a rate of a text without words is 0."""
    words = text.split()
    n = len(words)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    upper = len(text) - len(text.translate(None, UPPER))
    letters = len(text) - len(text.translate(None, LETTERS))
    return (n, len(text.translate(None, SPACE + CONTINUATION)), symbols, len(lines) - len(set(lines)), repeated_words(words),
            1000 * symbols // n if n else 0, 1000 * text.count(b"!") // n if n else 0, 1000 * upper // letters if letters else 0)


def _make():
    return lambda texts: map(signals, texts)


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def bucket(v):
    """The lower end of the sketch's bucket that holds v."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - F.lit(SUB.bit_length() - 1))
    return F.when(v < SUB, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def thresholds(stats: DataFrame) -> DataFrame:
    """lang, source and a threshold for each signal, of every group in stats (columns lang, source, n_words and SIGNALS).

    Sketches hold the documents that have words. Null is a language or source like any other.
    """
    rows = stats.where("n_words > 0")
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), bucket(F.col(k)).alias("b")) for k in SIGNALS])).alias("x"))
    sketch = long.groupBy("lang", "source", "x.signal", "x.b").agg(F.count("*").alias("n"))
    sketch = checkpointed(sketch)
    levels = [sketch.select(F.lit(0).alias("level"), "lang", "source", "signal", "b", "n")]
    levels.append(sketch.groupBy("lang", "signal", "b").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "signal", "b", "n"))
    levels.append(sketch.groupBy("signal", "b").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "signal", "b", "n"))
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    whole = Window.partitionBy("level", "lang", "source", "signal")
    ordered = whole.orderBy("b")
    ranked = merged.withColumn("below", F.sum("n").over(ordered)).withColumn("docs", F.sum("n").over(whole)).withColumn("next", F.lead("b").over(ordered))
    ratio = (F.col("next") + SUB) / (F.col("b") + SUB)
    gap = F.when((10 * F.col("below") >= (10 - TAIL_TENTHS) * F.col("docs")) & (ratio >= GAP), F.struct(ratio.alias("ratio"), (-F.col("b")).alias("b"), F.floor((F.col("b") + F.col("next")) / 2).alias("most")))
    limits = ranked.groupBy("level", "lang", "source", "signal", "docs").agg(F.max(gap)["most"].alias("most"))
    wide = limits.groupBy("level", "lang", "source", "docs").agg(*[F.max(F.when(F.col("signal") == k, F.col("most"))).alias(f"most_{k}") for k in SIGNALS])
    own, lang, everything = (wide.where(F.col("level") == k) for k in range(3))
    lang = lang.select(F.col("lang").alias("lang1"), F.col("docs").alias("docs1"), *[F.col(f"most_{k}").alias(f"lang_{k}") for k in SIGNALS])
    everything = everything.select(*[F.col(f"most_{k}").alias(f"all_{k}") for k in SIGNALS])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").join(F.broadcast(everything.limit(1)), F.lit(True), "left")
    pick = lambda k: F.when(F.col("docs") >= MIN_DOCS, F.col(f"most_{k}")).when(F.col("docs1") >= MIN_DOCS, F.col(f"lang_{k}")).otherwise(F.col(f"all_{k}"))
    return joined.select("lang", "source", *[pick(k).alias(f"limit_{k}") for k in SIGNALS])


def judged(rows: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """rows with the columns base_failed and kept (names after prefix), by a join with their group's limits."""
    by_lang, by_source, *names = free_names(rows, "_limit_lang", "_limit_source", *[f"_limit_{k}" for k in SIGNALS])
    limits = checkpointed(limits.select(F.col("lang").alias(by_lang), F.col("source").alias(by_source), *[F.col(f"limit_{k}").alias(n) for k, n in zip(SIGNALS, names, strict=True)]))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    c = lambda name: F.col(prefix + name)
    out = rows.join(limits, F.col(lang).eqNullSafe(F.col(by_lang)) & F.col(source).eqNullSafe(F.col(by_source)), "left")
    failed = base_failed(c("n_words"), c("n_repeat_words"))
    passes = F.lit(True)
    for k, n in zip(SIGNALS, names, strict=True):
        passes = passes & (c(k) <= F.coalesce(F.col(n), F.lit(2**62)))
    return out.select(*rows.columns, failed.alias(prefix + "base_failed"), (~failed & passes).alias(prefix + "kept"))


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_col, lang, source, the columns of FIELDS, base_failed and kept, for each row of df.

    A null or empty text has no words and fails the base rule. Repeated rows are judged, and counted in the sketches,
    each by itself. Other columns of df are left out.
    """
    keys = df.select(F.struct(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")).alias("key"), F.col(text_col).alias("text"))
    stats = map_texts(keys, "key", "text", _make, FIELDS)
    stats = checkpointed(stats.select(F.col("key.id").alias(id_col), "key.lang", "key.source", *[f.split()[0] for f in FIELDS.split(", ")]))
    return judged(stats, thresholds(stats))


def filter_documents(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that apply_rules keeps, with all their columns.

    The signals are computed twice, for the sketches and for the filter, instead of moving texts in a join.
    """
    slim = with_text_columns(df.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")), "text", _make, FIELDS)
    limits = thresholds(slim.drop("text"))
    prefix = "_rules_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    fields = ", ".join(prefix + f for f in FIELDS.split(", "))
    rows = with_text_columns(df, text_col, _make, fields)
    return judged(rows, limits, lang_col, source_col, prefix).where(F.col(prefix + "kept")).select(*df.columns)
