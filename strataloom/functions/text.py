"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CONTINUE_START, DANGLERS, INCOMPLETE_TAILS, MORE_STOPWORDS, TOPIC_START


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """What stands between white space; no tokens for blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def norm_words(text: Column) -> Column:
    """Lower-cased words of a-z, 0-9 and the apostrophe; all else parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9' ]", " "), " +"), lambda x: x != "")


def norm_token(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9']+", "")


def content_tokens(text: Column) -> Column:
    """The set of a text's words that aren't stopwords and have over two characters."""
    stop = strings(dict.fromkeys(INCOMPLETE_TAILS + MORE_STOPWORDS))
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9'\s]+", ""), r"\s+")
    return F.filter(F.array_except(words, stop), lambda t: F.length(t) > 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def starts_topic(text: Column, pattern: str = TOPIC_START) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)


def thought_complete(text: Column, words: Column | None = None) -> Column:
    """Ends in a full stop, or has six words or more of which the last may end a thought. words: the text's tokens, where a column has them."""
    words = tokens(text) if words is None else words
    last = norm_token(F.element_at(words, -1))
    return F.when(F.size(words) == 0, F.lit(False)).when(F.element_at(words, -1).rlike("[.?!]$"), F.lit(True)).otherwise((F.size(words) >= 6) & ~F.array_contains(strings(INCOMPLETE_TAILS), last))


def topic_shift(before: Column, after: Column, gap: Column, idea: float = 2.15, scene: float = 8.5, topic: str = TOPIC_START, goes_on: str = CONTINUE_START) -> Column:
    """Additive score that a new topic begins between two texts, gap seconds apart. For tables of any size see with_topic_shift."""
    a, b = content_tokens(before), content_tokens(after)
    return _shift(jaccard(a, b), (F.size(a) > 0) & (F.size(b) > 0), thought_complete(before), starts_topic(after, topic), starts_topic(after, goes_on), gap, idea, scene)


def _shift(alike: Column, both: Column, complete: Column, begins: Column, continues: Column, gap: Column, idea: float, scene: float) -> Column:
    return (
        F.when(gap >= idea, 2.2).otherwise(0.0) + F.when(gap >= scene, 2.5).otherwise(0.0) + F.when(begins, 2.4).otherwise(0.0) - F.when(continues, 2.2).otherwise(0.0)
        + F.when((alike < 0.08) & both, 2.0).when(alike < 0.16, 1.0).otherwise(0.0) + F.when(complete, 0.6).otherwise(-2.8)
    )


def with_content(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with complete and _content: what with_topic_shift needs of each text, found once for it."""
    return rows.withColumns({"_content": content_tokens(F.col(text)), "_tokens": tokens(F.col(text))}).withColumn("complete", thought_complete(F.col(text), F.col("_tokens"))).drop("_tokens")


def with_topic_shift(rows: DataFrame, after: str, content_after: str, gap: Column, idea: float = 2.15, scene: float = 8.5, topic: str = TOPIC_START, goes_on: str = CONTINUE_START) -> DataFrame:
    """Rows of with_content, each with the text after it and that text's content (null: none), with next_topic and shift, as topic_shift: each step is a column, so that it is worked out once."""
    rows = rows.withColumns({"_content_after": F.coalesce(content_after, F.array().cast("array<string>")), "next_topic": starts_topic(F.col(after), topic)})
    rows = rows.withColumns({"_alike": jaccard(F.col("_content"), F.col("_content_after")), "_both": (F.size("_content") > 0) & (F.size("_content_after") > 0)})
    return rows.withColumn("shift", _shift(F.col("_alike"), F.col("_both"), F.col("complete"), F.col("next_topic"), starts_topic(F.col(after), goes_on), gap, idea, scene)).drop("_content_after", "_alike", "_both")


def dangles(token: Column) -> Column:
    """A word that a line shouldn't end on: a dangler without closing punctuation."""
    return F.array_contains(strings(DANGLERS), F.btrim(F.lower(F.trim(token)), F.lit(".,?!;:\"'"))) & ~F.trim(token).rlike("[.?!,]$")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds, which carry into seconds by themselves."""
    d = lambda n: F.floor(ms / n).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", d(3_600_000), d(60_000) % 60, d(1000) % 60, ms.cast("long") % 1000)


def slug(text: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)


def preview(text: Column, most: int = 110) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def caption_upper(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def rolling_pick(seed: Column, choices: int) -> Column:
    """A rolling hash (33 h + c, 32 bits) of the seed's characters, modulo choices; null without choices."""
    codes = F.transform(F.filter(F.split(seed, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32)) % choices if choices else F.lit(None).cast("long")


def comma_list(text: Column, every: tuple[str, ...]) -> Column:
    """Lower-cased entries without blanks; "all" stands for every."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.array_contains(parts, "all"), strings(every)).otherwise(parts)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def url_encode(text: Column) -> Column:
    """Percent-encoded UTF-8 but for letters, digits and - . _ ~ (a space is %20, not a plus)."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
