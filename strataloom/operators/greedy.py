"""Operators whose next step depends on the last: greedy choices and segmentations.

Each works on one ordered group (a recording) at a time, as a grouped map over its rows, or, where a recording is too long for one task, as a scan over its pieces that hands
on what is still undecided. Every order has a unique tie-break.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..params import INCOMPLETE_TAILS, Captions, Thoughts, Windows
from ..shared import checkpointed
from . import rounds, scans, snapping


def per_source(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fn: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """keys and fields: fn's rows for each group, from its columns as lists in the given order. Null keys are a group."""
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *T.StructType.fromDDL(fields).fields])
    names = schema.names

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        rows = [(*key, *r) for r in fn(*(pdf[c].tolist() for c in columns))]
        return pd.DataFrame(rows, columns=names)

    return df.select(*keys, *dict.fromkeys([*order, *columns])).groupBy(*keys).applyInPandas(run, schema)


def per_run(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fn: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """As per_source, for columns of numbers, strings and booleans: a task's groups come one after another in its Arrow batches, so that a small group costs no data frames of its own.

    A task holds a batch and the group that goes on beyond it.
    """
    own = T.StructType.fromDDL(fields)
    schema = T.StructType([*[df.schema[k] for k in keys], *own.fields])
    along = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    laid = df.select(*dict.fromkeys([*keys, *order, *columns])).withColumn("_first", F.row_number().over(along) == 1)
    key_names, whole_numbers = [f"_k{n}" for n in range(len(keys))], [isinstance(f.dataType, T.IntegralType) for f in own]

    def values(column: pa.ChunkedArray) -> list:
        if pa.types.is_floating(column.type) or pa.types.is_integer(column.type) and not column.null_count:
            return column.to_numpy().tolist()  # a null double is NaN, as in a data frame
        return column.to_pylist()

    def results(found: list, kind: pa.DataType, whole: bool) -> pa.Array:
        if whole:
            return pa.array([None if x is None or x != x else int(x) for x in found], kind)
        return pa.Array.from_pandas(pd.Series(found), type=kind, safe=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kinds = to_arrow_schema(own).types

        def groups(parts: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            starts = np.flatnonzero(table.column("_first").to_numpy())
            lists = [values(table.column(f"_c{n}")) for n in range(len(columns))]
            rows, of = [], []
            for a, b in zip(starts, [*starts[1:], len(table)], strict=True):
                made = list(fn(*(c[a:b] for c in lists)))
                rows += made
                of.append(len(made))
            if rows:
                at = pa.array(np.repeat(starts, of))
                data = [table.column(k).take(at) for k in key_names] + [results(list(c), t, w) for c, t, w in zip(zip(*rows, strict=True), kinds, whole_numbers, strict=True)]
                yield from pa.table(data, names=schema.names).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_first")).to_numpy(zero_copy_only=False))
            cut = int(starts[-1]) if len(starts) else 0
            if len(starts) and (held or cut):
                yield from groups([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from groups(held)

    given = [F.col(k).alias(n) for k, n in zip(keys, key_names, strict=True)] + [F.col(c).alias(f"_c{n}") for n, c in enumerate(columns)]
    return laid.select(*given, "_first").mapInArrow(run, schema)


def in_order(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fn: Callable[..., tuple[list[tuple], int]], number: str | None, fields: str, piece: int | None) -> DataFrame:
    """keys, number (from 1) and fields: the rows of fn(*columns, ended), which also says the first row that it still needs.

    piece None: each recording as a whole in one task, in one pass. Else recordings are scanned in pieces of about so many rows (see scans), at the price of
    some passes more; for recordings too long for a task. The rows are the same.
    """
    if piece is not None:
        return scans.scan(df, keys, order, columns, scans.tail(fn), fields, number, piece)
    whole = lambda *c: numbered(fn(*c, True)[0]) if number else fn(*c, True)[0]
    plain = all(isinstance(df.schema[c].dataType, T.NumericType | T.StringType | T.BooleanType) for c in columns)
    return (per_run if plain else per_source)(df, keys, order, columns, whole, f"{number} int, {fields}" if number else fields)


# -- spacing, suppression --------------------------------------------------------------------------------------------


def minimum_spacing(points: DataFrame, keys: list[str], at: str, spacing, low=None, high=None, long: bool = False) -> DataFrame:
    """keys and at: the points kept when, in order, each must be spacing or more after the last kept, within [low, high].

    A fold over each group's ordered points. long: by pointer doubling (see rounds), for groups too large for a task; the rows are the same.
    """
    ok = F.col(at).isNotNull()
    if low is not None:
        ok = ok & (F.col(at) >= low)
    if high is not None:
        ok = ok & (F.col(at) <= high)
    kind = points.schema[at].dataType
    fit = points.where(ok)
    if long:
        own = checkpointed(fit.select(F.struct(*keys).alias("_key"), F.col(at).alias("at")).distinct())
        return rounds.reachable(rounds.spacing_links(own, spacing)).select("_key.*", F.col("at").alias(at))
    nothing = F.array().cast(T.ArrayType(kind))
    step = lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= spacing), F.array_append(kept, x)).otherwise(kept)
    ordered = fit.groupBy(*keys).agg(F.array_sort(F.collect_set(at)).alias("_points"))
    return ordered.select(*keys, F.explode(F.aggregate("_points", nothing, step)).alias(at))


def beaten_by(numbers: list, starts: list, ends: list) -> list:
    """For each clip, best first, the number of the kept clip (closed overlap) that beats it, or None: kept ones are disjoint and sorted, so each is placed by bisection."""
    kept: list[tuple] = []
    out: list = []
    for n, a, b in zip(numbers, starts, ends, strict=True):
        k = bisect_left(kept, (a,))
        near = [kept[k - 1]] if k and kept[k - 1][1] >= a else []
        m = k
        while m < len(kept) and kept[m][0] <= b:
            near.append(kept[m])
            m += 1
        if not near:
            kept.insert(k, (a, b, n, len(kept)))
        out.append(min(near, key=lambda x: x[3])[2] if near else None)
    return out


def suppress_overlaps(clips: DataFrame, keys: list[str], score: str, number: str, start: str, end: str) -> DataFrame:
    """clips with winner: null for those kept, else the number of the kept clip (closed overlap) that beat it.

    By falling score, then number; a clip goes if it meets one already kept. Every row comes back once, those with null keys as a group and repeated numbers too.
    A clip with a null bound, or one that ends before it starts, meets nothing. A group in one task; rounds.suppress_by_rounds has no such bound.
    """
    schema = T.StructType([*clips.schema.fields, T.StructField("winner", clips.schema[number].dataType)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, number, start, end], ascending=[False, True, True, True], kind="stable")
        fit = pdf[pdf[start].notna() & pdf[end].notna() & (pdf[start] <= pdf[end])]
        winner = beaten_by(*(fit[c].tolist() for c in (number, start, end)))
        return pdf.assign(winner=pd.Series(winner, index=fit.index, dtype=object).reindex(pdf.index).where(lambda x: x.notna(), None))

    return clips.groupBy(*keys).applyInPandas(run, schema)


# -- windows ---------------------------------------------------------------------------------------------------------


def next_snapped(starts: list, ends: list, length, overlap, stretch: float, ended: bool) -> tuple[list[tuple], int]:
    """(start, end) of windows that begin and end with segments, and the first segment of one that isn't decided yet.

    A window grows while it is shorter than length and the next segment keeps it within stretch * length. The next begins at the first
    later segment that starts at overlap before its end or after, else after its last.
    """
    out, i, n = [], 0, len(starts)
    while i < n:
        begin, j = starts[i], i
        while j + 1 < n and ends[j] - begin < length and ends[j + 1] - begin <= length * stretch:
            j += 1
        onward = next((k for k in range(i + 1, n) if starts[k] >= ends[j] - overlap), None)
        if not ended and (j + 1 >= n or onward is None):
            break
        out.append((begin, ends[j]))
        if j + 1 >= n:
            return out, n
        i = j + 1 if onward is None else onward
    return out, i


def snap_windows(starts: list, ends: list, length, overlap, stretch: float) -> list[tuple]:
    """(number from 1, start, end) of a whole recording (see next_snapped)."""
    return numbered(next_snapped(starts, ends, length, overlap, stretch, True)[0])


def snapped_windows(segments: DataFrame, keys: list[str], order: list[str], start: str, end: str, p: Windows | None = None, length=None, overlap=None, piece: int | None = None) -> DataFrame:
    """keys, window, start and end of each recording's windows. piece: as in in_order, but by links (see snapping). Segments without a start or end are left out."""
    p = p or Windows()
    size, back = p.length if length is None else length, p.overlap if overlap is None else overlap
    kind = segments.schema[start].dataType.simpleString()
    timed = segments.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    numbers = all(isinstance(segments.schema[c].dataType, T.IntegralType | T.FractionalType) and not isinstance(segments.schema[c].dataType, T.DecimalType) for c in (start, end))
    if piece is not None and numbers and p.stretch >= 1:
        return snapping.snapped_by_links(timed, keys, order, start, end, size, back, p.stretch, piece)
    return in_order(timed, keys, order, [start, end], lambda a, b, ended: next_snapped(a, b, size, back, p.stretch, ended), "window", f"start {kind}, end {kind}", piece)


# -- captions --------------------------------------------------------------------------------------------------------


def numbered(rows: Iterable[tuple]) -> list[tuple]:
    return [(k, *r) for k, r in enumerate(rows, 1)]


def next_cues(texts: list, starts: list, ends: list, p: Captions, ended: bool) -> tuple[list[tuple], int]:
    """(start, end, text) of the cues that words in order make: lines of few words that break at pauses and sentence ends, and not after a dangler.

    Then the first word of no cue yet: unless the recording has ended, the last word's break waits for the word after it.
    """
    from ..params import DANGLERS

    out, first, n = [], 0, len(texts)
    for k in range(n if ended else n - 1):
        text = (texts[k] or "").strip()
        size = k - first + 1
        stays = text.lower().strip(".,?!;:\"'") in DANGLERS and text[-1:] not in (".", "?", "!", ",")
        last = k + 1 == n
        if not (last or size >= (p.hard_words if stays else p.max_words) or ends[k] - starts[first] >= p.max_seconds or starts[k + 1] - ends[k] > p.pause or size >= 3 and text[-1:] in (".", "?", "!")):
            continue
        a, b = starts[first], max(ends[k], starts[first] + p.min_seconds) if ends[k] - starts[first] < p.min_seconds else ends[k]
        if not last:
            b = min(b, starts[k + 1])
        if b > a:
            out.append((a, b, " ".join((x or "").strip() for x in texts[first : k + 1]).strip()))
        first = k + 1
    return out, first


def group_cues(texts: list, starts: list, ends: list, p: Captions) -> list[tuple]:
    """(cue, start, end, text) of a whole recording (see next_cues)."""
    return numbered(next_cues(texts, starts, ends, p, True)[0])


def build_cues(words: DataFrame, keys: list[str], order: list[str], text: str = "text", start: str = "start", end: str = "end", p: Captions | None = None, piece: int | None = None) -> DataFrame:
    """keys, cue, start, end and text. piece: see in_order. A word without a start or end is left out, as its cue can't be timed."""
    p = p or Captions()
    kind = words.schema[start].dataType.simpleString()
    timed = words.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return in_order(timed, keys, order, [text, start, end], lambda t, a, b, ended: next_cues(t, a, b, p, ended), "cue", f"start {kind}, end {kind}, text string", piece)


def next_short_cues(texts: list, starts: list, ends: list, most: int, seconds, ended: bool) -> tuple[list[tuple], int]:
    """(start, end, text, the next cue's start or None), and the first word still needed: at most `most` words or `seconds`, or to a sentence's end. Blank words are skipped.

    Unless the recording has ended, the last cue waits for the word after it.
    """
    groups: list[list[int]] = [[]]
    for k, t in enumerate(texts):
        if not (t or "").strip():
            continue
        groups[-1].append(k)
        if len(groups[-1]) >= most or ends[k] - starts[groups[-1][0]] >= seconds or t.strip()[-1] in ".!?":
            groups.append([])
    full = [g for g in groups if g]
    shown = full if ended else full[:-1]
    after = [starts[g[0]] for g in full[1:]] + [None]
    return [(starts[g[0]], ends[g[-1]], " ".join(texts[k].strip() for k in g), b) for g, b in zip(shown, after, strict=False)], len(texts) if ended or not full else full[-1][0]


def short_cues(words: DataFrame, keys: list[str], order: list[str], text: str = "text", start: str = "start", end: str = "end", most: int = 3, seconds=1.35, blank=0.45, shown=0.35, piece: int | None = None) -> DataFrame:
    """keys, cue, start, end and text. Ends are set from the next cue's start. piece: see in_order. A word without a start or end is left out, as its cue can't be timed."""
    kind = words.schema[start].dataType.simpleString()
    timed = words.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    cues = in_order(timed, keys, order, [text, start, end], lambda t, a, b, ended: next_short_cues(t, a, b, most, seconds, ended), "cue", f"start {kind}, end {kind}, text string, _after {kind}", piece)
    own = F.when(F.col("end") <= F.col("start"), F.col("start") + blank).otherwise(F.col("end"))
    ends = F.when(F.col("_after").isNull(), own).otherwise(F.least("_after", F.greatest(own, F.col("start") + shown)))
    return cues.select(*keys, "cue", "start", ends.cast(kind).alias("end"), "text")


# -- thoughts --------------------------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def ends_with(last: str) -> tuple[bool, bool]:
    """Does a text end in a full stop with this token, and may the token end a long one?"""
    return last[-1] in ".?!", "".join(c for c in last.lower() if c.isascii() and (c.isalnum() or c == "'")) not in INCOMPLETE_TAILS


def finished(last: str, tokens: int) -> bool:
    """As functions.text.thought_complete, for a text by its last token and the number of them."""
    stop, may = ends_with(last)
    return stop or tokens >= 6 and may


def next_thoughts(texts: list, starts: list, ends: list, p: Thoughts, ended: bool) -> tuple[list[tuple], int]:
    """(start, end, text, gap_after) of the thoughts of words in order, and the first word of the thought that is still open (none once the recording has ended).

    A thought ends at a pause of `scene`, or one of `breath` once it is complete. Thoughts of under min_words words go. A long one is
    parted where a new topic begins in it: from its sixth word to its fourth last, after what is complete, eight or more words apart.
    Whether words a to k are complete depends on their number and the last of them only, so nothing is joined again at each word.
    """
    import re

    topic = re.compile(p.topic_start)
    plain = [t or "" for t in texts]
    said = [t.strip() for t in plain]
    tokens, last = [0], [""]  # of the words before each
    for x in said:
        own = x.split()
        tokens.append(tokens[-1] + len(own))
        last.append(own[-1] if own else last[-1])
    done = lambda a, k: tokens[k] > tokens[a] and finished(last[k], tokens[k] - tokens[a])
    cuts, first = [0] if texts else [], 0
    for k in range(1, len(texts)):
        gap = starts[k] - ends[k - 1]
        if gap >= p.scene or gap >= p.breath and done(first, k):
            cuts.append(k)
            first = k
    out: list[tuple] = []
    for a, b in zip(cuts, [*cuts[1:], len(texts)] if ended else cuts[1:], strict=False):  # no words: no cuts
        if tokens[b] - tokens[a] < p.min_words:
            continue
        gap = starts[b] - ends[b - 1] if b < len(texts) else 0.0
        inner = [a]
        if b - a >= 12:
            for k in range(a + 5, b - 3):
                if k - inner[-1] >= 8 and done(a, k) and topic.search(" ".join(plain[k : min(b, k + 8)])):
                    inner.append(k)
        for x, y in zip(inner, [*inner[1:], b], strict=True):
            if len(inner) == 1 or y - x >= p.min_words:
                out.append((starts[x], ends[y - 1], " ".join(said[x:y]), gap if y == b else 0.45))
    return out, len(texts) if ended or not cuts else cuts[-1]


def split_thoughts(texts: list, starts: list, ends: list, p: Thoughts) -> list[tuple]:
    """(unit, start, end, text, gap_after) of a whole recording (see next_thoughts)."""
    return numbered(next_thoughts(texts, starts, ends, p, True)[0])


def thoughts(words: DataFrame, keys: list[str], order: list[str], text: str = "text", start: str = "start", end: str = "end", p: Thoughts | None = None, piece: int | None = None) -> DataFrame:
    """keys, unit, start, end, text and gap_after. piece: see in_order. A word without a start or end is left out, as no pause can be measured at it."""
    p = p or Thoughts()
    timed = words.withColumns({start: F.col(start).cast("double"), end: F.col(end).cast("double")}).where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return in_order(timed, keys, order, [text, start, end], lambda t, a, b, ended: next_thoughts(t, a, b, p, ended), "unit", "start double, end double, text string, gap_after double", piece)


def scored_thoughts(units: DataFrame, keys: list[str], p: Thoughts | None = None, piece: int | None = None) -> DataFrame:
    """units with complete, next_topic, shift (to the next unit) and gap: all that choosing windows needs, by windows (or, in pieces, a scan) and expressions."""
    from ..functions.text import content_tokens, with_content, with_topic_shift

    p = p or Thoughts()
    if piece is None:
        w = Window.partitionBy(*keys).orderBy("unit")
        rows = with_content(units).withColumns({"_next": F.lead("text").over(w), "_next_start": F.lead("start").over(w), "_next_content": F.lead("_content").over(w)})
    else:

        def with_next(*columns) -> tuple[list[tuple], int]:
            *columns, ended = columns
            own = list(zip(*columns, strict=True))
            after = [(r[3], r[1]) for r in own[1:]] + [(None, None)]  # text, start
            return [(*r, *a) for r, a in zip(own if ended else own[:-1], after, strict=False)], len(own) if ended else max(0, len(own) - 1)

        rows = in_order(units, keys, ["unit"], ["unit", "start", "end", "text", "gap_after"], with_next, None, "unit int, start double, end double, text string, gap_after double, _next string, _next_start double", piece)
        rows = with_content(rows).withColumn("_next_content", content_tokens(F.col("_next")))
    rows = rows.withColumn("gap", F.coalesce(F.nullif(F.col("gap_after"), F.lit(0.0)), F.col("_next_start") - F.col("end")))
    rows = with_topic_shift(rows, "_next", "_next_content", F.col("gap"), p.idea, p.scene, p.topic_start, p.continue_start)
    return rows.select(*units.columns, "gap", "complete", "next_topic", "shift")


def choose_windows(starts: list, ends: list, gaps: list, done: list, topics: list, shifts: list, duration: float, p: Thoughts) -> list[tuple]:
    """(window, start, end) of a whole recording (see next_windows)."""
    return numbered(next_windows(starts, ends, gaps, done, topics, shifts, duration, p, True)[0])


def next_windows(starts: list, ends: list, gaps: list, done: list, topics: list, shifts: list, duration: float, p: Thoughts, ended: bool) -> tuple[list[tuple], int]:
    """(start, end): runs of thoughts from shortest to longest, broken at the strongest signs of a new subject; and the first thought of a window that isn't decided yet."""
    out, i, n = [], 0, len(starts)

    def stops(a: float, j: int) -> bool:
        """Should the window from a end with thought j?"""
        size = min(duration, ends[j] + 0.12) - a
        if min(duration, ends[j + 1] + 0.12) - a > p.longest:
            return True
        if size < p.shortest:
            return False
        scene = gaps[j] >= p.scene
        if size < p.prefer:
            return scene or topics[j] and done[j]
        return bool(scene or done[j] and (gaps[j] >= 3.2 and shifts[j] >= 2.8 or topics[j] or size >= 120 and gaps[j] >= p.idea or size >= 155))

    while i < n:
        a = max(0.0, starts[i] - 0.08)
        j = i
        while j + 1 < n and not stops(a, j):
            j += 1
        if j + 1 == n and not ended:
            break
        b = min(duration, ends[j] + 0.12)
        if b - a > p.longest:
            fit = next((k for k in range(j, i, -1) if min(duration, ends[k] + 0.12) - a <= p.longest and done[k]), None)
            b = min(a + p.longest, duration) if fit is None else min(duration, ends[fit] + 0.12)
            j = j if fit is None else fit
        if p.shortest <= b - a <= p.longest:
            out.append((a, b))
        i = j + 1
    return out, i


def thought_windows(units: DataFrame, keys: list[str], durations: DataFrame, duration: str = "duration", p: Thoughts | None = None, piece: int | None = None) -> DataFrame:
    """keys, window, start and end: the shorts of each recording. piece: see in_order."""
    p = p or Thoughts()
    own = durations.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(duration).cast("double").alias("_duration"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    rows = scored_thoughts(units, keys, p, piece).join(own, same)
    number = lambda v, none: [none if x is None or x != x else x for x in v]

    def fn(a, b, g, c, t, s, d, ended):
        return next_windows(a, b, number(g, float("-inf")), c, t, number(s, 0.0), d[0] if d else 0.0, p, ended)

    return in_order(rows, keys, ["unit"], ["start", "end", "gap", "complete", "next_topic", "shift", "_duration"], fn, "window", "start double, end double", piece)


# -- boxes -----------------------------------------------------------------------------------------------------------


def box_ious(box, others: np.ndarray) -> np.ndarray:
    """Intersection over union of a box with each of others (rows x, y, w, h); 0 where the union is."""
    low, high = np.maximum(others[:, :2], box[:2]), np.minimum(others[:, :2] + others[:, 2:], np.add(box[:2], box[2:]))
    both = np.maximum(high - low, 0).prod(1)
    union = others[:, 2] * others[:, 3] + box[2] * box[3] - both
    return np.divide(both, union, out=np.zeros(len(others)), where=union != 0)


class BoxGrid:
    """Numbered boxes by the grid cells that they touch: boxes that overlap share one."""

    def __init__(self, cell: float):
        self.cell = max(1.0, cell)
        self.boxes = np.zeros((16, 4))
        self.spans: list[tuple[int, ...]] = []
        self.cells: dict[tuple[int, int], set[int]] = {}

    def span(self, box) -> tuple[int, ...]:
        x, y, w, h = box
        return tuple(int(v // self.cell) for v in (x, y, x + max(w, 0), y + max(h, 0)))

    @staticmethod
    def within(span: tuple[int, ...]) -> Iterable[tuple[int, int]]:
        return ((i, j) for i in range(span[0], span[2] + 1) for j in range(span[1], span[3] + 1))

    def first(self, box, threshold: float) -> int | None:
        """The lowest number of a box that overlaps this one by more than threshold."""
        near = np.array(sorted(set().union(*(self.cells.get(c, ()) for c in self.within(self.span(box))))), np.int64)
        over = near[box_ious(box, self.boxes[near]) > threshold] if len(near) else near
        return int(over[0]) if len(over) else None

    def put(self, box, number: int | None = None) -> None:
        """A new box, or a new place of an old one."""
        span = self.span(box)
        if number is None:
            number = len(self.spans)
            if number == len(self.boxes):
                self.boxes = np.concatenate([self.boxes, np.zeros_like(self.boxes)])
            self.spans.append(())
        if self.spans[number] != span:
            for c in self.within(self.spans[number]) if self.spans[number] else ():
                self.cells[c].discard(number)
            for c in self.within(span):
                self.cells.setdefault(c, set()).add(number)
            self.spans[number] = span
        self.boxes[number] = box


def cell_size(rects: list) -> float:
    """About a box's side, so that a box touches few cells and a cell few boxes; the largest boxes touch some hundred cells."""
    sides = np.array([max(r[2], r[3]) for r in rects] or [1.0], float)
    return max(float(np.median(sides)), float(sides.max()) / 16)


def merge_boxes(boxes: DataFrame, keys: list[str], number: str, box: str, threshold: float = 0.35) -> DataFrame:
    """keys and number of the boxes that stay: by falling area, those that overlap no box already kept by more than threshold (0 or more). Kept boxes are found by a grid."""

    def run(numbers: list, rects: list) -> Iterable[tuple]:
        kept = BoxGrid(cell_size(rects))
        for n, r in zip(numbers, rects, strict=True):
            if kept.first(r, threshold) is None:
                kept.put(r)
                yield (n,)

    ranked = boxes.withColumn("_area", -F.get(box, F.lit(2)) * F.get(box, F.lit(3)))
    return per_source(ranked, keys, ["_area", number], [number, box], run, f"{number} {boxes.schema[number].dataType.simpleString()}")


def cluster_boxes(boxes: DataFrame, keys: list[str], frame: str, number: str, box: str, threshold: float = 0.3) -> DataFrame:
    """keys, cluster (by hits, then area), box (mean so far, in whole pixels) and hits: each box joins the first cluster whose box it overlaps by more than threshold (0 or more).

    Clusters are found by a grid of their boxes, so a box meets only those near it, however many there are.
    """

    def run(rects: list) -> Iterable[tuple]:
        grid = BoxGrid(cell_size(rects))
        means: list[tuple[int, ...]] = []
        hits: list[int] = []
        for r in rects:
            own = tuple(int(v) for v in r)
            at = grid.first(own, threshold)
            if at is None:
                means.append(own)
                hits.append(1)
                grid.put(own)
            else:
                hits[at] += 1
                means[at] = tuple(m + (v - m) // hits[at] for m, v in zip(means[at], own, strict=True))
                grid.put(means[at], at)
        order = sorted(range(len(hits)), key=lambda k: (-hits[k], -means[k][2] * means[k][3], k))
        return [(n, list(means[k]), hits[k]) for n, k in enumerate(order)]

    return per_source(boxes, keys, [frame, number], [box], run, "cluster int, box array<long>, hits int")
