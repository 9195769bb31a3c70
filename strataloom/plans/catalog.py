"""Every query by name, and the SQL each is compared with. IDs in the comments are those of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import media, text
from ..operators import bands, compiling, greedy, intervals, layout, registry, rounds, tracking
from ..params import Captions
from ..shared import checkpointed
from . import proxies as P
from .proxies import BASE, BLOCKS, HOUR, RECTS, STREAMS, WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
U = ["user_id"]
DAY = 24 * HOUR


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# -- blocks and windows ------------------------------------------------------------------------------------------------

SPANS = f"""seg AS (SELECT user_id, i, s, e, max(i) OVER (PARTITION BY user_id) AS last FROM w),
    sj AS (SELECT a.user_id, a.i, a.s, min(j.i) AS j FROM seg a JOIN seg j ON a.user_id = j.user_id AND j.i >= a.i LEFT JOIN seg k ON k.user_id = j.user_id AND k.i = j.i + 1
           WHERE j.e - a.s >= {DAY} OR j.i = j.last OR k.e - a.s > {DAY * 5 // 4} GROUP BY ALL),
    step AS (SELECT sj.user_id, sj.i, sj.s, sj.j, e.e AS j_end, e.last, coalesce((SELECT min(k.i) FROM seg k WHERE k.user_id = sj.user_id AND k.i > sj.i AND k.s >= e.e - {8 * HOUR}), sj.j + 1) AS nxt
             FROM sj JOIN seg e ON e.user_id = sj.user_id AND e.i = sj.j),
    spans AS (SELECT user_id, i, s, j_end, j, last, nxt, 1 AS n FROM step WHERE i = 1
              UNION ALL SELECT t.user_id, t.i, t.s, t.j_end, t.j, t.last, t.nxt, p.n + 1 FROM spans p JOIN step t ON t.user_id = p.user_id AND t.i = p.nxt WHERE p.j < p.last)"""


def _windows(w: DataFrame) -> DataFrame:
    return greedy.snapped_windows(w, U, ["i"], "s", "e", length=DAY, overlap=8 * HOUR)


@query(f"WITH RECURSIVE {WORDS}, {SPANS} SELECT user_id, n AS \"window\", s AS start, j_end AS \"end\" FROM spans")
def snapped_windows(spark, sf):  # INT-02
    return _windows(P.words(spark, sf))


def _stats(w: DataFrame, *more, segments: DataFrame | None = None) -> DataFrame:
    spans = checkpointed(_windows(w if segments is None else segments).select("user_id", "window", F.col("start").alias("w0"), F.col("end").alias("w1")))  # read twice by the join
    hits = bands.band_join(w, spans, U, "s", "w0", "w1", DAY, before=10)
    speech = F.sum(F.greatest(F.lit(0), F.least("e", "w1") - F.col("s")))
    stats = hits.groupBy("user_id", "window", "w0", "w1").agg(F.count("*").alias("n_words"), F.min("i").alias("first_word"), F.max("i").alias("last_word"), speech.alias("speech_ms"), bands.ordered_text("i", "w").alias("text"), *more)
    seconds = F.greatest(F.col("w1") - F.col("w0"), F.lit(1)) / HOUR
    return stats.withColumn("density", media.density(F.col("n_words"), F.col("speech_ms") / HOUR, seconds))


STATS = f"""{WORDS}, {SPANS},
    stats AS (SELECT p.user_id, n AS "window", p.s AS w0, j_end AS w1, count(*) AS n_words, min(w.i) AS first_word, max(w.i) AS last_word,
              sum(greatest(0, least(w.e, j_end) - w.s))::BIGINT AS speech_ms, string_agg(w.w, ' ' ORDER BY w.i) AS text
              FROM spans p JOIN w ON w.user_id = p.user_id AND w.s >= p.s - 10 AND w.s < j_end GROUP BY ALL),
    dense AS (SELECT *, least(n_words / (greatest(w1 - w0, 1) / {HOUR}::DOUBLE) / 3.2::DOUBLE, 1.3::DOUBLE) * 45 + least((speech_ms / {HOUR}::DOUBLE) / (greatest(w1 - w0, 1) / {HOUR}::DOUBLE), 1.0::DOUBLE) * 45 AS density FROM stats)"""


@query(f"WITH RECURSIVE {STATS} SELECT * FROM dense")
def window_stats(spark, sf):  # JON-04 AGG-02 AGG-12 SCL-19
    return _stats(P.words(spark, sf))


@query(f"""WITH RECURSIVE {STATS}, {BLOCKS}, wb AS (SELECT w.user_id, w.i, coalesce(min(b.b), -1) AS b FROM w LEFT JOIN b ON w.user_id = b.user_id AND w.s >= b0 - 150 AND w.s < b1 + 50 GROUP BY ALL),
    inside AS (SELECT d.user_id, d."window", count(*) FILTER (WHERE wb.b >= 0) AS n_in_blocks FROM dense d JOIN wb ON wb.user_id = d.user_id AND wb.i BETWEEN first_word AND last_word GROUP BY ALL)
    SELECT d.*, n_in_blocks FROM dense d JOIN inside USING (user_id, "window") ORDER BY density DESC, user_id, "window" LIMIT 10""")
def ranked_windows(spark, sf):  # the flagship: JON-01 INT-02 AGG-02 SRT-01
    w = checkpointed(P.words(spark, sf))  # points, blocks and segments
    tagged = bands.first_block(w.select("user_id", "i", "s", "e", "w"), P.blocks(w), U, "s", "b0", "b1", "b", "in_b", DAY, before=150, after=50)
    return _stats(tagged, F.sum((F.col("in_b") >= 0).cast("long")).alias("n_in_blocks"), segments=w).orderBy(F.desc("density"), "user_id", "window").limit(10)  # a top-k report


@query(f"WITH {WORDS}, {BLOCKS} SELECT w.user_id, w.i, w.s, coalesce(min(b.b), -1) AS in_b FROM w LEFT JOIN b ON w.user_id = b.user_id AND w.s >= b0 - 150 AND w.s < b1 + 50 GROUP BY ALL")
def word_blocks(spark, sf):  # JON-01
    w = P.words(spark, sf)
    return bands.first_block(w.select("user_id", "i", "s"), P.blocks(w), U, "s", "b0", "b1", "b", "in_b", DAY, before=150, after=50)


@query(f"WITH {WORDS}, {BLOCKS} SELECT b.user_id, b.b, coalesce(string_agg(w.w, ' ' ORDER BY w.i), '') AS text FROM b LEFT JOIN w ON w.user_id = b.user_id AND w.s >= b0 - 150 AND w.s < b1 + 50 GROUP BY ALL")
def block_texts(spark, sf):  # JON-02 AGG-12
    w = P.words(spark, sf)
    return bands.block_text(w, P.blocks(w), U, "s", "i", "w", "b0", "b1", "b", DAY, before=150, after=50)


@query(f"WITH {WORDS}, {BLOCKS} SELECT b.*, coalesce((SELECT min(o.s) FROM w o WHERE o.user_id = b.user_id AND o.w = 'click' AND o.s BETWEEN b0 - 50 AND b1), b0) AS onset FROM b")
def block_onsets(spark, sf):  # JON-03
    w = P.words(spark, sf)
    return bands.first_onset(P.blocks(w), w.where("w = 'click'").select("user_id", F.col("s").alias("onset")), U, "b0", "b1", "onset", DAY, before=50)


def _silences(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    events = w.select("user_id", (F.col("s") - BASE).alias("at"), F.when(F.col("w").isin("click", "view", "purchase"), "s").otherwise("e").alias("kind"))
    return events, events.groupBy("user_id").agg((F.max("at") + HOUR).alias("duration"))


def _speech(w: DataFrame) -> DataFrame:
    events, durations = _silences(w)
    return intervals.speech_blocks(events, U, "at", "kind", durations, "duration", least=HOUR)


SPEECH = f"""{WORDS}, ev AS (SELECT user_id, s - {BASE} AS tm, CASE WHEN w IN ('click', 'view', 'purchase') THEN 's' ELSE 'e' END AS kind FROM w),
    du AS (SELECT user_id, max(tm) + {HOUR} AS duration FROM ev GROUP BY 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, kind) AS k FROM ev UNION ALL SELECT user_id, duration, 'z', (SELECT count(*) + 1 FROM ev WHERE ev.user_id = du.user_id) FROM du),
    fold AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS cur, false AS quiet, NULL::BIGINT AS start, NULL::BIGINT AS "end" FROM du
             UNION ALL SELECT f.user_id, o.k, CASE WHEN kind = 'e' THEN tm ELSE cur END, CASE kind WHEN 's' THEN true WHEN 'e' THEN false ELSE quiet END,
                              CASE WHEN kind <> 'e' AND NOT quiet AND tm - cur > {HOUR} THEN cur END, CASE WHEN kind <> 'e' AND NOT quiet AND tm - cur > {HOUR} THEN tm END
                       FROM fold f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
    sp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS block, start, "end" FROM fold WHERE start IS NOT NULL)"""


@query(f"WITH RECURSIVE {SPEECH} SELECT * FROM sp")
def speech_blocks(spark, sf):  # INT-01 SET-02 SRT-09
    return _speech(P.words(spark, sf))


@query(f'WITH RECURSIVE {SPEECH} SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY block) - "end" AS gap_after FROM sp')
def block_gaps(spark, sf):  # WIN-01
    return intervals.gap_after(_speech(P.words(spark, sf)), U)


@query(f"""WITH RECURSIVE {SPEECH}, f AS (SELECT user_id, count(*) AS n, sum("end" - start) AS speech, count(*) FILTER (WHERE "end" - start < {8 * HOUR}) AS tiny FROM sp GROUP BY 1)
    SELECT user_id, coalesce(n IS NULL OR speech > duration * 0.4::DOUBLE OR (n > 10 AND tiny > n * 0.2::DOUBLE), true) AS degenerate FROM du LEFT JOIN f USING (user_id)""")
def degenerate_maps(spark, sf):  # FLT-13
    w = P.words(spark, sf)
    return intervals.degenerate(_speech(w), U, _silences(w)[1], "duration", most_speech=0.4, tiny=8 * HOUR, tiny_share=0.2)


@query(f"""WITH RECURSIVE {SPEECH}, f AS (SELECT user_id, count(*) AS n, sum("end" - start) AS speech, count(*) FILTER (WHERE "end" - start < {8 * HOUR}) AS tiny FROM sp GROUP BY 1),
    v AS (SELECT user_id, coalesce(n IS NULL OR speech > duration * 0.4::DOUBLE OR (n > 10 AND tiny > n * 0.2::DOUBLE), true) AS bad FROM du LEFT JOIN f USING (user_id)), {BLOCKS}
    SELECT user_id, block, start, "end", false AS rescued FROM sp JOIN v USING (user_id) WHERE NOT bad
    UNION ALL SELECT user_id, b, b0 - {BASE}, b1 - {BASE}, true FROM b JOIN v USING (user_id) WHERE bad""")
def rescued_maps(spark, sf):  # FLT-14
    w = P.words(spark, sf)
    other = P.blocks(w).select("user_id", F.col("b").cast("int").alias("block"), (F.col("b0") - BASE).alias("start"), (F.col("b1") - BASE).alias("end"))
    return intervals.choose_map(_speech(w), other, degenerate_maps(spark, sf), U)


@query(f"""WITH {WORDS}, v AS (SELECT user_id, list_sort(list(-value)) AS v FROM w GROUP BY 1), p AS (SELECT user_id, len(v) AS n, v[1 + floor(len(v) * 0.9::DOUBLE)::INT] AS hi, v[1 + floor(len(v) * 0.1::DOUBLE)::INT] AS lo FROM v),
    o AS (SELECT *, greatest(hi - 22, lo + 10) AS o FROM p)
    SELECT user_id, CASE WHEN n < 20 THEN -30 ELSE greatest(hi - 14, o + 6) END AS in_db, CASE WHEN n < 20 THEN -38 ELSE o END AS out_db FROM o""")
def calibrated_thresholds(spark, sf):  # AGG-06b SCL-25
    return intervals.thresholds(P.words(spark, sf).select("user_id", (-F.col("value")).alias("level")), U, "level")


def _ranges(w: DataFrame) -> DataFrame:
    return w.where("w = 'signup'").select("user_id", F.col("event_id").alias("r"), F.col("s").alias("t0"), F.col("e").alias("t1"))


GAPS = f"""{WORDS}, {BLOCKS}, rg AS (SELECT user_id, event_id AS r, s AS t0, e AS t1 FROM w WHERE w = 'signup'),
    c AS (SELECT rg.user_id, r, t0, t1, greatest(b0, t0) AS b0, least(b1, t1) AS b1 FROM rg JOIN b ON b.user_id = rg.user_id AND b1 > t0 AND b0 < t1 UNION ALL SELECT user_id, r, t0, t1, t1, t1 FROM rg),
    m AS (SELECT *, coalesce(max(b1) OVER (PARTITION BY user_id, r ORDER BY b0, b1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t0) AS cur FROM c),
    gp AS (SELECT DISTINCT user_id, r, cur + 600000 AS start, b0 - 600000 AS "end" FROM m WHERE b0 - cur >= {HOUR} + 1200000)"""


def _gaps(w: DataFrame) -> DataFrame:
    return intervals.gaps(_ranges(w), P.blocks(w).select("user_id", F.col("b0").alias("start"), F.col("b1").alias("end")), U, "r", DAY, least=HOUR, margin=600000)


@query(f"WITH {GAPS} SELECT * FROM gp")
def range_gaps(spark, sf):  # INT-03 JON-09 WIN-06
    return _gaps(P.words(spark, sf))


@query(f"""WITH {GAPS}, g AS (SELECT user_id, sum("end" - start)::BIGINT AS total, sum(CASE WHEN r % 3 <> 0 THEN "end" - start END)::BIGINT AS known, sum(CASE WHEN r % 3 <> 0 THEN ("end" - start) * (-20 - r % 40) END)::BIGINT AS weighted FROM gp GROUP BY 1),
    src AS (SELECT DISTINCT user_id, user_id % 7 = 0 AS rescued FROM w)
    SELECT user_id, coalesce(total, 0) AS total, weighted / known::DOUBLE AS mean_db, CASE WHEN (coalesce(total, 0) >= {HOUR} AND coalesce(weighted / known::DOUBLE > -38, false)) OR rescued THEN 'skip' ELSE 'ok' END AS bed FROM src LEFT JOIN g USING (user_id)""")
def bed_verdicts(spark, sf):  # AGG-04 AGG-13
    w = P.words(spark, sf)
    levels = _gaps(w).withColumn("db", F.when(F.col("r") % 3 != 0, -20 - F.col("r") % 40))
    return intervals.bed_verdict(levels, w.select("user_id", (F.col("user_id") % 7 == 0).alias("rescued")).distinct(), U, evidence=HOUR)


@query(f"""WITH RECURSIVE {WORDS}, raw AS (SELECT user_id, i, CASE WHEN event_id % 5 NOT IN (0, 1) THEN s END AS s, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 1 THEN e END AS e, s - 1000 AS seg FROM w),
    x AS (SELECT *, min(s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM raw),
    f AS (SELECT user_id, i, coalesce(s, seg) AS s, coalesce(e, CASE WHEN nxt IS NOT NULL THEN least(nxt, coalesce(s, seg) + 500000) ELSE coalesce(s, seg) + 300000 END) AS e FROM x WHERE i = 1
          UNION ALL SELECT x.user_id, x.i, coalesce(x.s, f.e), coalesce(x.e, CASE WHEN nxt IS NOT NULL THEN least(nxt, coalesce(x.s, f.e) + 500000) ELSE coalesce(x.s, f.e) + 300000 END) FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
    SELECT * FROM (SELECT user_id, i, s, min(e) AS e FROM f GROUP BY ALL)""")
def imputed_times(spark, sf):  # WIN-03
    w = P.words(spark, sf)
    first = Window.partitionBy("user_id")
    raw = w.select("user_id", "i", F.when(~(F.col("event_id") % 5).isin(0, 1), F.col("s")).alias("s"), F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 5 != 1), F.col("e")).alias("e"), (F.col("s") - 1000).alias("seg_start"))
    return intervals.impute_times(raw, U, "i", cap=500000, last_cap=300000).drop("seg_start")


# -- greedy ------------------------------------------------------------------------------------------------------------

SPACED = f"""{WORDS}, nx AS MATERIALIZED (SELECT a.user_id, a.s, min(b.s) AS nxt FROM w a LEFT JOIN w b ON b.user_id = a.user_id AND b.s >= a.s + {3 * DAY} GROUP BY ALL),
    k AS (SELECT user_id, min(s) AS s FROM w GROUP BY 1 UNION ALL SELECT k.user_id, nxt FROM k JOIN nx USING (user_id, s) WHERE nxt IS NOT NULL)"""


@query(f"WITH RECURSIVE {SPACED} SELECT * FROM k")
def spaced_events(spark, sf):  # INT-06
    return greedy.minimum_spacing(P.words(spark, sf), U, "s", 3 * DAY)


@query(f"""WITH RECURSIVE {SPACED}, o AS (SELECT user_id, 0::BIGINT AS r, {BASE} AS a, {BASE} + 40 * {DAY}::BIGINT AS b FROM (SELECT DISTINCT user_id FROM w)), p AS (SELECT user_id, r, a AS tm FROM o UNION ALL SELECT user_id, r, b FROM o UNION ALL SELECT user_id, 0, s FROM k)
    SELECT * FROM (SELECT user_id, r, tm AS in_frame, lead(tm) OVER (PARTITION BY user_id ORDER BY tm) AS out_frame FROM p) WHERE out_frame IS NOT NULL""")
def tiled_regions(spark, sf):  # INT-07
    w = P.words(spark, sf)
    ranges = w.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("r"), F.lit(BASE).alias("in_frame"), F.lit(BASE + 40 * DAY).alias("out_frame"))
    cuts = greedy.minimum_spacing(w, U, "s", 3 * DAY).select("user_id", F.lit(0).cast("long").alias("r"), F.col("s").alias("cut"))
    return intervals.tile(ranges, cuts, U, "r")


SUPPRESSED = f"""WITH RECURSIVE {WORDS}, o AS (SELECT user_id, event_id, s, s + {6 * HOUR} AS e, row_number() OVER (PARTITION BY user_id ORDER BY -floor(value * 100), event_id) AS k FROM w),
    f AS (SELECT user_id, k, [{{'n': event_id, 'a': s, 'b': e}}] AS kept, event_id AS n, NULL::BIGINT AS winner FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.k, CASE WHEN len(list_filter(kept, lambda x: x.a <= o.e AND o.s <= x.b)) = 0 THEN list_append(kept, {{'n': o.event_id, 'a': o.s, 'b': o.e}}) ELSE kept END, o.event_id, list_filter(kept, lambda x: x.a <= o.e AND o.s <= x.b)[1].n
                    FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, n AS event_id, winner FROM f"""


@query(SUPPRESSED)
def suppressed_overlaps(spark, sf):  # INT-05 SRT-03
    w = P.words(spark, sf).select("user_id", "event_id", F.floor(F.col("value") * 100).alias("score"), F.col("s").alias("a"), (F.col("s") + 6 * HOUR).alias("b"))
    return greedy.suppress_overlaps(w, U, "score", "event_id", "a", "b").select("user_id", "event_id", "winner")


CUES = f"""{WORDS}, n AS (SELECT user_id, i, CASE WHEN event_id % 4 = 0 THEN w || '.' WHEN event_id % 4 = 1 THEN 'the' ELSE w END AS t, s, e, lead(s) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM w)"""


def _said(w: DataFrame) -> DataFrame:
    return w.withColumn("t", F.when(F.col("event_id") % 4 == 0, F.concat("w", F.lit("."))).when(F.col("event_id") % 4 == 1, "the").otherwise(F.col("w")))


CAPTIONS = f"""WITH RECURSIVE {CUES},
    f AS (SELECT user_id, i, s AS a, e AS b, nxt, t, 1 AS k, t AS txt FROM n WHERE i = 1
          UNION ALL SELECT n.user_id, n.i, CASE WHEN brk THEN n.s ELSE g.a END, n.e, n.nxt, n.t, CASE WHEN brk THEN 1 ELSE g.k + 1 END, CASE WHEN brk THEN n.t ELSE g.txt || ' ' || n.t END
                    FROM (SELECT *, k >= CASE WHEN t = 'the' THEN 10 ELSE 7 END OR b - a >= {2 * DAY} OR nxt - b > {12 * HOUR} OR (t LIKE '%.' AND k >= 3) AS brk FROM f) g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1),
    c AS (SELECT *, k >= CASE WHEN t = 'the' THEN 10 ELSE 7 END OR b - a >= {2 * DAY} OR nxt IS NULL OR nxt - b > {12 * HOUR} OR (t LIKE '%.' AND k >= 3) AS brk FROM f),
    d AS (SELECT user_id, i, a AS start, least(CASE WHEN b - a < {HOUR} THEN a + {HOUR} ELSE b END, coalesce(nxt, 9000000000000000)) AS "end", txt FROM c WHERE brk)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i)::INT AS cue, start, "end", txt AS text FROM d WHERE "end" > start"""


@query(CAPTIONS)
def caption_cues(spark, sf):  # INT-10 SCL-08
    return greedy.build_cues(_said(P.words(spark, sf)), U, ["i"], "t", "s", "e", Captions(max_seconds=2 * DAY, pause=12 * HOUR, min_seconds=HOUR))


@query(f"""WITH RECURSIVE {CUES},
    f AS (SELECT user_id, i, s AS a, e AS b, nxt, t, 1 AS k, t AS txt FROM n WHERE i = 1
          UNION ALL SELECT n.user_id, n.i, CASE WHEN brk THEN n.s ELSE g.a END, n.e, n.nxt, n.t, CASE WHEN brk THEN 1 ELSE g.k + 1 END, CASE WHEN brk THEN n.t ELSE g.txt || ' ' || n.t END
                    FROM (SELECT *, k >= 3 OR b - a >= {DAY} OR t LIKE '%.' AS brk FROM f) g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i)::INT AS cue, lead(a) OVER (PARTITION BY user_id ORDER BY i) AS after FROM f WHERE k >= 3 OR b - a >= {DAY} OR t LIKE '%.' OR nxt IS NULL),
    d AS (SELECT *, CASE WHEN b <= a THEN a + 450 ELSE b END AS own FROM c)
    SELECT user_id, cue, a AS start, CASE WHEN after IS NULL THEN own ELSE least(after, greatest(own, a + 350)) END AS "end", txt AS text FROM d""")
def short_cues(spark, sf):  # INT-11 WIN-08
    return greedy.short_cues(_said(P.words(spark, sf)), U, ["i"], "t", "s", "e", seconds=DAY, blank=450, shown=350)


# -- recordings too long for one task: all events of a type are one ------------------------------------------------------

PIECE = 2_000


@query(CAPTIONS.replace(WORDS, STREAMS))
def long_cues(spark, sf):  # INT-10, scanned in pieces
    return greedy.build_cues(_said(P.streams(spark, sf)), U, ["i"], "t", "s", "e", Captions(max_seconds=2 * DAY, pause=12 * HOUR, min_seconds=HOUR), piece=PIECE)


@query(f"WITH RECURSIVE {STREAMS}, {SPANS} SELECT user_id, n AS \"window\", s AS start, j_end AS \"end\" FROM spans")
def long_windows(spark, sf):  # INT-02, scanned in pieces
    return greedy.snapped_windows(P.streams(spark, sf), U, ["i"], "s", "e", length=DAY, overlap=8 * HOUR, piece=PIECE)


@query(f"WITH RECURSIVE {SPACED.replace(WORDS, STREAMS).replace(str(3 * DAY), str(2 * HOUR))} SELECT * FROM k")
def long_spacing(spark, sf):  # INT-06, by pointer doubling
    return greedy.minimum_spacing(P.streams(spark, sf), U, "s", 2 * HOUR, long=True)


@query(SUPPRESSED.replace(WORDS, STREAMS).replace(f"s + {6 * HOUR}", f"s + {HOUR // 2}"))
def long_suppression(spark, sf):  # INT-05 SRT-03, by rounds
    w = P.streams(spark, sf).select("user_id", "event_id", F.floor(F.col("value") * 100).alias("score"), F.col("s").alias("a"), (F.col("s") + HOUR // 2).alias("b"))
    return rounds.suppress_by_rounds(w, U, "score", "event_id", "a", "b", HOUR).select("user_id", "event_id", "winner")


@query()
def thought_units(spark, sf):  # INT-12 INT-13
    return greedy.thoughts(P.spoken(spark, sf), ["conv_id"], ["i"])


@query()
def thought_windows(spark, sf):  # INT-14 FLT-11 FLT-12
    return greedy.thought_windows(greedy.thoughts(P.spoken(spark, sf), ["conv_id"], ["i"]), ["conv_id"], P.spoken_until(spark, sf))


# -- joins -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {WORDS}, c AS (SELECT a.event_id, abs(a.s - b.s) AS d, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.s - b.s), b.event_id) AS k
    FROM w a JOIN w b ON a.user_id = b.user_id AND a.w = 'error' AND b.w = 'click' AND abs(a.s - b.s) <= {12 * HOUR})
    SELECT w.user_id, w.event_id, w.s, c.other, c.d AS distance FROM w LEFT JOIN c ON c.event_id = w.event_id AND k = 1 WHERE w.w = 'error'""")
def nearest_clicks(spark, sf):  # JON-10
    w = P.words(spark, sf)
    clicks = w.where("w = 'click'").select("user_id", "s", "event_id", F.col("event_id").alias("other"))
    return bands.nearest(w.where("w = 'error'").select("user_id", "event_id", "s"), clicks, U, "s", "s", 12 * HOUR, "event_id", "other")


@query(f"""WITH {WORDS}, rg AS (SELECT user_id, event_id AS r, s AS t0, e AS t1 FROM w WHERE w = 'signup'), pu AS (SELECT user_id, event_id AS p, s AS p0, e AS p1 FROM w WHERE w = 'purchase')
    SELECT rg.user_id, r, t0, t1, p, p0, p1 FROM rg JOIN pu ON rg.user_id = pu.user_id AND p1 > t0 AND p0 < t1""")
def overlapping_spans(spark, sf):  # JON-12
    w = P.words(spark, sf)
    return bands.overlap_join(_ranges(w), w.where("w = 'purchase'").select("user_id", F.col("event_id").alias("p"), F.col("s").alias("p0"), F.col("e").alias("p1")), U, ("t0", "t1"), ("p0", "p1"), DAY)


@query(f"""WITH {WORDS}, rg AS (SELECT user_id, s AS t0, e AS t1 FROM w WHERE w = 'signup')
    SELECT user_id, i, s, e FROM w WHERE EXISTS (SELECT 1 FROM rg WHERE rg.user_id = w.user_id AND w.s >= t0 - 50 AND w.s <= t1)""")
def contained_words(spark, sf):  # JON-11
    w = P.words(spark, sf)
    return bands.band_join(w.select("user_id", "i", "s", "e"), _ranges(w), U, "s", "t0", "t1", DAY, before=50, closed=True, how="left_semi")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_orders(spark, sf):  # AGG-07 SRT-04
    o = P.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return bands.last_wins(o, ["o_custkey"], "at").drop("at")


@query(f"""WITH {WORDS}, p AS (SELECT user_id, s // {DAY} AS d, w AS k, max(event_id) AS last FROM w GROUP BY ALL)
    SELECT a.event_id, p.last, p.last IS NULL AS unmatched FROM w a LEFT JOIN p ON p.user_id = a.user_id AND p.d = a.s // {DAY} AND p.k = 'view' AND a.w = 'click' WHERE a.w = 'click'""")
def composite_lookup(spark, sf):  # JON-08
    w = P.words(spark, sf).withColumn("d", F.floor(F.col("s") / DAY).cast("long"))
    last = bands.last_wins(w.where("w = 'view'").select("user_id", "d", F.col("event_id").alias("last"), F.col("event_id").alias("o")), ["user_id", "d"], "o").drop("o")
    return w.where("w = 'click'").join(last, ["user_id", "d"], "left").select("event_id", "last", F.col("last").isNull().alias("unmatched"))


@query(f"""WITH {WORDS}, a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM w WHERE w = 'view'), b AS (SELECT user_id, event_id AS best, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM w WHERE w = 'click')
    SELECT a.user_id, event_id, best FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.k = b.k""")
def zipped_by_position(spark, sf):  # JON-14
    w = P.words(spark, sf)
    b = w.where("w = 'click'").select("user_id", F.col("event_id").alias("best"), F.col("value").alias("v"))
    return bands.zip_by_position(w.where("w = 'view'").select("user_id", "event_id", "s"), b, U, [F.col("s"), F.col("event_id")], [F.desc("v"), F.col("best")]).select("user_id", "event_id", "best")


@query(f"""WITH {WORDS}, {BLOCKS}, f AS (SELECT w.user_id, w.event_id, min(b.b) AS hit FROM w LEFT JOIN b ON b.user_id = w.user_id AND w.s >= b0 AND w.s < b1 GROUP BY ALL), l AS (SELECT user_id, max(b) AS last FROM b GROUP BY 1)
    SELECT user_id, event_id, coalesce(hit, last) AS b FROM f LEFT JOIN l USING (user_id)""")
def track_segments(spark, sf):  # JON-16
    w = P.words(spark, sf)
    track = P.blocks(w).withColumn("o", F.col("b"))
    return bands.as_of_segment(w.select("user_id", "event_id", "s"), track, U, "s", "b0", "b1", "b", "o", DAY).select("user_id", "event_id", "b")


@query(f"""WITH {WORDS}, rg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r, i AS a, least(i + 4, max(i) OVER (PARTITION BY user_id)) AS b FROM w)
    SELECT rg.user_id, r, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM rg JOIN w ON w.user_id = rg.user_id AND w.i BETWEEN a AND b GROUP BY ALL""")
def range_texts(spark, sf):  # JON-07
    w = P.words(spark, sf)
    last = F.max("i").over(Window.partitionBy("user_id"))
    ranges = w.select("user_id", F.col("i").alias("r"), F.col("i").alias("start_word"), F.least(F.col("i") + 4, last).alias("end_word"))
    return compiling.range_text(ranges, w, U, ["r"])


# -- ordered rows ------------------------------------------------------------------------------------------------------


@query(f"WITH {WORDS} SELECT user_id, i, coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS timeline_start, sum(e - s) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS timeline_end FROM w")
def timeline_offsets(spark, sf):  # WIN-04 WIN-05 AGG-15
    return intervals.running_offsets(P.words(spark, sf), U, "i", F.col("e") - F.col("s")).select("user_id", "i", "timeline_start", "timeline_end")


@query(f"""WITH {WORDS}, m AS (SELECT *, sum(CASE WHEN w IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY i) AS p FROM w))
    SELECT user_id, min(w) AS w, min(s) AS s, max(e) AS e FROM m GROUP BY user_id, g""")
def merged_runs(spark, sf):  # WIN-09
    return intervals.merge_equal(P.words(spark, sf), U, "i", "w", "s", "e")


@query(f"WITH {WORDS} SELECT user_id, i, w FROM (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY i) AS p FROM w) WHERE w IS DISTINCT FROM p")
def changed_values(spark, sf):  # WIN-10
    return intervals.drop_repeats(P.words(spark, sf).select("user_id", "i", "w"), U, "i", "w")


@query(f"WITH {WORDS} SELECT user_id, i, s - lag(e) OVER (PARTITION BY user_id ORDER BY i) AS gap, lead(s) OVER (PARTITION BY user_id ORDER BY i) AS next_start FROM w")
def word_gaps(spark, sf):  # WIN-02 WIN-07
    w = Window.partitionBy("user_id").orderBy("i")
    return P.words(spark, sf).select("user_id", "i", (F.col("s") - F.lag("e").over(w)).alias("gap"), F.lead("s").over(w).alias("next_start"))


@query(f"""WITH {WORDS}, x AS (SELECT user_id, i, (s - {BASE}) / 1000.0::DOUBLE AS a, (e - {BASE}) / 1000.0::DOUBLE AS b FROM w), y AS (SELECT *, greatest(0, floor(a * 30)::BIGINT) AS start_f, lead(a) OVER o AS na FROM x WINDOW o AS (PARTITION BY user_id ORDER BY i)),
    z AS (SELECT *, greatest(start_f + 1, floor(b * 30 + 0.5::DOUBLE)::BIGINT) AS end_f, lead(start_f) OVER (PARTITION BY user_id ORDER BY i) AS nf FROM y)
    SELECT user_id, i, start_f, end_f, CASE WHEN coalesce(na - b < 1.0, false) THEN greatest(start_f + 1, nf) ELSE least(end_f + 6, coalesce(nf, end_f + 6)) END AS visible_f FROM z""")
def caption_holds(spark, sf):  # WIN-11
    w = P.words(spark, sf).select("user_id", "i", ((F.col("s") - BASE) / 1000.0).alias("start"), ((F.col("e") - BASE) / 1000.0).alias("end"))
    return intervals.caption_holds(w, U, "i", 30.0).select("user_id", "i", "start_f", "end_f", "visible_f")


@query(f"WITH {WORDS}, v AS (SELECT user_id, list_sort(list(value)) AS v FROM w GROUP BY 1) SELECT user_id, v[1 + round_even((len(v) - 1) * 0.9::DOUBLE, 0)::INT] AS p90 FROM v")
def nearest_rank_p90(spark, sf):  # AGG-06
    return intervals.percentile(P.words(spark, sf), U, "value", 0.9, "p90")


@query(f"""WITH {WORDS}, x AS (SELECT user_id, i, value, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM w), m AS (SELECT a.user_id, a.i, list_sort(list(b.value)) AS v FROM x a JOIN x b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 4 AND a.k GROUP BY ALL)
    SELECT user_id, i, CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) * 0.5::DOUBLE END AS med FROM m""")
def rolling_medians(spark, sf):  # WIN-12
    v = F.array_sort(F.collect_list("value").over(Window.partitionBy("user_id").orderBy("i").rowsBetween(-4, 0)))
    rows = P.words(spark, sf).select("user_id", "i", v.alias("v")).withColumn("h", F.floor(F.size("v") / 2).cast("int"))
    return rows.select("user_id", "i", F.when(F.size("v") % 2 == 1, F.get("v", F.col("h"))).otherwise((F.get("v", F.col("h") - 1) + F.get("v", F.col("h"))) * 0.5).alias("med"))


@query(f"""WITH {WORDS}, sh AS (SELECT user_id, event_id AS short, s AS a, e AS b FROM w WHERE w = 'signup'), cu AS (SELECT user_id, s AS c0, e AS c1, i FROM w WHERE w = 'click'),
    l AS (SELECT sh.user_id, short, b - a AS len, greatest(0, c0 - a) AS x, least(b - a, greatest(greatest(0, c0 - a) + 180, c1 - a)) AS y, c0, c1, i FROM sh JOIN cu ON sh.user_id = cu.user_id AND c1 > a AND c0 < b),
    o AS (SELECT *, coalesce(lag(y) OVER q, 0) AS p, lead(y) OVER q IS NULL AS final FROM l WHERE y > 0 AND x < len WINDOW q AS (PARTITION BY user_id, short ORDER BY c0, c1, i)),
    s AS (SELECT user_id, short, x AS start, y AS "end", i::VARCHAR AS text FROM o UNION ALL SELECT user_id, short, p, x, NULL FROM o WHERE x > p UNION ALL SELECT user_id, short, y, len, NULL FROM o WHERE final AND y < len)
    SELECT user_id, short, start::DOUBLE AS start, "end"::DOUBLE AS "end", text FROM s WHERE "end" - start > 20""")
def local_cues(spark, sf):  # INT-08
    w = P.words(spark, sf)
    cues = w.where("w = 'click'").select("user_id", F.col("s").cast("double").alias("start"), F.col("e").cast("double").alias("end"), F.col("i").cast("string").alias("text"))
    shorts = w.where("w = 'signup'").select("user_id", F.col("event_id").alias("short"), F.col("s").cast("double").alias("a"), F.col("e").cast("double").alias("b"))
    return intervals.local_cues(cues, shorts, U, float(DAY), shortest=180.0, least=20.0)


# -- compiling ---------------------------------------------------------------------------------------------------------


def _transcript(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """words, blocks, sources and candidates from conversations: a candidate for each turn, from its first word, of one or two segments."""
    w = P.spoken(spark, sf).select("conv_id", "turn", "opens", (F.col("i") + 1).alias("i"), F.col("text").alias("w"), F.col("start").alias("s"), F.col("end").alias("e"))
    b = F.floor((F.col("i") - 1) / 25).cast("long")
    w = checkpointed(w.withColumn("b", F.when(F.col("i") % 50 == 0, F.lit(-1).cast("long")).otherwise(b)))  # each stage reads words, blocks and candidates again
    blocks = checkpointed(w.where("b >= 0").groupBy("conv_id", "b").agg(F.min("s").alias("onset"), F.max("e").alias("end")).withColumnRenamed("b", "i"))
    sources = w.select("conv_id").distinct().withColumn("fps", F.lit(30.0))
    r = lambda a, z: F.struct(a.cast("long").alias("start_word"), z.cast("long").alias("end_word"))
    i = F.col("i")
    opening = F.concat_ws(" ", F.col("w"), F.lead("w").over(Window.partitionBy("conv_id").orderBy("i")), F.lead("w", 2).over(Window.partitionBy("conv_id").orderBy("i")))
    t = F.col("turn")
    cands = w.withColumn("o", opening).where("opens").select(
        "conv_id", t.cast("int").alias("n"), F.format_string("clip %d", i).alias("title"), F.when(t % 3 == 0, "teaser").otherwise("natural").alias("hook_mode"), F.when(t % 4 == 3, "nothing like it").otherwise(F.col("o")).alias("hook_quote"),
        F.when(t % 3 == 0, r(i + 5, i + 9)).alias("teaser"), F.when(t % 7 == 1, F.array(r(i, i + 40))).when(t % 7 == 2, F.array(r(i, i + 30), r(i + 25, i + 60))).otherwise(F.array(r(i, i + 30), r(i + 31, i + 60))).alias("segments"),
        F.create_map(F.lit("hook"), (i % 25).cast("int"), F.lit("value"), (i % 11).cast("int")).alias("scores"),
    )
    return w, blocks, sources, checkpointed(cands)


def _manifest(spark, sf) -> DataFrame:
    w, blocks, sources, cands = _transcript(spark, sf)
    return compiling.compile_candidates(cands, w, blocks, sources, ["conv_id"])[0]


@query()
def compiled_candidates(spark, sf):  # FLT-01..09 AGG-01 AGG-03 AGG-08 WIN-15 INT-04 JON-06 SET-05 SRT-02
    lines = lambda c: F.array_join(c, "; ").alias(c)
    return _manifest(spark, sf).select("conv_id", "n", "title", "status", lines("reasons"), lines("warnings"), "total_score", "core_frames", "teaser_frames", "first_word", "last_word")


@query()
def compiled_captions(spark, sf):  # JON-05 INT-09 SET-01 FLT-10
    w, blocks, sources, cands = _transcript(spark, sf)
    cuts = compiling.compile_candidates(cands, w, blocks, sources, ["conv_id"])[1]
    return compiling.caption_words(cuts.withColumn("fps", F.lit(30.0)), w, ["conv_id"], ["n"])


@query(f"""WITH {WORDS}, x AS (SELECT user_id, i, s // 60000 AS a, greatest(e // 60000, s // 60000 + 1) AS b FROM w), y AS (SELECT *, greatest(a, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY i), a)) AS p FROM x),
    z AS (SELECT *, p > a AND b - p < 3 AS collapsed FROM y) SELECT user_id, i, p AS in_frame, b AS out_frame, p - a AS clamped, collapsed, max(collapsed::INT) OVER (PARTITION BY user_id ORDER BY i) = 1 AS dropped FROM z""")
def clamped_joins(spark, sf):  # WIN-15
    m = lambda c: F.floor(F.col(c) / 60000).cast("long")
    return compiling.clamp_joins(P.words(spark, sf).select("user_id", "i", m("s").alias("in_frame"), F.greatest(m("e"), m("s") + 1).alias("out_frame")), U, "i")


@query(f"WITH {WORDS}, {BLOCKS}, wb AS (SELECT w.user_id, w.i, min(b.b) AS b FROM w JOIN b ON w.user_id = b.user_id AND w.s >= b0 AND w.s < b1 GROUP BY ALL) SELECT user_id, b, min(i) AS first_word, max(i) AS last_word FROM wb GROUP BY ALL")
def block_edges(spark, sf):  # AGG-01
    w = P.words(spark, sf)
    tagged = bands.first_block(w.select("user_id", "i", "s"), P.blocks(w), U, "s", "b0", "b1", "b", "_b", DAY, before=0, after=0)
    return compiling.block_edges(tagged.withColumnRenamed("_b", "b"), U)


@query("""WITH t AS (SELECT conv_id, turn, string_split_regex(regexp_replace(lower(text), '[^a-z0-9'' ]', ' ', 'g'), ' +') AS v FROM conversations), u AS (SELECT conv_id, turn, list_filter(v, lambda x: x <> '') AS v FROM t)
    SELECT conv_id, turn, len(v) AS n, array_to_string(v[1:3], ' ') AS opening, coalesce(v[1] IN ('and','but','so','because','or','that','which','if','when','while','though','since','as','for','also','plus','then','actually','basically','like','really','just','maybe','cause','uh','um','yeah','okay','ok','right','well'), false) AS banned FROM u""")
def openings(spark, sf):  # SCL-01 FLT-05 FLT-06
    from ..params import BANNED_OPENERS

    v = P.table(spark, sf, "conversations").select("conv_id", "turn", text.norm_words(F.col("text")).alias("v"))
    return v.select("conv_id", "turn", F.size("v").cast("long").alias("n"), F.array_join(F.slice("v", 1, 3), " ").alias("opening"), F.coalesce(F.array_contains(text.strings(BANNED_OPENERS), F.get("v", F.lit(0))), F.lit(False)).alias("banned"))


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _topic_sql() -> str:
    from ..params import CONTINUE_START, INCOMPLETE_TAILS, MORE_STOPWORDS, TOPIC_START

    pattern = lambda p: p.replace("(?i)", "").replace("'", "''")
    return rf"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS v FROM conversations),
        u AS (SELECT *, list_filter(list_distinct(list_transform(v, lambda x: regexp_replace(lower(x), '[^a-z0-9'']+', '', 'g'))), lambda x: length(x) > 2 AND NOT list_contains([{_list(dict.fromkeys(INCOMPLETE_TAILS + MORE_STOPWORDS))}], x)) AS c,
              CASE WHEN len(v) = 0 THEN false WHEN regexp_matches(v[-1], '[.?!]$') THEN true ELSE len(v) >= 6 AND NOT list_contains([{_list(INCOMPLETE_TAILS)}], regexp_replace(lower(v[-1]), '[^a-z0-9'']+', '', 'g')) END AS done FROM t),
        p AS (SELECT *, lead(text) OVER o AS nt, lead(c) OVER o AS nc FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
        j AS (SELECT *, CASE WHEN len(c) = 0 OR len(nc) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(c, nc)) / len(list_distinct(list_concat(c, nc)))::DOUBLE END AS sim FROM p WHERE nt IS NOT NULL)
        SELECT conv_id, turn, done AS complete, (CASE WHEN turn % 3 = 0 THEN 2.2::DOUBLE ELSE 0 END) + (CASE WHEN turn % 9 = 0 THEN 2.5::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(nt, '{pattern(TOPIC_START)}', 'i') THEN 2.4::DOUBLE ELSE 0 END)
               - (CASE WHEN regexp_matches(nt, '{pattern(CONTINUE_START)}', 'i') THEN 2.2::DOUBLE ELSE 0 END) + (CASE WHEN sim < 0.08 AND len(c) > 0 AND len(nc) > 0 THEN 2.0::DOUBLE WHEN sim < 0.16 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN done THEN 0.6::DOUBLE ELSE -2.8::DOUBLE END) AS shift FROM j"""


@query(_topic_sql())
def topic_shifts(spark, sf):  # SCL-02..07 SET-03 SET-04
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = text.with_content(P.table(spark, sf, "conversations").select("conv_id", "turn", "text")).withColumns({"nt": F.lead("text").over(w), "nc": F.lead("_content").over(w)}).where("nt IS NOT NULL")
    gap = F.when(F.col("turn") % 9 == 0, 9.0).when(F.col("turn") % 3 == 0, 3.0).otherwise(1.0)
    return text.with_topic_shift(t, "nt", "nc", gap).select("conv_id", "turn", "complete", "shift")


@query(f"""WITH {WORDS}, t AS (SELECT event_id, s - {BASE} AS ms FROM w) SELECT event_id, lpad((ms // 3600000)::VARCHAR, greatest(2, length((ms // 3600000)::VARCHAR))::INT, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS srt FROM t""")
def srt_times(spark, sf):  # SCL-09 SCL-10
    return P.words(spark, sf).select("event_id", text.srt_time(F.col("s") - BASE).alias("srt"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug, CASE WHEN length(url) > 30 THEN substr(url, 1, 30) || '...' ELSE url END AS preview,
    replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def page_names(spark, sf):  # SCL-11 SCL-28 SCL-33
    u = F.col("url")
    return P.table(spark, sf, "pages").select("page_id", text.slug(u).alias("slug"), text.preview(u, 30).alias("preview"), text.xml_escape(u).alias("escaped"))


@query(r"""WITH f AS (SELECT p_partkey, (p_partkey % 13 + 1)::VARCHAR || CASE WHEN p_size % 5 = 0 THEN ' LONG ' ELSE ' CLIP ' END || p_size::VARCHAR || ' - ' || replace(p_name, ' ', '-') || CASE WHEN p_size % 7 = 0 THEN '.txt' ELSE '.mp4' END AS file FROM part)
    SELECT p_partkey, file, try_cast(nullif(regexp_extract(file, '^(\d+) (CLIP|LONG) (\d+) - (.+?)\.mp4$', 1), '') AS INT) AS rank, nullif(regexp_extract(file, '^(\d+) (CLIP|LONG) (\d+) - (.+?)\.mp4$', 2), '') AS kind,
           try_cast(nullif(regexp_extract(file, '^(\d+) (CLIP|LONG) (\d+) - (.+?)\.mp4$', 3), '') AS INT) AS score, replace(nullif(regexp_extract(file, '^(\d+) (CLIP|LONG) (\d+) - (.+?)\.mp4$', 4), ''), '-', ' ') AS title FROM f""")
def clip_names(spark, sf):  # SCL-12 PRS-09
    name = F.concat((F.col("p_partkey") % 13 + 1).cast("string"), F.when(F.col("p_size") % 5 == 0, " LONG ").otherwise(" CLIP "), F.col("p_size").cast("string"), F.lit(" - "), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 7 == 0, ".txt").otherwise(".mp4"))
    rows = P.table(spark, sf, "part").select("p_partkey", name.alias("file"))
    return rows.select("p_partkey", "file", *[c.alias(k) for k, c in media.clip_name(F.col("file")).items()])


@query(f"""WITH {WORDS}, h AS (SELECT event_id, s, lpad(to_hex(s), 12, '0') AS h, CASE WHEN event_id % 3 = 0 THEN '4' ELSE '7' END AS v FROM w)
    SELECT event_id, 'chan' || (event_id % 9)::VARCHAR AS handle, CASE WHEN v = '7' THEN s END AS created_ms FROM h""")
def video_urls(spark, sf):  # SCL-13 SCL-14
    h = F.lower(F.lpad(F.hex("s"), 12, "0"))
    uuid = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.when(F.col("event_id") % 3 == 0, "4").otherwise("7"), F.lit("abc-8def-0123456789ab"))
    u = P.words(spark, sf).select("event_id", F.concat(F.lit("https://www.video.example/chan"), (F.col("event_id") % 9).cast("string"), F.lit("/videos/"), uuid, F.lit("?t=1")).alias("url"))
    parts = media.video_url(F.col("url"))
    return u.select("event_id", parts["handle"].alias("handle"), parts["created_ms"].alias("created_ms"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 * 1000 AS plain_ms FROM events")
def iso_times(spark, sf):  # SCL-15
    e = P.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))
    return e.select("event_id", media.iso_millis(F.concat("t", F.lit("Z"))).alias("ms"), media.iso_millis(F.translate(F.substring("t", 1, 19), "T", " ")).alias("plain_ms"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0) + coalesce(CASE WHEN p_size % 3 = 0 THEN p_size * 2 END, 0) AS total, CASE WHEN p_size % 4 = 0 THEN 24 WHEN p_size % 4 = 1 THEN 30 ELSE p_size END::BIGINT AS timebase, p_size % 4 < 2 AS ntsc, (p_size // 2 * 2)::BIGINT AS even FROM part")
def scores_and_rates(spark, sf):  # AGG-03 SCL-16 SCL-17 SCL-26
    p = P.table(spark, sf, "part").withColumn("scores", F.create_map(F.lit("hook"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.lit("value"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 2)))
    fps = media.rational(F.when(F.col("p_size") % 4 == 0, "24000/1001").when(F.col("p_size") % 4 == 1, "30000/1001").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("/1"))))
    base, ntsc = media.rate_class(fps)
    return p.select("p_partkey", compiling.total_score(F.col("scores")).alias("total"), base.alias("timebase"), ntsc.alias("ntsc"), media.even_down(F.col("p_size")).cast("long").alias("even"))


@query("""WITH RECURSIVE c AS (SELECT p_partkey, p_name, 0 AS k, 0::BIGINT AS h FROM part UNION ALL SELECT p_partkey, p_name, k + 1, (h * 33 + ascii(substr(p_name, k + 1, 1))) % 4294967296 FROM c WHERE k < length(p_name)) SELECT p_partkey, h % 7 AS pick FROM c WHERE k = length(p_name)""")
def rolling_picks(spark, sf):  # SCL-20
    return P.table(spark, sf, "part").select("p_partkey", text.rolling_pick(F.col("p_name"), 7).alias("pick"))


# -- geometry ----------------------------------------------------------------------------------------------------------

INTER = "greatest(0.0::DOUBLE, least(a[1] + a[3], b[1] + b[3]) - greatest(a[1], b[1])) * greatest(0.0::DOUBLE, least(a[2] + a[4], b[2] + b[4]) - greatest(a[2], b[2]))"


@query(f"WITH {RECTS}, q AS (SELECT *, {INTER} AS x FROM r) SELECT vec_id, CASE WHEN a[3] * a[4] + b[3] * b[4] - x <> 0 THEN x / (a[3] * a[4] + b[3] * b[4] - x) ELSE 0 END AS iou, x / (b[3] * b[4]) >= 0.8::DOUBLE AS inside FROM q")
def rect_pairs(spark, sf):  # GEO-01 GEO-02
    a, b = G.Rect.of(F.col("a")), G.Rect.of(F.col("b"))
    return P.rects(spark, sf).select("vec_id", G.iou(a, b).alias("iou"), G.contains(a, b).alias("inside"))


@query(f"""WITH {RECTS}, v AS (SELECT vec_id, a, a[3] / a[4] > 1.125::DOUBLE AS wide FROM r)
    SELECT vec_id, CASE WHEN wide THEN a[1] + (a[3] - a[4] * 1.125::DOUBLE) / 2 ELSE a[1] END AS x, CASE WHEN wide THEN a[2] ELSE a[2] + (a[4] - a[3] / 1.125::DOUBLE) / 2 END AS y, CASE WHEN wide THEN a[4] * 1.125::DOUBLE ELSE a[3] END AS w, CASE WHEN wide THEN a[4] ELSE a[3] / 1.125::DOUBLE END AS h,
           a[1] < 20 OR a[1] + a[3] > 980 AS hugs, least(sqrt((a[1] + a[3] / 2) * (a[1] + a[3] / 2) + (a[2] + a[4] / 2) * (a[2] + a[4] / 2)), sqrt((a[1] + a[3] / 2 - 1000) * (a[1] + a[3] / 2 - 1000) + (a[2] + a[4] / 2) * (a[2] + a[4] / 2)),
                 sqrt((a[1] + a[3] / 2) * (a[1] + a[3] / 2) + (a[2] + a[4] / 2 - 600) * (a[2] + a[4] / 2 - 600)), sqrt((a[1] + a[3] / 2 - 1000) * (a[1] + a[3] / 2 - 1000) + (a[2] + a[4] / 2 - 600) * (a[2] + a[4] / 2 - 600))) AS corner FROM v""")
def visible_rects(spark, sf):  # GEO-05 FLT-16 SRT-06
    a = G.Rect.of(F.col("a"))
    v = G.visible_after_cover(a, 1.125)
    return P.rects(spark, sf).select("vec_id", *[c.alias(n) for n, c in zip("xywh", v, strict=True)], ((a.x < 20) | (a.x + a.w > 980)).alias("hugs"), G.corner_distance(a, F.lit(1000.0), F.lit(600.0)).alias("corner"))


@query(f"""WITH {RECTS}, t AS (SELECT vec_id, a, a[3] / a[4] AS ar FROM r),
    s AS (SELECT *, 1.125::DOUBLE * a[4] AS w2, a[3] / 1.125::DOUBLE AS h2, a[4] * 1.125::DOUBLE AS w1 FROM t)
    SELECT vec_id, CASE WHEN ar < 1.125 THEN CASE WHEN w1 <= 1000 THEN least(greatest(a[1] - (w1 - a[3]) * 0.5::DOUBLE, 0), 1000 - w1) ELSE 0 END
                        WHEN ar > 1.125 THEN CASE WHEN h2 <= 600 THEN a[1] ELSE least(greatest(a[1] + a[3] / 2 - 675.0::DOUBLE / 2, 0), 1000 - 675.0::DOUBLE) END ELSE a[1] END AS x,
           CASE WHEN ar < 1.125 THEN w1 WHEN ar > 1.125 THEN CASE WHEN h2 <= 600 THEN a[3] ELSE 675 END ELSE a[3] END AS w,
           CASE WHEN ar < 1.125 THEN a[4] WHEN ar > 1.125 THEN least(h2, 600) ELSE a[4] END AS h FROM s""")
def expanded_rects(spark, sf):  # GEO-04
    g = G.expand_to_aspect(G.Rect.of(F.col("a")), 1.125, F.lit(1000.0), F.lit(600.0))
    return P.rects(spark, sf).select("vec_id", g.x.alias("x"), g.w.alias("w"), g.h.alias("h"))


@query(f"""WITH {RECTS}, h AS (SELECT vec_id, a, b, greatest(greatest(132.0::DOUBLE, least(b[4] * 3.3::DOUBLE, 216.0::DOUBLE)), a[4]) AS h FROM r)
    SELECT vec_id, least(h * 1.125::DOUBLE, 1000) AS w, least(h, 600) AS h, CASE WHEN a[2] + a[4] >= 576 THEN 600 - h ELSE greatest(0, least(b[2] + b[4] / 2 - h * 0.42::DOUBLE, greatest(0, 600 - h))) END AS y FROM h""")
def inset_windows(spark, sf):  # GEO-03 GEO-06 GEO-07
    w = G.inset_window(G.Rect.of(F.col("a")), G.Rect.of(F.col("b")), F.lit(True), F.lit(1000.0), F.lit(600.0), 1.125)
    return P.rects(spark, sf).select("vec_id", w.w.alias("w"), w.h.alias("h"), w.y.alias("y"))


@query(f"""WITH RECURSIVE {RECTS}, o AS (SELECT label, vec_id, a, row_number() OVER (PARTITION BY label ORDER BY -a[3] * a[4], vec_id) AS k FROM r),
    f AS (SELECT label, k, vec_id, true AS keep, [a] AS kept FROM o WHERE k = 1
          UNION ALL SELECT o.label, o.k, o.vec_id, ok, CASE WHEN ok THEN list_append(kept, o.a) ELSE kept END FROM f JOIN o ON o.label = f.label AND o.k = f.k + 1,
          LATERAL (SELECT len(list_filter(list_transform(f.kept, lambda b: {{'x': {INTER.replace('a[', 'o.a[')}, 'u': o.a[3] * o.a[4] + b[3] * b[4]}}), lambda z: z.x / (z.u - z.x) > 0.35)) = 0 AS ok) t)
    SELECT label, vec_id FROM f WHERE keep""")
def merged_boxes(spark, sf):  # GEO-08 SRT-07
    return greedy.merge_boxes(P.rects(spark, sf), ["label"], "vec_id", "a")


@query(f"""WITH RECURSIVE {RECTS}, o AS (SELECT label, [x::BIGINT FOR x IN a] AS a, row_number() OVER (PARTITION BY label ORDER BY floor(vec_id / 50::DOUBLE), vec_id) AS k FROM r),
    f AS (SELECT label, k, [{{'b': a, 'n': 1}}] AS st FROM o WHERE k = 1
          UNION ALL SELECT o.label, o.k, CASE WHEN j = 0 THEN list_append(f.st, {{'b': o.a, 'n': 1}})
              ELSE list_transform(f.st, lambda c, m: CASE WHEN m = j THEN {{'b': [(c.b[1] * c.n + o.a[1]) // (c.n + 1), (c.b[2] * c.n + o.a[2]) // (c.n + 1), (c.b[3] * c.n + o.a[3]) // (c.n + 1), (c.b[4] * c.n + o.a[4]) // (c.n + 1)], 'n': c.n + 1}} ELSE c END) END
          FROM f JOIN o ON o.label = f.label AND o.k = f.k + 1,
          LATERAL (SELECT coalesce(list_position(list_transform(list_transform(f.st, lambda c: {{'x': {INTER.replace('a[', 'o.a[').replace('b[', 'c.b[')}, 'u': o.a[3] * o.a[4] + c.b[3] * c.b[4]}}), lambda z: z.x / (z.u - z.x) > 0.3), true), 0) AS j) t),
    l AS (SELECT label, st FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1), u AS (SELECT label, unnest(st) AS c, generate_subscripts(st, 1) AS m FROM l)
    SELECT label, (row_number() OVER (PARTITION BY label ORDER BY -c.n, -(c.b[3] * c.b[4]), m) - 1)::INT AS cluster, c.b[1] AS x, c.b[2] AS y, c.b[3] AS w, c.b[4] AS h, c.n::INT AS hits FROM u""")
def clustered_boxes(spark, sf):  # GEO-09
    r = P.rects(spark, sf)
    out = greedy.cluster_boxes(r.withColumn("frame", F.floor(F.col("vec_id") / 50)), ["label"], "frame", "vec_id", "a")
    return out.select("label", "cluster", *[F.get("box", F.lit(k)).alias(n) for k, n in enumerate("xywh")], "hits")


def _plan(spark, sf) -> tuple[DataFrame, DataFrame]:
    share = lambda c: F.array(*[F.get(c, F.lit(k)) / (1000.0 if k % 2 == 0 else 600.0) for k in range(4)])
    r = P.rects(spark, sf).select("label", "vec_id", share("a").alias("a"), share("b").alias("b"))
    frame = F.col("vec_id") * 100
    mode = F.element_at(F.array(*[F.lit(m) for m in ("split", "crop", "zoom", "full")]), (F.col("vec_id") % 4 + 1).cast("int"))
    plan = r.select("label", F.col("vec_id").alias("region"), frame.alias("in_frame"), (frame + 100).alias("out_frame"), mode.alias("mode"), F.lit(0.4).alias("face_x"), F.col("a").alias("inset"), F.col("b").alias("content"), F.col("a").alias("zone"), F.when(F.col("vec_id") % 9 == 0, "still").alias("rects_from"), F.lit(1000).alias("width"), F.lit(600).alias("height"))
    near = F.transform("a", lambda x: x + 0.01)
    probe = r.where("vec_id % 17 <> 3").select("label", F.col("vec_id").alias("ord"), frame.alias("in_frame"), (frame + 100).alias("out_frame"), F.when(F.col("vec_id") % 5 != 0, F.when(F.col("vec_id") % 3 == 0, F.col("b")).otherwise(near)).alias("cam"), F.when(F.col("vec_id") % 7 != 0, near).alias("cam_face"), F.when(F.col("vec_id") % 2 == 0, F.lit(0.7)).alias("full_face_x"), (F.col("vec_id") % 3).cast("int").alias("n_faces"), (F.col("vec_id") % 11 == 0).alias("void"))
    return plan, probe


INSIDE = "{x} BETWEEN {r}[1] AND {r}[1] + {r}[3] AND {y} BETWEEN {r}[2] AND {r}[2] + {r}[4]"
SHARED = "greatest(0::DOUBLE, least({a}[1] + {a}[3], {b}[1] + {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0::DOUBLE, least({a}[2] + {a}[4], {b}[2] + {b}[4]) - greatest({a}[2], {b}[2]))"
HOLDS = f"({{b}}[3] * {{b}}[4] > 0 AND {SHARED} / ({{b}}[3] * {{b}}[4]) >= 0.8::DOUBLE)"


def _verify_sql() -> str:
    """The rules of plan verification over the frame of 1000 x 600, as one SELECT for each step; rectangles are lists."""
    W, H, PANE, COLUMN = "1000::DOUBLE", "600::DOUBLE", "1.125::DOUBLE", "(600 * 0.5625::DOUBLE)"
    px = lambda r: f"[{r}[1] * {W}, {r}[2] * {H}, {r}[3] * {W}, {r}[4] * {H}]"
    places = lambda x, of: f"round_even((({x} / {of})::VARCHAR::DECIMAL(38, 20) * 10000)::DOUBLE, 0) / 10000"  # noqa: E731 - a tie is one of the decimals that are printed, as in Spark
    share = lambda r: "[" + ", ".join(places(f"{r}[{k}]", W if k % 2 else H) for k in (1, 2, 3, 4)) + "]"
    whole = lambda r: "[" + ", ".join(places(f"floor({r}[{k}])", W if k % 2 else H) for k in (1, 2, 3, 4)) + "]"
    clamp = lambda v, lo, hi: f"greatest({lo}, least({v}, {hi}))"
    shared = lambda a, b: SHARED.format(a=a, b=b)
    area = lambda r: f"({r}[3] * {r}[4])"
    iou = lambda a, b: f"CASE WHEN {area(a)} + {area(b)} - {shared(a, b)} <> 0 THEN {shared(a, b)} / ({area(a)} + {area(b)} - {shared(a, b)}) ELSE 0::DOUBLE END"

    def grown(r: str, aspect: str) -> str:
        def along(at, size, other_at, other, wanted, other_of, room, other_room):
            need = f"({wanted} - {size})"
            f = f"({at} + {size} / 2)"
            moved = f"({at} - {need} * (1 - {clamp(f'({f} - {at}) / {size}', '0.3::DOUBLE', '0.7::DOUBLE')}))"
            fits = f"{wanted} <= {room}"
            return (f"CASE WHEN {fits} THEN least(greatest({moved}, 0), {room} - {wanted}) ELSE 0 END", f"CASE WHEN {fits} THEN {wanted} ELSE {room} END",
                    f"CASE WHEN {fits} THEN {other_at} ELSE least(greatest({other_at} + {other} / 2 - {other_of} / 2, 0), {other_room} - {other_of}) END", f"CASE WHEN {fits} THEN {other} ELSE {other_of} END")

        x, y, w, h = (f"{r}[{k}]" for k in (1, 2, 3, 4))
        wx, ww, wy, wh = along(x, w, y, h, f"({h} * {aspect})", f"({W} / {aspect})", W, H)
        hy, hh, hx, hw = along(y, h, x, w, f"({w} / {aspect})", f"({H} * {aspect})", H, W)
        pick = lambda a, b, c: f"CASE WHEN {w} / {h} < {aspect} THEN {a} WHEN {w} / {h} > {aspect} THEN {b} ELSE {c} END"
        return f"[{pick(wx, hx, x)}, {pick(wy, hy, y)}, {pick(ww, hw, w)}, {pick(wh, hh, h)}]"

    def window(cam: str, face: str, has: str) -> str:
        fh, fx, fy = f"CASE WHEN {has} THEN {face}[4] ELSE {cam}[4] * 0.35::DOUBLE END", f"CASE WHEN {has} THEN {face}[1] + {face}[3] / 2 ELSE {cam}[1] + {cam}[3] / 2 END", f"CASE WHEN {has} THEN {face}[2] + {face}[4] / 2 ELSE {cam}[2] + {cam}[4] / 2 END"
        h = f"greatest({clamp(f'({fh}) * 3.3::DOUBLE', f'({H} * 0.22::DOUBLE)', f'({H} * 0.36::DOUBLE)')}, {cam}[4])"
        w = f"({h} * {PANE})"
        x = clamp(f"({fx}) - {w} / 2", "0", f"greatest(0, {W} - {w})")
        y = f"CASE WHEN {cam}[2] + {cam}[4] >= {H} * 0.96::DOUBLE THEN {H} - {h} ELSE {clamp(f'({fy}) - {h} * 0.42::DOUBLE', '0', f'greatest(0, {H} - {h})')} END"
        return f"[{x}, {y}, least({w}, {W}), least({h}, {H})]"

    inside = lambda x, y, r, m="0": f"({x} BETWEEN {r}[1] + {r}[3] * {m} AND {r}[1] + {r}[3] - {r}[3] * {m} AND {y} BETWEEN {r}[2] + {r}[4] * {m} AND {r}[2] + {r}[4] - {r}[4] * {m})"
    v = "win"
    wide, vw, vh = f"{v}[3] / {v}[4] > {PANE}", f"({v}[4] * {PANE})", f"({v}[3] / {PANE})"
    visible = f"[CASE WHEN {wide} THEN {v}[1] + ({v}[3] - {vw}) / 2 ELSE {v}[1] END, CASE WHEN {wide} THEN {v}[2] ELSE {v}[2] + ({v}[4] - {vh}) / 2 END, CASE WHEN {wide} THEN {vw} ELSE {v}[3] END, CASE WHEN {wide} THEN {v}[4] ELSE {vh} END]"
    fcx, fcy = "(face[1] + face[3] / 2)", "(face[2] + face[4] / 2)"
    centre = clamp(f"face_x * {W}", f"{COLUMN} / 2", f"{W} - {COLUMN} / 2")
    text = lambda test, said: f"CASE WHEN {test} THEN '{said}' END"
    notes = ", ".join([
        text("split_out AND void", "content pane is VOID (screen idle)"), text("split_out AND NOT void", "no cam / no face measured"), text("structural", "plan inset [] and measured cam [] are different objects"),
        text("mode = 'split' AND NOT split_out AND NOT structural AND measured AND agree < 0.35::DOUBLE", "inset corrected: plan [] -> measured cam []"),
        text("mode = 'split' AND hand", "rects_from=still: plan inset honoured (aspect-expand only)"), text("mode = 'split' AND hand AND (elsewhere OR NOT has_face)", "face check skipped (hand-drawn rects)"),
        text("face_lost", "face outside the streamer pane after centering"), text("mode = 'split' AND NOT split_out AND NOT structural AND NOT face_lost AND grew", "content expanded to pane aspect"),
        text("crop_out", "no full-frame face measured"), text("leaving", "face_x corrected (face was leaving the column)"), text("mode = 'zoom' AND hand", "rects_from=still: zone honoured (tall-widen only)"),
        text("on_cam", "zoom-on-cam: zone snapped to measured cam"), text("zoom_out", "zoom zone is VOID"), text("tall", "tall zone widened to 1:1+"),
        text("demoted AND full_face_x IS NOT NULL", "demoted -> crop"), text("demoted AND full_face_x IS NULL", "demoted -> full"),
    ])
    tenths = lambda r: f"array_to_string(list_transform({r}, lambda t: round(t * 10000)::BIGINT), ',')"
    return f"""WITH {RECTS}, sh AS (SELECT label, vec_id, [a[1] / 1000, a[2] / 600, a[3] / 1000, a[4] / 600] AS a, [b[1] / 1000, b[2] / 600, b[3] / 1000, b[4] / 600] AS b FROM r),
    rows AS (SELECT label, vec_id AS region, ['split', 'crop', 'zoom', 'full'][vec_id % 4 + 1] AS mode, 0.4::DOUBLE AS face_x, a AS inset, b AS content, a AS zone, vec_id % 9 = 0 AS hand, vec_id % 17 <> 3 AS probed,
        CASE WHEN vec_id % 17 <> 3 AND vec_id % 5 <> 0 THEN CASE WHEN vec_id % 3 = 0 THEN b ELSE list_transform(a, lambda x: x + 0.01::DOUBLE) END END AS cam, CASE WHEN vec_id % 17 <> 3 AND vec_id % 7 <> 0 THEN list_transform(a, lambda x: x + 0.01::DOUBLE) END AS cam_face,
        CASE WHEN vec_id % 17 <> 3 AND vec_id % 2 = 0 THEN 0.7::DOUBLE END AS full_face_x, CASE WHEN vec_id % 17 <> 3 THEN vec_id % 3 END AS n_faces, vec_id % 17 <> 3 AND vec_id % 11 = 0 AS void FROM sh),
    m AS (SELECT *, cam IS NOT NULL AS has_cam, cam IS NOT NULL AND cam_face IS NOT NULL AS has_face, {px("cam")} AS c, {px("cam_face")} AS face, {px("inset")} AS ins, {px("zone")} AS z, {px("content")} AS con, {iou("inset", "cam")} AS agree, {iou("zone", "cam")} AS zone_agree FROM rows),
    n AS (SELECT *, has_cam AND NOT hand AS measured, mode = 'split' AND NOT hand AND (void OR (NOT has_cam AND coalesce(n_faces, 0) = 0)) AS split_out, CASE WHEN has_cam AND NOT hand THEN c ELSE ins END AS seed,
        hand AND has_face AND NOT coalesce({inside(fcx, fcy, "ins")}, false) AS elsewhere, {grown("con", PANE)} AS g, {grown("z", "1.0::DOUBLE")} AS gz, {window("c", "face", "has_face")} AS cw FROM m),
    o AS (SELECT *, {window("seed", "face", "(has_face AND NOT elsewhere)")} AS win FROM n),
    q AS (SELECT *, coalesce({inside(fcx, fcy, visible, "0.06::DOUBLE")}, false) AS seen, mode = 'split' AND NOT split_out AND measured AND agree < 0.05::DOUBLE AS structural FROM o),
    s AS (SELECT *, mode = 'split' AND NOT split_out AND NOT structural AND has_face AND NOT elsewhere AND NOT seen AS face_lost, {" OR ".join(f"round_even(g[{k}], 0) <> round_even(con[{k}], 0)" for k in (1, 2, 3, 4))} AS grew,
        mode = 'crop' AND full_face_x IS NULL AS crop_out, coalesce(mode = 'crop' AND full_face_x IS NOT NULL AND NOT (full_face_x * {W} BETWEEN {centre} - {COLUMN} / 2 + {COLUMN} * 0.12::DOUBLE AND {centre} - {COLUMN} / 2 + {COLUMN} * 0.88::DOUBLE), false) AS leaving,
        coalesce(mode = 'zoom' AND NOT hand AND has_cam AND (zone_agree >= 0.5::DOUBLE OR ({area("c")} > 0 AND coalesce({shared("z", "c")} / {area("c")} >= 0.7::DOUBLE, false))), false) AS on_cam FROM q),
    u AS (SELECT *, mode = 'zoom' AND NOT hand AND NOT on_cam AND void AS zoom_out FROM s),
    x AS (SELECT *, mode = 'zoom' AND NOT on_cam AND NOT zoom_out AND z[3] / z[4] < 1 AS tall, split_out OR face_lost OR crop_out OR zoom_out AS demoted FROM u),
    y AS (SELECT *, list_filter([{notes}], lambda t: t IS NOT NULL) AS said, probed AND NOT structural AS act FROM x),
    res AS (SELECT label, region, CASE WHEN act AND demoted THEN CASE WHEN full_face_x IS NOT NULL THEN 'crop' ELSE 'full' END ELSE mode END AS mode, CASE WHEN act AND (demoted OR leaving) THEN full_face_x ELSE face_x END AS face_x,
        CASE WHEN act AND mode = 'split' AND NOT demoted THEN {whole("win")} WHEN NOT (act AND demoted) THEN inset END AS inset, CASE WHEN act AND mode = 'split' AND NOT demoted THEN {share("g")} WHEN NOT (act AND demoted) THEN content END AS content,
        CASE WHEN act AND on_cam THEN {whole("cw")} WHEN act AND tall THEN {share("gz")} WHEN NOT (act AND demoted) THEN zone END AS zone, CASE WHEN hand AND NOT (act AND demoted) THEN 'still' END AS rects_from,
        CASE WHEN NOT probed THEN 'NO-PROBE' WHEN structural THEN 'STRUCTURAL' WHEN demoted THEN 'DEMOTED' WHEN len(said) > 0 THEN 'FIXED' ELSE 'OK' END AS verdict, CASE WHEN NOT probed THEN 'no probe data for this region' ELSE array_to_string(said, '; ') END AS notes FROM y)
    SELECT label, region, region * 100 AS in_frame, region * 100 + 100 AS out_frame, mode, face_x, {tenths("inset")} AS inset, {tenths("content")} AS content, {tenths("zone")} AS zone, rects_from, verdict, notes FROM res"""


@query(_verify_sql())
def verified_plans(spark, sf):  # GEO-12 JON-08 SNK-08
    """Rectangles in ten-thousandths of the frame; numbers in notes are left out."""
    got = layout.verify_plan(*_plan(spark, sf), ["label"])
    parts = lambda c: F.array_join(F.transform(c, lambda t: F.round(t * 10000).cast("long").cast("string")), ",").alias(c)
    said = F.regexp_replace(F.array_join("notes", "; "), r"\[[^\]]*\]", "[]").alias("notes")
    return got.select("label", "region", "in_frame", "out_frame", "mode", "face_x", parts("inset"), parts("content"), parts("zone"), "rects_from", "verdict", said)


@query(f"""WITH {WORDS}, s AS (SELECT user_id, i, 100 * i AS c, 100 * i + 60 AS d FROM w)
    SELECT user_id, 'starts' AS fault FROM s WHERE user_id % 4 = 1 GROUP BY 1 UNION ALL SELECT user_id, 'uncovered' FROM s WHERE user_id % 4 = 2 GROUP BY 1 UNION ALL SELECT user_id, 'extra' FROM s WHERE user_id % 4 = 3 GROUP BY 1""")
def tiling_faults(spark, sf):  # FLT-15
    segs = P.words(spark, sf).select("user_id", "i", (F.col("i") * 100).alias("in_frame"), (F.col("i") * 100 + 60).alias("out_frame"))
    segs = segs.withColumn("last", F.col("i") == F.max("i").over(Window.partitionBy("user_id")))
    last = F.col("last")
    kind, mid = F.col("user_id") % 4, F.col("in_frame") + 25
    r = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    first = F.when((kind == 1) & last, F.array(r(F.col("in_frame") + 1, mid), r(mid, F.col("out_frame")))).when((kind == 2) & last, F.array(r(F.col("in_frame"), mid))).when((kind == 3) & last, F.array(r(F.col("in_frame"), mid), r(mid, F.col("out_frame")), r(F.col("out_frame"), F.col("out_frame") + 5))).otherwise(F.array(r(F.col("in_frame"), mid), r(mid, F.col("out_frame"))))
    regions = segs.select("user_id", F.explode(first).alias("x")).select("user_id", F.col("x.a").alias("in_frame"), F.col("x.b").alias("out_frame"), F.struct("x.a", "x.b").alias("o"))
    return intervals.tiling_faults(regions, segs.drop("last"), U, "o", "i")


# -- framing -----------------------------------------------------------------------------------------------------------


def _detections(spark, sf) -> DataFrame:
    """A short for each user: a sample for each event, with 0 to 3 faces whose places follow the event's number."""
    w = P.words(spark, sf)
    n, calm = F.col("event_id"), F.col("user_id") % 3 == 0
    face = lambda k: F.struct(F.when(calm, 500.0 + F.pmod(n, F.lit(20)) + 5.0 * k).otherwise(F.pmod(n * (31 + 7 * k), F.lit(700)) + 100.0 * k).alias("x"), F.lit(100.0).alias("y"), (60.0 + F.pmod(n, F.lit(40))).cast("double").alias("w"), (70.0 + 10 * k + F.pmod(n, F.lit(25))).cast("double").alias("h"), F.lit(0.9).alias("conf"))
    faces = F.slice(F.array(face(0), face(1), face(2)), 1, F.pmod(n, F.lit(3)).cast("int") + F.when(F.col("user_id") % 2 == 0, 0).otherwise(1))
    return w.select("user_id", (F.col("i") - 1).alias("frame"), F.lit(1280.0).alias("width"), F.lit(720.0).alias("height"), faces.alias("faces"), F.array().cast(f"array<{tracking.BOX}>").alias("humans"), F.lit(1280).alias("src_w"), F.lit(720).alias("src_h"))


@query(f"""WITH {WORDS}, n AS (SELECT user_id, event_id, event_id % 3 + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS c, 60.0::DOUBLE + event_id % 40 AS fw FROM w),
    f AS (SELECT user_id, event_id, k, CASE WHEN user_id % 3 = 0 THEN 500.0::DOUBLE + event_id % 20 + 5 * k ELSE (event_id * (31 + 7 * k)) % 700 + 100.0::DOUBLE * k END + fw / 2 AS cx FROM n, (SELECT unnest([0, 1, 2]) AS k) WHERE k < c),
    s AS (SELECT n.user_id, n.event_id, c, count(DISTINCT floor(cx / (1280 * 0.18::DOUBLE))) AS g, coalesce((max(cx) - min(cx)) / 1280, 0) AS span FROM n LEFT JOIN f USING (user_id, event_id) GROUP BY user_id, event_id, c)
    SELECT user_id, avg((c > 0)::INT) AS hit_rate, avg(c) AS mean_faces, avg(g) AS mean_clusters, avg((g >= 2)::INT) AS multi_share, avg((g >= 3)::INT) AS three_share, avg((span >= 0.52)::INT) AS wide_share, count(*) AS samples, 1280 AS src_w, 720 AS src_h FROM s GROUP BY 1""")
def framing_stats(spark, sf):  # AGG-05 AGG-10 AGG-11 TRK-05 JON-17
    return tracking.framing_stats(tracking.samples(_detections(spark, sf)), U)


def _moving(spark, sf) -> DataFrame:
    """A short for each user, with a sample for each event: of every four, one with faces anywhere, one drifting, two that take turns in size, one fast and at times away."""
    n, frame, way = F.col("event_id"), F.col("i") - 1, F.col("user_id") % 4
    pick = lambda *of: F.when(way == 0, of[0]).when(way == 1, of[1]).when(way == 2, of[2]).otherwise(of[3]).cast("double")

    def face(k: int):
        x = pick((n * (31 + 7 * k)) % 700 + 100 * k, 200 + 4 * (frame % 150), 300 + 26 * (frame % 2) + 400 * k, 100 + 9 * (frame % 100))
        size = F.when(F.floor(frame / 20) % 2 == k, 120).otherwise(80)
        return F.struct(x.alias("x"), F.lit(100.0).alias("y"), pick(60 + n % 40, F.lit(90), size, F.lit(90)).alias("w"), F.lit(100.0).alias("h"), F.lit(0.9).alias("conf"))

    count = pick(n % 3, F.lit(1), F.lit(2), (frame % 7 != 0).cast("int")).cast("int")
    faces = F.slice(F.array(face(0), face(1), face(2)), 1, count)
    return P.words(spark, sf).select("user_id", frame.alias("frame"), F.lit(1280.0).alias("width"), F.lit(720.0).alias("height"), faces.alias("faces"), F.array().cast(f"array<{tracking.BOX}>").alias("humans"), F.lit(1280).alias("src_w"), F.lit(720).alias("src_h"))


def _framing_sql() -> str:
    """Framing by recursion: the subject frame by frame, the targets pick by pick, the camera on its grid."""
    d = lambda x: f"{x}::DOUBLE"
    within = lambda x, most: f"greatest(-({most}), least({most}, {x}))"
    dead, sticky, force, speed = (f"({d(k)} * 405)" for k in (0.055, 0.11, 0.16, 0.085))
    crop = lambda c: f"greatest(0, least(875, round_even({c} - 202.5, 0)))"
    leaps = f"(jumps AND best.s >= m.s * {d(1.28)} AND t - since >= {d(0.85)})"
    pull = within(f"{d(2.6)} * {d(2.6)} * (g.goal - p.x) - 2 * {d(1.15)} * {d(2.6)} * p.v", force)
    return f"""WITH RECURSIVE {WORDS}, n AS (SELECT user_id, event_id, i - 1 AS frame, CASE user_id % 4 WHEN 0 THEN event_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE ((i - 1) % 7 <> 0)::INT END AS c FROM w),
    kf AS (SELECT *, CASE user_id % 4 WHEN 0 THEN (event_id * (31 + 7 * k)) % 700 + 100 * k WHEN 1 THEN 200 + 4 * (frame % 150) WHEN 2 THEN 300 + 26 * (frame % 2) + 400 * k ELSE 100 + 9 * (frame % 100) END AS x,
                  CASE user_id % 4 WHEN 0 THEN 60 + event_id % 40 WHEN 2 THEN CASE WHEN k = (frame // 20) % 2 THEN 120 ELSE 80 END ELSE 90 END AS fw FROM n, (SELECT unnest([0, 1, 2]) AS k) WHERE k < c),
    f AS (SELECT user_id, frame, k, x + fw / {d(2)} AS cx, fw * {d(100)} AS s FROM kf),
    fg AS (SELECT *, floor(cx / (1280 * {d(0.18)})) AS g FROM f),
    per AS (SELECT n.user_id, n.frame, c, count(DISTINCT g) AS g, coalesce((max(cx) - min(cx)) / 1280, 0) AS span FROM n LEFT JOIN fg USING (user_id, frame) GROUP BY ALL),
    st AS (SELECT user_id, avg((c > 0)::INT) AS hit, avg(g) AS mean, avg((g >= 2)::INT) AS multi, avg((g >= 3)::INT) AS three, avg((span >= {d(0.52)})::INT) AS wide, greatest({d(0.2)}, max(frame) / 3::DOUBLE) AS duration FROM per GROUP BY 1),
    facts AS (SELECT *, CASE WHEN hit < {d(0.28)} THEN 'few-faces' WHEN three >= {d(0.22)} THEN 'crowd' WHEN wide >= {d(0.45)} AND multi >= {d(0.5)} THEN 'wide-action' END AS early, multi >= {d(0.32)} AND mean >= {d(1.25)} AS jumps FROM st),
    seen AS (SELECT user_id, frame / 3::DOUBLE AS t, jumps, list({{'c': cx, 's': s, 'g': g}} ORDER BY k) AS faces, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS q FROM fg JOIN facts USING (user_id) WHERE early IS NULL GROUP BY user_id, frame, jumps),
    fb AS (SELECT *, list_filter(faces, lambda x: x.s = list_max(list_transform(faces, lambda y: y.s)))[1] AS best FROM seen),
    fo AS (SELECT user_id, q, t, best AS own, t AS since, 0 AS changes FROM fb WHERE q = 1
           UNION ALL SELECT user_id, q, t, CASE WHEN best.g = own.g OR m IS NULL THEN best WHEN {leaps} THEN best ELSE m END, CASE WHEN best.g <> own.g AND m IS NOT NULL AND {leaps} THEN t ELSE since END,
                            changes + (CASE WHEN best.g = own.g THEN false WHEN m IS NULL OR {leaps} THEN true ELSE false END)::INT
                     FROM (SELECT *, list_filter(mine, lambda x: x.s = list_max(list_transform(mine, lambda y: y.s)))[1] AS m
                           FROM (SELECT b.user_id, b.q, b.t, b.jumps, b.best, p.own, p.since, p.changes, list_filter(b.faces, lambda x: x.g = p.own.g) AS mine FROM fo p JOIN fb b ON b.user_id = p.user_id AND b.q = p.q + 1))),
    pk AS (SELECT user_id, q, t, own.c AS centre, changes AS epoch FROM fo),
    md AS (SELECT *, median(centre) OVER (PARTITION BY user_id, epoch ORDER BY q ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med, coalesce(epoch > lag(epoch) OVER o, false) AS changed, lag(t) OVER o AS t0, lag(centre) OVER o AS c0 FROM pk WINDOW o AS (PARTITION BY user_id ORDER BY q)),
    mv AS (SELECT user_id, q, t, med AS held, {crop("med")} AS spot, {crop("med")} AS told, true AS says FROM md WHERE q = 1
           UNION ALL SELECT user_id, q, t, CASE WHEN go THEN med ELSE held END, CASE WHEN go THEN {crop("med")} ELSE spot END, CASE WHEN go AND abs({crop("med")} - told) >= 2 THEN {crop("med")} ELSE told END, go AND abs({crop("med")} - told) >= 2
                     FROM (SELECT m.user_id, m.q, m.t, m.med, p.held, p.spot, p.told, m.changed OR (abs(m.med - p.held) >= {dead} AND abs(m.med - (p.spot + 202.5)) >= {sticky}) AS go FROM mv p JOIN md m ON m.user_id = p.user_id AND m.q = p.q + 1)),
    goals AS (SELECT user_id, t, told AS x FROM mv WHERE says),
    gn AS (SELECT user_id, count(*) AS n_goals, arg_min(x, t) AS first_x FROM goals GROUP BY 1),
    sp AS (SELECT user_id, list_sort(list(abs(centre - c0) / (t - t0))) AS v FROM md WHERE t0 > 0 AND t - t0 >= {d(0.25)} AND abs(centre - c0) >= {dead} GROUP BY 1),
    rk AS (SELECT user_id, v[1 + round_even((len(v) - 1) * {d(0.5)}, 0)::INT] AS med, v[1 + round_even((len(v) - 1) * {d(0.9)}, 0)::INT] AS p90 FROM sp),
    dec AS (SELECT f.*, coalesce(c.changes, 0) AS changes, coalesce(n_goals, 0) AS n_goals, first_x, coalesce(med, 0) AS med, coalesce(p90, 0) AS p90,
                   coalesce(early, CASE WHEN coalesce(med, 0) > {d(0.22)} * 405 OR coalesce(p90, 0) > {d(0.55)} * 405 THEN 'too-fast' WHEN jumps AND coalesce(c.changes, 0) / duration > {d(0.38)} THEN 'jump-too-often' END) AS why
            FROM facts f LEFT JOIN (SELECT user_id, max(epoch) AS changes FROM pk GROUP BY 1) c USING (user_id) LEFT JOIN gn USING (user_id) LEFT JOIN rk USING (user_id)),
    tk AS (SELECT 0 AS k, 0::DOUBLE AS t UNION ALL SELECT k + 1, t + 1 / 24::DOUBLE FROM tk WHERE t <= (SELECT max(duration) FROM facts) + 1),
    gr AS (SELECT user_id, k, tk.t, first_x FROM dec JOIN tk ON tk.t <= duration + 1e-6::DOUBLE WHERE why IS NULL AND n_goals > 0),
    gg AS (SELECT gr.user_id, gr.k, gr.t, gr.first_x, coalesce(goals.x, gr.first_x) AS goal FROM gr ASOF LEFT JOIN goals ON gr.user_id = goals.user_id AND gr.t >= goals.t),
    cam AS (SELECT user_id, -1 AS k, 0::DOUBLE AS t, first_x::DOUBLE AS x, 0::DOUBLE AS v FROM gg WHERE k = 0
            UNION ALL SELECT user_id, k, t, greatest(0, least(875, CASE WHEN still THEN goal ELSE x + nv * (1 / 24::DOUBLE) END)), CASE WHEN still THEN 0 ELSE nv END
                      FROM (SELECT g.user_id, g.k, g.t, g.goal, p.x, abs(g.goal - p.x) <= 405 * {d(0.012)} AND abs(p.v) <= 405 * {d(0.015)} AS still, {within(f"p.v + {pull} * (1 / 24::DOUBLE)", speed)} AS nv FROM cam p JOIN gg g ON g.user_id = p.user_id AND g.k = p.k + 1)),
    px AS (SELECT user_id, k, t, round_even(x, 0)::INT AS x, lag(round_even(x, 0)::INT) OVER (PARTITION BY user_id ORDER BY k) AS before FROM cam WHERE k >= 0),
    told AS (SELECT user_id, round(t * 1000)::BIGINT AS ms, x FROM px WHERE before IS NULL OR before <> x),
    ends AS (SELECT user_id, round(duration * 1000)::BIGINT AS ms, x FROM (SELECT user_id, max(ms) AS ms, arg_max(x, ms) AS x FROM told GROUP BY 1) JOIN dec USING (user_id) WHERE ms / 1000::DOUBLE < duration),
    path AS (SELECT user_id, string_agg(ms || ':' || x, ',' ORDER BY ms) AS path FROM (FROM told UNION ALL FROM ends) GROUP BY 1)
    SELECT user_id, CASE WHEN why IS NOT NULL THEN 'letterbox' WHEN jumps THEN 'jump' ELSE 'track' END AS mode, coalesce(why, CASE WHEN jumps THEN 'two-faces-' || changes || 'jumps' WHEN mean < {d(1.2)} THEN 'one-face' ELSE 'primary-face' END) AS reason,
           CASE WHEN early IS NULL THEN changes ELSE 0 END AS switches, CASE WHEN early IS NULL THEN n_goals ELSE 0 END AS retargets, CASE WHEN early IS NULL THEN med ELSE 0 END AS median_px_s, CASE WHEN early IS NULL THEN p90 ELSE 0 END AS p90_px_s,
           CASE WHEN why IS NOT NULL THEN '' ELSE coalesce(path, '0:437') END AS path
    FROM dec LEFT JOIN path USING (user_id)"""


@query(_framing_sql())
def framing_plans(spark, sf):  # TRK-01..03 TRK-06 FLT-17 WIN-12 WIN-13
    """The path as text: milliseconds and x."""
    d = _moving(spark, sf)
    got = tracking.plan_framing(tracking.samples(d), U, d.groupBy("user_id").agg((F.max("frame") / 3.0).alias("duration")))
    key = lambda k: F.concat_ws(":", F.round(k["t"] * 1000).cast("long"), k["x"])
    return got.withColumn("path", F.array_join(F.transform("crop_keys", key), ",")).drop("crop_keys")


def _paths(spark, sf) -> DataFrame:
    """A crop path for each user: a key for each event, 0.37 s apart."""
    w = P.words(spark, sf)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct((F.col("i") * 0.37).alias("t"), (F.col("event_id") % 900).cast("int").alias("x")).alias("k")))), lambda x: x["k"])
    return w.groupBy("user_id").agg(keys.alias("crop_keys"), (F.max("i") * 0.37 + 1.3).alias("duration")).withColumn("src_h", F.when(F.col("user_id") % 2 == 0, 720).otherwise(1080))


@query(f"""WITH {WORDS}, x AS (SELECT user_id, i - 1 AS n, i * 0.37::DOUBLE AS t, round_even((event_id % 900) * (1920 / CASE WHEN user_id % 2 = 0 THEN 720 ELSE 1080 END::DOUBLE), 0)::BIGINT AS x FROM w),
    y AS (SELECT user_id, n, t, x - x % 2 AS x FROM x), z AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY n) AS p FROM y)
    SELECT user_id, n::INT AS n, printf('%.3f crop x %d;', t, x) AS command FROM z WHERE x IS DISTINCT FROM p""")
def crop_commands(spark, sf):  # SNK-16 WIN-10
    return tracking.crop_commands(_paths(spark, sf), U)


# -- registry ----------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT p_brand AS package, p_partkey, p_name AS t, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part), m AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY p_size DESC, p_partkey) AS k FROM f WHERE rank % 2 = 0)
    SELECT f.package, f.rank::INT AS rank, f.p_size AS score, coalesce(m.t, f.t) AS title, CASE WHEN max((f.p_size % 50 = 0)::INT) OVER (PARTITION BY f.package) = 1 THEN 'longform' ELSE 'shorts' END AS mode FROM f LEFT JOIN m ON m.package = f.package AND m.k = f.rank""")
def scanned_packages(spark, sf):  # SRC-11 JON-14 WIN-14
    p = P.table(spark, sf, "part").withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    name = F.concat(F.col("rank").cast("string"), F.when(F.col("p_size") % 50 == 0, " LONG ").otherwise(" CLIP "), F.col("p_size").cast("string"), F.lit(" - "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".mp4"))
    manifest = p.where("rank % 2 = 0").select(F.col("p_brand").alias("package"), F.col("p_name").alias("title"), F.col("p_size").alias("total_score"), F.col("p_partkey").alias("n"))
    return registry.scan_packages(p.select(F.col("p_brand").alias("package"), name.alias("file")), manifest).drop("file")


@query(f"""WITH {WORDS} SELECT user_id, count(*) AS n, greatest(2, least(6, floor(count(*) * 1000 / 60::DOUBLE / 15)))::INT AS long_clips, string_agg(DISTINCT w, '+' ORDER BY w) AS modes FROM w GROUP BY 1""")
def package_counts(spark, sf):  # PRS-03 AGG-14
    g = P.words(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("w")), "+").alias("modes"))
    return g.select("user_id", "n", registry.long_form_count(F.col("n") * 1000).alias("long_clips"), "modes")


@query("SELECT coalesce(CASE WHEN max(event_id) > 0 THEN '#000000' END, '#7C5CFF') AS caption_color, 'default' AS caption_font, 'shorts' AS default_mode, 'auto' AS clip_count FROM events")
def merged_settings(spark, sf):  # SCL-29 SET-07 SRC-10
    saved = P.table(spark, sf, "events").agg(F.max("event_id").alias("m")).select(F.create_map(F.lit("caption_color"), F.when(F.col("m") > 0, "#000000"), F.lit("unknown"), F.lit("x")).alias("settings"))
    return registry.settings(saved)


@query(f"""WITH RECURSIVE {STATS} SELECT user_id, "window", density FROM dense WHERE n_words > 2 AND NOT EXISTS (SELECT 1 FROM (SELECT user_id AS u, "window" AS n FROM dense WHERE density >= 55) x WHERE u = user_id AND n = "window")""")
def unread_windows(spark, sf):  # PRS-01 PRS-10
    s = _stats(P.words(spark, sf))
    return registry.unread(s.where("n_words > 2"), s.where("density >= 55").select("user_id", "window"), ["user_id", "window"]).select("user_id", "window", "density")


@query(f"WITH {WORDS}, x AS (SELECT event_id, event_id * 10 AS a, event_id * 10 + event_id % 20 AS b FROM w) SELECT event_id, array_to_string(CASE WHEN b - a <= 8 THEN [(a + b) // 2] ELSE list_sort(list_distinct([a + 2, (a + b) // 2, b - 3])) END, ',') AS points FROM x")
def sample_points(spark, sf):  # SET-06
    n = F.col("event_id")
    return P.words(spark, sf).select("event_id", F.array_join(layout.sample_points(n * 10, n * 10 + n % 20), ",").alias("points"))


@query(r"""WITH c AS (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN [p_size * 5 % 256, p_size * 7 % 256, p_size * 11 % 256] ELSE [p_size % 16 * 17, p_size * 3 % 16 * 17, p_size * 5 % 16 * 17] END AS v FROM part)
    SELECT p_partkey, 0.2126::DOUBLE * (v[1] / 255::DOUBLE) + 0.7152::DOUBLE * (v[2] / 255::DOUBLE) + 0.0722::DOUBLE * (v[3] / 255::DOUBLE) AS luminance, CASE WHEN length(p_name) > 10 THEN (1080 * 0.076::DOUBLE) * (10 / length(p_name)::DOUBLE) ELSE 1080 * 0.076::DOUBLE END AS chip,
           upper(trim(regexp_replace(' ' || replace(p_name, ' ', '   '), '\s+', ' ', 'g'))) AS caption FROM c""")
def caption_looks(spark, sf):  # SCL-21 SCL-22 SCL-24
    s = F.col("p_size")
    hex2 = lambda c: F.lpad(F.hex(c), 2, "0")
    colour = F.when(s % 2 == 0, F.concat(F.lit("#"), hex2(s * 5 % 256), hex2(s * 7 % 256), hex2(s * 11 % 256))).otherwise(F.concat(F.lit("#"), F.hex(s % 16), F.hex(s * 3 % 16), F.hex(s * 5 % 16)))
    return P.table(spark, sf, "part").select("p_partkey", media.luminance(colour).alias("luminance"), media.chip_size(F.col("p_name"), F.lit(1080), F.lit(1920)).alias("chip"), text.caption_upper(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")))).alias("caption"))


@query(f"""WITH {RECTS}, x AS (SELECT vec_id, a[1] + a[3] / 2 AS cx, greatest(1.0::DOUBLE, a[3] * a[4]) AS area FROM r)
    SELECT vec_id, cx, area, greatest(0, least(662, round_even(cx - 337.5::DOUBLE / 2, 0)::BIGINT)) AS crop_x FROM x""")
def box_stats(spark, sf):  # SCL-27
    r = P.rects(spark, sf)
    box = F.struct(*[F.get("a", F.lit(k)).alias(n) for k, n in enumerate("xywh")])
    return r.select("vec_id", *[c.alias(k) for k, c in tracking.box_stats(box, F.lit(1000), F.lit(337.5)).items()])


@query(f"""WITH {RECTS} SELECT vec_id, a[1] + a[3] * 0.25::DOUBLE AS head_x, a[3] * 0.5::DOUBLE AS head_w, greatest(12.0::DOUBLE, a[4] * 0.28::DOUBLE) AS head_h, (1 - b[2] / 600 - b[4] / 600) * 600 AS flipped_y FROM r""")
def head_and_flipped_boxes(spark, sf):  # SCL-31 SCL-32
    box = lambda c, w, h: F.struct(*[(F.get(c, F.lit(k)) / s).alias(n) for k, (n, s) in enumerate(zip("xywh", (w, h, w, h), strict=True))], F.lit(0.9).alias("conf"))
    rows = P.rects(spark, sf).select("vec_id", tracking.head_box(box("a", 1.0, 1.0)).alias("h"), media.flipped_box(box("b", 1000.0, 600.0), F.lit(1000.0), F.lit(600.0)).alias("f"))
    return rows.select("vec_id", F.col("h.x").alias("head_x"), F.col("h.w").alias("head_w"), F.col("h.h").alias("head_h"), F.col("f.y").alias("flipped_y"))


@query(f"WITH {WORDS}, x AS (SELECT event_id, (s - {BASE}) / 1000.0::DOUBLE AS t FROM w) SELECT event_id, floor(t * 29.97::DOUBLE)::BIGINT AS f0, ceil(t * 29.97::DOUBLE)::BIGINT AS f1, round_even(t * 29.97::DOUBLE, 0)::BIGINT AS f FROM x")
def frame_numbers(spark, sf):  # SCL-18
    t = P.words(spark, sf).select("event_id", ((F.col("s") - BASE) / 1000.0).alias("t"))
    return t.select("event_id", media.start_frame(F.col("t"), 29.97).alias("f0"), media.end_frame(F.col("t"), 29.97).alias("f1"), media.nearest_frame(F.col("t"), 29.97).alias("f"))


@query("""WITH x AS (SELECT p_partkey, p_type, p_name, p_size, CASE WHEN p_size % 10 = 0 THEN 'X, ALL' ELSE ' ' || p_name || ', ,' || p_type END AS v FROM part)
    SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'a|b' ELSE lower(trim(p_name)) || '|' || lower(p_type) END AS platforms, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END, 99) AS place FROM x""")
def platform_lists(spark, sf):  # SCL-30 SRT-05
    v = F.when(F.col("p_size") % 10 == 0, "X, ALL").otherwise(F.concat(F.lit(" "), "p_name", F.lit(", ,"), "p_type"))
    return P.table(spark, sf, "part").select("p_partkey", F.array_join(text.comma_list(v, ("a", "b")), "|").alias("platforms"), F.coalesce(F.when(F.col("p_size") % 3 != 0, F.col("p_size")), F.lit(99)).alias("place"))


@query(r"""WITH x AS (SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN upper(p_name || ' ' || p_type) ELSE p_type END AS headline, p_name || ' ' || p_type || ' ' || p_brand || repeat(' and more', p_size % 9) AS why, p_size % 7 AS tags FROM part),
    y AS (SELECT *, len(list_filter(string_split_regex(headline, '\s+'), lambda x: x <> '')) AS w FROM x)
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN length(title) > 38 THEN 'title over 38' END, CASE WHEN NOT w BETWEEN 3 AND 5 THEN 'headline not 3-5 words' END, CASE WHEN headline <> upper(headline) THEN 'headline not upper case' END,
        CASE WHEN length(why) > 80 THEN 'why over 80' END, CASE WHEN NOT tags BETWEEN 3 AND 5 THEN 'hashtags not 3-5' END, CASE WHEN contains(lower(title || ' ' || headline || ' ' || why), 'an') THEN 'banned phrase' END], lambda x: x IS NOT NULL), ';') AS faults FROM y""")
def copy_faults(spark, sf):  # PRS-05 PRS-06
    p, size = P.table(spark, sf, "part"), F.col("p_size")
    headline = F.when(size % 2 == 0, F.upper(F.concat_ws(" ", "p_name", "p_type"))).otherwise(F.col("p_type"))
    why = F.concat(F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.repeat(F.lit(" and more"), (size % 9).cast("int")))
    tags = F.slice(F.array(*[F.lit(f"#{k}") for k in range(7)]), 1, (size % 7).cast("int"))
    return p.select("p_partkey", F.array_join(registry.copy_faults(F.col("p_name"), headline, why, tags, ("An",)), ";").alias("faults"))


@query(f"""WITH {RECTS}, f AS (SELECT vec_id // 8 AS region, [a[1], a[2], a[3] - a[3] % 2, a[4]] AS box, vec_id % 3 + 1 AS hits, vec_id % 7 AS motion FROM r),
    bl AS (SELECT vec_id // 8 AS region, vec_id AS number, b AS box, b[1] + b[3] / 2 AS cx, b[2] + b[4] / 2 AS cy, b[3] * b[4] AS area FROM r),
    fr AS (SELECT *, box[1] + box[3] / 2 AS cx, box[2] + box[4] / 2 AS cy, box[3] * box[4] AS area FROM f),
    fd AS (SELECT *, least(sqrt(cx * cx + cy * cy), sqrt((cx - 1000) * (cx - 1000) + cy * cy), sqrt(cx * cx + (cy - 600) * (cy - 600)), sqrt((cx - 1000) * (cx - 1000) + (cy - 600) * (cy - 600))) AS d FROM fr),
    small AS (SELECT * FROM fd WHERE box[4] < 144 QUALIFY row_number() OVER (PARTITION BY region ORDER BY motion DESC, d, hits DESC, area DESC, box) = 1),
    big AS (SELECT region, round((box[1] + box[3] / 2) / 1000, 3) AS full_face_x FROM fd WHERE box[4] >= 144 QUALIFY row_number() OVER (PARTITION BY region ORDER BY hits DESC, area DESC, box) = 1),
    held AS (SELECT s.region, s.box, s.hits, arg_min(bl.box, bl.number) AS blob FROM small s LEFT JOIN bl ON bl.region = s.region AND {INSIDE.format(x="s.cx", y="s.cy", r="bl.box")} GROUP BY ALL),
    pt AS (SELECT region, box, hits, coalesce(blob, [greatest(0, floor(box[1] - box[3] * 0.9::DOUBLE)), greatest(0, floor(box[2] - box[4] * 0.8::DOUBLE)), floor(box[3] * 2.8::DOUBLE), floor(box[4] * 3.2::DOUBLE)]) AS b FROM held),
    xy AS (SELECT region, box, hits, b, greatest(0, b[1] - 4) AS x, greatest(0, b[2] - 3) AS y FROM pt),
    own AS (SELECT region, [x, y, least(b[3] + 8, 1000 - x), least(b[4] + 7, 600 - y)] AS cam, box AS cam_face, hits / 3::DOUBLE AS conf FROM xy),
    corner AS (SELECT region, arg_min(box, number) AS corner FROM bl WHERE (box[1] < 20 OR box[1] + box[3] > 980) AND (box[2] < 12 OR box[2] + box[4] > 588)
               AND area / 600000 BETWEEN 0.015::DOUBLE AND 0.14::DOUBLE AND box[3] / box[4] BETWEEN 0.7::DOUBLE AND 2.4::DOUBLE GROUP BY 1),
    cams AS (SELECT region, coalesce(cam, corner) AS cam, cam_face, coalesce(conf, CASE WHEN corner IS NOT NULL THEN 0.3::DOUBLE END) AS conf, full_face_x FROM own FULL JOIN corner USING (region) FULL JOIN big USING (region)),
    outer_ AS (SELECT bl.* FROM bl LEFT JOIN cams USING (region) WHERE cam IS NULL OR NOT ({INSIDE.format(x="cx", y="cy", r="cam")})),
    top AS (SELECT region, box AS best, cx AS bx FROM outer_ QUALIFY row_number() OVER (PARTITION BY region ORDER BY area * (0.35::DOUBLE + least(cx / 1000, 1 - cx / 1000)) DESC, number) = 1),
    hull AS (SELECT region, min(box[1]) AS x, min(box[2]) AS y, max(box[1] + box[3]) AS x2, max(box[2] + box[4]) AS y2 FROM outer_ JOIN top USING (region) WHERE box = best OR abs(cx - bx) < best[3] * 0.75::DOUBLE GROUP BY 1),
    moving AS (SELECT region, [x, y, x2 - x, y2 - y] AS motion FROM hull),
    regions AS (SELECT * FROM cams FULL JOIN moving USING (region)),
    panels AS (SELECT region, number, box FROM outer_ WHERE box[1] >= 20 AND box[1] + box[3] <= 980 AND area <= 510000),
    ranked AS (SELECT region, p.box AS panel, coalesce({HOLDS.format(a="p.box", b="motion")}, false) AS holds, number FROM regions JOIN panels p USING (region)),
    chosen AS (SELECT region, panel, holds FROM ranked QUALIFY row_number() OVER (PARTITION BY region ORDER BY holds DESC, number) = 1),
    z AS (SELECT regions.*, panel, panel IS NOT NULL AND (motion IS NULL OR holds) AS use_panel FROM regions LEFT JOIN chosen USING (region)),
    o AS (SELECT *, CASE WHEN use_panel THEN panel ELSE motion END AS content FROM z),
    t AS (SELECT region, conf, full_face_x, motion IS NULL AND panel IS NULL AS void, CASE WHEN use_panel THEN 'panel' WHEN motion IS NOT NULL THEN 'motion' END AS content_source, cam, cam_face, motion, panel, content FROM o)
    SELECT region, conf, full_face_x, void, content_source, {", ".join(f"array_to_string(list_transform({c}, lambda v: v::BIGINT), ',') AS {c}" for c in ("cam", "cam_face", "motion", "panel", "content"))},
           CASE WHEN full_face_x IS NOT NULL THEN 'crop face_x=' || full_face_x WHEN void AND cam IS NOT NULL THEN 'zoom on cam' WHEN cam IS NOT NULL AND content IS NOT NULL THEN 'split' ELSE 'full' END AS suggest FROM t""")
def probe_choices(spark, sf):  # GEO-11 GEO-13 JON-13 AGG-09 SRT-06 SRT-08
    """A region for each eight vectors: their first rectangles are its faces, their second its moving parts and panels."""
    r = P.rects(spark, sf).withColumn("region", F.floor(F.col("vec_id") / 8))
    k = ["region"]
    size = lambda d: d.withColumn("width", F.lit(1000)).withColumn("height", F.lit(600))
    even = F.transform("a", lambda x, n: F.when(n == 2, x - F.pmod(x, F.lit(2.0))).otherwise(x))  # centres at whole pixels
    faces = size(r.select("region", even.alias("box"), (F.col("vec_id") % 3 + 1).alias("hits"), F.lit(3).alias("frames"), (F.col("vec_id") % 7 / 10).alias("motion")))
    blobs = size(r.select("region", F.col("vec_id").alias("number"), F.col("b").alias("box")))
    cams = layout.choose_camera(faces, blobs, k)
    motion = layout.choose_motion(blobs, cams, k)
    panels = blobs.where(G.is_panel(G.Rect.of(F.col("box")), F.col("width"), F.col("height"))).select("region", "number", "box")
    listed = lambda c: F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",").alias(c)
    return layout.choose_content(cams.join(motion, k, "full"), panels, k).select("region", "conf", "full_face_x", "void", "content_source", "suggest", *[listed(c) for c in ("cam", "cam_face", "motion", "panel", "content")])


@query(f"""WITH RECURSIVE {WORDS}, d AS (SELECT user_id, max(i) * 0.37::DOUBLE + 1.3::DOUBLE AS duration FROM w GROUP BY 1),
    p AS (SELECT user_id, i AS n, i * 0.37::DOUBLE AS a, (event_id % 900)::DOUBLE AS x FROM w UNION ALL SELECT user_id, 0, 0::DOUBLE, event_id % 900 FROM w WHERE i = 1
          UNION ALL SELECT user_id, max(i) + 1, max(i) * 0.37::DOUBLE + 1.3::DOUBLE, max_by(event_id % 900, i) FROM w GROUP BY 1),
    q AS (SELECT *, lead(a) OVER o AS b, lead(x) OVER o AS y FROM p WINDOW o AS (PARTITION BY user_id ORDER BY n)),
    g AS (SELECT user_id, duration, 0::DOUBLE AS t FROM d UNION ALL SELECT user_id, duration, t + 0.12::DOUBLE FROM g WHERE t + 0.12::DOUBLE <= duration + 1e-6::DOUBLE)
    SELECT g.user_id, round(g.t, 3) AS t, CASE WHEN b IS NULL THEN x ELSE round_even(x + (y - x) * ((g.t - a) / (b - a)), 0) END::INT AS x
    FROM g JOIN q ON q.user_id = g.user_id AND (q.a < g.t OR q.n = 0) AND (q.b IS NULL OR q.b >= g.t)""")
def resampled_paths(spark, sf):  # TRK-04
    return tracking.resampled(_paths(spark, sf), U)


def _srt_sql(ms: str) -> str:
    part = lambda d, w: f"lpad(({ms} // {d})::VARCHAR, greatest({w}, length(({ms} // {d})::VARCHAR))::INT, '0')" if d == 3600000 else f"lpad(({ms} // {d} % {1000 if d == 1 else 60})::VARCHAR, {w}, '0')"
    return f"{part(3600000, 2)} || ':' || {part(60000, 2)} || ':' || {part(1000, 2)} || ',' || {part(1, 3)}"


@query(f"""WITH sc AS ({ORACLE_SQL["short_cues"]}), m AS (SELECT user_id, cue, text, start - {BASE} AS a, "end" - {BASE} AS b FROM sc)
    SELECT user_id, string_agg(cue::VARCHAR || chr(10) || {_srt_sql("a")} || ' --> ' || {_srt_sql("b")} || chr(10) || text || chr(10), chr(10) ORDER BY cue) AS value FROM m GROUP BY 1""")
def srt_documents(spark, sf):  # SNK-10 SNK-11
    from ..sinks.writers import srt

    cues = short_cues(spark, sf).withColumns({"start": (F.col("start") - BASE) / 1000.0, "end": (F.col("end") - BASE) / 1000.0})
    return srt(cues, U)


def _timeline_sql() -> str:
    rate = "'<rate><timebase>30</timebase><ntsc>TRUE</ntsc></rate>'"
    media = f"""'<video><samplecharacteristics>' || {rate} || '<width>1920</width><height>1080</height><anamorphic>FALSE</anamorphic><pixelaspectratio>square</pixelaspectratio><fielddominance>none</fielddominance></samplecharacteristics></video>'
        || '<audio><samplecharacteristics><samplerate>48000</samplerate><sampledepth>16</sampledepth></samplecharacteristics><channelcount>2</channelcount></audio>'"""
    file = f"""'<file id="file-1"><name>' || name || '</name><pathurl>file:///a.mp4</pathurl>' || {rate} || '<duration>' || ceil(600.0::DOUBLE * 29.97::DOUBLE)::BIGINT::VARCHAR || '</duration><media>' || {media} || '</media></file>'"""
    body = "'<name>' || name || '</name><enabled>TRUE</enabled><duration>' || (z - a)::VARCHAR || '</duration><start>' || (till - (z - a))::VARCHAR || '</start><end>' || till::VARCHAR || '</end><in>' || a::VARCHAR || '</in><out>' || z::VARCHAR || '</out>'"
    link = lambda kind: f"'<link><linkclipref>clipitem-{kind}-' || i::VARCHAR || '</linkclipref><mediatype>{kind}</mediatype><trackindex>1</trackindex><clipindex>' || i::VARCHAR || '</clipindex></link>'"
    item = lambda kind: f"""'<clipitem id="clipitem-{kind}-' || i::VARCHAR || '">' || {body} || {file} || '<sourcetrack><mediatype>{kind}</mediatype><trackindex>1</trackindex></sourcetrack>' || {link("video")} || {link("audio")} || '</clipitem>'"""
    return f"""WITH {WORDS}, c AS (SELECT user_id, i, 'user &amp; ' || user_id::VARCHAR AS name, i * 100 AS a, i * 100 + event_id % 90 + 5 AS z FROM w),
        t AS (SELECT *, sum(z - a) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS till FROM c),
        v AS (SELECT user_id, any_value(name) AS name, max(till) AS till, string_agg({item("video")}, '' ORDER BY i) AS video, string_agg({item("audio")}, '' ORDER BY i) AS audio FROM t GROUP BY 1)
        SELECT user_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE xmeml>' || chr(10) || '<xmeml version="5"><sequence id="sequence-1"><name>' || name || '</name><duration>' || till::VARCHAR || '</duration>' || {rate}
            || '<media><video><track>' || video || '</track></video><audio><numOutputChannels>2</numOutputChannels><track>' || audio || '</track></audio></media></sequence></xmeml>' AS value FROM v"""


@query(_timeline_sql())
def timeline_documents(spark, sf):  # SNK-12
    from ..sinks.writers import timeline_xml

    w = P.words(spark, sf)
    cuts = w.select("user_id", F.col("i").alias("ord"), (F.col("i") * 100).alias("in_frame"), (F.col("i") * 100 + F.pmod("event_id", F.lit(90)) + 5).alias("out_frame"))
    sources = w.select("user_id").distinct().select("user_id", F.concat(F.lit("user & "), F.col("user_id").cast("string")).alias("name"), F.lit("file:///a.mp4").alias("pathurl"), F.lit(29.97).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(48000).alias("samplerate"), F.lit(2).alias("channels"), F.lit(600.0).alias("duration"))
    return timeline_xml(cuts, sources, U)


@query("""WITH f AS (SELECT p_brand AS package, p_partkey AS track, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 37 % 101, p_partkey) AS k FROM part), c AS (SELECT p_brand AS package, p_partkey AS clip, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size % 2 = 0)
    SELECT c.package, clip, track, CASE WHEN clip % 4 = 0 THEN 'disabled' WHEN clip % 4 = 1 THEN 'own' WHEN clip % 4 = 2 THEN 'default' ELSE 'unconfigured' END AS folder FROM c LEFT JOIN f USING (package, k)""")
def music_choices(spark, sf):  # PRS-07 PRS-08
    p = P.table(spark, sf, "part").select(F.col("p_brand").alias("package"), "p_partkey", "p_size")
    tracks = p.select("package", F.col("p_partkey").alias("track"), (F.col("p_size") * 37 % 101).alias("draw"))
    clips = p.where("p_size % 2 = 0").select("package", F.col("p_partkey").alias("clip"))
    n = F.col("clip") % 4
    folder = registry.music_folder(F.when(n == 0, "disabled").when(n == 1, "own").when(n == 2, ""), F.when(n == 2, "default"))
    return registry.pick_tracks(clips, tracks, ["package"], "clip", "draw").select("package", "clip", "track", folder.alias("folder"))


def _verdict_sql(result: str) -> str:
    from ..params import BANNED_OPENERS

    norm = lambda x: f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9'' ]', ' ', 'g'), ' +'), lambda x: x <> '')"
    return rf"""
    WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS v FROM conversations),
    k AS (SELECT conv_id, turn, unnest(v) AS w, generate_subscripts(v, 1) AS k FROM t),
    o AS (SELECT conv_id, turn, k, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS z FROM k),
    w AS (SELECT conv_id, turn, k = 1 AS opens, z + 1 AS i, w, (z * 4 + turn * 30 + turn // 4 * 60) / 10::DOUBLE AS s, (z * 4 + turn * 30 + turn // 4 * 60 + 3) / 10::DOUBLE AS e, CASE WHEN (z + 1) % 50 = 0 THEN -1 ELSE z // 25 END AS b FROM o),
    bl AS (SELECT conv_id, b, min(s) AS onset, max(e) AS fin FROM w WHERE b >= 0 GROUP BY ALL),
    near AS (SELECT w.*, coalesce(lag(e) OVER p, 0) AS pe, coalesce(lead(s) OVER p, e + 1) AS ns, b >= 0 AND row_number() OVER q = 1 AS fst, b >= 0 AND lead(i) OVER q IS NULL AS lst FROM w
             WINDOW p AS (PARTITION BY conv_id ORDER BY i), q AS (PARTITION BY conv_id, b ORDER BY i)),
    ed AS (SELECT conv_id, i, CASE WHEN fst THEN onset ELSE greatest(s - 0.06::DOUBLE, pe, 0) END AS t_in, CASE WHEN lst THEN fin ELSE least(e + 0.1::DOUBLE, greatest(ns - 0.02::DOUBLE, e)) END AS t_out, lst FROM near LEFT JOIN bl USING (conv_id, b)),
    c AS (SELECT conv_id, i, turn::INT AS n, turn, opens, turn % 3 = 0 AS teased, CASE WHEN turn % 4 = 3 THEN 'nothing like it' ELSE concat_ws(' ', w, lead(w) OVER p, lead(w, 2) OVER p) END AS quote, count(*) OVER (PARTITION BY conv_id) AS words,
          CASE WHEN turn % 7 = 1 THEN [[i, i + 40]] WHEN turn % 7 = 2 THEN [[i, i + 30], [i + 25, i + 60]] ELSE [[i, i + 30], [i + 31, i + 60]] END AS segs FROM w WINDOW p AS (PARTITION BY conv_id ORDER BY i)),
    d AS (SELECT *, (i % 25 + i % 11)::INT AS total_score, [x[1] FOR x IN segs] AS a, [x[2] FOR x IN segs] AS z, len(list_filter(segs, lambda x: x[2] > words)) + CASE WHEN teased AND i + 9 > words THEN 1 ELSE 0 END AS bad FROM c WHERE opens),
    r AS (SELECT conv_id, n, 0 AS ord, i + 5 AS x, i + 9 AS y FROM d WHERE bad = 0 AND turn % 7 <> 2 AND teased UNION ALL SELECT conv_id, n, unnest(range(1, len(segs) + 1)), unnest(a), unnest(z) FROM d WHERE bad = 0 AND turn % 7 <> 2),
    f AS (SELECT r.*, floor(p.t_in * 30)::BIGINT AS fi, greatest(ceil(q.t_out * 30)::BIGINT + q.lst::INT, floor(p.t_in * 30)::BIGINT + 1) AS fo FROM r JOIN ed p ON p.conv_id = r.conv_id AND p.i = x JOIN ed q ON q.conv_id = r.conv_id AND q.i = y),
    g AS (SELECT *, CASE WHEN ord = 0 THEN fi ELSE greatest(fi, coalesce(lag(fo) OVER (PARTITION BY conv_id, n, ord = 0 ORDER BY ord), fi)) END AS ci FROM f),
    h AS (SELECT *, ci > fi AND fo - ci < 3 AS gone FROM g), m AS (SELECT *, max(gone::INT) OVER (PARTITION BY conv_id, n ORDER BY ord) = 1 AS cut FROM h),
    fr AS (SELECT conv_id, n, coalesce(sum(fo - ci) FILTER (WHERE ord > 0 AND NOT cut), 0)::BIGINT AS core_frames, coalesce(sum(fo - ci) FILTER (WHERE ord = 0), 0)::BIGINT AS teaser_frames, max(gone::INT) AS collapsed, min_by(x, ord) AS ox, min_by(y, ord) AS oy FROM m GROUP BY ALL),
    op AS (SELECT fr.*, {norm("string_agg(w.w, ' ' ORDER BY w.i)")} AS opening FROM fr JOIN w ON w.conv_id = fr.conv_id AND w.i BETWEEN ox AND oy GROUP BY ALL),
    j AS (SELECT d.*, {norm("quote")} AS q, core_frames, teaser_frames, collapsed, opening FROM d LEFT JOIN op USING (conv_id, n)),
    cl AS (SELECT conv_id, n, min('segment starting at word ' || x::VARCHAR || ' collapses after a ' || (ci - fi)::VARCHAR || '-frame join clamp') AS why FROM h WHERE gone GROUP BY ALL),
    v AS (SELECT j.*, CASE WHEN bad > 0 THEN list_concat([CASE WHEN s[2] > words THEN 'bad word range ' || s[1]::VARCHAR || '-' || s[2]::VARCHAR END FOR s IN segs], [CASE WHEN teased AND i + 9 > words THEN 'bad word range ' || (i + 5)::VARCHAR || '-' || (i + 9)::VARCHAR END])
            WHEN turn % 7 = 2 THEN ['segments overlap or are out of order']
            ELSE [CASE WHEN least(3, len(q), len(opening)) = 0 OR opening[1:least(3, len(q), len(opening))] <> q[1:least(3, len(q), len(opening))]
                       THEN 'hook_quote mismatch: clip opens ' || chr(39) || array_to_string(opening[1:5], ' ') || chr(39) || ' but hook_quote says ' || chr(39) || array_to_string(q[1:5], ' ') || chr(39) END,
                  CASE WHEN list_contains([{_list(BANNED_OPENERS)}], opening[1]) THEN 'opens on continuation token ' || chr(39) || opening[1] || chr(39) END,
                  CASE WHEN (opening[1] = 'i' AND opening[2] = 'mean') OR (opening[1] = 'you' AND opening[2] = 'know') THEN 'opens on ' || chr(39) || opening[1] || ' ' || opening[2] || chr(39) END,
                  CASE WHEN teased AND NOT teaser_frames / 30::DOUBLE BETWEEN 1 AND 4 THEN printf('teaser is %.1fs', teaser_frames / 30::DOUBLE) END, cl.why,
                  CASE WHEN core_frames / 30::DOUBLE < 15 * 0.9::DOUBLE THEN printf('core %.1fs under min 15s', core_frames / 30::DOUBLE) END, CASE WHEN core_frames / 30::DOUBLE > 60 * 1.08::DOUBLE THEN printf('core %.1fs over max 60s', core_frames / 30::DOUBLE) END] END AS why
          FROM j LEFT JOIN cl USING (conv_id, n)),
    wn AS (SELECT conv_id, n, string_agg('join clamped ' || (ci - fi)::VARCHAR || ' frame(s): segment starting at word ' || x::VARCHAR, '; ' ORDER BY 'join clamped ' || (ci - fi)::VARCHAR || ' frame(s): segment starting at word ' || x::VARCHAR) AS clamps
           FROM m WHERE ord > 0 AND ci > fi AND NOT cut GROUP BY ALL),
    judged AS (SELECT v.*, CASE WHEN bad = 0 AND turn % 7 <> 2 THEN coalesce(clamps, '') END AS warnings, list_filter(why, lambda x: x IS NOT NULL) AS reasons FROM v LEFT JOIN wn USING (conv_id, n))
    {result}"""


@query(_verdict_sql("SELECT conv_id, n, CASE WHEN len(reasons) = 0 THEN 'kept' ELSE 'rejected' END AS status, array_to_string(reasons, '; ') AS reasons, total_score, core_frames, teaser_frames, a[1] AS first_word, list_max(z) AS last_word FROM judged"))
def candidate_verdicts(spark, sf):  # FLT-01..09 AGG-01 AGG-03 AGG-08 WIN-15 INT-04 JON-06 JON-07
    m = _manifest(spark, sf)
    return m.select("conv_id", "n", "status", F.array_join("reasons", "; ").alias("reasons"), "total_score", "core_frames", "teaser_frames", "first_word", "last_word")


ORACLE_SQL["compiled_candidates"] = _verdict_sql("SELECT conv_id, n, 'clip ' || i::VARCHAR AS title, CASE WHEN len(reasons) = 0 THEN 'kept' ELSE 'rejected' END AS status, array_to_string(reasons, '; ') AS reasons, warnings, total_score, core_frames, teaser_frames, a[1] AS first_word, list_max(z) AS last_word FROM judged")
ORACLE_SQL["compiled_captions"] = _verdict_sql("""
    , cu AS (SELECT m.conv_id, m.n, ord, ci / 30::DOUBLE AS t0, fo / 30::DOUBLE AS t1 FROM m JOIN judged USING (conv_id, n) WHERE len(reasons) = 0 AND (ord = 0 OR NOT cut)),
    tl AS (SELECT *, coalesce(sum(t1 - t0) OVER (PARTITION BY conv_id, n ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tl FROM cu),
    sh AS (SELECT conv_id, n, ord, w.i, w.w AS text, greatest(tl + w.s - t0, tl) AS start, least(tl + w.e - t0, tl + t1 - t0 - 0.001::DOUBLE) AS fin FROM tl JOIN w USING (conv_id) WHERE w.s >= t0 - 0.02::DOUBLE AND w.s < t1 - 0.005::DOUBLE),
    en AS (SELECT * EXCLUDE fin, CASE WHEN fin - start > 4 THEN start + 2.5::DOUBLE ELSE fin END AS "end" FROM sh) SELECT * FROM en WHERE "end" > start""")


def _thoughts_sql() -> str:
    """CTEs: un, the thoughts of each conversation; cuts and topic starts are recursions over its words."""
    from ..params import INCOMPLETE_TAILS, TOPIC_START, Thoughts

    p = Thoughts()
    pattern = TOPIC_START.replace("(?i)", "").replace("'", "''")
    return rf"""
    t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS v FROM conversations),
    k AS (SELECT conv_id, turn, unnest(v) AS w, generate_subscripts(v, 1) AS k FROM t),
    o AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM k),
    w AS (SELECT conv_id, i, w, (i * 4 + turn * 30 + turn // 4 * 60) / 10::DOUBLE AS s, (i * 4 + turn * 30 + turn // 4 * 60 + 3) / 10::DOUBLE AS e,
                 regexp_matches(w, '[.?!]$') AS stop, list_contains([{_list(INCOMPLETE_TAILS)}], regexp_replace(lower(w), '[^a-z0-9'']+', '', 'g')) AS tail FROM o),
    x AS (SELECT *, s - lag(e) OVER p AS gap, lag(stop) OVER p AS stopped, lag(tail) OVER p AS tailed, max(i) OVER (PARTITION BY conv_id) + 1 AS n,
                 string_agg(w, ' ') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead FROM w WINDOW p AS (PARTITION BY conv_id ORDER BY i)),
    f AS (SELECT conv_id, i, i AS a FROM x WHERE i = 0
          UNION ALL SELECT x.conv_id, x.i, CASE WHEN x.gap >= {p.scene} OR x.gap >= {p.breath} AND (x.stopped OR x.i - f.a >= 6 AND NOT x.tailed) THEN x.i ELSE f.a END FROM f JOIN x ON x.conv_id = f.conv_id AND x.i = f.i + 1),
    th AS (SELECT conv_id, a, max(i) + 1 AS b FROM f GROUP BY ALL HAVING count(*) >= {p.min_words}),
    topic AS (SELECT th.conv_id, a, b, x.i FROM th JOIN x ON x.conv_id = th.conv_id AND x.i BETWEEN a + 5 AND b - 4 WHERE b - a >= 12 AND regexp_matches(ahead, '{pattern}', 'i') AND (stopped OR x.i - a >= 6 AND NOT tailed)),
    inner_cuts AS (SELECT conv_id, a, b, a AS i FROM th UNION ALL SELECT c.conv_id, c.a, c.b, (SELECT min(y.i) FROM topic y WHERE y.conv_id = c.conv_id AND y.a = c.a AND y.i >= c.i + 8) FROM inner_cuts c
          WHERE EXISTS (SELECT 1 FROM topic y WHERE y.conv_id = c.conv_id AND y.a = c.a AND y.i >= c.i + 8)),
    parts AS (SELECT conv_id, a, b, i AS p, coalesce(lead(i) OVER (PARTITION BY conv_id, a ORDER BY i), b) AS q, count(*) OVER (PARTITION BY conv_id, a) AS many FROM inner_cuts),
    un AS (SELECT r.conv_id, row_number() OVER (PARTITION BY r.conv_id ORDER BY p)::INT AS unit, h.s AS start, l.e AS "end", (SELECT string_agg(w.w, ' ' ORDER BY w.i) FROM w WHERE w.conv_id = r.conv_id AND w.i >= p AND w.i < q) AS text,
                  CASE WHEN q < b THEN 0.45::DOUBLE WHEN nx.s IS NULL THEN 0 ELSE nx.s - l.e END AS gap_after
           FROM parts r JOIN w h ON h.conv_id = r.conv_id AND h.i = p JOIN w l ON l.conv_id = r.conv_id AND l.i = q - 1 LEFT JOIN w nx ON nx.conv_id = r.conv_id AND nx.i = b WHERE many = 1 OR q - p >= {p.min_words})"""


def _thought_windows_sql() -> str:
    from ..params import CONTINUE_START, INCOMPLETE_TAILS, MORE_STOPWORDS, TOPIC_START, Thoughts

    p = Thoughts()
    pattern = lambda x: x.replace("(?i)", "").replace("'", "''")
    return rf"""WITH RECURSIVE {_thoughts_sql()},
    du AS (SELECT conv_id, max(e) AS duration FROM w GROUP BY 1),
    v AS (SELECT *, string_split_regex(text, '\s+') AS v FROM un),
    c AS (SELECT *, list_filter(list_distinct(list_transform(v, lambda x: regexp_replace(lower(x), '[^a-z0-9'']+', '', 'g'))), lambda x: length(x) > 2 AND NOT list_contains([{_list(dict.fromkeys(INCOMPLETE_TAILS + MORE_STOPWORDS))}], x)) AS c,
                 regexp_matches(v[-1], '[.?!]$') OR len(v) >= 6 AND NOT list_contains([{_list(INCOMPLETE_TAILS)}], regexp_replace(lower(v[-1]), '[^a-z0-9'']+', '', 'g')) AS done FROM v),
    g AS (SELECT *, lead(text) OVER q AS nt, lead(c) OVER q AS nc, lead("end") OVER q AS after, coalesce(nullif(gap_after, 0), lead(start) OVER q - "end") AS gap FROM c WINDOW q AS (PARTITION BY conv_id ORDER BY unit)),
    z AS (SELECT *, CASE WHEN len(c) = 0 OR len(coalesce(nc, [])) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(c, nc)) / len(list_distinct(list_concat(c, nc)))::DOUBLE END AS sim, coalesce(regexp_matches(nt, '{pattern(TOPIC_START)}', 'i'), false) AS topic FROM g),
    sc AS (SELECT z.*, duration, (CASE WHEN gap >= {p.idea} THEN 2.2::DOUBLE ELSE 0 END) + (CASE WHEN gap >= {p.scene} THEN 2.5::DOUBLE ELSE 0 END) + (CASE WHEN topic THEN 2.4::DOUBLE ELSE 0 END)
               - (CASE WHEN regexp_matches(nt, '{pattern(CONTINUE_START)}', 'i') THEN 2.2::DOUBLE ELSE 0 END) + (CASE WHEN sim < 0.08 AND len(c) > 0 AND len(nc) > 0 THEN 2.0::DOUBLE WHEN sim < 0.16 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN done THEN 0.6::DOUBLE ELSE -2.8::DOUBLE END) AS shift FROM z JOIN du USING (conv_id)),
    pr AS (SELECT s.conv_id, s.unit AS i, e.unit AS j, greatest(0, s.start - 0.08::DOUBLE) AS a, e.duration, least(e.duration, e."end" + 0.12::DOUBLE) AS b, least(e.duration, e.after + 0.12::DOUBLE) AS b2, e.after IS NULL AS final, coalesce(e.gap, -1e9) AS gap, e.done, e.topic, e.shift
           FROM sc s JOIN sc e ON e.conv_id = s.conv_id AND e.unit >= s.unit),
    st AS (SELECT *, final OR b2 - a > {p.longest} OR (b - a >= {p.shortest} AND CASE WHEN b - a < {p.prefer} THEN gap >= {p.scene} OR (topic AND done)
               ELSE gap >= {p.scene} OR done AND (gap >= 3.2 AND shift >= 2.8 OR topic OR b - a >= 120 AND gap >= {p.idea} OR b - a >= 155) END) AS stops FROM pr),
    fi AS (SELECT conv_id, i, min(j) AS j FROM st WHERE stops GROUP BY ALL),
    en AS (SELECT fi.conv_id, fi.i, fi.j, s.a, s.b, s.duration, (SELECT max(q.j) FROM pr q WHERE q.conv_id = fi.conv_id AND q.i = fi.i AND q.j > fi.i AND q.j <= fi.j AND q.b - q.a <= {p.longest} AND q.done) AS fit FROM fi JOIN pr s ON s.conv_id = fi.conv_id AND s.i = fi.i AND s.j = fi.j),
    ch AS (SELECT conv_id, i, a, CASE WHEN b - a <= {p.longest} THEN b WHEN fit IS NULL THEN least(a + {p.longest}, duration) ELSE (SELECT q.b FROM pr q WHERE q.conv_id = en.conv_id AND q.i = en.i AND q.j = fit) END AS b, CASE WHEN b - a <= {p.longest} OR fit IS NULL THEN j ELSE fit END AS j FROM en),
    go AS (SELECT * FROM ch WHERE i = 1 UNION ALL SELECT ch.* FROM go JOIN ch ON ch.conv_id = go.conv_id AND ch.i = go.j + 1)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i)::INT AS "window", a AS start, b AS "end" FROM go WHERE b - a BETWEEN {p.shortest} AND {p.longest}"""


ORACLE_SQL["thought_units"] = f"WITH RECURSIVE {_thoughts_sql()} SELECT * FROM un"
ORACLE_SQL["thought_windows"] = _thought_windows_sql()


from . import files  # noqa: E402, F401 - its queries register themselves
