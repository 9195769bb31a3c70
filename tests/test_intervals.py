"""Interval operators against small loops, on random and on hand-made rows."""

import random

from pyspark.sql import functions as F

from strataloom.operators import bands, greedy, intervals


def test_speech_blocks_against_a_sweep(spark):
    r = random.Random(3)
    events, durations, want = [], [], {}
    for key in range(60):
        own = sorted((r.randint(0, 30), r.choice("se")) for _ in range(r.randint(0, 12)))
        shuffled = own.copy()
        r.shuffle(shuffled)
        events += [(key, t, k) for t, k in shuffled]
        durations.append((key, 40))
        cursor, quiet, out = 0, False, []
        for t, kind in own:
            if kind == "s":
                if not quiet and t - cursor > 2:
                    out.append((cursor, t))
                quiet = True
            else:
                cursor, quiet = t, False
        if not quiet and 40 - cursor > 2:
            out.append((cursor, 40))
        want[key] = out
    got = {}
    e, d = spark.createDataFrame(events, "k int, at int, kind string"), spark.createDataFrame(durations, "k int, duration int")
    for row in intervals.speech_blocks(e, ["k"], "at", "kind", d, "duration", least=2).orderBy("k", "block").collect():
        got.setdefault(row.k, []).append((row.start, row.end))
    assert got == {k: v for k, v in want.items() if v}


def test_imputed_times_against_a_loop(spark):
    r = random.Random(4)
    rows, want = [], {}
    for key in range(80):
        t, own = 0, []
        for i in range(r.randint(1, 12)):
            t += r.randint(1, 900)
            own.append([key, i, t if r.random() < 0.6 else None, t + 200 if r.random() < 0.6 else None, t - 10])
        rows += [tuple(x) for x in own]
        prev = None
        for n, x in enumerate(own):
            s = x[2] if x[2] is not None else prev if prev is not None else x[4]
            later = next((y[2] for y in own[n + 1 :] if y[2] is not None), None)
            e = x[3] if x[3] is not None else min(later, s + 500) if later is not None else s + 300
            want[key, n] = s, e
            prev = e
    df = spark.createDataFrame(rows, "k int, i int, s int, e int, seg_start int")
    got = {(x.k, x.i): (x.s, x.e) for x in intervals.impute_times(df, ["k"], "i", cap=500, last_cap=300).collect()}
    assert got == want


def test_band_join_bounds(spark):
    words = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.84, 0.85, 2.04, 2.05, 3.0])], "k int, i int, s double")
    blocks = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 1.5, 2.0), (1, 2, None, 9.0)], "k int, b int, b0 double, b1 double")
    got = {x.i: x.n for x in bands.first_block(words, blocks, ["k"], "s", "b0", "b1", "b", "n", 1.0).collect()}
    assert got == {0: -1, 1: 0, 2: 0, 3: -1, 4: -1}
    text = {x.b: x.text for x in bands.block_text(words.withColumn("w", F.col("i").cast("string")), blocks.where("b < 2"), ["k"], "s", "i", "w", "b0", "b1", "b", 1.0).collect()}
    assert text == {0: "1 2", 1: "2"}


def test_band_join_plans_no_nested_loop(spark):
    p, q = spark.range(100).selectExpr("id k", "id * 1.0 s"), spark.range(100).selectExpr("id k", "id * 1.0 a", "id + 5.0 b")
    plan = bands.band_join(p, q, ["k"], "s", "a", "b", 5.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_join_gives_each_pair_once(spark):
    r = random.Random(5)
    a = [(0, n, x, x + r.randint(0, 40)) for n, x in enumerate(r.randint(0, 100) for _ in range(40))]
    b = [(0, n, x, x + r.randint(0, 40)) for n, x in enumerate(r.randint(0, 100) for _ in range(40))]
    got = bands.overlap_join(spark.createDataFrame(a, "k int, i int, a0 int, a1 int"), spark.createDataFrame(b, "k int, j int, b0 int, b1 int"), ["k"], ("a0", "a1"), ("b0", "b1"), 7.0)
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if y[3] > x[2] and y[2] < x[3])


def test_nearest_takes_the_first_of_equals_within_tolerance(spark):
    a = spark.createDataFrame([(1, 0, 10_000), (1, 1, 50_000)], "k int, i int, t long")
    b = spark.createDataFrame([(1, 8_000, 5, "late"), (1, 12_000, 2, "early"), (1, 55_000, 1, "edge"), (1, 55_001, 0, "out")], "k int, u long, o int, v string")
    assert {x.i: x.v for x in bands.nearest(a, b, ["k"], "t", "u", 5000, "o", "v").collect()} == {0: "early", 1: "edge"}


def test_degenerate_boundaries(spark):
    def verdict(blocks, duration=100.0):
        df = spark.createDataFrame([(1, *b) for b in blocks], "k int, start double, end double")
        return intervals.degenerate(df, ["k"], spark.createDataFrame([(1, duration)], "k int, d double"), "d").first().degenerate

    assert verdict([])
    assert not verdict([(0.0, 95.0)]) and verdict([(0.0, 95.5)])
    tiny = [(float(n), n + 0.3) for n in range(8)] + [(50.0 + n * 2, 51.0 + n * 2) for n in range(2)]
    assert not verdict(tiny) and verdict([*tiny, (90.0, 90.3)])


def test_gaps_and_verdict(spark):
    ranges = spark.createDataFrame([(1, 0, 0.0, 10.0)], "k int, r int, t0 double, t1 double")
    blocks = spark.createDataFrame([(1, 1.0, 4.0), (1, 2.0, 3.0), (1, 4.46, 9.9)], "k int, start double, end double")
    got = intervals.gaps(ranges, blocks, ["k"], "r", 5.0)
    assert [(x.start, round(x.end, 2)) for x in got.collect()] == [(0.06, 0.94)]
    sources = spark.createDataFrame([(1, False), (2, True)], "k int, rescued boolean")
    levels = got.withColumn("db", F.lit(-38.0))
    assert {x.k: x.bed for x in intervals.bed_verdict(levels, sources, ["k"]).collect()} == {1: "ok", 2: "skip"}
    assert {x.k: x.bed for x in intervals.bed_verdict(levels.withColumn("db", F.lit(-37.9)), sources, ["k"]).collect()} == {1: "skip", 2: "skip"}


def test_spacing_and_suppression(spark):
    points = spark.createDataFrame([(1, t) for t in (5, 0, 11, 12, 12, 23, 99)], "k int, t int")
    assert sorted(x.t for x in greedy.minimum_spacing(points, ["k"], "t", 12, high=90).collect()) == [0, 12]
    r = random.Random(6)
    clips = [(0, n, r.randint(0, 5), a, a + r.randint(0, 30)) for n, a in enumerate(r.randint(0, 200) for _ in range(120))]
    kept, want = [], {}
    for c in sorted(clips, key=lambda c: (-c[2], c[1])):
        w = next((k for k in kept if k[3] <= c[4] and c[3] <= k[4]), None)
        want[c[1]] = w[1] if w else None
        if not w:
            kept.append(c)
    df = spark.createDataFrame(clips, "k int, n int, score int, a int, b int")
    for d in (df, df.orderBy(F.rand(1))):
        assert {x.n: x.winner for x in greedy.suppress_overlaps(d, ["k"], "score", "n", "a", "b").collect()} == want


def test_captions_break_after_danglers_late():
    from strataloom.params import Captions

    words = ["w"] * 6 + ["the", "cat", "sat"]
    starts = [k * 0.3 for k in range(9)]
    cues = greedy.group_cues(words, starts, [s + 0.2 for s in starts], Captions())
    assert [c[3] for c in cues] == ["w w w w w w the cat", "sat"]
    glitch = greedy.group_cues(["xx", "b"], [0.0, 0.0], [0.5, 0.5], Captions(max_words=1))
    assert [c[3] for c in glitch] == ["b"]  # a cue without length goes, with its words


def test_srt_carries_milliseconds(spark):
    from strataloom.functions.text import srt_time

    assert spark.range(1).select(srt_time(F.bround(F.lit(1.9996) * 1000).cast("long")).alias("t")).first().t == "00:00:02,000"


def test_empty_tables(spark):
    w = spark.createDataFrame([], "k int, i long, s long, e long, w string")
    assert greedy.snapped_windows(w, ["k"], ["i"], "s", "e").count() == 0
    assert greedy.build_cues(w, ["k"], ["i"], "w", "s", "e").count() == 0
    assert intervals.percentile(w, ["k"], "s", 0.5, "p").count() == 0


def test_long_intervals_take_few_buckets(spark):
    """An interval of a million widths beside short ones: few rows, every kind of join right, and still an equality join."""
    r = random.Random(8)
    points = [(r.choice([1, 2]), r.randint(-50, 2_000_000), n) for n in range(150)] + [(1, None, 900), (2, 77, 901), (2, 77, 901)]
    spans = [(r.choice([1, 2]), a, a + r.choice([0, 1, 3, 40, 700, 90_000, 1_000_000]), n) for n, a in enumerate(r.randint(-20, 1_500_000) for _ in range(60))] + [(1, 5, None, 99), (1, 9, 3, 98)]
    p, q = spark.createDataFrame(points, "k int, t int, n int"), spark.createDataFrame(spans, "k int, a int, b int, m int")
    pairs = sorted((n, m) for k, t, n in points for j, a, b, m in spans if t is not None and b is not None and j == k and a <= t < b)
    own = lambda how: bands.band_join(p, q, ["k"], "t", "a", "b", 1.0, how=how)
    assert sorted((x.n, x.m) for x in own("inner").collect()) == pairs and pairs
    hit = {n for n, _ in pairs}
    assert sorted((x.n, x.m) for x in own("left").where("m IS NOT NULL").collect()) == pairs
    assert sorted(x.n for x in own("left").where("m IS NULL").collect()) == sorted(n for _, _, n in points if n not in hit) == sorted(x.n for x in own("left_anti").collect())
    assert sorted(x.n for x in own("left_semi").collect()) == sorted(n for _, _, n in points if n in hit)
    a, b = q.toDF("k", "a0", "a1", "x"), q.toDF("k", "b0", "b1", "y")
    for closed in (False, True):
        got = sorted((x.x, x.y) for x in bands.overlap_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 1.0, closed).collect())
        fit = [s for s in spans if s[2] is not None and s[1] <= s[2]]
        assert got == sorted((s[3], u[3]) for s in fit for u in fit if s[0] == u[0] and (u[2] >= s[1] and u[1] <= s[2] if closed else u[2] > s[1] and u[1] < s[2]))
    one = spark.createDataFrame([(1, 0, 1_000_000, 1)], "k int, a int, b int, m int").withColumn("_own", bands._level(F.col("b") - F.col("a"), 1.0))
    assert one.select(F.size(F.sequence(bands._at(F.col("a"), 1.0, F.col("_own")), bands._at(F.col("b"), 1.0, F.col("_own")))).alias("n")).first().n < 50
    plan = own("inner")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
