"""Recordings too long for one task: scans in pieces, pointer doubling, rounds of suppression, lookups and order statistics without a group in one task."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.operators import bands, greedy, intervals, rounds, scans
from strataloom.params import Captions, Framing, Thoughts


def said(seed=1, sizes=(240, 0, 1, 2, 45), pauses=(0.05,) * 20 + (0.8, 2.5, 9.0)):
    r = random.Random(seed)
    rows = []
    for key, n in enumerate(sizes):
        t = 0.0
        for i in range(n):
            rows.append((key if key < 4 else None, i, r.choice(["word", "the", "stop.", "another", "and", "thing", " ", None]), t, t + 0.3))
            t = round(t + 0.3 + r.choice(pauses), 2)
    return rows


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(said(), "k int, i int, text string, start double, end double").cache()


def same(a, b):
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


@pytest.mark.parametrize("piece", [40])
def test_scans_equal_one_pass(words, piece):
    for fn in (
        lambda **x: greedy.build_cues(words, ["k"], ["i"], **x),
        lambda **x: greedy.build_cues(words, ["k"], ["i"], p=Captions(max_words=3, hard_words=4), **x),
        lambda **x: greedy.short_cues(words, ["k"], ["i"], **x),
        lambda **x: greedy.thoughts(words, ["k"], ["i"], **x),
        lambda **x: greedy.snapped_windows(words, ["k"], ["i"], "start", "end", length=20.0, overlap=7.0, **x),
    ):
        whole = fn()
        assert whole.count() > 10
        same(fn(piece=piece), whole)


def test_thought_windows_in_pieces(spark):
    words = spark.createDataFrame(said(2, (2500, 300), (0.05,) * 30 + (0.8, 2.5, 9.0)), "k int, i int, text string, start double, end double")
    units = greedy.thoughts(words, ["k"], ["i"]).cache()
    durations = words.groupBy("k").agg(F.max("end").alias("duration"))
    whole = greedy.thought_windows(units, ["k"], durations, p=Thoughts(prefer=25.0, shortest=5.0))
    assert whole.count() > 5
    same(greedy.thought_windows(units, ["k"], durations, p=Thoughts(prefer=25.0, shortest=5.0), piece=9), whole)


def test_a_state_that_never_forgets(spark):
    """A running total depends on all before it: the state goes from piece to piece, a round for each, and the result is still the whole's."""

    def step(state, columns, last):
        out, total = [], state or 0
        for x in columns[0]:
            total += x
            out.append((total,))
        return out, total

    rows = spark.createDataFrame([(k % 3, i, 1 + (7 * i + k) % 5) for k in range(3) for i in range(40)], "k int, i int, x int").repartition(3)
    got = scans.scan(rows, ["k"], ["i"], ["x"], step, "total long", "n", 11)
    want = set()
    for k in range(3):
        total = 0
        for i in range(40):
            total += 1 + (7 * i + k) % 5
            want.add((k, i + 1, total))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert scans.scan(rows.where("false"), ["k"], ["i"], ["x"], step, "total long", "n", 11).collect() == []


def test_one_recording_takes_many_tasks(spark):
    rows = spark.range(60_000).select(F.lit("one").alias("k"), F.col("id").alias("i"), (F.col("id") * 0.4).alias("start"), (F.col("id") * 0.4 + 0.3).alias("end"), F.when(F.col("id") % 11 == 0, "stop.").otherwise("word").alias("text"))
    pieces = scans.dealt(rows, ["k"], ["i"], 5000).groupBy("_piece").count().collect()
    assert len(pieces) >= 10 and max(p["count"] for p in pieces) < 10_000
    same(greedy.build_cues(rows, ["k"], ["i"], piece=5000), greedy.build_cues(rows, ["k"], ["i"]))


def test_missing_times_leave_the_others(spark):
    words = spark.createDataFrame([(1, 0, "a", 0.0, 0.3), (1, 1, "b", None, 0.7), (1, 2, "c", 0.8, None), (1, 3, "d", 1.2, 1.5)], "k int, i int, text string, start double, end double")
    assert [r.text for r in greedy.build_cues(words, ["k"], ["i"]).collect()] == ["a", "d"]
    assert [r.text for r in greedy.short_cues(words, ["k"], ["i"]).collect()] == ["a d"]


# -- rounds ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["int", "double"])
def test_spacing_by_doubling(spark, kind):
    r = random.Random(3)
    rows = [(k, r.randint(0, 4000) * (1 if kind == "int" else 0.25)) for k in (1, 2, None) for _ in range(300)] + [(4, 7 if kind == "int" else 7.0), (5, None)]
    df = spark.createDataFrame(rows, f"k int, t {kind}")
    for spacing in (1, 37, 900, 100_000):
        whole = greedy.minimum_spacing(df, ["k"], "t", spacing, low=3, high=3900)
        want = set()
        for k in (1, 2, None, 4):
            last = None
            for t in sorted(t for q, t in rows if q == k and t is not None and 3 <= t <= 3900):
                if last is None or t - last >= spacing:
                    want.add((k, t))
                    last = t
        assert {tuple(x) for x in whole.collect()} == want
        same(greedy.minimum_spacing(df, ["k"], "t", spacing, low=3, high=3900, long=True), whole)


def test_reachable_follows_only_its_own_chain(spark):
    links = spark.createDataFrame([("a", 1, 3, True), ("a", 2, 3, False), ("a", 3, 9, False), ("a", 9, None, False), ("a", 10, 1, False), ("b", 5, None, True)], "_key string, at int, next int, first boolean")
    assert {tuple(r) for r in rounds.reachable(links).collect()} == {("a", 1), ("a", 3), ("a", 9), ("b", 5)}


def test_suppression_by_rounds(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, None]), n, r.randint(0, 6), a, a + r.randint(0, 40)) for n, a in enumerate(r.randint(0, 900) for _ in range(400))]
    rows += [(7, n, 5 if n % 2 else n, 10 * n, 10 * n + 10) for n in range(40)]  # each touches the next: a long chain of waiting
    rows += [(8, n % 3, 1, 5, 9) for n in range(7)] + [(8, 50, 9, None, 7), (8, 51, 9, 6, None), (8, 52, 9, 8, 6), (8, 53, 0, 9, 9)]
    df = spark.createDataFrame(rows, "k int, n int, score int, a int, b int")
    whole = greedy.suppress_overlaps(df, ["k"], "score", "n", "a", "b")
    assert whole.count() == len(rows) and whole.where("k = 8 AND n >= 50 AND n < 53 AND winner IS NOT NULL").count() == 0
    same(rounds.suppress_by_rounds(df, ["k"], "score", "n", "a", "b", 25.0), whole)
    assert rounds.suppress_by_rounds(df.where("false"), ["k"], "score", "n", "a", "b", 25.0).collect() == []


# -- lookups and statistics --------------------------------------------------------------------------------------------


def test_nearest_by_union(spark):
    r = random.Random(5)
    a = [(r.choice([1, 2]), r.randint(-300, 900), n) for n in range(200)] + [(1, 5, 7), (1, 5, 7), (3, 5, 300), (1, None, 301), (None, 5, 302)]
    b = [(r.choice([1, 2]), r.randint(-300, 900), n, f"v{n}") for n in range(150)] + [(1, 500, 900, "x"), (1, 500, 899, "y"), (2, None, 1, "z"), (None, 5, 2, "w")]
    got = bands.nearest(spark.createDataFrame(a, "k int, t int, n int"), spark.createDataFrame(b, "k int, u int, tie int, value string"), ["k"], "t", "u", 6, "tie", "value")
    want = []
    for k, t, n in a:
        near = sorted((abs(t - u), tie, v) for q, u, tie, v in b if q == k and u is not None and t is not None and abs(t - u) <= 6)
        want.append((k, t, n, near[0][2] if near else None, near[0][0] if near else None))
    assert Counter(map(tuple, got.where("k IS NOT NULL").collect())) == Counter(w for w in want if w[0] is not None)
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1]


def test_order_statistics(spark):
    r = random.Random(6)
    values = {k: [r.choice([0.0, -0.0, r.gauss(0, 1), r.gauss(0, 1e6), float(r.randint(-3, 3)), float("inf"), -float("inf")]) for _ in range(n)] for k, n in ((1, 501), (2, 1), (3, 20), (None, 77))}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(1, None), (1, float("nan")), (9, None)]
    got = intervals.order_statistics(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [lambda n: F.floor(n * 0.9), lambda n: F.floor(n * 0.1), lambda n: n - 1, lambda n: n, lambda n: F.lit(0)])
    assert {r.k: (r.n, *r.stats) for r in got.collect()} == {k: (len(v), (s := sorted(v))[int(len(v) * 0.9)], s[int(len(v) * 0.1)], s[-1], None, s[0]) for k, v in values.items()}
    whole = intervals.percentile(spark.createDataFrame([(1, x) for x in (5, 1, 4, 2, 2)], "k int, v int"), ["k"], "v", 0.5, "p")
    assert [tuple(r) for r in whole.collect()] == [(1, 2)]


def test_framing_in_pieces(spark):
    """plan_long gives plan_framing's plans and paths, whatever the pieces."""
    from strataloom.operators import tracking
    from strataloom.operators.long_framing import plan_long

    r = random.Random(7)
    rows = []
    for key, (n, size) in enumerate([(200, (1920, 1080)), (60, (1080, 1920)), (150, (1920, 1080)), (1, (1920, 1080)), (90, (1920, 1080)), (70, (1920, 1080))]):
        x = 600.0
        for f in range(n):
            x = min(1700.0, max(50.0, x + r.gauss(0, 24 if key != 4 else 400)))
            two = key == 2 and f % 40 > 6 or key == 4
            faces = [(x, 200.0, 90.0, 100.0, 0.9)] + ([(x + 420.0, 210.0, 85.0 + 60 * (f // 60 % 2), 110.0, 0.8)] if two else [])
            if key == 5 and f % 3:
                faces = []
            rows.append((key, f, 640.0, 360.0, [tuple(v / 3 if i < 4 else v for i, v in enumerate(b)) for b in faces if key == 2 or r.random() > 0.05], [(x / 3, 60.0, 50.0, 120.0, 0.7)], *size))
    d = spark.createDataFrame(rows, f"k int, frame long, width double, height double, faces array<{tracking.BOX}>, humans array<{tracking.BOX}>, src_w int, src_h int")
    sampled, durations = tracking.samples(d).cache(), d.groupBy("k").agg((F.max("frame") / 3.0).alias("duration"))
    p = Framing(fast_median=0.5, fast_p90=5.0, jumps=2.0)
    whole = {x.k: x for x in tracking.plan_framing(sampled, ["k"], durations, p).collect()}
    assert {x["mode"] for x in whole.values()} == {"track", "jump", "letterbox"}, [(k, x["mode"], x.reason, x.switches, round(x.median_px_s), round(x.p90_px_s)) for k, x in whole.items()]
    plans, paths = plan_long(sampled, ["k"], durations, p, piece=150)
    assert {tuple(x) for x in plans.collect()} == {tuple(x)[:-1] for x in whole.values()}
    got = {k: sorted((x.t, x.x) for x in paths.where(F.col("k") == k).collect()) for k in whole}
    assert got == {k: [tuple(y) for y in x.crop_keys] for k, x in whole.items()}


def test_windows_of_many_pieces(spark):
    """Windows far longer than a piece, whose chains from different beginnings don't meet; segments inside others, ends out of order, and the last window."""
    r = random.Random(7)
    for kind in ("long", "double"):
        scale = 1 if kind == "long" else 0.1
        rows = []
        for key, n in ((1, 900), (2, 1), (None, 150), (3, 40)):
            t = 0
            for i in range(n):
                t += r.choice((0, 1, 2, 3, 30 if key == 3 else 2))
                rows.append((key, i, t * scale, (t + r.choice((1, 2, 5, 9, 40, 90 if i % 97 == 0 else 3))) * scale) if kind == "double" else (key, i, t, t + r.choice((1, 2, 5, 9, 40, 90 if i % 97 == 0 else 3))))
        df = spark.createDataFrame(rows, f"k int, i int, s {kind}, e {kind}").repartition(3)
        for length, overlap in ((60, 20), (7, 3), (100_000, 5), (300, 290)):
            go = lambda **x: greedy.snapped_windows(df, ["k"], ["i"], "s", "e", length=length * scale, overlap=overlap * scale, **x)  # noqa: B023, E731
            whole = go()
            assert whole.count() >= 4
            same(go(piece=11), whole)
    assert greedy.snapped_windows(df.where("false"), ["k"], ["i"], "s", "e", length=6.0, overlap=2.0, piece=11).collect() == []
