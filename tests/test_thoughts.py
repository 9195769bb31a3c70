"""Thoughts and the windows made of them: hand-made cases and limits that hold for any transcript."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import greedy
from strataloom.params import INCOMPLETE_TAILS, MORE_STOPWORDS, Thoughts
from strataloom.plans import proxies

P = Thoughts()


def spoken(parts):
    """(texts, starts, ends): parts are (sentence, pause after it); words take 0.3 s, 0.1 s apart."""
    out, t = [], 0.0
    for sentence, pause in parts:
        for w in sentence.split():
            out.append((w, round(t, 3), round(t + 0.3, 3)))
            t += 0.4
        t += pause - 0.1
    return [list(x) for x in zip(*out, strict=True)]


def test_breaks():
    units = greedy.split_thoughts(*spoken([("one two three four five.", 0.8), ("six seven eight nine and", 3.0), ("ten eleven twelve thirteen fourteen fifteen", 9.0), ("too short.", 9.0), ("a b c d e the", 9.0), ("last of all these words", 0)]), P)
    assert [u[3] for u in units] == ["one two three four five.", "six seven eight nine and ten eleven twelve thirteen fourteen fifteen", "a b c d e the", "last of all these words"]
    assert [round(u[4], 2) for u in units] == [0.8, 9.0, 9.0, 0.0]  # a unit that is dropped leaves its neighbour's gap
    assert greedy.split_thoughts([], [], [], P) == []


def test_inner_topics():
    words = "we spoke about the long road home. another matter is the weather in the hills now"
    assert len(greedy.split_thoughts(*spoken([(words, 0)]), P)) == 1  # seven words before it are one too few
    words = "we spoke about the long road home again today. another matter is the weather in the hills now"
    assert [u[3].split()[0] for u in greedy.split_thoughts(*spoken([(words, 0)]), P)] == ["we", "another"]
    assert [u[4] for u in greedy.split_thoughts(*spoken([(words, 0)]), P)] == [0.45, 0.0]


def test_complete_agrees_with_the_expression(spark):
    cases = ["", "  ", "yes.", "one two three four five six", "one two three four five the", "five words are too few", "it stops at the,", "ends with Its", "a b c d e that's"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.c for r in df.select(text.thought_complete(F.col("t")).alias("c")).collect()] == [bool(c.split()) and greedy.finished(c.split()[-1], len(c.split())) for c in cases]


def test_windows_by_hand():
    n = 30
    starts, ends = [k * 10.0 for k in range(n)], [k * 10.0 + 9 for k in range(n)]
    plain = dict(gaps=[1.0] * n, done=[True] * n, topics=[False] * n, shifts=[0.0] * n)
    go = lambda **x: greedy.choose_windows(starts, ends, **(plain | x), duration=400.0, p=P)
    assert [(round(b - a, 2)) for _, a, b in go()] == [159.12, 139.2]  # complete and over 155 s; then the rest
    scene = [1.0] * n
    scene[2] = 9.0
    assert go(gaps=scene)[0][2] == ends[2] + 0.12  # a scene's end splits as soon as the window is long enough
    topics = [False] * n
    topics[3] = True
    assert go(topics=topics)[0][2] == ends[3] + 0.12
    assert go(done=[False] * n)[0][2] - go(done=[False] * n)[0][1] <= P.longest


def test_windows_hold_their_limits(spark):
    r = random.Random(10)
    rows = []
    for key in range(12):
        t = 0.0
        for i in range(r.randint(0, 900)):
            rows.append((key, i, r.choice(["word", "the", "stop.", "another", "and", "thing"]), t, t + 0.3))
            t += 0.3 + r.choice([0.05] * 20 + [0.8, 2.5, 9.0])
    df = spark.createDataFrame(rows, "k int, i int, text string, start double, end double")
    units = greedy.thoughts(df, ["k"], ["i"])
    got = greedy.thought_windows(units, ["k"], df.groupBy("k").agg(F.max("end").alias("duration"))).collect()
    assert got and all(P.shortest <= w.end - w.start <= P.longest for w in got)
    for key in {w.k for w in got}:
        own = sorted((w.start, w.end) for w in got if w.k == key)
        assert all(b[0] >= a[1] - 0.21 for a, b in zip(own, own[1:], strict=False))


def test_a_small_recording_costs_no_data_frame_and_a_text_is_taken_apart_once(spark):
    """a call for each recording, and the content of a text found anew in each place of the score, took most of the time."""
    df = spark.createDataFrame([(1, 1, "word", 0.0, 0.3)], "k int, i int, text string, start double, end double")
    units = greedy.thoughts(df, ["k"], ["i"])
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(greedy.scored_thoughts(units, ["k"])).count("really") == 1  # in the list of stopwords
    assert "FlatMapGroups" not in plan(greedy.thought_windows(units, ["k"], df.groupBy("k").agg(F.max("end").alias("duration"))))


def test_runs_equal_groups(spark):
    """Groups that begin, end or go on anywhere in a batch; keys that are null, and whole numbers that no double holds."""
    r = random.Random(3)
    keys = [None, 2**60 + 1, 2**60 + 2, *range(5)]
    rows = [(k, j, i, r.choice(["a", None, "b c"]), r.choice([0.5 * i, None]), 2**60 + i) for k in keys for j in ("x", None) for i in range(r.choice([1, 2, 7, 40]))]
    df = spark.createDataFrame(rows, "k long, j string, i int, t string, d double, n long").repartition(3)
    fn = lambda t, d, n: [(a, b, n[0] if c == n[-1] else None, c) for a, b, c in zip(t, d, n, strict=True) if c % 3]
    args = (["k", "j"], ["i"], ["t", "d", "n"], fn, "t string, d double, n long, m long")
    want = []
    for key in {x[:2] for x in rows}:
        own = sorted((x for x in rows if x[:2] == key), key=lambda x: x[2])
        want += [(*key, *x) for x in fn(*zip(*(x[3:] for x in own), strict=True))]
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [tuple(None if x != x else x for x in row) for row in greedy.per_run(df, *args).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert Counter(got) == Counter(want)
    assert greedy.per_run(df.where("false"), *args).collect() == []


def test_content_and_shift_by_token(spark):
    texts = ["", None, " \t\n", "don't it's the WEATHER, weather; x", "İstanbul Kelvin ΣΑΣ a b c d", "another thing really happened here. and then", "because we were going home.", "thing happened, here another day we said so much about", "--- ''' ''"]
    rows = [(a, b, g) for a in texts for b in texts for g in (None, 1.0, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "a string, b string, gap double")
    stop = text.strings(dict.fromkeys(INCOMPLETE_TAILS + MORE_STOPWORDS))
    slowly = F.array_distinct(F.filter(F.transform(text.tokens(F.col("a")), text.norm_token), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))
    given = df.select("*", slowly.alias("slowly"), text.topic_shift(F.col("a"), F.col("b"), F.col("gap")).alias("want"), F.when(F.col("b").isNotNull(), text.content_tokens(F.col("b"))).alias("c"))
    got = text.with_topic_shift(text.with_content(given, "a"), "b", "c", F.col("gap")).select("slowly", "_content", "want", "shift").collect()
    assert len(got) == len(rows) and all(x.slowly == x._content and x.want == x.shift for x in got)


def test_how_long_is_spoken(spark, tmp_path):
    rows = [(1, 0, "a b"), (1, 3, " c  d\n"), (1, 9, " "), (1, 3, "e"), (2, 0, ""), (3, None, "x y"), (3, 4, "z"), (4, None, "x"), (None, 5, "p q"), (None, 6, None), (5, -3, "u v w")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = proxies.spoken(spark, str(tmp_path)).groupBy("conv_id").agg(F.max("end").alias("duration"))
    assert Counter(proxies.spoken_until(spark, str(tmp_path)).collect()) == Counter(want.collect())
