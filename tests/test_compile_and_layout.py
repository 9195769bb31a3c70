"""Candidates, plans and framing: hand-made cases, one for each rule."""

import numpy as np
from pyspark.sql import functions as F

from strataloom.operators import compiling, greedy, layout, registry, tracking
from strataloom.params import Clips, Framing

FPS = 30.0


def _transcript(spark, n=400):
    words = [(1, i, "and" if i == 200 else f"w{i}", (i - 1) * 0.4, (i - 1) * 0.4 + 0.3, (i - 1) // 40) for i in range(1, n + 1)]
    blocks = [(1, b, b * 16.0, b * 16.0 + 15.9) for b in range(-(-n // 40))]
    return spark.createDataFrame(words, "k int, i long, w string, s double, e double, b long"), spark.createDataFrame(blocks, "k int, i long, onset double, end double"), spark.createDataFrame([(1, FPS)], "k int, fps double")


def _compile(spark, candidates, p=None):
    w, b, s = _transcript(spark)
    rows = [(1, n, f"c{n}", c.get("mode", "natural"), c.get("quote"), c.get("teaser"), c.get("segments"), c.get("scores", {})) for n, c in enumerate(candidates, 1)]
    manifest, cuts = compiling.compile_candidates(spark.createDataFrame(rows, f"k int, {compiling.CANDIDATE}"), w, b, s, ["k"], p)
    return {r.n: r for r in manifest.collect()}, cuts


def test_reasons_come_by_stage(spark):
    got, cuts = _compile(spark, [
        {"segments": [(1, 80)], "quote": "w1 w2", "scores": {"hook": 3, "value": 4, "other": 9}},
        {"segments": [(0, 80), (390, 500)]},
        {"segments": []},
        {"segments": [(1, 50), (40, 80)], "quote": "nothing"},
        {"segments": [(1, 80)], "mode": "teaser", "quote": "w1"},
        {"segments": [(1, 80)], "mode": "teaser", "teaser": (90, 94), "quote": "w1"},
        {"segments": [(1, 80)], "quote": "w2 w1"},
        {"segments": [(200, 280)], "quote": "and w201"},
        {"segments": [(1, 20)], "quote": ""},
        {"segments": [(1, 300)], "quote": "W1!"},
        {"segments": [(1, 80)], "mode": "teaser", "teaser": (10, 15), "quote": "w10"},
        {"segments": [(1, 80)], "mode": "teaser", "teaser": (10, 40), "quote": "w10"},
    ])
    assert got[1].status == "kept" and got[1].total_score == 7 and got[1].reasons == []
    assert len(got[2].reasons) == 2 and got[3].reasons == ["no segments"]
    assert got[4].reasons == ["segments overlap or are out of order"]
    assert "no teaser range" in got[5].reasons[0] and "inside one" in got[6].reasons[0]
    assert got[7].reasons[0].startswith("hook_quote mismatch")
    assert any("continuation token 'and'" in r for r in got[8].reasons)
    assert len(got[9].reasons) == 2 and "under min" in got[9].reasons[1]
    assert "over max" in got[10].reasons[0]
    assert got[11].status == "kept" and got[11].teaser_frames > 0
    assert "teaser is" in got[12].reasons[0]
    assert sorted({r.n for r in cuts.collect()}) == [1, 11]
    assert [r.ord for r in cuts.where("n = 11").orderBy("ord").collect()] == [0, 1]


def test_longform_only_valid_candidates_suppress(spark):
    got, _ = _compile(spark, [
        {"segments": [(1, 330)], "quote": "w1", "scores": {"hook": 5}},
        {"segments": [(20, 399)], "quote": "wrong", "scores": {"hook": 9}},
        {"segments": [(30, 380)], "quote": "w30", "scores": {"hook": 5}},
        {"segments": [(1, 330)], "mode": "teaser", "teaser": (1, 5), "quote": "w1"},
    ], Clips.long())
    assert got[1].status == "kept" and got[2].reasons[0].startswith("hook_quote")
    assert "share source with candidate 1" in got[3].reasons[0] and got[4].reasons == ["long-form takes no teaser"]


def test_joins_clamp_and_collapse(spark):
    rows = [(1, 1, 0, 100), (1, 2, 99, 200), (1, 3, 198, 201), (1, 4, 300, 400), (2, 1, 0, 10)]
    got = {(r.n, r.ord): (r.in_frame, r.clamped, r.collapsed, r.dropped) for r in compiling.clamp_joins(spark.createDataFrame(rows, "n int, ord int, in_frame int, out_frame int"), ["n"]).collect()}
    assert got[1, 2] == (100, 1, False, False) and got[1, 3][2:] == (True, True) and got[1, 4][3] and got[2, 1] == (0, 0, False, False)


def test_edges(spark):
    w, b, s = _transcript(spark)
    e = compiling.word_edges(w, b, ["k"])
    r = spark.createDataFrame([(1, 41, 80), (1, 42, 79)], "k int, start_word long, end_word long").join(s, "k")
    got = {x.start_word: (x.in_frame, x.out_frame) for x in compiling.resolve(r, e, ["k"]).collect()}
    assert got[41] == (480, 958)  # the block's onset; ceil(31.9 * 30) + 1
    assert got[42][0] == int((41 * 0.4 - 0.06) * 30)


def test_glitched_word_is_capped(spark):
    cuts = spark.createDataFrame([(1, 1, 0, 0, 1200, FPS)], "k int, n int, ord int, in_frame int, out_frame int, fps double")
    words = spark.createDataFrame([(1, 1, "x", 1.0, 20.7), (1, 2, "", 2.0, 2.5), (1, 3, "late", 39.996, 40.5)], "k int, i long, w string, s double, e double")
    assert [(r.text, r.start, r.end) for r in compiling.caption_words(cuts, words, ["k"], ["n"]).collect()] == [("x", 1.0, 3.5)]


PLAN = "k int, region int, in_frame int, out_frame int, mode string, face_x double, inset array<double>, content array<double>, zone array<double>, rects_from string, width int, height int"
PROBE = "k int, ord int, in_frame int, out_frame int, cam array<double>, cam_face array<double>, full_face_x double, n_faces int, void boolean"
CAM, FACE = [0.02, 0.7, 0.2, 0.3], [0.08, 0.75, 0.06, 0.12]


def _verify(spark, plan, probe):
    return {r.region: r for r in layout.verify_plan(spark.createDataFrame(plan, PLAN), spark.createDataFrame(probe, PROBE), ["k"]).collect()}


def _row(n, mode, **x):
    return (1, n, n * 10, n * 10 + 10, mode, x.get("face_x"), x.get("inset"), x.get("content"), x.get("zone"), x.get("rects_from"), 1920, 1080)


def _seen(n, ord=0, **x):
    return (1, ord, n * 10, n * 10 + 10, x.get("cam"), x.get("face"), x.get("full"), x.get("count", 1), x.get("void", False))


def test_plan_rules(spark):
    got = _verify(spark, [
        _row(0, "split", inset=CAM), _row(1, "split", inset=CAM, content=[0.2, 0.1, 0.5, 0.5]), _row(2, "split", inset=[0.7, 0.1, 0.2, 0.2]), _row(3, "split", inset=[0.7, 0.1, 0.2, 0.2], rects_from="still"),
        _row(4, "crop", face_x=0.5), _row(5, "crop", face_x=0.1), _row(6, "crop", face_x=0.5), _row(7, "zoom", zone=CAM), _row(8, "zoom", zone=[0.6, 0.1, 0.1, 0.5]), _row(9, "zoom", zone=[0.5, 0.1, 0.4, 0.4]), _row(10, "full"), _row(11, "full"), _row(12, "split", inset=CAM),
    ], [
        _seen(0, cam=CAM, face=FACE, void=True), _seen(1, cam=CAM, face=FACE), _seen(2, cam=CAM, face=FACE), _seen(3, cam=CAM, face=FACE), _seen(4, full=0.5), _seen(5, full=0.6), _seen(6), _seen(7, cam=CAM, face=FACE), _seen(8, cam=CAM, face=FACE),
        _seen(9, cam=CAM, void=True, full=0.4), _seen(10), _seen(12, count=0),
    ])
    v = {k: (r.verdict, r["mode"]) for k, r in got.items()}
    assert v[0] == ("DEMOTED", "full") and v[1] == ("FIXED", "split") and v[2] == ("STRUCTURAL", "split") and v[3] == ("FIXED", "split")
    assert v[4] == ("OK", "crop") and v[5] == ("FIXED", "crop") and got[5].face_x == 0.6 and v[6] == ("DEMOTED", "full")
    assert v[7] == ("FIXED", "zoom") and v[8] == ("FIXED", "zoom") and v[9] == ("DEMOTED", "crop") and got[9].face_x == 0.4
    assert v[10] == ("OK", "full") and v[11] == ("NO-PROBE", "full") and v[12] == ("DEMOTED", "full")
    assert "face check skipped (hand-drawn rects)" in got[3].notes


def test_verifying_again_changes_nothing(spark):
    probe = [_seen(1, cam=CAM, face=FACE), _seen(5, full=0.6), _seen(7, cam=CAM, face=FACE), _seen(8, cam=CAM, face=FACE)]
    one = _verify(spark, [_row(1, "split", inset=CAM), _row(5, "crop", face_x=0.1), _row(7, "zoom", zone=CAM), _row(8, "zoom", zone=[0.6, 0.1, 0.1, 0.5])], probe)
    two = _verify(spark, [tuple([1, *r][: len(PLAN.split(", "))]) for r in [tuple(one[k])[1:12] for k in one]], probe)
    for k in one:
        assert (one[k]["mode"], one[k].face_x, one[k].inset, one[k].content, one[k].zone) == (two[k]["mode"], two[k].face_x, two[k].inset, two[k].content, two[k].zone)


def test_last_probe_wins(spark):
    assert _verify(spark, [_row(4, "crop", face_x=0.5)], [_seen(4, 0), _seen(4, 1, full=0.5)])[4].verdict == "OK"


def test_camera_choice(spark):
    face = "k int, box array<double>, hits int, frames int, motion double, width int, height int"
    faces = spark.createDataFrame([(1, [100.0, 100.0, 90.0, 90.0], 3, 3, 0.0, 1920, 1080), (1, [1700.0, 900.0, 60.0, 60.0], 2, 3, 0.4, 1920, 1080), (2, [800.0, 200.0, 300.0, 400.0], 3, 3, 0.2, 1920, 1080)], face)
    blobs = spark.createDataFrame([(1, 0, [1600.0, 850.0, 250.0, 200.0], 1920, 1080), (1, 1, [600.0, 200.0, 500.0, 400.0], 1920, 1080), (3, 0, [0.0, 800.0, 300.0, 280.0], 1920, 1080)], "k int, number int, box array<double>, width int, height int")
    got = {r.k: r for r in layout.choose_camera(faces, blobs, ["k"]).collect()}
    assert got[1].cam_face == [1700.0, 900.0, 60.0, 60.0] and got[1].cam[0] == 1593.0  # the moving face, not the still portrait
    assert got[2].full_face_x == round(950 / 1920, 3) and got[2].cam is None and got[3].cam == [0.0, 800.0, 300.0, 280.0]
    cams = layout.choose_camera(faces, blobs, ["k"])
    assert {r.k: r.motion for r in layout.choose_motion(blobs, cams, ["k"]).collect()}[1] == [600.0, 200.0, 500.0, 400.0]


def _followed(frames, jumps, p=None):
    """t, centre and epoch of the followed faces. frames: (t, [(centre, size), ...])."""
    p = p or Framing()
    faces = [f for _, fs in frames for f in fs]
    t = np.array([x for x, _ in frames])
    first = np.concatenate(([0], np.cumsum([len(fs) for _, fs in frames])))
    centre, size = (np.array([f[k] for f in faces], float) for k in range(2))
    picked, epoch = tracking.follow(t, first, size, (centre / (1920 * p.cluster)).astype(int), jumps, p)
    seen = picked >= 0
    return t[seen], centre[picked[seen]], epoch[seen]


def test_subject_holds():
    p = Framing()
    still = [(n / 3, [(600 + n % 2, 100)]) for n in range(30)]
    assert len(tracking.retargets(*_followed(still, False), 1920, 607.5, p)) == 1
    jump = [(n / 3, [(300, 100), (1500, 130 if n >= 10 else 80)]) for n in range(30)]
    t, c, e = _followed(jump, True)
    assert e.tolist() == [0] * 10 + [1] * 20 and c[9] == 300 and c[10] == 1500
    assert _followed(jump, False)[2].max() == 0
    early = [(n / 3, [(300, 100), (1500, 130)] if n % 2 else [(300, 100), (1500, 80)]) for n in range(30)]  # each change has to last hold seconds
    assert all(b - a >= p.hold for a, b in zip(*(lambda x: (x, x[1:]))(_followed(early, True)[0][np.flatnonzero(np.diff(_followed(early, True)[2])) + 1].tolist()), strict=False))
    assert _followed([(0.0, []), (1.0, [(5, 1)]), (2.0, [])], False)[0].tolist() == [1.0]


def test_retargets_are_the_first_places_where_the_median_leaves():
    p, rng = Framing(), np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 300))
        t, c = np.arange(n) / 3, np.clip(np.cumsum(rng.normal(0, 60, n)) + 900, 0, 1919)
        epoch = np.sort(rng.integers(0, 4, n))
        median = tracking.rolling_medians(c, epoch)
        for k in range(n):
            own = [c[m] for m in range(max(0, k - 4), k + 1) if epoch[m] == epoch[k]]
            assert median[k] == np.median(own)
        goals, at, held, want = tracking.retargets(t, c, epoch, 1920, 607.5, p), None, None, []
        for k in range(n):  # by the definition, place by place
            leaves = at is None or k and epoch[k] != epoch[k - 1] or abs(median[k] - held) >= p.dead_zone * 607.5 and abs(median[k] - at - 303.75) >= p.sticky * 607.5
            if leaves:
                held, at = median[k], tracking.crop_at(median[k], 1920, 607.5)
                want += [(t[k], at)] if not want or abs(want[-1][1] - at) >= 2 else []
        assert goals == want


def test_camera_path():
    p = Framing()
    path = tracking.camera_path([(0.0, 100), (1.0, 800)], 12.0, 1920, 607.5, p)
    speed = [abs(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(path, path[1:], strict=False) if b[0] - a[0] > 0.04]
    assert path[0] == (0.0, 100) and path[-1][1] > 600 and path[-1][0] == 12.0 and max(speed) <= 607.5 * p.max_speed + 25
    assert tracking.camera_path([], 3.0, 1920, 607.5, p) == [] and tracking.camera_path([(5.0, 9)], 1.0, 1920, 607.5, p) == [(0.0, 9), (1.0, 9)]
    assert tracking.resample_keys([(0.0, 0), (1.0, 10)], 1.0, 0.5) == [(0.0, 0), (0.5, 5), (1.0, 10)]
    assert tracking.resample_keys([(0.4, 10), (0.8, 20)], 1.3, 0.5) == [(0.0, 10), (0.5, 12), (1.0, 20)]
    assert tracking.resample_keys([(0.0, 0), (1.0, 10)], 1.0, 0.5, snap=10) == [(0.0, 0), (0.5, 0), (1.0, 10)] and tracking.resample_keys([], 1.0) == []


def test_shorts_without_samples(spark):
    none = spark.createDataFrame([], f"k int, frame long, width double, height double, faces array<{tracking.BOX}>, humans array<{tracking.BOX}>, src_w int, src_h int")
    sized = spark.createDataFrame([(1, 9.0, 1920, 1080), (2, 9.0, 1080, 1920), (None, 9.0, None, None)], "k int, duration double, src_w int, src_h int")
    got = {r.k: (r["mode"], r.reason, [tuple(x) for x in r.crop_keys]) for r in tracking.plan_framing(tracking.samples(none), ["k"], sized).collect()}
    assert got == {1: ("letterbox", "no-samples", []), 2: ("track", "no-samples-center", [(0.0, 0)]), None: ("letterbox", "no-samples", [])}


def test_suppressed_clips_keep_their_rows(spark):
    rows = [(None, 1, 5, 0, 10), (None, 2, 4, 5, 20), (1, 1, 5, 0, 10), (1, 1, 5, 0, 10), (1, 3, 2, 11, 12)]
    got = greedy.suppress_overlaps(spark.createDataFrame(rows, "k int, n int, score int, a int, b int"), ["k"], "score", "n", "a", "b").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(*r, w) for r, w in zip(rows, (None, 1, None, 1, None), strict=True)]))


def test_registry(spark):
    log = spark.createDataFrame([("a", "2024-01-01", 0), ("b", None, 1), ("a", "2024-02-01", 2), (None, "2023-01-01", 3)], "path string, date string, ord int")
    assert [(r.path, r.date) for r in registry.latest_registry(log).collect()] == [("a", "2024-02-01"), ("", "2023-01-01"), ("b", None)]
    files = spark.createDataFrame([("p", f"{n} CLIP {100 - n} - a-b-{n}.mp4") for n in range(1, 12)] + [("p", "x.txt")], "package string, file string")
    manifest = spark.createDataFrame([("p", f"T{n}", 100 - n, n) for n in range(1, 11)], "package string, title string, total_score int, n int")
    got = {r["rank"]: r.title for r in registry.scan_packages(files, manifest).collect()}
    assert got[2] == "T2" and got[10] == "T10" and got[11] == "a b 11"
    row = spark.createDataFrame([("A title", "ONE TWO THREE", "why", ["#a", "#b", "#c"]), ("x" * 39, "one two", "y" * 81, [])], "t string, h string, w string, g array<string>")
    faults = [r.f for r in row.select(registry.copy_faults(F.col("t"), F.col("h"), F.col("w"), F.col("g")).alias("f")).collect()]
    assert faults[0] == [] and len(faults[1]) == 5


def test_box_grids_against_every_box(spark):
    """Merging and clustering as if each box met each kept one, in the order they come."""
    import random

    r = random.Random(11)
    rows = [(k % 2, k // 3, k, [float(r.randint(-20, 300)), float(r.randint(0, 200)), float(r.choice([0, 3, 40, 60, 250])), float(r.choice([0, 5, 50, 70]))]) for k in range(400)]

    def iou(a, b):
        both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        union = a[2] * a[3] + b[2] * b[3] - both
        return both / union if union else 0

    merged, clusters = set(), {}
    for key in (0, 1):
        own = [x for x in rows if x[0] == key]
        kept, found = [], []
        for _, _, n, box in sorted(own, key=lambda x: (-x[3][2] * x[3][3], x[2])):
            if all(iou(box, k) <= 0.35 for k in kept):
                kept.append(box)
                merged.add((key, n))
        for _, _, _, box in sorted(own, key=lambda x: (x[1], x[2])):
            hit = next((c for c in found if iou(box, c[0]) > 0.3), None)
            if hit:
                hit[0], hit[1] = [(m * hit[1] + int(v)) // (hit[1] + 1) for m, v in zip(hit[0], box, strict=True)], hit[1] + 1
            else:
                found.append([[int(v) for v in box], 1])
        clusters[key] = sorted((-h, -b[2] * b[3], b) for b, h in found)
    df = spark.createDataFrame(rows, "k int, frame int, n int, box array<double>")
    from strataloom.operators import greedy

    assert {tuple(x) for x in greedy.merge_boxes(df, ["k"], "n", "box").collect()} == merged
    got = greedy.cluster_boxes(df, ["k"], "frame", "n", "box").collect()
    assert {k: sorted((-x.hits, -x.box[2] * x.box[3], list(x.box)) for x in got if x.k == k) for k in (0, 1)} == clusters


def test_shares_round_as_the_sql_does(spark):
    """A pane's width of 110 pixels by 9 / 8 is 123.75, and a product's error below that no other number."""
    from strataloom.functions.geometry import Rect, to_share

    values = [123.74999999999999, 123.75, 123.85, 123.74, 0.0, -123.75, 1e12, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.x[0] for r in df.select(to_share(Rect(*[F.col("v")] * 4), F.lit(1000.0), F.lit(600.0)).array().alias("x")).collect()]
    assert got[:7] == [0.1238, 0.1238, 0.1238, 0.1237, 0.0, -0.1238, 1e9] and got[7] != got[7]


def test_paths_of_many_shorts_a_few_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(1001))})
    parts = list(tracking.few_rows([batch, batch.slice(0, 0), batch.slice(5, 3)]))
    assert max(p.num_rows for p in parts) <= tracking.SHORTS
    assert [v for p in parts for v in p.column("k").to_pylist()] == [*range(1001), 5, 6, 7]


def test_resampled_takes_paths_without_keys(spark):
    df = spark.createDataFrame([(1, [(0.0, 10), (0.3, 40)], 0.3), (2, [], 1.0), (3, None, 1.0)], "k int, crop_keys array<struct<t:double,x:int>>, duration double")
    assert [(r.k, r.t, r.x) for r in tracking.resampled(df, ["k"]).collect()] == [(1, 0.0, 10), (1, 0.12, 22), (1, 0.24, 34)]
