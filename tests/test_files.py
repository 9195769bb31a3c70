"""Sources and sinks: files read and written as stated."""

import json

from pyspark.sql import functions as F

from strataloom.sinks import writers
from strataloom.sources import readers
from strataloom.streaming import live


def test_readers(spark, tmp_path):
    asr = {"segments": [{"start": 0.0, "end": 2.0, "words": [{"word": " hi ", "start": 0.1, "end": 0.4}, {"word": "7"}]}, {"start": 2.0, "end": 3.0, "words": []}]}
    (tmp_path / "a.json").write_text(json.dumps(asr, indent=1))
    p = str(tmp_path / "a.json")
    assert [(r.i, r.w, r.s, r.seg_start) for r in readers.asr_words(spark, p).orderBy("i").collect()] == [(1, "hi", 0.1, 0.0), (2, "7", None, 0.0)]
    assert readers.asr_words(spark, p, timed_only=True).count() == 1 and readers.asr_segments(spark, p).count() == 2
    (tmp_path / "w.jsonl").write_text('{"i":1,"w":"a","s":0,"e":1,"b":-1}\n\n{"i":2,"w":"b","s":1,"e":2,"b":0}\n')
    from strataloom import schemas

    assert readers.json_lines(spark, str(tmp_path / "w.jsonl"), schemas.WORD).count() == 2
    (tmp_path / "log.txt").write_text("x silence_start: 1.5\nsilence_end: 2.25 | y\nsilence_start: -0.1\nRMS_level=-31.5\npts_time:3.2\nmean_volume: -40.1 dB\n")
    log = readers.log_lines(spark, str(tmp_path / "log.txt"))
    assert sorted((r.kind, r.at) for r in readers.silence_events(log).collect()) == [("e", 2.25), ("s", 1.5)]
    assert readers.rms_levels(log).first().level == -31.5 and readers.scene_times(log).first().t == 3.2 and readers.mean_volumes(log).first().db == -40.1
    (tmp_path / "c.json").write_text(json.dumps({"streams": [{"codec_type": "audio", "sample_rate": "44100"}, {"codec_type": "video", "r_frame_rate": "30000/1001", "width": 4, "height": 2}], "format": {"duration": "9.5"}}))
    c = readers.container(spark, str(tmp_path / "c.json")).first()
    assert (round(c.fps, 3), c.samplerate, c.duration) == (29.97, 44100, 9.5)
    assert {r.file for r in readers.listing(spark, str(tmp_path), "*.json").collect()} == {"a.json", "c.json"}


def test_cuts_and_candidates(spark, tmp_path):
    from strataloom import schemas

    (tmp_path / "cuts.json").write_text(json.dumps({"source": "s", "fps": 30.0, "clips": [{"in_frame": 1, "out_frame": 5, "text": "t"}, {"in_frame": 7, "out_frame": 9, "text": "u", "teaser": True}]}))
    assert [(r.ord, r.in_frame, r.fps, r.teaser) for r in readers.exploded(spark, str(tmp_path / "cuts.json"), schemas.CUTS, "clips").orderBy("ord").collect()] == [(0, 1, 30.0, None), (1, 7, 30.0, True)]
    (tmp_path / "cand.json").write_text(json.dumps({"clips": [{"title": "x", "segments": [{"start_word": 1, "end_word": 2}], "scores": {"hook": 3}}]}))
    c = readers.candidates(spark, str(tmp_path / "cand.json")).first()
    assert c.n == 1 and c.teaser is None and c.scores == {"hook": 3}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ("b", 1, "x"), ("a", 1, "y")], "k string, i int, w string")
    writers.write_lines(rows, str(tmp_path / "lines"), ["k"], "i")
    (part,) = (tmp_path / "lines/k=b").glob("*.json")
    assert part.read_text().splitlines() == ['{"i":1,"w":"x"}', '{"i":2,"w":null}']
    docs = writers.as_document(rows, ["k"], "i", "rows", ["i", "w"], spark.createDataFrame([("b", 30.0)], "k string, fps double"))
    assert json.loads(docs.where("k = 'b'").first().value) == {"fps": 30.0, "rows": [{"i": 1, "w": "x"}, {"i": 2, "w": None}]}
    writers.write_documents(docs, str(tmp_path / "docs"), ["k"])
    assert len(list((tmp_path / "docs").glob("k=*"))) == 2
    cues = spark.createDataFrame([(1, 1, 0.0, 1.9996, "a"), (1, 2, 2.0, 3.0, "b")], "k int, cue int, start double, end double, text string")
    assert writers.srt(cues, ["k"]).first().value == "1\n00:00:00,000 --> 00:00:02,000\na\n\n2\n00:00:02,000 --> 00:00:03,000\nb\n"
    assert writers.plain_text(cues, ["k"]).first().value == "a\nb"


def test_timeline_xml(spark):
    import xml.dom.minidom

    cuts = spark.createDataFrame([(1, 0, 10, 40), (1, 1, 100, 120)], "k int, ord int, in_frame int, out_frame int")
    source = spark.createDataFrame([(1, "a & b", "file:///a", 29.97, 1920, 1080, 48000, 2, 60.0)], "k int, name string, pathurl string, fps double, width int, height int, samplerate int, channels int, duration double")
    doc = xml.dom.minidom.parseString(writers.timeline_xml(cuts, source, ["k"]).first().value)
    text = lambda tag: [x.firstChild.data for x in doc.getElementsByTagName(tag)]
    assert text("start") == ["0", "30"] * 2 and text("end") == ["30", "50"] * 2 and text("ntsc")[0] == "TRUE" and text("timebase")[0] == "30"


def test_streams(spark, tmp_path):
    spark.range(20).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), (F.lit(0) + F.col("id") * 600).cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long, t timestamp").parquet(str(tmp_path / "in"))
    live.latest_stream(stream, "k", "v").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.v for r in spark.table("latest").collect()} == {0: 18, 1: 19, 2: 17}
    live.run_once(live.sessions(stream, "k", "t", "40 minutes", "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 0


def test_packs_read_as_the_files(spark, tmp_path):
    """Few files whatever the number of keys, and the readers give what they give for a file for each key."""
    from strataloom import schemas
    from strataloom.plans import files

    n = 300
    rows = spark.range(2 * n).select((F.col("id") % n).alias("user_id"), F.col("id").alias("i"), F.concat(F.lit('a "b"\n'), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(None, 7, "é")], "user_id long, i long, text string"))
    docs = writers.as_document(rows, ["user_id"], "i", "clips", ["i", "text"])
    writers.write_packs(docs, path := str(tmp_path / "docs"), ["user_id"])
    assert len(list((tmp_path / "docs").glob("*.json"))) < 20
    got = files.user_of(readers.documents(spark, path, "clips array<struct<i:long,text:string>>", True)).select("user_id", F.explode("clips").alias("x")).select("user_id", "x.i", "x.text")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select("user_id", "i", "text").collect()))
    listed = readers.listing(spark, path, "user_id=1*", True).collect()
    size = {f"user_id={r.user_id}": len(r.value.encode()) for r in docs.where("user_id IS NOT NULL").collect()}
    assert {r.file: r.size for r in listed} == {k: v for k, v in size.items() if k.startswith("user_id=1")} and all(r.modified for r in listed)
    assert readers.listing(spark, path, "*.txt", True).count() == 0
    log = spark.createDataFrame([(1, "RMS_level=-31.5 | pts_time:3.2 | mean_volume: -40.1 dB\nRMS_level=-2"), (2, None), (3, "")], "user_id long, value string")
    writers.write_packs(log, path := str(tmp_path / "log"), ["user_id"])
    assert sorted((r.source_id, r.what, r.x) for r in readers.measures(readers.log_lines(spark, path, True)).collect()) == [("user_id=1", "level", -31.5), ("user_id=1", "level", -2.0), ("user_id=1", "scene", 3.2), ("user_id=1", "volume", -40.1)]
    lines = rows.select("user_id", "i", F.to_json(F.struct("i", F.col("text").alias("w"))).alias("value"))
    writers.write_packs(lines, path := str(tmp_path / "lines"), ["user_id"], "i")
    got = files.user_of(readers.json_lines(spark, path, schemas.WORD, True)).select("user_id", "i", F.col("w").alias("text"))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_queries_of_files_write_few(spark, tmp_path, monkeypatch):
    """No query of files writes a file for each recording."""
    from conftest import DATA

    from strataloom.plans import files

    for name in "measured_logs silence_logs word_lines kept_clip_files render_props caption_word_files speech_maps asr_words timed_asr_words candidate_files cut_files listed_packages".split():
        monkeypatch.setattr(files, "scratch", lambda s, name=name: str(tmp_path / name))
        files.__dict__[name](spark, f"{DATA}/sf0.01")
        assert 0 < len([p for p in (tmp_path / name).rglob("part-*")]) <= 16, name
