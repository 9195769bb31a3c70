"""Sinks: JSON lines and documents, subtitles, XML timelines, logs. Nulls are written as nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import rate_class
from ..functions.text import srt_time, xml_escape


def write_lines(df: DataFrame, path: str, keys: list[str], order: str) -> None:
    """JSON lines in order within each file; a folder for each keys. One recording's lines stay together and sorted."""
    out = df.repartition(*keys).sortWithinPartitions(*keys, order) if keys else df.orderBy(order)
    (out.write.partitionBy(*keys) if keys else out.write).option("ignoreNullFields", "false").json(path)


def as_document(df: DataFrame, keys: list[str], order: str, name: str, columns: list[str], header: DataFrame | None = None) -> DataFrame:
    """keys and value: a JSON document with the rows, in order, as the list `name`, and the header's columns beside it."""
    by = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)  # noqa: E731 - maps among the columns have no order
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_r"))), by), lambda x: x["_r"])
    docs = df.groupBy(*keys).agg(rows.alias(name))
    extra = [c for c in header.columns if c not in keys] if header is not None else []
    docs = docs.join(header, keys, "left") if header is not None else docs
    return docs.select(*keys, F.to_json(F.struct(*extra, name), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(docs: DataFrame, path: str, keys: list[str]) -> None:
    """A folder for each keys with its document."""
    docs.repartition(*keys).write.partitionBy(*keys).text(path)


def write_packs(files: DataFrame, path: str, keys: list[str], order: str | None = None) -> None:
    """Many small files as few large ones: JSON lines of source_id (a folder for each keys, as above), length (bytes) and value (the file's text, or a line of it).

    A file of its own for each of a million recordings is a million calls of the file system to write it, and as many to read it; packs are as many as tasks wrote, whatever the
    number of keys. order: the lines of one source_id stay together and sorted. sources.readers reads packs as it reads the files.
    """
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for k in keys])
    laid = files if order is None else files.repartition(*keys).sortWithinPartitions(*keys, order)
    laid.select(folder.alias("source_id"), F.octet_length("value").cast("long").alias("length"), "value").write.json(path)


def srt(cues: DataFrame, keys: list[str], order: str = "cue", start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """keys and value: the cues (seconds) as SubRip text, numbered from 1."""
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    block = F.concat(n.cast("string"), F.lit("\n"), srt_time(ms(start)), F.lit(" --> "), srt_time(ms(end)), F.lit("\n"), F.col(text), F.lit("\n"))
    blocks = cues.select(*keys, n.alias("_n"), block.alias("_b"))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda x: x["_b"]), "\n").alias("value"))


def plain_text(cues: DataFrame, keys: list[str], order: str = "cue", text: str = "text") -> DataFrame:
    return cues.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("value"))


def _tag(name: str, *inner) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(str(x)) for x in inner]
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


def timeline_xml(cuts: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys and value: an XMEML 5 sequence of the cuts (ord, in_frame, out_frame) for editing programs.

    sources: name, pathurl, fps, width, height, samplerate, channels, duration. Texts are escaped. The output timeline is a running sum.
    """
    from ..operators.intervals import running_offsets

    placed = running_offsets(cuts, keys, "ord", F.col("out_frame") - F.col("in_frame")).join(sources, keys)
    base, ntsc = rate_class(F.col("fps"))
    s = lambda c: (c if isinstance(c, Column) else F.col(c)).cast("string")
    rate = _tag("rate", _tag("timebase", s(base)), _tag("ntsc", F.upper(s(ntsc))))
    name = xml_escape(F.col("name"))
    media = F.concat(
        _tag("video", _tag("samplecharacteristics", rate, _tag("width", s("width")), _tag("height", s("height")), _tag("anamorphic", "FALSE"), _tag("pixelaspectratio", "square"), _tag("fielddominance", "none"))),
        _tag("audio", _tag("samplecharacteristics", _tag("samplerate", s("samplerate")), _tag("sampledepth", 16)), _tag("channelcount", s(F.coalesce("channels", F.lit(2))))),
    )
    frames = F.ceil(F.col("duration") * F.col("fps"))
    file = F.concat(F.lit('<file id="file-1">'), _tag("name", name), _tag("pathurl", xml_escape(F.col("pathurl"))), rate, _tag("duration", s(frames)), _tag("media", media), F.lit("</file>"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    body = F.concat(_tag("name", name), _tag("enabled", "TRUE"), _tag("duration", s(F.col("out_frame") - F.col("in_frame"))), _tag("start", s("timeline_start")), _tag("end", s("timeline_end")), _tag("in", s("in_frame")), _tag("out", s("out_frame")))
    link = lambda kind: _tag("link", _tag("linkclipref", F.concat(F.lit(f"clipitem-{kind}-"), s(number))), _tag("mediatype", kind), _tag("trackindex", 1), _tag("clipindex", s(number)))
    item = lambda kind: F.concat(F.lit(f'<clipitem id="clipitem-{kind}-'), s(number), F.lit('">'), body, file, _tag("sourcetrack", _tag("mediatype", kind), _tag("trackindex", 1)), link("video"), link("audio"), F.lit("</clipitem>"))
    items = placed.select(*keys, number.alias("_n"), item("video").alias("_v"), item("audio").alias("_a"), name.alias("_name"), rate.alias("_rate"), media.alias("_media"), F.col("timeline_end").alias("_end"))
    track = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", c))), lambda x: x[c]), "")
    whole = items.groupBy(*keys).agg(track("_v").alias("_video"), track("_a").alias("_audio"), F.first("_name").alias("_name"), F.first("_rate").alias("_rate"), F.max("_end").alias("_end"))
    sequence = F.concat(F.lit('<sequence id="sequence-1">'), _tag("name", F.col("_name")), _tag("duration", s("_end")), F.col("_rate"), _tag("media", _tag("video", _tag("track", F.col("_video"))), _tag("audio", _tag("numOutputChannels", 2), _tag("track", F.col("_audio")))), F.lit("</sequence>"))
    return whole.select(*keys, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n<xmeml version="5">'), sequence, F.lit("</xmeml>")).alias("value"))


def concat_list(spans: DataFrame, keys: list[str], blank: str = "blank.png") -> DataFrame:
    """keys, n, value: lines of a concat list from a local timeline (start, end, text; text null: a gap)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    shown = F.sum(F.col("text").isNotNull().cast("int")).over(Window.partitionBy(*keys).orderBy("start", "end")) - 1
    name = F.when(F.col("text").isNull(), F.lit(blank)).otherwise(F.format_string("cap_%04d.png", shown))
    return spans.select(*keys, n.alias("n"), F.concat(F.lit("file "), name, F.lit("\nduration "), F.format_string("%.3f", F.col("end") - F.col("start"))).alias("value"))


def append_registry(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_verified_plan(verified: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes, to a new path, the plans of which no region is structural or unprobed; gives back the keys of those held back."""
    bad = verified.where(F.col("verdict").isin("STRUCTURAL", "NO-PROBE")).select(*keys).distinct()
    verified.join(bad, keys, "left_anti").write.json(path)
    return bad


def write_revived(rows: DataFrame, path: str) -> None:
    """clip, mode, status, score, dur, hook_mode, title, reason as CSV with a header."""
    rows.select("clip", "mode", "status", "score", "dur", "hook_mode", "title", "reason").write.option("header", True).csv(path)


#: Fixed values of the caption renderer: what a package's settings overlay.
RENDER_DEFAULTS = {"color": "#7C5CFF", "fontWeight": 800, "title": "", "titleSec": 3.0, "captionY": 0.73}
SEAM = 0.5


def caption_track(regions: DataFrame, keys: list[str], order: str, fps: str = "fps", caption_y: str = "caption_y") -> DataFrame:
    """keys and track: where captions stand (y) from start to end on the output timeline; on the seam over splits. Regions of equal height are one.

    regions: in_frame, out_frame and mode in order, with fps and the height of captions over all but splits.
    """
    from ..operators.intervals import merge_equal, running_offsets

    y = F.when(F.col("mode") == "split", F.lit(SEAM)).otherwise(F.col(caption_y))
    placed = running_offsets(regions, keys, order, F.col("out_frame") - F.col("in_frame")).select(*keys, order, y.alias("y"), (F.col("timeline_start") / F.col(fps)).alias("start"), (F.col("timeline_end") / F.col(fps)).alias("end"))
    runs = merge_equal(placed, keys, order, "y", "start", "end")
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "y"))).alias("track"))


def render_props(words: DataFrame, videos: DataFrame, tracks: DataFrame, keys: list[str], order: str, settings: str = "settings") -> DataFrame:
    """keys and value: the document that the caption renderer reads: video, words, chip, fontWeight, captionY, track and title.

    words: text, start, end in order; videos: a row for each keys with file, width, height, fps, duration and settings, JSON text of any keys. It is parsed to a VARIANT: known
    keys of the right type overlay RENDER_DEFAULTS, others are left alone, and text that isn't JSON overlays nothing. tracks: see caption_track; without one, track is null.
    """
    own = F.try_parse_json(F.col(settings))
    kinds = {"color": "string", "fontWeight": "int", "title": "string", "titleSec": "double", "captionY": "double"}
    known = {k: F.coalesce(F.try_variant_get(own, f"$.{k}", kind), F.lit(RENDER_DEFAULTS[k]).cast(kind)) for k, kind in kinds.items()}
    spoken = words.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct("text", "start", "end").alias("w")))), lambda x: x["w"]).alias("words"))
    rows = videos.join(spoken, keys, "left").join(tracks, keys, "left").withColumns({f"_{k}": v for k, v in known.items()})
    document = F.struct(
        F.struct("file", "width", "height", "fps", "duration").alias("video"), F.coalesce("words", F.array().cast("array<struct<text:string,start:double,end:double>>")).alias("words"), F.struct(F.col("_color").alias("color")).alias("chip"),
        F.col("_fontWeight").alias("fontWeight"), F.col("_captionY").alias("captionY"), "track", F.struct(F.col("_title").alias("text"), F.col("_titleSec").alias("sec")).alias("title"),
    )
    return rows.select(*keys, F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def kept_only(clips: DataFrame) -> DataFrame:
    """The clips that suppression kept (winner null): a loser's files are never written, so there are none to delete."""
    return clips.where("winner IS NULL").drop("winner")
