"""Layout: what a region shows, by rules over measured rectangles, and the verification of layout plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, clamp, contains, corner_distance, expand_to_aspect, inset_window, iou, is_corner_blob, point_in, to_px, to_share, visible_after_cover
from ..params import Framing


def sample_points(a: Column, b: Column, n: int = 3) -> Column:
    """Frames to look at in a region: the middle one if it is short, else distinct ones near the start, middle and end."""
    middle = F.floor((a + b) / 2).cast("long")
    return F.when(b - a <= 8, F.array(middle)).otherwise(F.array_sort(F.array_distinct(F.slice(F.array((a + 2).cast("long"), middle, (b - 3).cast("long")), 1, max(2, n)))))


def choose_camera(faces: DataFrame, blobs: DataFrame, keys: list[str], width: str = "width", height: str = "height", small: float = 0.24) -> DataFrame:
    """keys, cam (array), cam_face (array), conf and full_face_x for each region that has any.

    faces: box, hits, frames, motion (share of the box that moves), and the frame's size; blobs: number, box (moving parts) and the size.
    The camera is on the small face that moves most, then is nearest a corner, most often seen, largest; the moving part that holds its centre is
    the camera, or else the face's surroundings. Without a small face it is the first blob of a corner's size and place.
    """
    W, H = F.col(width).cast("double"), F.col(height).cast("double")
    box = Rect.of(F.col("box"))
    ranked = faces.withColumn("_rank", F.struct(-F.col("motion"), corner_distance(box, W, H), -F.col("hits"), -(box.w * box.h), F.col("box")))
    is_small = box.h < H * small
    picked = ranked.where(is_small).groupBy(*keys).agg(F.min_by(F.struct("box", "hits", "frames", width, height), "_rank").alias("_f"))
    big = ranked.where(~is_small).groupBy(*keys).agg(F.min_by(F.bround((box.x + box.w / 2) / W, 3), F.struct(-F.col("hits"), -(box.w * box.h), "box")).alias("full_face_x"))
    f = Rect.of(F.col("_f.box"))
    held = picked.join(blobs.select(*keys, "number", F.col("box").alias("_blob")), keys, "left").withColumn("_holds", point_in(f.x + f.w / 2, f.y + f.h / 2, Rect.of(F.col("_blob"))))
    held = held.groupBy(*keys, "_f").agg(F.min_by("_blob", F.when(F.col("_holds"), F.col("number"))).alias("_b"), F.max("_holds").alias("_any"))
    whole = lambda c: F.floor(c)
    b = Rect.of(F.when(F.col("_any"), F.col("_b")).otherwise(F.array(F.greatest(F.lit(0.0), whole(f.x - f.w * 0.9)), F.greatest(F.lit(0.0), whole(f.y - f.h * 0.8)), whole(f.w * 2.8).cast("double"), whole(f.h * 3.2).cast("double"))))
    fw, fh = F.col(f"_f.{width}").cast("double"), F.col(f"_f.{height}").cast("double")
    x, y = F.greatest(F.lit(0.0), b.x - whole(fw * 0.004)), F.greatest(F.lit(0.0), b.y - whole(fh * 0.006))
    cam = F.array(x, y, F.least(b.w + whole(fw * 0.008), fw - x), F.least(b.h + whole(fh * 0.012), fh - y))
    by_face = held.select(*keys, cam.alias("cam"), F.col("_f.box").alias("cam_face"), (F.col("_f.hits") / F.col("_f.frames")).alias("conf"))
    corner = blobs.where(is_corner_blob(Rect.of(F.col("box")), W, H)).groupBy(*keys).agg(F.min_by("box", "number").alias("_corner"))
    out = by_face.join(corner, keys, "full").join(big, keys, "full")
    return out.select(*keys, F.coalesce("cam", F.col("_corner").cast("array<double>")).alias("cam"), "cam_face", F.coalesce("conf", F.when(F.col("_corner").isNotNull(), 0.3)).alias("conf"), "full_face_x")


def choose_motion(blobs: DataFrame, cams: DataFrame, keys: list[str], width: str = "width") -> DataFrame:
    """keys and motion (array): the hull of the best moving part outside the camera, by area weighted to the middle, and of those near its column."""
    box = Rect.of(F.col("box"))
    cx, cy = box.centre()
    out = blobs.join(cams.select(*keys, "cam"), keys, "left").where(F.col("cam").isNull() | ~point_in(cx, cy, Rect.of(F.col("cam"))))
    across = cx / F.col(width)
    best = out.groupBy(*keys).agg(F.min_by("box", F.struct(-(box.w * box.h * (0.35 + F.least(across, 1 - across))), "number")).alias("_best"))
    b = Rect.of(F.col("_best"))
    near = out.join(best, keys).where((F.col("box") == F.col("_best")) | (F.abs(cx - (b.x + b.w / 2)) < b.w * 0.75))
    hull = near.groupBy(*keys).agg(F.min(box.x).alias("x"), F.min(box.y).alias("y"), F.max(box.x + box.w).alias("x2"), F.max(box.y + box.h).alias("y2"))
    return hull.select(*keys, F.array(*[c.cast("double") for c in (F.col("x"), F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))]).alias("motion"))


def choose_content(regions: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """regions (cam, motion, full_face_x) with panel, content, content_source, void and suggest. panels: number, box; those whose middle the camera holds don't count."""
    own = panels.join(regions.select(*keys, "cam"), keys, "left")
    outside = F.col("cam").isNull() | ~point_in(*Rect.of(F.col("box")).centre(), Rect.of(F.col("cam")))
    m = regions.join(own.where(outside).select(*keys, "number", F.col("box").alias("_p")), keys, "left").withColumn("_holds", F.coalesce(contains(Rect.of(F.col("_p")), Rect.of(F.col("motion"))), F.lit(False)))
    first = m.groupBy(*keys).agg(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.struct(~F.col("_holds"), "number"))).alias("panel"))
    out = regions.join(first, keys, "left")
    use = F.col("panel").isNotNull() & (F.col("motion").isNull() | F.coalesce(contains(Rect.of(F.col("panel")), Rect.of(F.col("motion"))), F.lit(False)))
    out = out.withColumn("content", F.when(use, F.col("panel")).otherwise(F.col("motion"))).withColumn("content_source", F.when(use, "panel").when(F.col("motion").isNotNull(), "motion"))
    out = out.withColumn("void", F.col("motion").isNull() & F.col("panel").isNull())
    return out.withColumn("suggest", suggestion(F.col("full_face_x"), F.col("void"), F.col("cam").isNotNull(), F.col("content").isNotNull()))


def suggestion(full_face_x: Column, void: Column, cam: Column, content: Column) -> Column:
    return F.when(full_face_x.isNotNull(), F.concat(F.lit("crop face_x="), full_face_x.cast("string"))).when(void & cam, "zoom on cam").when(cam & content, "split").otherwise("full")


def verify_plan(plan: DataFrame, probe: DataFrame, keys: list[str], p: Framing | None = None) -> DataFrame:
    """The plan's regions as they may be rendered, with verdict (OK, FIXED, DEMOTED, STRUCTURAL, NO-PROBE) and notes.

    plan: region, in_frame, out_frame, mode, face_x, inset, content, zone (shares), rects_from, width, height. probe: ord, in_frame,
    out_frame, cam, cam_face (shares), full_face_x, n_faces, void. The last probe of equal frames counts. One left join, then expressions:
    a split is demoted if its content is void or nothing was measured, structural if its inset and the camera are different things, and else
    snapped to the camera; a crop follows the full-frame face; a zoom snaps to a camera that it shows. Verifying a verified plan changes nothing.
    """
    from .bands import last_wins

    p = p or Framing()
    measured = last_wins(probe.select(*keys, "in_frame", "out_frame", "ord", "cam", "cam_face", "full_face_x", "n_faces", "void"), [*keys, "in_frame", "out_frame"], "ord").drop("ord").withColumn("_probed", F.lit(True))
    rows = plan.join(measured, [*keys, "in_frame", "out_frame"], "left")
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    rect = lambda c: Rect.of(F.col(c))
    whole_frame = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])
    # Each step's columns are used many times by the next, so they are columns: an expression of all steps would repeat them.
    rows = rows.withColumns({
        "_mode": F.coalesce("mode", F.lit("full")), "_hand": F.coalesce(F.col("rects_from") == "still", F.lit(False)), "_has_cam": F.col("cam").isNotNull(), "_has_face": F.col("cam").isNotNull() & F.col("cam_face").isNotNull(),
        "_cam": to_px(rect("cam"), W, H).array(), "_face": to_px(rect("cam_face"), W, H).array(), "_inset": to_px(rect("inset"), W, H).array(), "_zone": to_px(rect("zone"), W, H).array(),
        "_content": to_px(Rect.of(F.coalesce("content", whole_frame)), W, H).array(), "_agree": iou(rect("inset"), rect("cam")), "_zone_agree": iou(rect("zone"), rect("cam")), "void": F.coalesce("void", F.lit(False)), "_probed": F.coalesce("_probed", F.lit(False)),
    })
    hand, has_cam, has_face, void, mode = (F.col(c) for c in ("_hand", "_has_cam", "_has_face", "void", "_mode"))
    split, crop, zoom = mode == "split", mode == "crop", mode == "zoom"
    agree, measured_cam = F.col("_agree"), F.col("_has_cam") & ~F.col("_hand")
    cam, face = rect("_cam"), rect("_face")
    fcx, fcy = face.centre()
    rows = rows.withColumns({
        "_split_out": split & ~hand & (void | (~has_cam & (F.coalesce("n_faces", F.lit(0)) == 0))),
        "_seed": F.when(measured_cam, F.col("_cam")).otherwise(F.col("_inset")), "_elsewhere": hand & has_face & ~F.coalesce(point_in(fcx, fcy, rect("_inset")), F.lit(False)),
        "_grown": expand_to_aspect(rect("_content"), p.pane, W, H).array(), "_grown_zone": expand_to_aspect(rect("_zone"), 1.0, W, H).array(), "_cam_window": inset_window(cam, face, has_face, W, H, p.pane).array(),
    })
    split_out, elsewhere = F.col("_split_out"), F.col("_elsewhere")
    rows = rows.withColumn("_window", inset_window(rect("_seed"), face, has_face & ~elsewhere, W, H, p.pane).array())
    rows = rows.withColumn("_seen", F.coalesce(point_in(fcx, fcy, visible_after_cover(rect("_window"), p.pane), 0.06), F.lit(False)))
    structural = split & ~split_out & measured_cam & (agree < 0.05)
    face_lost = split & ~split_out & ~structural & has_face & ~elsewhere & ~F.col("_seen")
    grew = F.exists(F.arrays_zip("_grown", "_content"), lambda z: F.bround(z["_grown"]) != F.bround(z["_content"]))
    whole = lambda c: to_share(Rect(*[F.floor(x) for x in rect(c)]), W, H).array()

    # crop
    column = H * p.column
    centre = clamp(F.coalesce("face_x", F.lit(0.5)) * W, column / 2, W - column / 2)
    full_px = F.col("full_face_x") * W
    leaving = crop & F.col("full_face_x").isNotNull() & ~full_px.between(centre - column / 2 + column * 0.12, centre - column / 2 + column * 0.88)
    crop_out = crop & F.col("full_face_x").isNull()

    # zoom
    zone_px = rect("_zone")
    on_cam = zoom & ~hand & has_cam & ((F.col("_zone_agree") >= 0.5) | contains(zone_px, cam, 0.7))
    zoom_out = zoom & ~hand & ~on_cam & void
    tall = zoom & ~on_cam & ~zoom_out & (zone_px.w / zone_px.h < 1.0)
    rows = rows.withColumns({"_structural": structural, "_face_lost": face_lost, "_grew": grew, "_crop_out": crop_out, "_leaving": F.coalesce(leaving, F.lit(False)), "_on_cam": F.coalesce(on_cam, F.lit(False)), "_zoom_out": F.coalesce(zoom_out, F.lit(False)), "_tall": F.coalesce(tall, F.lit(False))})
    structural, face_lost, grew, crop_out, leaving, on_cam, zoom_out, tall = (F.col(c) for c in ("_structural", "_face_lost", "_grew", "_crop_out", "_leaving", "_on_cam", "_zoom_out", "_tall"))

    demoted = split_out | face_lost | crop_out | zoom_out
    probed = F.col("_probed")
    text = lambda r: F.concat(F.lit("["), F.array_join(r.cast("array<string>"), ", "), F.lit("]"))
    notes = F.array_compact(F.array(
        F.when(split_out & void, "content pane is VOID (screen idle)"), F.when(split_out & ~void, "no cam / no face measured"),
        F.when(structural, F.concat(F.lit("plan inset "), text(F.col("inset")), F.lit(" and measured cam "), text(F.col("cam")), F.lit(" are different objects"))),
        F.when(split & ~split_out & ~structural & measured_cam & (agree < 0.35), F.concat(F.lit("inset corrected: plan "), text(F.col("inset")), F.lit(" -> measured cam "), text(F.col("cam")))),
        F.when(split & hand, "rects_from=still: plan inset honoured (aspect-expand only)"), F.when(split & hand & (elsewhere | ~has_face), "face check skipped (hand-drawn rects)"),
        F.when(face_lost, "face outside the streamer pane after centering"), F.when(split & ~split_out & ~structural & ~face_lost & grew, "content expanded to pane aspect"),
        F.when(crop_out, "no full-frame face measured"), F.when(leaving, "face_x corrected (face was leaving the column)"),
        F.when(zoom & hand, "rects_from=still: zone honoured (tall-widen only)"), F.when(on_cam, "zoom-on-cam: zone snapped to measured cam"), F.when(zoom_out, "zoom zone is VOID"), F.when(tall, "tall zone widened to 1:1+"),
        F.when(demoted & F.col("full_face_x").isNotNull(), "demoted -> crop"), F.when(demoted & F.col("full_face_x").isNull(), "demoted -> full"),
    ))
    verdict = F.when(~probed, "NO-PROBE").when(structural, "STRUCTURAL").when(demoted, "DEMOTED").when(F.size(notes) > 0, "FIXED").otherwise("OK")
    act = probed & ~structural
    sharing = act & split & ~demoted
    out_mode = F.when(act & demoted, F.when(F.col("full_face_x").isNotNull(), "crop").otherwise("full")).otherwise(mode)
    keep = lambda c, when: F.when(when, c)
    stays = ~(act & demoted)
    return rows.select(
        *keys, "region", "in_frame", "out_frame", out_mode.alias("mode"), F.when(act & (demoted | leaving), F.col("full_face_x")).otherwise(F.col("face_x")).alias("face_x"),
        F.when(sharing, whole("_window")).otherwise(keep(F.col("inset"), stays)).alias("inset"), F.when(sharing, to_share(rect("_grown"), W, H).array()).otherwise(keep(F.col("content"), stays)).alias("content"),
        F.when(act & on_cam, whole("_cam_window")).when(act & tall, to_share(rect("_grown_zone"), W, H).array()).otherwise(keep(F.col("zone"), stays)).alias("zone"),
        keep(F.col("rects_from"), stays).alias("rects_from"), "width", "height", verdict.alias("verdict"), F.when(~probed, F.array(F.lit("no probe data for this region"))).otherwise(notes).alias("notes"),
    )
