"""Cleaning of detections, boxes and masks (DataFrame in, DataFrame out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def parse_frame_labels(frames: DataFrame, json_col: str = "json", path_col: str = "path") -> DataFrame:
    """A frame's label file as rows: person id, box, score; the frame number comes from the name."""
    kind = "struct<labels: map<string, struct<instance_id: int, class_name: string, x1: double, y1: double, x2: double, y2: double, score: double>>>"
    labels = F.coalesce(F.from_json(F.col(json_col), kind)["labels"], F.create_map().cast("map<string, struct<instance_id: int, class_name: string, x1: double, y1: double, x2: double, y2: double, score: double>>"))
    name = F.element_at(F.split(path_col, "/"), -1)
    rows = frames.withColumn("frame_idx", F.regexp_extract(name, r"mask_(\d+)", 1).cast("int")).withColumn("labels", labels)
    # outer, and then without the frames that had none: the plain form is given a filter that parses the text again
    boxes = rows.select(*[c for c in frames.columns if c != json_col], "frame_idx", F.posexplode_outer("labels").alias("ord", "person", "box")).where("ord IS NOT NULL")
    return boxes.select("*", F.col("person").cast("long").alias("person_id"), "box.*").drop("person", "box", "labels")


def above_score(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return rows.where(F.col("score") >= cfg.new_detection_score)


def drop_degenerate(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Boxes with a side below the least, or over most of the image, go."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where((w >= cfg.min_box_side) & (h >= cfg.min_box_side) & (w * h <= cfg.cover_limit * F.col("img_w") * F.col("img_h")))


def pad_boxes(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Boxes widened by a share of their sides (whole pixels) and clamped to the image."""
    px = ((F.col("x2") - F.col("x1")) * F.lit(cfg.box_padding)).cast("int")
    py = ((F.col("y2") - F.col("y1")) * F.lit(cfg.box_padding)).cast("int")
    zero = F.lit(0)
    return boxes.select(
        *[c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")],
        F.greatest(zero, F.col("x1") - px).alias("x1"), F.greatest(zero, F.col("y1") - py).alias("y1"),
        F.least("img_w", F.col("x2") + px).alias("x2"), F.least("img_h", F.col("y2") + py).alias("y2"),
    )


def normalised_boxes(boxes: DataFrame) -> DataFrame:
    """Left, top, width and height as shares of the image; a missing score is 1."""
    d = lambda a, b: F.col(a).cast("double") / F.col(b)
    return boxes.withColumns({
        "nx": d("x1", "img_w"), "ny": d("y1", "img_h"),
        "nw": (F.col("x2") - F.col("x1")).cast("double") / F.col("img_w"), "nh": (F.col("y2") - F.col("y1")).cast("double") / F.col("img_h"),
        "score": F.coalesce("score", F.lit(1.0)),
    })


def compose_runs(runs: DataFrame, keys: list[str], person: str = "person_id", order: str = "ord") -> DataFrame:
    """Committed runs: where objects overlap, the one of greatest order stays.

    A row of an image is cut at all ends of its runs, and each piece goes to the
    last object that covers it; pixels are never made into rows.  What is gathered
    is the runs of one image row.
    """
    row = runs.groupBy(*keys, "y").agg(F.collect_list(F.struct(F.col(order).alias("o"), F.col(person).alias("p"), F.col("x_start").alias("a"), F.col("x_end").alias("e"))).alias("runs"))
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("runs", lambda r: r["a"]), F.transform("runs", lambda r: r["e"] + 1))))

    def piece(k: Column) -> Column:
        start, stop = F.get("ends", k), F.get("ends", k + 1) - 1
        over = F.array_max(F.filter("runs", lambda r: (r["a"] <= start) & (r["e"] >= stop)))
        return F.struct(start.alias("x_start"), stop.alias("x_end"), over["p"].alias(person))

    pieces = F.transform(F.sequence(F.lit(0), F.size("ends") - 2), piece)
    return row.where(F.size("runs") > 0).withColumn("ends", ends).where(F.size("ends") > 1).select(*keys, "y", F.inline(pieces)).where(F.col(person).isNotNull())


def mask_boxes(runs: DataFrame, keys: list[str], person: str = "person_id") -> DataFrame:
    """Inclusive bounds and pixel count of each object's committed runs."""
    return runs.groupBy(*keys, person).agg(F.min("x_start").alias("x1"), F.min("y").alias("y1"), F.max("x_end").alias("x2"), F.max("y").alias("y2"), F.sum(F.col("x_end") - F.col("x_start") + 1).alias("pixels"))


def stored_ids(rows: DataFrame, person: str = "person_id") -> DataFrame:
    """Ids as they stand in masks: one more, since 0 is the background."""
    return rows.withColumn(person, F.col(person) + 1)


def labelled_frames(frames: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of frames that are there; frames without labels and labels without a frame drop out."""
    return labels.join(frames.select(*keys).distinct(), keys, "left_semi")


def field_set(rows: DataFrame, converted: bool, raw: list[str], smplx: list[str], always: list[str]) -> DataFrame:
    """The fields that are stored: the converted set where a converter is there, else the raw one, and those of both."""
    wanted = [*(smplx if converted else raw), *always]
    return rows.select(*[c for c in rows.columns if c not in {*raw, *smplx, *always}], *[c for c in wanted if c in rows.columns])


def well_filled(masks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Masks with pixels that fill enough of their (inclusive) box and not too much of the image."""
    area = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    rows = masks.withColumn("fill_ratio", F.col("pixels") / area)
    return rows.where((F.col("pixels") == 0) | (F.col("fill_ratio") >= cfg.min_fill_ratio)).where(F.col("pixels") <= cfg.cover_limit * F.col("img_w") * F.col("img_h"))


def every_nth_frame(rows: DataFrame, step: int) -> DataFrame:
    return rows.where(F.pmod("frame_idx", F.lit(step)) == 0) if step > 1 else rows


def nth_usable_frame(boxes: DataFrame, n: int = 1, cfg: Config = DEFAULT) -> DataFrame:
    """The ``n``-th frame, in frame order, that has a box of the least side or more."""
    big = (F.col("x2") - F.col("x1") >= cfg.min_box_side) & (F.col("y2") - F.col("y1") >= cfg.min_box_side)
    frames = boxes.where(big).select("frame_idx").distinct().orderBy("frame_idx").limit(n)
    return frames.orderBy(F.desc("frame_idx")).limit(1)


def resized(frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Size of a frame after its longer side is brought down to the limit (half rounds to even)."""
    longest = F.greatest("img_w", "img_h")
    to = lambda c: F.when(longest > cfg.max_side, F.bround(F.col(c) * F.lit(float(cfg.max_side)) / longest)).otherwise(F.col(c)).cast("int")
    return frames.withColumns({"out_w": to("img_w"), "out_h": to("img_h")})


def with_label_text(ids: DataFrame, remap: DataFrame) -> DataFrame:
    """Draw text of each person: its number, and the raw ids that were merged into it."""
    raw = remap.groupBy(F.col("new_id").alias("person_id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("old_id").cast("long"))).cast("array<string>"), ", ").alias("raw"))
    text = F.concat(F.lit("P"), F.col("person_id"))
    return ids.join(raw, "person_id", "left").withColumn("label_text", F.when(F.col("raw").isNull(), text).otherwise(F.concat(text, F.lit("  [SAM2: "), F.col("raw"), F.lit("]")))).drop("raw")


def palette_index(rows: DataFrame, size: int = 8) -> DataFrame:
    return rows.withColumn("palette", (F.col("person_id") % size).cast("int"))


def first_scenes(rows: DataFrame, n: int, scene: str = "scene_id") -> DataFrame:
    """Rows of the first ``n`` scenes by name."""
    return rows.join(F.broadcast(rows.select(scene).distinct().orderBy(scene).limit(n)), scene, "left_semi")


def without_ego(videos: DataFrame, stem: str = "stem", drop_aria: bool = True) -> DataFrame:
    s = F.col(stem)
    keep = ~s.startswith("ego_preview")
    return videos.where(keep & ~s.startswith("aria")) if drop_aria else videos.where(keep)


def scenes_with_videos(videos: DataFrame, least: int = 2) -> DataFrame:
    return videos.groupBy("scene_id").agg(F.countDistinct("video_id").alias("n_videos")).where(F.col("n_videos") >= least)


def location_stem(rows: DataFrame, name: str) -> DataFrame:
    """The part of a name before ``_ddd_``, or all of it."""
    got = F.regexp_extract(F.col(name), r"^(.+?)_\d{3}_", 1)
    return rows.withColumn("location", F.when(got == "", F.col(name)).otherwise(got))


def row_rank(keys: list[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
