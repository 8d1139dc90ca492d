"""Track statistics, hygiene and id remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .covisible import covisible_pairs  # noqa: F401  part of this module's interface
from .selection import medians, same


def track_summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id", "person_id").agg(F.countDistinct("frame_idx").alias("num_frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def drop_short_tracks(detections: DataFrame, least: int) -> DataFrame:
    short = detections.groupBy("video_id", "person_id").agg(F.countDistinct("frame_idx").alias("n")).where(F.col("n") < least)
    return detections.join(short, ["video_id", "person_id"], "left_anti")


def drop_poor_fits(rows: DataFrame, valid: str, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks whose share of valid rows is below the least go."""
    poor = rows.groupBy("video_id", "person_id").agg(F.avg(F.col(valid).cast("double")).alias("share")).where(F.col("share") < cfg.min_body_fit)
    return rows.join(poor, ["video_id", "person_id"], "left_anti")


def max_ids(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id").agg(F.max("person_id").alias("max_id"))


def frame_range(detections: DataFrame) -> DataFrame:
    return detections.agg(F.min("frame_idx").alias("start"), (F.max("frame_idx") + 1).alias("stop"))


def max_persons(detections: DataFrame) -> DataFrame:
    per_video = detections.groupBy("video_id").agg(F.countDistinct("person_id").alias("n"))
    return per_video.agg(F.max("n").alias("max_persons"))


def person_slots(detections: DataFrame) -> DataFrame:
    """Each person's slot in a video: the rank of its id, from 0."""
    ids = detections.select("video_id", "person_id").distinct()
    return ids.withColumn("slot", (F.row_number().over(Window.partitionBy("video_id").orderBy("person_id")) - 1).cast("int"))


def shape_median(joints: DataFrame) -> DataFrame:
    """Median over frames of each coordinate."""
    found = medians(joints, ["scene_id", "video_id", "person_id", "joint"], ["x", "y", "z"])
    return found.withColumnsRenamed({c: f"med_{c}" for c in ("x", "y", "z")})


def six_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, standard deviation, least, greatest and number of the values of each
    group; groups may have any size (see ``selection``)."""
    v = F.col(value)
    sums = rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    middle = medians(rows, keys, [value])
    out = sums.alias("l").join(middle.alias("r"), same(keys))
    return out.select(*[f"l.{k}" for k in keys], "mean", F.col(f"r.{value}").alias("median"), "std", "min", "max", "n")


def named_statistics(rows: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """The six statistics of every name; one without values has NaN and a count of 0."""
    nan = F.lit(float("nan"))
    found = names.select(key).distinct().join(six_statistics(rows, [key], value), key, "left")
    return found.select(key, *[F.coalesce(c, nan).alias(c) for c in ("mean", "median", "std", "min", "max")], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def id_merges(raw: DataFrame, remap: DataFrame) -> DataFrame:
    """Distinct ids of each video before and after a remap, and how many were merged."""
    new = F.coalesce("new_id", "person_id")
    rows = raw.join(remap.withColumnRenamed("old_id", "person_id"), ["video_id", "person_id"], "left")
    out = rows.groupBy("video_id").agg(F.countDistinct("person_id").alias("n_before"), F.countDistinct(new).alias("n_after"))
    return out.withColumn("n_merged", F.col("n_before") - F.col("n_after"))


def remap_labels(detections: DataFrame, remap: DataFrame) -> DataFrame:
    """Labels under new ids; where two meet in a frame, one that kept its id wins,
    then the earlier one, and a remapped row that loses keeps its old id."""
    rows = detections.join(remap.select("video_id", F.col("old_id").alias("person_id"), "new_id"), ["video_id", "person_id"], "left")
    rows = rows.withColumn("wanted", F.coalesce("new_id", "person_id")).withColumn("moved", (F.col("new_id").isNotNull() & (F.col("new_id") != F.col("person_id"))).cast("int"))
    place = F.row_number().over(Window.partitionBy("video_id", "frame_idx", "wanted").orderBy("moved", "ord"))
    return rows.withColumn("place", place).withColumn("final_id", F.when((F.col("place") == 1) | (F.col("moved") == 0), F.col("wanted")).otherwise(F.col("person_id"))).select(*detections.columns, "final_id")


def remap_pixels(mask_rows: DataFrame, remap: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pixel counts of ids in frames under new ids; an id that covers most of the
    image in a frame keeps its old id there and is flagged."""
    rows = mask_rows.join(remap.select("video_id", F.col("old_id").alias("person_id"), "new_id"), ["video_id", "person_id"], "left")
    wide = F.col("pixels") > cfg.cover_limit * F.col("img_w") * F.col("img_h")
    return rows.withColumn("guarded", wide & F.col("new_id").isNotNull()).withColumn("final_id", F.when(F.col("guarded"), F.col("person_id")).otherwise(F.coalesce("new_id", "person_id"))).drop("new_id")


def remap_runs(runs: DataFrame, remap: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mask runs under new ids.  Ids that no remap names are kept; one that covers
    most of the image in a frame keeps its old id there (``guarded``)."""
    keys = ["video_id", "frame_idx", "person_id"]
    size = runs.groupBy(*keys).agg(F.sum(F.col("x_end") - F.col("x_start") + 1).alias("pixels"), F.first("img_w").alias("img_w"), F.first("img_h").alias("img_h"))
    ids = remap_pixels(size, remap, cfg).select(*keys, "final_id", "guarded")
    return runs.join(ids, keys)


def unmapped_ids(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """The ids of each video that are not the background and that no remap names."""
    ids = rows.where("person_id <> 0").select("video_id", "person_id").distinct()
    return ids.join(remap.select("video_id", F.col("old_id").alias("person_id")).distinct(), ["video_id", "person_id"], "left_anti")


def remap_keyed(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """Params, gallery or summary under new ids: rows keyed by ``video_id`` and ``person_id``."""
    found = rows.join(remap.select("video_id", F.col("old_id").alias("person_id"), "new_id").distinct(), ["video_id", "person_id"], "left")
    return found.withColumn("person_id", F.coalesce("new_id", "person_id")).select(*rows.columns)


def remap_tracks(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """As ``remap_keyed``, with at most one track of a video under each id: of tracks that meet,
    one that keeps its id wins, then that of the least old id, and the others keep theirs."""
    names = remap.groupBy("video_id", F.col("old_id").alias("person_id")).agg(F.min("new_id").alias("new_id"))
    ids = rows.select("video_id", "person_id").distinct().join(names, ["video_id", "person_id"], "left")
    ids = ids.withColumns({"wanted": F.coalesce("new_id", "person_id"), "moved": F.col("new_id").isNotNull() & (F.col("new_id") != F.col("person_id"))})
    place = F.row_number().over(Window.partitionBy("video_id", "wanted").orderBy("moved", "person_id"))
    final = ids.select("video_id", "person_id", F.when(place == 1, F.col("wanted")).otherwise(F.col("person_id")).alias("final_id"))
    found = rows.join(final, ["video_id", "person_id"])
    return found.withColumn("person_id", F.col("final_id").cast(rows.schema["person_id"].dataType)).select(*rows.columns)


def observed_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Names of the fields that a group has in any row, sorted."""
    there = F.array_compact(F.array(*[F.when(F.count(f) > 0, F.lit(f)) for f in fields]))
    return rows.groupBy(*keys).agg(F.array_sort(there).alias("fields"))


def draw_list(frames: DataFrame, labels: DataFrame, params: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Everything to draw in each frame: its labels, and each label's body and mask where they are there."""
    keys = ["video_id", "frame_idx"]
    out = frames.join(labels, keys, "left").join(params, [*keys, "person_id"], "left")
    return out if masks is None else out.join(masks, [*keys, "person_id"], "left")


def first_available(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows with missing array fields filled by zeros shaped like the first that is there;
    fields that are missing everywhere in a group stay null."""
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zeros = lambda f: F.array_repeat(F.lit(0.0), F.size(F.first(f, True).over(w))).cast(rows.schema[f].dataType)
    there = lambda f: F.first(f, True).over(w).isNotNull()
    return rows.withColumns({f: F.coalesce(f, F.when(there(f), zeros(f))) for f in fields})


def array_ranges(rows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Least and greatest component of an array column by group."""
    return rows.groupBy(*keys).agg(F.min(F.array_min(array)).alias("least"), F.max(F.array_max(array)).alias("greatest"))


def running_best(log: DataFrame, keys: list[str], order: str, loss: str, patience: int) -> DataFrame:
    """Best loss so far, epochs since it was reached, and whether to stop there."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("improved", F.coalesce(F.col(loss) < before, F.lit(True)))
    rows = rows.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("improved"), F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("since_best", (F.col(order) - last).cast("int")).withColumn("stop", F.col("since_best") >= patience)
