"""Queries over detections, boxes and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections as det
from ..operators import tracks as trk
from ..sources import adapters as ad
from ..sources.adapters import ctes
from .catalogue import query


@query(ctes("detections") + """SELECT video_id, person_a, person_b, count(*) AS n_frames FROM (
  SELECT DISTINCT a.video_id, a.frame_idx, a.person_id AS person_a, b.person_id AS person_b
  FROM detections a JOIN detections b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.person_id < b.person_id)
GROUP BY ALL HAVING count(*) >= 3""")
def covisible_pairs(spark, sf_dir):
    return trk.covisible_pairs(ad.detections(spark, sf_dir))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def label_json_explode(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,int>"))
    return rows.select("event_id", F.explode("m").alias("key", "k")).where("key = 'k'").select("event_id", "k")


@query(ctes("detections") + "SELECT video_id, frame_idx, person_id, score FROM detections WHERE score >= 0.4")
def score_filter(spark, sf_dir):
    return det.above_score(ad.detections(spark, sf_dir)).select("video_id", "frame_idx", "person_id", "score")


@query(ctes("detections") + """SELECT video_id, frame_idx, person_id, ord FROM detections WHERE (video_id, person_id) NOT IN (
  SELECT (video_id, person_id) FROM detections GROUP BY video_id, person_id HAVING count(DISTINCT frame_idx) < 8)""")
def short_tracks(spark, sf_dir):
    return trk.drop_short_tracks(ad.detections(spark, sf_dir), 8).select("video_id", "frame_idx", "person_id", "ord")


@query(ctes("detections") + """SELECT d.video_id, d.frame_idx, d.person_id, d.ord FROM detections d JOIN (
  SELECT video_id, person_id FROM detections GROUP BY ALL HAVING avg(CASE WHEN score >= 0.2 THEN 1.0 ELSE 0.0 END) >= 0.30) USING (video_id, person_id)""")
def body_fit_prune(spark, sf_dir):
    rows = ad.detections(spark, sf_dir).withColumn("valid", F.col("score") >= 0.2)
    return trk.drop_poor_fits(rows, "valid").select("video_id", "frame_idx", "person_id", "ord")


_CLEAN = "x2-x1 >= 10 AND y2-y1 >= 10 AND (x2-x1)*(y2-y1) <= 0.80*img_w*img_h"


@query(ctes("boxes") + f"""SELECT frame_idx, ord, greatest(0, x1-px) AS x1, greatest(0, y1-py) AS y1, least(img_w, x2+px) AS x2, least(img_h, y2+py) AS y2
FROM (SELECT *, CAST(floor((x2-x1)*0.2::DOUBLE) AS INT) AS px, CAST(floor((y2-y1)*0.2::DOUBLE) AS INT) AS py FROM boxes WHERE {_CLEAN})""")
def bbox_clean_pad(spark, sf_dir):
    return det.pad_boxes(det.drop_degenerate(ad.boxes(spark, sf_dir))).select("frame_idx", "ord", "x1", "y1", "x2", "y2")


@query(ctes("boxes") + "SELECT frame_idx, ord, x1::DOUBLE/img_w AS nx, y1::DOUBLE/img_h AS ny, (x2-x1)::DOUBLE/img_w AS nw, (y2-y1)::DOUBLE/img_h AS nh, coalesce(nullif(score, 0), 1.0) AS score FROM boxes")
def bbox_norm_xywh(spark, sf_dir):
    rows = ad.boxes(spark, sf_dir).withColumn("score", F.nullif("score", F.lit(0.0)))
    return det.normalised_boxes(rows).select("frame_idx", "ord", "nx", "ny", "nw", "nh", "score")


_RUNS = "SELECT frame_idx, ord, ord AS person_id, y1 AS y, x1 AS x_start, greatest(x1, x2) AS x_end, img_w, img_h FROM boxes"
_PIXELS = "SELECT frame_idx, y, x, arg_max(person_id, ord) AS person_id FROM (SELECT frame_idx, y, ord, person_id, unnest(range(x_start, x_end+1)) AS x FROM runs) GROUP BY frame_idx, y, x"


def _committed(spark, sf_dir):
    runs = ad.boxes(spark, sf_dir).selectExpr("frame_idx", "ord", "ord AS person_id", "y1 AS y", "x1 AS x_start", "greatest(x1, x2) AS x_end")
    return det.compose_runs(runs, ["frame_idx"])


@query(ctes("boxes", runs=_RUNS, pixels=_PIXELS) + "SELECT frame_idx, person_id, CAST(min(x) AS INT) AS x1, min(y) AS y1, CAST(max(x) AS INT) AS x2, max(y) AS y2, count(*) AS pixels FROM pixels GROUP BY frame_idx, person_id")
def mask_bbox_compose(spark, sf_dir):
    return det.mask_boxes(_committed(spark, sf_dir), ["frame_idx"])


@query(ctes("boxes") + """SELECT frame_idx, ord, pixels, fill_ratio FROM (
  SELECT *, pixels::DOUBLE/((x2-x1+1)*(y2-y1+1)) AS fill_ratio FROM (SELECT *, CAST(score * 4 * (x2-x1+1) AS BIGINT) AS pixels FROM boxes WHERE x2 >= x1 AND y2 >= y1))
WHERE (pixels = 0 OR fill_ratio >= 0.10) AND pixels <= 0.80*img_w*img_h""")
def fill_ratio(spark, sf_dir):
    rows = ad.boxes(spark, sf_dir).where("x2 >= x1 AND y2 >= y1").withColumn("pixels", F.round(F.col("score") * 4 * (F.col("x2") - F.col("x1") + 1)).cast("long"))
    return det.well_filled(rows).select("frame_idx", "ord", "pixels", "fill_ratio")


@query(ctes("boxes") + "SELECT max(frame_idx) AS frame_idx FROM (SELECT DISTINCT frame_idx FROM boxes WHERE x2-x1 >= 10 AND y2-y1 >= 10 ORDER BY frame_idx LIMIT 5)")
def nth_usable_frame(spark, sf_dir):
    return det.nth_usable_frame(ad.boxes(spark, sf_dir), 5)


@query("SELECT p_partkey, CAST(CASE WHEN m > 1440 THEN round_even(w * 1440.0::DOUBLE / m, 0) ELSE w END AS INT) AS out_w, CAST(CASE WHEN m > 1440 THEN round_even(h * 1440.0::DOUBLE / m, 0) ELSE h END AS INT) AS out_h FROM (SELECT p_partkey, w, h, greatest(w, h) AS m FROM (SELECT p_partkey, CAST(p_partkey % 4000 + 100 AS INT) AS w, p_size * 60 AS h FROM part))")
def resize_rule(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 4000 + 100 AS INT) AS img_w", "p_size * 60 AS img_h")
    return det.resized(rows).select("p_partkey", "out_w", "out_h")


@query(ctes("detections") + "SELECT video_id, person_id, count(DISTINCT frame_idx) AS num_frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM detections GROUP BY ALL")
def track_summary(spark, sf_dir):
    return trk.track_summary(ad.detections(spark, sf_dir))


@query(ctes("detections") + "SELECT video_id, max(person_id) AS max_id FROM detections GROUP BY ALL")
def max_person_id(spark, sf_dir):
    return trk.max_ids(ad.detections(spark, sf_dir))


@query(ctes("detections") + "SELECT min(frame_idx) AS start, max(frame_idx) + 1 AS stop FROM detections")
def global_frame_range(spark, sf_dir):
    return trk.frame_range(ad.detections(spark, sf_dir))


@query(ctes("detections") + "SELECT max(n) AS max_persons FROM (SELECT count(DISTINCT person_id) AS n FROM detections GROUP BY video_id)")
def max_persons(spark, sf_dir):
    return trk.max_persons(ad.detections(spark, sf_dir))


@query(ctes("detections") + "SELECT video_id, person_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY person_id) - 1 AS INT) AS slot FROM (SELECT DISTINCT video_id, person_id FROM detections)")
def person_slots(spark, sf_dir):
    return trk.person_slots(ad.detections(spark, sf_dir))


@query("SELECT event_type AS metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY 1")
def metric_summary(spark, sf_dir):
    out = trk.six_statistics(ad.table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric"), ["metric"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("SELECT user_id % 7 AS loss, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM events WHERE value > 5 GROUP BY 1")
def loss_summary(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").where("value > 5").selectExpr("user_id % 7 AS loss", "value")
    return trk.six_statistics(rows, ["loss"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")}).drop("n")


@query(ctes("detections") + "SELECT video_id, frame_idx, person_id, ord FROM detections WHERE frame_idx % 5 = 0")
def frame_step(spark, sf_dir):
    return det.every_nth_frame(ad.detections(spark, sf_dir), 5).select("video_id", "frame_idx", "person_id", "ord")


@query(ctes("joints") + "SELECT scene_id, video_id, person_id, joint, round(median(x), 6) AS med_x, round(median(y), 6) AS med_y, round(median(z), 6) AS med_z FROM joints GROUP BY ALL")
def shape_median(spark, sf_dir):
    return trk.shape_median(ad.joints(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("med_x", "med_y", "med_z")})


_REMAP = "SELECT DISTINCT video_id, person_id AS old_id, person_id // 3 AS new_id FROM detections WHERE person_id % 3 = 1"


def _remap(rows):
    return rows.where("person_id % 3 = 1").selectExpr("video_id", "person_id AS old_id", "person_id DIV 3 AS new_id").distinct()


@query(ctes("detections", remap=_REMAP) + """SELECT video_id, frame_idx, person_id, ord, CASE WHEN place = 1 OR moved = 0 THEN wanted ELSE person_id END AS final_id FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, wanted ORDER BY moved, ord) AS place FROM (
    SELECT d.*, coalesce(new_id, person_id) AS wanted, CASE WHEN new_id IS NOT NULL AND new_id <> person_id THEN 1 ELSE 0 END AS moved
    FROM detections d LEFT JOIN remap r ON d.video_id = r.video_id AND d.person_id = r.old_id))""")
def remap_labels(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    return trk.remap_labels(rows, _remap(rows)).select("video_id", "frame_idx", "person_id", "ord", "final_id")


@query(ctes("detections", remap=_REMAP) + "SELECT video_id, count(DISTINCT person_id) AS n_before, count(DISTINCT coalesce(new_id, person_id)) AS n_after, count(DISTINCT person_id) - count(DISTINCT coalesce(new_id, person_id)) AS n_merged FROM (SELECT d.video_id, d.person_id, r.new_id FROM detections d LEFT JOIN remap r ON d.video_id = r.video_id AND d.person_id = r.old_id) GROUP BY video_id")
def id_merges(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    return trk.id_merges(rows, _remap(rows))


@query(ctes("detections", remap=_REMAP) + """SELECT d.video_id, d.frame_idx, d.person_id, d.ord, CASE WHEN score > 0.8 AND new_id IS NOT NULL THEN person_id ELSE coalesce(new_id, person_id) END AS final_id, score > 0.8 AND new_id IS NOT NULL AS guarded
FROM detections d LEFT JOIN remap r ON d.video_id = r.video_id AND d.person_id = r.old_id""")
def remap_pixels(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    masks = rows.withColumns({"pixels": F.col("score"), "img_w": F.lit(1), "img_h": F.lit(1)})
    return trk.remap_pixels(masks, _remap(rows)).select("video_id", "frame_idx", "person_id", "ord", "final_id", "guarded")


@query(ctes("detections", remap=_REMAP) + """SELECT p.person_id, CASE WHEN raw IS NULL THEN 'P' || p.person_id ELSE 'P' || p.person_id || '  [SAM2: ' || raw || ']' END AS label_text, CAST(p.person_id % 8 AS INT) AS palette
FROM (SELECT DISTINCT person_id FROM detections) p LEFT JOIN (SELECT new_id, string_agg(old_id, ', ' ORDER BY old_id) AS raw FROM (SELECT DISTINCT new_id, old_id FROM remap) GROUP BY new_id) r ON p.person_id = r.new_id""")
def draw_labels(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    return det.palette_index(det.with_label_text(rows.select("person_id").distinct(), _remap(rows)))


@query(ctes("gallery") + "SELECT scene_id, video_id, min(list_min(descriptor)) AS least, max(list_max(descriptor)) AS greatest FROM gallery GROUP BY ALL")
def array_ranges(spark, sf_dir):
    return trk.array_ranges(ad.gallery(spark, sf_dir), ["scene_id", "video_id"], "descriptor")


@query(ctes("series") + """SELECT video_id, frame_idx, round(best, 6) AS best, since_best, since_best >= 3 AS stop FROM (
  SELECT *, frame_idx - max(CASE WHEN improved THEN frame_idx END) OVER w AS since_best FROM (
    SELECT *, min(v) OVER w AS best, coalesce(v < min(v) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
    FROM series WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def early_stopping(spark, sf_dir):
    out = trk.running_best(ad.series(spark, sf_dir), ["video_id"], "frame_idx", "v", 3)
    return out.select("video_id", "frame_idx", F.round("best", 6).alias("best"), "since_best", "stop")


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^(.+?)#\\d{3}') THEN regexp_extract(c_name, '^(.+?)#\\d{3}', 1) ELSE c_name END AS location FROM (SELECT c_custkey, c_name FROM customer)".replace("#", "_"))
def location_stem(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return det.location_stem(rows, "c_name").select("c_custkey", "location")


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT starts_with(s_name, 'aria') AND NOT starts_with(s_name, 'ego_preview') AND s_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier ORDER BY 1 LIMIT 5)")
def scene_limit_no_ego(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "supplier")
    return det.without_ego(det.first_scenes(rows, 5, "s_nationkey"), "s_name").select("s_suppkey", "s_name")


@query(ctes("gallery") + "SELECT scene_id, count(DISTINCT video_id) AS n_videos FROM gallery GROUP BY scene_id HAVING count(DISTINCT video_id) >= 2")
def scenes_with_videos(spark, sf_dir):
    return det.scenes_with_videos(ad.gallery(spark, sf_dir))

