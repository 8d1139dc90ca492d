"""Queries over readers, layouts, remaps and joins that put a recording together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import JOINT_PARENTS
from ..functions import cam, rot, vec
from ..operators import alignment as al
from ..operators import detections as det
from ..operators import losses as lo
from ..operators import sync as sy
from ..operators import tracks as trk
from ..operators import windows as wi
from ..sources import adapters as ad
from ..sources import archives, compaction, files, sinks
from ..sources.adapters import ctes
from ..sources.session import ensure_checkpoint_dir
from .catalogue import query
from .motion import _CORR, _Q, _r
from .tracking import _REMAP, _remap

# -- readers ----------------------------------------------------------------------


@query("SELECT l_orderkey AS frame_idx, l_linenumber AS ord, l_partkey AS person_id, 'person' AS class_name, l_quantity AS x1, l_extendedprice AS x2, l_discount AS score FROM lineitem")
def label_json_parse(spark, sf_dir):
    """Labels through their JSON files' text and names."""
    label = F.struct(F.lit(1).alias("instance_id"), F.lit("person").alias("class_name"), F.col("l_quantity").alias("x1"), F.lit(0.0).alias("y1"), F.col("l_extendedprice").alias("x2"), F.lit(1.0).alias("y2"), F.col("l_discount").alias("score"))
    body = F.to_json(F.struct(F.lit(64).alias("mask_height"), F.create_map(F.col("l_partkey").cast("string"), label).alias("labels")))
    name = F.concat(F.lit("a/b/mask_"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), F.lit(".json"))
    name = F.when(F.col("l_orderkey") > 999_999, F.concat(F.lit("a/b/mask_"), F.col("l_orderkey"), F.lit(".json"))).otherwise(name)
    frames = ad.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), body.alias("json"), name.alias("path"))
    return det.parse_frame_labels(frames).selectExpr("CAST(frame_idx AS BIGINT) AS frame_idx", "line AS ord", "person_id", "class_name", "x1", "x2", "score")


@query(ctes("all_cameras", m=f"SELECT *, {_Q} FROM all_cameras") + "SELECT scene_id, cam, round(r0, 6) AS e0, round(tx, 6) AS e3, round(r8, 6) AS e10, round(tz, 6) AS e11, round(focal_raw, 6) AS k0, CAST(NULL AS INT) AS n_distortion FROM m")
def calibration_parse(spark, sf_dir):
    """Calibrations through their XML text; there is no distortion in it."""
    r, t = cam.rotation(), cam.translation()
    text = lambda cols: F.concat_ws(" ", *[c.cast("string") for c in cols])
    rows = [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2]]
    tag = lambda name, n, m, cols: F.concat(F.lit(f"<{name}><rows>{n}</rows><cols>{m}</cols><data>\n  "), text(cols), F.lit(f"\n</data></{name}>"))
    k = [F.col("focal_raw"), F.lit(0.0), F.lit(320.0), F.lit(0.0), F.col("focal_raw"), F.lit(240.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    xml = F.concat(F.lit("<opencv_storage>"), tag("CameraMatrix", 3, 4, rows), tag("Intrinsics", 3, 3, k), F.lit("</opencv_storage>"))
    found = files.calibrations(ad.all_cameras(spark, sf_dir).select("scene_id", "cam", xml.alias("xml")))
    e = F.col("extrinsics")
    out = found.select("scene_id", "cam", e[0].alias("e0"), e[3].alias("e3"), e[10].alias("e10"), e[11].alias("e11"), F.col("intrinsics")[0].alias("k0"), F.when(F.col("distortion").isNotNull(), F.size("distortion")).alias("n_distortion"))
    return _r(out, "e0", "e3", "e10", "e11", "k0")


@query(ctes("gallery") + "SELECT scene_id, video_id, person_id, 64 AS n, 1.0::DOUBLE AS conf FROM gallery WHERE person_id % 3 <> 0")
def persons_to_sync(spark, sf_dir):
    """Persons without keypoints, null or empty, are left out."""
    d = F.when(F.col("person_id") % 6 == 0, F.lit(None)).when(F.col("person_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.col("descriptor"))
    rows = files.persons_to_sync(ad.gallery(spark, sf_dir).withColumn("pred_keypoints_3d", d))
    return rows.select("scene_id", "video_id", "person_id", F.size("pred_keypoints_3d").alias("n"), "conf")


_SUMMARY = "SELECT video_id, person_id FROM detections GROUP BY ALL HAVING count(*) >= 5"


@query(ctes("detections", summary=_SUMMARY) + "SELECT video_id, frame_idx, person_id, ord FROM detections WHERE (video_id, person_id) IN (SELECT (video_id, person_id) FROM summary)")
def persons_in_summary(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    summary = rows.groupBy("video_id", "person_id").count().where("count >= 5")
    return files.persons_in_summary(rows, summary).select("video_id", "frame_idx", "person_id", "ord")


@query(ctes("videos", masks="SELECT CAST(c_custkey AS BIGINT) AS video_id, CAST(0 AS INT) AS frame_idx, c_name AS mask FROM customer WHERE c_custkey % 3 = 0") + "SELECT v.video_id, v.frame_idx, mask FROM (SELECT video_id, CAST(num_frames % 2 AS INT) AS frame_idx FROM videos) v LEFT JOIN masks m ON v.video_id = m.video_id AND v.frame_idx = m.frame_idx")
def mask_lookup(spark, sf_dir):
    masks = ad.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS video_id", "0 AS frame_idx", "c_name AS mask")
    return files.mask_of_frame(masks, ad.videos(spark, sf_dir).selectExpr("video_id", "CAST(num_frames % 2 AS INT) AS frame_idx"))


@query("SELECT 'c' || a.n_nationkey AS video_a, 'c' || b.n_nationkey AS video_b, CAST(a.n_nationkey AS DOUBLE) AS r0, CAST(b.n_nationkey AS DOUBLE) AS t0 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE (a.n_nationkey + b.n_nationkey) % 3 <> 0")
def pairwise_pose_load(spark, sf_dir):
    """Pairs without a translation, and keys that name no pair, are skipped."""
    a = ad.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS i", "n_regionkey")
    pairs = a.join(a.withColumnRenamed("i", "j"), "n_regionkey").where("i < j")
    key = F.concat(F.lit("c"), "i", F.lit("__to__c"), "j")
    r = pairs.select(F.concat(key, F.lit("__R")).alias("key"), F.array(*[F.col("i").cast("double")] * 9).alias("value"))
    t = pairs.where("(i + j) % 3 <> 0").select(F.concat(key, F.lit("__t")).alias("key"), F.array(*[F.col("j").cast("double")] * 3).alias("value"))
    odd = pairs.select(F.lit("nobody__R").alias("key"), F.array(F.lit(1.0)).alias("value"))
    found = files.pairwise_poses(r.union(t).union(odd))
    return found.select("video_a", "video_b", F.col("rotation")[0].alias("r0"), F.col("translation")[0].alias("t0"))


@query(ctes("videos", asked="SELECT unnest([0, 7, -1, -60, 500]) AS position") + "SELECT video_id, CAST(position AS INT) AS position, CAST(CASE WHEN position < 0 THEN num_frames + position ELSE position END AS INT) AS frame_idx FROM videos, asked WHERE CASE WHEN position < 0 THEN num_frames + position ELSE position END BETWEEN 0 AND num_frames - 1")
def frames_at(spark, sf_dir):
    return wi.frames_at(ad.videos(spark, sf_dir), [0, 7, -1, -60, 500]).select("video_id", "position", "frame_idx")


@query(ctes("detections") + "SELECT video_id, frame_idx, person_id, ord FROM detections WHERE frame_idx NOT IN (SELECT frame_idx FROM detections WHERE score > 0.9)")
def not_done(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    return files.not_done(rows, rows.where("score > 0.9"), ["frame_idx"]).select("video_id", "frame_idx", "person_id", "ord")


# -- layouts ------------------------------------------------------------------------


@query(ctes("gallery", g="SELECT *, CASE WHEN person_id % 3 = 1 THEN NULL ELSE descriptor[1:2] END AS a FROM gallery") + """SELECT scene_id, video_id, person_id % 5 AS track, person_id AS frame_idx, coalesce(a[1], CASE WHEN max(a[1]) OVER w IS NULL THEN NULL ELSE 0 END) AS a0, 0.0::DOUBLE AS b_missing FROM g
WINDOW w AS (PARTITION BY scene_id, video_id, person_id % 5)""")
def dense_tracks(spark, sf_dir):
    """Gaps are zeros of the same length; a field that nobody has is left out."""
    d = F.when(F.col("person_id") % 3 != 1, F.slice("descriptor", 1, 2))
    rows = ad.gallery(spark, sf_dir).select("scene_id", "video_id", (F.col("person_id") % 5).alias("person_id"), F.col("person_id").alias("frame_idx"), d.alias("a"), F.lit(None).cast("array<double>").alias("b"))
    out = sinks.dense_tracks(rows, ["a", "b", "c"])
    return out.select("scene_id", "video_id", F.col("person_id").alias("track"), "frame_idx", F.col("a")[0].alias("a0"), F.lit(float("b" in out.columns)).alias("b_missing"))


@query(ctes("gallery") + "SELECT scene_id, video_id, person_id + 1 AS person_id, round(descriptor[1], 6) AS smplx, round(descriptor[3], 6) AS bbox FROM gallery")
def field_set(spark, sf_dir):
    d = F.col("descriptor")
    rows = ad.gallery(spark, sf_dir).select("scene_id", "video_id", "person_id", d[0].alias("smplx"), d[1].alias("raw"), d[2].alias("bbox"))
    return _r(det.stored_ids(det.field_set(rows, True, ["raw"], ["smplx"], ["bbox"])), "smplx", "bbox")


@query(ctes("detections") + "SELECT video_id, frame_idx, person_id, ord FROM detections WHERE (video_id, frame_idx) IN (SELECT (video_id, frame_idx) FROM detections WHERE score >= 0.5)")
def labelled_frames(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    return det.labelled_frames(rows.where("score >= 0.5"), rows, ["video_id", "frame_idx"]).select("video_id", "frame_idx", "person_id", "ord")


@query(ctes("gallery") + "SELECT scene_id, list_sort(list_filter(['a', 'b', 'c'], lambda f: (f = 'a') OR (f = 'b' AND scene_id % 2 = 0))) AS fields FROM (SELECT DISTINCT scene_id FROM gallery)")
def observed_fields(spark, sf_dir):
    rows = ad.gallery(spark, sf_dir).select("scene_id", F.col("descriptor").alias("a"), F.when(F.col("scene_id") % 2 == 0, F.lit(1)).alias("b"), F.lit(None).cast("int").alias("c"))
    return trk.observed_fields(rows, ["scene_id"], ["c", "b", "a"])


@query(ctes("gallery") + "SELECT scene_id, video_id, person_id, 165 AS n, round(descriptor[1], 6) AS first, round(descriptor[4], 6) AS body, CASE WHEN video_id = 0 THEN round(descriptor[1], 6) ELSE 0 END AS hand, 0.0::DOUBLE AS face FROM gallery")
def full_pose(spark, sf_dir):
    d = F.col("descriptor")
    pose = vec.full_pose(F.slice(d, 1, 3), F.slice(F.concat(F.slice(d, 4, 61), d), 1, 63), F.when(F.col("video_id") == 0, F.slice(d, 1, 45)), F.lit(None).cast("array<double>"))
    out = ad.gallery(spark, sf_dir).withColumn("p", pose).select("scene_id", "video_id", "person_id", F.size("p").alias("n"), F.col("p")[0].alias("first"), F.col("p")[3].alias("body"), F.col("p")[66].alias("hand"), F.col("p")[164].alias("face"))
    return _r(out, "first", "body", "hand")


@query("SELECT v AS position, round(sin(v), 6) AS p0, round(cos(v), 6) AS p1, round(sin(v * pow(10000.0::DOUBLE, -6.0/8)), 6) AS p6, round(cos(v * pow(10000.0::DOUBLE, -6.0/8)), 6) AS p7 FROM (SELECT CAST(c_custkey AS BIGINT) AS v FROM customer)")
def positional_encoding(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "customer").selectExpr("c_custkey AS position").withColumn("e", vec.positional_encoding(F.col("position"), 8))
    return _r(rows.select("position", *[F.col("e")[k].alias(f"p{k}") for k in (0, 1, 6, 7)]), "p0", "p1", "p6", "p7")


@query(ctes("boxes") + "SELECT frame_idx, ord, greatest(3, CAST(floor(greatest(1, y2-y1) / 24.0) AS INT)) AS limb, greatest(greatest(3, CAST(floor(greatest(1, y2-y1) / 24.0) AS INT)), CAST(floor(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) * 0.6::DOUBLE) AS INT)) AS head FROM boxes")
def draw_radii(spark, sf_dir):
    limb = vec.limb_radius(F.col("y1"), F.col("y2"))
    head = vec.head_radius(limb, vec.distance_2d(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return ad.boxes(spark, sf_dir).select("frame_idx", "ord", limb.alias("limb"), head.alias("head"))


_POOL = "(descriptor[{0}] + descriptor[{1}]) / 2"


@query(ctes("gallery", p=f"SELECT scene_id, video_id, person_id, {_POOL.format(1, 2)} AS a, {_POOL.format(3, 4)} AS b, {_POOL.format(5, 6)} AS c FROM gallery") + "SELECT scene_id, video_id, person_id, round(a / greatest(sqrt(a*a+b*b+c*c), 1e-8), 6) AS a, round(b / greatest(sqrt(a*a+b*b+c*c), 1e-8), 6) AS b, round(c / greatest(sqrt(a*a+b*b+c*c), 1e-8), 6) AS c FROM p")
def pooled_feature(spark, sf_dir):
    d = F.col("descriptor")
    rows = ad.gallery(spark, sf_dir).withColumn("f", vec.pooled_feature(F.array(F.slice(d, 1, 2), F.slice(d, 3, 2), F.slice(d, 5, 2))))
    return _r(rows.select("scene_id", "video_id", "person_id", *[F.col("f")[k].alias(c) for k, c in enumerate("abc")]), "a", "b", "c")


@query(ctes("all_cameras", m=f"SELECT *, {_Q} FROM all_cameras") + "SELECT scene_id, cam, round(r3, 6) AS w1, round(-(r0*tx+r3*ty+r6*tz), 6) AS w3, round(r5, 6) AS w9, round(-(r2*tx+r5*ty+r8*tz), 6) AS w11, 1.0::DOUBLE AS w15, round(greatest(focal_raw, 0) + ln(1 + exp(-abs(focal_raw))), 6) AS k0, 320.0::DOUBLE AS k2 FROM m")
def camera_to_world(spark, sf_dir):
    """The inverse of every camera as a 4 x 4 matrix, and its intrinsics."""
    m = cam.matrix_4x4(*cam.inverse(cam.rotation(), cam.translation()))
    rows = ad.all_cameras(spark, sf_dir).withColumn("m", m).withColumn("k", cam.intrinsics(F.col("focal_raw"), F.lit(640.0), F.lit(480.0)))
    out = rows.select("scene_id", "cam", *[F.col("m")[k].alias(f"w{k}") for k in (1, 3, 9, 11, 15)], F.col("k")[0].alias("k0"), F.col("k")[2].alias("k2"))
    return _r(out, "w1", "w3", "w9", "w11", "k0")


# -- remaps --------------------------------------------------------------------------

@query(ctes("boxes", remap="SELECT DISTINCT CAST(frame_idx % 4 AS INT) AS video_id, ord AS old_id, ord + 10 AS new_id FROM boxes WHERE ord % 2 = 1", sized="SELECT CAST(frame_idx % 4 AS INT) AS video_id, frame_idx, ord AS person_id, sum(greatest(x1, x2) - x1 + 1) OVER (PARTITION BY frame_idx, ord) AS px FROM boxes") + """SELECT s.video_id, s.frame_idx, s.person_id, CASE WHEN px > 0.8*64 AND new_id IS NOT NULL THEN s.person_id ELSE coalesce(new_id, s.person_id) END AS final_id, px > 0.8*64 AND new_id IS NOT NULL AS guarded
FROM sized s LEFT JOIN remap r ON s.video_id = r.video_id AND s.person_id = r.old_id""")
def remap_runs(spark, sf_dir):
    """Mask runs under new ids, wide ones kept: images are one row of 64 pixels."""
    rows = ad.boxes(spark, sf_dir).selectExpr("CAST(frame_idx % 4 AS INT) AS video_id", "frame_idx", "ord AS person_id", "0 AS y", "x1 AS x_start", "greatest(x1, x2) AS x_end", "64 AS img_w", "1 AS img_h")
    remap = rows.where("person_id % 2 = 1").selectExpr("video_id", "person_id AS old_id", "person_id + 10 AS new_id").distinct()
    return trk.remap_runs(rows, remap).select("video_id", "frame_idx", "person_id", "final_id", "guarded")


@query(ctes("detections", remap=_REMAP) + "SELECT DISTINCT video_id, person_id FROM detections WHERE person_id <> 0 AND (video_id, person_id) NOT IN (SELECT (video_id, old_id) FROM remap)")
def unmapped_ids(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    return trk.unmapped_ids(rows, _remap(rows))


@query(ctes("detections", remap=_REMAP) + "SELECT d.video_id, coalesce(new_id, person_id) AS person_id, count(*) AS num_frames, min(frame_idx) AS first_frame FROM detections d LEFT JOIN remap r ON d.video_id = r.video_id AND d.person_id = r.old_id GROUP BY d.video_id, d.person_id, new_id")
def remap_summary(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    summary = rows.groupBy("video_id", "person_id").agg(F.count(F.lit(1)).alias("num_frames"), F.min("frame_idx").alias("first_frame"))
    return trk.remap_keyed(summary, _remap(rows))


_TRACKS = """SELECT d.video_id, d.person_id, coalesce(new_id, d.person_id) AS wanted, CASE WHEN new_id IS NOT NULL AND new_id <> d.person_id THEN 1 ELSE 0 END AS moved, count(*) AS num_frames, min(frame_idx) AS first_frame
FROM detections d LEFT JOIN (SELECT video_id, old_id, min(new_id) AS new_id FROM remap GROUP BY ALL) r ON d.video_id = r.video_id AND d.person_id = r.old_id GROUP BY ALL"""


@query(ctes("detections", remap=_REMAP, tracks=_TRACKS) + "SELECT video_id, CASE WHEN row_number() OVER (PARTITION BY video_id, wanted ORDER BY moved, person_id) = 1 THEN wanted ELSE person_id END AS person_id, num_frames, first_frame FROM tracks")
def remap_tracks(spark, sf_dir):
    """Where two tracks of a video meet under one id, the second keeps its own."""
    rows = ad.detections(spark, sf_dir)
    summary = rows.groupBy("video_id", "person_id").agg(F.count(F.lit(1)).alias("num_frames"), F.min("frame_idx").alias("first_frame"))
    return trk.remap_tracks(summary, _remap(rows))


# -- joins ---------------------------------------------------------------------------


@query(ctes("joints") + "SELECT a.scene_id, a.frame_idx, a.person_id, a.joint, round(coalesce(b.x, 0), 6) AS gt, CASE WHEN b.x IS NULL THEN 0 ELSE 1 END AS has_truth FROM (SELECT * FROM joints WHERE video_id = 0) a LEFT JOIN (SELECT * FROM joints WHERE video_id = 1 AND joint < 18) b ON a.scene_id = b.scene_id AND a.frame_idx = b.frame_idx AND a.person_id = b.person_id AND a.joint = b.joint")
def prediction_with_truth(spark, sf_dir):
    """Camera 1 stands for the truth of camera 0; the last joints have none."""
    rows = ad.joints(spark, sf_dir)
    keys = ["scene_id", "frame_idx", "person_id", "joint"]
    truth = rows.where("video_id = 1 AND joint < 18").select(*keys, F.array("x", "y", "z").alias("p"))
    out = wi.with_truth(rows.where("video_id = 0").select(*keys), truth, keys, {"p": 3})
    return _r(out.select(*keys, F.col("gt_p")[0].alias("gt"), "has_truth"), "gt")


@query(ctes("joints", "cameras") + "SELECT j.scene_id, j.video_id, j.frame_idx, c.cam, round(j.x, 6) AS x, round(c.tx, 6) AS tx FROM joints j JOIN cameras c ON j.scene_id = c.scene_id WHERE j.joint = 0")
def truth_for_cameras(spark, sf_dir):
    truth = ad.joints(spark, sf_dir).where("joint = 0").select("scene_id", "video_id", "frame_idx", "x")
    return _r(wi.for_each_camera(truth, ad.cameras(spark, sf_dir).select("scene_id", "cam", "tx"), ["scene_id"]), "x", "tx")


@query(ctes("detections", frames="SELECT DISTINCT video_id, frame_idx FROM detections", labels="SELECT DISTINCT video_id, frame_idx, person_id FROM detections WHERE score >= 0.5", params="SELECT video_id, frame_idx, person_id, max(score) AS fit FROM detections WHERE score >= 0.8 GROUP BY ALL") + "SELECT f.video_id, f.frame_idx, l.person_id, p.fit FROM frames f LEFT JOIN labels l ON f.video_id = l.video_id AND f.frame_idx = l.frame_idx LEFT JOIN params p ON l.video_id = p.video_id AND l.frame_idx = p.frame_idx AND l.person_id = p.person_id")
def draw_list(spark, sf_dir):
    rows, keys = ad.detections(spark, sf_dir), ["video_id", "frame_idx", "person_id"]
    params = rows.where("score >= 0.8").groupBy(*keys).agg(F.max("score").alias("fit"))
    return trk.draw_list(rows.select(*keys[:2]).distinct(), rows.where("score >= 0.5").select(*keys).distinct(), params)


@query(ctes("detections") + "SELECT video_id, CAST(frame_idx + CASE video_id WHEN 'click' THEN 7 WHEN 'view' THEN 3 ELSE 0 END AS INT) AS frame_idx, person_id, ord FROM detections")
def frames_with_offsets(spark, sf_dir):
    starts = spark.createDataFrame([("click", 7), ("view", 3)], "video_id string, start_frame int")
    return wi.with_start_offsets(ad.detections(spark, sf_dir), starts).select("video_id", "frame_idx", "person_id", "ord")


_GRID = "SELECT scene_id, window_start, CAST(window_start + k AS INT) AS frame_idx, CAST(c AS INT) AS cam, CAST(p AS INT) AS slot FROM windows, range(0, 10) t(k), range(0, 3) u(c), range(0, 3) v(p)"


@query(ctes("joints", windows="SELECT DISTINCT scene_id, unnest([0, 5]) AS window_start FROM joints", grid=_GRID, slots="SELECT scene_id, frame_idx, video_id AS cam, person_id AS slot, x, y FROM joints WHERE joint = 0") + """SELECT g.*, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS mask
FROM grid g LEFT JOIN slots s ON s.scene_id = g.scene_id AND s.frame_idx = g.frame_idx AND s.cam = g.cam AND s.slot = g.slot""")
def window_tensor(spark, sf_dir):
    """Windows of ten frames, three cameras (one is empty) and three persons, padded by zeros."""
    rows = ad.joints(spark, sf_dir).where("joint = 0").select("scene_id", "frame_idx", F.col("video_id").alias("cam"), F.col("person_id").alias("slot"), F.array("x", "y").alias("p"))
    windows = rows.select("scene_id").distinct().select("scene_id", F.explode(F.array(F.lit(0), F.lit(5))).alias("window_start"))
    out = wi.padded_windows(windows, rows, ["scene_id"], 10, [0, 1, 2], 3, {"p": 2})
    return _r(out.select("scene_id", "window_start", "frame_idx", "cam", "slot", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "mask"), "x", "y")


@query(ctes("joints") + "SELECT scene_id, min(n) AS n_persons FROM (SELECT scene_id, video_id, count(DISTINCT person_id) AS n FROM joints GROUP BY ALL) GROUP BY scene_id HAVING min(n) = max(n)")
def equal_person_scenes(spark, sf_dir):
    return sy.scenes_with_equal_persons(ad.joints(spark, sf_dir))


@query("SELECT * FROM (VALUES ('absent', 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, 'nan'::DOUBLE, 0::BIGINT)) t(metric, mean, median, std, min, max, n) UNION ALL SELECT event_type, round(avg(value), 6), round(median(value), 6), round(stddev_pop(value), 6), min(value), max(value), count(value) FROM events GROUP BY 1")
def metric_summary_all(spark, sf_dir):
    """A metric without any value is there too."""
    rows = ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    names = rows.select("metric").union(spark.createDataFrame([("absent",)], "metric string"))
    out = trk.named_statistics(rows, names, "metric", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query(ctes("pair_offsets", known="SELECT i, j, off FROM pair_offsets WHERE i = 0", starts="SELECT 0 AS cam, 0::DOUBLE AS t UNION ALL SELECT j, off FROM known") + "SELECT CAST(cam AS BIGINT) AS cam, round(t - least((SELECT min(t) FROM starts), 0), 6) AS start FROM starts")
def start_times_sparse(spark, sf_dir):
    """Only the pairs of camera 0 have offsets: they are the starts themselves."""
    pairs = ad.pair_offsets(spark, sf_dir).where("i = 0").withColumn("scene_id", F.lit(1))
    out = sy.start_times_sparse(pairs, ["scene_id"]).select(F.col("cam").cast("long").alias("cam"), "start")
    return _r(out, "start")


_BODY = "SELECT * FROM (VALUES " + ", ".join(f"({j}, {p})" for j, p in enumerate(JOINT_PARENTS)) + ") t(joint, parent)"


@query((ctes("joints", body=_BODY) + "SELECT j.scene_id, j.video_id, j.frame_idx, j.person_id, j.joint, round(sqrt((j.x-p.x)*(j.x-p.x)+(j.y-p.y)*(j.y-p.y)+(j.z-p.z)*(j.z-p.z)), 6) AS bone FROM joints j JOIN body b ON j.joint = b.joint JOIN joints p ON p.scene_id = j.scene_id AND p.video_id = j.video_id AND p.frame_idx = j.frame_idx AND p.person_id = j.person_id AND p.joint = b.parent").replace("joints AS (", "joints AS MATERIALIZED ("))
def body_bones(spark, sf_dir):
    """Bones by the body model's own tree; the adapter's joints are its first 21."""
    keys = ["scene_id", "video_id", "frame_idx", "person_id"]
    return _r(lo.bone_lengths(ad.joints(spark, sf_dir), lo.body_parents(spark), keys), "bone")


_JM = ctes("joints", corr=_CORR, mean="SELECT scene_id, frame_idx, person_id, joint, avg(x) AS m FROM joints GROUP BY ALL", y="SELECT scene_id, frame_idx, person_id, joint, avg(y) AS m FROM joints GROUP BY ALL")


@query(_JM + """SELECT 'pose' AS name, round(avg((y.m - mean.m) * (y.m - mean.m)), 6) AS loss FROM y JOIN mean USING (scene_id, frame_idx, person_id, joint)
UNION ALL SELECT 'camera', round(avg((ax - bx) * (ax - bx)), 6) FROM corr
UNION ALL SELECT 'temporal', round(sum(d * d), 6) FROM (SELECT m - 2*lag(m, 1) OVER w + lag(m, 2) OVER w AS d FROM y WINDOW w AS (PARTITION BY scene_id, person_id, joint ORDER BY frame_idx))
UNION ALL SELECT 'bone', round(avg(l), 6) FROM (SELECT scene_id, avg(s) AS l FROM (SELECT scene_id, joint, stddev_samp(conf) + 1e-6 AS s FROM joints GROUP BY ALL) GROUP BY scene_id)""")
def wired_losses(spark, sf_dir):
    """Each loss wired as in a training step; y stands for the prediction of x."""
    rows = ad.joints(spark, sf_dir).withColumnRenamed("video_id", "cam")
    cameras = al.correspondences(ad.joints(spark, sf_dir)).select(F.col("ax").alias("pred"), F.col("bx").alias("gt"))
    pred = rows.select("scene_id", "cam", "frame_idx", "person_id", "joint", F.col("y").alias("x"))
    return _r(lo.wired_losses(pred, rows, cameras, rows.select("scene_id", "joint", F.col("conf").alias("bone"))), "loss")


@query(ctes("gallery") + "SELECT scene_id, video_id, person_id, 0 AS frame_idx, 64 AS n, round(descriptor[1], 9) AS first, round(descriptor[64], 9) AS last, CAST(NULL AS DOUBLE) AS bbox FROM gallery")
def archive_round_trip(spark, sf_dir):
    """Persons written as archives, one for each, and read back by member."""
    root = f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    rows = ad.gallery(spark, sf_dir).withColumns({"frame_indices": F.lit(0), "smplx_betas": F.col("descriptor"), "other": F.col("descriptor")})
    name = F.concat_ws("/", F.col("scene_id"), F.col("video_id"), F.lit("body_data"), F.concat(F.lit("person_"), F.col("person_id"), F.lit(".npz")))
    archives.write_rows(rows, root, ["scene_id", "video_id", "person_id"], "frame_indices", ["frame_indices", "smplx_betas", "other"], name).agg(F.sum("n_rows")).collect()
    back = files.person_archives(spark, root, ["smplx_betas", "bbox"])
    d = F.col("smplx_betas")
    return back.select(F.col("scene_id").cast("int").alias("scene_id"), F.col("video_id").cast("int").alias("video_id"), "person_id", "frame_idx", F.size(d).alias("n"), F.round(d[0], 9).alias("first"), F.round(d[63], 9).alias("last"), F.col("bbox")[0].alias("bbox"))


@query(ctes("detections") + "SELECT video_id, frame_idx, person_id, ord, round(score, 6) AS score FROM detections")
def compacted_detections(spark, sf_dir):
    """Detections written in many files, compacted in place and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/compacted-{uuid.uuid4().hex}"
    rows = ad.detections(spark, sf_dir).select("video_id", "frame_idx", "person_id", "ord", "score").withColumn("camera", F.col("video_id"))
    rows.repartition(16).write.partitionBy("camera").parquet(path)
    compaction.compact(spark, path, ["camera"], ["frame_idx", "ord"])
    return _r(compaction.live(spark, path).drop("camera"), "score")


_SHAPES = "SELECT scene_id, CAST(rk AS INT) AS cam, CAST(rk % 3 AS INT) AS person_id, CAST(d AS INT) AS dim, e[d+1] AS pred, e[d+11] AS gt FROM ranked, range(0, 10) t(d)"


@query(ctes("ranked", shapes=_SHAPES, means="SELECT scene_id, person_id, dim, avg(pred) AS p, avg(gt) AS g FROM shapes GROUP BY ALL") + """SELECT 'shape' AS name, round(avg((p - g) * (p - g)), 9) AS loss FROM means
UNION ALL SELECT 'beta', round(avg((pred - p) * (pred - p)), 9) FROM shapes JOIN means USING (scene_id, person_id, dim)""")
def shape_losses(spark, sf_dir):
    """The shape terms of a training step; ten components of a vector stand for a camera's shape."""
    e = F.col("e")
    shapes = ad.ranked(spark, sf_dir).select("scene_id", F.col("rk").alias("cam"), (F.col("rk") % 3).alias("person_id"), F.posexplode(F.arrays_zip(F.slice(e, 1, 10).alias("pred"), F.slice(e, 11, 10).alias("gt"))).alias("dim", "x"))
    return _r(lo.shape_losses(shapes.select("scene_id", "cam", "person_id", "dim", "x.pred", "x.gt")), "loss", digits=9)


_RODRIGUES = """SELECT scene_id, cam, a, CASE WHEN a < 1e-8 THEN 1.0::DOUBLE ELSE sin(a)/a END AS s, CASE WHEN a < 1e-8 THEN 0.5::DOUBLE ELSE (1-cos(a))/(a*a) END AS c, x, y, z
FROM (SELECT scene_id, rk AS cam, e[9] AS x, e[10] AS y, e[11] AS z, sqrt(e[9]*e[9]+e[10]*e[10]+e[11]*e[11]) AS a FROM ranked)"""
_BODY_TURN = "SELECT scene_id, cam, [1-c*(y*y+z*z), -s*z+c*x*y, s*y+c*x*z, s*z+c*x*y, 1-c*(x*x+z*z), -s*x+c*y*z, -s*y+c*x*z, s*x+c*y*z, 1-c*(x*x+y*y)] AS b FROM rodrigues"
_TURN = "SELECT m.scene_id, m.cam, [" + ", ".join(f"o.r{3 * i}*m.r{3 * j}+o.r{3 * i + 1}*m.r{3 * j + 1}+o.r{3 * i + 2}*m.r{3 * j + 2}" for i in range(3) for j in range(3)) + "] AS t FROM m JOIN m o ON m.scene_id = o.scene_id AND o.cam = 0"


@query(ctes("all_cameras", m=f"SELECT *, {_Q} FROM all_cameras", rodrigues=_RODRIGUES, body_turn=_BODY_TURN, turn=_TURN) + "SELECT scene_id, cam, " + ", ".join(f"round(t[{3 * i + 1}]*b[{j + 1}]+t[{3 * i + 2}]*b[{j + 4}]+t[{3 * i + 3}]*b[{j + 7}], 5) AS w{3 * i + j}" for i in range(3) for j in range(3)) + " FROM turn JOIN body_turn USING (scene_id, cam)")
def orientations_to_first_camera(spark, sf_dir):
    """Orientations in camera 0's frame, as the matrices that they stand for."""
    rows = ad.ranked(spark, sf_dir).select("scene_id", F.col("rk").alias("cam"), F.slice("e", 9, 3).alias("global_orient"))
    out = al.orientations_to_first_camera(rows, ad.all_cameras(spark, sf_dir))
    m = rot.axis_angle_to_matrix(vec.items(F.col("global_orient"), 3))
    return out.select("scene_id", "cam", *[(F.round(m[k], 5) + F.lit(0.0)).alias(f"w{k}") for k in range(9)])


@query(ctes("joints", "all_cameras") + "SELECT j.scene_id, j.video_id, j.frame_idx, c.cam, round(j.x, 6) AS x, round(c.tx, 6) AS tx FROM joints j JOIN all_cameras c ON j.scene_id = c.scene_id WHERE j.joint = 0")
def truth_for_cameras_all(spark, sf_dir):
    truth = ad.joints(spark, sf_dir).where("joint = 0").select("scene_id", "video_id", "frame_idx", "x")
    # rounded once for each row and not for each pair
    return wi.for_each_camera(_r(truth, "x"), _r(ad.all_cameras(spark, sf_dir).select("scene_id", "cam", "tx"), "tx"), ["scene_id"])


_POINTS = "SELECT scene_id, video_id, person_id, CAST(j AS INT) AS joint, CASE WHEN person_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, descriptor AS d FROM gallery, range(0, 21) t(j) WHERE person_id % 2 = 0 OR j < 10"


@query(ctes("gallery", points=_POINTS) + "SELECT scene_id, video_id, person_id, joint, round(d[3*joint+1] + t, 6) AS x, round(d[3*joint+2] + 2*t, 6) AS y, round(d[3*joint+3] + 3*t, 6) AS z FROM points")
def evaluation_points(spark, sf_dir):
    """Keypoints of persons that have them, vertices of the others."""
    d, even = F.col("descriptor"), F.col("person_id") % 2 == 0
    rows = ad.gallery(spark, sf_dir).withColumns({"frame_idx": F.lit(0), "pred_keypoints_3d": F.when(even, F.slice(d, 1, 63)), "pred_cam_t": F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "vertices": F.slice(d, 1, 30)})
    return _r(al.evaluation_points(rows).drop("frame_idx"), "x", "y", "z")
