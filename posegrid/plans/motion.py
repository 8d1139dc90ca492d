"""Queries over windows, vectors, cameras, synchronisation, alignment and losses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import cam, rot, vec
from ..operators import alignment as al
from ..operators import attention as at
from ..operators import losses as lo
from ..operators import metrics as me
from ..operators import reid
from ..operators import similarity as sim
from ..operators import sync as sy
from ..operators import windows as wi
from ..sources import adapters as ad
from ..sources.adapters import SQL, ctes
from ..sources.session import ensure_checkpoint_dir
from .catalogue import query


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- windows --------------------------------------------------------------------

_RANGES = "SELECT video_id, 0 AS start, num_frames AS stop FROM videos"
_WINDOWS = "SELECT DISTINCT video_id, window_start FROM (SELECT video_id, CASE WHEN stop <= 32 THEN [0] ELSE list_append(range(0, stop-32+1, 16), stop-32) END AS w FROM ranges) t, unnest(t.w) u(window_start)"


def _windows(spark, sf_dir):
    ranges = ad.videos(spark, sf_dir).selectExpr("video_id", "0 AS start", "num_frames AS stop")
    return wi.sliding_windows(ranges, replace(DEFAULT, window=32, stride=16))


@query(ctes("videos", ranges=_RANGES, windows=_WINDOWS) + "SELECT video_id, CAST(window_start AS INT) AS window_start FROM windows")
def sliding_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


_DET_WINDOWS = "SELECT video_id, CAST(unnest([0, 300, 600]) AS INT) AS window_start FROM (SELECT DISTINCT video_id FROM detections)"


def _observed(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    windows = rows.select("video_id").distinct().select("video_id", F.explode(F.array(F.lit(0), F.lit(300), F.lit(600))).alias("window_start"))
    return wi.windowed(windows, rows, ["video_id"], 128)


@query(ctes("detections", windows=_DET_WINDOWS) + """SELECT w.video_id, window_start, count(*) AS n_slots, CAST(sum(CASE WHEN d.ord IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_observed
FROM (SELECT *, CAST(unnest(range(window_start, window_start + 128)) AS INT) AS frame_idx FROM windows) w LEFT JOIN detections d ON w.video_id = d.video_id AND w.frame_idx = d.frame_idx GROUP BY ALL""")
def window_counts(spark, sf_dir):
    return _observed(spark, sf_dir).groupBy("video_id", "window_start").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("observed").alias("n_observed"))


_ALL_RANGES = "SELECT video_id, min(frame_idx) AS start, max(frame_idx) + 1 AS stop FROM detections GROUP BY video_id"
_ALL_WINDOWS = "SELECT DISTINCT video_id, CAST(window_start AS INT) AS window_start FROM (SELECT video_id, CASE WHEN stop - start <= 128 THEN [start] ELSE list_append(range(start, stop-128+1, 64), stop-128) END AS w FROM ranges) t, unnest(t.w) u(window_start)"


@query(ctes("detections", ranges=_ALL_RANGES, windows=_ALL_WINDOWS) + """SELECT w.video_id, window_start, count(*) AS n_slots, CAST(sum(CASE WHEN d.ord IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_observed
FROM (SELECT *, CAST(unnest(range(window_start, window_start + 128)) AS INT) AS frame_idx FROM windows) w LEFT JOIN detections d ON w.video_id = d.video_id AND w.frame_idx = d.frame_idx GROUP BY ALL""")
def window_counts_all(spark, sf_dir):
    """Over windows that cover every frame from a video's first to its last."""
    rows = ad.detections(spark, sf_dir)
    ranges = rows.groupBy("video_id").agg(F.min("frame_idx").alias("start"), (F.max("frame_idx") + 1).alias("stop"))
    found = wi.windowed(wi.sliding_windows(ranges, replace(DEFAULT, window=128, stride=64)), rows, ["video_id"], 128)
    return found.groupBy("video_id", "window_start").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("observed").alias("n_observed"))


@query(ctes("detections") + "SELECT video_id, frame_idx, arg_min(score, slot) AS score FROM (SELECT video_id, frame_idx, score, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY person_id, ord) AS slot FROM detections) GROUP BY ALL")
def window_camera_first(spark, sf_dir):
    from ..operators.detections import row_rank

    rows = ad.detections(spark, sf_dir).withColumn("slot", row_rank(["video_id", "frame_idx"], "person_id", "ord"))
    return wi.first_slot_camera(rows, ["video_id", "frame_idx"], "score", "slot")


@query(ctes("videos") + "SELECT video_id, CAST(k AS INT) AS k, CAST((k * (num_frames - 1)) // 7 AS INT) AS frame_idx FROM videos, range(0, 8) t(k)")
def uniform_sample(spark, sf_dir):
    return wi.uniform_sample(ad.videos(spark, sf_dir), 8).select("video_id", "k", "frame_idx")


@query(ctes("videos") + "SELECT video_id, CAST(unnest(range(5, least(60, num_frames), 3)) AS INT) AS frame_idx FROM videos WHERE num_frames > 5")
def clip_frames(spark, sf_dir):
    return wi.clip_frames(ad.videos(spark, sf_dir), 5, 60, 3).select("video_id", "frame_idx")


@query(ctes("videos") + "SELECT video_id, CAST(t AS INT) AS t, CAST(least(greatest(3 + t, 3), num_frames - 1) AS INT) AS shifted, least(greatest(3 + t, 3), num_frames - 1) / fps AS seconds FROM videos, range(0, 40, 13) x(t)")
def shifted_frames(spark, sf_dir):
    rows = ad.videos(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(13)))).withColumn("frame_idx", wi.shifted_frame(F.lit(3), F.col("t"), F.col("num_frames")))
    return wi.frame_clock(rows).selectExpr("video_id", "t", "frame_idx AS shifted", "seconds")


@query()
def random_crop(spark, sf_dir):
    return wi.random_crop(ad.videos(spark, sf_dir)).select("video_id", "crop_start", "crop_stop")


# -- vectors and descriptors ------------------------------------------------------


@query(ctes("series") + "SELECT video_id, round(list_reduce(list(v ORDER BY frame_idx), lambda g, x: 0.9::DOUBLE * g + (1 - 0.9::DOUBLE) * x), 6) AS ema FROM series GROUP BY video_id")
def gallery_ema(spark, sf_dir):
    return _r(reid.moving_average(ad.series(spark, sf_dir), ["video_id"], "frame_idx", "v", 0.9), "ema")


@query()
def gallery_ema_unit(spark, sf_dir):
    out = reid.moving_descriptor(ad.gallery(spark, sf_dir), ["scene_id", "video_id"], "person_id", "descriptor")
    return out.select("scene_id", "video_id", F.posexplode("descriptor").alias("dim", "x"))


_COS = "SELECT a.scene_id, a.video_id AS video_a, a.person_id AS person_a, b.video_id AS video_b, b.person_id AS person_b, list_dot_product(a.descriptor, b.descriptor) / (sqrt(list_dot_product(a.descriptor, a.descriptor)) * sqrt(list_dot_product(b.descriptor, b.descriptor))) AS sim FROM gallery a JOIN gallery b ON a.scene_id = b.scene_id AND a.video_id < b.video_id"


@query(ctes("gallery", cos=_COS) + "SELECT scene_id, video_a, person_a, video_b, person_b, round(sim, 6) AS sim FROM cos")
def cosine_pairs(spark, sf_dir):
    return sim.all_pairs(ad.gallery(spark, sf_dir), 6)


@query(ctes("gallery", cos=_COS) + "SELECT scene_id, video_a, person_a, video_b, person_b, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, video_a, person_a, video_b ORDER BY sim DESC, person_b) AS place FROM cos) WHERE place = 1")
def top1_similarity(spark, sf_dir):
    return _r(sim.best_partners(ad.gallery(spark, sf_dir)), "sim")


_HYB = "SELECT scene_id, video_id, person_id, sqrt(list_sum(list_transform(descriptor[1:54], lambda x: 0.49::DOUBLE*x*x)) + 0.09::DOUBLE) AS n, descriptor AS d, sqrt(list_sum(list_transform(descriptor[55:64], lambda x: x*x))) AS s FROM gallery"


@query(ctes("gallery", h=_HYB) + "SELECT scene_id, video_id, person_id, round(0.7*d[1]/n, 6) AS first, round(0.3*d[64]/s/n, 6) AS last FROM h")
def hybrid_descriptor(spark, sf_dir):
    d = F.col("descriptor")
    h = vec.hybrid(F.slice(d, 1, 54), F.slice(d, 55, 10))
    return _r(ad.gallery(spark, sf_dir).withColumn("h", h).select("scene_id", "video_id", "person_id", F.col("h")[0].alias("first"), F.col("h")[63].alias("last")), "first", "last")


@query(ctes("gallery") + "SELECT scene_id, video_id, person_id, round(descriptor[10], 6) AS tenth, 0.0::DOUBLE AS padded FROM gallery")
def fitted_betas(spark, sf_dir):
    out = ad.gallery(spark, sf_dir).withColumn("b", vec.fitted(F.slice("descriptor", 1, 10), 12))
    return _r(out.select("scene_id", "video_id", "person_id", F.col("b")[9].alias("tenth"), F.col("b")[11].alias("padded")), "tenth")


_SMALL = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scene_id, video_id ORDER BY person_id) AS INT) AS k FROM gallery WHERE video_id < 2) WHERE k <= 3"
_SMALLCOS = "SELECT a.scene_id, a.k AS ka, b.k AS kb, a.person_id AS person_a, b.person_id AS person_b, list_dot_product(a.descriptor, b.descriptor) / (sqrt(list_dot_product(a.descriptor, a.descriptor)) * sqrt(list_dot_product(b.descriptor, b.descriptor))) AS sim FROM small a JOIN small b ON a.scene_id = b.scene_id AND a.video_id = 0 AND b.video_id = 1"
_PLANS = "SELECT x.scene_id, x.kb AS b1, y.kb AS b2, z.kb AS b3, x.sim + y.sim + z.sim AS total FROM smallcos x JOIN smallcos y ON x.scene_id = y.scene_id AND x.ka = 1 AND y.ka = 2 AND x.kb <> y.kb JOIN smallcos z ON x.scene_id = z.scene_id AND z.ka = 3 AND z.kb NOT IN (x.kb, y.kb)"
_BEST = "SELECT scene_id, arg_max([b1, b2, b3], total) AS b FROM plans GROUP BY scene_id"


@query(ctes("gallery", small=_SMALL, smallcos=_SMALLCOS, plans=_PLANS, best=_BEST) + "SELECT c.scene_id, person_a, person_b, round(sim, 6) AS sim FROM smallcos c JOIN best USING (scene_id) WHERE b[ka] = kb AND sim >= -1")
def assignment_small(spark, sf_dir):
    rows = ad.gallery(spark, sf_dir).where("video_id < 2")
    from ..operators.detections import row_rank

    rows = rows.withColumn("k", row_rank(["scene_id", "video_id"], "person_id")).where("k <= 3").drop("k")
    found = reid.match_cameras(reid.cosine_pairs(rows), replace(DEFAULT, cross_view_threshold=-1.0))
    return _r(found.select("scene_id", "person_a", "person_b", "sim"), "sim")


@query()
def assignment_full(spark, sf_dir):
    return reid.match_galleries(ad.gallery(spark, sf_dir), replace(DEFAULT, cross_view_threshold=0.25))


_EDGES = "SELECT scene_id*1000000 + video_a*10000 + person_a AS a, scene_id*1000000 + video_b*10000 + person_b AS b FROM cos WHERE sim >= 0.25"
_NODES = "SELECT scene_id*1000000 + video_id*10000 + person_id AS node FROM gallery"


@query(ctes("gallery", recursive=True, cos=_COS, edges=_EDGES, nodes=_NODES, both_ways="SELECT a, b FROM edges UNION SELECT b, a FROM edges", reach="SELECT node, node AS seen FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a") + "SELECT node, min(seen) AS label FROM reach GROUP BY node")
def components_min_label(spark, sf_dir):
    from ..sources.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    gallery = ad.gallery(spark, sf_dir)
    # a cosine that is 0.25 to nine digits
    edges = sim.links(gallery, 0.2499999995).selectExpr("scene_id*1000000 + video_a*10000 + person_a AS a", "scene_id*1000000 + video_b*10000 + person_b AS b")
    return reid.component_labels(gallery.selectExpr("scene_id*1000000 + video_id*10000 + person_id AS node"), edges)


@query()
def conflict_free_ids(spark, sf_dir):
    return reid.match_across_views(ad.gallery(spark, sf_dir), replace(DEFAULT, cross_view_threshold=0.25))


@query()
def reid_fold(spark, sf_dir):
    rows = ad.detections(spark, sf_dir)
    vectors = ad.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS feature")
    featured = rows.withColumn("vec_id", F.col("person_id") % 40).join(vectors, "vec_id").select("video_id", "frame_idx", "ord", "person_id", "feature")
    return reid.reidentify_seen(featured, rows)


# -- cameras and rotations --------------------------------------------------------

_Q = "1-2*(qy*qy+qz*qz) AS r0, 2*(qx*qy-qw*qz) AS r1, 2*(qx*qz+qw*qy) AS r2, 2*(qx*qy+qw*qz) AS r3, 1-2*(qx*qx+qz*qz) AS r4, 2*(qy*qz-qw*qx) AS r5, 2*(qx*qz-qw*qy) AS r6, 2*(qy*qz+qw*qx) AS r7, 1-2*(qx*qx+qy*qy) AS r8"
_ROT = f"SELECT *, {_Q} FROM cameras"
_NINE = ", ".join(f"round(r{k}, 6) AS r{k}" for k in range(9))


_ALL_ROT = f"SELECT *, {_Q} FROM all_cameras"


def _rotations(spark, sf_dir, cameras=ad.cameras):
    r = cam.rotation()
    return cameras(spark, sf_dir).withColumns({f"r{k}": r[k] for k in range(9)})


@query(ctes("cameras", rotations=_ROT) + f"SELECT scene_id, cam, {_NINE} FROM rotations")
def quat_to_matrix(spark, sf_dir, cameras=ad.cameras):
    return _r(_rotations(spark, sf_dir, cameras), *[f"r{k}" for k in range(9)]).select("scene_id", "cam", *[f"r{k}" for k in range(9)])


@query(ctes("cameras", rotations=_ROT) + "SELECT scene_id, cam, round(-(r0*tx+r3*ty+r6*tz), 6) AS cx, round(-(r1*tx+r4*ty+r7*tz), 6) AS cy, round(-(r2*tx+r5*ty+r8*tz), 6) AS cz FROM rotations")
def camera_centres(spark, sf_dir, cameras=ad.cameras):
    c = cam.centre(cam.rotation(), cam.translation())
    return _r(cameras(spark, sf_dir).select("scene_id", "cam", *[c[k].alias(n) for k, n in enumerate(("cx", "cy", "cz"))]), "cx", "cy", "cz")


@query(ctes("cameras", rotations=_ROT) + f"SELECT scene_id, cam, {_NINE} FROM rotations")
def sixd_roundtrip(spark, sf_dir, cameras=ad.cameras):
    rows = _rotations(spark, sf_dir, cameras)
    m = rot.sixd_to_matrix(rot.matrix_to_sixd([F.col(f"r{k}") for k in range(9)]))
    return _r(rows.select("scene_id", "cam", *[m[k].alias(f"r{k}") for k in range(9)]), *[f"r{k}" for k in range(9)])


@query(ctes("cameras", rotations=_ROT) + f"SELECT scene_id, cam, {_NINE} FROM rotations")
def axis_angle_roundtrip(spark, sf_dir, cameras=ad.cameras):
    rows = _rotations(spark, sf_dir, cameras)
    v = rot.matrix_to_axis_angle([F.col(f"r{k}") for k in range(9)])
    rows = rows.select("scene_id", "cam", *[v[k].alias(f"v{k}") for k in range(3)])
    m = rot.axis_angle_to_matrix([F.col(f"v{k}") for k in range(3)])
    return _r(rows.select("scene_id", "cam", *[m[k].alias(f"r{k}") for k in range(9)]), *[f"r{k}" for k in range(9)])


@query(ctes("cameras") + "SELECT scene_id, cam, round(greatest(focal_raw, 0) + ln(1 + exp(-abs(focal_raw))), 6) AS focal, round(focal_raw, 6) AS again FROM cameras")
def softplus_focal(spark, sf_dir, cameras=ad.cameras):
    f = cam.softplus(F.col("focal_raw"))
    return _r(cameras(spark, sf_dir).select("scene_id", "cam", f.alias("focal"), cam.inverse_softplus(f).alias("again")), "focal", "again")


# The same over every camera of a scene, however many there are.


@query(ctes("all_cameras", rotations=_ALL_ROT) + f"SELECT scene_id, cam, {_NINE} FROM rotations")
def quat_to_matrix_all(spark, sf_dir):
    return quat_to_matrix(spark, sf_dir, ad.all_cameras)


@query(ctes("all_cameras", rotations=_ALL_ROT) + "SELECT scene_id, cam, round(-(r0*tx+r3*ty+r6*tz), 6) AS cx, round(-(r1*tx+r4*ty+r7*tz), 6) AS cy, round(-(r2*tx+r5*ty+r8*tz), 6) AS cz FROM rotations")
def camera_centres_all(spark, sf_dir):
    return camera_centres(spark, sf_dir, ad.all_cameras)


@query(ctes("all_cameras", rotations=_ALL_ROT) + f"SELECT scene_id, cam, {_NINE} FROM rotations")
def sixd_roundtrip_all(spark, sf_dir):
    return sixd_roundtrip(spark, sf_dir, ad.all_cameras)


@query(ctes("all_cameras", rotations=_ALL_ROT) + f"SELECT scene_id, cam, {_NINE} FROM rotations")
def axis_angle_roundtrip_all(spark, sf_dir):
    return axis_angle_roundtrip(spark, sf_dir, ad.all_cameras)


@query(ctes("all_cameras") + "SELECT scene_id, cam, round(greatest(focal_raw, 0) + ln(1 + exp(-abs(focal_raw))), 6) AS focal, round(focal_raw, 6) AS again FROM all_cameras")
def softplus_focal_all(spark, sf_dir):
    return softplus_focal(spark, sf_dir, ad.all_cameras)


@query(ctes("joints") + "SELECT scene_id, video_id, frame_idx, joint, round(500*x/(z+2+1e-8::DOUBLE)+320, 6) AS u, round(500*y/(z+2+1e-8::DOUBLE)+240, 6) AS v FROM joints")
def projection(spark, sf_dir):
    f = F.lit(500.0)
    u, v = cam.project([F.col("x"), F.col("y"), F.col("z") + 2], f, f, F.lit(320.0), F.lit(240.0))
    return _r(ad.joints(spark, sf_dir).select("scene_id", "video_id", "frame_idx", "joint", u.alias("u"), v.alias("v")), "u", "v")


_PAIRS = "SELECT a.scene_id, a.cam AS cam_a, b.cam AS cam_b, " + ", ".join(f"a.r{k} AS a{k}, b.r{k} AS b{k}" for k in range(9)) + " FROM rotations a JOIN rotations b ON a.scene_id = b.scene_id AND a.cam < b.cam"
_TRACE = "+".join(f"a{k}*b{k}" for k in range(9))
_ANGLES = f"SELECT scene_id, cam_a, cam_b, degrees(acos(greatest(-1, least(1, ({_TRACE}-1)/2)))) AS angle FROM pairs"


def _two_cameras(spark, sf_dir):
    """Cameras with the identity as the true rotation, so that errors are relative angles."""
    one = F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    rows = _rotations(spark, sf_dir)
    return rows.select("scene_id", "cam", F.array(*[F.col(f"r{k}") for k in range(9)]).alias("pred"), one.alias("gt"))


@query(ctes("cameras", rotations=_ROT, pairs=_PAIRS, angles=_ANGLES) + "SELECT scene_id, cam_a, cam_b, round(angle, 4) AS angle FROM angles")
def pairwise_angle_error(spark, sf_dir):
    return _r(me.pair_angles(_two_cameras(spark, sf_dir)), "angle", digits=4)


@query(ctes("cameras", rotations=_ROT, pairs=_PAIRS, angles=_ANGLES) + "SELECT scene_id, round(avg(angle), 4) AS value FROM angles GROUP BY scene_id")
def angle_error(spark, sf_dir):
    return _r(me.angle_error(_two_cameras(spark, sf_dir)), "value", digits=4)


@query(ctes("cameras", rotations=_ROT, pairs=_PAIRS, angles=_ANGLES) + "SELECT scene_id, round(avg(CASE WHEN angle <= 90 THEN 1.0 ELSE 0.0 END), 6) AS value FROM angles GROUP BY scene_id")
def rra(spark, sf_dir):
    return _r(me.rotation_accuracy(_two_cameras(spark, sf_dir), replace(DEFAULT, rotation_threshold_deg=90.0)), "value")


def _centres(spark, sf_dir):
    c = cam.centre(cam.rotation(), cam.translation())
    return ad.cameras(spark, sf_dir).select("scene_id", "cam", *[c[k].alias(f"a{n}") for k, n in enumerate("xyz")], *[F.col(f"t{n}").alias(f"b{n}") for n in "xyz"])


@query(ctes("cameras") + "SELECT scene_id, round(max(sqrt((tx-mx)*(tx-mx)+(ty-my)*(ty-my)+(tz-mz)*(tz-mz))), 6) AS scale_m FROM (SELECT *, avg(tx) OVER w AS mx, avg(ty) OVER w AS my, avg(tz) OVER w AS mz FROM cameras WINDOW w AS (PARTITION BY scene_id)) GROUP BY scene_id")
def scene_scale(spark, sf_dir):
    return _r(me.scene_scale(_centres(spark, sf_dir)), "scale_m")


_MATS = "SELECT scene_id, video_id, person_id, frame_idx, joint FROM joints"


def _poses(spark, sf_dir):
    """Joints with predicted rotations from their coordinates and true ones turned by a constant."""
    m = rot.axis_angle_to_matrix([F.col("x"), F.col("y"), F.col("z")])
    rows = ad.joints(spark, sf_dir).withColumn("pred", F.array(*m))
    q = rot.axis_angle_to_matrix([F.lit(0.1), F.lit(0.0), F.lit(0.0)])
    return rows.withColumn("gt", F.array(*vec.matmul(q, vec.items(F.col("pred"), 9))))


@query(ctes("joints") + "SELECT scene_id, round(avg(v), 4) AS value FROM (SELECT scene_id, person_id, avg(CASE WHEN joint = 0 THEN 0.0::DOUBLE ELSE degrees(0.1::DOUBLE) END) AS v FROM joints GROUP BY ALL) GROUP BY scene_id")
def pa_mpjre(spark, sf_dir):
    rows = _poses(spark, sf_dir).withColumn("frame_idx", F.col("frame_idx") * 2 + F.col("video_id"))
    return _r(me.pa_mpjre(rows), "value", digits=4)


@query(ctes("joints") + "SELECT scene_id, round(avg(CASE WHEN joint = 0 THEN 0.0::DOUBLE ELSE degrees(0.1::DOUBLE) END), 4) AS value FROM joints GROUP BY scene_id")
def ga_mpjre(spark, sf_dir):
    return _r(me.ga_mpjre(_poses(spark, sf_dir)), "value", digits=4)


# -- alignment --------------------------------------------------------------------

_CORR = "SELECT a.scene_id, a.video_id AS video_a, b.video_id AS video_b, a.person_id, a.frame_idx, a.joint, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM joints a JOIN joints b ON a.scene_id = b.scene_id AND a.person_id = b.person_id AND a.frame_idx = b.frame_idx AND a.joint = b.joint AND a.video_id < b.video_id"
_B = {"bx": "bx", "by": "by_", "bz": "bz"}


_ROOTED = "SELECT j.scene_id, j.video_id, j.frame_idx, j.person_id, j.joint, j.x+r.x AS x, j.y+r.y AS y, j.z+r.z AS z FROM joints j JOIN joints r ON j.scene_id=r.scene_id AND j.video_id=r.video_id AND j.frame_idx=r.frame_idx AND j.person_id=r.person_id WHERE r.joint = 0"


@query((ctes("joints", rooted=_ROOTED) + "SELECT scene_id, video_id, frame_idx, joint, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM rooted WHERE NOT (x=0 AND y=0 AND z=0)").replace("joints AS (", "joints AS MATERIALIZED (").replace("ranked AS (", "ranked AS MATERIALIZED ("))
def absolute_joints(spark, sf_dir):
    rows = ad.joints(spark, sf_dir)
    return _r(al.absolute_joints(rows, rows.where("joint = 0")).select("scene_id", "video_id", "frame_idx", "joint", "x", "y", "z"), "x", "y", "z")


@query((ctes("joints", roots="SELECT scene_id, video_id, frame_idx, person_id, x, y, z FROM joints WHERE joint = 20 AND person_id <> 2") + "SELECT scene_id, video_id, frame_idx, CAST(-1 AS INT) AS joint, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM roots WHERE frame_idx % 2 = 0").replace("joints AS (", "joints AS MATERIALIZED (").replace("ranked AS (", "ranked AS MATERIALIZED ("))
def absolute_roots(spark, sf_dir):
    """Persons without joints are their roots alone; without a root they drop out."""
    rows = ad.joints(spark, sf_dir)
    found = al.absolute_joints(rows.where("frame_idx % 2 = 1"), rows.where("joint = 20 AND person_id <> 2"))
    return _r(found.where("joint = -1").select("scene_id", "video_id", "frame_idx", "joint", "x", "y", "z"), "x", "y", "z")


_H = [("x", "x"), ("x", "y"), ("z", "z")]


@query(ctes("joints", corr=_CORR) + "SELECT scene_id, video_a, video_b, count(*) AS n, round(avg(ax), 6) AS max, " + ", ".join(f"round(covar_pop({_B['b' + i]}, a{j}), 6) AS h{i}{j}" for i, j in _H) + ", round(var_pop(ax)+var_pop(ay)+var_pop(az), 6) AS var_a FROM corr GROUP BY ALL")
def correspondence_sums(spark, sf_dir):
    s = al.sums(al.correspondences(ad.joints(spark, sf_dir)), ["scene_id", "video_a", "video_b"])
    cols = ["max", *[f"h{i}{j}" for i, j in _H], "var_a"]
    return _r(s.select("scene_id", "video_a", "video_b", "n", *cols), *cols)


@query(ctes("joints", corr=_CORR, planar="SELECT scene_id, video_a, video_b, atan2(covar_pop(by_, ax) - covar_pop(bx, ay), covar_pop(bx, ax) + covar_pop(by_, ay)) AS t, (covar_pop(bx,ax)*covar_pop(by_,ay) - covar_pop(bx,ay)*covar_pop(by_,ax)) AS det FROM corr GROUP BY ALL") + "SELECT scene_id, video_a, video_b, round(cos(t), 4) AS r0, round(sin(t), 4) AS r3 FROM planar WHERE det > 0")
def kabsch_planar(spark, sf_dir):
    points = al.correspondences(ad.joints(spark, sf_dir)).withColumns({"az": F.lit(0.0), "bz": F.lit(0.0)})
    s = al.sums(points, ["scene_id", "video_a", "video_b"]).where("hxx*hyy - hxy*hyx > 0")
    fits = al.poses(s)
    return _r(fits.select("scene_id", "video_a", "video_b", F.col("rotation")[0].alias("r0"), F.col("rotation")[3].alias("r3")), "r0", "r3", digits=4)


@query(ctes("joints", corr=_CORR) + "SELECT scene_id, video_a, video_b, round(sqrt(avg((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz))), 6) AS rmse FROM corr GROUP BY ALL")
def alignment_rmse_identity(spark, sf_dir):
    points = al.correspondences(ad.joints(spark, sf_dir))
    keys = ["scene_id", "video_a", "video_b"]
    one = points.select(*keys).distinct().select(*keys, F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)]).alias("rotation"), F.array(*[F.lit(0.0)] * 3).alias("translation"), F.lit(1.0).alias("scale"))
    out = al.residuals(points, one, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    return _r(out, "rmse")


@query()
def alignment_report(spark, sf_dir):
    return al.pair_report(al.correspondences(ad.joints(spark, sf_dir)))


@query(ctes("joints", corr=_CORR) + "SELECT scene_id, video_a, video_b, CAST(count(*) AS BIGINT) AS n FROM corr GROUP BY ALL HAVING count(*) >= 30")
def enough_correspondences(spark, sf_dir):
    s = al.sums(al.correspondences(ad.joints(spark, sf_dir), by_rank=True), ["scene_id", "video_a", "video_b"])
    return al.poses(s).select("scene_id", "video_a", "video_b", "n")


@query(ctes("cameras", rotations=_ROT, base="SELECT scene_id, r0 AS o0, r1 AS o1, r2 AS o2, r3 AS o3, r4 AS o4, r5 AS o5, r6 AS o6, r7 AS o7, r8 AS o8, tx AS ox, ty AS oy, tz AS oz FROM rotations WHERE cam = 0", local="SELECT *, r0*(1-tx)+r3*(2-ty)+r6*(3-tz) AS px, r1*(1-tx)+r4*(2-ty)+r7*(3-tz) AS py, r2*(1-tx)+r5*(2-ty)+r8*(3-tz) AS pz FROM rotations JOIN base USING (scene_id)") + "SELECT scene_id, cam, round(o0*px+o1*py+o2*pz+ox, 6) AS wx, round(o3*px+o4*py+o5*pz+oy, 6) AS wy, round(o6*px+o7*py+o8*pz+oz, 6) AS wz FROM local")
def world_transform(spark, sf_dir):
    cams = ad.cameras(spark, sf_dir)
    points = cams.select("scene_id", "cam", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return _r(al.to_first_camera(points, cams).select("scene_id", "cam", "wx", "wy", "wz"), "wx", "wy", "wz")


def _scene_points(spark, sf_dir):
    return al.correspondences(ad.joints(spark, sf_dir))


@query()
def pose_metrics(spark, sf_dir):
    """All position and camera metrics of the adapter's scenes and their statistics.

    Each view is read once, into a table that the metrics share.
    """
    ensure_checkpoint_dir(spark)
    points, centres, poses, two = (f(spark, sf_dir).checkpoint() for f in (_scene_points, _centres, _poses, _two_cameras))
    correction = al.poses(al.sums(centres, ["scene_id"]), False, least=1).select("scene_id", "rotation")
    return me.collect({
        **me.position_metrics(points, centres), "w_mpjre": me.w_mpjre(poses, correction),
        "ga_mpjre": me.ga_mpjre(poses), "pa_mpjre": me.pa_mpjre(poses), "te": me.translation_error(centres, False), "s_te": me.translation_error(centres, True),
        "ae": me.angle_error(two), "rra_15": me.rotation_accuracy(two), "cca_15": me.centre_accuracy(centres, False), "s_cca_15": me.centre_accuracy(centres, True),
    })


@query("SELECT CAST(least(floor(value * 50 / 500.0::DOUBLE), 49) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def residual_histogram(spark, sf_dir):
    return al.residual_histogram(ad.table(spark, sf_dir, "events"), "value", 0.0, 500.0)


# -- synchronisation ----------------------------------------------------------------


@query(ctes("joints") + """SELECT a.scene_id, a.person_id, a.video_id AS video_a, b.video_id AS video_b, a.frame_idx AS frame_a, b.frame_idx AS frame_b,
round(power(sum(a.conf*b.conf*sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) / (sum(a.conf*b.conf) + 1e-8::DOUBLE), 2), 6) AS cost
FROM joints a JOIN joints b ON a.scene_id=b.scene_id AND a.person_id=b.person_id AND a.joint=b.joint AND a.video_id<b.video_id GROUP BY ALL""")
def cost_matrix(spark, sf_dir):
    return _r(sy.cost_matrix(ad.joints(spark, sf_dir)), "cost")


_DIAG = """SELECT p.video_a, p.video_b, 0 AS k, list_transform(range(0, n+1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS d1, list_transform(range(0, n+1), lambda i: 'inf'::DOUBLE) AS d2, va, vb, n, m FROM two p
UNION ALL SELECT video_a, video_b, k+1, list_transform(range(0, n+1), lambda i: CASE WHEN i < 1 OR k+1-i < 1 OR k+1-i > m THEN 'inf'::DOUBLE ELSE (va[i]-vb[k+1-i])*(va[i]-vb[k+1-i]) + least(d2[i], d1[i+1], d1[i]) END), d1, va, vb, n, m FROM diag WHERE k < n + m"""


@query(ctes("series", recursive=True, lists="SELECT video_id, list(v ORDER BY frame_idx) AS v, CAST(count(*) AS INT) AS n FROM series GROUP BY video_id", two="SELECT a.video_id AS video_a, b.video_id AS video_b, a.v AS va, b.v AS vb, a.n, b.n AS m FROM lists a JOIN lists b ON a.video_id < b.video_id", diag=_DIAG) + "SELECT video_a, video_b, round(d1[n+1], 4) AS distance FROM diag WHERE k = n + m")
def dtw_distance(spark, sf_dir):
    out = sy.warp_series(ad.series(spark, sf_dir).withColumn("scene_id", F.lit("all")), ["scene_id"])
    return _r(out.select("video_a", "video_b", "distance"), "distance", digits=4)


_PLACED = "SELECT scene_id, person_id, video_id, frame_idx, row_number() OVER (PARTITION BY scene_id, person_id, video_id ORDER BY frame_idx) AS at FROM (SELECT DISTINCT scene_id, person_id, video_id, frame_idx FROM joints)"
_COSTS = """SELECT a.scene_id, a.person_id, p.at AS i, q.at AS j, power(sum(a.conf*b.conf*sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) / (sum(a.conf*b.conf) + 1e-8::DOUBLE), 2) AS c
FROM joints a JOIN joints b ON a.scene_id = b.scene_id AND a.person_id = b.person_id AND a.joint = b.joint AND a.video_id = 0 AND b.video_id = 1
JOIN placed p ON p.scene_id = a.scene_id AND p.person_id = a.person_id AND p.video_id = 0 AND p.frame_idx = a.frame_idx JOIN placed q ON q.scene_id = b.scene_id AND q.person_id = b.person_id AND q.video_id = 1 AND q.frame_idx = b.frame_idx GROUP BY ALL"""
_INF = "'inf'::DOUBLE"
_TOTALS = f"""SELECT scene_id, person_id, n, m, c, 0 AS k, list_transform(range(0, n+1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE {_INF} END) AS d1, list_transform(range(0, n+1), lambda i: {_INF}) AS d2 FROM matrices
UNION ALL SELECT scene_id, person_id, n, m, c, k+1, list_transform(range(0, n+1), lambda i: CASE WHEN i < 1 OR k+1-i < 1 OR k+1-i > m THEN {_INF} ELSE c[(i-1)*m + k+1-i] + least(least(d2[i], d1[i]), d1[i+1]) END), d1 FROM totals WHERE k < n + m"""
_STEPS = """SELECT scene_id, person_id, n AS i, m AS j FROM matrices
UNION ALL SELECT * FROM (SELECT s.scene_id, s.person_id, s.i - CASE WHEN t.d2[s.i] <= least(t.d1[s.i], t.d1[s.i+1]) OR t.d1[s.i] <= t.d1[s.i+1] THEN 1 ELSE 0 END AS i, s.j - CASE WHEN t.d2[s.i] <= least(t.d1[s.i], t.d1[s.i+1]) OR t.d1[s.i] > t.d1[s.i+1] THEN 1 ELSE 0 END AS j FROM steps s JOIN totals t ON t.scene_id = s.scene_id AND t.person_id = s.person_id AND t.k = s.i + s.j - 1) WHERE i > 0 AND j > 0"""


@query(ctes("joints", recursive=True, placed=_PLACED, costs=_COSTS, matrices="SELECT scene_id, person_id, CAST(max(i) AS INT) AS n, CAST(max(j) AS INT) AS m, list(c ORDER BY i, j) AS c FROM costs GROUP BY ALL", totals=_TOTALS, steps=_STEPS, shifts="SELECT scene_id, person_id, j - i AS shift, count(*) AS times FROM steps GROUP BY ALL", best="SELECT scene_id, person_id, arg_min(shift, (-times, shift)) AS shift FROM shifts GROUP BY ALL").replace("joints AS (", "joints AS MATERIALIZED (").replace("costs AS (", "costs AS MATERIALIZED (") + "SELECT scene_id, 0 AS video_a, 1 AS video_b, quantile_disc(shift, 0.5)::DOUBLE AS \"offset\" FROM best GROUP BY scene_id")
def dtw_offsets(spark, sf_dir):
    by_person = sy.warp_sequences(ad.joints(spark, sf_dir))
    return sy.pair_offsets(by_person, ["scene_id", "video_a", "video_b"])


@query("SELECT o_custkey % 50 AS pair, quantile_disc(CAST(o_orderkey % 13 - 6 AS INT), 0.5)::DOUBLE AS \"offset\" FROM orders GROUP BY 1")
def pair_offset_median(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS pair", "CAST(o_orderkey % 13 - 6 AS INT) AS offset")
    return sy.pair_offsets(rows, ["pair"])


_MATRIX = "SELECT i, j, off FROM pair_offsets UNION ALL SELECT j, i, -off FROM pair_offsets UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation WHERE n_nationkey < 6"


@query(ctes("pair_offsets", matrix=_MATRIX) + "SELECT i, j, off FROM matrix")
def offset_matrix(spark, sf_dir):
    return sy.offset_matrix(ad.pair_offsets(spark, sf_dir))


@query(ctes("pair_offsets", matrix=_MATRIX, means="SELECT j AS cam, avg(off) AS m FROM matrix GROUP BY j", starts="SELECT cam, m - (SELECT m FROM means WHERE cam = 0) AS t FROM means") + "SELECT cam, round(t - least((SELECT min(t) FROM starts), 0), 6) AS start, CAST(round_even(t - least((SELECT min(t) FROM starts), 0), 0) AS INT) AS start_frame FROM starts")
def start_times_ls(spark, sf_dir):
    return _r(sy.rounded(sy.start_times(sy.offset_matrix(ad.pair_offsets(spark, sf_dir)))), "start")


# -- losses ---------------------------------------------------------------------------


@query(ctes("joints", corr=_CORR) + "SELECT scene_id, round(avg((ax-bx)*(ax-bx)), 6) AS mse FROM corr GROUP BY scene_id")
def mse(spark, sf_dir):
    return _r(lo.mse(_scene_points(spark, sf_dir), "ax", "bx", ["scene_id"]), "mse")


@query(ctes("series") + "SELECT video_id, round(sum(d2*d2), 4) AS loss FROM (SELECT video_id, v - 2*lag(v, 1) OVER w + lag(v, 2) OVER w AS d2 FROM series WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)) GROUP BY video_id")
def temporal_smoothness(spark, sf_dir):
    return _r(lo.temporal_smoothness(ad.series(spark, sf_dir), ["video_id"], "frame_idx", "v"), "loss", digits=4)


@query(ctes("series") + "SELECT video_id, frame_idx, round(v - lag(v, 1) OVER w, 6) AS d1, round(v - 2*lag(v, 1) OVER w + lag(v, 2) OVER w, 6) AS d2 FROM series WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)")
def frame_differences(spark, sf_dir):
    return _r(wi.differences(ad.series(spark, sf_dir), ["video_id"], "frame_idx", "v").select("video_id", "frame_idx", "d1", "d2"), "d1", "d2")


@query(ctes("joints") + "SELECT scene_id, round(-0.5*sum(1 + y - x*x - exp(y)), 6) AS kl FROM joints GROUP BY scene_id")
def kl_term(spark, sf_dir):
    return _r(lo.kl_term(ad.joints(spark, sf_dir), "x", "y", ["scene_id"]), "kl")


@query(ctes("joints") + "SELECT scene_id, round(avg(kl), 6) AS kl FROM (SELECT scene_id, -0.5*sum(1 + y - x*x - exp(y)) AS kl FROM joints GROUP BY scene_id, video_id, person_id, frame_idx) GROUP BY scene_id")
def kl_mean(spark, sf_dir):
    """A body in a frame is a sample, its joints the latent components."""
    return _r(lo.kl_loss(ad.joints(spark, sf_dir), "x", "y", ["video_id", "person_id", "frame_idx"], ["scene_id"]), "kl")


_PARENT_SQL = "SELECT unnest(range(1, 21)) AS joint, (unnest(range(1, 21)) - 1) // 2 AS parent"


@query(ctes("joints", parents=_PARENT_SQL, bones="SELECT j.scene_id, j.joint, sqrt((j.x-p.x)*(j.x-p.x)+(j.y-p.y)*(j.y-p.y)+(j.z-p.z)*(j.z-p.z)) AS bone FROM joints j JOIN parents q ON j.joint = q.joint JOIN joints p ON p.scene_id=j.scene_id AND p.video_id=j.video_id AND p.frame_idx=j.frame_idx AND p.person_id=j.person_id AND p.joint=q.parent") + "SELECT scene_id, round(avg(s), 6) AS loss FROM (SELECT scene_id, joint, stddev_samp(bone) + 1e-6::DOUBLE AS s FROM bones GROUP BY ALL) GROUP BY scene_id")
def bone_length_std(spark, sf_dir):
    parents = spark.range(1, 21).selectExpr("CAST(id AS INT) AS joint", "CAST((id - 1) DIV 2 AS INT) AS parent")
    bones = lo.bone_lengths(ad.joints(spark, sf_dir), parents, ["scene_id", "video_id", "frame_idx", "person_id"])
    return _r(lo.bone_consistency(bones, ["scene_id"]), "loss")


@query(ctes("joints") + "SELECT round(avg(d*d), 6) AS loss FROM (SELECT x - avg(x) OVER (PARTITION BY scene_id, frame_idx, person_id, joint) AS d FROM joints)")
def beta_consistency(spark, sf_dir):
    return _r(lo.beta_consistency(ad.joints(spark, sf_dir), ["scene_id", "frame_idx", "person_id", "joint"], "x"), "loss")


@query(ctes("cameras", pairs="SELECT a.*, b.qw AS hw, b.qx AS hx, b.qy AS hy, b.qz AS hz, b.tx AS ux, b.ty AS uy, b.tz AS uz FROM cameras a JOIN cameras b ON a.scene_id=b.scene_id AND b.cam = (a.cam + 1) % 6") + "SELECT scene_id, round(avg((tx-ux)*(tx-ux)+(ty-uy)*(ty-uy)+(tz-uz)*(tz-uz)) + avg(1 - abs(qw*hw+qx*hx+qy*hy+qz*hz)), 6) AS loss FROM pairs GROUP BY scene_id")
def camera_mse(spark, sf_dir):
    rows = ad.cameras(spark, sf_dir)
    g = rows.select("scene_id", ((F.col("cam") + 5) % 6).alias("cam"), *[F.col(c).alias(f"g_{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    return _r(lo.camera_loss(rows.join(g, ["scene_id", "cam"]), ["scene_id"]), "loss")


@query("SELECT round(sum(w * loss), 4) AS total FROM (SELECT event_type, avg(value) AS loss FROM events GROUP BY 1) JOIN (SELECT event_type, 0.5::DOUBLE + rank() OVER (ORDER BY event_type) AS w FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)")
def weighted_loss(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("loss"))
    # Event types are a fixed, small set; the ranking is over their names only.
    weights = rows.select("name").selectExpr("name", "0.5D + rank() OVER (ORDER BY name) AS weight")
    return _r(lo.weighted_sum(rows, weights), "total", digits=4)


@query(ctes("joints") + "SELECT scene_id, video_id, frame_idx, joint, round(ln(conf*conf + 1e-6::DOUBLE), 6) AS bias FROM joints")
def confidence_bias(spark, sf_dir):
    return _r(ad.joints(spark, sf_dir).select("scene_id", "video_id", "frame_idx", "joint", lo.confidence_bias(F.col("conf"), F.col("conf")).alias("bias")), "bias")


@query(ctes("gallery", top="SELECT *, max(descriptor[1]) OVER (PARTITION BY scene_id, video_id) AS m FROM gallery") + "SELECT scene_id, video_id, round(sum(exp(descriptor[1]-m)*descriptor[2]) / sum(exp(descriptor[1]-m)), 6) AS pooled FROM top GROUP BY ALL")
def camera_softmax_pool(spark, sf_dir):
    rows = ad.gallery(spark, sf_dir).select("scene_id", "video_id", F.col("descriptor")[0].alias("logit"), F.col("descriptor")[1].alias("x"))
    return _r(lo.softmax_pool(rows, ["scene_id", "video_id"], "logit", "x"), "pooled")


@query(ctes("series", s="SELECT video_id, frame_idx, v/500 AS v FROM series", sc="SELECT a.video_id, a.frame_idx, a.v*b.v AS s, b.v AS val FROM s a JOIN s b ON a.video_id=b.video_id AND abs(a.frame_idx-b.frame_idx) <= 4", mx="SELECT *, max(s) OVER (PARTITION BY video_id, frame_idx) AS m FROM sc") + "SELECT video_id, frame_idx, round(sum(exp(s-m)*val)/sum(exp(s-m)), 6) AS pooled FROM mx GROUP BY ALL")
def windowed_attention(spark, sf_dir):
    rows = ad.series(spark, sf_dir).withColumn("v", F.col("v") / 500)
    return _r(lo.windowed_attention(rows, ["video_id"], "frame_idx", "v", "v", "v", 4), "pooled")


_VA = "SELECT a.scene_id, a.person_id AS q_id, list_dot_product(a.descriptor[1:8], b.descriptor[1:8]) / sqrt(8) AS s, b.descriptor[9:10] AS v FROM g a JOIN g b ON a.scene_id = b.scene_id"


@query(ctes("gallery", g="SELECT * FROM gallery WHERE video_id = 0", va=_VA, mx="SELECT *, max(s) OVER (PARTITION BY scene_id, q_id) AS m FROM va") + "SELECT scene_id, q_id, round(sum(exp(s-m)*v[1])/sum(exp(s-m)), 6) AS o1, round(sum(exp(s-m)*v[2])/sum(exp(s-m)), 6) AS o2 FROM mx GROUP BY ALL")
def vector_attention(spark, sf_dir):
    g = ad.gallery(spark, sf_dir).where("video_id = 0")
    d = F.col("descriptor")
    q = g.select("scene_id", F.col("person_id").alias("q_id"), F.slice(d, 1, 8).alias("q"))
    kv = g.select("scene_id", F.slice(d, 1, 8).alias("k"), F.slice(d, 9, 2).alias("v"))
    out = lo.vector_attention(q, kv, ["scene_id"])
    return _r(out.select("scene_id", "q_id", F.col("out")[0].alias("o1"), F.col("out")[1].alias("o2")), "o1", "o2")


_VA_ALL = "SELECT a.scene_id, a.video_id, a.person_id AS q_id, list_dot_product(a.descriptor[1:8], b.descriptor[1:8]) / sqrt(8) AS s, b.descriptor[9:10] AS v FROM gallery a JOIN gallery b ON a.scene_id = b.scene_id AND a.video_id = b.video_id"


@query(ctes("gallery", va=_VA_ALL, mx="SELECT *, max(s) OVER (PARTITION BY scene_id, video_id, q_id) AS m FROM va") + "SELECT scene_id, video_id, q_id, round(sum(exp(s-m)*v[1])/sum(exp(s-m)), 6) AS o1, round(sum(exp(s-m)*v[2])/sum(exp(s-m)), 6) AS o2 FROM mx GROUP BY ALL")
def vector_attention_all(spark, sf_dir):
    """Over the persons of every camera."""
    g, d = ad.gallery(spark, sf_dir), F.col("descriptor")
    q = g.select("scene_id", "video_id", F.col("person_id").alias("q_id"), F.slice(d, 1, 8).alias("q"))
    kv = g.select("scene_id", "video_id", F.slice(d, 1, 8).alias("k"), F.slice(d, 9, 2).alias("v"))
    out = lo.vector_attention(q, kv, ["scene_id", "video_id"])
    return _r(out.select("scene_id", "video_id", "q_id", F.col("out")[0].alias("o1"), F.col("out")[1].alias("o2")), "o1", "o2")


_TA = """SELECT a.scene_id, a.rk AS frame_idx, h, list_dot_product(a.e[4*h+1:4*h+4], b.e[4*h+1:4*h+4]) / sqrt(4) + ln(abs(a.e[64]) * abs(b.e[64]) + 1e-6::DOUBLE) AS s, b.e[4*h+9] AS first, b.e[4*h+12] AS last
FROM ranked a JOIN ranked b ON a.scene_id = b.scene_id AND abs(a.rk - b.rk) <= 7, range(0, 2) t(h)"""


@query(ctes("ranked", ta=_TA, mx="SELECT *, max(s) OVER (PARTITION BY scene_id, frame_idx, h) AS m FROM ta", o="SELECT scene_id, frame_idx, h, sum(exp(s-m)*first)/sum(exp(s-m)) AS first, sum(exp(s-m)*last)/sum(exp(s-m)) AS last FROM mx GROUP BY ALL") + "SELECT a.scene_id, a.frame_idx, round(a.first, 6) AS first_0, round(a.last, 6) AS last_0, round(b.first, 6) AS first_1, round(b.last, 6) AS last_1 FROM o a JOIN o b ON a.scene_id = b.scene_id AND a.frame_idx = b.frame_idx AND a.h = 0 AND b.h = 1")
def temporal_attention(spark, sf_dir):
    """Two heads of four components over seven frames each way, with the confidences' bias."""
    e = F.col("e")
    rows = ad.ranked(spark, sf_dir).select("scene_id", F.col("rk").alias("frame_idx"), F.slice(e, 1, 8).alias("q"), F.slice(e, 1, 8).alias("k"), F.slice(e, 9, 8).alias("v"), F.abs(e[63]).alias("conf"))
    out = at.temporal_attention(rows, ["scene_id"], "frame_idx", 7, 2, "conf", tile=16)
    o = F.col("out")
    return _r(out.select("scene_id", "frame_idx", o[0].alias("first_0"), o[3].alias("last_0"), o[4].alias("first_1"), o[7].alias("last_1")), "first_0", "last_0", "first_1", "last_1")


@query()
def epipolar_loss(spark, sf_dir):
    points = ad.joints(spark, sf_dir).select("scene_id", "x", "y", F.col("z") + 3)
    return lo.epipolar_loss(points.toDF("scene_id", "x", "y", "z"), ad.cameras(spark, sf_dir), 320.0, 240.0)


@query(ctes("joints") + "SELECT scene_id, frame_idx, person_id, joint, round(avg(x), 6) AS target FROM joints GROUP BY ALL")
def camera_mean_target(spark, sf_dir):
    return _r(lo.camera_mean_target(ad.joints(spark, sf_dir), ["scene_id", "frame_idx", "person_id", "joint"], "x"), "target")


# -- camera queries over all cameras of a scene -----------------------------------------

#: The view named cameras holds all of them here.
_EVERY = {"cameras": SQL["all_cameras"]}


def _all_two(spark, sf_dir):
    one = F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    return _rotations(spark, sf_dir, ad.all_cameras).select("scene_id", "cam", F.array(*[F.col(f"r{k}") for k in range(9)]).alias("pred"), one.alias("gt"))


@query(ctes("ranked", **_EVERY, rotations=_ROT, pairs=_PAIRS, angles=_ANGLES) + "SELECT scene_id, cam_a, cam_b, round(angle, 4) AS angle FROM angles")
def pairwise_angle_error_all(spark, sf_dir):
    return _r(me.pair_angles(_all_two(spark, sf_dir)), "angle", digits=4)


@query(ctes("ranked", **_EVERY, rotations=_ROT, pairs=_PAIRS, angles=_ANGLES) + "SELECT scene_id, round(avg(angle), 4) AS value FROM angles GROUP BY scene_id")
def angle_error_all(spark, sf_dir):
    return _r(me.angle_error(_all_two(spark, sf_dir)), "value", digits=4)


@query(ctes("ranked", **_EVERY, rotations=_ROT, pairs=_PAIRS, angles=_ANGLES) + "SELECT scene_id, round(avg(CASE WHEN angle <= 90 THEN 1.0 ELSE 0.0 END), 6) AS value FROM angles GROUP BY scene_id")
def rra_all(spark, sf_dir):
    return _r(me.rotation_accuracy(_all_two(spark, sf_dir), replace(DEFAULT, rotation_threshold_deg=90.0)), "value")


@query(ctes("all_cameras") + "SELECT scene_id, round(max(sqrt((tx-mx)*(tx-mx)+(ty-my)*(ty-my)+(tz-mz)*(tz-mz))), 6) AS scale_m FROM (SELECT *, avg(tx) OVER w AS mx, avg(ty) OVER w AS my, avg(tz) OVER w AS mz FROM all_cameras WINDOW w AS (PARTITION BY scene_id)) GROUP BY scene_id")
def scene_scale_all(spark, sf_dir):
    centres = ad.all_cameras(spark, sf_dir).select("scene_id", "cam", *[F.col(f"t{n}").alias(f"b{n}") for n in "xyz"])
    return _r(me.scene_scale(centres), "scale_m")


@query(ctes("all_cameras", m=f"SELECT *, {_Q} FROM all_cameras", local="SELECT a.scene_id, a.cam, b.r0 AS o0, b.r1 AS o1, b.r2 AS o2, b.r3 AS o3, b.r4 AS o4, b.r5 AS o5, b.r6 AS o6, b.r7 AS o7, b.r8 AS o8, b.tx AS ox, b.ty AS oy, b.tz AS oz, a.r0*(1-a.tx)+a.r3*(2-a.ty)+a.r6*(3-a.tz) AS px, a.r1*(1-a.tx)+a.r4*(2-a.ty)+a.r7*(3-a.tz) AS py, a.r2*(1-a.tx)+a.r5*(2-a.ty)+a.r8*(3-a.tz) AS pz FROM m a JOIN m b ON a.scene_id = b.scene_id AND b.cam = 0") + "SELECT scene_id, cam, round(o0*px+o1*py+o2*pz+ox, 6) AS wx, round(o3*px+o4*py+o5*pz+oy, 6) AS wy, round(o6*px+o7*py+o8*pz+oz, 6) AS wz FROM local")
def world_transform_all(spark, sf_dir):
    cams = ad.all_cameras(spark, sf_dir)
    points = cams.select("scene_id", "cam", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return _r(al.to_first_camera(points, cams).select("scene_id", "cam", "wx", "wy", "wz"), "wx", "wy", "wz")


@query(ctes("all_cameras", pairs="SELECT a.*, b.qw AS hw, b.qx AS hx, b.qy AS hy, b.qz AS hz, b.tx AS ux, b.ty AS uy, b.tz AS uz FROM all_cameras a JOIN all_cameras b ON a.scene_id=b.scene_id AND b.cam = a.cam + 1") + "SELECT scene_id, round(avg((tx-ux)*(tx-ux)+(ty-uy)*(ty-uy)+(tz-uz)*(tz-uz)) + avg(1 - abs(qw*hw+qx*hx+qy*hy+qz*hz)), 6) AS loss FROM pairs GROUP BY scene_id")
def camera_mse_all(spark, sf_dir):
    """Each camera against the next one."""
    rows = ad.all_cameras(spark, sf_dir)
    g = rows.select("scene_id", (F.col("cam") - 1).alias("cam"), *[F.col(c).alias(f"g_{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    return _r(lo.camera_loss(rows.join(g, ["scene_id", "cam"]), ["scene_id"]), "loss")
