"""Registered queries over cameras, observations and landmarks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import mapping
from ..registry import query
from ..sources.fixtures import in_camera, in_world, v_cam, v_land, v_match, v_obs, v_pix

_P = ", ".join(f"{e} AS {n}" for e, n in zip(in_camera("x", "y", "z", "p."), ("px", "py", "pz"), strict=True))
_ERR = f"e0 AS (SELECT p.*, l.x, l.y, l.z, {_P} FROM v_pix p JOIN v_land l USING (track)), er AS (SELECT *, sqrt(pow(fx * px / pz + cx - u, 2) + pow(fy * py / pz + cy - v, 2)) AS error FROM e0)"


def _errors(spark, d):
    return mapping.with_error(v_pix(spark, d), v_land(spark, d))


@query("camera_support", "SELECT frame, count(*) AS observations FROM v_obs GROUP BY frame")
def camera_support(spark, d):
    return mapping.camera_support(v_obs(spark, d))


@query("covisibility_edges", "WITH f AS (SELECT track, min(frame) AS first FROM v_obs GROUP BY track) SELECT DISTINCT first AS u, frame AS v FROM v_obs JOIN f USING (track) WHERE frame > first")
def covisibility_edges(spark, d):
    return mapping.covisibility_edges(v_obs(spark, d))


@query(
    "support_violations",
    """WITH o AS (SELECT track, frame FROM v_obs WHERE track % 97 = frame % 5 AND frame % 10 <> 7 OR track % 89 = 1 AND frame % 10 = 7),
    c AS (SELECT frame, count(*) AS observations FROM o GROUP BY frame), b AS (SELECT frame, count(*) AS before FROM v_obs GROUP BY frame),
    f AS (SELECT CAST(range AS BIGINT) AS frame FROM range(104)), e AS (SELECT DISTINCT a.frame AS u, z.frame AS v FROM o a JOIN o z USING (track)),
    w(node) AS (SELECT 0::BIGINT UNION SELECT v FROM w JOIN e ON e.u = w.node)
    SELECT frame, coalesce(observations, 0) AS observations, coalesce(before, -1) AS before, frame IN (SELECT node FROM w) AS connected FROM f LEFT JOIN c USING (frame) LEFT JOIN b USING (frame)
    WHERE coalesce(observations, 0) < 6 OR frame NOT IN (SELECT node FROM w)""".replace("WITH o", "WITH RECURSIVE o", 1),
)
def support_violations(spark, d):
    """Every tenth frame sees tracks of its own, so it has observations enough but nothing that joins it to the first."""
    obs = v_obs(spark, d)
    cameras = spark.range(104).withColumnRenamed("id", "frame")
    seen = obs.where("track % 97 = frame % 5 AND frame % 10 <> 7 OR track % 89 = 1 AND frame % 10 = 7")
    return mapping.support_violations(cameras, seen, mapping.camera_support(obs)).withColumn("before", F.coalesce("before", F.lit(-1)))


@query("stable_anchors", f"WITH {_ERR} SELECT track, count(*) FILTER (round(error, 6) <= 3) AS support FROM er GROUP BY track HAVING count(*) FILTER (round(error, 6) <= 3) >= 3")
def stable_anchors(spark, d):
    return mapping.stable_anchors(_errors(spark, d).withColumn("error", F.round("error", 6)))


@query("disjoint_maps", "SELECT frame, count(*) AS observations FROM v_obs WHERE (track % 3 = 0 AND frame < 40) OR (track % 3 = 1 AND frame >= 60) GROUP BY frame")
def disjoint_maps(spark, d):
    obs, cams = v_obs(spark, d), v_obs(spark, d).select("frame").distinct()
    parts = [(cams.where("frame < 40"), obs.where("track % 3 = 0 AND frame < 40")), (cams.where("frame >= 60"), obs.where("track % 3 = 1 AND frame >= 60"))]
    cameras, observations = mapping.disjoint_union(parts)
    return mapping.camera_support(observations).join(cameras, "frame")


@query("reprojection_error", f"WITH {_ERR} SELECT track, frame, round(error, 6) AS error FROM er")
def reprojection_error(spark, d):
    return _errors(spark, d).select("track", "frame", F.round("error", 6).alias("error"))


_W = in_world("(u - cx) / fx * d", "(v - cy) / fy * d", "d")


@query("backproject", f"SELECT track, frame, round({_W[0]}, 6) AS x, round({_W[1]}, 6) AS y, round({_W[2]}, 6) AS z FROM v_pix")
def backproject(spark, d):
    world = G.back_project(*[F.col(c) for c in ("u", "v", "d", "fx", "fy", "cx", "cy")], [F.col("r")[i] for i in range(9)], [F.col("c0"), F.col("c1"), F.col("c2")])
    return v_pix(spark, d).select("track", "frame", *[F.round(p, 6).alias(n) for p, n in zip(world, "xyz", strict=True)])


_C, _S = math.cos(0.3), math.sin(0.3)


@query(
    "sim3_transform",
    f"SELECT track, round(1.5::DOUBLE * ({_C!r}::DOUBLE * x - {_S!r}::DOUBLE * y) + 1, 6) AS x, round(1.5::DOUBLE * ({_S!r}::DOUBLE * x + {_C!r}::DOUBLE * y) + 2, 6) AS y, round(1.5::DOUBLE * z + 3, 6) AS z FROM v_land",
)
def sim3_transform(spark, d):
    r = [F.lit(v) for v in (_C, -_S, 0.0, _S, _C, 0.0, 0.0, 0.0, 1.0)]
    moved = G.sim3(F.lit(1.5), r, [F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.col(c) for c in "xyz"])
    return v_land(spark, d).select("track", *[F.round(p, 6).alias(n) for p, n in zip(moved, "xyz", strict=True)])


@query(
    "center_scale_votes",
    """WITH b AS (SELECT frame, c0, c1, c2, c0 * 0.5::DOUBLE AS l0, c1 * 0.5::DOUBLE + CASE WHEN frame % 11 = 0 THEN 2 ELSE 0 END AS l1, c2 * 0.5::DOUBLE AS l2 FROM v_cam),
    p AS (SELECT a.frame AS i, b.frame AS j, sqrt(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2)) AS tn, sqrt(pow(a.l0 - b.l0, 2) + pow(a.l1 - b.l1, 2)) AS sn, (a.l0 - b.l0) * (a.c0 - b.c0) + (a.l1 - b.l1) * (a.c1 - b.c1) AS dot FROM b a JOIN b ON b.frame < a.frame)
    SELECT i, j, round(dot / (sn * sn), 6) AS scale FROM p WHERE tn > 1 AND sn > 0.5 AND dot / (sn * tn) >= 0.8""",
)
def center_scale_votes(spark, d):
    cam = v_cam(spark, d)
    half = F.lit(0.5)
    local = cam.select("frame", (F.col("c0") * half).alias("c0"), (F.col("c1") * half + F.when(F.col("frame") % 11 == 0, 2).otherwise(0)).alias("c1"), (F.col("c2") * half).alias("c2"))
    # Scales are above 0. F.round goes by decimal numbers, which here costs more than all the rest.
    return mapping.center_scale_votes(cam, local, 1.0, 0.5).withColumn("scale", F.floor(F.col("scale") * 1e6 + 0.5) / 1e6)


_ROT = "rot AS (SELECT frame, cos(frame * 0.01::DOUBLE + CASE WHEN frame % 11 = 0 THEN 0.5 ELSE 0 END) AS c, sin(frame * 0.01::DOUBLE + CASE WHEN frame % 11 = 0 THEN 0.5 ELSE 0 END) AS s FROM v_cam)"
_ANGLE = "acos(least(1, greatest(-1, (a.c * b.c + a.s * b.s + a.s * b.s + a.c * b.c + 1 - 1) / 2)))"


def _rotations(spark, d):
    t = F.col("frame") * F.lit(0.01) + F.when(F.col("frame") % 11 == 0, 0.5).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return v_cam(spark, d).select("frame", F.array(F.cos(t), -F.sin(t), zero, F.sin(t), F.cos(t), zero, zero, zero, one).alias("r"))


@query("rotation_angles", f"WITH {_ROT} SELECT a.frame, round({_ANGLE}, 5) AS angle FROM rot a, rot b WHERE b.frame = 5 AND a.frame <> 5")
def rotation_angles(spark, d):
    rot = _rotations(spark, d)
    one = rot.where("frame = 5").select(F.col("r").alias("q"))
    angle = G.rotation_angle([F.col("r")[k] for k in range(9)], [F.col("q")[k] for k in range(9)])
    return rot.where("frame <> 5").crossJoin(one).select("frame", F.round(angle, 5).alias("angle"))


@query("rotation_medoid", f"WITH {_ROT}, c AS (SELECT a.frame, round(sum({_ANGLE}), 5) AS cost FROM rot a, rot b GROUP BY a.frame) SELECT frame, cost, frame = (SELECT frame FROM c ORDER BY cost, frame LIMIT 1) AS medoid FROM c")
def rotation_medoid(spark, d):
    return mapping.rotation_costs(_rotations(spark, d))


@query("shared_intrinsics", "SELECT quantile_cont(fx, 0.5) AS fx, quantile_cont(fy, 0.5) AS fy, quantile_cont(cx, 0.5) AS cx, quantile_cont(cy, 0.5) AS cy FROM v_cam")
def shared_intrinsics(spark, d):
    return mapping.shared_intrinsics(v_cam(spark, d))


@query(
    "landmark_init",
    f"""WITH b AS (SELECT *, {_W[0]} AS bx, {_W[1]} AS bym, {_W[2]} AS bz FROM v_pix),
    l AS (SELECT track, quantile_cont(bx, 0.5) AS x, quantile_cont(bym, 0.5) AS y, quantile_cont(bz, 0.5) AS z FROM b GROUP BY track),
    c AS (SELECT p.*, l.x, l.y, l.z, {_P} FROM v_pix p JOIN l USING (track)),
    e AS (SELECT track, x, y, z, sqrt(pow(fx * px / pz + cx - u, 2) + pow(fy * py / pz + cy - v, 2)) AS error FROM c WHERE pz > 0)
    SELECT track, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, count(*) AS views FROM e WHERE error <= 14 GROUP BY ALL HAVING count(*) >= 3""",
)
def landmark_init(spark, d):
    made = mapping.initialize_landmarks(v_pix(spark, d))
    return made.select("track", *[F.round(c, 6).alias(c) for c in "xyz"], "views")


@query("prune_landmarks", f"WITH {_ERR} SELECT track, count(*) AS views FROM er WHERE round(error, 6) <= 3 GROUP BY track HAVING count(*) >= 3")
def prune_landmarks(spark, d):
    return mapping.prune_landmarks(_errors(spark, d).withColumn("error", F.round("error", 6)))


@query(
    "holdout_validation",
    f"""WITH {_ERR}, held AS (SELECT track, frame FROM v_pix WHERE track % 4 = 0 AND frame % 5 = 0),
    sup AS (SELECT h.track, h.frame, count(*) AS support FROM held h JOIN v_pix t ON t.track = h.track AND t.frame <> h.frame WHERE (t.track + t.frame) % 3 <> 0 GROUP BY ALL),
    r AS (SELECT h.frame, round(e.error, 6) AS error, coalesce(s.support, 0) AS support FROM held h LEFT JOIN (SELECT * FROM er WHERE track % 13 <> 0) e ON e.track = h.track AND e.frame = h.frame LEFT JOIN sup s ON s.track = h.track AND s.frame = h.frame),
    a AS (SELECT frame, count(*) AS holdouts, count(*) FILTER (error IS NOT NULL AND support >= 2 AND error <= 5) AS passed, count(*) FILTER (error IS NULL) AS missing, count(*) FILTER (error IS NOT NULL AND support < 2) AS unsupported, count(*) FILTER (error IS NOT NULL AND support >= 2 AND error > 5) AS failed FROM r GROUP BY frame)
    SELECT *, holdouts < 5 OR passed >= 0.75 * holdouts AS accepted FROM a""",
)
def holdout_validation(spark, d):
    pix = v_pix(spark, d)
    held = pix.where("track % 4 = 0 AND frame % 5 = 0").select("track", "frame")
    training = held.withColumnRenamed("frame", "held_frame").join(pix.select("track", "frame", "u", "v"), "track").where("frame <> held_frame")
    errors = _errors(spark, d).where("track % 13 <> 0").select("track", "frame", F.round("error", 6).alias("error"))
    return mapping.validate_holdouts(held, training, pix.where("(track + frame) % 3 <> 0").select("track", "frame", "u", "v"), errors)


@query("huber_residuals", f"WITH {_ERR} SELECT track, frame, round(CASE WHEN error > 3 THEN sqrt(3 / error * (2 - 3 / error)) ELSE 1 END, 6) AS weight, round(error * CASE WHEN error > 3 THEN sqrt(3 / error * (2 - 3 / error)) ELSE 1 END, 6) AS residual FROM er")
def huber_residuals(spark, d):
    w = G.huber_weight(F.col("error"), 3.0)
    return _errors(spark, d).select("track", "frame", F.round(w, 6).alias("weight"), F.round(F.col("error") * w, 6).alias("residual"))


_TLS = "CASE WHEN e <= 0.5 / 1.5 * 9 THEN 1 WHEN e >= 1.5 / 0.5 * 9 THEN 0 ELSE sqrt(9 * 0.5 * 1.5 / e) - 0.5 END"


@query("gnc_tls_weights", f"WITH m AS (SELECT source, target, source_feature, (au - bu) * (au - bu) / 1e6 AS e FROM v_match) SELECT source, target, source_feature, round(CAST({_TLS} AS DOUBLE), 6) AS weight FROM m")
def gnc_tls_weights(spark, d):
    e = (F.col("au") - F.col("bu")) * (F.col("au") - F.col("bu")) / F.lit(1e6)
    return v_match(spark, d).select("source", "target", "source_feature", F.round(G.tls_weight(e, 0.5, 3.0), 6).alias("weight"))


@query(
    "gnc_round_stats",
    f"""WITH {_ERR}, w AS (SELECT track % 10 AS grp, track, round(CAST({_TLS} AS DOUBLE), 6) AS rw FROM (SELECT *, round(error * error, 6) AS e FROM er)),
    t AS (SELECT grp, track, count(*) FILTER (rw > 0.01 AND rw < 0.99) AS soft, count(*) FILTER (rw > 0.01) AS active FROM w GROUP BY ALL)
    SELECT grp, CAST(sum(soft) AS BIGINT) AS soft, count(*) FILTER (active < 3) AS frozen FROM t GROUP BY grp""",
)
def gnc_round_stats(spark, d):
    e = F.round(F.col("error") * F.col("error"), 6)
    weighted = _errors(spark, d).select((F.col("track") % 10).alias("grp"), "track", F.round(G.tls_weight(e, 0.5, 3.0), 6).alias("root_weight"))
    return mapping.gnc_round(weighted, ["grp"])


@query(
    "ba_error_stats",
    f"""WITH {_ERR}, q AS (SELECT frame, round(error * error, 6) AS e FROM er)
    SELECT frame, count(*) AS n, count(*) AS finite, count(*) FILTER (e <= 9) AS within, round(sum(least(e, 9)), 3) AS tls_cost, round(list_sort(list(sqrt(e)))[count(*) // 2 + 1], 6) AS median FROM q GROUP BY frame""",
)
def ba_error_stats(spark, d):
    rows = _errors(spark, d).select("frame", F.round(F.col("error") * F.col("error"), 6).alias("error2"))
    return mapping.error_statistics(rows, ["frame"]).withColumn("tls_cost", F.round("tls_cost", 3)).withColumn("median", F.round("median", 6))


@query(
    "ba_residuals",
    f"""WITH {_ERR}, q AS (SELECT track, frame, fx * px / greatest(pz, 1e-4) + cx - u AS ru, fy * py / greatest(pz, 1e-4) + cy - v AS rv, 1000 * least(pz - 1e-4, 0) AS r2 FROM er),
    h AS (SELECT *, sqrt(ru * ru + rv * rv) AS r FROM q) SELECT track, frame, round(ru * CASE WHEN r > 3 THEN sqrt(3 / r * (2 - 3 / r)) ELSE 1 END, 6) AS r0, round(rv * CASE WHEN r > 3 THEN sqrt(3 / r * (2 - 3 / r)) ELSE 1 END, 6) AS r1, CAST(r2 AS DOUBLE) AS r2 FROM h""",
)
def ba_residuals(spark, d):
    return mapping.residuals(_errors(spark, d)).select("track", "frame", F.round("r0", 6).alias("r0"), F.round("r1", 6).alias("r1"), "r2")


#: Derivatives of the two pixel coordinates by the point in the world.
_JACOBIAN = ", ".join(f"fx / pz * r[{3 * k + 1}] - fx * px / (pz * pz) * r[{3 * k + 3}] AS u{k}, fy / pz * r[{3 * k + 2}] - fy * py / (pz * pz) * r[{3 * k + 3}] AS v{k}" for k in range(3))


@query(
    "ba_normal_blocks",
    f"""WITH {_ERR}, j AS (SELECT track, {_JACOBIAN} FROM er) SELECT track, {", ".join(f"round(sum(u{i} * u{k} + v{i} * v{k}), 3) AS h{i}{k}" for i in range(3) for k in range(i, 3))} FROM j GROUP BY track""",
)
def ba_normal_blocks(spark, d):
    blocks = mapping.point_blocks(_errors(spark, d))
    return blocks.select("track", *[F.round(c, 3).alias(c) for c in blocks.columns if c != "track"])


_MAP = "m AS (SELECT track, frame, u, v FROM v_obs WHERE frame < 60), l AS (SELECT track, frame, u + CASE WHEN track % 7 = 0 THEN 1 ELSE 1e-5 END AS u, v, CAST(floor(u) % 20 AS DOUBLE) AS error FROM v_obs WHERE frame >= 40)"


def _maps(spark, d):
    obs = v_obs(spark, d)
    shift = F.when(F.col("track") % 7 == 0, F.lit(1.0)).otherwise(F.lit(1e-5))
    local = obs.where("frame >= 40").select("track", "frame", (F.col("u") + shift).alias("u"), "v", (F.floor("u") % 20).cast("double").alias("error"))
    return obs.where("frame < 60"), local


@query(
    "merge_maps",
    f"""WITH {_MAP}, bad AS (SELECT DISTINCT m.track FROM m JOIN l USING (track, frame) WHERE sqrt(pow(m.u - l.u, 2) + pow(m.v - l.v, 2)) > 1e-3),
    i AS (SELECT track, frame, u, v FROM l WHERE track NOT IN (SELECT track FROM bad) AND error <= CASE WHEN track IN (SELECT track FROM m) THEN 4 ELSE 14 END AND NOT EXISTS (SELECT 1 FROM m WHERE m.track = l.track AND m.frame = l.frame)),
    r AS (SELECT *, 'map' AS origin FROM m UNION ALL SELECT *, 'local' AS origin FROM i) SELECT track, frame, round(u, 6) AS u, v, origin FROM r WHERE track IN (SELECT track FROM r GROUP BY track HAVING count(*) >= 3)""",
)
def merge_maps(spark, d):
    accepted, local = _maps(spark, d)
    return mapping.merge_maps(accepted, local).withColumn("u", F.round("u", 6))


@query("same_pixel_join", f"WITH {_MAP} SELECT m.track, m.frame FROM m JOIN l ON m.track = l.track AND m.frame = l.frame AND round_even(m.u * 10000, 0) = round_even(l.u * 10000, 0) AND round_even(m.v * 10000, 0) = round_even(l.v * 10000, 0)")
def same_pixel_join(spark, d):
    accepted, local = _maps(spark, d)
    return mapping.same_pixel(accepted, local).select("track", "frame")


@query("shared_cameras", f"WITH {_MAP} SELECT frame, accepted_support, local_support FROM (SELECT frame, count(*) AS accepted_support FROM m GROUP BY frame) JOIN (SELECT frame, count(*) AS local_support FROM l GROUP BY frame) USING (frame)")
def shared_cameras(spark, d):
    return mapping.shared_cameras(*_maps(spark, d))


@query(
    "retained_loops",
    "WITH k AS (SELECT track, min(frame) AS source, max(frame) AS target FROM v_obs GROUP BY track HAVING max(frame) - min(frame) > 30), o AS (SELECT track, frame FROM v_obs WHERE (track + frame) % 4 <> 0) SELECT k.* FROM k WHERE EXISTS (SELECT 1 FROM o WHERE o.track = k.track AND o.frame = source) AND EXISTS (SELECT 1 FROM o WHERE o.track = k.track AND o.frame = target)",
)
def retained_loops(spark, d):
    obs = v_obs(spark, d)
    links = obs.groupBy("track").agg(F.min("frame").alias("source"), F.max("frame").alias("target")).where("target - source > 30")
    return mapping.retained_loops(links, obs.where("(track + frame) % 4 <> 0"))
