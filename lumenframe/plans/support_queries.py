"""Registered queries of the supporting operators: lookups, checks, previews, bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import bridges, dense, graph, images, mapping, matching, scan, windows
from ..registry import query
from ..sources.fixtures import v_cam, v_depth, v_frames, v_land, v_match, v_obs, v_pix, v_points
from .map_queries import _ERR, _maps, _MAP
from .match_queries import _PLAN, _loop_pairs, _plan

_INDEX = "ix AS (SELECT ticks, candidate, event_type = 'signup' AS is_key FROM v_frames)"


def _index(spark, d):
    return v_frames(spark, d).select("ticks", "candidate", (F.col("event_type") == "signup").alias("is_key"))


@query("head_limit", "SELECT candidate, ts_s FROM v_frames ORDER BY ts_s LIMIT 120")
def head_limit(spark, d):
    return scan.head(v_frames(spark, d), 120).select("candidate", "ts_s")


@query(
    "packet_index",
    """WITH p AS (SELECT ticks, event_type = 'signup' AS is_key, candidate % 23 = 5 AS is_discard FROM v_frames), s AS (SELECT * FROM p WHERE NOT is_discard)
    SELECT (SELECT count(*) FROM s) AS packets, (SELECT count(*) FROM s WHERE is_key) AS keys, (SELECT count(*) FROM p WHERE is_discard) AS discarded, (SELECT min(ticks) FROM s) AS first, (SELECT max(ticks) FROM s) AS last,
      (SELECT count(*) = count(DISTINCT ticks) FROM s) AND (SELECT bool_or(is_key) FROM s WHERE ticks = (SELECT min(ticks) FROM s)) AS eligible""",
)
def packet_index(spark, d):
    packets = v_frames(spark, d).select("ticks", (F.col("event_type") == "signup").alias("is_key"), (F.col("candidate") % 23 == 5).alias("is_discard"))
    return scan.packet_index(packets)


@query("requested_frames", "SELECT ticks, candidate, feature_count FROM v_frames WHERE feature_count % 9 = 4")
def requested_frames(spark, d):
    frames = v_frames(spark, d).select("ticks", "candidate", "feature_count")
    return scan.requested_frames(frames, frames.where("feature_count % 9 = 4"))


@query(
    "section_preroll",
    f"""WITH {_INDEX}, r AS (SELECT ticks, is_key, row_number() OVER (ORDER BY ticks) - 1 AS rn, count(*) OVER () AS n FROM ix), t AS (SELECT ticks AS target FROM r WHERE rn > 0 AND rn IN (n // 4, n * 2 // 4, n * 3 // 4)),
    b AS (SELECT ticks AS "begin" FROM r WHERE rn = 0 UNION SELECT (SELECT min(ticks) FROM ix WHERE is_key AND ticks >= target) FROM t),
    e AS (SELECT "begin", lead("begin") OVER (ORDER BY "begin") AS "end", row_number() OVER (ORDER BY "begin") - 1 AS section FROM b WHERE "begin" IS NOT NULL), k AS (SELECT ticks, lag(ticks, 2) OVER (ORDER BY ticks) AS preroll FROM ix WHERE is_key)
    SELECT CAST(section AS BIGINT) AS section, coalesce(preroll, "begin") AS preroll, count(*) AS packets FROM e JOIN ix ON ix.ticks >= "begin" AND ("end" IS NULL OR ix.ticks < "end") LEFT JOIN k ON k.ticks = "begin" GROUP BY ALL""",
)
def section_preroll(spark, d):
    index = _index(spark, d)
    return scan.sections(index, scan.range_partition(index, 4)).groupBy(F.col("section").cast("long").alias("section"), "preroll").agg(F.count(F.lit(1)).alias("packets"))


@query("order_violations", "WITH v AS (SELECT candidate, CASE WHEN candidate % 400 = 7 THEN ts_s - 100000 ELSE ts_s END AS t FROM v_frames), l AS (SELECT *, lag(t) OVER (ORDER BY candidate) AS p FROM v) SELECT candidate FROM l WHERE t <= p")
def order_violations(spark, d):
    shifted = v_frames(spark, d).select("candidate", F.when(F.col("candidate") % 400 == 7, F.col("ts_s") - 100000).otherwise(F.col("ts_s")).alias("t"))
    return scan.violations_of_order(shifted, "candidate", "t").select("candidate")


@query("canvas_scale", "SELECT frame, w * (frame % 7 + 1) AS width, round(least(1.0::DOUBLE, 1024.0::DOUBLE / (w * (frame % 7 + 1)), 768.0::DOUBLE / h), 9) AS scale, CAST(greatest(1, round(w * (frame % 7 + 1) * least(1.0::DOUBLE, 1024.0::DOUBLE / (w * (frame % 7 + 1)), 768.0::DOUBLE / h))) AS INT) AS canvas_w FROM v_cam")
def canvas_scale(spark, d):
    width = F.col("w") * (F.col("frame") % 7 + 1)
    scale, w, _ = G.canvas_scale(width, F.col("h"), 1024, 768)
    return v_cam(spark, d).select("frame", width.alias("width"), F.round(scale, 9).alias("scale"), w.alias("canvas_w"))


@query("inverse_pose", "SELECT frame, round(-(cos(frame * 0.01::DOUBLE) * c0 + sin(frame * 0.01::DOUBLE) * c1), 6) AS x, round(-(-sin(frame * 0.01::DOUBLE) * c0 + cos(frame * 0.01::DOUBLE) * c1), 6) AS y, round(-c2, 6) + 0.0 AS z FROM v_cam")
def inverse_pose(spark, d):
    a = F.col("frame") * F.lit(0.01)
    zero, one = F.lit(0.0), F.lit(1.0)
    _, c = G.inverse_pose([F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one], [F.col("c0"), F.col("c1"), F.col("c2")])
    return v_cam(spark, d).select("frame", *[(F.round(v, 6) + 0.0).alias(n) for v, n in zip(c, "xyz", strict=True)])


@query(
    "normalized_gauge",
    """WITH s AS (SELECT *, sqrt(pow(c0 - lag(c0) OVER (ORDER BY frame), 2) + pow(c1 - lag(c1) OVER (ORDER BY frame), 2) + pow(c2 - lag(c2) OVER (ORDER BY frame), 2)) AS step FROM v_cam),
    u AS (SELECT quantile_cont(step, 0.5) FILTER (step > 1e-8) AS unit, arg_min(c0, frame) AS o0, arg_min(c1, frame) AS o1 FROM s) SELECT frame, round((c0 - o0) / unit, 6) AS c0, round((c1 - o1) / unit, 6) AS c1 FROM v_cam, u""",
)
def normalized_gauge(spark, d):
    return mapping.normalized_gauge(v_cam(spark, d)).select("frame", F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


@query("depth_preview", "WITH q AS (SELECT frame, quantile_cont(raw, 0.02) AS lo, quantile_cont(raw, 0.98) AS hi FROM v_depth GROUP BY frame) SELECT frame, CAST(floor(round(greatest(0, least(1, (raw - lo) / greatest(hi - lo, 1e-12))) * 255, 6)) AS INT) AS grey, count(*) AS pixels FROM v_depth JOIN q USING (frame) GROUP BY ALL")
def depth_preview(spark, d):
    return images.depth_preview(v_depth(spark, d).withColumnRenamed("raw", "depth")).groupBy("frame", "grey").agg(F.count(F.lit(1)).alias("pixels"))


@query(
    "pixel_lookup",
    "SELECT track, frame, CAST(greatest(0, least(63, round_even(u / 2000, 0))) + 64 * greatest(0, least(47, round_even(v, 0))) + frame AS DOUBLE) AS d FROM v_obs",
)
def pixel_lookup(spark, d):
    """Each frame's raster holds its own pixel numbers, raised by the frame's."""
    obs = v_obs(spark, d).select("track", "frame", (F.col("u") / 2000).alias("u"), "v")
    grids = obs.select("frame").distinct().select("frame", F.lit(48).alias("h"), F.lit(64).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(64 * 48 - 1)), lambda i: (i + F.col("frame")).cast("double")).alias("depth"))
    return images.pixel_lookup(obs, grids).select("track", "frame", "d")


_CELL = "least(3, floor({v} * 4 / 51.0::DOUBLE)::INT) * 4 + least(3, floor({u} * 4 / 110000.0::DOUBLE)::INT)"


@query(
    "reliable_matches",
    f"""WITH p AS (SELECT source, target, count(*) AS matches, count(*) FILTER (inlier) AS inliers, count(DISTINCT {_CELL.format(u="au", v="av")}) FILTER (inlier) AS ca, count(DISTINCT {_CELL.format(u="bu", v="bv")}) FILTER (inlier) AS cb FROM v_match GROUP BY ALL)
    SELECT source, target, inliers, least(ca, cb) / 16 AS coverage FROM p WHERE inliers >= 60 AND inliers / matches >= 0.4 AND least(ca, cb) / 16 >= 0.8""",
)
def reliable_matches(spark, d):
    quality = matching.match_coverage(v_match(spark, d), 110000.0, 51.0, 110000.0, 51.0)
    return matching.reliable(quality, coverage=0.8).select("source", "target", "inliers", "coverage")


@query("reusable_pairs", f"WITH {_PLAN} SELECT source, target FROM plan WHERE pair_kind = 'temporal' UNION SELECT source, target FROM plan SEMI JOIN (SELECT * FROM lp WHERE source % 2 = 0) USING (source, target)")
def reusable_pairs(spark, d):
    return matching.reusable_pairs(_plan(spark, d), _loop_pairs(spark, d).where("source % 2 = 0"))


@query("holdout_suppression", f"WITH {_MAP} SELECT m.track, m.frame FROM m ANTI JOIN l ON m.track = l.track AND m.frame = l.frame AND round_even(m.u * 10000, 0) = round_even(l.u * 10000, 0) AND round_even(m.v * 10000, 0) = round_even(l.v * 10000, 0)")
def holdout_suppression(spark, d):
    accepted, local = _maps(spark, d)
    return mapping.withhold(accepted, local).select("track", "frame")


@query(
    "compatible_tracks",
    f"WITH {_MAP}, j AS (SELECT l.track, coalesce(sqrt(pow(m.u - l.u, 2) + pow(m.v - l.v, 2)), 0) AS far, error FROM l LEFT JOIN m USING (track, frame) WHERE l.track IN (SELECT track FROM m)) SELECT track, count(*) FILTER (error <= 4) AS support FROM j GROUP BY track HAVING max(far) <= 1e-3 AND count(*) FILTER (error <= 4) >= 3",
)
def compatible_tracks(spark, d):
    return mapping.compatible_tracks(*_maps(spark, d)).select("track", "support")


@query(
    "pose_targets",
    """WITH h AS (SELECT p_partkey AS track, p_partkey::UHUGEINT AS v FROM part), a AS (SELECT track, (xor(v, v >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM h),
    b AS (SELECT track, (xor(v, v >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM a), s AS (SELECT track, xor(v, v >> 31) % 5 = 0 AS held FROM b),
    r AS (SELECT p.frame, p.track, held FROM v_pix p JOIN v_land USING (track) JOIN s USING (track) WHERE u >= 0 AND v >= 0 AND u < w AND v < h),
    c AS (SELECT frame, count(*) AS n FROM r GROUP BY frame HAVING count(*) FILTER (NOT held) >= 30 AND count(*) FILTER (held) >= 10 ORDER BY n DESC, frame LIMIT 4) SELECT frame, track, held FROM r SEMI JOIN c USING (frame)""",
)
def pose_targets(spark, d):
    tracks = v_pix(spark, d).select("track", "frame", "u", "v")
    return bridges.pose_targets(v_land(spark, d), tracks, v_cam(spark, d)).select("frame", "track", "held")


@query("restored_tracks", f"WITH {_ERR}, k AS (SELECT track, frame, frame < 50 AS anchor FROM er WHERE round(error, 9) <= 3) SELECT track, count(*) AS observations, bool_or(anchor) AND bool_or(NOT anchor) AS bridges FROM k GROUP BY track")
def restored_tracks(spark, d):
    cams = v_cam(spark, d)
    cameras = cams.select("frame", "fx", "fy", "cx", "cy", "r", F.array("c0", "c1", "c2").alias("c"))
    kept = bridges.restored_tracks(v_land(spark, d), v_pix(spark, d).select("track", "frame", "u", "v"), cameras, cams.select("frame", (F.col("frame") < 50).alias("anchor")))
    return kept.groupBy("track", "bridges").agg(F.count(F.lit(1)).alias("observations"))


@query("voxel_preview", "WITH c AS (SELECT DISTINCT CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz FROM v_points), r AS (SELECT *, row_number() OVER (ORDER BY vx, vy, vz) - 1 AS pos, greatest(1, (count(*) OVER () + 99) // 100) AS stride FROM c) SELECT vx, vy, vz FROM r WHERE pos % stride = 0")
def voxel_preview(spark, d):
    return dense.preview(dense.voxel_fusion(v_points(spark, d), 5.0), 100).select("vx", "vy", "vz")


@query("display_fit", "WITH m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM v_points) SELECT round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, round(quantile_cont(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)), 0.95), 5) AS radius FROM v_points, m GROUP BY ALL")
def display_fit(spark, d):
    return images.display_fit(v_points(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("mx", "my", "mz")], F.round("radius", 5).alias("radius"))


@query("keypoint_conflicts", "WITH e AS (SELECT source AS frame, source_feature AS kp, au AS u FROM v_match UNION ALL SELECT target, target_feature, CASE WHEN target % 9 = 2 THEN bu + 0.01 ELSE bu END FROM v_match) SELECT frame, count(*) AS conflicts FROM (SELECT frame, kp FROM e GROUP BY ALL HAVING max(u) - min(u) > 1e-4) GROUP BY frame")
def keypoint_conflicts(spark, d):
    m = v_match(spark, d)
    ends = m.select(F.col("source").alias("frame"), F.col("source_feature").alias("kp"), F.col("au").alias("u")).unionByName(
        m.select(F.col("target").alias("frame"), F.col("target_feature").alias("kp"), F.when(F.col("target") % 9 == 2, F.col("bu") + 0.01).otherwise(F.col("bu")).alias("u"))
    )
    spread = ends.groupBy("frame", "kp").agg((F.max("u") - F.min("u")).alias("du")).where("du > 1e-4")
    return spread.groupBy("frame").agg(F.count(F.lit(1)).alias("conflicts"))


@query(
    "window_eligibility",
    """WITH c AS (SELECT range AS candidate, range * 7 AS base, range % 5 = 0 AS accepted, range % 7 = 3 AS blocked FROM range(15)) SELECT candidate::BIGINT AS candidate FROM c
    WHERE NOT accepted AND NOT blocked AND base + 15 >= 40 AND (candidate % 2 = 0 OR base - 3 < 40)""",
)
def window_eligibility(spark, d):
    """Windows of 16 frames, 7 apart; odd ones wait for the frame three before their first."""
    base = F.col("id") * 7
    rows = spark.range(15).select(
        F.col("id").alias("candidate"),
        F.sequence(base, base + 15).alias("frames"),
        (F.col("id") % 5 == 0).alias("accepted"),
        (F.col("id") % 7 == 3).alias("blocked"),
        F.when(F.col("id") % 2 == 1, F.array(base - 3)).otherwise(F.array().cast("array<bigint>")).alias("waiting_for"),
        F.array().cast("array<array<bigint>>").alias("attempted"),
    )
    return windows.eligible(rows, spark.range(-10, 40).withColumnRenamed("id", "frame")).select("candidate")


@query("anchor_component", "SELECT 0::BIGINT AS root, count(*) FILTER (frame < 50) AS shared, (SELECT count(DISTINCT track) FROM v_obs WHERE frame < 50) AS landmarks FROM v_cam WHERE frame < 70")
def anchor_component(spark, d):
    comps = v_cam(spark, d).select(F.col("frame").alias("node"), F.when(F.col("frame") < 50, 0).otherwise(50).cast("long").alias("root"))
    return bridges.anchor_component(comps, v_obs(spark, d), v_cam(spark, d).where("frame < 70").select("frame")).select("root", "shared", F.coalesce("landmarks", F.lit(0)).alias("landmarks"))


@query(
    "loop_links",
    """WITH isl AS (SELECT track, frame, sum(new) OVER (PARTITION BY track ORDER BY frame) AS run FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) <= 4 THEN 0 ELSE 1 END AS new FROM v_obs)),
    tr AS (SELECT track, run, min(frame) AS first, max(frame) AS last FROM isl GROUP BY ALL HAVING count(*) >= 3) SELECT first AS head_frame, track AS head_kp, first AS source, last AS target FROM tr WHERE last - first > 8""",
)
def loop_links(spark, d):
    """Loop edges from a track's first frame to its last where those are more than eight apart."""
    edges = v_match(spark, d).select(F.col("source").alias("fa"), F.col("source_feature").alias("ka"), F.col("target").alias("fb"), F.col("target_feature").alias("kb"), "confidence", F.lit(False).alias("is_loop"))
    tracks = graph.build_tracks(edges)
    ends = tracks.groupBy("head_frame", "head_kp").agg(F.min("frame").alias("fa"), F.max("frame").alias("fb")).where("fb - fa > 8")
    loops = ends.select("fa", F.col("head_kp").alias("ka"), "fb", F.col("head_kp").alias("kb"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_loop"))
    return graph.loop_links(loops, tracks)
