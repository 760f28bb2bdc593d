"""Registered queries over depths and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense
from ..registry import query
from ..sources.fixtures import in_camera, in_world, v_depth, v_grid, v_land, v_pix, v_points, v_view

W_, H_ = 64, 48
_COS = "round(cos(radians(0.5)), 12)"


def _measured(points: str, name: str) -> str:
    """SQL of the agreement of ``points(frame, x, y, red, green, blue, z)``."""
    camera = lambda mark: ", ".join(f"{mark}.{c} AS {mark}_{c}" for c in ("fx", "fy", "cx", "cy", "c0", "c1", "c2", "r"))
    w = in_world("(x - a_cx) / a_fx * z", "(y - a_cy) / a_fy * z", "z", "a_")
    k = in_camera("w0", "w1", "w2", "n_")
    s = in_world("(pu - n_cx) / n_fx * zn", "(pv - n_cy) / n_fy * zn", "zn", "n_")
    e = in_camera("s0", "s1", "s2", "a_")
    dot = lambda p, q: " + ".join(f"(w{i} - {p}c{i}) * (w{i} - {q}c{i})" for i in range(3))
    return f"""{name}0 AS (SELECT p.*, n.frame AS neighbor, {camera("a")}, {camera("n")} FROM {points} p JOIN v_view a ON a.frame = p.frame JOIN v_view n ON abs(n.frame - p.frame) IN (1, 2, 4)),
    {name}1 AS (SELECT *, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2 FROM {name}0),
    {name}2 AS (SELECT *, {k[0]} AS k0, {k[1]} AS k1, {k[2]} AS k2 FROM {name}1),
    {name}3 AS (SELECT *, n_fx * k0 / k2 + n_cx AS pu, n_fy * k1 / k2 + n_cy AS pv FROM {name}2 WHERE k2 > 0),
    {name}4 AS (SELECT b.*, s.depth AS zn, (abs(b.red - s.red) + abs(b.green - s.green) + abs(b.blue - s.blue)) / 3 AS apart FROM {name}3 b JOIN v_grid s ON s.frame = b.neighbor AND s.x = CAST(round_even(pu, 0) AS BIGINT) AND s.y = CAST(round_even(pv, 0) AS BIGINT) WHERE pu BETWEEN 0 AND 63 AND pv BETWEEN 0 AND 47 AND s.depth > 0),
    {name}5 AS (SELECT *, {s[0]} AS s0, {s[1]} AS s1, {s[2]} AS s2 FROM {name}4),
    {name}6 AS (SELECT *, {e[0]} AS b0, {e[1]} AS b1, {e[2]} AS back FROM {name}5),
    {name}7 AS (SELECT *, abs(k2 - zn) / zn AS relative, sqrt(pow(a_fx * b0 / back + a_cx - x, 2) + pow(a_fy * b1 / back + a_cy - y, 2)) AS cycle, ({dot("a_", "n_")}) / (sqrt({dot("a_", "a_")}) * sqrt({dot("n_", "n_")})) AS cosine FROM {name}6),
    {name} AS (SELECT *, back > 0 AND round(relative, 9) <= 0.05 AND round(cycle, 9) <= 2 AND round(apart, 9) <= 0.15 AND round(cosine, 12) < {_COS} AS agree FROM {name}7)"""


@query(
    "depth_confidence_filter",
    "WITH t AS (SELECT frame, quantile_cont(conf, 0.3) AS threshold FROM v_depth WHERE raw > 0 GROUP BY frame) SELECT frame, round(threshold, 9) AS threshold, count(*) AS kept FROM v_depth JOIN t USING (frame) WHERE raw > 0 AND round(conf, 9) >= round(threshold, 9) GROUP BY ALL",
)
def depth_confidence_filter(spark, d):
    kept = dense.confidence_filter(v_depth(spark, d).withColumnRenamed("raw", "depth"))
    return kept.groupBy("frame", F.round("threshold", 9).alias("threshold")).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "depth_calibration",
    """WITH r AS (SELECT frame, ln(opt / raw) AS lr FROM v_depth), m AS (SELECT frame, quantile_cont(lr, 0.5) AS log_scale, count(*) AS anchors FROM r GROUP BY frame),
    s AS (SELECT frame, quantile_cont(abs(lr - log_scale), 0.5) AS mad FROM r JOIN m USING (frame) GROUP BY frame)
    SELECT frame, round(log_scale, 9) AS log_scale, anchors, round(mad, 9) AS mad, CASE WHEN anchors < 6 THEN 'too few anchors' WHEN round(mad, 9) > 0.68 THEN 'inconsistent scale' ELSE 'accepted' END AS reason FROM m JOIN s USING (frame)""",
)
def depth_calibration(spark, d):
    out = dense.calibrate(v_depth(spark, d).select("frame", F.ln(F.col("opt") / F.col("raw")).alias("log_ratio")), most_spread=0.68)
    return out.select("frame", F.round("log_scale", 9).alias("log_scale"), "anchors", F.round("mad", 9).alias("mad"), F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query("depth_gauge", "SELECT frame, count(*) AS samples, round(exp(quantile_cont(ln(opt / raw), 0.5)), 4) AS factor, round(quantile_cont(opt, 0.5), 6) AS scene_depth FROM v_depth GROUP BY frame HAVING count(*) >= 3")
def depth_gauge(spark, d):
    return dense.depth_gauge(v_depth(spark, d)).select("frame", "samples", F.round("factor", 4).alias("factor"), F.round("scene_depth", 6).alias("scene_depth"))


@query("dense_scale", "WITH f AS (SELECT frame, quantile_cont(ln(opt / raw), 0.5) AS lr FROM v_depth WHERE part % 4 = 0 GROUP BY frame) SELECT round(exp(quantile_cont(lr, 0.5)), 6) AS scale, count(*) AS frames FROM f")
def dense_scale(spark, d):
    pixels = v_depth(spark, d).select("frame", F.col("part").alias("pixel"), F.col("opt").alias("da"), F.col("raw").alias("db"))
    return dense.dense_scale(pixels, 4).select(F.round("scale", 6).alias("scale"), "frames")


@query("multiview_consistency", f"WITH p AS (SELECT *, depth AS z FROM v_grid), {_measured('p', 'q')} SELECT frame, neighbor, x, y, round(relative, 6) AS relative, round(cycle, 6) AS cycle, round(back, 6) AS back, agree, round(CASE WHEN agree THEN 1 / (1 + pow(relative / 0.02, 2)) ELSE 0 END, 6) AS weight FROM q")
def multiview_consistency(spark, d):
    grid = v_grid(spark, d)
    rows = dense.measure(grid.withColumn("z", F.col("depth")), grid, v_view(spark, d), W_, H_)
    return rows.select("frame", "neighbor", "x", "y", F.round("relative", 6).alias("relative"), F.round("cycle", 6).alias("cycle"), F.round("back", 6).alias("back"), "agree", F.round("weight", 6).alias("weight"))


_CONSENSUS = f"""p AS (SELECT *, depth AS z FROM v_grid), {_measured('p', 'q')},
    w AS (SELECT frame, x, y, sum(1 / (1 + pow(relative / 0.02, 2))) AS ws, sum(1 / (1 + pow(relative / 0.02, 2)) / back) AS wz FROM q WHERE agree GROUP BY ALL),
    g AS (SELECT v.*, round((1 + coalesce(ws, 0)) / (1 / depth + coalesce(wz, 0)), 9) AS z FROM v_grid v LEFT JOIN w USING (frame, x, y)), {_measured('g', 'k')},
    sup AS (SELECT frame, x, y, count(*) FILTER (agree) AS support FROM k GROUP BY ALL),
    con AS (SELECT g.frame, g.x, g.y, depth, z, coalesce(support, 0) AS support, coalesce(support, 0) >= 2 AS accepted FROM g LEFT JOIN sup USING (frame, x, y))"""


@query("depth_consensus", f"WITH {_CONSENSUS} SELECT frame, x, y, round(CASE WHEN accepted THEN z ELSE depth END, 6) AS refined, support, accepted FROM con")
def depth_consensus(spark, d):
    return dense.consensus(v_grid(spark, d), v_view(spark, d), W_, H_).select("frame", "x", "y", F.round("refined", 6).alias("refined"), "support", "accepted")


@query("dense_coverage", f"WITH {_CONSENSUS} SELECT frame, count(*) FILTER (accepted) AS supported, count(*) AS total, round(quantile_cont(CASE WHEN accepted THEN z ELSE depth END, 0.5), 6) AS median_depth FROM con GROUP BY frame")
def dense_coverage(spark, d):
    return dense.coverage(dense.consensus(v_grid(spark, d), v_view(spark, d), W_, H_)).withColumn("median_depth", F.round("median_depth", 6))


@query(
    "voxel_fusion",
    """SELECT CAST(floor(x / 10) AS BIGINT) AS vx, CAST(floor(y / 10) AS BIGINT) AS vy, CAST(floor(z / 10) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z,
    CAST(least(255, greatest(0, round(avg(red), 0))) AS INT) AS red, CAST(least(255, greatest(0, round(avg(green), 0))) AS INT) AS green, CAST(least(255, greatest(0, round(avg(blue), 0))) AS INT) AS blue, count(*) AS n, min(frame) AS first_frame FROM v_points GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY floor(x / 10), floor(y / 10), floor(z / 10)"),
)
def voxel_fusion(spark, d):
    cells = dense.voxel_fusion(v_points(spark, d), 10.0, 5_000_000)
    return cells.select("vx", "vy", "vz", *[F.round(c, 6).alias(c) for c in "xyz"], "red", "green", "blue", "n", "first_frame")


_PIXELS = "px AS (SELECT frame, CAST(round_even(u, 0) AS BIGINT) AS x, CAST(round_even(v, 0) AS BIGINT) AS y, max(CASE WHEN track % 6 = 0 THEN -1 ELSE d * (1 + track % 4 * 0.1::DOUBLE) END) AS depth FROM v_pix WHERE u BETWEEN -0.4 AND 639.4 AND v BETWEEN -0.4 AND 479.4 AND track % 5 <> 0 GROUP BY ALL)"
_ANCHOR = in_camera("l.x", "l.y", "l.z", "p.")


@query(
    "sparse_anchors",
    f"""WITH {_PIXELS}, e AS (SELECT p.track, p.frame, u, v, fx, fy, cx, cy, {_ANCHOR[0]} AS p0, {_ANCHOR[1]} AS p1, {_ANCHOR[2]} AS p2 FROM v_pix p JOIN v_land l USING (track)),
    a AS (SELECT *, CAST(round_even(u, 0) AS BIGINT) AS x, CAST(round_even(v, 0) AS BIGINT) AS y FROM e WHERE p2 > 0 AND round(sqrt(pow(fx * p0 / p2 + cx - u, 2) + pow(fy * p1 / p2 + cy - v, 2)), 9) <= 3)
    SELECT frame, track, round(depth, 6) AS raw, round(p2, 6) AS opt, round(ln(p2 / depth), 6) AS log_ratio FROM a JOIN px USING (frame, x, y) WHERE depth > 0""",
)
def sparse_anchors(spark, d):
    """Depth pixels are predicted where observations lie, some invalid, some missing, some off in scale."""
    seen = v_pix(spark, d)
    scaled = F.when(F.col("track") % 6 == 0, -1.0).otherwise(F.col("d") * (1 + F.col("track") % 4 * F.lit(0.1)))
    inside = seen.where("u BETWEEN -0.4 AND 639.4 AND v BETWEEN -0.4 AND 479.4 AND track % 5 <> 0")
    pixels = inside.groupBy("frame", F.rint("u").cast("bigint").alias("x"), F.rint("v").cast("bigint").alias("y")).agg(F.max(scaled).alias("depth"))
    out = dense.sparse_anchors(seen, v_land(spark, d), pixels)
    return out.select("frame", "track", *[F.round(c, 6).alias(c) for c in ("raw", "opt", "log_ratio")])
