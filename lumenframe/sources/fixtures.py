"""Binding views: the driver's tables read as frames, descriptors, observations, matches, points, cameras, depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import camera_point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("candidate"),
        F.col("event_id").alias("source_frame"),
        ticks.alias("ticks"),
        (ticks / F.lit(1e6)).alias("ts_s"),
        (F.get_json_object("props", "$.k").cast("int") + 80).alias("feature_count"),
        F.col("value").alias("sharpness"),
        "event_type",
    )


def v_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("vec_id").cast("double").alias("ts_s"), F.col("embedding").alias("emb"), "label"
    )


def _observed(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select(F.col("l_partkey").alias("track"), (F.col("l_suppkey") % 100).alias("frame"), "l_extendedprice", "l_quantity")
    return rows.groupBy("track", "frame").agg(F.min("l_extendedprice").alias("u"), F.min("l_quantity").alias("v"))


def v_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(table(spark, sf_dir, "lineitem"))


def v_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band self-join over the four following frames: a track's observations in order, each with the next four.

    A track has one observation a frame, so no more than four lie within the band. Rows move once, by track, and
    the matches of a track stay side by side.
    """
    lineitem = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
    following = W.partitionBy("track").orderBy("source")
    obs = _observed(lineitem.repartition("l_partkey")).select("track", F.col("frame").alias("source"), F.col("u").alias("au"), F.col("v").alias("av"))
    b = F.struct(F.col("source").alias("target"), F.col("au").alias("bu"), F.col("av").alias("bv"))
    both = obs.withColumn("next", F.array(*[F.lead(b, k).over(following) for k in range(1, 5)])).withColumn("b", F.explode("next")).where("b.target <= source + 4").select("track", "source", "au", "av", "b.*")
    gap = F.abs(F.col("av") - F.col("bv"))
    return both.select(
        "source",
        "target",
        F.col("track").alias("source_feature"),
        F.col("track").alias("target_feature"),
        "au",
        "av",
        "bu",
        "bv",
        (gap <= (7 * F.col("source") + 3 * F.col("target")) % 40).alias("inlier"),
        (1 / (1 + gap)).alias("confidence"),
    )


def v_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("frame"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (F.col("l_linenumber") * 30).cast("int").alias("red"),
        F.rint(F.col("l_tax") * 1000).cast("int").alias("green"),
        F.rint("l_quantity").cast("int").alias("blue"),
    )


def turned(a: Column, b: Column) -> Column:
    """The camera-to-world rotation by ``a`` about the second axis after ``b`` about the first, row by row."""
    ca, sa, cb, sb = F.cos(a), F.sin(a), F.cos(b), F.sin(b)
    return F.array(ca, sa * sb, sa * cb, F.lit(0.0), cb, -sb, -sa, ca * sb, ca * cb)


def v_cam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera for each supplier, turned by a few degrees; places repeat every hundred."""
    focal, key = (500 + F.col("s_nationkey")).cast("double"), F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("frame"),
        focal.alias("fx"),
        focal.alias("fy"),
        F.lit(320.0).alias("cx"),
        F.lit(240.0).alias("cy"),
        (key % 100).cast("double").alias("c0"),
        (F.col("s_acctbal") / 1000).alias("c1"),
        F.lit(0.0).alias("c2"),
        F.lit(640).alias("w"),
        F.lit(480).alias("h"),
        turned((key % 7 - 3) * F.lit(0.02), (key % 5 - 2) * F.lit(0.03)).alias("r"),
    )


def v_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("frame"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("raw"),
        (F.col("l_extendedprice") / 1000).alias("opt"),
        (1 - F.col("l_tax")).alias("conf"),
    )


def v_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as every supplier sees them."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track"), F.col("l_suppkey").alias("frame"))
    return rows.agg(F.min("l_extendedprice").alias("raw_u"), F.min("l_quantity").alias("raw_v"))


def v_pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as pixels of known points seen by the turned cameras, with bounded errors; d is the depth in the camera."""
    rows = v_seen(spark, sf_dir).join(v_cam(spark, sf_dir), "frame")
    point = [(F.col("track") % 37).cast("double"), (F.col("track") % 23).cast("double"), (50 + F.col("track") % 10).cast("double")]
    p = camera_point(*point, [F.col("r")[i] for i in range(9)], [F.col(f"c{i}") for i in range(3)])
    rows = rows.withColumns(dict(zip(("p0", "p1", "p2"), p, strict=True)))
    u = F.col("fx") * F.col("p0") / F.col("p2") + F.col("cx") + (F.floor("raw_u") % 7 - 3)
    v = F.col("fy") * F.col("p1") / F.col("p2") + F.col("cy") + (F.floor("raw_v") % 5 - 2)
    return rows.select("track", "frame", "fx", "fy", "cx", "cy", "c0", "c1", "c2", "r", "w", "h", u.alias("u"), v.alias("v"), F.col("p2").alias("d"))


def v_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"))
    return tracks.select("track", (F.col("track") % 37 + F.col("track") % 4 * F.lit(0.1)).alias("x"), (F.col("track") % 23).cast("double").alias("y"), (50 + F.col("track") % 10).cast("double").alias("z"))


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth pixels: one median depth and three channels per frame and raster cell."""
    rows = v_depth(spark, sf_dir).select("frame", (F.col("part") % 64).alias("x"), (F.floor(F.col("part") / 64) % 48).alias("y"), "raw")
    mean = F.avg("raw") / 50
    channels = [F.round(mean, 6).alias("red"), F.round(mean * 0.9, 6).alias("green"), F.round(1 - mean, 6).alias("blue")]
    return rows.groupBy("frame", "x", "y").agg((10 + F.percentile("raw", 0.5) / 25).alias("depth"), *channels)


def v_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cameras of the depth pixels: each with its own focals, centre and rotation. Every eleventh isn't anchored."""
    f = F.col("frame")
    frames = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).alias("frame")).distinct().where("frame % 11 <> 10")
    return frames.select(
        "frame",
        (60 + f % 3).cast("double").alias("fx"),
        (61 + f % 2).cast("double").alias("fy"),
        F.lit(32.0).alias("cx"),
        F.lit(24.0).alias("cy"),
        (f * F.lit(0.05)).alias("c0"),
        (f % 5 * F.lit(0.01)).alias("c1"),
        (f % 3 * F.lit(0.02)).alias("c2"),
        turned((f % 7 - 3) * F.lit(0.01), (f % 5 - 2) * F.lit(0.008)).alias("r"),
    )


def _turned(a: str, b: str) -> str:
    return f"[cos({a}), sin({a}) * sin({b}), sin({a}) * cos({b}), 0, cos({b}), -sin({b}), -sin({a}), cos({a}) * sin({b}), cos({a}) * cos({b})]"


def in_camera(x: str, y: str, z: str, camera: str = "") -> list[str]:
    """SQL of a world point in a camera's frame; ``camera`` is the alias that holds r, c0, c1 and c2."""
    return [f"({camera}r[{j}] * ({x} - {camera}c0) + {camera}r[{j + 3}] * ({y} - {camera}c1) + {camera}r[{j + 6}] * ({z} - {camera}c2))" for j in (1, 2, 3)]


def in_world(q0: str, q1: str, q2: str, camera: str = "") -> list[str]:
    """SQL of a point of a camera's frame in the world."""
    return [f"({camera}r[{3 * i + 1}] * ({q0}) + {camera}r[{3 * i + 2}] * ({q1}) + {camera}r[{3 * i + 3}] * ({q2}) + {camera}c{i})" for i in range(3)]


_POINT = in_camera("track % 37", "track % 23", "(50 + track % 10)", "c.")

#: The same views as DuckDB SQL.
VIEWS_SQL = {
    "v_frames": "SELECT event_id AS candidate, event_id AS source_frame, epoch_us(ts) AS ticks, epoch_us(ts) / 1e6::DOUBLE AS ts_s, CAST(json_extract(props, '$.k') AS INT) + 80 AS feature_count, value AS sharpness, event_type FROM events",
    "v_desc": "SELECT vec_id AS frame, CAST(vec_id AS DOUBLE) AS ts_s, embedding AS emb, label FROM embeddings",
    "v_obs": "SELECT l_partkey AS track, l_suppkey % 100 AS frame, MIN(l_extendedprice) AS u, MIN(l_quantity) AS v FROM lineitem GROUP BY ALL",
    "v_match": "SELECT a.frame AS source, b.frame AS target, a.track AS source_feature, b.track AS target_feature, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, abs(a.v - b.v) <= (7 * a.frame + 3 * b.frame) % 40 AS inlier, 1 / (1 + abs(a.v - b.v)) AS confidence FROM v_obs a JOIN v_obs b ON a.track = b.track AND b.frame > a.frame AND b.frame <= a.frame + 4",
    "v_points": "SELECT l_suppkey % 100 AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, CAST(l_linenumber * 30 AS INT) AS red, CAST(round_even(l_tax * 1000, 0) AS INT) AS green, CAST(round_even(l_quantity, 0) AS INT) AS blue FROM lineitem",
    "v_cam": f"SELECT s_suppkey AS frame, CAST(500 + s_nationkey AS DOUBLE) AS fx, CAST(500 + s_nationkey AS DOUBLE) AS fy, 320.0::DOUBLE AS cx, 240.0::DOUBLE AS cy, CAST(s_suppkey % 100 AS DOUBLE) AS c0, s_acctbal / 1000 AS c1, 0.0::DOUBLE AS c2, 640 AS w, 480 AS h, {_turned('(s_suppkey % 7 - 3) * 0.02::DOUBLE', '(s_suppkey % 5 - 2) * 0.03::DOUBLE')} AS r FROM supplier",
    "v_depth": "SELECT l_suppkey % 100 AS frame, l_partkey AS part, l_quantity AS raw, l_extendedprice / 1000 AS opt, 1 - l_tax AS conf FROM lineitem",
    "v_seen": "SELECT l_partkey AS track, l_suppkey AS frame, MIN(l_extendedprice) AS raw_u, MIN(l_quantity) AS raw_v FROM lineitem GROUP BY ALL",
    "v_pix": f"SELECT track, o.frame, fx, fy, cx, cy, c0, c1, c2, r, w, h, fx * {_POINT[0]} / {_POINT[2]} + cx + (floor(raw_u)::BIGINT % 7 - 3) AS u, fy * {_POINT[1]} / {_POINT[2]} + cy + (floor(raw_v)::BIGINT % 5 - 2) AS v, {_POINT[2]} AS d FROM v_seen o JOIN v_cam c ON o.frame = c.frame",
    "v_land": "SELECT p_partkey AS track, p_partkey % 37 + p_partkey % 4 * 0.1::DOUBLE AS x, CAST(p_partkey % 23 AS DOUBLE) AS y, CAST(50 + p_partkey % 10 AS DOUBLE) AS z FROM part",
    "v_grid": "SELECT frame, part % 64 AS x, part // 64 % 48 AS y, 10 + quantile_cont(raw, 0.5) / 25 AS depth, round(avg(raw) / 50, 6) AS red, round(avg(raw) / 50 * 0.9::DOUBLE, 6) AS green, round(1 - avg(raw) / 50, 6) AS blue FROM v_depth GROUP BY ALL",
    "v_view": f"SELECT frame, CAST(60 + frame % 3 AS DOUBLE) AS fx, CAST(61 + frame % 2 AS DOUBLE) AS fy, 32.0::DOUBLE AS cx, 24.0::DOUBLE AS cy, frame * 0.05::DOUBLE AS c0, frame % 5 * 0.01::DOUBLE AS c1, frame % 3 * 0.02::DOUBLE AS c2, {_turned('(frame % 7 - 3) * 0.01::DOUBLE', '(frame % 5 - 2) * 0.008::DOUBLE')} AS r FROM (SELECT DISTINCT s_suppkey % 100 AS frame FROM supplier) WHERE frame % 11 <> 10",
}
