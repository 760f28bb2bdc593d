"""Dense depth: gates, calibration, multi-view agreement, consensus, voxel fusion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import require
from ..plans.ordered import bare, ordered, ranked
from .mapping import with_error

OFFSETS = (-4, -2, -1, 1, 2, 4)
CHANNELS = ("red", "green", "blue")


def confidence_filter(pixels: DataFrame, quantile: float = 0.3) -> DataFrame:
    """Valid depths at or above their frame's confidence quantile; the threshold rides along."""
    ok = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.col("depth") > 0) & (F.col("depth") < float("inf")) & F.col("conf").isNotNull() & ~F.isnan("conf") & (F.abs("conf") < float("inf"))
    valid = pixels.where(ok)
    return valid.join(valid.groupBy("frame").agg(F.percentile("conf", quantile).alias("threshold")), "frame").where(F.round("conf", 9) >= F.round("threshold", 9))


def calibrate(anchors: DataFrame, minimum: int = 6, most_spread: float = 0.35) -> DataFrame:
    """Per frame of (log_ratio): its median, the median deviation, and the reason of a rejection (null if accepted)."""
    middle = anchors.groupBy("frame").agg(F.percentile("log_ratio", 0.5).alias("log_scale"), F.count(F.lit(1)).alias("anchors"))
    spread = anchors.join(middle, "frame").groupBy("frame").agg(F.percentile(F.abs(F.col("log_ratio") - F.col("log_scale")), 0.5).alias("mad"))
    out = middle.join(spread, "frame")
    reason = F.when(F.col("anchors") < minimum, "too few anchors").when(F.round("mad", 9) > most_spread, "inconsistent scale").when(~(F.abs("log_scale") < 700), "nonfinite depth")
    return out.withColumn("reason", reason)


def depth_gauge(anchors: DataFrame, minimum: int = 3) -> DataFrame:
    """Per frame of (raw, opt): the depth factor and the median scene depth, from at least three samples."""
    ok = anchors.where((F.col("raw") > 0) & (F.col("opt") > 0) & (F.col("raw") < float("inf")) & (F.col("opt") < float("inf")))
    out = ok.groupBy("frame").agg(F.count(F.lit(1)).alias("samples"), F.exp(F.percentile(F.ln(F.col("opt") / F.col("raw")), 0.5)).alias("factor"), F.percentile("opt", 0.5).alias("scene_depth"))
    return out.where(F.col("samples") >= minimum)


def dense_scale(pixels: DataFrame, stride: int) -> DataFrame:
    """One scale between two depth maps of shared frames: the median over frames of each frame's median log ratio on strided pixels."""
    sampled = pixels.where((F.pmod(F.col("pixel"), F.lit(stride)) == 0) & (F.col("da") > 0) & (F.col("db") > 0))
    per_frame = sampled.groupBy("frame").agg(F.percentile(F.ln(F.col("da") / F.col("db")), 0.5).alias("log_ratio"))
    return per_frame.agg(F.exp(F.percentile("log_ratio", 0.5)).alias("scale"), F.count(F.lit(1)).alias("frames"))


def sparse_anchors(observations: DataFrame, landmarks: DataFrame, pixels: DataFrame, most: float = 3.0) -> DataFrame:
    """(frame, track, raw, opt, log_ratio): depths at sparse observations, from the prediction and from the map.

    ``observations(track, frame, u, v)`` carry their camera as for ``mapping.with_error``. One counts if its rounded pixel
    has a valid depth in ``pixels(frame, x, y, depth)``, its landmark lies before the camera, and it is
    reprojected within ``most`` pixels.
    """
    rows = with_error(observations, landmarks).where((F.col("pz") > 0) & (F.round("error", 9) <= most))
    rows = rows.select("track", "frame", F.col("pz").alias("opt"), F.rint("u").cast("bigint").alias("x"), F.rint("v").cast("bigint").alias("y"))
    ok = pixels.where((F.col("depth") > 0) & (F.col("depth") < float("inf"))).select("frame", "x", "y", F.col("depth").alias("raw"))
    return rows.join(ok, ["frame", "x", "y"]).select("frame", "track", "raw", "opt", F.ln(F.col("opt") / F.col("raw")).alias("log_ratio"))


def voxel_width(scene_depths: DataFrame, fraction: float = 0.01) -> float:
    """Width of a fusion cell: a part of the median over frames of ``scene_depth``."""
    require(0 < fraction <= 1, "the fraction must lie in (0, 1]")
    middle = scene_depths.agg(F.percentile("scene_depth", 0.5)).first()[0]
    require(middle is not None and 0 < middle < float("inf"), "no frame has a scene depth")
    return fraction * middle


CALIBRATION = ("fx", "fy", "cx", "cy")


def camera_pairs(cameras: DataFrame) -> DataFrame:
    """Each camera with its neighbours at OFFSETS: what takes a point of its frame into the neighbour's, six short rows a camera.

    k = m q + t takes camera coordinates to the neighbour's, q = m' k + o back; ``n_`` marks the neighbour's calibration.
    """
    a = cameras.select("frame", F.col("r").alias("ra"), *[F.col(f"c{i}").alias(f"a{i}") for i in range(3)])
    a = a.withColumn("neighbor", F.explode(F.array(*[F.col("frame") + o for o in OFFSETS])))
    n = cameras.select(F.col("frame").alias("neighbor"), F.col("r").alias("rn"), *[F.col(f"c{i}").alias(f"n{i}") for i in range(3)], *[F.col(c).alias(f"n_{c}") for c in CALIBRATION])
    ra, rn = ([F.get(r, F.lit(i)) for i in range(9)] for r in ("ra", "rn"))
    total = lambda terms: sum(terms[1:], terms[0])
    m = [total([rn[3 * k + i] * ra[3 * k + j] for k in range(3)]).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    apart = [F.col(f"a{k}") - F.col(f"n{k}") for k in range(3)]
    t = [total([rn[3 * k + i] * apart[k] for k in range(3)]).alias(f"t{i}") for i in range(3)]
    o = [(-total([ra[3 * k + i] * apart[k] for k in range(3)])).alias(f"o{i}") for i in range(3)]
    return a.join(n, "neighbor").select("frame", "neighbor", *m, *t, *o, *[f"n_{c}" for c in CALIBRATION])


def measure(
    points: DataFrame, pixels: DataFrame, cameras: DataFrame, w: int, h: int, *, depth: float = 0.05, cycle: float = 2.0, colour: float = 0.15, parallax: float = 0.5
) -> DataFrame:
    """Agreement of ``points(frame, x, y, red, green, blue, z)`` with the depth samples of neighbouring frames.

    ``cameras(frame, fx, fy, cx, cy, c0, c1, c2, r)`` are the anchored frames with centre and camera-to-world rotation;
    a point or a neighbour in any other frame has no rows. Each point is projected into each neighbour, the nearest
    of ``pixels(frame, x, y, depth, red, green, blue)`` is found by an equi-join on frame and integer pixel, and it
    must agree in depth (relative), cycle (pixels), mean difference of the channels, and parallax (degrees). ``back``
    is the sample's depth in the point's own camera.
    """
    # Whatever depends on cameras alone lies below a join, so it is worked out once for each pair and not for each pixel.
    rows = points.join(cameras.select("frame", *[F.col(c).alias(f"a_{c}") for c in CALIBRATION]), "frame")
    rows = rows.withColumn("q0", (F.col("x") - F.col("a_cx")) / F.col("a_fx") * F.col("z")).withColumn("q1", (F.col("y") - F.col("a_cy")) / F.col("a_fy") * F.col("z"))
    rows = rows.join(camera_pairs(cameras), "frame")
    c = F.col
    k = [c(f"m{i}0") * c("q0") + c(f"m{i}1") * c("q1") + c(f"m{i}2") * c("z") + c(f"t{i}") for i in range(3)]
    rows = rows.withColumns({f"k{i}": v for i, v in enumerate(k)}).where("k2 > 0")
    rows = rows.withColumn("pu", c("n_fx") * c("k0") / c("k2") + c("n_cx")).withColumn("pv", c("n_fy") * c("k1") / c("k2") + c("n_cy"))
    rows = rows.where(c("pu").between(0, w - 1) & c("pv").between(0, h - 1))
    # The sample lies at its depth along a ray of the neighbour; the ray and the neighbour's centre, both in the point's camera, go along.
    u, v = (c("pu") - c("n_cx")) / c("n_fx"), (c("pv") - c("n_cy")) / c("n_fy")
    ray = [(c(f"m0{i}") * u + c(f"m1{i}") * v + c(f"m2{i}")).alias(f"ray{i}") for i in range(3)]
    length = lambda x, y, z: F.sqrt(c(x) * c(x) + c(y) * c(y) + c(z) * c(z))
    along = sum(((c(f"k{i}") - c(f"t{i}")) * c(f"k{i}") for i in (1, 2)), (c("k0") - c("t0")) * c("k0"))
    cosine = (along / (length("q0", "q1", "z") * length("k0", "k1", "k2"))).alias("cosine")
    nearest = [F.rint("pu").cast("bigint").alias("sx"), F.rint("pv").cast("bigint").alias("sy")]
    rows = rows.select(*points.columns, "neighbor", *nearest, "k2", cosine, *ray, "o0", "o1", "o2", *[f"a_{n}" for n in CALIBRATION])
    samples = pixels.where("depth > 0").select(c("frame").alias("neighbor"), c("x").alias("sx"), c("y").alias("sy"), c("depth").alias("zn"), *[c(n).alias(f"{n}_n") for n in CHANNELS])
    rows = rows.join(samples, ["neighbor", "sx", "sy"])
    rows = rows.withColumns({n: c(f"ray{i}") * c("zn") + c(f"o{i}") for i, n in enumerate(("b0", "b1", "back"))})
    off = F.hypot(F.col("a_fx") * F.col("b0") / F.col("back") + F.col("a_cx") - F.col("x"), F.col("a_fy") * F.col("b1") / F.col("back") + F.col("a_cy") - F.col("y"))
    rows = rows.withColumn("relative", F.abs(F.col("k2") - F.col("zn")) / F.col("zn")).withColumn("cycle", F.when(F.col("back") > 0, off))
    apart = sum((F.abs(F.col(c) - F.col(f"{c}_n")) for c in CHANNELS[1:]), F.abs(F.col(CHANNELS[0]) - F.col(f"{CHANNELS[0]}_n"))) / 3
    agree = (F.col("back") > 0) & (F.round("relative", 9) <= depth) & (F.round("cycle", 9) <= cycle) & (F.round(apart, 9) <= colour)
    agree = agree & (F.round("cosine", 12) < round(math.cos(math.radians(parallax)), 12))
    rows = rows.withColumn("agree", F.coalesce(agree, F.lit(False)))
    return rows.withColumn("weight", F.when(F.col("agree"), 1 / (1 + F.pow(F.col("relative") / 0.02, 2))).otherwise(0.0))


def consensus(pixels: DataFrame, cameras: DataFrame, w: int, h: int, *, minimum_support: int = 2, **gates: float) -> DataFrame:
    """Inverse-depth weighted mean with the neighbours' samples, seen from the pixel's camera; support is counted anew at the updated depth.

    ``gates`` are those of :func:`measure`. Pixels of frames without an anchored camera keep their depth.
    """
    require(minimum_support >= 1, "the support must be positive")
    key = ["frame", "x", "y"]
    sums = measure(pixels.withColumn("z", F.col("depth")), pixels, cameras, w, h, **gates).where("agree").groupBy(*key).agg(F.sum("weight").alias("ws"), F.sum(F.col("weight") / F.col("back")).alias("wz"))
    candidate = (1 + F.coalesce("ws", F.lit(0.0))) / (1 / F.col("depth") + F.coalesce("wz", F.lit(0.0)))
    updated = pixels.join(sums, key, "left").withColumn("z", F.round(candidate, 9)).drop("ws", "wz")
    support = measure(updated, pixels, cameras, w, h, **gates).groupBy(*key).agg(F.count_if("agree").alias("support"))
    out = updated.join(support, key, "left").withColumn("support", F.coalesce("support", F.lit(0)))
    accepted = (F.col("support") >= minimum_support) & (F.col("z") > 0) & (F.col("z") < float("inf"))
    return out.withColumn("accepted", accepted).withColumn("refined", F.when(F.col("accepted"), F.col("z")).otherwise(F.col("depth"))).select(*key, "depth", "refined", "support", "accepted")


def coverage(refined: DataFrame) -> DataFrame:
    return refined.groupBy("frame").agg(F.count_if("accepted").alias("supported"), F.count(F.lit(1)).alias("total"), F.percentile("refined", 0.5).alias("median_depth"))


def voxel_fusion(points: DataFrame, voxel: float, most_cells: int | None = None) -> DataFrame:
    """Cells of a grid: mean position, rounded mean colour, count and first frame. Sums are merged before the shuffle.

    With ``most_cells`` the number of cells is checked, as the memory limit of a single machine was.
    """
    if not voxel > 0:
        raise ValueError("voxel width must be positive")
    at = {c: F.floor(F.col(c) / voxel) for c in "xyz"}
    sane = F.lit(True)
    for c in "xyz":
        sane = sane & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c) / voxel) < 9e18)
    rows = points.where(sane).select("*", *[v.cast("bigint").alias(f"v{c}") for c, v in at.items()])
    cells = rows.groupBy("vx", "vy", "vz").agg(
        *[F.avg(c).alias(c) for c in "xyz"], *[F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.avg(c), 0))).cast("int").alias(c) for c in ("red", "green", "blue")], F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame")
    )
    if most_cells is not None and cells.limit(most_cells + 1).count() > most_cells:
        raise ValueError(f"more than {most_cells} cells")
    return cells


def preview(cells: DataFrame, most: int = 240_000) -> DataFrame:
    """A strided sample of cells in grid order, at most ``most``."""
    n = cells.count()
    stride = max(1, -(-n // most))
    return bare(ranked(ordered(cells, "vx", "vy", "vz"), "at").where(F.col("at") % stride == 0).drop("at"))
