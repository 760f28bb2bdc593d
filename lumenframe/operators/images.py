"""Per-image measures and previews: sharpness, depth stretch, depth lookup, strided points, display fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import percentiles
from ..plans.scratch import saved

#: Luma weights (fixed values).
LUMA = np.array([0.299, 0.587, 0.114])


def laplacian_variance(rgb: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of luma, borders mirrored without repeating the edge; at least 0."""
    y = rgb.astype(np.float64) @ LUMA if rgb.ndim == 3 else rgb.astype(np.float64)
    p = np.pad(y, 1, mode="reflect") if min(y.shape) > 1 else np.pad(y, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * y
    return float(max(0.0, (lap**2).mean() - lap.mean() ** 2))


def sharpness_of_pixels(pixels: DataFrame) -> DataFrame:
    """(frame, sharpness) of ``pixels(frame, x, y, luma)``, whole rasters: the same measure as columns.

    A pixel's four neighbours come by shifted keys; beyond the border lies the mirror image, the edge not repeated.
    """
    ends = pixels.groupBy("frame").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    rows = pixels.join(ends, "frame")
    mirrored = lambda at, last: F.when(last == 0, 0).when(at < 0, -at).when(at > last, 2 * last - at).otherwise(at)
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    asked = rows.withColumn("side", F.explode(sides))
    asked = asked.select("frame", "x", "y", "luma", mirrored(F.col("x") + F.col("side.dx"), F.col("right")).alias("nx"), mirrored(F.col("y") + F.col("side.dy"), F.col("bottom")).alias("ny"))
    near = pixels.select("frame", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("luma").alias("beside"))
    laplacian = asked.join(near, ["frame", "nx", "ny"]).groupBy("frame", "x", "y").agg((F.sum("beside") - 4 * F.first("luma")).alias("l"))
    return laplacian.groupBy("frame").agg(F.greatest(F.lit(0.0), F.avg(F.col("l") * F.col("l")) - F.avg("l") * F.avg("l")).alias("sharpness"))


def sharpness(images: DataFrame) -> DataFrame:
    """(frame, sharpness) of ``images(frame, h, w, rgb)``, rgb as bytes row by row; images are measured one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [laplacian_variance(np.frombuffer(b, np.uint8).reshape(int(h), int(w), 3)) for h, w, b in batch[["h", "w", "rgb"]].itertuples(index=False)]
            yield pd.DataFrame({"frame": batch["frame"], "sharpness": values})

    return images.select("frame", "h", "w", "rgb").mapInPandas(run, "frame long, sharpness double")


def depth_preview(depths: DataFrame) -> DataFrame:
    """Depth pixels as 8-bit grey, each frame stretched between its 2 % and 98 % quantiles; invalid depths are 0."""
    valid = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.col("depth") > 0) & (F.col("depth") < float("inf"))
    ends = depths.where(valid).groupBy("frame").agg(F.percentile("depth", [0.02, 0.98]).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    level = (F.col("depth") - low) / F.greatest(high - low, F.lit(1e-12))
    grey = F.when(valid, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)) * 255)).otherwise(0)
    return depths.join(ends, "frame", "left").withColumn("grey", grey.cast("int")).drop("q")


def pixel_lookup(observations: DataFrame, depth_frames: DataFrame) -> DataFrame:
    """Observations with the depth of their nearest pixel: halves to even, clamped to the raster.

    ``depth_frames(frame, h, w, depth)`` keeps a frame's depths in one array, so nothing is exploded: one equi-join
    and one element access.
    """
    rows = observations.join(depth_frames.select("frame", "h", "w", F.col("depth").alias("grid")), "frame")
    x = F.greatest(F.lit(0), F.least(F.col("w") - 1, F.rint("u").cast("int")))
    y = F.greatest(F.lit(0), F.least(F.col("h") - 1, F.rint("v").cast("int")))
    return rows.withColumn("d", F.get("grid", y * F.col("w") + x)).drop("grid", "h", "w")


def strided_points(depth_frames: DataFrame, most: int = 2000) -> DataFrame:
    """At most ``most`` evenly strided pixels of each frame as (frame, x, y, depth), for previews."""
    n = F.size("depth")
    stride = F.greatest(F.lit(1), F.ceil(n / most).cast("int"))
    at = F.explode(F.sequence(F.lit(0), n - 1, stride))
    rows = depth_frames.where(n > 0).select("frame", "w", "depth", at.alias("i"))
    picked = rows.select("frame", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).alias("y"), F.get("depth", F.col("i")).alias("depth"))
    return picked.where((F.col("depth") > 0) & ~F.isnan("depth"))


def display_fit(points: DataFrame) -> DataFrame:
    """One row: the median centre of points and the radius that holds 95 % of them; none of no points."""
    centre = saved(percentiles(points, {f"m{c}": F.col(c) for c in "xyz"}, 0.5), "centre")
    away = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0)))
    radius = percentiles(points.crossJoin(F.broadcast(centre)), {"radius": away}, 0.95)  # one row
    return points.limit(1).select().crossJoin(centre).crossJoin(radius)  # one row each
