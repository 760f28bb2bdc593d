"""Overlapping count windows of frames, their ranking, ownership and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import require


def overlapping_windows(spark: SparkSession, count: int, size: int = 64, overlap: int = 32) -> DataFrame:
    """(window, frame): windows of ``size`` frames, each ``size - overlap`` further; the last ends with the frames."""
    require(count >= 6, "at least six frames are required")
    require(size >= 8 and 6 <= overlap < size, "a window has at least 8 frames, an overlap at least 6 and fewer than a window")
    step = size - overlap
    last = max(0, -(-(count - size) // step))
    windows = spark.range(last + 1).withColumnRenamed("id", "window")
    return windows.withColumn("frame", F.explode(F.sequence(F.col("window") * step, F.least(F.lit(count), F.col("window") * step + size) - 1)))


def subwindows(windows: DataFrame) -> DataFrame:
    """Halves of windows of more than eight frames: (window, part, frame), the last part at the end."""
    held = windows.groupBy("window").agg(F.sort_array(F.collect_list("frame")).alias("frames")).where(F.size("frames") > 8)
    n = F.size("frames")
    size = F.greatest(F.lit(8), F.floor((n + 1) / 2).cast("int"))
    stride = size - F.greatest(F.lit(6), F.floor(size / 2).cast("int"))
    starts = F.sequence(F.lit(0), n - size, stride)
    starts = F.when(F.element_at(starts, -1) == n - size, starts).otherwise(F.concat(starts, F.array(n - size)))
    parts = held.select("window", "frames", size.alias("size"), F.posexplode(starts).alias("part", "start"))
    return parts.select("window", F.col("part").cast("long").alias("part"), F.explode(F.slice("frames", F.col("start") + 1, F.col("size"))).alias("frame"))


def parts(frames: list[int]) -> list[list[int]]:
    """The same halves as :func:`subwindows`, of one window's sorted frames on the driver."""
    if len(frames) <= 8:
        return []
    size = max(8, (len(frames) + 1) // 2)
    last = len(frames) - size
    starts = list(range(0, last + 1, size - max(6, size // 2)))
    return [frames[s : s + size] for s in (starts if starts[-1] == last else [*starts, last])]


def rank_windows(windows: DataFrame, observations: DataFrame, cameras: DataFrame, landmarks: DataFrame, first: bool = False) -> DataFrame:
    """(window, shared, tracks, rank): most shared cameras first, then most tracks, then index.

    A track counts with three views in the window, and, unless ``first``, only if it is a landmark; a window
    without a shared camera is left out unless ``first``.
    """
    shared = windows.join(cameras.select("frame").distinct().withColumn("has", F.lit(1)), "frame", "left")
    shared = shared.groupBy("window").agg(F.count("has").alias("shared"))
    views = windows.join(observations, "frame").groupBy("window", "track").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    if not first:
        views = views.join(landmarks.select("track").distinct(), "track", "left_semi")
        shared = shared.where("shared > 0")
    ranked = shared.join(views.groupBy("window").agg(F.count(F.lit(1)).alias("tracks")), "window", "left").withColumn("tracks", F.coalesce("tracks", F.lit(0)))
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("shared"), F.desc("tracks"), "window")))


def frontier(windows: DataFrame, owned: DataFrame) -> DataFrame:
    """Windows at the edge of the map, most owned frames first: some owned (if any is), not all, over eight frames."""
    flagged = windows.join(owned.select("frame").distinct().withColumn("has", F.lit(1)), "frame", "left")
    any_owned = owned.select((F.count(F.lit(1)) > 0).alias("any"))
    sized = flagged.groupBy("window").agg(F.count("has").alias("owned"), F.count(F.lit(1)).alias("frames")).crossJoin(any_owned)  # one row
    keep = (F.col("owned") < F.col("frames")) & ((F.col("owned") > 0) | ~F.col("any")) & (F.col("frames") > 8)
    return sized.where(keep).select("window", "owned", "frames", F.row_number().over(W.orderBy(F.desc("owned"), "window")).alias("place"))


def eligible(candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """Candidates to try now, from (candidate, frames, accepted, blocked, waiting_for, attempted array of arrays)."""
    all_owned = owned.select(F.sort_array(F.collect_set("frame")).alias("owned"))
    support = F.array_sort(F.array_intersect("frames", "owned"))
    waiting = F.coalesce(F.size("waiting_for"), F.lit(0)) > 0
    return candidates.crossJoin(all_owned).where(
        ~F.col("accepted")
        & ~F.col("blocked")
        & (F.size(F.array_except("frames", "owned")) > 0)
        & (~waiting | F.arrays_overlap("waiting_for", "owned"))
        & ~F.coalesce(F.exists("attempted", lambda a: F.array_sort(a) == support), F.lit(False))
    ).drop("owned")


def ownership(windows: DataFrame, accepted: DataFrame) -> DataFrame:
    """(frame, owner): the window that was accepted first among those that hold the frame."""
    return windows.join(accepted, "window").groupBy("frame").agg(F.min_by("window", "accept_seq").alias("owner"))


def missing_frames(spark: SparkSession, count: int, owned: DataFrame) -> DataFrame:
    return spark.range(count).withColumnRenamed("id", "frame").join(owned.select("frame"), "frame", "left_anti")
