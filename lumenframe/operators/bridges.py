"""Bridging separate parts of a local map: pose targets from stable landmarks, scale fit, restored tracks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .alignment import pose_from_points
from .holdouts import held_out, is_held_out

#: Hold-out and acceptance counts of a bridge, and the bounds on attempts.
TRAIN, HELD, RESTORED, SOLVES, BRIDGES, TARGETS = 30, 10, 30, 16, 4, 4
MOST_LOG_SCALE = float(np.log(1.25))


def stable_landmarks(errors: DataFrame, pixels: float = 3.0, views: int = 3) -> DataFrame:
    """Tracks with at least three observations within three pixels."""
    return errors.where(F.col("error") <= pixels).groupBy("track").agg(F.count(F.lit(1)).alias("views")).where(F.col("views") >= views).select("track")


def pose_targets(anchor_landmarks: DataFrame, tracks: DataFrame, group_cameras: DataFrame, most: int = TARGETS) -> DataFrame:
    """(frame, track, x, y, z, u, v, held): observations of anchor landmarks in a group's cameras, inside the image.

    Only frames with enough training and held-out observations count; the ``most`` richest stay, earlier ones first.
    """
    rows = tracks.join(anchor_landmarks, "track").join(group_cameras.select("frame", "w", "h"), "frame")
    rows = rows.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < F.col("w")) & (F.col("v") < F.col("h"))).withColumn("held", is_held_out(F.col("track")))
    counts = rows.groupBy("frame").agg(F.count_if(~F.col("held")).alias("train"), F.count_if("held").alias("test"), F.count(F.lit(1)).alias("n"))
    best = counts.where((F.col("train") >= TRAIN) & (F.col("test") >= HELD)).orderBy(F.desc("n"), "frame").limit(most)
    return rows.join(best.select("frame"), "frame", "left_semi")


def anchor_component(components: DataFrame, observations: DataFrame, shared: DataFrame) -> DataFrame:
    """The component with most cameras shared with the map, then most landmarks, then the least root."""
    cams = components.join(shared.select(F.col("frame").alias("node"), F.lit(1).alias("s")), "node", "left").groupBy("root").agg(F.count("s").alias("shared"))
    land = observations.join(components.withColumnRenamed("node", "frame"), "frame").groupBy("root").agg(F.count_distinct("track").alias("landmarks"))
    return cams.join(land, "root", "left").orderBy(F.desc("shared"), F.desc(F.coalesce("landmarks", F.lit(0))), "root").limit(1)


def fit_scale(poses: dict[int, tuple[np.ndarray, np.ndarray]], target: int, anchor: pd.DataFrame, group_depths: np.ndarray) -> float | None:
    """Scale of a group in the anchor's frame from depths of shared points in one camera; 70 % must agree within a quarter."""
    r, t = poses[target]
    depth = (anchor[["x", "y", "z"]].to_numpy(float) @ r.T + t)[:, 2]
    ok = (depth > 0) & np.isfinite(group_depths) & (group_depths > 0)
    if ok.sum() < 3:
        return None
    logs = np.log(depth[ok] / group_depths[ok])
    middle = float(np.median(logs))
    return float(np.exp(middle)) if (np.abs(logs - middle) <= MOST_LOG_SCALE).mean() >= 0.7 else None


def _off(target: pd.DataFrame, k: np.ndarray, pose: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pixel errors of a target's points in a world-to-camera pose; infinite behind it."""
    c = target[["x", "y", "z"]].to_numpy(float) @ pose[0].T + pose[1]
    with np.errstate(all="ignore"):
        off = np.linalg.norm((c @ k.T)[:, :2] / c[:, 2:] - target[["u", "v"]].to_numpy(float), axis=1)
    return np.where((c[:, 2] > 0) & np.isfinite(off), off, np.inf)


def _held(target: pd.DataFrame) -> np.ndarray:
    return target["held"].to_numpy(bool) if "held" in target else held_out(target["track"]).to_numpy()


def supported(target: pd.DataFrame, k: np.ndarray, pose: tuple[np.ndarray, np.ndarray], pixels: float = 3.0) -> bool:
    """Enough training points within ``pixels``, and 80 % of enough held-out points within five."""
    held, off = _held(target), _off(target, k, pose)
    return (off[~held] <= pixels).sum() >= TRAIN and held.sum() >= HELD and (off[held] <= 5).sum() >= 0.8 * held.sum()


def solve_pose(target: pd.DataFrame, k: np.ndarray, pixels: float = 3.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Camera pose from a target's training points, if its held-out points agree too."""
    held = _held(target)
    pose = pose_from_points(target[["x", "y", "z"]].to_numpy(float)[~held], target[["u", "v"]].to_numpy(float)[~held], k, pixels)
    if pose is None or pose[2].sum() < TRAIN:
        return None
    return (pose[0], pose[1]) if supported(target, k, (pose[0], pose[1]), pixels) else None


def recover_bridges(targets: dict[int, pd.DataFrame], k: np.ndarray | dict[int, np.ndarray], accept: Callable[[int, tuple], int], solves: int = SOLVES, bridges: int = BRIDGES) -> list[tuple[int, int]]:
    """Try targets in order: solve a pose, let ``accept(frame, pose)`` join the groups and count restored tracks.

    At most ``solves`` solves and ``bridges`` bridges; a bridge needs RESTORED restored tracks. ``k`` is one camera
    matrix, or one for each frame. Returns (frame, restored).
    """
    made: list[tuple[int, int]] = []
    for frame, target in list(targets.items())[:solves]:
        if len(made) == bridges:
            break
        pose = solve_pose(target, k[frame] if isinstance(k, dict) else k)
        if pose is not None and (n := accept(frame, pose)) >= RESTORED:
            made.append((frame, n))
    return made


def restored_tracks(landmarks: DataFrame, tracks: DataFrame, cameras: DataFrame, side: DataFrame, pixels: float = 3.0) -> DataFrame:
    """Track observations that fit their landmark in merged cameras; ``bridges`` marks tracks seen from both sides.

    ``side(frame, anchor)`` says which part a camera came from. Errors are compared to the billionth of a pixel, so an
    error of just ``pixels`` is kept however its last digits fall.
    """
    rows = tracks.join(landmarks, "track").join(cameras, "frame").join(side, "frame")
    p = G.camera_point(F.col("x"), F.col("y"), F.col("z"), [F.get("r", F.lit(i)) for i in range(9)], [F.get("c", F.lit(i)) for i in range(3)])
    error = G.reprojection_error(p, *[F.col(c) for c in ("fx", "fy", "cx", "cy", "u", "v")])
    kept = rows.withColumn("error", error).where(F.round("error", 9) <= pixels)
    both = kept.groupBy("track").agg((F.bool_or("anchor") & F.bool_or(~F.col("anchor"))).alias("bridges"))
    return kept.join(both, "track").select("track", "frame", "u", "v", "error", "bridges")
