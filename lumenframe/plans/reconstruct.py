"""A whole run: tracks from matches, windows assembled into one map, results published, and a status that a rerun resumes from."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hooks import StageTimes
from ..operators import graph, mapping
from ..operators.map_builder import MapBuilder, assemble
from ..options import require
from ..sinks import writers
from ..sources.cache import fingerprint
from ..sources.readers import read_windows
from .repair import tracks_of
from .scratch import saved

#: Raised whenever results of equal input may differ from earlier ones.
REVISION = 2
INPUTS = ("frames", "matches", "cameras", "depths")


def identity(spark: SparkSession, source: str, settings: dict) -> dict:
    """What decides a run's results: sizes and times of its input files, its settings, and the implementation's revision."""
    jvm, files = spark._jvm, {}
    for name in INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{source.rstrip('/')}/{name}.parquet")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                files[f"{name}/{f.getPath().getName()}"] = [f.getLen(), f.getModificationTime()]
    return {"files": files, "settings": settings, "revision": REVISION}


def observed(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """Observations (track, frame, kp, u, v) of tracks; a keypoint's pixel is that of its matches."""
    ends = [matches.select(F.col(f).alias("frame"), F.col(k).alias("kp"), F.col(u).alias("u"), F.col(v).alias("v")) for f, k, u, v in (("source", "source_feature", "au", "av"), ("target", "target_feature", "bu", "bv"))]
    pixels = ends[0].unionByName(ends[1]).groupBy("frame", "kp").agg(F.min("u").alias("u"), F.min("v").alias("v"))
    number = (F.shiftleft(F.col("head_frame").cast("long"), 32) + F.col("head_kp")).alias("track")
    return tracks.select(number, "frame", "kp").join(pixels, ["frame", "kp"])


def reconstruct(
    spark: SparkSession, source: str, target: str, *, resume: bool = True, joint_iterations: int = 1000, size: tuple[float, float] | None = None, predict: Callable | None = None
) -> dict:
    """Run over ``source`` and publish into the local folder ``target``; returns the status document.

    ``source`` holds frames(frame, ts_s, w, h), matches as of ``repair.tracks_of``, and each window's predicted
    cameras(window, frame, fx, fy, cx, cy, r, c) and depths(window, frame, kp, depth). Loop matches take part if ``size``,
    the images' width and height, is given and they prove themselves. A finished run of equal identity is not
    repeated unless ``resume`` is false. One map's cameras and tracks are held on the driver, as the map is.
    """
    times, status_path = StageTimes(), os.path.join(target, "status.json")
    name = fingerprint(identity(spark, source, {"joint_iterations": joint_iterations, "size": size}))
    if resume and os.path.exists(status_path):
        with open(status_path, encoding="utf-8") as f:
            known = json.load(f)
        if known["identity"] == name and known["complete"]:
            return known
    os.makedirs(target, exist_ok=True)
    writers.document(status_path, {"identity": name, "complete": False})
    frames, matches = (spark.read.parquet(f"{source.rstrip('/')}/{n}.parquet") for n in INPUTS[:2])
    cameras, depths = read_windows(spark, source)
    with times.stage("tracks"):
        loops = None
        if size is not None and "pair_kind" in matches.columns:
            from .repair import verified_loops

            loops = verified_loops(matches, size)[1]
        elif "pair_kind" in matches.columns:
            matches = matches.where("pair_kind <> 'loop'")
        tracks = saved(tracks_of(matches, loops)[0], "run-tracks")
        seen = saved(observed(matches, tracks), "run-observations")
        writers.write_tracks(seen.select("track", "frame", "u", "v"), f"{target}/tracks")
    with times.stage("windows"):
        obs = seen.select("track", "frame", "u", "v").toPandas()
        predicted = cameras.toPandas()
        placed = depths.join(seen.select("track", "frame", "kp"), ["frame", "kp"]).select("window", "track", "frame", "depth").toPandas()
        given = {int(w): (c.drop(columns="window").reset_index(drop=True), placed.loc[placed["window"] == w, ["track", "frame", "depth"]].reset_index(drop=True)) for w, c in predicted.groupby("window")}
        warnings: list[str] = []
        builder = MapBuilder(obs, joint_iterations, warnings.append)
        attempts = assemble(builder, given, predict=predict)
        require(len(builder.map.cameras) > 0, "no window could start a map")
    with times.stage("adjustment"):
        builder.finalize()
    with times.stage("publication"):
        model = builder.map
        cams = spark.createDataFrame(pd.DataFrame({c: [x.tolist() if hasattr(x, "tolist") else x for x in model.cameras[c]] for c in ("frame", "fx", "fy", "cx", "cy", "r", "c")}))
        writers.trajectory(cams.join(frames.select("frame", "ts_s", "w", "h"), "frame").orderBy("frame").coalesce(1), f"{target}/trajectory")
        grey = [F.lit(200).alias(c) for c in ("red", "green", "blue")]
        cloud = writers.publish_cloud(spark.createDataFrame(model.points[["track", "x", "y", "z"]]).select("track", "x", "y", "z", *grey), f"{target}/cloud.ply", order=["track"])
        kept = spark.createDataFrame(model.observations[["track", "frame"]])
        if loops is not None:
            edges = matches.where("inlier AND pair_kind = 'loop'").join(loops, ["source", "target"], "left_semi")
            edges = edges.select(F.col("source").alias("fa"), F.col("source_feature").alias("ka"), F.col("target").alias("fb"), F.col("target_feature").alias("kb"), F.lit(True).alias("is_loop"))
            links = graph.loop_links(edges, tracks).select((F.shiftleft(F.col("head_frame").cast("long"), 32) + F.col("head_kp")).alias("track"), "source", "target")
            writers.write_loop_links(mapping.retained_loops(links, kept), f"{target}/loops")
    missing = sorted(set(predicted["frame"]) - set(model.cameras["frame"]))
    status = {
        "identity": name, "complete": True, "cameras": len(model.cameras), "points": len(model.points), "observations": len(model.observations), "missing_frames": [int(f) for f in missing],
        "attempts": [{k: None if pd.isna(v) else v for k, v in row.items()} for row in attempts.astype(object).to_dict("records")], "warnings": warnings, **cloud, **times.document(),
    }
    writers.document(status_path, status)
    return status
