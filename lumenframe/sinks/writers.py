"""Writers: staged publication, pair and track records, point clouds, trajectories."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.images import depth_preview

PLY_FIELDS = ("x", "y", "z", "red", "green", "blue")


def publish(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write under a temporary name and rename: a reader sees all of a table or none of it."""
    spark = df.sparkSession
    jvm = spark._jvm
    at = lambda suffix: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + suffix)
    mine = uuid.uuid4().hex  # two writers don't share a staging name
    to, staging, old = at(""), at(f".staging-{mine}"), at(f".old-{mine}")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    writer = df.write.format(kind)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).save(staging.toString())
        # The old table steps aside and returns if the new one can't take its place.
        aside = fs.exists(to) and fs.rename(to, old)
        if not fs.rename(staging, to):
            if aside:
                fs.rename(old, to)
            raise OSError(f"could not publish {path}")
        fs.delete(old, True)
    finally:
        fs.delete(staging, True)


def document(path: str, content: dict) -> None:
    """A JSON document on the driver's disk, NaN refused, replaced in one step."""
    staging = f"{path}.staging"
    with open(staging, "w", encoding="utf-8") as f:
        json.dump(content, f, allow_nan=False, indent=1)
    os.replace(staging, path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    publish(pairs, path, "json")


def write_tracks(observations: DataFrame, path: str) -> None:
    """One JSON object a line: track and its map of frame to pixel."""
    rows = observations.groupBy("track").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("frame").cast("string"), F.array("u", "v"))))).alias("observations"))
    publish(rows, path, "json")


def ascii_ply(rows: Iterable, path: str) -> int:
    """Points (x, y, z, red, green, blue) with %.6g coordinates; rows stream through, none are held."""
    body, n = f"{path}.body", 0
    with open(body, "w") as f:
        for r in rows:
            f.write(f"{r['x']:.6g} {r['y']:.6g} {r['z']:.6g} {r['red']} {r['green']} {r['blue']}\n")
            n += 1
    with open(path, "w") as out, open(body) as f:
        out.write(_header(n, "ascii", "float"))
        for line in f:
            out.write(line)
    os.remove(body)
    return n


def _header(n: int, form: str, real: str) -> str:
    return f"ply\nformat {form} 1.0\nelement vertex {n}\n" + "".join(f"property {real} {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = np.dtype([(c, "<f4") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")])
    for batch in batches:
        rows = np.empty(batch.num_rows, kind)
        for c in PLY_FIELDS:
            rows[c] = batch.column(c).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "body": pa.array([rows.tobytes()], pa.binary())})


def binary_ply(points: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Little-endian vertices of 15 bytes each in one file on the driver's disk.

    Executors pack the vertices; the driver only strings their blocks together, one partition at a time.
    """
    rows = (points.orderBy(*order) if order else points).select(*PLY_FIELDS)
    body, n = f"{path}.body", 0
    try:
        with open(body, "wb") as f:
            for block in rows.mapInArrow(_packed, "n long, body binary").toLocalIterator():
                f.write(block["body"])
                n += block["n"]
        with open(path, "wb") as out, open(body, "rb") as f:
            out.write(_header(n, "binary_little_endian", "float").encode())
            shutil.copyfileobj(f, out, 1 << 20)
    finally:
        if os.path.exists(body):
            os.remove(body)
    return n


def publish_cloud(sparse: DataFrame, path: str, dense: DataFrame | None = None, order: list[str] | None = None) -> dict:
    """Publish the dense points where there are any, else the sparse ones; returns what a status document says of it."""
    chosen, kind = (dense, "dense") if dense is not None and dense.take(1) else (sparse, "sparse")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    points = binary_ply(chosen, staging, order)
    os.replace(staging, path)
    return {"cloud": kind, "points": points}


def write_depth_frames(refined: DataFrame, path: str) -> None:
    """One row a frame, a partition each: depth, support and 8-bit preview as arrays in raster order, pixels without a value 0.

    ``refined(frame, x, y, refined, support, accepted)`` is what ``dense.consensus`` gives. A frame's pixels are bounded by its raster.
    """
    grey = depth_preview(refined.withColumn("depth", F.when(F.col("accepted"), F.col("refined"))))
    rows = grey.groupBy("frame").agg(
        (F.max("x") + 1).cast("int").alias("w"),
        (F.max("y") + 1).cast("int").alias("h"),
        F.map_from_entries(F.collect_list(F.struct((F.col("y") * 65536 + F.col("x")).alias("at"), F.struct("refined", "support", "grey")))).alias("pixels"),
    )
    cells = F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.col("pixels")[F.floor(i / F.col("w")) * 65536 + i % F.col("w")])
    rows = rows.withColumn("cells", cells)
    value = lambda name, kind: F.transform("cells", lambda c: F.coalesce(c[name], F.lit(0)).cast(kind))
    values = [value("refined", "float").alias("depth"), value("support", "tinyint").alias("support"), value("grey", "smallint").alias("preview")]
    publish(rows.select("frame", "h", "w", *values), path, "parquet", ["frame"])


def write_windows(cameras: DataFrame, depths: DataFrame, folder: str) -> None:
    """Predictions of windows as :func:`readers.read_windows` takes them, depths in one folder for each window."""
    publish(cameras, f"{folder.rstrip('/')}/cameras.parquet")
    publish(depths, f"{folder.rstrip('/')}/depths.parquet", partition_by=["window"])


def write_loop_links(links: DataFrame, path: str) -> None:
    """One JSON object a line: a track and its loop links as (source, target) pairs in order."""
    pairs = F.sort_array(F.collect_list(F.array(F.col("source").cast("long"), F.col("target").cast("long")))).alias("links")
    publish(links.groupBy("track").agg(pairs), path, "json")


def trajectory(cameras: DataFrame, path: str) -> None:
    """Cameras in frame order: index, time, camera-to-world, intrinsics, image size."""
    publish(
        cameras.select(
            F.col("frame").alias("keyframe_index"),
            F.col("ts_s").alias("timestamp_seconds"),
            F.array(*[F.array(*[F.get("r", F.lit(3 * i + j)) for j in range(3)], F.get("c", F.lit(i))) for i in range(3)], F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])).alias("camera_to_world"),
            F.array(F.array(F.col("fx"), F.lit(0.0), F.col("cx")), F.array(F.lit(0.0), F.col("fy"), F.col("cy")), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("intrinsics"),
            F.array("h", "w").alias("image_size_hw"),
        ),
        path,
        "json",
    )
