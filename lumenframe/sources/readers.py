"""Readers of stage records, with explicit schemas, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import violations_of_order
from ..plans.ordered import bare, ordered, ranked

MANIFEST = "format_version INT, source_width INT, source_height INT, width INT, height INT, decoder STRING, max_edge INT, timestamp_origin DOUBLE, storage STRING, candidate_frame_count BIGINT"
PAIRS = (
    "source BIGINT, target BIGINT, verification STRING, pair_kind STRING, retrieval_score DOUBLE, "
    "matches ARRAY<STRUCT<a: ARRAY<DOUBLE>, b: ARRAY<DOUBLE>, source_feature: BIGINT, target_feature: BIGINT, inlier: BOOLEAN, confidence: DOUBLE>>, "
    "loop_geometry STRUCT<accepted: BOOLEAN, inliers: BIGINT, matches: BIGINT, grid_cells: ARRAY<INT>>"
)
#: What a manifest's storage may be.
STORAGE = ("images", "metadata_only", "keyframes_only")
IMAGES = ("jpg", "jpeg", "png")


class RecordError(ValueError):
    """Input that breaks a constraint."""


def expect_empty(violations: DataFrame, message: str) -> None:
    if found := violations.limit(3).collect():
        raise RecordError(f"{message}: {found}")


def natural_key(name: Column) -> Column:
    """A sort key that orders digit runs by value: each is padded by its length."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.concat(F.lit("0"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0"))).otherwise(F.concat(F.lit("1"), p))), "")


def read_images(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """Image files of a folder in natural order: path, content, position."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*IMAGES)).withColumn("natural", natural_key(name))
    # Names are ranked without the images' bytes.
    places = bare(ranked(ordered(files.select("path", "natural"), "natural", "path"), "position")).drop("natural")
    out = files.drop("natural").join(places, "path")
    return out if first is None else out.where(F.col("position") < first)


#: The first bytes of the readable kinds of image.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF"}


def unreadable_images(images: DataFrame) -> DataFrame:
    """Paths of ``images(path, content)`` that are empty or don't begin as their kind of file does. Only the first bytes are looked at."""
    kind, start = F.lower(F.element_at(F.split("path", r"\."), -1)), F.hex(F.substring("content", 1, 8))
    sound = F.lit(False)
    for name, signature in SIGNATURES.items():
        sound = sound | ((kind == name) & start.startswith(signature))
    return images.where(~F.coalesce(sound, F.lit(False))).select("path")


def check_images(images: DataFrame) -> None:
    expect_empty(unreadable_images(images), "unreadable images")


CAMERAS = "window BIGINT, frame BIGINT, fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE, r ARRAY<DOUBLE>, c ARRAY<DOUBLE>"
DEPTHS = "window BIGINT, frame BIGINT, kp BIGINT, depth DOUBLE"


def read_windows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Predicted cameras and depths of windows; other columns are left in the files, and a frame predicted twice in a window is an error."""
    cameras, depths = (spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parquet") for name, schema in (("cameras", CAMERAS), ("depths", DEPTHS)))
    twice = cameras.groupBy("window", "frame").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    expect_empty(twice, "frames predicted twice in a window")
    check_cameras(cameras)
    return cameras, depths


def check_dimensions(frames: DataFrame) -> None:
    """All frames share one width and height."""
    sizes = frames.select("w", "h").distinct().limit(2).collect()
    if len(sizes) > 1:
        raise RecordError(f"frame dimensions differ: {sizes}")


def read_manifest(spark: SparkSession, path: str, frames: DataFrame | None = None):
    """The one header row, checked; with ``frames`` also their order and alignment."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).collect()
    if len(rows) != 1 or rows[0]["format_version"] != 1:
        raise RecordError("a manifest of format version 1 is required")
    head = rows[0]
    if head["storage"] not in STORAGE or not head["width"] or not head["height"] or head["width"] > head["source_width"] or head["height"] > head["source_height"]:
        raise RecordError("invalid manifest header")
    if frames is not None:
        expect_empty(violations_of_order(frames, "candidate", "ts_s"), "timestamps must rise strictly")
        expect_empty(violations_of_order(frames.withColumn("source_frame", F.col("source_frame").cast("double")), "candidate", "source_frame"), "source indices must rise strictly")
    return head


def misaligned(selected: DataFrame, decoded: DataFrame, key: str = "candidate", columns: tuple[str, ...] = ("source_frame", "ticks", "ts_s")) -> DataFrame:
    """Selected records that differ from the decoded record of the same key, or have none."""
    both = selected.select(key, *[F.col(c).alias(f"s_{c}") for c in columns]).join(decoded.select(key, *columns), key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return both.where(differs)


def check_alignment(selected: DataFrame, decoded: DataFrame, key: str = "candidate", columns: tuple[str, ...] = ("source_frame", "ticks", "ts_s")) -> None:
    """Selected records equal the decoded ones."""
    expect_empty(misaligned(selected, decoded, key, columns), "selected frames differ from decoded ones")


def read_pairs(spark: SparkSession, path: str, frames: int | None = None) -> DataFrame:
    """Pair records, one JSON object a line; malformed lines and invalid ids are errors."""
    pairs = spark.read.schema(PAIRS).option("mode", "FAILFAST").json(path)
    bad = F.col("source").isNull() | F.col("target").isNull() | (F.col("source") == F.col("target"))
    if frames is not None:
        bad = bad | ~F.col("source").between(0, frames - 1) | ~F.col("target").between(0, frames - 1)
    expect_empty(pairs.where(bad).select("source", "target"), "invalid frame ids in pairs")
    return pairs


def matches_of(pairs: DataFrame) -> DataFrame:
    m = pairs.select("source", "target", "pair_kind", F.explode("matches").alias("m"))
    return m.select(
        "source",
        "target",
        "pair_kind",
        "m.source_feature",
        "m.target_feature",
        *[F.get(f"m.{p}", F.lit(i)).alias(f"{p}{c}") for p in "ab" for i, c in enumerate("uv")],
        "m.inlier",
        "m.confidence",
    )


def check_keypoints(matches: DataFrame) -> None:
    """One pixel per frame and keypoint, to 1e-4."""
    ends = matches.select(F.col("source").alias("frame"), F.col("source_feature").alias("kp"), F.col("au").alias("u"), F.col("av").alias("v")).unionByName(
        matches.select(F.col("target").alias("frame"), F.col("target_feature").alias("kp"), F.col("bu").alias("u"), F.col("bv").alias("v"))
    )
    spread = ends.groupBy("frame", "kp").agg((F.max("u") - F.min("u")).alias("du"), (F.max("v") - F.min("v")).alias("dv"))
    expect_empty(spread.where("du > 1e-4 OR dv > 1e-4"), "a keypoint has several pixels")


def check_tracks(observations: DataFrame) -> None:
    """A measured pixel belongs to one track."""
    cells = observations.groupBy("frame", F.rint(F.col("u") * 1e4).alias("ku"), F.rint(F.col("v") * 1e4).alias("kv")).agg(F.count_distinct("track").alias("tracks"))
    expect_empty(cells.where("tracks > 1"), "a pixel belongs to several tracks")


def check_cameras(cameras: DataFrame) -> None:
    """Positive focals; rotations (array r, row by row) orthonormal to 1e-3 with determinant +1."""
    r = [F.get("r", F.lit(k)) for k in range(9)]
    bad = (F.size("r") != 9) | ~(F.col("fx") > 0) | ~(F.col("fy") > 0)
    for i in range(3):
        for j in range(i, 3):
            dot = sum((r[3 * i + k] * r[3 * j + k] for k in range(3)), F.lit(0.0))
            bad = bad | (F.abs(dot - (1.0 if i == j else 0.0)) > 1e-3)
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    expect_empty(cameras.where(F.coalesce(bad | (det < 0), F.lit(True))).select("frame"), "invalid cameras")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Observations (track, frame, u, v) from one JSON object {frame: [u, v]} a line; tracks are numbered in ``track``."""
    lines = spark.read.schema(T.StructType([T.StructField("track", T.LongType()), T.StructField("observations", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])).json(path)
    return lines.select("track", F.explode("observations").alias("frame", "p")).select("track", F.col("frame").cast("long").alias("frame"), F.get("p", F.lit(0)).alias("u"), F.get("p", F.lit(1)).alias("v"))


def read_loop_links(spark: SparkSession, path: str, tracks: DataFrame | None = None) -> DataFrame:
    """Loop links (track, source, target); a link of a frame with itself, or of frames that don't see the track in ``tracks``, is an error."""
    lines = spark.read.schema("track BIGINT, links ARRAY<ARRAY<BIGINT>>").option("mode", "FAILFAST").json(path)
    links = lines.select("track", F.explode("links").alias("l")).select("track", F.get("l", F.lit(0)).alias("source"), F.get("l", F.lit(1)).alias("target"))
    expect_empty(links.where(F.coalesce(F.col("source") == F.col("target"), F.lit(True))), "invalid loop links")
    if tracks is not None:
        for end in ("source", "target"):
            seen = tracks.select("track", F.col("frame").alias(end))
            expect_empty(links.join(seen, ["track", end], "left_anti"), f"loop links whose {end} does not see the track")
    return links
