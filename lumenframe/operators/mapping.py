"""Sparse maps as tables: support, initialisation, pruning, merging, validation, similarity votes, residual statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..options import require
from ..plans.ordered import bare, ordered, ranked
from ..plans.scratch import saved
from .graph import connected_components


def camera_support(observations: DataFrame) -> DataFrame:
    return observations.groupBy("frame").agg(F.count(F.lit(1)).alias("observations"))


def covisibility_edges(observations: DataFrame) -> DataFrame:
    """Star edges from each track's first frame to its others: they connect what all pairs would."""
    first = observations.groupBy("track").agg(F.min("frame").alias("first"))
    return observations.select("track", "frame").join(first, "track").where("frame > first").select(F.col("first").alias("u"), F.col("frame").alias("v")).distinct()


def support_violations(cameras: DataFrame, observations: DataFrame, before: DataFrame | None = None, minimum: int = 6, connected: bool = True) -> DataFrame:
    """(frame, observations, connected) of cameras with too few observations, or not joined to the first camera by tracks.

    ``before`` adds each one's count before an operation. Without ``connected`` only counts are asked for.
    """
    counts = cameras.select("frame").join(camera_support(observations), "frame", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    if before is not None:
        counts = counts.join(before.select("frame", F.col("observations").alias("before")), "frame", "left")
    roots = connected_components(covisibility_edges(observations).unionByName(cameras.select(F.col("frame").alias("u"), F.col("frame").alias("v"))))
    counts = counts.join(roots.select(F.col("node").alias("frame"), "root"), "frame", "left")
    anchor = cameras.agg(F.min("frame").alias("frame")).join(roots.select(F.col("node").alias("frame"), F.col("root").alias("anchor")), "frame").select("anchor")
    counts = counts.crossJoin(anchor).withColumn("connected", F.col("root").eqNullSafe(F.col("anchor"))).drop("root", "anchor")  # one row
    wrong = F.col("observations") < minimum
    return counts.where(wrong | ~F.col("connected") if connected else wrong)


def disjoint_union(maps: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Cameras and observations of the parts of one map put together; a camera or a track in two parts is an error."""
    cameras, observations = maps[0][0].withColumn("part", F.lit(0)), maps[0][1].withColumn("part", F.lit(0))
    for i, (c, o) in enumerate(maps[1:], 1):
        cameras, observations = cameras.unionByName(c.withColumn("part", F.lit(i))), observations.unionByName(o.withColumn("part", F.lit(i)))
    for what, rows in (("frame", cameras), ("track", observations)):
        twice = rows.groupBy(what).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").agg(F.count(F.lit(1)).alias("n"), F.min(what).alias("least")).first()
        require(not twice["n"], f"{twice['n']} values of {what} lie in two parts, the least is {twice['least']}")
    return cameras.drop("part"), observations.drop("part")


def stable_anchors(errors: DataFrame, pixels: float = 3.0, minimum: int = 3) -> DataFrame:
    """Tracks that at least ``minimum`` cameras see within ``pixels``; only these may place another camera."""
    return errors.groupBy("track").agg(F.count_if(F.col("error") <= pixels).alias("support")).where(F.col("support") >= minimum)


def _pose(rows: DataFrame) -> tuple[list[Column] | None, list[Column]]:
    """The camera-to-world rotation in the array ``r``, none where rows have no such column, and the centre."""
    return [F.get("r", F.lit(i)) for i in range(9)] if "r" in rows.columns else None, [F.col(f"c{i}") for i in range(3)]


def with_error(observations: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Observations that carry their camera (fx, fy, cx, cy, c0, c1, c2 and the rotation r), joined with landmarks; adds ``error`` and the camera-frame point."""
    j = observations.join(landmarks, "track")
    p = G.camera_point(F.col("x"), F.col("y"), F.col("z"), *_pose(j))
    error = G.reprojection_error(p, *[F.col(c) for c in ("fx", "fy", "cx", "cy", "u", "v")])
    return j.withColumn("error", error).withColumn("px", p[0]).withColumn("py", p[1]).withColumn("pz", p[2])


def initialize_landmarks(observations: DataFrame, pixels: float = 14.0, minimum_views: int = 3) -> DataFrame:
    """Landmarks at the per-axis medians of their back-projected depths; observations beyond ``pixels`` go, then thin tracks."""
    world = G.back_project(*[F.col(c) for c in ("u", "v", "d", "fx", "fy", "cx", "cy")], *_pose(observations))
    placed = observations.withColumn("bx", world[0]).withColumn("by", world[1]).withColumn("bz", world[2])
    land = placed.groupBy("track").agg(*[F.percentile(f"b{c}", 0.5).alias(c) for c in "xyz"])
    kept = with_error(observations, land).where(F.col("error") <= pixels)
    return kept.groupBy("track", "x", "y", "z").agg(F.count(F.lit(1)).alias("views")).where(F.col("views") >= minimum_views)


def prune_landmarks(errors: DataFrame, pixels: float = 3.0, minimum_views: int = 3) -> DataFrame:
    """(track, views) after adjustment."""
    return errors.where(F.col("error") <= pixels).groupBy("track").agg(F.count(F.lit(1)).alias("views")).where(F.col("views") >= minimum_views)


def same_pixel(a: DataFrame, b: DataFrame) -> DataFrame:
    """Measurements that both tables hold: equal track, frame and 1e-4 pixel cell."""
    key = lambda df: df.withColumn("ku", G.pixel_key(F.col("u"))).withColumn("kv", G.pixel_key(F.col("v")))
    return key(a).join(key(b).select("track", "frame", "ku", "kv"), ["track", "frame", "ku", "kv"], "left_semi")


def withhold(observations: DataFrame, holdouts: DataFrame) -> DataFrame:
    """Observations without those equal to earlier hold-outs."""
    key = lambda df: df.withColumn("ku", G.pixel_key(F.col("u"))).withColumn("kv", G.pixel_key(F.col("v")))
    return key(observations).join(key(holdouts).select("track", "frame", "ku", "kv"), ["track", "frame", "ku", "kv"], "left_anti").drop("ku", "kv")


def merge_maps(accepted: DataFrame, local: DataFrame, conflict: float = 1e-3, existing: float = 4.0, new: float = 14.0) -> DataFrame:
    """Observations (track, frame, u, v, origin) of the combined map; both inputs have (track, frame, u, v, error).

    A shared track with a frame measured differently by more than ``conflict`` pixels stays as it was; another
    gains the local observations within ``existing`` pixels in frames it lacks; a new track keeps those within
    ``new``. Tracks then need three observations.
    """
    both = accepted.select("track", "frame", F.col("u").alias("u0"), F.col("v").alias("v0")).join(local, ["track", "frame"])
    apart = F.max(F.hypot(F.col("u") - F.col("u0"), F.col("v") - F.col("v0"))).alias("apart")
    clashing = both.groupBy("track").agg(apart).where(F.col("apart") > conflict).select("track")
    known = accepted.select("track").distinct().withColumn("known", F.lit(True))
    incoming = local.join(clashing, "track", "left_anti").join(known, "track", "left")
    incoming = incoming.where(F.col("error") <= F.when(F.col("known"), existing).otherwise(new)).join(accepted, ["track", "frame"], "left_anti")
    rows = accepted.select("track", "frame", "u", "v", F.lit("map").alias("origin")).unionByName(incoming.select("track", "frame", "u", "v", F.lit("local").alias("origin")))
    enough = rows.groupBy("track").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("track")
    return rows.join(enough, "track", "left_semi")


def compatible_tracks(accepted: DataFrame, local: DataFrame, conflict: float = 1e-3, existing: float = 4.0) -> DataFrame:
    """Shared tracks without conflict that gain three supported observations; a merge needs twenty."""
    both = accepted.select("track", "frame", F.col("u").alias("u0"), F.col("v").alias("v0"))
    joined = local.join(both, ["track", "frame"], "left").join(accepted.select("track").distinct(), "track", "left_semi")
    far = F.max(F.coalesce(F.hypot(F.col("u") - F.col("u0"), F.col("v") - F.col("v0")), F.lit(0.0)))
    return joined.groupBy("track").agg(far.alias("apart"), F.count_if(F.col("error") <= existing).alias("support")).where((F.col("apart") <= conflict) & (F.col("support") >= 3))


def shared_cameras(accepted: DataFrame, local: DataFrame) -> DataFrame:
    a = accepted.groupBy("frame").agg(F.count(F.lit(1)).alias("accepted_support"))
    return a.join(local.groupBy("frame").agg(F.count(F.lit(1)).alias("local_support")), "frame")


def retained_loops(links: DataFrame, observations: DataFrame) -> DataFrame:
    """Loop links whose two frames still observe the landmark."""
    a, b = observations.select("track", F.col("frame").alias("source")), observations.select("track", F.col("frame").alias("target"))
    return links.join(a, ["track", "source"], "left_semi").join(b, ["track", "target"], "left_semi")


def validate_holdouts(holdouts: DataFrame, training: DataFrame, model: DataFrame, errors: DataFrame, pixels: float = 5.0) -> DataFrame:
    """Per frame: hold-outs passed, missing, unsupported, failed, and the frame's verdict.

    ``holdouts(track, frame)``, ``training(track, frame, held_frame, u, v)``, ``model(track, frame, u, v)`` and
    ``errors(track, frame, error)`` of hold-outs whose landmark the model still has. Missing ones stay counted.
    """
    support = same_pixel(training, model).groupBy("track", "held_frame").agg(F.count(F.lit(1)).alias("support"))
    rows = holdouts.join(errors, ["track", "frame"], "left").join(support.withColumnRenamed("held_frame", "frame"), ["track", "frame"], "left")
    missing = F.col("error").isNull()
    thin = ~missing & (F.coalesce("support", F.lit(0)) < 2)
    passed = ~missing & ~thin & (F.col("error") <= pixels)
    out = rows.groupBy("frame").agg(
        F.count(F.lit(1)).alias("holdouts"), F.count_if(passed).alias("passed"), F.count_if(missing).alias("missing"), F.count_if(thin).alias("unsupported"), F.count_if(~missing & ~thin & ~passed).alias("failed")
    )
    return out.withColumn("accepted", (F.col("holdouts") < 5) | (F.col("passed") >= 0.75 * F.col("holdouts")))


#: Cameras to a block: pairs of blocks are rows of their own, so a whole table's pairs spread over all tasks.
BLOCK = 1024


def _pairs_of_blocks(rows: DataFrame, below: bool = False) -> DataFrame:
    """(q, t): every two blocks of rows of a table as arrays of structs, dealt out over the tasks; ``below``: only blocks up to q's own."""
    dealt = ordered(rows, "frame")
    blocks = max(1, -(-dealt.count() // BLOCK))
    dealt = bare(ranked(dealt)).withColumn("b", F.floor(F.col("rank") / BLOCK).cast("int")).drop("rank")
    packed = saved(dealt.groupBy("b").agg(F.collect_list(F.struct(*rows.columns)).alias("rows")), "blocks")
    numbers = rows.sparkSession.range(blocks).select(F.col("id").cast("int").alias("qb"))
    grid = numbers.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("qb") if below else F.lit(blocks - 1))))
    return grid.join(packed.select(F.col("b").alias("qb"), F.col("rows").alias("q")), "qb").join(packed.select(F.col("b").alias("tb"), F.col("rows").alias("t")), "tb").repartition(max(1, min(blocks * blocks, 192)), "qb", "tb").select("q", "t")


def center_scale_votes(reference: DataFrame, local: DataFrame, floor_reference: float, floor_local: float) -> DataFrame:
    """(i, j, scale) for pairs j < i of shared cameras with enough displacement and like directions; blocks of cameras meet blocks."""
    names = [*[f"c{k}" for k in range(3)], *[f"l{k}" for k in range(3)]]
    both = reference.join(local.select("frame", *[F.col(f"c{k}").alias(f"l{k}") for k in range(3)]), "frame")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, t in zip(batch["q"], batch["t"], strict=True):
                fq, ft = np.array([r["frame"] for r in q]), np.array([r["frame"] for r in t])
                a, b = ([np.array([r[c] for r in rows], float) for c in names] for rows in (q, t))
                found = []
                for i in range(len(fq)):
                    tt, ss, st = (sum(((a[m][i] - b[m]) * (a[n][i] - b[n]) for m, n in zip(x, y, strict=True)), np.zeros(len(ft))) for x, y in (((0, 1, 2), (0, 1, 2)), ((3, 4, 5), (3, 4, 5)), ((3, 4, 5), (0, 1, 2))))
                    tn, sn = np.sqrt(tt), np.sqrt(ss)
                    with np.errstate(all="ignore"):
                        at = np.flatnonzero((ft < fq[i]) & (tn > floor_reference) & (sn > floor_local) & (st / (sn * tn) >= 0.8))
                    found.append((np.full(len(at), fq[i]), ft[at], st[at] / (sn[at] * sn[at])))
                    if sum(len(f[0]) for f in found) >= 100_000 or i == len(fq) - 1:
                        yield pd.DataFrame(dict(zip(("i", "j", "scale"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))
                        found = []

    return _pairs_of_blocks(both.select("frame", *names), below=True).mapInPandas(run, "i long, j long, scale double")


def rotation_costs(rotations: DataFrame) -> DataFrame:
    """(frame, cost, medoid): summed angle to all others; the least is the medoid, the first of equals. Blocks of cameras meet blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, t in zip(batch["q"], batch["t"], strict=True):
                a, b = np.array([r["r"] for r in q], float), np.array([r["r"] for r in t], float).T.copy()
                sums = np.empty(len(a))
                for i in range(len(a)):
                    trace = a[i, 0] * b[0]
                    for k in range(1, 9):  # the terms in the order of G.rotation_angle
                        trace += a[i, k] * b[k]
                    sums[i] = np.arccos(np.clip((trace - 1) / 2, -1, 1)).sum()
                yield pd.DataFrame({"frame": [r["frame"] for r in q], "part": sums})

    sums = _pairs_of_blocks(rotations.select("frame", "r")).mapInPandas(run, "frame long, part double")
    costs = saved(sums.groupBy("frame").agg(F.round(F.sum("part"), 5).alias("cost")), "rotation-costs")
    best = costs.agg(F.min(F.struct("cost", "frame")).alias("b"))
    return costs.crossJoin(best).select("frame", "cost", (F.col("frame") == F.col("b.frame")).alias("medoid"))


def shared_intrinsics(cameras: DataFrame) -> DataFrame:
    return cameras.agg(*[F.percentile(c, 0.5).alias(c) for c in ("fx", "fy", "cx", "cy")])


def normalized_gauge(cameras: DataFrame, order: str = "frame") -> DataFrame:
    """Centres relative to the first camera in units of the median step (steps above 1e-8 count)."""
    w = W.orderBy(order)
    step = F.sqrt(sum((F.pow(F.col(f"c{k}") - F.lag(f"c{k}").over(w), 2) for k in range(3)), F.lit(0.0)))
    scale = cameras.withColumn("step", step).agg(F.percentile(F.when(F.col("step") > 1e-8, F.col("step")), 0.5).alias("unit"), *[F.min_by(f"c{k}", order).alias(f"o{k}") for k in range(3)])
    return cameras.crossJoin(scale).select(*[c for c in cameras.columns if c not in ("c0", "c1", "c2")], *[((F.col(f"c{k}") - F.col(f"o{k}")) / F.coalesce("unit", F.lit(1.0))).alias(f"c{k}") for k in range(3)])


def error_statistics(errors: DataFrame, by: list[str], c: float = 3.0) -> DataFrame:
    """Per group of squared errors: count, finite, within c squared, truncated cost, upper median of the roots."""
    e = F.col("error2")
    finite = e < G.INF
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sqrt(error2) DESC)")  # of an even count the higher one
    return errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("finite"), F.count_if(e <= c * c).alias("within"), F.sum(F.least(e, F.lit(c * c))).alias("tls_cost"), upper.alias("median")
    )


def gnc_round(weighted: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (track, root_weight): soft weights, and landmarks frozen for the round (fewer than three active views)."""
    soft = F.col("root_weight").between(0.01, 0.99) & (F.col("root_weight") > 0.01) & (F.col("root_weight") < 0.99)
    per_track = weighted.groupBy(*by, "track").agg(F.count_if(soft).alias("soft"), F.count_if(F.col("root_weight") > 0.01).alias("active"))
    return per_track.groupBy(*by).agg(F.sum("soft").alias("soft"), F.count_if(F.col("active") < 3).alias("frozen"))


def residuals(errors: DataFrame, delta: float = 3.0) -> DataFrame:
    """The two pixel residuals under Huber and the cheirality barrier of every observation."""
    depth = F.greatest(F.col("pz"), F.lit(1e-4))
    ru, rv = F.col("fx") * F.col("px") / depth + F.col("cx") - F.col("u"), F.col("fy") * F.col("py") / depth + F.col("cy") - F.col("v")
    h = G.huber_weight(F.hypot(ru, rv), delta)
    return errors.withColumn("r0", h * ru).withColumn("r1", h * rv).withColumn("r2", 1000 * F.least(F.col("pz") - 1e-4, F.lit(0.0)))


def point_blocks(errors: DataFrame) -> DataFrame:
    """Per track the 3 by 3 normal block of its point (upper triangle), summed over its observations."""
    z = F.col("pz")
    ju = [F.col("fx") / z, F.lit(0.0), -F.col("fx") * F.col("px") / (z * z)]
    jv = [F.lit(0.0), F.col("fy") / z, -F.col("fy") * F.col("py") / (z * z)]
    r, _ = _pose(errors)
    if r is not None:  # from the camera's frame to the world's
        ju, jv = ([sum((j[i] * r[3 * k + i] for i in range(1, 3)), j[0] * r[3 * k]) for k in range(3)] for j in (ju, jv))
    return errors.groupBy("track").agg(*[F.sum(ju[i] * ju[j] + jv[i] * jv[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)])


