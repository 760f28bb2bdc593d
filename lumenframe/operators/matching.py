"""Pairs and matches: plans, gates, coverage, mutual neighbours, model choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..options import require

PAIR = ["source", "target"]


def temporal_pairs(frames: DataFrame, neighbors: int = 4) -> DataFrame:
    """source < target <= source + neighbors, as an equi-join on spread offsets."""
    require(1 <= neighbors <= 12, "neighbors must lie in [1, 12]")
    near = frames.select(F.col("frame").alias("source")).withColumn("target", F.explode(F.sequence(F.col("source") + 1, F.col("source") + neighbors)))
    return near.join(frames.select(F.col("frame").alias("target")), "target", "left_semi").select(*PAIR)


def pair_plan(temporal: DataFrame, loops: DataFrame, neighbors: int = 4) -> DataFrame:
    """Union of temporal and loop pairs with their kind: temporal where planned so or near, else loop."""
    rows = temporal.select(*PAIR, F.lit(True).alias("t")).unionByName(loops.select(*PAIR, F.lit(False).alias("t")))
    kind = F.when(F.col("t") | (F.col("target") - F.col("source") <= neighbors), "temporal").otherwise("loop")
    return rows.groupBy(*PAIR).agg(F.max("t").alias("t")).select(*PAIR, kind.alias("pair_kind"))


def missing_pairs(plan: DataFrame, reusable: DataFrame) -> DataFrame:
    return plan.join(reusable.select(*PAIR), PAIR, "left_anti")


def reusable_pairs(previous: DataFrame, loops: DataFrame) -> DataFrame:
    """Earlier temporal pairs, and earlier pairs that are loop candidates now."""
    return previous.where("pair_kind = 'temporal'").select(*PAIR).unionByName(previous.join(loops, PAIR, "left_semi").select(*PAIR)).distinct()


def plan_differences(plan: DataFrame, cached: DataFrame) -> DataFrame:
    """Pairs that a plan and a cached batch don't hold equally often, with the surplus of the plan."""
    sides = plan.select(*PAIR, F.lit(1).alias("n")).unionByName(cached.select(*PAIR, F.lit(-1).alias("n")))
    return sides.groupBy(*PAIR).agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def same_plan(plan: DataFrame, cached: DataFrame) -> bool:
    """Whether a cached batch holds exactly the planned pairs."""
    return not plan_differences(plan, cached).take(1)


def remap_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs in new frame numbers, from ``ids(old, new)``; pairs with a dropped frame go."""
    one = ids.select(F.col("old").alias("source"), F.col("new").alias("new_source"))
    two = ids.select(F.col("old").alias("target"), F.col("new").alias("new_target"))
    return pairs.join(one, "source").join(two, "target")


def usable_keypoint(x: Column, y: Column, score: Column, w: float, h: float, threshold: float = 0.0, border: float = 4.0) -> Column:
    finite = ~F.isnan(x) & ~F.isnan(y) & ~F.isnan(score) & (F.abs(x) < G.INF) & (F.abs(y) < G.INF) & (F.abs(score) < G.INF)
    return F.coalesce(finite & (x >= border) & (y >= border) & (x < w - border) & (y < h - border) & (score >= threshold), F.lit(False))


def compact_matches(raw: DataFrame, keypoints: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Matches (source, target, i, j, confidence) with valid indices, usable ends and enough confidence, with their points.

    ``invalid`` marks pairs that held a non-finite confidence.
    """
    ends = keypoints.where("usable").select("frame", "kp", "x", "y")
    bad = raw.groupBy(*PAIR).agg(F.max(F.isnan("confidence") | (F.abs("confidence") == G.INF)).alias("invalid"))
    kept = raw.where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("confidence") >= threshold) & ~F.isnan("confidence"))
    a = ends.select(F.col("frame").alias("source"), F.col("kp").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = ends.select(F.col("frame").alias("target"), F.col("kp").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return kept.join(a, ["source", "i"]).join(b, ["target", "j"]).join(bad, PAIR)


def mutual_nearest(scores: DataFrame) -> DataFrame:
    """Cells (g, i, j, score) that are the best of their row and of their column; the lower index wins a tie."""
    rows = scores.groupBy("g", "i").agg(F.min(F.struct((-F.col("score")).alias("s"), "j")).alias("best")).select("g", "i", F.col("best.j").alias("j"), (-F.col("best.s")).alias("score"))
    columns = scores.groupBy("g", "j").agg(F.min(F.struct((-F.col("score")).alias("s"), "i")).alias("best")).select("g", "j", F.col("best.i").alias("i"))
    return rows.join(columns, ["g", "i", "j"], "left_semi")


def nearest_pairs(a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """Mutual nearest neighbours (g, i, j, score) by dot product of ``a(g, i, vector)`` and ``b(g, j, vector)`` within a group.

    Blocks meet blocks in matrix products, each pair of blocks in a row of its own; only the best of each row and column
    of a product leave it, so scores are never a table. The lower index wins a tie.
    """
    require(block >= 1, "a block has at least one row")

    def packed(df: DataFrame, index: str, name: str) -> DataFrame:
        sizes = df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        dealt = df.join(sizes, "g").withColumn(f"{name}_block", F.pmod(F.xxhash64(index), F.col("blocks")))
        row = F.struct(F.col(index).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v"))
        return dealt.groupBy("g", f"{name}_block").agg(F.sort_array(F.collect_list(row)).alias(name))

    grid = packed(a, "i", "left").join(packed(b, "j", "right"), "g").repartition("g", "left_block", "right_block").select("g", "left", "right")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, left, right in zip(batch["g"], batch["left"], batch["right"], strict=True):
                x, y = np.array([r["v"] for r in left]), np.array([r["v"] for r in right])
                i, j = np.array([r["id"] for r in left]), np.array([r["id"] for r in right])
                scores = np.zeros((len(x), len(y)))
                for d in range(x.shape[1]):  # one order of terms, so a score doesn't depend on the blocks
                    scores += x[:, d : d + 1] * y[:, d]
                to_j, to_i = scores.argmax(axis=1), scores.argmax(axis=0)  # ids ascend: the first of equals is the lowest
                yield pd.DataFrame({"g": g, "of_row": True, "i": i, "j": j[to_j], "score": scores[np.arange(len(i)), to_j]})
                yield pd.DataFrame({"g": g, "of_row": False, "i": i[to_i], "j": j, "score": scores[to_i, np.arange(len(j))]})

    best = grid.mapInPandas(run, f"g {a.schema['g'].dataType.simpleString()}, of_row boolean, i long, j long, score double")
    return mutual_nearest(best.drop("of_row"))


def pair_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("matches"), F.count_if("inlier").alias("inliers"))


def verified_pairs(matches: DataFrame, minimum: int = 30, ratio: float = 0.25) -> DataFrame:
    """Pairs with at least ``minimum`` inliers that are at least ``ratio`` of their matches."""
    return pair_counts(matches).where((F.col("inliers") >= minimum) & (F.col("inliers") >= ratio * F.col("matches")))


def loop_pair_quality(matches: DataFrame, w: float, h: float) -> DataFrame:
    """The pair gate, and at least four of sixteen cells in both images."""

    def cells(x: str, y: str) -> Column:
        inside = F.col("inlier") & (F.col(x) >= 0) & (F.col(x) < w) & (F.col(y) >= 0) & (F.col(y) < h)
        return F.count_distinct(F.when(inside, F.floor(F.col(y) * 4 / h) * 4 + F.floor(F.col(x) * 4 / w)))

    out = matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("matches"), F.count_if("inlier").alias("inliers"), cells("au", "av").alias("cells_a"), cells("bu", "bv").alias("cells_b"))
    ok = (F.col("inliers") >= 30) & (F.col("inliers") >= 0.25 * F.col("matches")) & (F.least("cells_a", "cells_b") >= 4)
    return out.withColumn("accepted", ok)


def match_coverage(matches: DataFrame, wa: float, ha: float, wb: float, hb: float) -> DataFrame:
    """Per pair: inliers, covered share of the poorer image's sixteen cells, upper median displacement over the diagonal."""
    bit = lambda x, y, w, h: F.bit_or(F.when(F.col("inlier"), F.call_function("shiftleft", F.lit(1), G.grid_cell(F.col(x), F.col(y), w, h))))
    step = F.hypot(F.col("au") - F.col("bu"), F.col("av") - F.col("bv"))
    out = matches.groupBy(*PAIR).agg(
        F.count_if("inlier").alias("inliers"),
        F.count(F.lit(1)).alias("matches"),
        F.least(F.bit_count(bit("au", "av", wa, ha)), F.bit_count(bit("bu", "bv", wb, hb))).alias("cells"),
        F.sort_array(F.collect_list(F.when(F.col("inlier"), step))).alias("steps"),
    )
    middle = F.get(F.col("steps"), F.floor(F.size("steps") / 2).cast("int"))
    return out.select(
        *PAIR,
        "inliers",
        F.coalesce(F.try_divide(F.col("inliers"), F.col("matches")), F.lit(0.0)).alias("ratio"),
        (F.coalesce("cells", F.lit(0)) / 16.0).alias("coverage"),
        (F.coalesce(middle, F.lit(0.0)) / (wa * wa + ha * ha) ** 0.5).alias("displacement"),
    )


def reliable(quality: DataFrame, inliers: int = 60, ratio: float = 0.4, coverage: float = 0.25) -> DataFrame:
    return quality.where((F.col("inliers") >= inliers) & (F.col("ratio") >= ratio) & (F.col("coverage") >= coverage))


def choose_model(hypotheses: DataFrame) -> DataFrame:
    """Per pair and family the hypothesis with most inliers, then least cost, then least id; then the homography only if it has more."""
    best = hypotheses.groupBy("target", "family").agg(F.min(F.struct((-F.col("inliers")).alias("n"), "cost", "id")).alias("b"))
    ranked = best.groupBy("target").agg(F.min(F.struct(F.col("b.n").alias("n"), (F.col("family") == "H").alias("h"), F.col("b.cost").alias("cost"), F.col("b.id").alias("id"))).alias("w"))
    return ranked.select("target", F.when(F.col("w.h"), "H").otherwise("F").alias("family"), F.col("w.id").alias("id"), (-F.col("w.n")).alias("inliers"))
