"""Connection repair: match, build tracks, find weak boundaries, insert frames, again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, matching, retrieval
from ..options import require
from .scratch import saved


def _edges(matches: DataFrame, loops: DataFrame | None) -> DataFrame:
    good = matching.verified_pairs(matches).select("source", "target")
    kind = F.col("pair_kind") == "loop" if "pair_kind" in matches.columns else F.lit(False)
    rows = matches.where("inlier").join(good, ["source", "target"], "left_semi").withColumn("is_loop", kind)
    if loops is not None:
        rows = rows.where(~F.col("is_loop")).unionByName(rows.where("is_loop").join(loops, ["source", "target"], "left_semi"))
    return saved(rows.select(F.col("source").alias("fa"), F.col("source_feature").alias("ka"), F.col("target").alias("fb"), F.col("target_feature").alias("kb"), "confidence", "is_loop"), "repair-edges")


def tracks_of(matches: DataFrame, loops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tracks with loops, tracks of temporal matches alone): inliers of verified pairs, loop pairs only if corroborated."""
    edges = _edges(matches, loops)
    return graph.build_tracks(edges), graph.build_tracks(edges.where(~F.col("is_loop")))


def verified_loops(matches: DataFrame, size: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(pairs that pass the quality gate, those of them that another one corroborates) of matches of kind loop."""
    gated = saved(matching.loop_pair_quality(matches.where("pair_kind = 'loop'"), *size).where("accepted").select("source", "target"), "repair-loops")
    return gated, saved(retrieval.corroborated(gated), "repair-corroborated")


def repair(
    frames: DataFrame,
    match: Callable[[DataFrame, DataFrame], DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    *,
    rounds: int = 2,
    crossing: int = 60,
    share: float = 0.25,
    most: int = 512,
    neighbors: int = 4,
    describe: Callable[[DataFrame], DataFrame] | None = None,
    size: tuple[float, float] | None = None,
    search: dict | None = None,
):
    """Frames (frame, candidate) with insertions, their tracks, and the rounds' counts.

    ``match(frames, pairs)`` gives matches of pairs and ``fetch(candidates)`` the inserted frames' records. At
    most ``rounds`` rounds insert frames where fewer than ``crossing`` tracks cross a boundary, at most ``share`` of the
    frames and ``most`` in all.

    ``describe(frames)`` gives descriptors (frame, ts_s, emb), ``search`` keywords of ``retrieval.loop_candidates``; each round retrieves loop candidates by them and asks
    for temporal and loop pairs together (``pair_kind``). Pairs that were temporal in a round stay so when insertions
    move them apart. Without ``describe`` no loops are looked for. A pair is temporal if planned so, or if near and not
    planned; any other enters the tracks only if it passes the loop quality gate in images of ``size`` (width, height;
    matches then need au, av, bu, bv) and another such pair corroborates it; without ``size`` none does.
    Weak boundaries are found on temporal tracks alone. The last count has ``loop_links``, a table as of
    ``graph.loop_links``.
    """
    require(describe is None or size is not None, "loops need the images' size")
    require(rounds >= 0 and crossing >= 0, "rounds and crossing tracks must not be negative")
    first = frames.count()
    budget, history, earlier = graph.insertion_budget(first, share, most), [], None
    for turn in range(rounds + 1):
        temporal = matching.temporal_pairs(frames, neighbors)
        if earlier is not None:
            temporal = temporal.unionByName(earlier).distinct()
        loops = temporal.limit(0) if describe is None else retrieval.loop_candidates(describe(frames), neighbors, **(search or {}))
        plan = saved(matching.pair_plan(temporal, loops, neighbors), "repair-plan")
        near = F.when(F.col("target") - F.col("source") <= neighbors, "temporal").otherwise("loop")
        matches = match(frames, plan).drop("pair_kind").join(plan, matching.PAIR, "left").withColumn("pair_kind", F.coalesce("pair_kind", near))
        matches = saved(matches, "repair-matches")
        loops = matches.where("false").select("source", "target")
        counted = {}
        if size is not None:
            gated, loops = verified_loops(matches, size)
            counted = {"loop_candidates": plan.where("pair_kind = 'loop'").count(), "verified_loops": gated.count(), "corroborated_loops": loops.count()}
        edges = _edges(matches, loops)
        tracks = graph.build_tracks(edges)
        extents = graph.build_tracks(edges.where(~F.col("is_loop"))).groupBy("head_frame", "head_kp").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
        counts = saved(graph.crossing_counts(extents, frames), "repair-counts")
        count = frames.count()
        weak = graph.weak_boundaries(counts, crossing)
        history.append({"round": turn, "frames": count, "weak": weak.count(), **counted})
        left = budget - (count - first)
        if turn == rounds or left <= 0 or not history[-1]["weak"]:
            break
        added = saved(graph.repair_candidates(frames, counts, left, crossing).select("candidate"), "repair-added")
        if not added.take(1):
            break
        together = frames.select("candidate").unionByName(fetch(added).select("candidate")).distinct()
        old = frames.select("candidate", F.col("frame").alias("old"))
        frames = saved(together.withColumn("frame", (F.row_number().over(W.orderBy("candidate")) - 1).cast("long")), "repair-frames")
        ids = old.join(frames.select("candidate", F.col("frame").alias("new")), "candidate").select("old", "new")
        earlier = saved(matching.remap_pairs(plan.where("pair_kind = 'temporal'"), ids).select(F.col("new_source").alias("source"), F.col("new_target").alias("target")), "repair-pairs")
    history[-1]["loop_links"] = graph.loop_links(edges, tracks)
    return frames, tracks, history
