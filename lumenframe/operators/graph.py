"""Feature tracks and image connectivity: components, constrained joining, crossing counts, repair plans."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import require
from ..plans.scratch import saved
from ..plans.spread import spread_join


#: Edges that one task unites by itself before the rounds between tasks begin.
TOGETHER = 1_000_000


def _rooted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of these edges, the places of all ``u`` and then all ``v`` among them, and the place of the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        left, right = root[a], root[b]
        apart = left != right
        if not apart.any():
            break
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while (root != root[root]).any():
            root = root[root]
    return nodes, at, root


def _united(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """(u, v) of the nodes that these edges join to a lesser one, the least they reach among these edges."""
    nodes, _, root = _rooted(u, v)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= TOGETHER:
            yield _united(*(np.concatenate([h[c].to_numpy() for h in held]) for c in "uv"))
            held, rows = [], 0
    if rows:
        yield _united(*(np.concatenate([h[c].to_numpy() for h in held]) for c in "uv"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges(u, v)``; root is the least node reachable.

    Each task first unites TOGETHER edges at a time by itself, which leaves at most one edge a node of them; where that
    was all, the work is done. Else alternating star steps follow, each a partial minimum and a join with one row per
    node, until the table holds still; every round is written to the shared folder. The table never grows from
    round to round. Nodes with a large share of all edges are joined in pieces.
    """
    held = saved(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")), "edges")
    alone = held.where("u = v").select(F.col("u").alias("node"))
    rows = held.count()
    parts = max(1, -(-rows // TOGETHER))
    held = saved(held.where("u <> v").coalesce(parts).mapInPandas(_unite, "u long, v long").distinct(), "edges", rows)
    before = tuple(held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) if parts > 1 else None
    while parts > 1:
        rows = before[0]
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n")
        large = spread_join(held, low, ["v"], "n", 2 * rows, ["u"]).select("u", F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, ["u"], "n", rows, ["v"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        held = saved(small.select("e.*").where("u > v").distinct(), "edges", rows)
        mark = tuple(held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before:
            break
        before = mark
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
    centres = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = stars.unionByName(centres)
    return found.unionByName(alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root")))


def join_constrained(edges: pd.DataFrame) -> pd.DataFrame:
    """Strongest edge first, join its two components unless they share a frame. (fa, ka, fb, kb, confidence, is_loop) -> (frame, kp, head_frame, head_kp)."""
    parent: dict = {}
    frames: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        frames.setdefault(x, {x[0]})
        return x

    rows = edges.sort_values(["confidence", "fa", "ka", "fb", "kb", "is_loop"], ascending=False)
    for fa, ka, fb, kb in rows[["fa", "ka", "fb", "kb"]].itertuples(index=False):
        x, y = top((fa, ka)), top((fb, kb))
        if x == y or frames[x] & frames[y]:
            continue
        if len(frames[x]) < len(frames[y]):
            x, y = y, x
        parent[y] = x
        frames[x] |= frames.pop(y)
    groups: dict = {}
    for node in parent:
        groups.setdefault(top(node), []).append(node)
    return pd.DataFrame([(*n, *min(g)) for g in groups.values() for n in g], columns=["frame", "kp", "head_frame", "head_kp"])


#: Edges of a component that one task joins by itself; larger ones are joined by rounds over all tasks.
JOINED = 200_000


def join_by_rounds(edges: DataFrame) -> DataFrame:
    """What :func:`join_constrained` gives, of any number of edges, as (frame, kp, head_frame, head_kp).

    What happens to an edge depends only on the stronger edges at its two groups. So in a round every edge that is the
    strongest left at both its groups is decided at once: the groups are joined, or share a frame and the edge goes
    for good, as groups only grow. Such edges touch each group once, so joined groups come in pairs.
    """
    node = lambda f, k: F.struct(F.col(f).alias("frame"), F.col(k).alias("kp"))
    order = F.struct("confidence", "fa", "ka", "fb", "kb", "is_loop")
    live = saved(edges.select(node("fa", "ka").alias("a"), node("fb", "kb").alias("b"), order.alias("at")).distinct(), "join-edges")
    members = saved(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("head")), "join-members")
    while True:
        live = saved(live.where("a <> b"), "join-edges")
        best = live.select(F.col("a").alias("head"), "at").union(live.select("b", "at")).groupBy("head").agg(F.max("at").alias("at"))
        chosen = live.join(best.select(F.col("head").alias("a"), "at"), ["a", "at"]).join(best.select(F.col("head").alias("b"), "at"), ["b", "at"]).select("a", "b", "at")
        chosen = saved(chosen, "join-chosen")
        if not chosen.take(1):
            break
        frames = members.select("head", F.col("node.frame").alias("frame"))
        both = chosen.join(frames.withColumnRenamed("head", "a"), "a").join(frames.withColumnRenamed("head", "b"), ["b", "frame"])
        clash = saved(both.select("a", "b").distinct(), "join-clashes")
        moves = chosen.join(clash, ["a", "b"], "left_anti").select(F.greatest("a", "b").alias("head"), F.least("a", "b").alias("to"))
        moves = saved(moves, "join-moves")
        renamed = lambda df, c: df.join(moves.withColumnRenamed("head", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        members = saved(renamed(members, "head"), "join-members")
        rejected = chosen.join(clash, ["a", "b"]).select("at")
        live = renamed(renamed(live.join(rejected, "at", "left_anti"), "a"), "b")
    return members.select("node.frame", "node.kp", F.col("head.frame").alias("head_frame"), F.col("head.kp").alias("head_kp"))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the least node of their component among up to TOGETHER edges, and which ends first name a node there."""
    held, rows = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
        if rows and (batch is None or rows >= TOGETHER):
            edges = pa.Table.from_batches(held)
            nodes, at, root = _rooted(edges["u"].to_numpy(), edges["v"].to_numpy())
            named = np.zeros(2 * rows, bool)
            seen = np.empty(len(nodes), np.int64)
            seen[at] = np.arange(2 * rows)
            named[seen] = True
            edges = edges.append_column("label", pa.array(nodes[root[at[:rows]]])).append_column("names_u", pa.array(named[:rows])).append_column("names_v", pa.array(named[rows:]))
            yield from edges.to_batches(max_chunksize=50_000)
            held, rows = [], 0


#: Rows of two numbers that a join sends to all executors.
SENT = 2_000_000


def _looked_up(rows: DataFrame, table: DataFrame, key: str, count: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if count <= SENT else table, key, how)


def _join_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """:func:`join_constrained` for many small components at a time, which come one after the other; they don't meet."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = int(held["root"].searchsorted(held["root"].iloc[-1])) if len(held) else 0
        else:
            whole = 0 if held is None else len(held)
        if whole and (batch is None or whole >= JOINED // 4):
            yield join_constrained(held.iloc[:whole])
            held = held.iloc[whole:]


class _Parts(NamedTuple):
    """Components of edges: (frame, kp, root) of all nodes; (root, n, frames, head_frame, head_kp) of components; edges
    with their root; the edges of components that a conflict touches; and how their nodes were joined."""

    members: DataFrame
    components: DataFrame
    edges: DataFrame
    clashing: DataFrame
    joined: DataFrame


def _parts(edges: DataFrame) -> _Parts:
    """Joining never leaves an unconstrained component, so components are found first, distributed.

    Each task labels up to TOGETHER of its edges with their component among those, which is the whole component where
    edges of a track arrive together. Only nodes with several labels tie labels to each other, so what goes through
    :func:`connected_components` is the labels that are split between tasks. A component that no conflict touches (each
    frame once) is a track as it stands, and only the others are joined edge by edge: small ones many to a task, large
    ones by rounds.
    """
    keyed = edges.select("*", F.xxhash64("fa", "ka").alias("u"), F.xxhash64("fb", "kb").alias("v"))
    schema = T.StructType([*keyed.schema.fields, T.StructField("label", T.LongType()), T.StructField("names_u", T.BooleanType()), T.StructField("names_v", T.BooleanType())])
    keyed = saved(keyed.mapInArrow(_labelled, schema), "track-edges")
    ends = keyed.where("names_u").select(F.col("u").alias("node"), F.col("fa").alias("frame"), F.col("ka").alias("kp"), "label")
    ends = ends.unionAll(keyed.where("names_v").select("v", "fb", "kb", "label"))
    nodes = ends.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.first("frame").alias("frame"), F.first("kp").alias("kp"))
    nodes = saved(nodes, "track-nodes")
    split = nodes.where("label <> other").select("node", F.col("label").alias("least"))
    ties = _looked_up(ends.select("node", "label"), split, "node", split.count()).where("label <> least")
    roots = saved(connected_components(ties.select(F.col("label").alias("u"), F.col("least").alias("v")).distinct()).withColumnRenamed("node", "label"), "track-roots")
    ties_of = roots.count()
    rooted = lambda df: _looked_up(df, roots, "label", ties_of, "left").withColumn("root", F.coalesce("root", "label"))
    members = rooted(nodes.select("label", "frame", "kp")).select("frame", "kp", "root")
    by_frame = members.groupBy("root", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("kp").alias("kp"))
    components = by_frame.groupBy("root").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("frames"), F.min("frame").alias("head_frame"), F.min_by("kp", "frame").alias("head_kp"))
    components = saved(components, "track-components")
    touched = components.where("n <> frames").select("root")
    placed = rooted(keyed).select("root", *edges.columns)
    clashing = saved(_looked_up(placed, touched, "root", touched.count(), "left_semi"), "track-clashes")
    columns = ["root", "fa", "ka", "fb", "kb", "confidence", "is_loop"]
    large = clashing.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > JOINED).select("root")
    small = clashing.select(*columns).join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root")
    joined = small.mapInPandas(_join_parts, "frame long, kp long, head_frame long, head_kp long")
    if large.take(1):
        joined = joined.unionByName(join_by_rounds(clashing.select(*columns).join(large, "root", "left_semi").drop("root")))
    return _Parts(members, components, placed, clashing, saved(joined, "track-joined"))


def _counted(joined: DataFrame) -> DataFrame:
    return joined.groupBy("head_frame", "head_kp").agg(F.count(F.lit(1)).alias("views"))


def _views(parts: _Parts, minimum: int) -> DataFrame:
    clean = parts.components.where("n = frames").select("head_frame", "head_kp", F.col("n").alias("views"))
    return clean.unionAll(_counted(parts.joined)).where(F.col("views") >= minimum)


def track_views(edges: DataFrame, minimum_views: int = 3) -> DataFrame:
    """(head_frame, head_kp, views) of the tracks of :func:`build_tracks`, without their observations."""
    return _views(_parts(edges), minimum_views)


def build_tracks(edges: DataFrame, minimum_views: int = 3) -> DataFrame:
    """Observations (track, frame, kp) of tracks with enough views; a track is numbered by its least observation."""
    parts = _parts(edges)
    columns = ["head_frame", "head_kp", "frame", "kp", "views"]
    clean = parts.components.where("n = frames").withColumn("views", F.col("n")).where(F.col("views") >= minimum_views)
    long = _counted(parts.joined).where(F.col("views") >= minimum_views)
    return parts.members.join(clean, "root").select(*columns).unionAll(parts.joined.join(long, ["head_frame", "head_kp"]).select(*columns))


def rejected_edges(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """Edges whose ends came to lie in different tracks of ``joined``, the result of :func:`joined_tracks`: those that a conflict kept out."""
    ends = [joined.select(F.col("frame").alias(f), F.col("kp").alias(k), F.struct("head_frame", "head_kp").alias(h)) for f, k, h in (("fa", "ka", "ha"), ("fb", "kb", "hb"))]
    return edges.join(ends[0], ["fa", "ka"]).join(ends[1], ["fb", "kb"]).where("ha <> hb").drop("ha", "hb")


def conflicting_edges(edges: DataFrame) -> DataFrame:
    """What :func:`rejected_edges` gives for ``edges`` and their own joined tracks, looked for only where a conflict is."""
    parts = _parts(edges)
    return rejected_edges(parts.clashing.drop("root"), parts.joined).select(*edges.columns)


def joined_tracks(edges: DataFrame) -> DataFrame:
    """(frame, kp, head_frame, head_kp) of all keypoints that edges touch, before short tracks go."""
    parts = _parts(edges)
    clean = parts.members.join(parts.components.where("n = frames"), "root").select("frame", "kp", "head_frame", "head_kp")
    return clean.unionByName(parts.joined)


def summary(candidates: DataFrame, matches: DataFrame, verified: DataFrame, corroborated: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts of a match graph: pairs asked for as loops, verified and corroborated, edges, conflicts, tracks, components.

    ``candidates`` and ``corroborated`` are loop pairs, ``verified`` all verified pairs with their ``pair_kind``, and
    ``edges`` what tracks are built from, with ``is_loop``.
    """
    whole = _parts(edges)
    clean, long = whole.components.where("n = frames"), _counted(whole.joined).where("views >= 3")
    looped = saved(whole.edges.where("is_loop").select("root").distinct(), "summary-looped")
    asked = looped.count()
    # Without loop edges nothing changes in a component that holds none and that no conflict touches.
    same = _looked_up(clean.where("n >= 3"), looped, "root", asked, "left_anti")
    changed = saved(looped.union(whole.components.where("n <> frames").select("root")).distinct(), "summary-changed")
    temporal = _looked_up(whole.edges, changed, "root", changed.count(), "left_semi").where(~F.col("is_loop")).select(*edges.columns)
    temporal = _views(_parts(temporal), 3)
    looped_clean = _looked_up(clean.where("n >= 3"), looped, "root", asked, "left_semi")
    looped_joined = loop_links(whole.clashing, whole.joined.join(long, ["head_frame", "head_kp"], "left_semi"))
    heads = ["head_frame", "head_kp"]
    loops = looped_clean.select(*heads).unionAll(looped_joined.select(*heads).distinct())
    tracks = _views(whole, 3)
    found = same.select(*heads).unionAll(temporal.select(*heads))
    frames = connected_components(verified.select(F.col("source").alias("u"), F.col("target").alias("v")))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = [
        count(verified, "verified_pairs"), count(edges, "match_edges"), count(rejected_edges(whole.clashing, whole.joined), "conflicting_edges"), count(tracks, "tracks"), count(found, "temporal_tracks"),
        count(candidates, "loop_candidates"), count(verified.where("pair_kind = 'loop'"), "verified_loops"), count(corroborated, "corroborated_loops"), count(loops, "loop_tracks"),
        count(frames.select("root").distinct(), "components"), count(matches.select("source", "target").distinct(), "matched_pairs"),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(row)  # one row each
    return out


def loop_links(edges: DataFrame, tracks: DataFrame) -> DataFrame:
    """(head_frame, head_kp, source, target) of loop edges whose two ends lie in the same track."""
    a = tracks.select(F.col("frame").alias("fa"), F.col("kp").alias("ka"), "head_frame", "head_kp")
    b = tracks.select(F.col("frame").alias("fb"), F.col("kp").alias("kb"), F.col("head_frame").alias("hf"), F.col("head_kp").alias("hk"))
    both = edges.where("is_loop").join(a, ["fa", "ka"]).join(b, ["fb", "kb"]).where("head_frame = hf AND head_kp = hk")
    return both.select("head_frame", "head_kp", F.col("fa").alias("source"), F.col("fb").alias("target")).distinct()


def crossing_counts(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, crossing): tracks (first, last) with first < frame <= last, by steps of +1 and -1 summed along the frames."""
    steps = tracks.select(F.explode(F.array(F.struct((F.col("first") + 1).alias("frame"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("frame"), F.lit(-1).alias("d")))).alias("s"))
    change = steps.groupBy("s.frame").agg(F.sum("s.d").alias("d"))
    return frames.select("frame").join(change, "frame", "left").select("frame", F.sum(F.coalesce("d", F.lit(0))).over(W.orderBy("frame")).alias("crossing"))


def weak_boundaries(counts: DataFrame, minimum: int = 60) -> DataFrame:
    return counts.where((F.col("frame") > 0) & (F.col("crossing") < minimum))


def insertion_budget(frames: int, share: float = 0.25, most: int = 512) -> int:
    """How many frames a repair may insert in all: a share of the first ones, rounded up."""
    require(0 <= share <= 1 and most >= 0, "the share must lie in [0, 1]")
    return min(most, math.ceil(frames * share))


def repair_candidates(frames: DataFrame, counts: DataFrame, budget: int, minimum: int = 60) -> DataFrame:
    """Midpoints to insert, from ``frames(frame, candidate)``: weakest boundary first, each with its two neighbours.

    A gap counts once, at its first place in that order; the first ``budget`` distinct midpoints stay.
    """
    gaps = frames.withColumn("left", F.lag("candidate").over(W.orderBy("frame"))).select(F.col("frame").alias("right"), "left", "candidate")
    weak = weak_boundaries(counts, minimum).withColumn("place", F.row_number().over(W.orderBy("crossing", "frame")))
    asked = weak.select("place", F.posexplode(F.array(F.col("frame"), F.col("frame") - 1, F.col("frame") + 1)).alias("nth", "right"))
    mids = asked.join(gaps.where("left IS NOT NULL AND candidate - left > 1"), "right").select("place", "nth", F.floor((F.col("left") + F.col("candidate")) / 2).cast("long").alias("candidate"))
    first = mids.groupBy("candidate").agg(F.min(F.struct("place", "nth")).alias("at"))
    return first.withColumn("priority", F.row_number().over(W.orderBy("at"))).where(F.col("priority") <= budget).select("candidate", "priority")
