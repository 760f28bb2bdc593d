"""Embedding near-dedup by a pivot-permutation index.

Each vector is described by its nearest of PIVOTS reference points. Inverted lists are kept per pair of those
pivots, so vectors that share at least SHARED of them meet; what meets is verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components as components
from ..plans.spread import spread_join
from .base import lean, saved

PIVOTS, SHARED = 256, 2
#: Pivots are picked from this many vectors, the first by hash, and lie this many link distances apart at least.
SAMPLE, SPACING = 4096, 1.5
#: Nearest pivots that describe a vector, by the largest share that the link distance has of the usual distance.
NEAREST = ((0.17, 5), (0.4, 6), (np.inf, 8))
THRESHOLD = 0.98
#: Rows of an inverted list compared at once; longer lists are compared block by block, in tasks of their own.
BLOCK = 256


def choose_pivots(nodes: DataFrame, width: int, threshold: float) -> tuple[np.ndarray, int]:
    """Reference points spread over a bounded sample of ``nodes(node, vector)``, and how many nearest ones describe a vector.

    Each point is the one farthest from those before, down to SPACING times the distance at which vectors link. So
    vectors that share a direction get as many points as others. The closer all vectors lie together, measured in
    that distance, the less a link stands out and the more points describe a vector.
    """
    sample = _unit([r["vector"] for r in nodes.orderBy("node").limit(SAMPLE).select("vector").collect()], width)
    if not len(sample):
        return sample, 0
    link = max(1e-6, np.sqrt(2 - 2 * min(threshold, 1.0)))
    apart = lambda x: np.sqrt(np.maximum(0, 2 - 2 * (sample @ x)))
    picked, far = [0], apart(sample[0])
    ordinary = float(np.median(far[far > 0])) if (far > 0).any() else 0.0
    while len(picked) < PIVOTS and far.max() >= SPACING * link:
        picked.append(int(far.argmax()))
        far = np.minimum(far, apart(sample[picked[-1]]))
    nearest = next(n for within, n in NEAREST if link <= within * ordinary or within == np.inf)
    return sample[picked], min(nearest, len(picked))


def _unit(vectors: list, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if len(x):  # so that squares of very small or large components neither vanish nor overflow
        x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _described(nodes: DataFrame, pivots: np.ndarray, nearest: int, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosines = _unit(batch["vector"].tolist(), width) @ pivots.T
                top = np.sort(np.argsort(-cosines, axis=1, kind="stable")[:, :nearest], axis=1).astype(np.int32)
                yield pd.DataFrame({"node": batch["node"], "top": list(top)})

    return nodes.select("node", "vector").mapInPandas(run, "node long, top array<int>")


def _compare(one: pd.DataFrame, width: int, threshold: float) -> pd.DataFrame | None:
    """Links of one block pair that no earlier list holds: per node its links, weighted by copies, and a local root."""
    first, i, j = (int(one[c].iloc[0]) for c in ("p", "i", "j"))
    second = int(one["q"].iloc[0])
    vectors, tops = _unit(one["vector"].tolist(), width), np.stack(one["top"].to_numpy())
    block = one["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    # The list of the two smallest shared pivots speaks for a pair.
    common = (tops[a][:, :, None] == tops[b][:, None, :]).any(axis=2)
    rank = np.cumsum(common, axis=1)
    ours = (common & (rank == 1) & (tops[a] == first)).any(axis=1)
    if second >= 0:
        ours &= (common & (rank == 2) & (tops[a] == second)).any(axis=1)
    a, b = a[ours], b[ours]
    if not len(a):
        return None
    copies, node = one["copies"].to_numpy(), one["node"].to_numpy()
    n = np.zeros(len(one), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    root = node.copy()
    while True:
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == was).all():
            break
    kept = np.flatnonzero(n)
    return pd.DataFrame({"node": node[kept], "n": n[kept], "root": root[kept]})


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable over links), kept.

    Vectors of equal, non-null label link at a cosine of at least ``threshold``. Null, empty and zero vectors and
    those with null or non-finite components link with nothing, and neither do vectors of different length. Equal
    vectors of a label are one node with a number of copies, so each of g equal rows has g - 1 links from them;
    rows repeating an id count each. Only the id returns, so other columns can't clash. An empty table gives no rows.

    Every row is indexed. The sample bounds pivots only.
    """
    lean(df.sparkSession)
    vector = F.transform(df[vector_col], lambda x: x.cast("double"))
    sound = F.size(vector) > 0
    sound = sound & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(
        df[id_col].alias("id"),
        F.when(sound & df[label_col].isNotNull(), F.xxhash64(df[label_col].cast("string"), vector)).alias("node"),
        df[label_col].cast("string").alias("label"),
        df[vector_col].cast("array<double>").alias("vector"),
    )
    nodes = rows.where("node IS NOT NULL").groupBy("node", "label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    nodes = saved(nodes, "vectors")
    width, count = nodes.agg(F.max(F.size("vector")), F.sum("copies")).first()
    width, count = width or 1, count or 0
    pivots, nearest = choose_pivots(nodes, width, threshold)
    described = saved(nodes.join(_described(nodes, pivots, nearest, width), "node"), "described")

    if len(pivots) > 1:
        chosen = F.array(*[F.struct(F.col("top")[x].alias("p"), F.col("top")[y].alias("q")) for x, y in combinations(range(nearest), 2)])
    else:
        chosen = F.array(F.struct(F.lit(0).alias("p"), F.lit(-1).alias("q")))
    keys = described.select("node", F.struct("label", F.size("vector").alias("width")).alias("within"), F.explode(chosen).alias("k")).select("node", "within", "k.p", "k.q")
    long = keys.groupBy("within", "p", "q").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    long = long.select("within", "p", "q", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    listed = keys.join(long, ["within", "p", "q"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = listed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    listed = listed.join(described.select("node", "vector", "top", "copies"), "node")
    by = ["within", "p", "q", "i", "j"]
    dealt = listed.select(F.xxhash64(*by).alias("task"), "p", "q", "i", "j", "block", "node", "copies", "vector", "top")
    dealt = dealt.repartition("task").sortWithinPartitions("task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last task of a batch may go on in the next
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            task = batch["task"].to_numpy()
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            starts = [0, *cuts.tolist()]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1 and (made := _compare(batch.iloc[s:e], width, threshold)) is not None:
                    yield made
            held = batch.iloc[done:]
        if held is not None and len(held) > 1 and (made := _compare(held, width, threshold)) is not None:
            yield made

    found = saved(dealt.mapInPandas(run, "node long, n long, root long"), "vector-links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    told = described.select("node", "copies", "rep").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(roots, "node", "left")
    told = told.withColumn("root", F.coalesce("root", "node"))
    label = told.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("in_root"))
    told = spread_join(told.where("copies > 1 OR n IS NOT NULL"), label, ["root"], "in_root", count, ["node"])
    told = told.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies")
    out = spread_join(rows.select("id", "node"), saved(told, "vectors-told"), ["node"], "copies", count, ["id"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
