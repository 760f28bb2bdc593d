"""Place retrieval: normalised descriptors, top-k with exclusion and spacing, corroboration."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import require
from ..plans.ordered import bare, ordered, ranked


def normalize(descriptors: DataFrame, emb: str = "emb") -> DataFrame:
    """Unit vectors as ``unit``; ``ok`` is false for null, empty, zero or non-finite descriptors, whose unit is null."""
    v = F.transform(emb, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    ok = F.coalesce((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.lit(False))
    return descriptors.withColumn("norm", norm).withColumn("ok", ok).withColumn("unit", F.when(ok, F.transform(v, lambda x: x / norm)))


def diversified(ranked: Column, spacing: float, k: int) -> Column:
    """Walk a ranked array of (neg_score, frame, ts_s): keep one unless within ``spacing`` of one kept, up to ``k``."""
    return F.aggregate(
        ranked,
        F.slice(ranked, 1, 0),
        lambda kept, x: F.when((F.size(kept) < k) & ~F.exists(kept, lambda y: F.abs(y["ts_s"] - x["ts_s"]) < spacing), F.concat(kept, F.array(x))).otherwise(kept),
    )


def _possible(times: np.ndarray, spacing: float, k: int) -> int:
    """How many of a block's ranked targets the walk over all blocks could take.

    It takes a target only if each better one is taken or within the spacing of one taken, of which there are
    k - 1 at most. So the better ones of the block must fit into k - 1 spans shorter than twice the spacing.
    """
    held: list[float] = []
    for n, t in enumerate(times):
        spans, end = 0, -np.inf
        for x in held:
            if x >= end:
                spans, end = spans + 1, x + 2 * spacing
        if spans > k - 1:
            return n
        bisect.insort(held, float(t))
    return len(times)


#: Targets of a block that are looked at first by a rough score, and how far that may be from the exact one (of unit vectors).
LOOKED_AT, ROUGH = 24, 1e-9


def loop_candidates(descriptors: DataFrame, neighbors: int = 4, *, each: int = 3, apart_frames: int = 32, apart_seconds: float = 10.0, spacing: float = 5.0, block: int = 512) -> DataFrame:
    """Pairs (source, target, score): each frame's best far frames by cosine, walked for spacing.

    A far frame is more than ``apart_frames`` (and ``neighbors``) frames and at least ``apart_seconds`` away; ``each`` are
    taken for a frame, ``spacing`` seconds apart from each other.

    Blocks of queries meet blocks of targets in matrix products, which choose whose scores are worked out exactly. Of a block, only targets that the whole walk could
    take are passed on (see :func:`_possible`), some for each query and block; the walk over those is the whole walk.
    """
    require(each >= 1 and apart_frames >= 0 and apart_seconds >= 0 and spacing > 0, "distances must not be negative, spacing and number positive")
    unit = normalize(descriptors).where("ok").select("frame", "ts_s", "unit")
    # Blocks are runs of so many frames in time, so none is larger, and what excludes a target is mostly in its own block.
    dealt = ordered(unit, "ts_s", "frame")
    blocks = max(1, -(-dealt.count() // block))
    dealt = bare(ranked(dealt)).withColumn("b", F.floor(F.col("rank") / block).cast("int")).drop("rank")
    # A block is three flat arrays, which come to Python without an object for each number.
    packed = dealt.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("frame", "ts_s", "unit"))).alias("rows"))
    packed = packed.select("b", F.col("rows.frame").alias("f"), F.col("rows.ts_s").alias("s"), F.flatten("rows.unit").alias("u"))
    left, right = (packed.select(*[F.col(c).alias(f"{side}{c}") for c in "bfsu"]) for side in "qt")
    grid = left.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "tb").select(*[f"{side}{c}" for side in "qt" for c in "fsu"])
    gap = max(neighbors, apart_frames)

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(b))
        for d in range(b.shape[1]):  # one fixed order of terms, so a score doesn't depend on the blocks
            total += a[..., d] * b[:, d]
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fq, sq, uq, ft, st, ut in batch.itertuples(index=False):
                a, b = np.reshape(uq, (len(fq), -1)), np.reshape(ut, (len(ft), -1))
                rough = a @ b.T
                far = (np.abs(fq[:, None] - ft) > gap) & (np.abs(sq[:, None] - st) >= apart_seconds) & np.isfinite(rough)
                rough[~far] = -np.inf
                few = min(LOOKED_AT, len(ft))
                bar = np.partition(rough, len(ft) - few, axis=1)[:, len(ft) - few]
                i, j = np.nonzero(far & (rough >= bar[:, None] - 2 * ROUGH))
                score = exact(a[i], b[j])
                order = np.lexsort((ft[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                ends = np.searchsorted(i, np.arange(len(fq) + 1))
                rows, columns, scores = [], [], []
                for k in range(len(fq)):
                    at, value = j[ends[k] : ends[k + 1]], score[ends[k] : ends[k + 1]]
                    sure = int((value >= bar[k] - ROUGH).sum())  # better than all that were not looked at
                    n = _possible(st[at[:sure]], spacing, each)
                    if n == sure and sure < far[k].sum():
                        at = np.flatnonzero(far[k])
                        value = exact(a[k], b[at])
                        order = np.lexsort((ft[at], -value))
                        at, value = at[order], value[order]
                        n = _possible(st[at], spacing, each)
                    rows.append(np.full(n, fq[k]))
                    columns.append(at[:n])
                    scores.append(value[:n])
                at = np.concatenate(columns)
                yield pd.DataFrame({"query": np.concatenate(rows), "frame": ft[at], "ts_s": st[at], "score": np.concatenate(scores)})

    best = grid.mapInPandas(run, "query long, frame long, ts_s double, score double")
    walks = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg_score"), "frame", "ts_s"))).alias("ranked"))
    chosen = walks.select("query", F.explode(diversified(F.col("ranked"), spacing, each)).alias("c"))
    pairs = chosen.select(F.least("query", "c.frame").alias("source"), F.greatest("query", "c.frame").alias("target"), "query", (-F.col("c.neg_score")).alias("score"))
    return pairs.groupBy("source", "target").agg(F.max_by("score", "query").alias("score"))


def corroborated(pairs: DataFrame, reach: int = 2) -> DataFrame:
    """Pairs with another pair offset by 1 to ``reach`` on both sides. Offsets are spread, so it is a semi-join on equal keys."""
    offsets = F.array(*[F.lit(o) for o in range(-reach, reach + 1) if o])
    near = pairs.withColumn("da", F.explode(offsets)).withColumn("db", F.explode(offsets))
    near = near.select((F.col("source") - F.col("da")).alias("source"), (F.col("target") - F.col("db")).alias("target")).distinct()
    return pairs.join(near, ["source", "target"], "left_semi")
