"""Hold-out choice for validation: a stable split, and a balanced greedy choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(track: pd.Series) -> pd.Series:
    """A fixed fifth of track ids, by a 64-bit mix (its multipliers are fixed values)."""
    v = track.to_numpy(np.int64).view(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series((v ^ (v >> np.uint64(31))) % np.uint64(5) == 0)


def is_held_out(track: Column) -> Column:
    return F.pandas_udf(held_out, "boolean")(track)


def choose_holdouts(candidates: DataFrame, support: DataFrame, minimum_support: int = 10) -> DataFrame:
    """(boundary, track, frame): each track gives up one shared frame, the one with fewest hold-outs so far.

    ``candidates(boundary, track, frame)`` are shared frames of tracks with at least four observations, and
    ``support(boundary, frame, observations)`` counts all observations. A frame keeps more than
    ``minimum_support``. Tracks go in order, as each choice changes the counts; a boundary is one window's overlap.
    """
    rows = candidates.join(support, ["boundary", "frame"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = dict(zip(pdf["frame"], pdf["observations"], strict=True))
        taken = dict.fromkeys(left, 0)
        out = []
        for track, frames in pdf.sort_values(["track", "frame"]).groupby("track", sort=True)["frame"]:
            open_ = [f for f in frames if left[f] > minimum_support]
            if open_:
                pick = min(open_, key=lambda f: (taken[f], f))
                left[pick] -= 1
                taken[pick] += 1
                out.append((pdf["boundary"].iloc[0], track, pick))
        return pd.DataFrame(out, columns=["boundary", "track", "frame"])

    return rows.groupBy("boundary").applyInPandas(choose, "boundary long, track long, frame long")
