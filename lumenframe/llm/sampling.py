"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Classes that are learned at most, the most frequent ones.
CLASSES = 1000


def thinned(rows: DataFrame, id_col: str, class_col: str, most: int, classes: int = CLASSES) -> DataFrame:
    """About ``most`` rows in all at most, alike for each class, picked by a hash of the id.

    Rows of classes beyond the ``classes`` most frequent ones are not taken, so a model doesn't know them.
    """
    counts = {r[0]: r["n"] for r in rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(classes).collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, most // len(counts))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, each / n))).otherwise(share)
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(chance < share)
