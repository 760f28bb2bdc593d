"""Joins on a key that a large share of all rows may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No key keeps more than this part of the rows together, nor fewer rows than the second number.
PARTS, LEAST = 10_000, 256


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and says in ``weight`` how many rows hold it.

    The weights add up to ``total`` at most. Keys of more than total / PARTS rows are heavy: fewer than PARTS of them can
    exist, so their list may be broadcast. A heavy key is cut into pieces by a hash of the columns ``by`` of
    ``rows``, and its row of ``table`` is copied once for each piece. The column ``weight`` is dropped.
    """
    most = max(LEAST, -(-total // PARTS))
    pieces = F.ceil(F.col(weight) / most)
    heavy = table.where(F.col(weight) > most).select(*keys, pieces.alias("pieces"))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("piece", F.pmod(F.xxhash64(*by), F.coalesce("pieces", F.lit(1).cast("long")))).drop("pieces")
    copied = table.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(weight) > most, pieces).otherwise(1) - 1))).drop(weight)
    return dealt.join(copied, [*keys, "piece"], how).drop("piece")
