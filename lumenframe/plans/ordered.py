"""Ranks, neighbours and running values along one order of a whole table, without one task that sees all of it.

Rows are dealt into ranges of the order and sorted inside them; what crosses the ranges is one short row for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import saved

#: Added columns: the range a row lies in and its place there, from 0.
PART, PLACE = "order_part", "order_place"
_BITS = 33  # of a row's number within its partition


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with the columns PART and PLACE, from a scratch table sorted by ``order`` in ranges."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    rows = saved(rows, "ordered")
    return rows.withColumn(PART, F.shiftright(PLACE, _BITS)).withColumn(PLACE, F.col(PLACE).bitwiseAND(F.lit((1 << _BITS) - 1)))


def _carried(rows: DataFrame, made: Column, combine: Column, back: bool) -> DataFrame:
    """(PART, carry): ``made`` of each range, combined over the ranges before it (after it, if ``back``). One row a range."""
    parts = rows.groupBy(PART).agg(made.alias("made"))
    order = W.orderBy(F.col(PART).desc() if back else F.col(PART)).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(PART, combine.over(order).alias("carry"))


def ranked(rows: DataFrame, name: str = "rank") -> DataFrame:
    """Append a row's rank in the whole order, from 0."""
    carried = _carried(rows, F.count(F.lit(1)), F.sum("made"), False)
    return rows.join(F.broadcast(carried), PART).withColumn(name, F.col(PLACE) + F.coalesce("carry", F.lit(0))).drop("carry")


_COMBINE: dict[Callable, Callable[[Column, Column], Column]] = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.min: F.least}


def running(rows: DataFrame, value: Column, how: Callable, name: str, *, back: bool = False) -> DataFrame:
    """Append ``how`` (F.sum, F.max or F.min) of ``value`` over the rows up to this one, or from this one on if ``back``."""
    rows = rows.withColumn("running_value", value)
    inner = W.partitionBy(PART).orderBy(F.col(PLACE).desc() if back else F.col(PLACE)).rowsBetween(W.unboundedPreceding, 0)
    carried = _carried(rows, how("running_value"), how("made"), back)
    rows = rows.withColumn("running_inner", how("running_value").over(inner)).join(F.broadcast(carried), PART)
    return rows.withColumn(name, _COMBINE[how](F.col("running_inner"), F.col("carry"))).drop("running_value", "running_inner", "carry")


def previous(rows: DataFrame, value: Column, name: str, back: int = 1) -> DataFrame:
    """Append ``value`` of the row ``back`` places before, null at the start."""
    rows = ranked(rows.withColumn("previous_value", value), "previous_rank")
    # The last rows of a range are looked at from the next; short ranges may need several, so ranks decide.
    ends = rows.groupBy(PART).agg(F.max("previous_rank").alias("end"))
    tail = rows.join(F.broadcast(ends), PART).where(F.col("previous_rank") > F.col("end") - back).select("previous_rank", "previous_value")
    inner = W.partitionBy(PART).orderBy(PLACE)
    rows = rows.withColumn("inner_value", F.lag(F.struct("previous_value"), back).over(inner))
    tail = tail.select((F.col("previous_rank") + back).alias("previous_rank"), F.col("previous_value").alias("tail_value"))  # ``back`` rows a range
    rows = rows.join(F.broadcast(tail), "previous_rank", "left")
    return rows.withColumn(name, F.when(F.col("inner_value").isNotNull(), F.col("inner_value.previous_value")).otherwise(F.col("tail_value"))).drop("previous_rank", "previous_value", "inner_value", "tail_value")


def percentiles(rows: DataFrame, asked: dict[str, Column], share: float) -> DataFrame:
    """One row with the exact ``share`` quantile of each column, between two values as :func:`F.percentile` gives it.

    F.percentile holds all distinct values in one task. Here they are counted, ordered in ranges, and the one or two at
    the place are picked. Nulls don't count; of no values the quantile is null.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), value.cast("double").alias("value")) for i, value in enumerate(asked.values())]))
    counts = rows.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("of", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = running(ordered(counts, "of", "value"), F.col("n"), F.sum, "upto")
    sizes = counts.groupBy("of").agg(F.sum("n").alias("all"), F.max("upto").alias("end"))  # one row a column
    at = (F.col("all") - 1) * F.lit(share)
    sizes = sizes.select("of", (F.col("end") - F.col("all")).alias("begin"), at.alias("at"), F.floor(at).alias("low"), F.ceil(at).alias("high"))
    held = counts.join(F.broadcast(sizes), "of").withColumns({"last": F.col("upto") - F.col("begin"), "first": F.col("upto") - F.col("begin") - F.col("n")})
    held = held.where("first <= high AND last > low").groupBy("of", "at", "low", "high").agg(*[F.max(F.when((F.col("first") <= F.col(c)) & (F.col("last") > F.col(c)), F.col("value"))).alias(f"{c}_value") for c in ("low", "high")])
    between = (F.col("high") - F.col("at")) * F.col("low_value") + (F.col("at") - F.col("low")) * F.col("high_value")
    held = held.select("of", F.when(F.col("low_value") == F.col("high_value"), F.col("low_value")).otherwise(between).alias("value"))
    return held.agg(*[F.max(F.when(F.col("of") == i, F.col("value"))).alias(name) for i, name in enumerate(asked)])


def bare(rows: DataFrame) -> DataFrame:
    return rows.drop(PART, PLACE)
