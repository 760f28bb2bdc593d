"""Character spans of regular-expression matches as native expressions.

Spark's regexp functions give matches but no positions. Matches and the gaps that ``split`` leaves between
them alternate, so a match starts where the lengths of all earlier gaps and matches end. Prefix sums run in
blocks, which keeps a text with many matches near linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
#: Characters that every match has at least, where context is asked for.
LEAST = 5
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,near:string>>"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def match_spans(text: Column, pattern: str, kind: str, rank: int, guard: Column, group: int = 0, window: int = 0) -> Column:
    """Array of (start, rank, end, kind, value, near) for the leftmost non-overlapping matches; null where ``guard`` fails.

    Offsets are code points, end exclusive; ``value`` is the text of ``group``, ``near`` the match with the text around
    it, up to ``window`` characters on both sides, neighbouring matches included.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    bound = F.array(F.struct(found.alias("m"), values.alias("v"), gaps.alias("t"), F.transform(gaps, lambda g: F.length(g)).alias("g")))

    def around(b: Column) -> Column:
        if not window:
            return F.transform(b["m"], lambda m: F.lit(None).cast("string"))
        # Matches and gaps alternate, each cut to its ends; every match has LEAST characters, so a few pieces cover the window.
        cut = lambda x: F.when(F.length(x) > 2 * window, F.concat(F.substring(x, 1, window), F.substring(x, -window, window))).otherwise(x)
        pieces = F.array_append(F.flatten(F.transform(b["m"], lambda m, i: F.array(cut(F.get(b["t"], i)), cut(m)))), cut(F.element_at(b["t"], -1)))
        reach = 2 * (window // LEAST + 1) + 1

        def side(p: Column, i: Column) -> Column:
            left = F.array_join(F.slice(p, F.greatest(F.lit(1), 2 * i + 2 - reach), F.least(F.lit(reach), 2 * i + 1)), "")
            return F.concat(F.substring(left, -window, window), F.get(b["m"], i), F.substring(F.array_join(F.slice(p, 2 * i + 3, F.lit(reach)), ""), 1, window))

        return F.flatten(F.transform(F.array(pieces), lambda p: F.transform(b["m"], lambda m, i: side(p, i))))

    out = F.flatten(
        F.transform(
            F.transform(
                F.transform(
                    bound,
                    lambda b: F.struct(
                        F.transform(b["m"], lambda m: F.length(m)).alias("n"),
                        F.transform(b["m"], lambda m, i: F.get(b["g"], i) + F.length(m)).alias("step"),
                        b["v"].alias("v"),
                        around(b).alias("near"),
                    ),
                ),
                lambda b: F.struct(
                    b["n"].alias("n"),
                    b["step"].alias("step"),
                    b["v"].alias("v"),
                    b["near"].alias("near"),
                    F.transform(F.sequence(F.lit(0), F.floor(F.size(b["n"]) / BLOCK).cast("int")), lambda k: _sum(F.slice(b["step"], k * BLOCK + 1, BLOCK))).alias("sums"),
                ),
            ),
            lambda b: F.transform(
                b["v"],
                lambda v, i: F.struct(
                    (
                        _sum(F.slice(b["sums"], F.lit(1), F.floor(i / BLOCK).cast("int")))
                        + _sum(F.slice(b["step"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
                        - F.get(b["n"], i)
                    ).alias("start"),
                    F.lit(rank).alias("rank"),
                    (
                        _sum(F.slice(b["sums"], F.lit(1), F.floor(i / BLOCK).cast("int")))
                        + _sum(F.slice(b["step"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))
                    ).alias("end"),
                    F.lit(kind).alias("kind"),
                    v.alias("value"),
                    F.get(b["near"], i).alias("near"),
                ),
            ),
        )
    )
    return F.when(guard & F.regexp_like(text, F.lit(pattern)), out).otherwise(F.lit(None)).cast(SPAN)


def or_empty(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; the array must be sorted."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
