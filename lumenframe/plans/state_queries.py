"""Registered queries of ordered and stateful operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holdouts
from ..registry import query
from ..sources.fixtures import table, v_frames, v_obs
from ..streaming.keyframes import Thresholds, select_keyframes

OPTIONS = Thresholds(minimum_features=95)


def fixture_quality(video: int, anchor: int, current: int) -> tuple[int, float, float, float]:
    """Match quality as a fixed function of the two frames."""
    step = current - anchor
    inliers = max(0, 160 - 6 * step + current * 37 % 23 - anchor * 13 % 7)
    return inliers, inliers / (inliers + 40), 1.0 - step * 0.02, step * 0.004


_Q = "greatest(0, 160 - 6 * (c - {a}) + c * 37 % 23 - {a} * 13 % 7)"
_REL = "({q} >= 60 AND {q} / ({q} + 40) >= 0.4 AND 1.0 - (c - {a}) * 0.02 >= 0.25)"


def _time(c: str) -> str:
    return f"({c} * 0.15::DOUBLE + ({c} // 130) * 1.9::DOUBLE)"


@query(
    "keyframe_decisions",
    f"""WITH RECURSIVE fr AS (SELECT candidate // 500 AS video, candidate AS c, feature_count >= 95 AND sharpness >= 20 AS usable, row_number() OVER (PARTITION BY candidate // 500 ORDER BY candidate) AS i FROM v_frames),
    st AS (SELECT video, 0::BIGINT AS i, -1::BIGINT AS anchor, -1::BIGINT AS good, 0::BIGINT AS best, NULL::BIGINT AS c, NULL::VARCHAR AS decision, NULL::BIGINT AS reference, NULL::BIGINT AS inliers, NULL::BIGINT AS bridge, false AS broken FROM (SELECT DISTINCT video FROM fr)
    UNION ALL
    SELECT video, i, CASE WHEN NOT usable THEN anchor WHEN anchor < 0 OR acc THEN c ELSE a2 END, g2, CASE WHEN NOT usable THEN best WHEN anchor < 0 OR acc THEN 0 ELSE b2 END, c,
      CASE WHEN g2 >= 0 AND {_time('c')} - {_time('g2')} > 2 THEN 'tracking_break' WHEN NOT usable THEN 'reject_quality' WHEN anchor < 0 THEN 'first_usable' WHEN NOT rel THEN 'unreliable_matches' WHEN NOT acc THEN 'redundant' WHEN q2 < 0.65 * b2 THEN 'overlap_drop' ELSE 'image_motion' END,
      CASE WHEN usable AND anchor >= 0 THEN a2 END, CASE WHEN usable AND anchor >= 0 THEN q2 END, CASE WHEN usable AND anchor >= 0 AND bridged THEN a2 END, g2 >= 0 AND {_time('c')} - {_time('g2')} > 2
    FROM (SELECT *, CASE WHEN usable AND (anchor < 0 OR rel) THEN c ELSE good END AS g2, rel AND {_time('c')} - {_time('a2')} >= 0.2 AND (q2 < 0.65 * b2 OR (c - a2) * 0.004 >= 0.035) AS acc
    FROM (SELECT *, CASE WHEN rel THEN greatest(b1, q2) ELSE b1 END AS b2
    FROM (SELECT *, {_REL.format(q='q2', a='a2')} AS rel
    FROM (SELECT *, {_Q.format(a='a2')} AS q2
    FROM (SELECT *, CASE WHEN bridged THEN good ELSE anchor END AS a2, CASE WHEN bridged THEN 0 ELSE best END AS b1
    FROM (SELECT *, NOT {_REL.format(q='q1', a='anchor')} AND good > anchor AS bridged
    FROM (SELECT *, {_Q.format(a='anchor')} AS q1 FROM (SELECT st.video, fr.i, st.anchor, st.good, st.best, fr.c, fr.usable FROM st JOIN fr ON fr.video = st.video AND fr.i = st.i + 1 WHERE NOT st.broken))))))))
    ) SELECT video, c AS candidate, decision, coalesce(reference, -1) AS reference, coalesce(inliers, -1) AS inliers, coalesce(bridge, -1) AS bridge FROM st WHERE i > 0""",
)
def keyframe_decisions(spark, d):
    c = F.col("candidate")
    frames = v_frames(spark, d).select(
        F.floor(c / 500).alias("video"), "candidate", (c * F.lit(0.15) + F.floor(c / 130) * F.lit(1.9)).alias("ts_s"), "feature_count", "sharpness"
    )
    return select_keyframes(frames, fixture_quality, OPTIONS).select(
        "video", "candidate", "decision", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("reference", "inliers", "bridge")]
    )


@query(
    "holdout_split",
    """WITH t AS (SELECT p_partkey AS track, p_partkey::UHUGEINT AS v FROM part), a AS (SELECT track, (xor(v, v >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM t),
    b AS (SELECT track, (xor(v, v >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM a) SELECT track, xor(v, v >> 31) % 5 = 0 AS held_out FROM b""",
)
def holdout_split(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("track")).withColumn("held_out", holdouts.is_held_out(F.col("track")))


@query("holdout_selection")
def holdout_selection(spark, d):
    obs = v_obs(spark, d)
    boundary = F.floor(F.col("frame") / 20).alias("boundary")
    long = obs.groupBy("track").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("track")
    support = obs.groupBy(boundary, "frame").agg(F.count(F.lit(1)).alias("observations"))
    return holdouts.choose_holdouts(obs.join(long, "track", "left_semi").select(boundary, "track", "frame"), support)
