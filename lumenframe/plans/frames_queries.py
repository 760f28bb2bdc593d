"""Registered queries over frames and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import scan, windows
from ..registry import query
from ..sources.fixtures import table, v_frames, v_obs
from ..streaming.keyframes import quality_gate

START, DAY = 1704153600.0, 86400.0


@query("temporal_range_scan", f"SELECT candidate, ts_s FROM v_frames WHERE ts_s >= {START} AND ts_s < {START + 5 * DAY}")
def temporal_range_scan(spark, d):
    return scan.temporal_range(v_frames(spark, d), START, 5 * DAY).select("candidate", "ts_s")


@query(
    "uniform_temporal_sampling",
    f"""WITH r AS (SELECT candidate, ts_s, row_number() OVER (ORDER BY ts_s) - 1 AS rn FROM v_frames WHERE ts_s >= {START} AND ts_s < {START + 20 * DAY}),
    t AS (SELECT CAST(range AS BIGINT) AS n, {START} + range * {20 * DAY} / 700 AS target FROM range(700)),
    f AS (SELECT n, r.rn AS first FROM t ASOF JOIN r ON t.target <= r.ts_s),
    s AS (SELECT n, n + max(first - n) OVER (ORDER BY n) AS rn FROM f)
    SELECT CAST(s.n AS BIGINT) AS n, candidate, ts_s FROM s JOIN r USING (rn)""",
)
def uniform_temporal_sampling(spark, d):
    return scan.uniform_sampling(v_frames(spark, d), START, 20 * DAY, 700).select(F.col("n").cast("long").alias("n"), "candidate", "ts_s")


@query(
    "exact_frame_recovery",
    """WITH q AS (SELECT DISTINCT ticks + (feature_count % 2) AS ticks FROM v_frames WHERE (feature_count - 80) % 17 = 0)
    SELECT q.ticks, coalesce(f.candidate, -1) AS candidate, f.candidate IS NOT NULL AS found FROM q LEFT JOIN v_frames f USING (ticks)""",
)
def exact_frame_recovery(spark, d):
    frames = v_frames(spark, d)
    wanted = frames.where((F.col("feature_count") - 80) % 17 == 0).select((F.col("ticks") + F.col("feature_count") % 2).alias("ticks"))
    return scan.exact_frames(frames, wanted).select("ticks", F.coalesce("candidate", F.lit(-1)).alias("candidate"), "found")


@query(
    "keyframe_range_partition",
    """WITH r AS (SELECT ticks, event_type = 'signup' AS is_key, row_number() OVER (ORDER BY ticks) - 1 AS rn, count(*) OVER () AS n FROM v_frames),
    t AS (SELECT ticks AS target FROM r WHERE rn > 0 AND rn IN (n // 4, n * 2 // 4, n * 3 // 4)),
    b AS (SELECT ticks AS "begin" FROM r WHERE rn = 0 UNION SELECT (SELECT min(ticks) FROM r WHERE is_key AND ticks >= target) FROM t)
    SELECT CAST(row_number() OVER (ORDER BY "begin") - 1 AS BIGINT) AS section, "begin" FROM b WHERE "begin" IS NOT NULL""",
)
def keyframe_range_partition(spark, d):
    index = v_frames(spark, d).select("ticks", (F.col("event_type") == "signup").alias("is_key"))
    return scan.range_partition(index, 4).select(F.col("section").cast("long").alias("section"), "begin")


@query(
    "working_size",
    """SELECT l_partkey * 7 % 5000 + 100 AS width, l_orderkey * 3 % 3000 + 100 AS height,
    CAST(CASE WHEN greatest(l_partkey * 7 % 5000 + 100, l_orderkey * 3 % 3000 + 100) <= 1600 THEN l_partkey * 7 % 5000 + 100
      ELSE greatest(2, trunc((l_partkey * 7 % 5000 + 100) * (1600.0::DOUBLE / greatest(l_partkey * 7 % 5000 + 100, l_orderkey * 3 % 3000 + 100)))::BIGINT // 2 * 2) END AS BIGINT) AS working_width,
    CAST(CASE WHEN greatest(l_partkey * 7 % 5000 + 100, l_orderkey * 3 % 3000 + 100) <= 1600 THEN l_orderkey * 3 % 3000 + 100
      ELSE greatest(2, trunc((l_orderkey * 3 % 3000 + 100) * (1600.0::DOUBLE / greatest(l_partkey * 7 % 5000 + 100, l_orderkey * 3 % 3000 + 100)))::BIGINT // 2 * 2) END AS BIGINT) AS working_height FROM lineitem""",
)
def working_size(spark, d):
    sizes = table(spark, d, "lineitem").select((F.col("l_partkey") * 7 % 5000 + 100).alias("width"), (F.col("l_orderkey") * 3 % 3000 + 100).alias("height"))
    w, h = G.working_size(F.col("width"), F.col("height"), 1600)
    return sizes.select("width", "height", w.alias("working_width"), h.alias("working_height"))


@query("frame_quality_gate", "SELECT candidate, feature_count, sharpness FROM v_frames WHERE feature_count >= 120 AND sharpness >= 20")
def frame_quality_gate(spark, d):
    return quality_gate(v_frames(spark, d)).select("candidate", "feature_count", "sharpness")


@query(
    "recovery_groups",
    """WITH q AS (SELECT candidate, ts_s FROM v_frames WHERE (feature_count - 80) % 17 = 0),
    g AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER (ORDER BY ts_s) > 3000 OR lag(ts_s) OVER (ORDER BY ts_s) IS NULL THEN 1 ELSE 0 END AS new FROM q)
    SELECT candidate, ts_s, CAST(sum(new) OVER (ORDER BY ts_s) - 1 AS BIGINT) AS grp FROM g""",
)
def recovery_groups(spark, d):
    wanted = v_frames(spark, d).where((F.col("feature_count") - 80) % 17 == 0).select("candidate", "ts_s")
    return scan.gap_groups(wanted, "ts_s", 3000.0)


@query(
    "section_merge_validation",
    """WITH e AS (SELECT candidate, ticks, feature_count FROM v_frames), m AS (SELECT candidate, CASE WHEN candidate = 41 THEN ticks + 1 ELSE ticks END AS ticks, feature_count FROM v_frames WHERE candidate <> 77)
    SELECT coalesce(e.candidate, m.candidate) AS candidate, coalesce(e.ticks, -1) AS expected_ticks, coalesce(m.ticks, -1) AS merged_ticks FROM e FULL JOIN m ON e.candidate = m.candidate
    WHERE e.ticks IS DISTINCT FROM m.ticks OR e.feature_count IS DISTINCT FROM m.feature_count""",
)
def section_merge_validation(spark, d):
    frames = v_frames(spark, d)
    index = frames.select("ticks", "candidate", "feature_count", (F.col("event_type") == "signup").alias("is_key"))
    merged = scan.sections(index, scan.range_partition(index, 4)).where("candidate <> 77")
    merged = merged.withColumn("ticks", F.col("ticks") + (F.col("candidate") == 41).cast("long"))
    return scan.merge_mismatches(frames, merged, "candidate", ["ticks", "feature_count"]).select("candidate", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("expected_ticks", "merged_ticks")])


@query(
    "overlapping_windows",
    """SELECT CAST(w.range AS BIGINT) AS "window", CAST(f.range AS BIGINT) AS frame FROM (SELECT count(*) AS n FROM v_frames) c, range(0, 100000) w, range(0, 64) o, LATERAL (SELECT w.range * 32 + o.range AS range) f
    WHERE w.range <= greatest(0, (c.n - 64 + 31) // 32) AND f.range < c.n""",
)
def overlapping_windows(spark, d):
    return windows.overlapping_windows(spark, v_frames(spark, d).count())


@query(
    "recovery_subwindows",
    """WITH s AS (SELECT CAST(range + 7 AS BIGINT) AS "window" FROM range(60)), z AS (SELECT "window", greatest(8, ("window" + 1) // 2) AS size FROM s WHERE "window" > 8),
    y AS (SELECT *, size - greatest(6, size // 2) AS stride FROM z),
    x AS (SELECT DISTINCT "window", size, st FROM (SELECT "window", size, unnest(list_append(range(0, "window" - size + 1, stride), "window" - size)) AS st FROM y)),
    p AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY st) - 1 AS part FROM x)
    SELECT "window", CAST(part AS BIGINT) AS part, CAST(st + o.range AS BIGINT) AS frame FROM p, range(0, 64) o WHERE o.range < size""",
)
def recovery_subwindows(spark, d):
    """Windows of 7 to 66 frames, each named by its size."""
    whole = spark.range(60).select((F.col("id") + 7).alias("window")).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("window") - 1)))
    return windows.subwindows(whole)


@query(
    "sharpness_variance",
    "SELECT event_type, round(greatest(0, var_pop(sharpness)), 6) AS sharpness_variance, count(*) AS samples FROM v_frames GROUP BY ALL",
)
def sharpness_variance(spark, d):
    return v_frames(spark, d).groupBy("event_type").agg(F.round(F.greatest(F.lit(0.0), F.var_pop("sharpness")), 6).alias("sharpness_variance"), F.count(F.lit(1)).alias("samples"))


_WINDOWS = """w AS (SELECT CAST(wi.range AS BIGINT) AS "window", CAST(wi.range * 8 + o.range AS BIGINT) AS frame FROM range(0, 12) wi, range(0, 16) o WHERE wi.range * 8 + o.range < 100)"""


@query(
    "rank_windows",
    f"""WITH {_WINDOWS}, l AS (SELECT track FROM v_obs WHERE frame < 40 GROUP BY track HAVING count(*) >= 3),
    s AS (SELECT "window", count(*) FILTER (frame < 40) AS shared FROM w GROUP BY ALL),
    t AS (SELECT "window", track FROM w JOIN v_obs USING (frame) GROUP BY ALL HAVING count(*) >= 3),
    c AS (SELECT "window", count(*) AS tracks FROM t WHERE track IN (SELECT track FROM l) GROUP BY ALL)
    SELECT s."window", shared, coalesce(tracks, 0) AS tracks, CAST(row_number() OVER (ORDER BY shared DESC, coalesce(tracks, 0) DESC, s."window") AS INT) AS rank FROM s LEFT JOIN c USING ("window") WHERE shared > 0""",
)
def rank_windows(spark, d):
    obs = v_obs(spark, d)
    owned = spark.range(40).withColumnRenamed("id", "frame")
    landmarks = obs.where("frame < 40").groupBy("track").count().where("count >= 3")
    return windows.rank_windows(windows.overlapping_windows(spark, 100, 16, 8), obs, owned, landmarks)


@query(
    "recovery_frontier",
    f"""WITH {_WINDOWS}, s AS (SELECT "window", count(*) FILTER (frame < 40) AS owned, count(*) AS frames FROM w GROUP BY ALL)
    SELECT "window", owned, frames, CAST(row_number() OVER (ORDER BY owned DESC, "window") AS INT) AS place FROM s WHERE owned < frames AND owned > 0 AND frames > 8""",
)
def recovery_frontier(spark, d):
    return windows.frontier(windows.overlapping_windows(spark, 100, 16, 8), spark.range(40).withColumnRenamed("id", "frame"))


@query("frame_ownership", f"""WITH {_WINDOWS} SELECT frame, min("window") AS owner FROM w GROUP BY frame""")
def frame_ownership(spark, d):
    held = windows.overlapping_windows(spark, 100, 16, 8)
    accepted = held.select("window").distinct().withColumn("accept_seq", F.col("window"))
    return windows.ownership(held, accepted)


@query("missing_frames", f"""WITH {_WINDOWS} SELECT CAST(range AS BIGINT) AS frame FROM range(100) WHERE range NOT IN (SELECT frame FROM w WHERE "window" < 4)""")
def missing_frames(spark, d):
    held = windows.overlapping_windows(spark, 100, 16, 8)
    accepted = held.where("window < 4").select("window").distinct().withColumn("accept_seq", F.col("window"))
    return windows.missing_frames(spark, 100, windows.ownership(held, accepted))
