"""Registered queries over descriptors, pairs, matches and tracks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, matching, retrieval
from ..registry import query
from ..sources.cache import misses
from ..sources.fixtures import table, v_desc, v_match, v_obs
from .scratch import saved

W_, H_ = 110000.0, 51.0
_UNIT = "d AS (SELECT frame, ts_s, list_transform(emb, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(emb, lambda y: y::DOUBLE * y::DOUBLE)))) AS unit FROM v_desc)"


@query(
    "descriptor_normalize",
    "SELECT frame, round(sqrt(list_sum(list_transform(emb, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, sqrt(list_sum(list_transform(emb, lambda x: x::DOUBLE * x::DOUBLE))) > 0 AS ok, abs(sqrt(list_sum(list_transform(emb, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 1e-4 AS was_unit FROM v_desc",
)
def descriptor_normalize(spark, d):
    return retrieval.normalize(v_desc(spark, d)).select("frame", F.round("norm", 6).alias("norm"), "ok", (F.abs(F.col("norm") - 1) < 1e-4).alias("was_unit"))


#: Greedy spacing over the ranked targets of each query, one chosen target a step.
_LOOPS = f"""{_UNIT},
    s AS (SELECT a.frame AS query, b.frame AS target, b.ts_s, list_dot_product(a.unit, b.unit) AS score FROM d a JOIN d b ON abs(a.frame - b.frame) > 32 AND abs(a.ts_s - b.ts_s) >= 10),
    one AS (SELECT query, arg_min(struct_pack(target := target, ts_s := ts_s, score := score), struct_pack(a := -score, b := target)) AS x FROM s GROUP BY query),
    two AS (SELECT s.query, arg_min(struct_pack(target := target, ts_s := s.ts_s, score := score), struct_pack(a := -score, b := target)) AS x FROM s JOIN one ON s.query = one.query AND abs(s.ts_s - one.x.ts_s) >= 5 GROUP BY s.query),
    three AS (SELECT s.query, arg_min(struct_pack(target := target, ts_s := s.ts_s, score := score), struct_pack(a := -score, b := target)) AS x FROM s JOIN one ON s.query = one.query AND abs(s.ts_s - one.x.ts_s) >= 5 JOIN two ON s.query = two.query AND abs(s.ts_s - two.x.ts_s) >= 5 GROUP BY s.query),
    c AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
    loops AS (SELECT least(query, x.target) AS source, greatest(query, x.target) AS target, round(arg_max(x.score, query), 6) AS score FROM c GROUP BY ALL)"""


@query("loop_retrieval", f"WITH {_LOOPS} SELECT source, target, score FROM loops")
def loop_retrieval(spark, d):
    return retrieval.loop_candidates(v_desc(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "loop_corroboration",
    f"WITH {_LOOPS} SELECT a.source, a.target FROM loops a WHERE EXISTS (SELECT 1 FROM loops b WHERE abs(a.source - b.source) IN (1, 2) AND abs(a.target - b.target) IN (1, 2))",
)
def loop_corroboration(spark, d):
    return retrieval.corroborated(retrieval.loop_candidates(v_desc(spark, d)).select("source", "target"))


@query(
    "usable_keypoints",
    f"SELECT frame, count(*) AS keypoints, count(*) FILTER (u >= 4 AND v >= 4 AND u < {W_} - 4 AND v < {H_} - 4 AND v / 50 >= 0.2) AS usable FROM v_obs GROUP BY frame",
)
def usable_keypoints(spark, d):
    ok = matching.usable_keypoint(F.col("u"), F.col("v"), F.col("v") / 50, W_, H_, 0.2)
    return v_obs(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("keypoints"), F.count_if(ok).alias("usable"))


@query(
    "compact_matches",
    f"""SELECT m.source, m.target, m.source_feature AS i, m.target_feature AS j, m.au AS ax, m.bu AS bx FROM v_match m
    WHERE confidence >= 0.1 AND au >= 4 AND av >= 4 AND au < {W_} - 4 AND av < {H_} - 4 AND bu >= 4 AND bv >= 4 AND bu < {W_} - 4 AND bv < {H_} - 4""",
)
def compact_matches(spark, d):
    raw = v_match(spark, d).select("source", "target", F.col("source_feature").alias("i"), F.col("target_feature").alias("j"), "confidence")
    points = v_obs(spark, d).select("frame", F.col("track").alias("kp"), F.col("u").alias("x"), F.col("v").alias("y"))
    points = points.withColumn("usable", matching.usable_keypoint(F.col("x"), F.col("y"), F.lit(1.0), W_, H_))
    return matching.compact_matches(raw, points).select("source", "target", "i", "j", "ax", "bx")


@query(
    "half_pixel_rescale",
    "SELECT source, target, source_feature, round((au + 0.5) * 1920 / 640 - 0.5, 6) AS x, round((av + 0.5) * 1080 / 480 - 0.5, 6) AS y FROM v_match",
)
def half_pixel_rescale(spark, d):
    x, y = G.half_pixel(F.col("au"), F.lit(1920), F.lit(640)), G.half_pixel(F.col("av"), F.lit(1080), F.lit(480))
    return v_match(spark, d).select("source", "target", "source_feature", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(
    "mutual_nearest_neighbors",
    """WITH s AS (SELECT a.label AS g, a.frame AS i, b.frame AS j, list_dot_product(a.emb::DOUBLE[], b.emb::DOUBLE[]) AS score FROM v_desc a JOIN v_desc b ON a.label = b.label AND a.frame % 2 = 0 AND b.frame % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY score DESC, j) AS x, row_number() OVER (PARTITION BY g, j ORDER BY score DESC, i) AS y FROM s)
    SELECT g, i, j, round(score, 6) AS score FROM r WHERE x = 1 AND y = 1""",
)
def mutual_nearest_neighbors(spark, d):
    rows = v_desc(spark, d)
    a = rows.where("frame % 2 = 0").select(F.col("label").alias("g"), F.col("frame").alias("i"), F.col("emb").alias("vector"))
    b = rows.where("frame % 2 = 1").select(F.col("label").alias("g"), F.col("frame").alias("j"), F.col("emb").alias("vector"))
    return matching.nearest_pairs(a, b).withColumn("score", F.round("score", 6))


_FRAMES = "SELECT DISTINCT frame FROM v_obs"


@query("temporal_pairs", f"WITH f AS ({_FRAMES}) SELECT a.frame AS source, b.frame AS target FROM f a JOIN f b ON b.frame > a.frame AND b.frame <= a.frame + 4")
def temporal_pairs(spark, d):
    return matching.temporal_pairs(v_obs(spark, d).select("frame").distinct())


_LOOP_PAIRS = "lp AS (SELECT DISTINCT least(frame, frame * 37 % 100) AS source, greatest(frame, frame * 37 % 100) AS target FROM v_obs WHERE frame % 3 = 0 AND frame <> frame * 37 % 100)"
_PLAN = f"f AS ({_FRAMES}), {_LOOP_PAIRS}, t AS (SELECT a.frame AS source, b.frame AS target FROM f a JOIN f b ON b.frame > a.frame AND b.frame <= a.frame + 4), plan AS (SELECT source, target, CASE WHEN target - source <= 4 THEN 'temporal' ELSE 'loop' END AS pair_kind FROM (SELECT * FROM t UNION SELECT * FROM lp))"


def _loop_pairs(spark, d):
    frame, other = F.col("frame"), F.col("frame") * 37 % 100
    rows = v_obs(spark, d).select("frame").distinct().where((frame % 3 == 0) & (frame != other))
    return rows.select(F.least(frame, other).alias("source"), F.greatest(frame, other).alias("target")).distinct()


def _plan(spark, d):
    return matching.pair_plan(matching.temporal_pairs(v_obs(spark, d).select("frame").distinct()), _loop_pairs(spark, d))


@query("pair_plan", f"WITH {_PLAN} SELECT source, target, pair_kind FROM plan")
def pair_plan(spark, d):
    return _plan(spark, d)


_GATED = "gated AS (SELECT source, target, count(*) AS matches, count(*) FILTER (inlier) AS inliers FROM v_match GROUP BY ALL HAVING count(*) FILTER (inlier) >= 30 AND count(*) FILTER (inlier) >= 0.25 * count(*))"


@query("missing_pairs", f"WITH {_PLAN}, {_GATED} SELECT source, target, pair_kind FROM plan ANTI JOIN gated USING (source, target)")
def missing_pairs(spark, d):
    return matching.missing_pairs(_plan(spark, d), matching.verified_pairs(v_match(spark, d)))


@query(
    "remap_pairs",
    f"WITH {_GATED}, ids AS (SELECT frame AS old, CAST(row_number() OVER (ORDER BY frame) - 1 AS INT) AS new FROM ({_FRAMES}) WHERE frame % 10 <> 3) SELECT g.source, g.target, a.new AS new_source, b.new AS new_target FROM gated g JOIN ids a ON a.old = g.source JOIN ids b ON b.old = g.target",
)
def remap_pairs(spark, d):
    ids = v_obs(spark, d).select(F.col("frame").alias("old")).distinct().where("old % 10 <> 3").withColumn("new", F.row_number().over(W.orderBy("old")) - 1)
    return matching.remap_pairs(matching.verified_pairs(v_match(spark, d)), ids).select("source", "target", "new_source", "new_target")


@query("verified_pairs", f"WITH {_GATED} SELECT source, target, matches, inliers FROM gated")
def verified_pairs(spark, d):
    return matching.verified_pairs(v_match(spark, d)).select("source", "target", "matches", "inliers")


@query(
    "loop_pair_quality",
    f"""WITH q AS (SELECT source, target, count(*) AS matches, count(*) FILTER (inlier) AS inliers,
    count(DISTINCT CASE WHEN inlier AND au >= 0 AND au < {W_} AND av >= 0 AND av < {H_} THEN floor(av * 4 / {H_}) * 4 + floor(au * 4 / {W_}) END) AS cells_a,
    count(DISTINCT CASE WHEN inlier AND bu >= 0 AND bu < {W_} AND bv >= 0 AND bv < {H_} THEN floor(bv * 4 / {H_}) * 4 + floor(bu * 4 / {W_}) END) AS cells_b FROM v_match GROUP BY ALL)
    SELECT *, inliers >= 30 AND inliers >= 0.25 * matches AND least(cells_a, cells_b) >= 4 AS accepted FROM q""",
)
def loop_pair_quality(spark, d):
    return matching.loop_pair_quality(v_match(spark, d), W_, H_)


@query(
    "match_coverage",
    f"""WITH q AS (SELECT source, target, count(*) FILTER (inlier) AS inliers, count(*) AS matches,
    coalesce(bit_count(bit_or(CASE WHEN inlier THEN 1::BIGINT << (least(3, floor(av * 4 / {H_})) * 4 + least(3, floor(au * 4 / {W_})))::INT END)), 0) AS ca,
    coalesce(bit_count(bit_or(CASE WHEN inlier THEN 1::BIGINT << (least(3, floor(bv * 4 / {H_})) * 4 + least(3, floor(bu * 4 / {W_})))::INT END)), 0) AS cb,
    list_sort(list(sqrt((au - bu) * (au - bu) + (av - bv) * (av - bv))) FILTER (inlier)) AS steps FROM v_match GROUP BY ALL)
    SELECT source, target, inliers, round(inliers / matches, 6) AS ratio, least(ca, cb) / 16.0::DOUBLE AS coverage, round(coalesce(steps[len(steps) // 2 + 1], 0) / sqrt({W_} * {W_} + {H_} * {H_}), 6) AS displacement FROM q""",
)
def match_coverage(spark, d):
    q = matching.match_coverage(v_match(spark, d), W_, H_, W_, H_)
    return q.select("source", "target", "inliers", F.round("ratio", 6).alias("ratio"), "coverage", F.round("displacement", 6).alias("displacement"))


FUNDAMENTAL = [1e-9, 2e-8, -1e-3, -2e-8, 1e-9, 2e-3, 1e-3, -2e-3, 0.5]
HOMOGRAPHY = [0.99, 0.01, 3.0, -0.01, 1.01, -2.0, 1e-8, 2e-8, 1.0]
_f, _h = FUNDAMENTAL, HOMOGRAPHY


@query(
    "epipolar_residuals",
    f"""WITH m AS (SELECT source, target, source_feature, au, av, bu, bv,
    {_f[0]!r}::DOUBLE * au + {_f[1]!r}::DOUBLE * av + {_f[2]!r}::DOUBLE AS l0, {_f[3]!r}::DOUBLE * au + {_f[4]!r}::DOUBLE * av + {_f[5]!r}::DOUBLE AS l1, {_f[6]!r}::DOUBLE * au + {_f[7]!r}::DOUBLE * av + {_f[8]!r}::DOUBLE AS l2,
    {_f[0]!r}::DOUBLE * bu + {_f[3]!r}::DOUBLE * bv + {_f[6]!r}::DOUBLE AS r0, {_f[1]!r}::DOUBLE * bu + {_f[4]!r}::DOUBLE * bv + {_f[7]!r}::DOUBLE AS r1,
    {_h[6]!r}::DOUBLE * au + {_h[7]!r}::DOUBLE * av + {_h[8]!r}::DOUBLE AS z FROM v_match)
    SELECT source, target, source_feature,
    round(greatest((bu * l0 + bv * l1 + l2) * (bu * l0 + bv * l1 + l2) / (l0 * l0 + l1 * l1), (bu * l0 + bv * l1 + l2) * (bu * l0 + bv * l1 + l2) / (r0 * r0 + r1 * r1)), 3) AS epipolar,
    round((({_h[0]!r}::DOUBLE * au + {_h[1]!r}::DOUBLE * av + {_h[2]!r}::DOUBLE) / z - bu) * (({_h[0]!r}::DOUBLE * au + {_h[1]!r}::DOUBLE * av + {_h[2]!r}::DOUBLE) / z - bu) + (({_h[3]!r}::DOUBLE * au + {_h[4]!r}::DOUBLE * av + {_h[5]!r}::DOUBLE) / z - bv) * (({_h[3]!r}::DOUBLE * au + {_h[4]!r}::DOUBLE * av + {_h[5]!r}::DOUBLE) / z - bv), 3) AS transfer FROM m""",
)
def epipolar_residuals(spark, d):
    points = [F.col(c) for c in ("au", "av", "bu", "bv")]
    return v_match(spark, d).select(
        "source", "target", "source_feature", F.round(G.fundamental_error(FUNDAMENTAL, *points), 3).alias("epipolar"), F.round(G.homography_error(HOMOGRAPHY, *points), 3).alias("transfer")
    )


@query(
    "ransac_model_selection",
    """WITH h AS (SELECT target, CASE WHEN source % 2 = 0 THEN 'H' ELSE 'F' END AS family, source AS id, count(*) FILTER (inlier) AS inliers, round(sum(abs(av - bv)), 3) AS cost FROM v_match GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY target, family ORDER BY inliers DESC, cost, id) AS r FROM h),
    w AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY inliers DESC, family) AS q FROM b WHERE r = 1)
    SELECT target, family, id, inliers FROM w WHERE q = 1""",
)
def ransac_model_selection(spark, d):
    h = v_match(spark, d).groupBy("target", F.when(F.col("source") % 2 == 0, "H").otherwise("F").alias("family"), F.col("source").alias("id"))
    return matching.choose_model(h.agg(F.count_if("inlier").alias("inliers"), F.round(F.sum(F.abs(F.col("av") - F.col("bv"))), 3).alias("cost")))


#: On these matches a keypoint is its part, so tracks are the runs of a part's frames with steps of at most four.
_ISLANDS = """isl AS (SELECT track, frame, sum(new) OVER (PARTITION BY track ORDER BY frame) AS run FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track ORDER BY frame) <= 4 THEN 0 ELSE 1 END AS new FROM v_obs)),
    tr AS (SELECT track, run, min(frame) AS first, max(frame) AS last, count(*) AS views FROM isl GROUP BY ALL HAVING count(*) >= 3)"""


def _edges(spark, d):
    return v_match(spark, d).select(
        F.col("source").alias("fa"), F.col("source_feature").alias("ka"), F.col("target").alias("fb"), F.col("target_feature").alias("kb"), "confidence", F.lit(False).alias("is_loop")
    )


@query("measured_tracks", f"WITH {_ISLANDS} SELECT first AS head_frame, track AS head_kp, views FROM tr")
def measured_tracks(spark, d):
    return graph.build_tracks(_edges(spark, d)).select("head_frame", "head_kp", "views").distinct()


def _extents(spark, d):
    return graph.build_tracks(_edges(spark, d)).groupBy("head_frame", "head_kp").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


_SPINE = "sp AS (SELECT CAST(range AS BIGINT) AS frame FROM range(100))"
_CROSS = f"{_ISLANDS}, {_SPINE}, cr AS (SELECT frame, (SELECT count(*) FROM tr WHERE first < frame AND frame <= last) AS crossing FROM sp)"


@query("temporal_crossing_counts", f"WITH {_CROSS} SELECT frame, crossing FROM cr")
def temporal_crossing_counts(spark, d):
    return graph.crossing_counts(_extents(spark, d), spark.range(100).withColumnRenamed("id", "frame"))


@query("weak_boundaries", f"WITH {_CROSS} SELECT frame, crossing FROM cr WHERE frame > 0 AND crossing < 300")
def weak_boundaries(spark, d):
    return graph.weak_boundaries(graph.crossing_counts(_extents(spark, d), spark.range(100).withColumnRenamed("id", "frame")), 300)


@query(
    "repair_candidates",
    f"""WITH {_CROSS}, wk AS (SELECT frame, row_number() OVER (ORDER BY crossing, frame) AS place FROM cr WHERE frame > 0 AND crossing < 300),
    ask AS (SELECT place, o.nth, frame + o.step AS "right" FROM wk, (VALUES (0, 0), (1, -1), (2, 1)) o(nth, step)),
    mid AS (SELECT place, nth, (3 * ("right" - 1) + 3 * "right") // 2 AS candidate FROM ask WHERE "right" > 0 AND "right" < 100),
    fst AS (SELECT candidate, min(place * 10 + nth) AS pos FROM mid GROUP BY candidate),
    r AS (SELECT candidate, CAST(row_number() OVER (ORDER BY pos) AS INT) AS priority FROM fst) SELECT candidate, priority FROM r WHERE priority <= 12""",
)
def repair_candidates(spark, d):
    frames = spark.range(100).select(F.col("id").alias("frame"), (F.col("id") * 3).alias("candidate"))
    return graph.repair_candidates(frames, graph.crossing_counts(_extents(spark, d), frames), 12, 300)


@query(
    "image_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT source AS a, target AS b FROM v_match WHERE source % 20 <> 19 AND target % 20 <> 19 AND source // 20 = target // 20), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk AS (SELECT a AS node, a AS root FROM n UNION SELECT n.b, walk.root FROM walk JOIN n ON n.a = walk.node) SELECT node, min(root) AS root FROM walk GROUP BY node""",
)
def image_components(spark, d):
    cut = "source % 20 <> 19 AND target % 20 <> 19 AND source DIV 20 = target DIV 20"
    return graph.connected_components(v_match(spark, d).where(cut).select(F.col("source").alias("u"), F.col("target").alias("v")).distinct())


@query(
    "graph_summary",
    f"WITH {_GATED}, {_ISLANDS} SELECT (SELECT count(*) FROM gated) AS verified_pairs, (SELECT count(*) FROM v_match SEMI JOIN gated USING (source, target) WHERE inlier) AS match_edges, (SELECT count(*) FROM tr) AS tracks, (SELECT max(views) FROM tr) AS longest_track",
)
def graph_summary(spark, d):
    matches = v_match(spark, d)
    gated = saved(matching.verified_pairs(matches), "gated")
    tracks = graph.build_tracks(_edges(spark, d)).select("head_frame", "head_kp", "views").distinct()
    one = gated.agg(F.count(F.lit(1)).alias("verified_pairs"))
    two = matches.where("inlier").join(gated, ["source", "target"], "left_semi").agg(F.count(F.lit(1)).alias("match_edges"))
    three = tracks.agg(F.count(F.lit(1)).alias("tracks"), F.max("views").alias("longest_track"))
    return one.crossJoin(two).crossJoin(three)  # one row each


@query("content_keys", "SELECT doc_id, sha256(text) AS key FROM documents")
def content_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))


@query(
    "descriptor_cache_misses",
    "SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)",
)
def descriptor_cache_misses(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.sha2("text", 256))
    return misses(docs.select("key"), docs.where("doc_id % 3 = 0").select("key", F.lit(True).alias("sound")))
