"""Edge cases that the tables don't hold."""

import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.operators import dense, graph, holdouts, mapping, matching, retrieval, scan, windows
from lumenframe.options import from_json
from lumenframe.streaming.keyframes import Thresholds


def frames(spark, times):
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "candidate long, ts_s double")


def test_range_is_half_open_and_order_violations_show(spark):
    f = frames(spark, [0, 1, 2, 3])
    assert [r[0] for r in scan.temporal_range(f, 1, 2).orderBy("candidate").collect()] == [1, 2]
    assert scan.violations_of_order(f, "candidate", "ts_s").count() == 0
    bad = frames(spark, [0, 1, 1, float("nan"), 5])
    assert sorted(r[0] for r in scan.violations_of_order(bad, "candidate", "ts_s").collect())[:2] == [2, 3]
    with pytest.raises(ValueError):
        scan.head(f, 5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=4, max_size=30, unique=True), st.integers(2, 9))
def test_uniform_sampling_equals_the_greedy_walk(spark, times, count):
    times = sorted(times)
    taken, n = [], 0
    for t in times:
        if n < count and t < 60 and t >= n * 60 / count:
            taken.append(t)
            n += 1
    got = scan.uniform_sampling(frames(spark, times), 0.0, 60.0, count)
    assert sorted(r["ts_s"] for r in got.collect()) == taken


def test_gap_of_exactly_the_limit_stays_together(spark):
    got = scan.gap_groups(frames(spark, [0, 2, 4.001, 5]), "ts_s", 2.0).orderBy("candidate").collect()
    assert [r["grp"] for r in got] == [0, 0, 1, 1]


def test_windows_of_small_counts(spark):
    n = lambda c: {r["window"]: r["count"] for r in windows.overlapping_windows(spark, c).groupBy("window").count().collect()}
    assert n(6) == {0: 6} and n(64) == {0: 64} and n(65) == {0: 64, 1: 33} and n(96) == {0: 64, 1: 64} and n(97)[2] == 33
    with pytest.raises(ValueError):
        windows.overlapping_windows(spark, 5)


def test_subwindows_follow_the_rule(spark):
    def plain(n):
        if n <= 8:
            return []
        size = max(8, (n + 1) // 2)
        starts = list(range(0, n - size + 1, size - max(6, size // 2)))
        if starts[-1] != n - size:
            starts.append(n - size)
        return [list(range(s, s + size)) for s in starts]

    for n in (8, 9, 15, 16, 64):
        df = spark.range(n).select(F.lit(0).cast("long").alias("window"), F.col("id").alias("frame"))
        got = windows.subwindows(df).groupBy("part").agg(F.sort_array(F.collect_list("frame")).alias("f")).orderBy("part").collect()
        assert [r["f"] for r in got] == plain(n)


def test_eligibility_of_candidates(spark):
    rows = [(0, [1, 2], False, False, [], []), (1, [1, 9], False, False, [], []), (2, [1, 9], True, False, [], []), (3, [1, 9], False, False, [5], []), (4, [1, 9], False, False, [2], []), (5, [1, 9], False, False, [], [[1]])]
    df = spark.createDataFrame(rows, "candidate int, frames array<long>, accepted boolean, blocked boolean, waiting_for array<long>, attempted array<array<long>>")
    owned = spark.createDataFrame([(1,), (2,)], "frame long")
    assert sorted(r["candidate"] for r in windows.eligible(df, owned).collect()) == [1, 4]


def edges(spark, rows):
    return spark.createDataFrame([(*r, False) if len(r) == 5 else r for r in rows], "fa long, ka long, fb long, kb long, confidence double, is_loop boolean")


def tracks_of(df):
    return sorted(sorted((r["frame"], r["kp"]) for r in rows) for rows in _grouped(df).values())


def _grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["head_frame"], r["head_kp"]), []).append(r)
    return out


def test_conflicting_edge_is_skipped_and_strength_decides(spark):
    rows = [(0, 1, 1, 1, 0.9), (1, 1, 2, 1, 0.8), (0, 2, 2, 1, 0.7)]
    assert tracks_of(graph.build_tracks(edges(spark, rows))) == [[(0, 1), (1, 1), (2, 1)]]
    rows[2] = (0, 2, 2, 1, 0.95)
    strong = tracks_of(graph.build_tracks(edges(spark, rows), 2))
    assert [(0, 2), (2, 1)] in strong


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 5), st.integers(0, 3), st.integers(1, 99)), min_size=1, max_size=40))
def test_tracks_equal_a_plain_union(spark, raw):
    rows = [(a, k, b, m, c / 100) for a, k, b, m, c in raw if a != b]
    if not rows:
        return
    sets = {}
    for a, k, b, m, _ in sorted(rows, key=lambda r: (r[4], r[0], r[1], r[2], r[3]), reverse=True):
        x, y = (sets.setdefault(n, frozenset([n])) for n in ((a, k), (b, m)))
        if x is not y and not {f for f, _ in x} & {f for f, _ in y}:
            for n in x | y:
                sets[n] = x | y
            whole = x | y
            for n in whole:
                sets[n] = whole
    want = sorted(sorted(s) for s in set(sets.values()) if len(s) >= 2)
    assert tracks_of(graph.build_tracks(edges(spark, rows), 2)) == want


def test_loop_links_need_one_track(spark):
    rows = [(0, 1, 1, 1, 0.9, False), (1, 1, 2, 1, 0.8, False), (0, 1, 2, 1, 0.7, True), (0, 5, 9, 5, 0.6, True)]
    e = edges(spark, rows)
    links = graph.loop_links(e, graph.build_tracks(e)).collect()
    assert [(r["source"], r["target"]) for r in links] == [(0, 2)]


def matches(spark, n, inliers, spread=1.0):
    return spark.createDataFrame([(0, 1, i < inliers, float(i % 8 * 10 * spread), float(i // 8 * 4 * spread), float(i % 8 * 10 * spread), float(i // 8 * 4 * spread)) for i in range(n)], "source long, target long, inlier boolean, au double, av double, bu double, bv double")


@pytest.mark.parametrize("n, inliers, passes", [(100, 29, 0), (100, 30, 1), (121, 30, 0), (120, 30, 1)])
def test_both_limits_of_the_pair_gate(spark, n, inliers, passes):
    assert matching.verified_pairs(matches(spark, n, inliers)).count() == passes


def test_concentrated_loop_matches_are_rejected(spark):
    assert matching.loop_pair_quality(matches(spark, 64, 64, 1.0), 80, 32).first()["accepted"]
    assert not matching.loop_pair_quality(matches(spark, 64, 64, 0.2), 80, 32).first()["accepted"]


def test_corroboration_needs_offsets_on_both_sides(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "source long, target long")
    assert retrieval.corroborated(pairs((10, 60), (11, 60))).count() == 0
    assert retrieval.corroborated(pairs((10, 60), (11, 61))).count() == 2


def test_equal_scores_take_the_lower_frame_and_blocks_do_not_matter(spark):
    rows = [(i * 40, i * 40.0, [1.0, 0.0]) for i in range(8)] + [(7, 7.0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "frame long, ts_s double, emb array<double>")
    whole = sorted(map(tuple, retrieval.loop_candidates(df).collect()))
    assert whole == sorted(map(tuple, retrieval.loop_candidates(df, block=2).collect()))
    assert (0, 40, 1.0) in whole and not any(7 in p[:2] for p in whole)


def plain_walk(rows, neighbors, o):
    pairs = {}
    unit = [(f, t, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for f, t, v in rows]
    for q, tq, a in unit:
        ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), f, t) for f, t, b in unit if abs(f - q) > max(neighbors, o["apart_frames"]) and abs(t - tq) >= o["apart_seconds"])
        kept = []
        for s, f, t in ranked:
            if len(kept) < o["each"] and all(abs(t - x) >= o["spacing"] for x in kept):
                kept.append(t)
                pairs[min(q, f), max(q, f)] = True
    return sorted(pairs)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=20, max_size=70), st.floats(0.3, 2.0))
def test_blocked_retrieval_equals_the_plain_walk(spark, vectors, pace):
    o = {"each": 3, "apart_frames": 3, "apart_seconds": 3.0, "spacing": 5.0}
    rows = [(i, i * pace, [a / 7, b / 7, 0.3 + i / 1000]) for i, (a, b) in enumerate(vectors)]
    df = spark.createDataFrame(rows, "frame long, ts_s double, emb array<double>")
    want = plain_walk(rows, 1, o)
    for block in (1000, 7):
        assert sorted((r[0], r[1]) for r in retrieval.loop_candidates(df, 1, **o, block=block).collect()) == want


def test_calibration_gates(spark):
    rows = [(0, 0.1)] * 5 + [(1, 0.1)] * 6 + [(2, float(x)) for x in range(6)]
    got = {r["frame"]: r["reason"] for r in dense.calibrate(spark.createDataFrame(rows, "frame int, log_ratio double")).collect()}
    assert got == {0: "too few anchors", 1: None, 2: "inconsistent scale"}


def test_depth_gate_ignores_invalid_values(spark):
    rows = [(0, d, c) for d, c in [(1.0, 0.9), (2.0, 0.1), (float("nan"), 1.0), (0.0, 1.0), (-1.0, 1.0), (3.0, float("nan")), (4.0, 0.5)]]
    kept = dense.confidence_filter(spark.createDataFrame(rows, "frame int, depth double, conf double")).collect()
    assert sorted(r["depth"] for r in kept) == [1.0, 4.0]


def test_voxels_floor_negatives_and_conserve_sums(spark):
    rows = [(0, x, 0.0, 0.0, 10, 20, 30) for x in (-0.1, 0.0, 0.1)] + [(1, float("nan"), 0.0, 0.0, 1, 1, 1)]
    points = spark.createDataFrame(rows, "frame int, x double, y double, z double, red int, green int, blue int")
    cells = {r["vx"]: r for r in dense.voxel_fusion(points, 1.0).collect()}
    assert {k: v["n"] for k, v in cells.items()} == {-1: 1, 0: 2}
    assert math.isclose(sum(v["n"] * v["x"] for v in cells.values()), 0.0, abs_tol=1e-12)
    with pytest.raises(ValueError):
        dense.voxel_fusion(points, 1.0, most_cells=1)
    assert dense.preview(dense.voxel_fusion(points, 1.0), 1).count() == 1


def test_point_at_or_behind_the_camera_is_infinitely_wrong(spark):
    from lumenframe.functions.geometry import reprojection_error

    rows = spark.createDataFrame([(1.0, 1.0, 0.0), (1.0, 1.0, -1.0), (0.0, 0.0, 2.0)], "x double, y double, z double")
    lit = [F.lit(float(v)) for v in (500, 500, 320, 240, 320, 240)]
    assert [r[0] for r in rows.select(reprojection_error((F.col("x"), F.col("y"), F.col("z")), *lit)).collect()] == [math.inf, math.inf, 0.0]


def test_upper_and_interpolated_medians(spark):
    rows = spark.createDataFrame([(0, float(v * v)) for v in (1, 2, 3, 4)], "g int, error2 double")
    assert mapping.error_statistics(rows, ["g"]).first()["median"] == 3.0
    cams = spark.createDataFrame([(float(v), 1.0, 1.0, 1.0) for v in (1, 2, 3, 4)], "fx double, fy double, cx double, cy double")
    assert mapping.shared_intrinsics(cams).first()["fx"] == 2.5


def test_holdouts_are_balanced(spark):
    rows = [(0, t, f) for t in range(60) for f in (1, 2, 3)]
    support = spark.createDataFrame([(0, f, n) for f, n in ((1, 60), (2, 60), (3, 11))], "boundary long, frame long, observations long")
    got = holdouts.choose_holdouts(spark.createDataFrame(rows, "boundary long, track long, frame long"), support).groupBy("frame").count().collect()
    assert {r["frame"]: r["count"] for r in got} == {1: 30, 2: 29, 3: 1}


def test_held_out_share_is_a_fifth():
    assert 0.18 < holdouts.held_out(pd.Series(range(20_000))).mean() < 0.22


def test_options_refuse_nonsense(spark):
    with pytest.raises(ValueError):
        windows.overlapping_windows(spark, 100, 7, 6)
    with pytest.raises(ValueError):
        windows.overlapping_windows(spark, 100, 64, 1)
    with pytest.raises(ValueError):
        Thresholds(retention=2.0)
    with pytest.raises(ValueError, match="unknown"):
        from_json(Thresholds, '{"speed": 1}')
    assert graph.insertion_budget(1000, **from_json(graph.insertion_budget, '{"most": 10}')) == 10 and graph.insertion_budget(10) == 3


def test_skewed_components_and_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(chain + [(900, 900)], "u long, v long")).collect()}
    assert set(got.values()) == {0, 900} and len(got) == 202


@pytest.mark.parametrize("seed", [0, 1])
def test_rounds_join_like_one_task(spark, monkeypatch, seed):
    """Greedy joining by strength, edge by edge in one task and in rounds over all tasks, on edges full of conflicts."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = {(int(a), int(b), int(c), int(d)) for a, b, c, d in rng.integers(0, [9, 4, 9, 4], (90, 4)) if a < c}
    edges = pd.DataFrame([(*r, float(rng.integers(0, 6)), bool(rng.integers(0, 2))) for r in sorted(rows)], columns=["fa", "ka", "fb", "kb", "confidence", "is_loop"])
    df = spark.createDataFrame(edges, "fa long, ka long, fb long, kb long, confidence double, is_loop boolean")
    want = set(map(tuple, graph.join_constrained(edges).itertuples(index=False)))
    assert {tuple(r) for r in graph.join_by_rounds(df).collect()} == want
    whole = {tuple(r) for r in graph.joined_tracks(df).collect()}
    monkeypatch.setattr(graph, "JOINED", 0)
    assert {tuple(r) for r in graph.joined_tracks(df).collect()} == whole == want
    heads = {(f, k): (a, b) for f, k, a, b in want}
    assert graph.rejected_edges(df, graph.joined_tracks(df)).count() == sum(heads[a, b] != heads[c, d] for a, b, c, d in rows)


def test_components_over_several_tasks_and_heavy_nodes(spark, monkeypatch):
    import numpy as np

    from lumenframe.plans import spread

    monkeypatch.setattr(graph, "TOGETHER", 300)
    monkeypatch.setattr(spread, "LEAST", 10)
    monkeypatch.setattr(spread, "PARTS", 50)
    rng = np.random.default_rng(0)
    u, v = np.concatenate([rng.integers(0, 4000, 2000), np.full(800, 9000)]), np.concatenate([rng.integers(0, 4000, 2000), rng.integers(5000, 6000, 800)])
    parent = {int(x): int(x) for x in np.concatenate([u, v])}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pd.DataFrame({"u": u, "v": v})).repartition(6)
    assert {r["node"]: r["root"] for r in graph.connected_components(df).collect()} == {x: top(x) for x in parent}


def test_a_union_refuses_what_lies_in_two_parts(spark):
    cams = spark.range(10).withColumnRenamed("id", "frame")
    obs = cams.select(F.col("frame").alias("track"), "frame")
    one, two = (cams.where("frame < 5"), obs.where("frame < 5")), (cams.where("frame >= 5"), obs.where("frame >= 5"))
    assert mapping.disjoint_union([one, two])[0].count() == 10
    with pytest.raises(ValueError, match="two parts"):
        mapping.disjoint_union([one, (cams.where("frame >= 4"), two[1])])


def test_voxels_follow_the_median_scene_depth(spark):
    depths = spark.createDataFrame([(float(v),) for v in (1, 2, 9)], "scene_depth double")
    assert dense.voxel_width(depths) == 0.02
    for wrong in (0.0, 2.0):
        with pytest.raises(ValueError):
            dense.voxel_width(depths, wrong)


def test_few_looked_at_find_the_same_loops(spark, monkeypatch):
    rows = [(i, float(i // 3), [float(math.cos(i % 7)), float(math.sin(i % 7)), float(i % 2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "frame long, ts_s double, emb array<double>")
    ask = lambda: sorted(map(tuple, retrieval.loop_candidates(df, apart_frames=4, apart_seconds=2.0, block=40).collect()))
    whole = ask()
    monkeypatch.setattr(retrieval, "LOOKED_AT", 1)
    assert whole and ask() == whole


def _ladder():
    """Edges of 200 tracks of five frames in the order of the tracks, then weak ones that join neighbours, every third in conflict."""
    rows = [(f + 5 * (t % 3 > 0) * (t % 2), t, f + 1 + 5 * (t % 3 > 0) * (t % 2), t, 0.9, False) for t in range(200) for f in range(4)]
    weak = [(0, t, 5 * ((t + 1) % 3 > 0), t + 1, 0.0, True) for t in range(0, 200, 2)]
    return pd.DataFrame(rows + weak, columns=["fa", "ka", "fb", "kb", "confidence", "is_loop"])


def test_tracks_that_arrive_together_need_no_rounds(spark, monkeypatch):
    asked = []
    plain = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda edges: asked.append(edges.count()) or plain(edges))
    pdf = _ladder()
    df = spark.createDataFrame(pdf, "fa long, ka long, fb long, kb long, confidence double, is_loop boolean")
    want = graph.join_constrained(pdf)
    assert {tuple(r) for r in graph.joined_tracks(df).collect()} == set(map(tuple, want.itertuples(index=False)))
    views = want.groupby(["head_frame", "head_kp"]).size().reset_index()
    assert sorted(views[0].unique()) == [5, 10]
    assert {tuple(r) for r in graph.track_views(df, 6).collect()} == set(map(tuple, views[views[0] >= 6].itertuples(index=False)))
    assert max(asked) <= 220  # two for each weak edge and some where a partition ends, of 900 edges
    apart = df.repartition(7, "fa", "ka", "fb")
    assert {tuple(r) for r in graph.joined_tracks(apart).collect()} == set(map(tuple, want.itertuples(index=False)))


def test_rejected_edges_are_looked_for_where_a_conflict_is(spark, monkeypatch):
    looked = []
    plain = graph.rejected_edges
    monkeypatch.setattr(graph, "rejected_edges", lambda edges, joined: looked.append((edges.count(), joined.count())) or plain(edges, joined))
    pdf = _ladder()
    df = spark.createDataFrame(pdf, "fa long, ka long, fb long, kb long, confidence double, is_loop boolean")
    head = {(f, k): (a, b) for f, k, a, b in graph.join_constrained(pdf).itertuples(index=False)}
    want = sorted(r for r in pdf.itertuples(index=False, name=None) if head[r[0], r[1]] != head[r[2], r[3]])
    assert want and sorted(map(tuple, graph.conflicting_edges(df).collect())) == want
    assert looked == [(9 * len(want), 10 * len(want))]  # a weak edge and its two tracks, of 900 edges


def test_a_summary_joins_anew_only_what_loop_edges_touch(spark, monkeypatch):
    asked = []
    plain = graph._parts
    monkeypatch.setattr(graph, "_parts", lambda edges: asked.append(edges.count()) or plain(edges))
    pdf = _ladder().query("not is_loop or fb > 0 or ka < 100")
    df = spark.createDataFrame(pdf, "fa long, ka long, fb long, kb long, confidence double, is_loop boolean")
    pairs = df.select(F.col("fa").alias("source"), F.col("fb").alias("target")).distinct()
    verified = pairs.select("*", F.lit("temporal").alias("pair_kind"))
    got = graph.summary(pairs.limit(0), df.select(F.col("fa").alias("source"), F.col("fb").alias("target")), verified, pairs.limit(0), df).first()
    size = lambda rows: graph.join_constrained(rows).groupby(["head_frame", "head_kp"]).size()
    of = {(f, k): (a, b) for f, k, a, b in graph.join_constrained(pdf).itertuples(index=False)}
    loops = pdf[pdf.is_loop]
    kept = {of[r.fa, r.ka] for r in loops.itertuples() if of[r.fa, r.ka] == of[r.fb, r.kb]}
    assert (got["match_edges"], got["tracks"], got["temporal_tracks"]) == (len(pdf), (size(pdf) >= 3).sum(), (size(pdf[~pdf.is_loop]) >= 3).sum())
    assert (got["loop_tracks"], got["conflicting_edges"]) == (len(kept), len(loops) - sum(of[r.fa, r.ka] == of[r.fb, r.kb] for r in loops.itertuples()))
    assert asked == [len(pdf), 8 * len(loops)]  # the second time the edges of the tracks that a loop edge touches, of 800
