import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import alignment, ransac, solver
from lumenframe.operators.map_builder import MapBuilder, WindowRejected, assemble
from lumenframe.streaming.keyframes import Thresholds
from lumenframe.plans.state_queries import fixture_quality
from lumenframe.streaming import keyframes


def rows(n=300, gap=0.15):
    return [(0, i, i * gap, 100 + i % 30, 10.0 + (i * 7) % 40) for i in range(n)]


SCHEMA = "video long, candidate long, ts_s double, feature_count long, sharpness double"
OPTIONS = Thresholds(minimum_features=105)


def test_timeout_is_strict_and_overrides():
    m = keyframes.Selector(fixture_quality, Thresholds())
    assert m.feed(0, 0.0, 200, 50)[0] == "first_usable"
    assert m.feed(1, 2.0, 0, 0)[0] == "reject_quality"
    assert m.feed(2, 2.001, 0, 0)[0] == "tracking_break" and m.feed(3, 2.1, 200, 50) is None and not m.finish()


def test_times_must_rise():
    m = keyframes.Selector(fixture_quality, Thresholds())
    m.feed(0, 1.0, 200, 50)
    with pytest.raises(ValueError):
        m.feed(1, 1.0, 200, 50)


def test_state_round_trip_continues_alike():
    a, b, out = keyframes.Selector(fixture_quality, OPTIONS), None, []
    for i, r in enumerate(rows(120)):
        b = keyframes.Selector(fixture_quality, OPTIONS).load(a.state) if i else keyframes.Selector(fixture_quality, OPTIONS)
        out.append((a.feed(*r[1:]), b.feed(*r[1:])))
    assert all(x == y for x, y in out)


def test_selected_keyframes_equal_the_machine(spark):
    m = keyframes.Selector(fixture_quality, OPTIONS)
    for r in rows():
        m.feed(*r[1:])
    assert m.finish()
    got = keyframes.selected_keyframes(keyframes.select_keyframes(spark.createDataFrame(rows(), SCHEMA), fixture_quality, OPTIONS))
    assert sorted((r["candidate"], r["reason"]) for r in got.collect()) == sorted(m.selected)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    data = rows(90)
    for k in range(files):
        part = data[k * len(data) // files : (k + 1) * len(data) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = keyframes.stream_keyframes(keyframes.read_frame_stream(spark, str(tmp_path / "in"), schema), fixture_quality, OPTIONS)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = keyframes.select_keyframes(spark.createDataFrame(data, SCHEMA), fixture_quality, OPTIONS)
    key = lambda df: sorted((r["candidate"], r["decision"], r["reference"], r["bridge"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def scene(n=8, m=150, seed=1, noise=0.2):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (m, 3)) + [0, 0, 8]
    r = np.array([alignment._rodrigues(rng.normal(size=3) * 0.03) for _ in range(n)])
    c = np.c_[np.arange(n) * 0.4 - 1.2, rng.normal(size=(n, 2)) * 0.05]
    obs = []
    for i in range(n):
        y = (x - c[i]) @ r[i]
        p = 600 * y[:, :2] / y[:, 2:] + [320, 240] + rng.normal(size=(m, 2)) * noise
        obs += [(t, i, p[t, 0], p[t, 1], y[t, 2]) for t in range(m)]
    return x, r, c, pd.DataFrame(obs, columns=["track", "frame", "u", "v", "depth"])


def test_adjustment_recovers_a_scene_and_never_raises_cost():
    x, r, c, obs = scene()
    rng = np.random.default_rng(3)
    w2c = np.swapaxes(r, 1, 2).copy()
    for i in range(1, len(w2c)):
        w2c[i] = w2c[i] @ alignment._rodrigues(rng.normal(size=3) * 0.01)
    t = -np.einsum("nij,nj->ni", np.swapaxes(r, 1, 2), c)
    pix = obs[["u", "v"]].to_numpy()
    out = rng.choice(len(pix), 40, replace=False)
    pix[out] += rng.normal(size=(40, 2)) * 50
    problem = solver.Problem(w2c, t, np.full((8, 2), 600.0), np.tile([320.0, 240.0], (8, 1)), x + rng.normal(size=x.shape) * 0.05, obs["frame"].to_numpy(), obs["track"].to_numpy(), pix)
    for options in ({}, {"gnc": False, "iterations": 60}, {"gnc": False, "iterations": 60, "shared_calibration": False, "refine_principal": True}):
        a = solver.Adjuster(problem, **options)
        assert solver.finite_difference_error(a) < 1e-5
        report = a.solve()
        assert report.median < 0.6 and report.within >= len(pix) - 45
        if options:
            assert all(y <= z for z, y in zip(report.cost, report.cost[1:], strict=False))
    with pytest.raises(ValueError):
        solver.Problem(w2c[:2], t[:2], np.full((2, 2), 600.0), np.zeros((2, 2)), x, obs["frame"].to_numpy()[:300], obs["track"].to_numpy()[:300], pix[:300]).check()


def test_similarity_and_pose_are_recovered():
    rng = np.random.default_rng(0)
    s = {"scale": 1.7, "rotation": alignment._rodrigues(np.array([0.3, -0.2, 0.5])), "translation": np.array([1.0, 2.0, 3.0])}
    local = {i: (alignment._rodrigues(rng.normal(size=3)), rng.normal(size=3)) for i in range(8)}
    ref = {i: alignment.apply_sim3(s, *v) for i, v in local.items()}
    ref[3] = (ref[3][0] @ alignment._rodrigues(np.array([0.4, 0, 0])), ref[3][1])  # one wrong rotation
    got = alignment.align(ref, local, [], 1.0, 1.0)
    assert abs(got["scale"] - 1.7) < 0.05 and alignment.angle(got["rotation"], s["rotation"]) < 0.05
    with pytest.raises(ValueError):
        alignment.align(ref, {99: local[0]}, [], None, None)
    x = rng.normal(size=(120, 3)) + [0, 0, 6]
    k = np.array([[600, 0, 320], [0, 600, 240], [0, 0, 1.0]])
    r, t = alignment._rodrigues(np.array([0.02, 0.1, -0.03])), np.array([0.5, 0.1, -0.2])
    p = (x @ r.T + t) @ k.T
    pix = p[:, :2] / p[:, 2:]
    pix[:30] += rng.normal(size=(30, 2)) * 80
    pose = alignment.pose_from_points(x, pix, k)
    assert alignment.angle(pose[0], r) < 1e-6 and np.allclose(pose[1], t, atol=1e-6) and pose[2].sum() >= 90
    assert alignment.pose_from_points(x[:5], pix[:5], k) is None


def test_two_view_models(spark):
    rng = np.random.default_rng(0)
    x = np.c_[rng.uniform(-2, 2, (150, 2)), rng.uniform(5, 11, 150)]
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    p, q = x @ k.T, (x @ alignment._rodrigues(np.array([0.02, 0.1, -0.03])).T + [0.4, 0.1, -0.2]) @ k.T
    a, b = p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]
    b[:30] += rng.normal(size=(30, 2)) * 60
    df = spark.createDataFrame(pd.DataFrame({"source": 1, "target": 2, "au": a[:, 0], "av": a[:, 1], "bu": b[:, 0], "bv": b[:, 1]}))
    row = ransac.verify_pairs(df, (640, 480), (640, 480)).first()
    assert row["model"] == "fundamental" and row["inliers"] >= 118 and row["matches"] == 150 and 0 < row["coverage"] <= 1
    assert row == ransac.verify_pairs(df.repartition(3), (640, 480), (640, 480)).first()
    few = ransac.verify_pairs(df.limit(3), (640, 480), (640, 480)).first()
    assert few["inliers"] == 0 and few["matrix"] is None


def test_windows_join_a_map_or_leave_it_alone():
    x, r, c, obs = scene(n=14, m=220)
    rng = np.random.default_rng(9)
    turn, shift = alignment._rodrigues(np.array([0.1, 0.2, 0.1])), np.array([1.0, -2.0, 0.5])

    def window(frames, scale, rotate, move):
        cams = pd.DataFrame({"frame": frames, "fx": 600.0, "fy": 600.0, "cx": 320.0, "cy": 240.0})
        cams["r"] = [(rotate @ r[f] @ alignment._rodrigues(rng.normal(size=3) * 0.002)).ravel() for f in frames]
        cams["c"] = [scale * rotate @ c[f] + move for f in frames]
        return cams, obs[obs["frame"].isin(frames)].assign(depth=lambda d: d["depth"] * scale)[["track", "frame", "depth"]]

    b = MapBuilder(obs[["track", "frame", "u", "v"]])
    plan = {0: window(list(range(8)), 1.0, np.eye(3), np.zeros(3)), 1: window(list(range(4, 14)), 2.5, turn, shift)}
    attempts = assemble(b, plan, lambda builder, waiting: sorted(waiting))
    assert attempts["status"].tolist() == ["accepted", "accepted"] and len(b.map.cameras) == 14
    before = b.map
    bad = window(list(range(4, 14)), 1.0, np.eye(3), np.zeros(3))
    with pytest.raises(WindowRejected):
        b.add_window(2, bad[0], bad[1].head(100))
    assert b.map is before
    b.finalize()
    assert b.map.cameras["fx"].nunique() == 1
    got = np.stack(b.map.cameras.sort_values("frame")["c"].to_numpy())
    steps = np.linalg.norm(np.diff(got, axis=0), axis=1) / np.linalg.norm(np.diff(c, axis=0), axis=1)
    assert steps.std() / steps.mean() < 0.05
