import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenframe.operators import alignment, bridges, images


def test_sharpness_of_flat_and_striped_images(spark):
    flat, stripes = np.full((4, 6, 3), 90, np.uint8), np.zeros((4, 6, 3), np.uint8)
    stripes[:, ::2] = 255
    df = spark.createDataFrame([(0, 4, 6, bytearray(flat.tobytes())), (1, 4, 6, bytearray(stripes.tobytes()))], "frame long, h int, w int, rgb binary")
    got = {r["frame"]: r["sharpness"] for r in images.sharpness(df).collect()}
    assert got[0] < 1e-9 and got[1] > 1e5


def test_depth_preview_and_lookup(spark):
    rows = [(0, float(i)) for i in range(1, 101)] + [(0, float("nan")), (0, -1.0)]
    got = images.depth_preview(spark.createDataFrame(rows, "frame int, depth double")).collect()
    grey = sorted(r["grey"] for r in got)
    assert grey[0] == 0 and grey[-1] == 255 and grey[50] in range(110, 145)
    grids = spark.createDataFrame([(0, 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "frame long, h int, w int, depth array<double>")
    obs = spark.createDataFrame([(1, 0, 0.5, 0.0), (2, 0, 1.5, 0.6), (3, 0, 99.0, 99.0), (4, 0, -3.0, 0.0)], "track long, frame long, u double, v double")
    assert {r["track"]: r["d"] for r in images.pixel_lookup(obs, grids).collect()} == {1: 1.0, 2: 6.0, 3: 6.0, 4: 1.0}
    assert images.strided_points(grids, 2).count() == 2
    points = spark.createDataFrame([(float(i), 0.0, 0.0) for i in range(-50, 51)], "x double, y double, z double")
    fit = images.display_fit(points).first()
    assert fit["mx"] == 0.0 and 46 < fit["radius"] < 49


def test_a_pose_target_bridges_two_groups(spark):
    rng = np.random.default_rng(4)
    x = np.c_[rng.uniform(-2, 2, (200, 2)), rng.uniform(5, 9, 200)]
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    r, t = alignment._rodrigues(np.array([0.05, -0.1, 0.02])), np.array([0.2, -0.1, 0.3])
    p = (x @ r.T + t) @ k.T
    uv = p[:, :2] / p[:, 2:]
    land = spark.createDataFrame(pd.DataFrame({"track": range(200), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
    tracks = spark.createDataFrame(pd.DataFrame({"track": range(200), "frame": 7, "u": uv[:, 0], "v": uv[:, 1]}))
    cams = spark.createDataFrame([(7, 640, 480)], "frame long, w int, h int")
    target = bridges.pose_targets(land, tracks, cams).toPandas()
    assert target["held"].sum() >= bridges.HELD
    pose = bridges.solve_pose(target, k)
    assert alignment.angle(pose[0], r) < 1e-6
    scale = bridges.fit_scale({7: pose}, 7, target, (target[["x", "y", "z"]].to_numpy() @ r.T + t)[:, 2] / 2)
    assert abs(scale - 2) < 1e-9
    made = bridges.recover_bridges({7: target}, k, lambda frame, found: 50)
    assert made == [(7, 50)] and bridges.recover_bridges({7: target}, k, lambda frame, found: 3) == []
    camera = spark.createDataFrame([(7, 500.0, 500.0, 320.0, 240.0, [float(v) for v in r.T.ravel()], [float(v) for v in -r.T @ t])], "frame long, fx double, fy double, cx double, cy double, r array<double>, c array<double>")
    kept = bridges.restored_tracks(land, tracks, camera, spark.createDataFrame([(7, True)], "frame long, anchor boolean"))
    assert kept.count() == 200 and kept.where("bridges").count() == 0
    assert bridges.stable_landmarks(kept.withColumn("error", F.lit(1.0)), views=1).count() == 200


def test_anchor_component(spark):
    comps = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (6, 5)], "node long, root long")
    obs = spark.createDataFrame([(1, 0), (2, 0), (3, 5)], "track long, frame long")
    assert bridges.anchor_component(comps, obs, spark.createDataFrame([(5,), (6,)], "frame long")).first()["root"] == 5


def test_turned_cameras_agree_on_a_plane(spark):
    """Depths of one plane, seen by cameras of different rotation, centre and focal length, support each other; wrong ones don't."""
    from lumenframe.operators import dense
    from lumenframe.operators.alignment import _rodrigues

    w, h, cameras, pixels = 24, 18, [], []
    for f in range(3):
        r, c, fx, fy = _rodrigues(np.array([0.02 * f, 0.03 * f, -0.02 * f])), np.array([0.4 * f, 0.1 * f, 0.05 * f]), 30.0 + f, 31.0 - f
        cameras.append((f, fx, fy, 12.0, 9.0, *c.tolist(), r.ravel().tolist()))
        for y in range(h):
            for x in range(w):
                ray = r @ np.array([(x - 12.0) / fx, (y - 9.0) / fy, 1.0])
                pixels.append((f, x, y, float((10 - c[2]) / ray[2]), 0.5, 0.4, 0.3))
    cams = spark.createDataFrame(cameras, "frame long, fx double, fy double, cx double, cy double, c0 double, c1 double, c2 double, r array<double>")
    grid = spark.createDataFrame(pixels, "frame long, x long, y long, depth double, red double, green double, blue double")
    rows = dense.measure(grid.withColumn("z", grid["depth"]), grid, cams, w, h).toPandas()
    assert len(rows) > 1000 and rows["agree"].mean() > 0.9 and (rows["back"] - rows["z"]).abs().max() < 0.6
    out = dense.consensus(grid, cams, w, h).toPandas()
    inner = out[out["accepted"]]
    assert len(inner) > 300 and (inner["refined"] / inner["depth"] - 1).abs().max() < 0.02
    assert dense.measure(grid.withColumn("z", grid["depth"] * 1.2), grid, cams, w, h).where("agree").count() == 0
    assert dense.measure(grid.withColumn("z", grid["depth"]), grid.withColumn("blue", grid["blue"] + 1), cams, w, h).where("agree").count() == 0
    assert dense.measure(grid.withColumn("z", grid["depth"]), grid, cams.where("frame = 0"), w, h).count() == 0


def test_an_error_of_just_the_limit_is_kept(spark):
    land = spark.createDataFrame([(t, 1.0 + t / 7, 0.0, 3.0 + t / 11) for t in range(60)], "track long, x double, y double, z double")
    rows = [(t, 7, 507.0 * (1.0 + t / 7) / (3.0 + t / 11) + 320.0 + step, 240.0) for t in range(60) for step in (3 + 1e-11, 3.001)]
    tracks = spark.createDataFrame(rows, "track long, frame long, u double, v double")
    camera = spark.createDataFrame([(7, 507.0, 507.0, 320.0, 240.0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0])], "frame long, fx double, fy double, cx double, cy double, r array<double>, c array<double>")
    kept = bridges.restored_tracks(land, tracks, camera, spark.createDataFrame([(7, True)], "frame long, anchor boolean")).collect()
    assert sorted(r["track"] for r in kept) == list(range(60)) and any(r["error"] > 3 for r in kept)


def test_rotation_costs_by_blocks_equal_plain_ones(spark, monkeypatch):
    from lumenframe.operators import mapping

    monkeypatch.setattr(mapping, "BLOCK", 7)
    rng = np.random.default_rng(8)
    turns = [alignment._rodrigues(v) for v in rng.normal(size=(40, 3))]
    rows = spark.createDataFrame([(i, [float(v) for v in r.ravel()]) for i, r in enumerate(turns)], "frame long, r array<double>")
    costs = [sum(np.arccos(np.clip((np.trace(p.T @ q) - 1) / 2, -1, 1)) for q in turns) for p in turns]
    found = {r["frame"]: (r["cost"], r["medoid"]) for r in mapping.rotation_costs(rows).collect()}
    assert all(abs(found[i][0] - costs[i]) < 2e-5 for i in range(40)) and found[int(np.argmin(costs))][1]
    assert mapping._pairs_of_blocks(rows).count() == 36


def test_pairs_of_cameras_by_blocks_equal_plain_ones(spark, monkeypatch):
    from lumenframe.operators import mapping

    monkeypatch.setattr(mapping, "BLOCK", 7)
    rng = np.random.default_rng(8)
    c = rng.uniform(-9, 9, (40, 3))
    near = c * 0.5 + rng.normal(size=(40, 3)) * 0.8
    frame = lambda v: spark.createDataFrame([(i * 3, *map(float, r)) for i, r in enumerate(v)], "frame long, c0 double, c1 double, c2 double")
    got = {(r["i"], r["j"]): r["scale"] for r in mapping.center_scale_votes(frame(c), frame(near), 1.0, 0.5).collect()}
    want = {}
    for i in range(40):
        for j in range(i):
            t, s = c[i] - c[j], near[i] - near[j]
            if (t @ t) ** 0.5 > 1 and (s @ s) ** 0.5 > 0.5 and s @ t / ((s @ s) ** 0.5 * (t @ t) ** 0.5) >= 0.8:
                want[i * 3, j * 3] = s @ t / (s @ s)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = mapping.center_scale_votes(frame(c), frame(near), 1.0, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan


def test_many_matches_are_verified_in_parts(monkeypatch):
    from lumenframe.operators import ransac

    rng, sizes = np.random.default_rng(6), []
    x = np.c_[rng.uniform(-2, 2, (9000, 2)), rng.uniform(5, 9, 9000)]
    turn = alignment._rodrigues(np.array([0.02, 0.1, -0.03]))
    y = x @ turn.T + (0.4, 0.1, -0.2)
    a, b = (500 * p[:, :2] / p[:, 2:] + (320, 240) for p in (x, y))
    b[::5] += 40
    errors = ransac.errors
    monkeypatch.setattr(ransac, "errors", lambda model, m, a, b: sizes.append(len(m) * len(a)) or errors(model, m, a, b))
    name, n, *_, inside = ransac.verify(1, 2, a, b, (640, 480), (640, 480), hypotheses=250)
    assert name == "fundamental" and 7200 <= n < 7600 and inside.sum() == n
    assert max(sizes) <= 250 * ransac.MATCHES < 250 * len(a)
