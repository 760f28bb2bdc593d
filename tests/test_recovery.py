import numpy as np
import pandas as pd
import pytest
from test_state_and_geometry import scene

from lumenframe.operators import alignment, windows
from lumenframe.operators.map_builder import MapBuilder, assemble

EYE, ZERO = np.eye(3), np.zeros(3)
TURN, SHIFT = alignment._rodrigues(np.array([0.1, 0.2, 0.1])), np.array([1.0, -2.0, 0.5])


def predicted(r, c, obs, frames, gauges, seed=9):
    """Cameras and depths of frames; ``gauges`` gives (scale, rotation, shift) of each frame's prediction."""
    rng = np.random.default_rng(seed)
    cams = pd.DataFrame({"frame": frames, "fx": 600.0, "fy": 600.0, "cx": 320.0, "cy": 240.0})
    cams["r"] = [(gauges(f)[1] @ r[f] @ alignment._rodrigues(rng.normal(size=3) * 0.002)).ravel() for f in frames]
    cams["c"] = [gauges(f)[0] * gauges(f)[1] @ c[f] + gauges(f)[2] for f in frames]
    rows = obs[obs["frame"].isin(frames)]
    return cams, rows.assign(depth=rows["depth"] * rows["frame"].map(lambda f: gauges(f)[0]))[["track", "frame", "depth"]]


def even_steps(model, c):
    got = model.cameras.sort_values("frame")
    steps = np.linalg.norm(np.diff(np.stack(got["c"].to_numpy()), axis=0), axis=1) / np.linalg.norm(np.diff(c[got["frame"].astype(int)], axis=0), axis=1)
    return steps.std() / steps.mean() < 0.05


@pytest.mark.parametrize("count", [5, 8, 9, 10, 15, 16, 17, 31, 64])
def test_parts_equal_the_table(spark, count):
    frames = [3 * f for f in range(count)]
    table = windows.subwindows(spark.createDataFrame([(0, f) for f in frames], "window long, frame long")).toPandas()
    assert windows.parts(frames) == [sorted(g["frame"]) for _, g in table.groupby("part")]


@pytest.mark.parametrize("again", [False, True])
def test_parts_of_a_rejected_window_join(again):
    x, r, c, obs = scene(n=14, m=220)
    obs = obs[(obs["frame"] < 12) | (obs["track"] < 24)]  # too few for a bridge
    plain = lambda f: (1.0, EYE, ZERO)
    wrong = lambda f: (2.5, TURN, SHIFT) if f < 12 else (2.5, EYE, SHIFT + 40.0)  # the last two cameras fit nothing
    asked = []

    def predict(window, cut):
        asked.append((window, cut))
        return [predicted(r, c, obs, p, lambda f: (1.7, TURN, SHIFT)) for p in cut]

    b = MapBuilder(obs[["track", "frame", "u", "v"]])
    plan = {0: predicted(r, c, obs, list(range(8)), plain), 1: predicted(r, c, obs, list(range(4, 14)), wrong)}
    attempts = assemble(b, plan, lambda builder, waiting: sorted(waiting), predict if again else None)
    first = attempts[attempts["window"] == 1].iloc[0]
    assert first["status"] == "rejected" and ("saved_subset", "accepted") in set(zip(attempts["kind"], attempts["status"], strict=True))
    if again:
        assert asked == [(1, [list(range(4, 12)), list(range(6, 14))])]
        assert len(b.map.cameras) == 14 and attempts["kind"].iloc[-1] == "smaller_prediction"
    else:
        assert sorted(b.map.cameras["frame"]) == list(range(12))
    assert even_steps(b.map, c)
    other = MapBuilder(obs[["track", "frame", "u", "v"]])
    assemble(other, plan, predict=predict if again else None)
    assert sorted(other.map.cameras["frame"]) == sorted(b.map.cameras["frame"])


def test_parts_of_a_window_without_a_common_track_are_aligned_each():
    """Tracks of two kinds share the frames 0 to 3 alone, so the later window falls into two groups with gauges of their own."""
    x, r, c, obs = scene(n=16, m=400)
    one, two = [*range(7), 10, 11, 12], [*range(4), 7, 8, 9, 13, 14, 15]
    obs = obs[np.where(obs["track"] % 2 == 0, obs["frame"].isin(one), obs["frame"].isin(two))]
    gauges = lambda f: (2.5, TURN, SHIFT) if f in one else (0.8, TURN.T, -SHIFT)
    b = MapBuilder(obs[["track", "frame", "u", "v"]])
    plan = {0: predicted(r, c, obs, list(range(10)), lambda f: (1.0, EYE, ZERO)), 1: predicted(r, c, obs, list(range(4, 16)), gauges)}
    attempts = assemble(b, plan, lambda builder, waiting: sorted(waiting))
    assert attempts["status"].tolist() == ["accepted", "accepted"] and len(b.map.cameras) == 16
    assert even_steps(b.map, c)


@pytest.mark.parametrize("seen", [True, False])
def test_a_bridge_joins_a_part_without_a_frame_of_the_map(seen):
    """The last four frames come in a gauge of their own; only tracks of the others' landmarks in them tell where they are."""
    x, r, c, obs = scene(n=14, m=500)
    obs = obs[np.where(obs["track"] < 300, (obs["frame"] < 10) | seen, obs["frame"] >= 10)]
    gauges = lambda f: (1.0, EYE, ZERO) if f < 10 else (1.6, TURN, SHIFT)
    b = MapBuilder(obs[["track", "frame", "u", "v"]])
    plan = {0: predicted(r, c, obs, list(range(8)), gauges), 1: predicted(r, c, obs, list(range(4, 14)), gauges)}
    attempts = assemble(b, plan, lambda builder, waiting: sorted(waiting))
    second = attempts[attempts["window"] == 1].iloc[0]
    if seen:
        assert second["status"] == "accepted" and len(b.map.cameras) == 14 and even_steps(b.map, c)
    else:
        assert second["status"] == "rejected" and b.map.cameras["frame"].max() < 10
