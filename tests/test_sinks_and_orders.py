import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe import hooks
from lumenframe.catalog import QUERIES
from lumenframe.operators import images, scan
from lumenframe.plans.ordered import bare, ordered, percentiles, previous, ranked, running
from lumenframe.sinks import writers
from lumenframe.sources import readers


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_orders_over_ranges_equal_one_window(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"t": rng.permutation(n) * 3 - 50, "v": rng.integers(-9, 9, n)})
    df = spark.createDataFrame(pdf, "t long, v long").repartition(5)
    want = pdf.sort_values("t").reset_index(drop=True)
    rows = ordered(df, "t")
    rows = previous(previous(ranked(rows), F.col("t"), "one"), F.col("t"), "three", 3)
    rows = running(running(running(rows, F.col("v"), F.sum, "total"), F.col("v"), F.max, "high"), F.col("v"), F.min, "ahead", back=True)
    got = bare(rows).toPandas().sort_values("t").reset_index(drop=True)
    assert got["rank"].tolist() == list(range(n))
    for name, back in (("one", 1), ("three", 3)):
        assert [None if pd.isna(x) else x for x in got[name]] == [None] * min(back, n) + want["t"].tolist()[: max(0, n - back)]
    assert got["total"].tolist() == want["v"].cumsum().tolist() and got["high"].tolist() == want["v"].cummax().tolist()
    assert got["ahead"].tolist() == want["v"][::-1].cummin()[::-1].tolist()


def test_requested_frames_are_all_there_or_an_error(spark):
    frames = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "ticks long, candidate long")
    ask = lambda *t: spark.createDataFrame([(x,) for x in t], "ticks long")
    assert {r["candidate"] for r in scan.requested_frames(frames, ask(10, 30, 30)).collect()} == {0, 2}
    with pytest.raises(ValueError, match="1 requested frames are missing, the first at tick 25"):
        scan.requested_frames(frames, ask(10, 25))
    with pytest.raises(ValueError, match="exclude"):
        scan.requested_frames(frames, ask(10), count=3)


def test_packets_that_cannot_be_split(spark):
    index = lambda rows: scan.packet_index(spark.createDataFrame(rows, "ticks long, is_key boolean, is_discard boolean")).first()
    assert tuple(index([(1, True, False), (2, False, False), (0, False, True)])) == (2, 1, 1, 1, 2, True)
    assert not index([(1, False, False), (2, True, False)])["eligible"]
    assert not index([(1, True, False), (1, True, False)])["eligible"]
    assert not index([(1, True, False), (None, False, False)])["eligible"]


def test_merged_sections_are_checked(spark):
    frames = spark.createDataFrame([(i, i * 10, 64, 48) for i in range(6)], "candidate long, ticks long, w int, h int")
    scan.check_merge(frames, frames)
    for wrong, what in ((frames.where("candidate <> 3"), "5 frames"), (frames.withColumn("w", F.col("w") + (F.col("candidate") == 2).cast("int")), "dimensions"), (frames.withColumn("ticks", F.col("ticks") + (F.col("candidate") == 4).cast("int")), "first at 4")):
        with pytest.raises(ValueError, match=what):
            scan.check_merge(frames, wrong)


def test_a_failed_publication_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.publish(spark.range(3), path)
    with pytest.raises(Exception, match="boom"):
        writers.publish(spark.range(5).select(F.raise_error(F.lit("boom")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    writers.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_dense_points_replace_sparse_ones(spark, tmp_path):
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 255, 0, 9), (0.5, 1.0, 2.0, 1, 2, 3)], "x double, y double, z double, red int, green int, blue int")
    path = str(tmp_path / "cloud.ply")
    assert writers.publish_cloud(points, path, points.limit(0)) == {"cloud": "sparse", "points": 2}
    assert writers.publish_cloud(points, path, points.where("x = 1")) == {"cloud": "dense", "points": 1}
    assert (tmp_path / "cloud.ply").read_bytes().endswith(np.array([1, 2, 3], "<f4").tobytes() + bytes([255, 0, 9]))


def test_depth_frames_and_loop_links_come_back(spark, tmp_path):
    rows = [(0, 0, 0, 2.0, 3, True), (0, 1, 0, 4.0, 2, True), (0, 1, 1, 6.0, 0, False), (1, 0, 0, 5.0, 2, True)]
    writers.write_depth_frames(spark.createDataFrame(rows, "frame long, x long, y long, refined double, support long, accepted boolean"), str(tmp_path / "d"))
    got = {r["frame"]: r for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert (got[0]["w"], got[0]["h"], got[0]["depth"], got[0]["support"]) == (2, 2, [2.0, 4.0, 0.0, 6.0], [3, 2, 0, 0])
    assert got[0]["preview"][2] == got[0]["preview"][3] == 0 and got[1]["depth"] == [5.0]
    links = spark.createDataFrame([(7, 1, 9), (7, 2, 9), (8, 3, 4)], "track long, source long, target long")
    writers.write_loop_links(links, str(tmp_path / "l"))
    assert sorted(map(tuple, readers.read_loop_links(spark, str(tmp_path / "l")).collect())) == sorted(map(tuple, links.collect()))
    seen = spark.createDataFrame([(7, 1), (7, 2), (7, 9), (8, 3)], "track long, frame long")
    with pytest.raises(readers.RecordError, match="target does not see"):
        readers.read_loop_links(spark, str(tmp_path / "l"), seen)


def test_stage_times_add_up_and_viewers_see_the_last():
    times = hooks.StageTimes()
    for _ in range(2):
        with times.stage("match"):
            pass
    assert times.document()["stage_entries"] == {"match": 2} and times.seconds["match"] >= 0
    recent = hooks.Recent(2, 3)
    for k in (2, 10, 4):
        recent.add(list(range(k)))
    assert list(recent.samples) == [[0, 4, 8], [0, 2]]


def test_predictions_come_back_and_images_are_looked_at(spark, tmp_path):
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    cameras = spark.createDataFrame([(w, f, 600.0, 600.0, 320.0, 240.0, unit, [float(f), 0.0, 0.0]) for w in (0, 1) for f in (w, w + 1)], readers.CAMERAS)
    depths = spark.createDataFrame([(w, w, 5, 2.5) for w in (0, 1)], readers.DEPTHS)
    writers.write_windows(cameras, depths, str(tmp_path))
    back = readers.read_windows(spark, str(tmp_path))
    assert back[0].count() == 4 and sorted(map(tuple, back[1].select(depths.columns).collect())) == sorted(map(tuple, depths.collect()))
    writers.write_windows(cameras.unionAll(cameras), depths, str(tmp_path))
    with pytest.raises(readers.RecordError, match="twice"):
        readers.read_windows(spark, str(tmp_path))
    png, jpeg = bytes.fromhex("89504E470D0A1A0A0000"), bytes.fromhex("FFD8FFE000")
    images = spark.createDataFrame([("a/1.png", png), ("a/2.JPG", jpeg), ("a/3.jpeg", png), ("a/4.png", b""), ("a/5.png", None)], "path string, content binary")
    assert {r["path"] for r in readers.unreadable_images(images).collect()} == {"a/3.jpeg", "a/4.png", "a/5.png"}
    with pytest.raises(readers.RecordError, match="unreadable"):
        readers.check_images(images)


def test_a_requested_frame_comes_without_others_of_its_tick(spark):
    frames = spark.createDataFrame([(10, 0, 84), (10, 1, 85), (20, 2, 93), (20, 3, 93)], "ticks long, candidate long, feature_count int")
    assert {r["candidate"] for r in scan.requested_frames(frames, frames.where("feature_count % 9 = 3")).collect()} == {0, 2, 3}
    with pytest.raises(ValueError):
        scan.requested_frames(frames, spark.createDataFrame([(10, 2)], "ticks long, candidate long"))


def test_percentiles_by_counts_equal_the_gathered_ones(spark):
    rng = np.random.default_rng(2)
    values = [(float(a), float(b) if b > 1 else None) for a, b in zip(rng.normal(size=301).round(1), rng.integers(0, 9, 301), strict=True)]
    rows = spark.createDataFrame([*values, (float("nan"), None)], "a double, b double").repartition(5)
    for share in (0.0, 0.02, 0.5, 0.95, 1.0):
        want = rows.agg(F.percentile("a", share).alias("a"), F.percentile("b", share).alias("b")).first()
        got = percentiles(rows, {"a": F.col("a"), "b": F.col("b")}, share)
        assert repr(got.first()) == repr(want)
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert percentiles(rows.where("false"), {"a": F.col("a")}, 0.5).first()["a"] is None
    points = rows.select(F.col("a").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert "percentile" not in images.display_fit(points)._jdf.queryExecution().optimizedPlan().toString()
    assert images.display_fit(points.where("false")).count() == 0


def test_rasters_of_previews_are_made_once_a_frame(spark, sf):
    plan = QUERIES["preview_points"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
