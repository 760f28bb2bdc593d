import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe import hooks
from lumenframe.__main__ import main
from lumenframe.plans import repair
from lumenframe.plans.scratch import clear, saved, shared_folder
from lumenframe.sinks import writers
from lumenframe.sources import cache, readers


def test_natural_order(spark, tmp_path):
    for n in ("f10.png", "f2.PNG", "f1.jpg", "notes.txt", "F02b.jpeg"):
        (tmp_path / n).write_bytes(n.encode())
    got = [r["path"].rsplit("/", 1)[1] for r in readers.read_images(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == ["f1.jpg", "f2.PNG", "F02b.jpeg", "f10.png"]
    assert readers.read_images(spark, str(tmp_path), first=2).count() == 2


def test_manifest_checks(spark, tmp_path):
    head = {"format_version": 1, "source_width": 1920, "source_height": 1080, "width": 960, "height": 540, "decoder": "x", "max_edge": 960, "timestamp_origin": 0.0, "storage": "images"}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(head))
    frames = spark.createDataFrame([(0, 0, 0.0), (1, 2, 0.1)], "candidate long, source_frame long, ts_s double")
    assert readers.read_manifest(spark, str(path), frames)["width"] == 960
    with pytest.raises(readers.RecordError):
        readers.read_manifest(spark, str(path), frames.unionByName(spark.createDataFrame([(2, 3, 0.1)], frames.schema)))
    path.write_text(json.dumps(head | {"format_version": 2}))
    with pytest.raises(readers.RecordError):
        readers.read_manifest(spark, str(path))


def test_pairs_round_trip_and_checks(spark, tmp_path):
    match = {"a": [1.0, 2.0], "b": [3.0, 4.0], "source_feature": 5, "target_feature": 6, "inlier": True, "confidence": 0.5}
    (tmp_path / "p.json").write_text(json.dumps({"source": 0, "target": 1, "verification": "F", "pair_kind": "temporal", "matches": [match, match]}) + "\n")
    pairs = readers.read_pairs(spark, str(tmp_path / "p.json"), frames=2)
    m = readers.matches_of(pairs)
    assert m.count() == 2 and m.first()["bv"] == 4.0
    readers.check_keypoints(m)
    with pytest.raises(readers.RecordError):
        readers.read_pairs(spark, str(tmp_path / "p.json"), frames=1)
    with pytest.raises(readers.RecordError):
        readers.check_keypoints(m.union(m.withColumn("au", F.lit(9.0))))
    writers.write_pairs(pairs, str(tmp_path / "out"))
    assert readers.read_pairs(spark, str(tmp_path / "out")).collect() == pairs.collect()


def test_tracks_and_cameras(spark, tmp_path):
    obs = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 3, 4.0, 5.0), (2, 0, 9.0, 9.0)], "track long, frame long, u double, v double")
    writers.write_tracks(obs, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.read_tracks(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, obs.collect()))
    readers.check_tracks(obs)
    with pytest.raises(readers.RecordError):
        readers.check_tracks(obs.union(obs.withColumn("track", F.lit(7).cast("long"))))
    good = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    cams = lambda r: spark.createDataFrame([(0, 0.0, 1.0, 1.0, 0.0, 0.0, 2, 2, [float(x) for x in r], [0.0, 0.0, 0.0])], "frame long, ts_s double, fx double, fy double, cx double, cy double, w int, h int, r array<double>, c array<double>")
    readers.check_cameras(cams(good))
    for bad in ([-1.0, 0, 0, 0, 1, 0, 0, 0, 1], [1.0, 0.1, 0, 0, 1, 0, 0, 0, 1], good[:8]):
        with pytest.raises(readers.RecordError):
            readers.check_cameras(cams(bad))
    writers.trajectory(cams(good), str(tmp_path / "trajectory"))
    assert spark.read.json(str(tmp_path / "trajectory")).first()["image_size_hw"] == [2, 2]


def test_point_clouds(spark, tmp_path):
    points = spark.createDataFrame([(0.5, 1e-7, 123456789.0, 1, 2, 3), (1.0, 2.0, 3.0, 255, 0, 9)], "x double, y double, z double, red int, green int, blue int")
    assert writers.ascii_ply(points.orderBy("x").toLocalIterator(), str(tmp_path / "a.ply")) == 2
    assert (tmp_path / "a.ply").read_text().splitlines()[-2:] == ["0.5 1e-07 1.23457e+08 1 2 3", "1 2 3 255 0 9"]
    assert writers.binary_ply(points, str(tmp_path / "b.ply"), ["x"]) == 2
    body = (tmp_path / "b.ply").read_bytes().split(b"end_header\n")[1]
    assert len(body) == 30 and struct.unpack("<fffBBB", body[15:]) == (1.0, 2.0, 3.0, 255, 0, 9)
    with pytest.raises(ValueError):
        writers.document(str(tmp_path / "d.json"), {"x": float("nan")})


def test_publish_replaces_whole_tables(spark, tmp_path):
    writers.publish(spark.range(5), str(tmp_path / "t"))
    writers.publish(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_caches(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), {"a": 1}, make).count() == 3
    assert len(made) == 1 and cache.fingerprint({"a": 1, "b": 2}) == cache.fingerprint({"b": 2, "a": 1})
    held = spark.createDataFrame([("x", True), ("y", False)], "key string, sound boolean")
    wanted = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "key string")
    assert sorted(r["key"] for r in cache.misses(wanted, held).collect()) == ["y", "z"]


def test_scratch_tables(spark):
    df = saved(spark.range(4), "t")
    assert df.count() == 4 and shared_folder(spark).removeprefix("file://") in df.inputFiles()[0]
    clear(spark)


def test_repair_inserts_frames_at_weak_boundaries(spark):
    frames = spark.createDataFrame([(0, 0), (1, 10), (2, 20), (3, 60), (4, 70), (5, 80)], "frame long, candidate long")

    def match(f, pairs):
        """Every keypoint is seen along the video, but only across short gaps."""
        place = f.select("frame", "candidate")
        p = pairs.join(place.withColumnRenamed("frame", "source").withColumnRenamed("candidate", "cs"), "source").join(place.withColumnRenamed("frame", "target").withColumnRenamed("candidate", "ct"), "target")
        return p.where("ct - cs <= 20").withColumn("source_feature", F.explode(F.sequence(F.lit(0), F.lit(79)).cast("array<long>"))).select(
            "source", "target", "source_feature", F.col("source_feature").alias("target_feature"), F.lit(True).alias("inlier"), F.lit(1.0).alias("confidence")
        )

    done, tracks, history = repair.repair(frames, match, lambda added: added, share=1.0)
    assert history[0]["weak"] >= 1 and history[-1]["weak"] == 0 and 40 in [r["candidate"] for r in done.collect()]
    assert tracks.count() > 0


def test_estimators_skip_finished_rows(spark):
    hooks.register_estimator("double", lambda batches: (b.assign(window=b["window"] * 2) for b in batches), "window long")
    rows = spark.range(4).withColumnRenamed("id", "window")
    assert sorted(r[0] for r in hooks.estimate("double", rows, rows.where("window < 2")).collect()) == [4, 6]
    with pytest.raises(KeyError):
        hooks.estimate("none", rows)


def test_progress_never_stops_a_run():
    def fail(record):
        raise RuntimeError

    p = hooks.Progress(fail)
    p._send({}, always=True)
    assert p.seconds == float("inf")


def test_command_line(spark, sf, tmp_path, capsys):
    assert main(["list"]) == 0 and "loop_retrieval" in capsys.readouterr().out
    assert main(["run", "--input", sf, "--query", "camera_support", "--output", str(tmp_path / "o")]) == 0
    assert pd.read_parquet(tmp_path / "o").shape[0] == 10
    assert main(["run", "--input", sf, "--query", "nothing"]) == 1


def test_only_a_local_master_may_use_a_folder_of_its_own(spark, monkeypatch):
    from lumenframe.plans import scratch

    class Elsewhere:
        """A session on a cluster whose checkpoint folder is not set."""

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("sc", (), {"getCheckpointDir": lambda self: type("none", (), {"isEmpty": lambda self: True})()})()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Elsewhere)
    Elsewhere.conf.get = staticmethod(lambda key, default: "hdfs://shared/folder/")
    assert scratch.shared_folder(Elsewhere) == "hdfs://shared/folder"
    assert scratch.shared_folder(spark)


def test_a_step_drops_its_own_tables(spark):
    from lumenframe.plans import scratch

    with scratch.step(spark):
        kept, gone = saved(spark.range(5), "kept", keep=True), saved(spark.range(3), "gone")
        assert gone.count() == 3
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found|FAILED_READ_FILE"):
        gone.count()
