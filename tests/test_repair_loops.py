from pyspark.sql import functions as F

from lumenframe.plans import repair


def test_repair_finds_loops_and_asks_for_proof(spark):
    """Frames 14 to 17 look at the places of frames 0 to 3 again; frame 22 looks like frame 10, but no pair near says so too."""
    frames = spark.range(24).select(F.col("id").alias("frame"), (F.col("id") * 2).alias("candidate"))
    place = lambda c: F.when(F.col(c).between(14, 17), F.col(c) - 14).when(F.col(c) == 22, 10).otherwise(F.col(c))
    asked = []

    def describe(f):
        one_hot = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when(i == place("frame"), 1.0).otherwise(0.0))
        return f.select("frame", F.col("frame").cast("double").alias("ts_s"), one_hot.alias("emb"))

    def match(f, pairs):
        """All points are seen along the video, but nothing joins the frames up to 9 with later ones save loops; one pair wasn't asked for."""
        asked.append({(r["source"], r["target"]) for r in pairs.collect()})
        both = pairs.select("source", "target").where("(target < 10 OR source > 9) AND target - source <= 4")
        both = both.unionByName(pairs.select("source", "target").where((F.col("target") - F.col("source") > 4) & (place("source") == place("target"))))
        both = both.unionByName(spark.createDataFrame([(6, 21)], "source long, target long"))
        k = F.col("source_feature")
        x, y = k % 10 * 64.0, F.floor(k / 10) * 60.0
        points = both.withColumn("source_feature", F.explode(F.sequence(F.lit(0), F.lit(79)).cast("array<long>")))
        return points.select("source", "target", k, k.alias("target_feature"), F.lit(True).alias("inlier"), F.lit(1.0).alias("confidence"), x.alias("au"), y.alias("av"), x.alias("bu"), y.alias("bv"))

    search = {"each": 1, "apart_frames": 8, "apart_seconds": 5.0}
    _, tracks, history = repair.repair(frames, match, lambda added: added, rounds=0, describe=describe, size=(640, 480), search=search)
    true = {(i, i + 14) for i in range(4)}
    assert true | {(10, 22)} <= asked[0] and history[0]["verified_loops"] == 6 and history[0]["corroborated_loops"] == 4
    assert {(r["source"], r["target"]) for r in history[-1]["loop_links"].select("source", "target").distinct().collect()} == true
    assert tracks.where("frame IN (0, 14)").groupBy("head_frame", "head_kp").count().where("count = 2").count() == 80
    # without the images' size nothing can prove a loop
    tracks = repair.repair(frames, match, lambda added: added, rounds=0)[1]
    assert tracks.where("frame IN (0, 14)").groupBy("head_frame", "head_kp").count().where("count = 2").count() == 0
