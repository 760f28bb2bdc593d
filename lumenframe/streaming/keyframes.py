"""Keyframe selection: one state machine, folded over batches or kept as streaming state.

Frames of a video come in order of candidate number with rising times. Match quality is a function of the anchor,
which the machine itself chooses, so it is asked for as ``quality(video, anchor, current)``: from a table keyed by
pair, or from a callback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import require

#: inliers, inlier ratio, coverage, displacement
Quality = tuple[int, float, float, float]
DECISIONS = "video long, candidate long, ts_s double, decision string, reference long, inliers long, bridge long"
SELECTED = "video long, candidate long, reason string"


@dataclass(frozen=True)
class Thresholds:
    """When a frame is taken. The names are the keys of the configuration file, so they are fixed."""

    minimum_features: int = 120
    minimum_sharpness: float = 20.0
    minimum_inliers: int = 60
    minimum_inlier_ratio: float = 0.4
    minimum_coverage: float = 0.25
    motion: float = 0.035
    retention: float = 0.65
    minimum_interval: float = 0.2
    tracking_timeout: float = 2.0
    minimum_keyframes: int = 3

    def __post_init__(self) -> None:
        for share in (self.minimum_inlier_ratio, self.minimum_coverage, self.retention):
            require(0 <= share <= 1, "a share must lie in [0, 1]")
        require(min(self.minimum_features, self.minimum_inliers, self.minimum_sharpness, self.motion, self.minimum_interval) >= 0, "thresholds must not be negative")
        require(self.tracking_timeout > 0, "tracking_timeout must be positive")


@dataclass
class Selector:
    """Decides frame by frame; ``state`` is all it remembers."""

    quality: Callable[[int, int, int], Quality]
    options: Thresholds
    video: int = 0
    anchor: tuple[int, float] | None = None
    good: tuple[int, float] | None = None
    best: int = 0
    count: int = 0
    broken: bool = False
    last_time: float | None = None
    selected: list[tuple[int, str]] = field(default_factory=list)

    @property
    def state(self) -> tuple:
        a, g = self.anchor or (-1, 0.0), self.good or (-1, 0.0)
        return (a[0], a[1], g[0], g[1], self.best, self.count, self.broken, self.last_time if self.last_time is not None else float("-inf"))

    def load(self, state: tuple) -> Selector:
        self.anchor = (state[0], state[1]) if state[0] >= 0 else None
        self.good = (state[2], state[3]) if state[2] >= 0 else None
        self.best, self.count, self.broken, self.last_time = int(state[4]), int(state[5]), bool(state[6]), state[7]
        return self

    def _take(self, frame: tuple[int, float], reason: str) -> None:
        self.anchor, self.best = frame, 0
        self.count += 1
        self.selected.append((frame[0], reason))

    def _reliable(self, q: Quality) -> bool:
        o = self.options
        return q[0] >= o.minimum_inliers and q[1] >= o.minimum_inlier_ratio and q[2] >= o.minimum_coverage

    def feed(self, candidate: int, ts: float, features: int, sharpness: float) -> tuple | None:
        """Decision, reference, inliers and bridged frame; None once tracking broke. Times that don't rise are an error."""
        if self.broken:
            return None
        if self.last_time is not None and not ts > self.last_time:
            raise ValueError(f"timestamps must rise strictly: {ts} after {self.last_time} in video {self.video}")
        self.last_time = ts
        o, now = self.options, (candidate, ts)
        reference = inliers = bridge = None
        if features < o.minimum_features or sharpness < o.minimum_sharpness:
            decision = "reject_quality"
        elif self.anchor is None:
            self._take(now, "first_usable")
            self.good, decision = now, "first_usable"
        else:
            q = self.quality(self.video, self.anchor[0], candidate)
            if not self._reliable(q) and self.good and self.good[0] > self.anchor[0]:
                bridge = self.good[0]
                self._take(self.good, "before_tracking_loss")
                q = self.quality(self.video, self.anchor[0], candidate)
            reference, inliers, decision = self.anchor[0], int(q[0]), "unreliable_matches"
            if self._reliable(q):
                self.best = max(self.best, int(q[0]))
                dropped, moved = q[0] < o.retention * self.best, q[3] >= o.motion
                decision = "redundant"
                if ts - self.anchor[1] >= o.minimum_interval and (dropped or moved):
                    decision = "overlap_drop" if dropped else "image_motion"
                    self._take(now, decision)
                self.good = now
        if self.good and ts - self.good[1] > o.tracking_timeout:
            self.broken, decision = True, "tracking_break"
        return decision, reference, inliers, bridge

    def finish(self) -> bool:
        """End of the video: the last good frame joins; whether the selection succeeded."""
        if not self.broken and self.good and self.anchor and self.good[0] != self.anchor[0]:
            self._take(self.good, "last_usable")
        return not self.broken and self.count >= self.options.minimum_keyframes


def quality_gate(frames: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Frames with enough features that are sharp enough: what selection looks at at all."""
    return frames.where((F.col("feature_count") >= thresholds.minimum_features) & (F.col("sharpness") >= thresholds.minimum_sharpness))


def select_keyframes(frames: DataFrame, quality: Callable[[int, int, int], Quality], options: Thresholds = Thresholds()) -> DataFrame:
    """Decisions for ``frames(video, candidate, ts_s, feature_count, sharpness)``, each video folded in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("candidate")
        machine = Selector(quality, options, int(pdf["video"].iloc[0]))
        out = []
        for row in pdf.itertuples(index=False):
            made = machine.feed(int(row.candidate), float(row.ts_s), int(row.feature_count), float(row.sharpness))
            if made is None:
                break
            out.append((machine.video, int(row.candidate), float(row.ts_s), *made))
        return pd.DataFrame(out, columns=["video", "candidate", "ts_s", "decision", "reference", "inliers", "bridge"]).astype({"reference": "Int64", "inliers": "Int64", "bridge": "Int64"})

    return frames.select("video", "candidate", "ts_s", "feature_count", "sharpness").groupBy("video").applyInPandas(fold, DECISIONS)


def selected_keyframes(decisions: DataFrame, minimum: int = 3) -> DataFrame:
    """(video, candidate, reason) of accepted frames of videos that succeeded: no break, at least ``minimum`` keyframes.

    A bridged frame is accepted just before the frame that lost it; the last good frame joins at the end.
    """
    accepted = decisions.where("decision IN ('first_usable', 'overlap_drop', 'image_motion')").select("video", "candidate", F.col("decision").alias("reason"))
    bridged = decisions.where("bridge IS NOT NULL").select("video", F.col("bridge").alias("candidate"), F.lit("before_tracking_loss").alias("reason"))
    good = decisions.where("decision IN ('first_usable', 'overlap_drop', 'image_motion', 'redundant')")
    last = good.groupBy("video").agg(F.max("candidate").alias("candidate")).withColumn("reason", F.lit("last_usable"))
    taken = accepted.unionByName(bridged)
    last = last.join(taken, ["video", "candidate"], "left_anti")
    broken = decisions.where("decision = 'tracking_break'").select("video").distinct()
    chosen = taken.unionByName(last).join(broken, "video", "left_anti")
    enough = chosen.groupBy("video").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    return chosen.join(enough.select("video"), "video", "left_semi")


def stream_keyframes(frames: DataFrame, quality: Callable[[int, int, int], Quality], options: Thresholds = Thresholds()) -> DataFrame:
    """The same decisions over a streaming ``frames``: the machine's state is kept per video, in the state store.

    Late frames are an error, as rising times are demanded; no watermark drops them.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Keep(StatefulProcessor):
        def init(self, handle) -> None:
            schema = "a long, at double, g long, gt double, best long, count long, broken boolean, time double"
            self.held = handle.getValueState("machine", schema)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
            machine = Selector(quality, options, int(key[0]))
            if self.held.exists():
                machine.load(self.held.get())
            out = []
            pdf = pd.concat(list(rows)).sort_values("candidate")
            for row in pdf.itertuples(index=False):
                made = machine.feed(int(row.candidate), float(row.ts_s), int(row.feature_count), float(row.sharpness))
                if made is None:
                    break
                out.append((machine.video, int(row.candidate), float(row.ts_s), *made))
            self.held.update(machine.state)
            if out:
                yield pd.DataFrame(out, columns=["video", "candidate", "ts_s", "decision", "reference", "inliers", "bridge"]).astype({"reference": "Int64", "inliers": "Int64", "bridge": "Int64"})

        def close(self) -> None:
            pass

    return frames.groupBy("video").transformWithStateInPandas(statefulProcessor=Keep(), outputStructType=DECISIONS, outputMode="Append", timeMode="None")


def read_frame_stream(spark, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Frame metadata files as they arrive; a bounded number of files a trigger keeps batches small."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
