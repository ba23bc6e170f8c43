"""Speed, distance and possession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import KEY, attach_segment, nearest_human


def speed_distance(points: DataFrame, fps: float, window: int = 5, px_per_m: float = 12.0) -> DataFrame:
    """seq, track_id, frame, speed (km/h), distance (m, running): over windows [0, 5], [5, 10], … that share their borders.

    A window needs the track at both ends; the last one ends at the sequence's last frame.  A frame of two windows
    has the later one's values.  A window of no length has speed 0.
    """
    last = points.groupBy("seq").agg(F.max("frame").alias("n1"))
    at = points.select("seq", "track_id", "frame", "px", "py").join(last, "seq")
    start = at.where(F.col("frame") % window == 0).withColumn("end", F.least(F.col("frame") + window, F.col("n1")))
    stop = points.select("seq", "track_id", F.col("frame").alias("end"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    w = start.join(stop, ["seq", "track_id", "end"]).withColumn("m", g.dist(g.point(F.col("px"), F.col("py")), g.point(F.col("qx"), F.col("qy"))) / px_per_m)
    dt = (F.col("end") - F.col("frame")) / F.lit(float(fps))
    w = w.withColumn("speed", F.when(dt > 0, F.col("m") / dt * 3.6).otherwise(0.0))
    run = Window.partitionBy("seq", "track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("distance", F.sum("m").over(run)).select("seq", "track_id", F.col("frame").alias("start"), "end", "speed", "distance")
    each = w.withColumn("frame", F.explode(F.sequence("start", "end")))
    best = each.groupBy("seq", "track_id", "frame").agg(F.max_by(F.struct("speed", "distance"), "start").alias("v"))
    return best.join(points.select("seq", "track_id", "frame"), ["seq", "track_id", "frame"]).select("seq", "track_id", "frame", "v.speed", "v.distance")


def metric_speed(points: DataFrame, segments: DataFrame, step: int, fps: float) -> DataFrame:
    """Displacement (m) and speed (m/s) over ``step`` frames, only where both ends lie in one calibrated segment; else null."""
    placed = attach_segment(points.select("seq", "track_id", "frame", "px", "py"), segments)
    placed = placed.withColumn("m", g.project(F.col("h"), g.point(F.col("px"), F.col("py")))).select("seq", "track_id", "frame", "seg_ord", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
    other = placed.select("seq", "track_id", (F.col("frame") - step).alias("frame"), F.col("seg_ord").alias("seg2"), F.col("mx").alias("nx"), F.col("my").alias("ny"))
    both = placed.join(other, ["seq", "track_id", "frame"])
    d = F.when(F.col("seg_ord") == F.col("seg2"), g.dist(g.point(F.col("mx"), F.col("my")), g.point(F.col("nx"), F.col("ny"))))
    return both.select("seq", "track_id", "frame", d.alias("displacement"), (d / (step / fps)).alias("speed"))


def possession(tracks: DataFrame, ball: DataFrame, frames: DataFrame, max_px: float = 70.0) -> DataFrame:
    """For every frame who has the ball: possessor_id and possessor_cls (null: nobody known) and team, 0 where unknown.  A goalkeeper may have it but has no team."""
    near = nearest_human(tracks, ball, max_px)
    team = F.coalesce(F.when(F.col("possessor_cls") == "goalkeeper", F.lit(0)).otherwise(F.col("team")), F.lit(0)).cast("int")
    return frames.select(*KEY).join(near, list(KEY), "left").select(*KEY, "possessor_id", "possessor_cls", team.alias("team"))


def possession_share(poss: DataFrame) -> DataFrame:
    """poss with each team's share of the frames so far in which a team had the ball (0 before the first)."""
    so_far = Window.partitionBy("seq").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    known = F.sum((F.col("team") > 0).cast("int")).over(so_far)
    share = lambda t: F.when(known > 0, F.sum((F.col("team") == t).cast("int")).over(so_far) / known).otherwise(0.0)
    return poss.withColumn("share1", share(1)).withColumn("share2", share(2))


def track_stats(tracks: DataFrame) -> DataFrame:
    """Per track: max_speed and max_distance (uncalibrated), appearances, and the first team it was given."""
    first = F.min_by("team", F.when(F.col("team").isNotNull(), F.col("frame")))
    return tracks.groupBy("seq", "track_id").agg(F.max("speed").alias("max_speed"), F.max("distance").alias("max_distance"), F.count(F.lit(1)).alias("appearances"), first.alias("team"))


def run_summary(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Per sequence: frames, distinct track ids, and tracks in its first frame."""
    n = frames.groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"))
    t = tracks.join(n.select("seq", "first"), "seq").groupBy("seq").agg(F.countDistinct("track_id").alias("track_ids"), F.sum((F.col("frame") == F.col("first")).cast("int")).alias("in_first_frame"))
    return n.select("seq", "frames").join(t, "seq", "left").na.fill(0)
