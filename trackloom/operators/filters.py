"""Filters and projections of detections and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

#: What detectors call the four classes.
ALIASES = {
    "player": "player", "players": "player", "person": "player", "goalkeeper": "goalkeeper", "goalie": "goalkeeper", "keeper": "goalkeeper",
    "referee": "referee", "ref": "referee", "ball": "ball", "football": "ball", "soccer ball": "ball", "sports ball": "ball",
}


def normalize_classes(dets: DataFrame, aliases: dict[str, str] = ALIASES, unmapped: str | None = None) -> DataFrame:
    """dets with cls by the alias table; a class outside it is dropped, or named ``unmapped`` where that is given."""
    pairs = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    named = dets.withColumn("cls", F.coalesce(F.element_at(pairs, F.lower(F.trim("cls"))), F.lit(unmapped)))
    return named.where("cls is not null")


def remap_classes(labels: DataFrame, exported: list[str], target: list[str]) -> DataFrame:
    """labels with cls_id of the exported list as that of the target list, by name; problem says why there is none."""
    name = F.element_at(F.array(*map(F.lit, exported)), F.col("cls_id") + 1)
    ids = F.create_map(*(F.lit(x) for i, n in enumerate(target) for x in (n, i)))
    known = F.col("cls_id").between(0, len(exported) - 1)
    name = F.when(known, name)
    new = F.element_at(ids, F.lower(F.trim(name)))
    return labels.withColumn("target_id", new).withColumn("problem", F.when(~known, "no such class").when(new.isNull(), F.concat(F.lit("unmapped "), name)))


def tag_confidence(dets: DataFrame, accept: float = 0.25, floor: float = 0.10) -> DataFrame:
    """dets of the floor and above, with the state observed or candidate_low_conf."""
    return dets.where(F.col("conf") >= floor).withColumn("state", F.when(F.col("conf") >= accept, "observed").otherwise("candidate_low_conf"))


def plausible(dets: DataFrame, min_w: float, max_w: float, min_ar: float, max_ar: float) -> DataFrame:
    """dets with the reason (null: none) why the box can't be what it is said to be."""
    b = g.box()
    ratio = F.when(g.height(b) > 0, g.width(b) / g.height(b))
    reason = F.when((g.width(b) <= 0) | (g.height(b) <= 0), "degenerate").when(g.width(b) < min_w, "too_narrow").when(g.width(b) > max_w, "too_wide").when(ratio < min_ar, "too_tall").when(ratio > max_ar, "too_flat")
    return dets.withColumn("reason", reason)


def accepted_only(tracks: DataFrame, conf: float = 0.25) -> DataFrame:
    return tracks.where(F.col("conf") >= conf)


def subsample(frames: DataFrame, n: int) -> DataFrame:
    """Every n-th frame, numbered anew; rates divide by n."""
    return frames.where(F.col("frame") % n == 0).withColumn("frame", F.expr(f"CAST(frame div {n} AS INT)"))


def add_position(tracks: DataFrame) -> DataFrame:
    """tracks with px, py: a ball's centre, else the foot point, cut to integers."""
    at = F.when(F.col("cls") == "ball", g.center_int(g.box())).otherwise(g.foot_int(g.box()))
    return tracks.withColumn("px", at["x"]).withColumn("py", at["y"])


def adjust_for_camera(tracks: DataFrame, camera: DataFrame) -> DataFrame:
    """tracks with ax, ay: the position without the camera's motion of that frame (null where it isn't known)."""
    return tracks.join(camera.select("seq", "frame", "dx", "dy"), ["seq", "frame"], "left").withColumn("ax", F.col("px") - F.col("dx")).withColumn("ay", F.col("py") - F.col("dy")).drop("dx", "dy")


def dominant_motion(flow: DataFrame, min_px: float = 5.0) -> DataFrame:
    """seq, frame, dx, dy: the largest displacement of a frame's valid features (ties: lowest feature), (0, 0) up to min_px and in frame 0."""
    length: Column = F.sqrt(F.pow("dx", 2) + F.pow("dy", 2))
    best = flow.where("valid").groupBy("seq", "frame").agg(F.max_by(F.struct("dx", "dy"), F.struct(length, -F.col("feature"))).alias("v"))
    still = (F.sqrt(F.pow("v.dx", 2) + F.pow("v.dy", 2)) <= min_px) | (F.col("frame") == 0)
    return best.select("seq", "frame", F.when(still, 0.0).otherwise(F.col("v.dx")).alias("dx"), F.when(still, 0.0).otherwise(F.col("v.dy")).alias("dy"))
