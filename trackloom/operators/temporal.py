"""Ball recovery over time, cuts, continuity, keyframes and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import BOX, KEY


def _seq():
    return Window.partitionBy("seq").orderBy("frame")


def _so_far():
    return _seq().rowsBetween(Window.unboundedPreceding, 0)


def _from_here():
    """This frame and all later ones, latest first: the last value over it is the nearest one ahead."""
    return Window.partitionBy("seq").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)


def cut_flags(frames: DataFrame, threshold: float = 30.0) -> DataFrame:
    """frames (seq, frame, sig: array) with cut: the mean absolute difference to the frame before is over the threshold (first: false)."""
    before = F.lag("sig").over(_seq())
    return frames.withColumn("cut", F.coalesce(g.mad(F.col("sig"), before) > threshold, F.lit(False)))


def hard_cuts(features: DataFrame, mad: float = 18.0, hcorr: float = 0.80) -> DataFrame:
    """features (seq, frame, sig, hist) with cut: both the pictures and their histograms of two adjacent frames differ."""
    last = F.lag("frame").over(_seq())
    far = (g.mad(F.col("sig"), F.lag("sig").over(_seq())) >= mad) & (g.ncc(F.col("hist"), F.lag("hist").over(_seq())) <= hcorr)
    return features.withColumn("cut", F.coalesce((F.col("frame") == last + 1) & far, F.lit(False)))


def continuity_runs(breaks: DataFrame, lag: int = 8, need: int = 300) -> DataFrame:
    """seq, first, last, length, long_enough of maximal runs of frames; breaks: seq, frame, broken (a discontinuity begins there).

    After a break the next run begins lag + 1 frames later.
    """
    skip = F.max(F.when(F.col("broken"), F.col("frame") + lag + 1)).over(_so_far())
    ok = breaks.withColumn("skip", skip).where("skip is null or frame >= skip")
    runs = ok.withColumn("run", F.col("frame") - F.row_number().over(_seq()))
    found = runs.groupBy("seq", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("length"))
    return found.select("seq", "first", "last", "length", (F.col("length") >= need).alias("long_enough"))


def select_ball(cands: DataFrame, frames: DataFrame, accept: float = 0.25, floor: float = 0.10, max_gap: float = 0.6, gate: float = 60.0, growth: float = 40.0, width: float = 640.0, look_ahead: bool = False) -> DataFrame:
    """seq, frame, state, box, conf: the ball of every frame, with where it comes from.

    The best candidate (confidence, then smaller x1) of accept or more is observed.  Else, up to max_gap seconds after the last
    anchor, a candidate of the floor or more within gate + growth * missed frames of the place that the last two anchors
    predict is recovered_low_conf: the nearest, then the most confident.  Recovered boxes are anchors too.  A cut forgets them.
    With look_ahead, a candidate within the gate of the next frame's observed ball counts too, unless a cut begins that frame; each
    candidate has the smaller of its two distances.  Else the frame is unknown.  A fold over each stretch between cuts: what it keeps depends on what it recovered before.
    """
    scale = width / 640.0
    near = cands.where(F.col("conf") >= floor).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), "x1", "y1", "x2", "y2", "conf"))).alias("cands"))
    rows = frames.select(*KEY, "ts", "dt", "cut").join(near, list(KEY), "left").withColumn("part", F.sum(F.col("cut").cast("int")).over(_so_far()))
    if look_ahead:
        top = F.get(F.filter("cands", lambda c: c["conf"] >= accept), F.lit(0))
        seen_at = F.when(top.isNotNull() & ~F.col("cut"), F.struct(((top["x1"] + top["x2"]) / 2).alias("x"), ((top["y1"] + top["y2"]) / 2).alias("y")))
        rows = rows.withColumn("next", F.lead(seen_at).over(_seq()))
    item = F.struct("frame", "ts", "dt", "cands", *(["next"] if look_ahead else []))
    each = rows.groupBy("seq", "part").agg(F.array_sort(F.collect_list(item)).alias("frames"))
    point = "struct<t:double,x:double,y:double>"
    box = "struct<x1:double,y1:double,x2:double,y2:double,conf:double>"
    start = F.struct(F.lit(None).cast(point).alias("a"), F.lit(None).cast(point).alias("b"), F.array().cast(f"array<struct<frame:int,state:string,box:{box}>>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        found = F.filter(f["cands"], lambda c: c["conf"] >= accept)
        seen = F.when(F.size(found) > 0, found[0])
        a, b = acc["a"], acc["b"]  # the last two anchors, b the later
        gap = f["ts"] - b["t"]
        move = F.when(a.isNotNull() & (b["t"] > a["t"]), gap / (b["t"] - a["t"])).otherwise(0.0)
        px, py = b["x"] + F.coalesce((b["x"] - a["x"]) * move, F.lit(0.0)), b["y"] + F.coalesce((b["y"] - a["y"]) * move, F.lit(0.0))
        missed = F.greatest(F.lit(0.0), F.round(gap / f["dt"]) - 1)
        far = lambda c: F.sqrt(F.pow((c["x1"] + c["x2"]) / 2 - px, 2) + F.pow((c["y1"] + c["y2"]) / 2 - py, 2))
        by_past = lambda c: F.when(b.isNotNull() & (gap <= max_gap + 1e-9) & (far(c) <= (gate + growth * missed) * scale), far(c))
        to_next = lambda c: F.sqrt(F.pow((c["x1"] + c["x2"]) / 2 - f["next"]["x"], 2) + F.pow((c["y1"] + c["y2"]) / 2 - f["next"]["y"], 2))
        by_next = lambda c: F.when(to_next(c) <= gate * scale, to_next(c))
        d = (lambda c: F.least(by_past(c), by_next(c))) if look_ahead else by_past
        weak = F.filter(f["cands"], lambda c: (c["conf"] < accept) & d(c).isNotNull())
        again = F.array_min(F.transform(weak, lambda c: F.struct(d(c).alias("d"), (-c["conf"]).alias("o"), c["x1"].alias("x1"), c["y1"].alias("y1"), c["x2"].alias("x2"), c["y2"].alias("y2"), c["conf"].alias("conf"))))
        take = lambda c: F.struct(*(c[n].alias(n) for n in (*BOX, "conf")))
        got = F.when(seen.isNotNull(), take(seen)).when(again.isNotNull(), take(again)).otherwise(F.lit(None).cast(box))
        state = F.when(seen.isNotNull(), "observed").when(again.isNotNull(), "recovered_low_conf").otherwise("unknown")
        at = F.struct(f["ts"].alias("t"), ((got["x1"] + got["x2"]) / 2).alias("x"), ((got["y1"] + got["y2"]) / 2).alias("y"))
        hit = got.isNotNull()
        row = F.struct(f["frame"].alias("frame"), state.alias("state"), got.alias("box"))
        return F.struct(F.when(hit, b).otherwise(a).alias("a"), F.when(hit, at).otherwise(b).alias("b"), F.array_append(acc["out"], row).alias("out"))

    out = each.select("seq", F.explode(F.aggregate("frames", start, step)["out"]).alias("r"))
    return out.select("seq", "r.frame", "r.state", *(F.col(f"r.box.{c}").alias(c) for c in (*BOX, "conf")))


def interpolate_ball(sel: DataFrame, frames: DataFrame, max_gap: float = 0.4) -> DataFrame:
    """sel with unknown stretches between two anchors filled by time: no cut after the left one up to the right one, and the
    stretch (from the left anchor to the frame before the right one) is over 0 and at most max_gap seconds.  conf stays null."""
    rows = sel.join(frames.select(*KEY, "ts", "dt", "cut"), list(KEY)).withColumn("cuts", F.sum(F.col("cut").cast("int")).over(_so_far()))
    anchor = F.when(F.col("state") != "unknown", F.struct("ts", "dt", "cuts", *BOX))
    rows = rows.withColumn("left", F.last(anchor, ignorenulls=True).over(_so_far())).withColumn("right", F.last(anchor, ignorenulls=True).over(_from_here()))
    span = F.col("right.ts") - F.col("left.ts")
    gap = span - F.col("right.dt")
    ok = (F.col("state") == "unknown") & (F.col("left.cuts") == F.col("right.cuts")) & (gap > 1e-9) & (gap <= max_gap + 1e-9)
    share = (F.col("ts") - F.col("left.ts")) / span
    filled = {c: F.when(ok, F.col(f"left.{c}") + (F.col(f"right.{c}") - F.col(f"left.{c}")) * share).otherwise(F.col(c)).alias(c) for c in BOX}
    return rows.select(*KEY, F.when(ok, "interpolated_short_gap").otherwise(F.col("state")).alias("state"), *filled.values(), "conf")


def hold_last(ball: DataFrame, max_gap: int = 15) -> DataFrame:
    """ball with the last known box repeated for at most max_gap frames; held_for counts them (0: known).  For display, never evidence."""
    known = F.when(F.col("x1").isNotNull(), F.struct("frame", *BOX))
    last = ball.withColumn("l", F.last(known, ignorenulls=True).over(_so_far())).withColumn("age", F.col("frame") - F.col("l.frame"))
    fresh = F.col("age") <= max_gap
    return last.select(*KEY, *(F.when(fresh, F.col(f"l.{c}")).alias(c) for c in BOX), F.when(fresh, F.col("age")).alias("held_for"))


def expand_keyframes(shapes: DataFrame) -> DataFrame:
    """Boxes of every frame from keyframes (seq, track_id, frame, box, outside, occluded): linear between two, none after an outside one, the last alone."""
    nxt = F.lead(F.struct("frame", *BOX)).over(Window.partitionBy("seq", "track_id").orderBy("frame"))
    rows = shapes.withColumn("n", nxt).where("not outside")
    rows = rows.withColumn("at", F.explode(F.sequence(F.col("frame"), F.coalesce(F.col("n.frame") - 1, F.col("frame")))))
    share = F.coalesce((F.col("at") - F.col("frame")) / (F.col("n.frame") - F.col("frame")), F.lit(0.0))
    return rows.select("seq", "track_id", F.col("at").alias("frame"), *((F.col(c) + F.coalesce(F.col(f"n.{c}") - F.col(c), F.lit(0.0)) * share).alias(c) for c in BOX), "occluded")


def identity_gaps(boxes: DataFrame) -> DataFrame:
    """seq, track_id, gap_from, gap_to: frames missing between a track's first and last."""
    before = F.lag("frame").over(Window.partitionBy("seq", "track_id").orderBy("frame"))
    return boxes.select("seq", "track_id", "frame").distinct().withColumn("b", before).where("frame - b > 1").select("seq", "track_id", (F.col("b") + 1).alias("gap_from"), (F.col("frame") - 1).alias("gap_to"))


def reappearances(boxes: DataFrame, k: float = 3.0) -> DataFrame:
    """Where a track comes back after a gap more than k widths away: seq, track_id, frame, moved."""
    before = F.lag(F.struct("frame", *BOX)).over(Window.partitionBy("seq", "track_id").orderBy("frame"))
    moved = g.dist(g.center(g.box()), g.center(F.col("b")))
    rows = boxes.withColumn("b", before).withColumn("moved", moved)
    return rows.where((F.col("frame") - F.col("b.frame") > 1) & (F.col("moved") > k * (F.col("b.x2") - F.col("b.x1")))).select("seq", "track_id", "frame", "moved")


def keep_ball_id(sel: DataFrame, tracks: DataFrame) -> DataFrame:
    """Ball rows with the id that the frame's ball track already has, else 1; frames without a box have no row."""
    had = tracks.where("cls = 'ball'").groupBy(*KEY).agg(F.min("track_id").alias("had"))
    return sel.where("x1 is not null").join(had, list(KEY), "left").withColumn("track_id", F.coalesce("had", F.lit(1))).drop("had")
