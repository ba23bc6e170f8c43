"""Greedy matching, duplicate suppression and linking of boxes.

Groups are the boxes of a frame (tens of them), groups are many: each is folded as a sorted array inside generated
expressions, so nothing leaves the JVM.  Track linking walks the frames of many stretches together and is the one pandas job here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.storage import cut
from .graph import connected_components
from .joins import BOX, KEY, adjacent_pairs, pairs_by_iou, side
from .linking import Linker


def take_in_order(pairs: DataFrame, key: list[str], order: list[Column], a: str, b: str, value: str) -> DataFrame:
    """Of each group's pairs, in order, those whose a and b are both still free."""
    item = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("v"))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("ua"), none.alias("ub"), F.array().cast("array<struct<a:bigint,b:bigint,v:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["ua"], x["a"]) & ~F.array_contains(acc["ub"], x["b"])
        one = F.array(F.struct(x["a"].cast("bigint").alias("a"), x["b"].cast("bigint").alias("b"), x["v"].cast("double").alias("v")))
        return F.when(free, F.struct(F.array_append(acc["ua"], x["a"].cast("bigint")).alias("ua"), F.array_append(acc["ub"], x["b"].cast("bigint")).alias("ub"), F.concat(acc["out"], one).alias("out"))).otherwise(acc)

    folded = pairs.groupBy(*key).agg(F.aggregate(F.sort_array(F.collect_list(item)), start, step)["out"].alias("m"))
    return folded.select(*key, F.explode("m").alias("m")).select(*key, F.col("m.a").alias(a), F.col("m.b").alias(b), F.col("m.v").alias(value))


def match_one_to_one(gt: DataFrame, preds: DataFrame, thr: float = 0.5, cost: str = "iou", by_class: bool = True, max_dist: float | None = None) -> DataFrame:
    """Greedy one-to-one matches of truth and predictions of a frame: highest IoU first (at least thr), or nearest centre first (under max_dist).

    Ties: truth id, then prediction id.  Columns: the key, g_det_id, p_det_id, and iou or d.
    """
    key = [*KEY, "cls"] if by_class else list(KEY)
    if cost == "iou":
        pairs = pairs_by_iou(side(gt, "g", tuple(key)).select(*key, "g_det_id", *(F.col(f"g_{c}").alias(c) for c in BOX)), side(preds, "p", tuple(key)).select(*key, "p_det_id", *(F.col(f"p_{c}").alias(c) for c in BOX)), tuple(key), thr)
        pairs = pairs.select(*key, F.col("a_g_det_id").alias("g_det_id"), F.col("b_p_det_id").alias("p_det_id"), "iou")
        return take_in_order(pairs, key, [-F.col("iou"), F.col("g_det_id"), F.col("p_det_id")], "g_det_id", "p_det_id", "iou")
    both = side(gt, "g", tuple(key)).join(side(preds, "p", tuple(key)), key).withColumn("d", g.dist(g.center(g.box("g_")), g.center(g.box("p_"))))
    near = both.where(F.col("d") < (max_dist or thr)).select(*key, "g_det_id", "p_det_id", "d")
    return take_in_order(near, key, [F.col("d"), F.col("g_det_id"), F.col("p_det_id")], "g_det_id", "p_det_id", "d")


def match_by_confidence(gt: DataFrame, preds: DataFrame, thr: float = 0.5, by_class: bool = True) -> DataFrame:
    """Every prediction, most confident first, takes its best free truth box of at least thr: p_det_id, conf, g_det_id (null: none), iou."""
    key = [*KEY, "cls"] if by_class else list(KEY)
    ids = preds.select(*key, F.col("det_id").alias("p_det_id"), "conf", *BOX)
    pairs = pairs_by_iou(ids, gt.select(*key, F.col("det_id").alias("g_det_id"), *BOX), tuple(key), thr)
    pairs = pairs.select(*key, F.col("a_p_det_id").alias("p_det_id"), F.col("a_conf").alias("conf"), F.col("b_g_det_id").alias("g_det_id"), "iou")
    # in the order of confidence, then IoU, while both are free: every prediction takes its best free box
    taken = take_in_order(pairs, key, [-F.col("conf"), F.col("p_det_id"), -F.col("iou"), F.col("g_det_id")], "p_det_id", "g_det_id", "iou")
    return ids.drop(*BOX).join(taken, [*key, "p_det_id"], "left").select(*key, "p_det_id", "conf", "g_det_id", "iou")


def _keep_apart(df: DataFrame, key: list[str], order: list[Column], same) -> DataFrame:
    """Rows of each group that, taken in order, are ``same`` as none kept before; det_id names a row."""
    item = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("det_id").alias("id"), *BOX)
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    kind = rows.schema["boxes"].dataType.simpleString()
    keep = F.aggregate("boxes", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: same(k, x)), acc).otherwise(F.array_append(acc, x)))
    return df.join(rows.select(F.explode(keep).alias("k")).select(F.col("k.id").alias("det_id")), "det_id", "left_semi")


def suppress_duplicates(dets: DataFrame, cls: str = "ball", iou: float = 0.70) -> DataFrame:
    """dets without boxes of one class that overlap a more confident one of their frame by iou or more; other classes stay."""
    mine = dets.where(F.col("cls") == cls)
    kept = _keep_apart(mine, list(KEY), [-F.col("conf"), F.col("det_id")], lambda a, b: g.iou(a, b) >= iou)
    return dets.where((F.col("cls") != cls) | F.col("cls").isNull()).unionByName(kept)


def merge_by_center(dets: DataFrame, radius: float = 10.0) -> DataFrame:
    """dets without boxes whose centre is within radius of a more confident one's (overlapping tiles see a thing twice)."""
    return _keep_apart(dets, list(KEY), [-F.col("conf"), F.col("det_id")], lambda a, b: g.dist(g.center(a), g.center(b)) <= radius)


def dedupe_labels(labels: DataFrame, iou: float = 0.90) -> DataFrame:
    """labels without exact repeats and, largest first, without near repeats of one class and image; key: seq, frame, cls."""
    first = Window.partitionBy(*KEY, "cls", *BOX).orderBy("det_id")
    exact = labels.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return _keep_apart(exact, [*KEY, "cls"], [-g.area(g.box()), F.col("det_id")], lambda a, b: g.iou(a, b) >= iou)


def agreement(ref: DataFrame, ann: DataFrame, thr: float = 0.5, loose: float = 0.8) -> DataFrame:
    """Every box of a reference and an annotation with its status: matched, loose (under ``loose``), role_differs, missing, extra."""
    m = match_one_to_one(ref, ann, thr, by_class=False)
    roles = m.join(ref.select(F.col("det_id").alias("g_det_id"), F.col("cls").alias("g_cls")), "g_det_id").join(ann.select(F.col("det_id").alias("p_det_id"), F.col("cls").alias("p_cls")), "p_det_id")
    status = F.when(F.col("g_cls") != F.col("p_cls"), "role_differs").when(F.col("iou") < loose, "loose").otherwise("matched")
    found = roles.select("g_det_id", "p_det_id", status.alias("status"))
    missing = ref.join(m, ref["det_id"] == m["g_det_id"], "left_anti").select(F.col("det_id").alias("g_det_id"), F.lit(None).cast("long").alias("p_det_id"), F.lit("missing").alias("status"))
    extra = ann.join(m, ann["det_id"] == m["p_det_id"], "left_anti").select(F.lit(None).cast("long").alias("g_det_id"), F.col("det_id").alias("p_det_id"), F.lit("extra").alias("status"))
    return found.unionByName(missing).unionByName(extra)


def adjacent_tracklets(boxes: DataFrame, min_iou: float = 0.4) -> DataFrame:
    """det_id, tracklet (its smallest det_id) and length: chains of boxes linked from frame to frame."""
    found = cut(connected_components(adjacent_pairs(boxes, min_iou), "a_det_id", "b_det_id"))
    # lengths are counted where there are links: a box without one is a tracklet by itself, so all boxes are dealt once
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("length"))
    named = found.join(sizes, "component").select(F.col("node").alias("det_id"), F.col("component").alias("tracklet"), "length")
    return boxes.select("det_id").join(named, "det_id", "left").select("det_id", F.coalesce("tracklet", "det_id").alias("tracklet"), F.coalesce("length", F.lit(1)).alias("length"))


def identity_map(tracks: DataFrame, gt: DataFrame, iou: float = 0.30, min_frames: int = 2, min_rate: float = 0.5, ratio: float = 2.0) -> DataFrame:
    """For each track its truth identity, or why it has none: too_short, no_support, low_support_rate, not_dominant, mapped, conflict_lost, conflict_tied.

    In each frame a track votes for its best overlapping truth id (ties: lowest).  The winner needs min_rate of the track's
    frames and ratio times the runner-up.  Of tracks with one identity that share a frame, the one with most votes keeps it;
    equal ones all lose it.
    """
    # equal boxes of a frame have one best identity, and of equal truth boxes the lowest identity wins: each place is compared once
    places = gt.groupBy(*KEY, *BOX).agg(F.min("gt_id").alias("gt_id"))
    pairs = pairs_by_iou(tracks.select(*KEY, *BOX).distinct(), places.select(*KEY, "gt_id", *BOX), KEY, iou)
    nearest = pairs.groupBy(*KEY, *(F.col(f"a_{c}").alias(c) for c in BOX)).agg(F.min(F.struct((-F.col("iou")).alias("o"), F.col("b_gt_id").alias("gt_id"))).alias("b"))
    best = tracks.select(*KEY, "track_id", *BOX).join(nearest, [*KEY, *BOX]).groupBy(*KEY, "track_id").agg(F.min("b")["gt_id"].alias("gt_id"))
    votes = best.groupBy("seq", "track_id", "gt_id").agg(F.count(F.lit(1)).alias("votes"))
    ranked = votes.withColumn("rk", F.row_number().over(Window.partitionBy("seq", "track_id").orderBy(F.desc("votes"), "gt_id")))
    top = ranked.groupBy("seq", "track_id").agg(F.max(F.when(F.col("rk") == 1, F.col("gt_id"))).alias("gt_id"), F.max(F.when(F.col("rk") == 1, F.col("votes"))).alias("votes"), F.max(F.when(F.col("rk") == 2, F.col("votes"))).alias("next"))
    size = tracks.groupBy("seq", "track_id").agg(F.countDistinct("frame").alias("frames"))
    all_ = size.join(top, ["seq", "track_id"], "left")
    reason = F.when(F.col("frames") < min_frames, "too_short").when(F.col("votes").isNull(), "no_support").when(F.col("votes") < min_rate * F.col("frames"), "low_support_rate").when(F.coalesce("next", F.lit(0)) * ratio > F.col("votes"), "not_dominant").otherwise("mapped")
    named = all_.withColumn("reason", reason)
    mapped = named.where("reason = 'mapped'").select("seq", "track_id", "gt_id", "votes")
    at = tracks.select("seq", "track_id", "frame").distinct().join(mapped, ["seq", "track_id"])
    other = at.select("seq", "frame", "gt_id", F.col("track_id").alias("rival"), F.col("votes").alias("rival_votes"))
    rivals = at.join(other, ["seq", "frame", "gt_id"]).where("track_id <> rival").select("seq", "track_id", "votes", "rival", "rival_votes").distinct()
    lost = rivals.groupBy("seq", "track_id").agg(F.max(F.when(F.col("rival_votes") > F.col("votes"), 2).when(F.col("rival_votes") == F.col("votes"), 1).otherwise(0)).alias("worst"))
    out = named.join(lost, ["seq", "track_id"], "left")
    reason = F.when(F.col("worst") == 2, "conflict_lost").when(F.col("worst") == 1, "conflict_tied").otherwise(F.col("reason"))
    return out.select("seq", "track_id", "frames", "votes", reason.alias("reason")).join(mapped.select("seq", "track_id", "gt_id"), ["seq", "track_id"], "left").withColumn("gt_id", F.when(F.col("reason") == "mapped", F.col("gt_id")))


HELD = 1 << 19  # boxes that wait for the end of their tracks before it is asked which have ended


def _numbered(values: pd.Series, known: dict) -> np.ndarray:
    """A number for each value, the same one whenever it comes again."""
    codes, names = pd.factorize(values)
    return np.array([known.setdefault(v, len(known)) for v in names], np.int64)[codes]


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(frame, group, det_id, box (4 x n), conf) of each frame of rows in order of frame and det_id; a group is a sequence and class."""
    seqs, kinds, rest = {}, {}, None
    for batch in batches:
        if not len(batch):
            continue
        part = (batch["frame"].to_numpy(np.int64), (_numbered(batch["seq"], seqs) << 32) + _numbered(batch["cls"], kinds), batch["det_id"].to_numpy(np.int64), batch[list(BOX)].to_numpy(float).T, batch["conf"].to_numpy(float))
        frame, *columns = part if rest is None else (np.concatenate(x, -1) for x in zip(rest, part))
        edge = [0, *(np.flatnonzero(frame[1:] != frame[:-1]) + 1).tolist()]
        for a, b in zip(edge, edge[1:]):
            order = a + np.argsort(columns[0][a:b], kind="stable")
            yield int(frame[a]), *(c[..., order] for c in columns)
        rest = (frame[edge[-1] :], *(c[..., edge[-1] :] for c in columns))  # the next batch may go on with it
    if rest is not None:
        order = np.argsort(rest[1], kind="stable")
        yield int(rest[0][0]), *(c[..., order] for c in rest[1:])


def _told(n: np.ndarray, det: np.ndarray, least: int) -> pd.DataFrame:
    """det_id and name of the boxes of tracks n that have so many."""
    order = np.argsort(n, kind="stable")
    n, det = n[order], det[order]
    edge = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else np.empty(0, np.int64)
    size = np.diff(np.r_[edge, len(n)])
    name = np.repeat(np.minimum.reduceat(det, edge) + 1, size) if len(n) else det
    told = np.repeat(size >= least, size)
    return pd.DataFrame({"det_id": det[told], "track_id": name[told]})


def _walk(linker: Linker, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """det_id and track_id of the boxes of told tracks, as these end."""
    held, count, ask = [], 0, HELD
    for frame, group, ids, boxes, conf in _frames(batches):
        n = linker.advance(frame, group, ids, boxes, conf)
        held.append((n[n > 0], ids[n > 0]))
        count += len(held[-1][0])
        if count > ask:
            n, ids = (np.concatenate(x) for x in zip(*held))
            live = np.isin(n, linker.n)
            yield _told(n[~live], ids[~live], linker.min_hits)
            held, count = [(n[live], ids[live])], int(live.sum())
            ask = max(HELD, 2 * count)
    if held:
        yield _told(*(np.concatenate(x) for x in zip(*held)), linker.min_hits)


def link_tracks(dets: DataFrame, fps: float, high: float = 0.6, **rules) -> DataFrame:
    """dets with track_id: identities within a sequence and class by the steps of ``Linker`` (and its rules), null where a box belongs to none.

    A sequence and class is cut wherever no box occurs for longer than a track may be out of sight, as no track crosses such a gap; the
    stretches between are dealt apart.  A task walks all of its stretches together, a frame of them all in each step, and keeps the live tracks and
    the ids of their boxes.  A track's name is the smallest det_id of its boxes + 1, so no two sequences share one.
    """
    budget = Linker(fps, high, **rules).budget
    before = F.lag("frame").over(Window.partitionBy("seq", "cls").orderBy("frame"))
    frames = dets.select("seq", "cls", "frame").distinct().withColumn("starts", F.coalesce((F.col("frame") - before > budget).cast("int"), F.lit(0)))
    frames = frames.withColumn("stretch", F.sum("starts").over(Window.partitionBy("seq", "cls").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _walk(Linker(fps, high, **rules), batches)

    rows = dets.select(*KEY, "det_id", *BOX, "conf", "cls").join(frames.select("seq", "cls", "frame", "stretch"), ["seq", "cls", "frame"])
    found = rows.repartition("seq", "cls", "stretch").sortWithinPartitions("frame", "det_id").drop("stretch").mapInPandas(run, "det_id long, track_id long")
    return dets.join(found, "det_id", "left")
