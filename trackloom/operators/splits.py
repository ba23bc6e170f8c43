"""Dataset splits, batches and frame picks: the few decisions that depend on the ones before, per small group."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut


def assign_splits(sources: DataFrame, ratios: dict[str, float], seed: int, pins: DataFrame | None = None) -> DataFrame:
    """match, split: whole matches to splits, within each domain greedily to the split that lacks most of its share.

    sources: match, domain, images.  pins: match, split, decided by hand; a match pinned to two splits is an error.
    Largest matches first, ties by a seeded hash.  A split of ratio 0 gets nothing but its pins.  The work is per domain.
    """
    total = sources.groupBy("domain", "match").agg(F.sum("images").alias("images"))
    if pins is None:
        pinned = total.withColumn("pin", F.lit(None).cast("string"))
    else:
        p = pins.groupBy("match").agg(F.max("split").alias("pin"), F.countDistinct("split").alias("k"))
        checked = p.select("match", F.when(F.col("k") > 1, F.raise_error(F.concat(F.lit("pinned twice: "), F.col("match").cast("string")))).otherwise(F.col("pin")).alias("pin"))
        pinned = total.join(checked, "match", "left")
    names = sorted(ratios)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        whole = group["images"].sum()
        have = {n: int(group.loc[group["pin"] == n, "images"].sum()) for n in names}
        out = [(m, p) for m, p in zip(group["match"], group["pin"]) if isinstance(p, str)]
        free = [(-int(k), hashlib.md5(f"{m}:{seed}".encode()).hexdigest(), m) for m, k, p in zip(group["match"], group["images"], group["pin"]) if not isinstance(p, str)]
        for size, _, m in sorted(free):
            n = max((x for x in names if ratios[x] > 0), key=lambda x: (ratios[x] * whole - have[x], x))
            have[n] -= size
            out.append((m, n))
        return pd.DataFrame(out, columns=["match", "split"])

    kind = total.schema["match"].dataType.simpleString()
    return pinned.groupBy("domain").applyInPandas(run, f"match {kind}, split string")


def diverse_batch(images: DataFrame, size: int, seed: int, width: int = 1000) -> DataFrame:
    """image_id, source, turn: each source's share of ``size`` (by its number of images, one at least), picked for priority and unlike hashes.

    The first is the one of highest priority, then always the one of highest hash distance to its nearest pick plus priority (64 while no
    pick has a hash, 32 for an image without one; ties: priority, then a seeded hash of the id).  A source within its share gives all its images.

    A value only falls as picks are added.  So each round takes every source's ``width`` best images, which Spark finds before its shuffle,
    and picks among them while the best is no worse than the last of them was: no other image could win.  The rest waits for the next round.
    """
    n = images.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = images.count()
    share = F.bround(F.col("n") * (min(size, total) / max(1, total))).cast("int")
    quota = n.select("source", F.least(F.col("n"), F.greatest(F.lit(1), share)).cast("int").alias("quota"), "n")
    keyed = images.select("image_id", "source", "dhash", F.col("priority").cast("double").alias("priority"), F.md5(F.concat_ws(":", "image_id", F.lit(seed))).alias("tie"))
    rows = cut(keyed.join(quota, "source"))
    kinds = [images.schema[c].dataType.simpleString() for c in ("image_id", "source")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["value", "priority", "tie"], ascending=[False, False, True])
        value, priority, tie = g["value"].to_numpy(float), g["priority"].to_numpy(float), g["tie"].to_numpy()
        known, h = g["known"].to_numpy(bool), g["hash"].to_numpy(np.int64).view(np.uint64)
        done, all_there = int(g["done"].iloc[0]), len(g) < width
        bound = (-value[-1], -priority[-1], tie[-1])
        left, picked = np.ones(len(g), bool), []
        while done + len(picked) < int(g["quota"].iloc[0]) and left.any():
            at = np.flatnonzero(left & (value == value[left].max()))
            k = min(at, key=lambda i: (-priority[i], tie[i]))
            if not all_there and (-value[k], -priority[k], tie[k]) > bound:
                break
            picked.append(k)
            left[k] = False
            far = np.bitwise_count(h ^ h[k]).astype(float) if known[k] else np.full(len(g), 64.0)
            value = np.minimum(value, priority + np.where(known, far, 32.0))
        ids = g["image_id"].to_numpy()[picked]
        return pd.DataFrame({"image_id": ids, "source": g["source"].iloc[0], "turn": done + np.arange(len(ids)), "pick": pd.array([int(h[i].astype(np.int64)) if known[i] else None for i in picked], "Int64")})

    picked = None
    while True:
        if picked is None:
            state = rows.withColumn("done", F.lit(0)).withColumn("value", F.col("priority") + 64.0)
        else:
            so_far = picked.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("done"), F.collect_list("pick").alias("picks"))
            near = F.array_min(F.transform("picks", lambda p: F.bit_count(p.bitwiseXOR(F.col("dhash")))))
            far = F.when(F.col("dhash").isNull(), 32).otherwise(F.coalesce(near, F.lit(64)))
            open_ = rows.join(so_far.join(quota, "source").where("done < quota").select("source", "done", "picks"), "source")
            state = open_.join(picked.select("source", "image_id"), ["source", "image_id"], "left_anti").withColumn("value", F.col("priority") + far)
        best = Window.partitionBy("source").orderBy(F.desc("value"), F.desc("priority"), "tie")
        top = state.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= width)
        new = top.select("image_id", "source", F.coalesce("dhash", F.lit(0)).cast("long").alias("hash"), F.col("dhash").isNotNull().alias("known"), "priority", "tie", "quota", "done", "value").groupBy("source").applyInPandas(run, f"image_id {kinds[0]}, source {kinds[1]}, turn int, pick long")
        picked = cut(new if picked is None else picked.union(new))
        behind = picked.groupBy("source").agg(F.count(F.lit(1)).alias("done")).join(quota, "source").where("done < quota")
        if not behind.limit(1).count():
            return picked.select("image_id", "source", "turn")


def frame_candidates(features: DataFrame, interval: int = 30, burst_ratio: float = 2.5, blur_pct: float = 20.0, warm_up: int = 300) -> DataFrame:
    """features (seq, frame, motion, sharpness, ...) with why, of frames worth labelling: every interval-th, and bursts of motion over burst_ratio times the median of the 300 frames before.

    Frames blurrier than the blur_pct percentile of a sequence's first warm_up frames are left out.  Both order statistics are exact, over windows.
    """
    by = Window.partitionBy("seq").orderBy("frame")
    values = F.sort_array(F.collect_list("motion").over(by.rowsBetween(-300, -1)))  # sorts doubles as such; array_sort calls a comparator for each two
    n = F.size("values")
    median = (F.get("values", F.expr("(size(values) - 1) div 2").cast("int")) + F.get("values", F.expr("size(values) div 2").cast("int"))) / 2
    rows = features.withColumn("values", values).withColumn("median", F.when(n > 0, median)).drop("values").withColumn("place", F.row_number().over(by))
    least = rows.where(F.col("place") <= warm_up).groupBy("seq").agg(F.percentile("sharpness", F.lit(blur_pct / 100)).alias("least"))
    why = F.when(F.col("frame") % interval == 0, "interval").when((F.col("median") > 0) & (F.col("motion") > burst_ratio * F.col("median")), "burst")
    return rows.withColumn("why", why).where("why is not null").join(least, "seq").where("sharpness >= least").drop("place", "least", "median")


def pick_frames(features: DataFrame, interval: int = 30, burst_ratio: float = 2.5, blur_pct: float = 20.0, warm_up: int = 300, near: int = 6, last: int = 20) -> DataFrame:
    """seq, frame, why of the candidates that aren't within ``near`` bits (dhash) of one of the last ``last`` picks: a fold of a sequence's candidates alone."""
    one = F.struct("frame", "dhash", "why")
    each = frame_candidates(features, interval, burst_ratio, blur_pct, warm_up).groupBy("seq").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<struct<frame:int,why:string>>").alias("out"))

    def step(acc, x):
        seen = F.exists(acc["kept"], lambda h: F.bit_count(h.bitwiseXOR(x["dhash"])) <= near)
        kept = F.slice(F.array_prepend(acc["kept"], x["dhash"]), 1, last)
        return F.when(seen, acc).otherwise(F.struct(kept.alias("kept"), F.array_append(acc["out"], F.struct(x["frame"].cast("int").alias("frame"), x["why"].alias("why"))).alias("out")))

    return each.select("seq", F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("seq", "o.frame", "o.why")


def content_windows(videos: DataFrame, fractions: list[float], length: int) -> DataFrame:
    """seq, window, first, last: windows of ``length`` frames at fixed fractions of each video (seq, frames), cut to it, none that meets the one before."""
    at = F.posexplode(F.array(*(F.lit(float(f)) for f in fractions)))
    rows = videos.select("seq", "frames", at.alias("window", "fraction")).withColumn("first", F.floor(F.col("fraction") * F.greatest(F.col("frames") - length, F.lit(0))).cast("int"))
    rows = rows.withColumn("last", F.least(F.col("first") + length, F.col("frames")).cast("int") - 1)
    before = F.expr("lag(last) over (partition by seq order by window)")
    return rows.withColumn("before", before).where("before is null or first > before").select("seq", "window", "first", "last")


def uniform_frames(videos: DataFrame, k: int) -> DataFrame:
    """seq, i, frame: frame floor((i + 0.5) * frames / k) for i below k."""
    return videos.select("seq", "frames", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).select("seq", "i", F.expr(f"CAST(((2 * i + 1) * frames) div {2 * k} AS INT)").alias("frame"))


def replace_picks(picks: DataFrame, videos: DataFrame, ahead: int = 8) -> DataFrame:
    """seq, frame, replacement of each leaking pick (seq, frame, leaks): the nearest frame of its video (seq, frames) that is free, in the order +1, -1, +2, -2, ...; null if none is.

    A frame is free if it is no pick and no earlier pick's replacement.  In rounds: every pick asks for its next frame that is no pick (an anti-join); of those that ask for one frame the earliest
    has it, though a still earlier one may come for it later, and the others go on.  That ends where going through the picks in order would.
    """
    taken = picks.select("seq", F.col("frame").alias("at")).distinct()
    asked = picks.where("leaks").select("seq", "frame").distinct().join(videos.select("seq", "frames"), "seq")
    state = cut(asked.select("seq", "frame", "frames", F.lit(0).alias("k"), F.lit(None).cast("int").alias("at"), F.lit(True).alias("goes_on")))
    while state.where("goes_on").limit(1).count():
        on = state.where("goes_on").withColumn("next", F.explode(F.sequence(F.col("k") + 1, F.col("k") + ahead)))
        off = F.expr("CAST((next + 1) div 2 AS INT)")
        on = on.withColumn("at", F.col("frame") + F.when(F.col("next") % 2 == 1, off).otherwise(-off)).where((F.col("at") >= 0) & (F.col("at") < F.col("frames")))
        best = on.join(taken, ["seq", "at"], "left_anti").groupBy("seq", "frame").agg(F.min(F.struct("next", "at")).alias("n"))
        moved = state.where("goes_on").drop("at").join(best, ["seq", "frame"], "left").select("seq", "frame", "frames", F.coalesce("n.next", F.col("k") + ahead).alias("k"), F.col("n.at").alias("at"))
        all_ = state.where("not goes_on").select("seq", "frame", "frames", "k", "at").unionByName(moved)
        first = F.row_number().over(Window.partitionBy("seq", "at").orderBy("frame")) == 1
        searching = F.col("at").isNull() & (F.col("k") < 2 * F.col("frames"))
        state = cut(all_.withColumn("goes_on", F.when(F.col("at").isNull(), searching).otherwise(~first)))
    return state.select("seq", "frame", F.col("at").alias("replacement"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str = "name") -> DataFrame:
    """names with source: that of the longest prefix (prefix, source) that a name begins with; null without one.

    An equi-join for each length that a prefix has: a name meets its own beginnings of these lengths alone.  Of equal prefixes the smallest source counts.
    """
    each = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("source").alias("source"))
    lengths = sorted(r.n for r in each.select(F.length("prefix").alias("n")).distinct().collect())  # a number for each length
    known = names.select(name).distinct()
    begun = known.withColumn("n", F.explode(F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(name)))).withColumn("prefix", F.substring(F.col(name), F.lit(1), F.col("n")))
    found = begun.join(each, "prefix").groupBy(name).agg(F.max_by("source", "n").alias("source"))
    return names.join(found, name, "left")
