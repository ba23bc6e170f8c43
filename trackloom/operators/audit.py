"""Audits of collections, proposals and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.storage import cut
from .joins import KEY, near_hashes, side
from .running import running_sums


def inventory(labels: DataFrame) -> DataFrame:
    """Per source and problem the label rows that have it: out_of_range, out_of_bounds, zero_area, unknown_class; "ok" for the rest.

    labels: source, cls_id, cx, cy, w, h (normalised), classes (their number in that source).
    """
    inside = F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & F.col("w").between(0, 1) & F.col("h").between(0, 1)
    edge = (F.col("cx") - F.col("w") / 2 < 0) | (F.col("cx") + F.col("w") / 2 > 1) | (F.col("cy") - F.col("h") / 2 < 0) | (F.col("cy") + F.col("h") / 2 > 1)
    rules = {"out_of_range": ~inside, "out_of_bounds": inside & edge, "zero_area": F.col("w") * F.col("h") == 0, "unknown_class": ~F.col("cls_id").between(0, F.col("classes") - 1)}
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    rows = labels.select("source", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ok")))).alias("problem"))
    return rows.groupBy("source", "problem").agg(F.count(F.lit(1)).alias("n"))


def multi_counts(boxes: DataFrame, cls: str) -> DataFrame:
    """How many frames hold 0, 1, 2, … boxes of a class, among frames with any box."""
    per = boxes.groupBy(*KEY).agg(F.sum((F.col("cls") == cls).cast("int")).alias("boxes"))
    return per.groupBy("boxes").agg(F.count(F.lit(1)).alias("frames"))


def metric_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new, delta of two metric tables (metric, value); a side that is missing is null."""
    return old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full_outer").withColumn("delta", F.col("new") - F.col("old"))


def missed_with_proposal(gt: DataFrame, accepted: DataFrame, raw: DataFrame, iou: float = 0.5) -> DataFrame:
    """Per class: truth boxes that no accepted box covers by iou, and how many of them a raw proposal does."""
    best = lambda t, name: side(gt, "g").join(side(t, "p"), list(KEY)).where("g_cls = p_cls").groupBy("g_det_id").agg(F.max(g.iou(g.box("g_"), g.box("p_"))).alias(name))
    rows = gt.select("cls", F.col("det_id").alias("g_det_id")).join(best(accepted, "a"), "g_det_id", "left").join(best(raw, "r"), "g_det_id", "left")
    missed = F.coalesce(F.col("a") < iou, F.lit(True))
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("truth"), F.sum(missed.cast("int")).alias("missed"), F.sum((missed & F.coalesce(F.col("r") >= iou, F.lit(False))).cast("int")).alias("with_proposal"))


def cost_curve(cands: DataFrame, targets: list[float], images: int) -> DataFrame:
    """For each recall target the highest confidence that reaches it, and how many proposals an image that costs.

    cands: conf, hit (1: confirmed).  Recall is of the confirmed ones; candidates of one confidence come together.
    """
    per = cands.groupBy("conf").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    summed = running_sums(per.withColumn("all", F.lit(0)), ["all"], [F.desc("conf")], {"proposals": "n", "found": "hits"})
    total = F.broadcast(per.agg(F.sum("hits").alias("total")).withColumn("all", F.lit(0)))  # one row
    rows = summed.join(total, "all").select("conf", "proposals", (F.col("found") / F.col("total")).alias("recall"))
    each = rows.withColumn("target", F.explode(F.filter(F.array(*(F.lit(float(t)) for t in targets)), lambda t: t <= F.col("recall") + 1e-12)))
    best = each.groupBy("target").agg(F.max_by(F.struct("conf", "proposals", "recall"), "conf").alias("b"))
    return best.select("target", F.col("b.conf").alias("threshold"), (F.col("b.proposals") / images).alias("per_image"), F.col("b.recall").alias("recall"))


def triage(boxes: DataFrame, preds: DataFrame, kits: DataFrame, iou: float = 0.5) -> DataFrame:
    """det_id, label, agreement of a box from two signals: the class of the best overlapping prediction, and its kit (kits: det_id, kit).

    Both agree: that label, "both"; one speaks: its label, "one"; they differ: AMBIGUOUS, "differ"; neither: AMBIGUOUS, "none".
    """
    near = side(boxes, "b").join(side(preds, "p"), list(KEY)).withColumn("v", g.iou(g.box("b_"), g.box("p_"))).where(F.col("v") >= iou)
    best = near.groupBy(F.col("b_det_id").alias("det_id")).agg(F.max_by("p_cls", F.struct("v", -F.col("p_det_id"))).alias("seen"))
    rows = boxes.select("det_id").join(best, "det_id", "left").join(kits.select("det_id", "kit"), "det_id", "left")
    s, k = F.col("seen"), F.col("kit")
    agreement = F.when(s.isNull() & k.isNull(), "none").when(s.isNull() | k.isNull(), "one").when(s == k, "both").otherwise("differ")
    label = F.when(agreement.isin("both", "one"), F.coalesce(s, k)).otherwise("AMBIGUOUS")
    return rows.select("det_id", label.alias("label"), agreement.alias("agreement"))


def clean_subset(triaged: DataFrame, level: int) -> DataFrame:
    """Images all of whose boxes are clean: level 1 nothing ambiguous, 2 also no single signal, 3 also no referee."""
    ok: Column = F.col("label") != "AMBIGUOUS"
    if level >= 2:
        ok &= F.col("agreement") == "both"
    if level >= 3:
        ok &= F.col("label") != "referee"
    return triaged.groupBy("image").agg(F.bool_and(ok).alias("clean"), F.count(F.lit(1)).alias("boxes")).where("clean").select("image", "boxes")


def kit_modes(colors: DataFrame, width: float = 15.0, share: float = 0.05, least: int = 3) -> DataFrame:
    """Per run and role the hue buckets with at least max(least, share) boxes: bucket, n, and the median colour."""
    rows = colors.withColumn("bucket", F.floor(F.col("h") / width).cast("int"))
    n = rows.groupBy("run", "role").agg(F.count(F.lit(1)).alias("all"))
    b = rows.groupBy("run", "role", "bucket").agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, F.lit(0.5)).alias(c) for c in ("h", "s", "v")))
    return b.join(n, ["run", "role"]).where((F.col("n") >= least) & (F.col("n") >= F.col("all") * share)).drop("all")


#: The eight orientations of an n x n signature in row order, as index expressions of (row, column).
_TURNS = ("r * {n} + c", "c * {n} + {m} - r", "({m} - r) * {n} + {m} - c", "({m} - c) * {n} + r", "r * {n} + {m} - c", "({m} - r) * {n} + c", "c * {n} + r", "({m} - c) * {n} + {m} - r")


def oriented(images: DataFrame, n: int) -> DataFrame:
    """images with each of the eight orientations of its n x n signature: turn (0: as it is), sig."""
    turned = [f"transform(sequence(0, {n * n - 1}), i -> sig[CAST({t.format(n=n, m=n - 1).replace('r', '(i div ' + str(n) + ')').replace('c', '(i % ' + str(n) + ')')} AS INT)])" for t in _TURNS]
    return images.select("*", F.posexplode(F.expr(f"array({', '.join(turned)})")).alias("turn", "turned")).drop("sig").withColumnRenamed("turned", "sig")


def difference_hash(sig: Column) -> Column:
    """Bit i is set where value i + 1 exceeds value i, over the first 64 steps of a signature."""
    steps = F.transform(F.sequence(F.lit(0), F.least(F.lit(62), F.size(sig) - 2)), lambda i: F.when(F.get(sig, i + 1) > F.get(sig, i), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(F.reverse(steps), F.lit(0).cast("bigint"), lambda a, b: a * 2 + b)


def leakage(external: DataFrame, heldout: DataFrame, n: int, max_dist: int = 10, least: float = 0.95) -> DataFrame:
    """image_id, held_id, split, ncc: external images that show a held-out one in any orientation.

    external and heldout: image_id, sig (n x n, row order); heldout has its split.  Candidates by hash distance (held-out hashes look up
    the external ones), then the correlation of centred and scaled signatures.
    """
    a = cut(oriented(external.select("image_id", "sig"), n).select("image_id", difference_hash(F.col("sig")).alias("dhash"), g.unit(F.col("sig")).alias("u")))
    b = cut(heldout.select(F.col("image_id").alias("held_id"), "split", difference_hash(F.col("sig")).alias("dhash"), g.unit(F.col("sig")).alias("held_u")))
    near = near_hashes(b, a, max_dist).select(F.col("dhash").alias("held_hash"), F.col("other").alias("dhash"))
    both = a.join(near, "dhash").join(b.withColumnRenamed("dhash", "held_hash"), "held_hash").withColumn("ncc", g.dot(F.col("u"), F.col("held_u"))).where(F.col("ncc") >= least)
    return both.groupBy("image_id", "held_id", "split").agg(F.max("ncc").alias("ncc"))
