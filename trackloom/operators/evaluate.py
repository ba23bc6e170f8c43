"""Evaluation of predictions against truth."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.storage import cut
from .joins import BOX, KEY, pairs_by_iou
from .matching import match_one_to_one, take_in_order
from .running import running_sums


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b > 0, a / b)


def _with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))


def pr_by_class(gt: DataFrame, preds: DataFrame, conf: float = 0.25, iou: float = 0.5) -> DataFrame:
    """cls, tp, fp, fn, precision, recall at one confidence and IoU."""
    q = preds.where(F.col("conf") >= conf)
    m = match_one_to_one(gt, q, iou)
    tp = m.groupBy("cls").agg(F.count(F.lit(1)).alias("tp"))
    n = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    p = q.groupBy("cls").agg(F.count(F.lit(1)).alias("p"))
    all_ = n.join(p, "cls", "full_outer").join(tp, "cls", "left").na.fill(0, ["n", "p", "tp"])
    return _with_rates(all_.select("cls", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn")))


def role_confusion(gt: DataFrame, preds: DataFrame, iou: float = 0.5, classes: tuple[str, ...] = ("player", "goalkeeper", "referee", "ball")) -> DataFrame:
    """For each true class: how often it was predicted as each class, and the partition correct, wrong_role, missed."""
    m = match_one_to_one(gt, preds, iou, by_class=False).select("g_det_id", "p_det_id")
    roles = gt.select("cls", F.col("det_id").alias("g_det_id")).join(m, "g_det_id", "left").join(preds.select(F.col("det_id").alias("p_det_id"), F.col("cls").alias("pcls")), "p_det_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    return roles.groupBy("cls").agg(*(count(F.col("pcls") == c).alias(c) for c in classes), count(F.col("pcls") == F.col("cls")).alias("correct"), count(F.col("pcls") != F.col("cls")).alias("wrong_role"), count(F.col("pcls").isNull()).alias("missed"))


def threshold_grid(gt: DataFrame, preds: DataFrame, grid: list[float], iou: float = 0.5) -> DataFrame:
    """tp, fp, fn, precision and recall over all classes for each confidence threshold, from one pass over the pairs."""
    at = F.array(*(F.lit(float(t)) for t in grid))
    # the threshold joins as one more part of the class, so that every threshold is matched by itself
    key = lambda t: F.concat_ws("|", "cls", t.cast("string"))
    q = preds.withColumn("threshold", F.explode(F.filter(at, lambda t: t <= F.col("conf"))))
    truth = gt.withColumn("threshold", F.explode(at))
    m = match_one_to_one(truth.withColumn("cls", key(F.col("threshold"))).drop("threshold"), q.withColumn("cls", key(F.col("threshold"))).drop("threshold"), iou)
    tp = m.select(F.element_at(F.split("cls", r"\|"), -1).cast("double").alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("tp"))
    n = truth.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))
    p = q.groupBy("threshold").agg(F.count(F.lit(1)).alias("p"))
    all_ = n.join(p, "threshold", "left").join(tp, "threshold", "left").na.fill(0, ["p", "tp"])
    return _with_rates(all_.select("threshold", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("n") - F.col("tp")).alias("fn")))


#: The ten thresholds of the usual mean.
IOUS = tuple((50 + 5 * i) / 100 for i in range(10))


def _hits(gt: DataFrame, preds: DataFrame, ious: tuple[float, ...]) -> DataFrame:
    """preds (seq, cls, conf, p_det_id) with t0, t1, ...: whether the prediction finds a truth box at each threshold.

    Pairs are computed once; each counts at the thresholds that it reaches, which are one more part of a frame's key, and is taken in the order of
    confidence, then IoU, while both of its boxes are free at that threshold: every prediction takes its best free box.
    """
    key = [*KEY, "cls"]
    ids = preds.select(*key, F.col("det_id").alias("p_det_id"), "conf", *BOX)
    pairs = pairs_by_iou(ids, gt.select(*key, F.col("det_id").alias("g_det_id"), *BOX), tuple(key), min(ious))
    pairs = pairs.select(*key, F.col("a_p_det_id").alias("p_det_id"), F.col("a_conf").alias("conf"), F.col("b_g_det_id").alias("g_det_id"), "iou")
    reached = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(ious))), lambda x: x["t"] <= F.col("iou"))
    each = pairs.withColumn("at", F.explode(reached)).withColumn("k", F.col("at.k"))
    taken = take_in_order(each, [*key, "k"], [-F.col("conf"), F.col("p_det_id"), -F.col("iou"), F.col("g_det_id")], "p_det_id", "g_det_id", "iou")
    found = taken.groupBy("p_det_id").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("bits"))
    rows = ids.join(found, "p_det_id", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    return rows.select("seq", "cls", "conf", "p_det_id", *(F.shiftright("bits", k).bitwiseAND(F.lit(1)).alias(f"t{k}") for k in range(len(ious))))


def _parts(by_sequence: bool) -> Column:
    return F.explode(F.array(F.lit("all"), F.col("seq").cast("string"))) if by_sequence else F.lit("all")


def average_precision(gt: DataFrame, preds: DataFrame, ious: list[float] | tuple[float, ...], by_sequence: bool = False) -> DataFrame:
    """cls, iou, ap: mean over 101 recalls of the best precision at that recall or more; with by_sequence also part: "all" and each sequence.

    Predictions in the order of confidence, then id.  A class without truth (in that part) has no row.
    """
    n = gt.select("cls", _parts(by_sequence).alias("part")).groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(_hits(gt, preds, tuple(ious)))  # ranges are drawn from it before it is dealt
    rows = rows.withColumn("whole", _parts(by_sequence)).withColumn("one", F.lit(1))
    summed = running_sums(rows, ["whole", "cls"], [F.desc("conf"), F.asc("p_det_id")], {"seen": "one"} | {f"h{k}": f"t{k}" for k in range(len(ious))}, n.withColumnRenamed("part", "whole"))
    # precision only counts where recall grows, which is at hits
    points = F.filter(F.array(*(F.when(F.col(f"t{k}") == 1, F.struct(F.lit(float(t)).alias("iou"), F.col(f"h{k}").alias("h"))) for k, t in enumerate(ious))), lambda x: x.isNotNull())
    hits = summed.where("n is not null").select(F.col("whole").alias("part"), "cls", "seen", "n", F.explode(points).alias("x"))
    level = F.floor(F.col("x.h") / F.col("n") * 100 + 1e-9).cast("int")
    curve = hits.groupBy("part", "cls", F.col("x.iou").alias("iou"), level.alias("level")).agg(F.max(F.col("x.h") / F.col("seen")).alias("p"))
    # recalls up to a level, from the one below it, have the best precision of that level and all above
    of = Window.partitionBy("part", "cls", "iou")
    best = F.max("p").over(of.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.lag("level").over(of.orderBy("level")), F.lit(-1))
    found = curve.withColumn("share", best * (F.col("level") - below)).groupBy("part", "cls", "iou").agg((F.sum("share") / 101).alias("ap"))
    asked = n.select("part", "cls", F.explode(F.array(*(F.lit(float(t)) for t in ious))).alias("iou"))
    out = asked.join(found, ["part", "cls", "iou"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    return out.select(*(["part"] if by_sequence else []), "cls", "iou", "ap")


def mean_average_precision(gt: DataFrame, preds: DataFrame, classes: tuple[str, ...] = ("player", "goalkeeper", "referee", "ball"), ious: tuple[float, ...] = IOUS) -> DataFrame:
    """part ("all" and each sequence), cls, truth, ap50, ap75 and map (mean over the thresholds).  Without truth all three are 1 if nothing was predicted, else 0."""
    ap = average_precision(gt, preds, ious, True).groupBy("part", "cls").agg(*(F.max(F.when(F.abs(F.col("iou") - t) < 1e-9, F.col("ap"))).alias(name) for name, t in (("ap50", 0.5), ("ap75", 0.75))), F.avg("ap").alias("map"))
    count = lambda t, name: t.select("cls", _parts(True).alias("part")).groupBy("part", "cls").agg(F.count(F.lit(1)).alias(name))
    seqs = gt.select("seq").union(preds.select("seq")).distinct()
    asked = seqs.select(_parts(True).alias("part")).distinct().select("part", F.explode(F.array(*(F.lit(c) for c in classes))).alias("cls"))
    all_ = asked.join(count(gt, "truth"), ["part", "cls"], "left").join(count(preds, "said"), ["part", "cls"], "left").join(ap, ["part", "cls"], "left")
    none = F.when(F.col("said").isNull(), 1.0).otherwise(0.0)
    return all_.select("part", "cls", F.coalesce("truth", F.lit(0)).alias("truth"), *(F.when(F.col("truth").isNull(), none).otherwise(F.col(c)).alias(c) for c in ("ap50", "ap75", "map")))


def _log_factorial(m: Column) -> Column:
    """ln m!: a sum of logarithms below 32, Stirling's series from there on, whose next term is under 2e-14."""
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(32)).cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    x = m.cast("double")
    return F.when(m < 32, few).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of b against c discordant pairs: the binomial tail from its largest term downwards, each term from the one before.

    Terms more than 10 * sqrt(n) + 50 below the largest are under e**-200 of it, so no double sees them: the work grows with the root of n.
    """
    n, k = (b + c).cast("bigint"), F.least(b, c).cast("bigint")
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(k, F.ceil(10 * F.sqrt(n.cast("double"))) + 50))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    sums = F.aggregate(steps, start, lambda a, j: F.struct((a["term"] * (k - j) / (n - k + j + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")))["sum"]
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + n * math.log(0.5))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * sums))


def paired_compare(gt: DataFrame, preds_a: DataFrame, preds_b: DataFrame, iou: float = 0.5) -> DataFrame:
    """both, a_only, b_only, neither of the truth boxes, mean IoUs of what both found, and McNemar's p_value."""
    a, b = (match_one_to_one(gt, p, iou).select("g_det_id", F.col("iou").alias(name)) for p, name in ((preds_a, "va"), (preds_b, "vb")))
    rows = gt.select(F.col("det_id").alias("g_det_id")).join(a, "g_det_id", "left").join(b, "g_det_id", "left")
    in_a, in_b = F.col("va").isNotNull(), F.col("vb").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    total = rows.agg(count(in_a & in_b).alias("both"), count(in_a & ~in_b).alias("a_only"), count(~in_a & in_b).alias("b_only"), count(~in_a & ~in_b).alias("neither"), F.avg(F.when(in_b, F.col("va"))).alias("mean_iou_a"), F.avg(F.when(in_a, F.col("vb"))).alias("mean_iou_b"))
    return total.withColumn("p_value", mcnemar(F.col("a_only"), F.col("b_only")))


def geometry_error(matches: DataFrame, gt: DataFrame, preds: DataFrame) -> DataFrame:
    """Per class: centre errors (mean, median, p90), mean area ratio, share within 2 pixels."""
    a = gt.select(F.col("det_id").alias("g_det_id"), *(F.col(c).alias(f"g_{c}") for c in BOX))
    b = preds.select(F.col("det_id").alias("p_det_id"), *(F.col(c).alias(f"p_{c}") for c in BOX))
    rows = matches.select("cls", "g_det_id", "p_det_id").join(a, "g_det_id").join(b, "p_det_id").withColumn("c", g.dist(g.center(g.box("g_")), g.center(g.box("p_")))).withColumn("a", g.area(g.box("p_")) / g.area(g.box("g_")))
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_centre"), F.percentile("c", F.lit(0.5)).alias("median_centre"), F.percentile("c", F.lit(0.9)).alias("p90_centre"), F.avg("a").alias("mean_area_ratio"), F.avg((F.col("c") <= 2).cast("int")).alias("within_2px"))


def multi_object_frames(gt: DataFrame, cls: str = "ball") -> DataFrame:
    """Frames with more than one box of a class: seq, frame, n."""
    return gt.where(F.col("cls") == cls).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def binary_scores(labels: DataFrame, by: str = "part") -> DataFrame:
    """Scores of predicted (0, 1) against actual (0, 1; null: ambiguous, excluded), for each ``by`` and pooled (null)."""
    rows = labels.where("actual is not null and predicted is not null")
    count = lambda a, p: F.sum(((F.col("actual") == a) & (F.col("predicted") == p)).cast("int"))
    c = rows.rollup(by).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recall, specificity, precision = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp)
    return c.select(by, "tp", "fp", "fn", "tn", recall.alias("recall"), specificity.alias("specificity"), precision.alias("precision"), _ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"), ((recall + specificity) / 2).alias("balanced"), _ratio(fp, fp + tn).alias("fp_rate"))


def permutation_accuracy(labels: DataFrame, by: str = "part") -> DataFrame:
    """Accuracy under the better of the two ways to name the classes (ties: as they are), for each ``by``.

    labels: actual (0, 1), predicted (0, 1, null: abstained), weight.
    """
    named = labels.withColumn("swap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("right", (F.when(F.col("swap") == 1, 1 - F.col("predicted")).otherwise(F.col("predicted")) == F.col("actual")).cast("int"))
    s = named.groupBy(by, "swap").agg(F.count(F.lit(1)).alias("n"), F.count("predicted").alias("covered"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.coalesce("right", F.lit(0))).alias("wr"))
    best = s.groupBy(by).agg(F.max_by(F.struct("*"), F.struct("right", -F.col("swap"))).alias("b")).select(F.col(f"b.{by}").alias(by), "b.swap", "b.n", "b.covered", "b.right", "b.w", "b.wr")
    return best.select(by, "swap", "n", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("covered") / F.col("n")).alias("coverage"), _ratio(F.col("right"), F.col("covered")).alias("selective"), _ratio(F.col("wr"), F.col("w")).alias("weighted"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Interval (low, high) of a proportion; null for n = 0."""
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def gate(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, value, base, delta, passed of each criterion (metric, at_least: the smallest delta); a missing value isn't passed."""
    both = baseline.join(metrics, "metric", "left").withColumn("delta", F.col("value") - F.col("base"))
    return both.select("metric", "value", "base", "delta", F.coalesce(F.col("delta") >= F.col("at_least"), F.lit(False)).alias("passed"))


def describe(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: n, mean, exact quantiles and counts up to 5, 8 and 12."""
    q = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(x)).alias(k) for k, x in q.items()), *(F.sum((F.col(value) <= x).cast("int")).alias(f"le{x}") for x in (5, 8, 12)))


def _bisected(ok, low, high, whole: bool):
    """The least value (integer where whole) in [low, high] from which on ok holds."""
    for _ in range(200):
        if (high - low <= 1) if whole else (high - low < 1e-13):
            break
        mid = (low + high) // 2 if whole else (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return low if ok(low) else high


def _binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of n draws."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    at = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    return math.fsum(math.exp(at(j)) for j in range(k, n + 1))


def _draws_tail(k: int, n: int, positives: int, population: int) -> float:
    """P(X >= k) of n draws without putting back."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    first, last = max(k, n - (population - positives), 0), min(n, positives)
    if first > last:
        return 0.0
    if k <= max(0, n - (population - positives)):
        return 1.0
    return math.fsum(math.exp(choose(positives, j) + choose(population - positives, n - j) - choose(population, n)) for j in range(first, last + 1))


def exact_intervals(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts (k of n asked, of a population) with low and high of the share (binomial, both tails alpha / 2) and least and most positives in the population.

    The second pair is for draws without putting back: the positives under which k or more, or k or fewer, have at least alpha / 2.  Null where
    not 0 <= k <= n <= population or n is 0.  A row is a stratum that people were asked about: its work grows with n.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, size in zip(b["k"], b["n"], b["population"]):
                if any(pd.isna(v) for v in (k, n, size)) or not 0 <= k <= n <= size or n == 0:
                    out.append((None,) * 4)
                    continue
                k, n, size = int(k), int(n), int(size)
                low = 0.0 if k == 0 else _bisected(lambda p: _binomial_tail(k, n, p) >= alpha / 2, 0.0, 1.0, False)
                high = 1.0 if k == n else _bisected(lambda p: 1 - _binomial_tail(k + 1, n, p) < alpha / 2, 0.0, 1.0, False)
                least = _bisected(lambda m: _draws_tail(k, n, m, size) >= alpha / 2, 0, size, True)
                # k or fewer positives are n - k or more of the others
                most = size - _bisected(lambda m: _draws_tail(n - k, n, m, size) >= alpha / 2, 0, size, True)
                out.append((low, high, least, most))
            ends = pd.DataFrame(out, columns=["low", "high", "least", "most"], index=b.index)
            yield pd.concat([b, ends.astype({"least": "Int64", "most": "Int64"})], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(run, f"{fields}, low double, high double, least long, most long")


def attribute_stability(tracks: DataFrame, *attributes: str) -> DataFrame:
    """Per track: span in frames, points, and how many values each attribute takes."""
    return tracks.groupBy("seq", "track_id").agg((F.max("frame") - F.min("frame") + 1).alias("span"), F.count(F.lit(1)).alias("points"), *(F.countDistinct(a).alias(f"n_{a}") for a in attributes))


def temporal_scores(gt: DataFrame, sel: DataFrame, view: str = "seq", radius: float = 20.0) -> DataFrame:
    """Per view and pooled (null): frames, truth, raw (observed hits), found (observed or recovered hits), covered, hallucinated frames and the longest run of them.

    gt: seq, frame, box (null where there is no ball).  A hit is a centre within radius of the truth's.
    """
    t = gt.select(*KEY, *(F.col(c).alias(f"g_{c}") for c in BOX))
    rows = sel.join(t, list(KEY), "left").withColumn("there", F.col("g_x1").isNotNull()).withColumn("said", F.col("x1").isNotNull())
    rows = rows.withColumn("hit", F.coalesce(F.col("there") & F.col("said") & (g.dist(g.center(g.box()), g.center(g.box("g_"))) <= radius), F.lit(False)))
    rows = rows.withColumn("ghost", F.col("said") & ~F.col("there"))
    run = F.col("frame") - F.row_number().over(Window.partitionBy("seq", "ghost").orderBy("frame"))
    rows = rows.withColumn("run", F.when(F.col("ghost"), run))
    runs = rows.where("ghost").groupBy("seq", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("seq").agg(F.max("n").alias("longest"))
    rows = rows.join(runs, "seq", "left")
    count = lambda c: F.sum(c.cast("int"))
    return rows.rollup(view).agg(F.count(F.lit(1)).alias("frames"), count(F.col("there")).alias("truth"), count(F.col("hit") & (F.col("state") == "observed")).alias("raw"), count(F.col("hit")).alias("found"), count(F.col("said")).alias("covered"), count(F.col("ghost")).alias("ghosts"), F.coalesce(F.max("longest"), F.lit(0)).alias("longest_ghost"))


def gt_stats(gt: DataFrame, frames: DataFrame, classes: tuple[str, ...] = ("player", "goalkeeper", "referee", "ball")) -> DataFrame:
    """Per sequence: frames, boxes of each class, frames without any box, frames without a ball."""
    per = gt.groupBy(*KEY).agg(*(F.sum((F.col("cls") == c).cast("int")).alias(c) for c in classes))
    rows = frames.select(*KEY).join(per, list(KEY), "left")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes]
    return rows.groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), *total, F.sum(F.col(classes[0]).isNull().cast("int")).alias("empty"), F.sum((F.coalesce("ball", F.lit(0)) == 0).cast("int")).alias("without_ball"))


def event_census(events: DataFrame, kind: str, props: str, time: str, by: str) -> DataFrame:
    """Per kind: events, events with a property, distinct property names, and how many are earlier than the one before of the same ``by`` (in order of id)."""
    before = F.lag(time).over(Window.partitionBy(by).orderBy("id"))
    rows = events.withColumn("back", F.coalesce(F.col(time) < before, F.lit(False)).cast("int")).withColumn("keys", F.json_object_keys(props))
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), F.sum((F.size("keys") > 0).cast("int")).alias("with_props"), F.size(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("names"), F.sum("back").alias("backward"))


def run_audit(boxes: DataFrame, uncertain: str = "U") -> DataFrame:
    """Per run: images, humans an image, median height, share uncertain, and the domain: broadcast from 16 humans an image with under 7.5 % uncertain."""
    per = boxes.groupBy("run", "image").agg(F.count(F.lit(1)).alias("n"))
    n = per.groupBy("run").agg(F.count(F.lit(1)).alias("images"), F.avg("n").alias("humans"))
    b = boxes.groupBy("run").agg(F.percentile("height", F.lit(0.5)).alias("median_height"), F.avg((F.col("role") == uncertain).cast("int")).alias("uncertain"))
    return n.join(b, "run").withColumn("domain", F.when((F.col("humans") >= 16) & (F.col("uncertain") < 0.075), "broadcast").otherwise("other"))


def prevalence(answers: DataFrame, population: DataFrame, by: str) -> DataFrame:
    """Per stratum: population, asked, positives, unsure, and bounds of the share if all unsure are no, or yes."""
    p = population.groupBy(by).agg(F.count(F.lit(1)).alias("population"))
    a = answers.groupBy(by).agg(F.count(F.lit(1)).alias("asked"), F.sum((F.col("answer") == "yes").cast("int")).alias("positives"), F.sum((F.col("answer") == "unsure").cast("int")).alias("unsure"))
    j = p.join(a, by, "left").na.fill(0, ["asked", "positives", "unsure"])
    return j.withColumn("low", _ratio(F.col("positives"), F.col("asked"))).withColumn("high", _ratio(F.col("positives") + F.col("unsure"), F.col("asked")))


def _judged_possession(rows: DataFrame) -> DataFrame:
    """rows with outcome (correct, wrong, unassigned, unmappable of PLAYER frames; false or none of frames where nobody has the ball) and the outcome of the earlier mapping."""
    assigned, player = F.col("assigned").isNotNull(), F.col("label") == "PLAYER"
    right = lambda c: F.when(F.coalesce(F.col(c) == F.col("gt_player"), F.lit(False)), "correct").otherwise("wrong")
    nobody = F.when(F.col("label").isin("NO_CONTROL", "NO_BALL"), F.when(assigned, "false").otherwise("none"))
    now = F.when(player & ~assigned, "unassigned").when(player & F.col("mapped").isNull(), "unmappable").when(player, right("mapped")).otherwise(nobody)
    was = F.when(player & ~assigned, "unassigned").when(player, right("mapped_before"))
    return rows.withColumn("outcome", now).withColumn("outcome_before", was)


def possession_scores(rows: DataFrame, window: str = "window", state: str = "ball_state") -> DataFrame:
    """Scores of who has the ball, per window, per state of the ball and over all (the other column null; by: window, state or all).

    rows: label (PLAYER, NO_CONTROL, NO_BALL, AMBIGUOUS), gt_player, assigned (a track, null: nobody), mapped (its true player, null: none).
    Ambiguous frames are counted and not judged.  mappable = correct + wrong.
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    label, outcome = F.col("label"), F.col("outcome")
    player = [n(outcome == o).alias(o) for o in ("correct", "wrong", "unassigned", "unmappable")]
    nobody = [x for k in ("NO_CONTROL", "NO_BALL") for x in (n(label == k).alias(k.lower()), n((label == k) & (outcome == "false")).alias(f"false_{k.lower()}"))]
    found = _judged_possession(rows.withColumn("mapped_before", F.lit(None).cast("long"))).groupingSets([[window], [state], []], window, state).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("frames"), n(label == "AMBIGUOUS").alias("ambiguous"), n(label == "PLAYER").alias("player"), n(outcome.isin("correct", "wrong")).alias("mappable"), *player, *nobody
    )
    by = F.when(F.col("g") == 1, "window").when(F.col("g") == 2, "state").otherwise("all")
    return found.withColumn("by", by).drop("g")


def possession_errors(rows: DataFrame) -> DataFrame:
    """error, n: WRONG_PLAYER (BALL_MISSING where the frame has no ball), UNASSIGNED_PLAYER, UNMAPPABLE, and SHOULD_BE_UNKNOWN where nobody has it."""
    o = F.col("outcome")
    error = F.when(o == "unmappable", "UNMAPPABLE").when(o == "unassigned", "UNASSIGNED_PLAYER").when((o == "wrong") & F.col("ball_present"), "WRONG_PLAYER").when(o == "wrong", "BALL_MISSING").when(o == "false", "SHOULD_BE_UNKNOWN")
    judged = _judged_possession(rows.withColumn("mapped_before", F.lit(None).cast("long")))
    return judged.select(error.alias("error")).where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def possession_changes(rows: DataFrame, *keys: str) -> DataFrame:
    """PLAYER frames whose outcome differs between two mappings of tracks to players (mapped_before, mapped): keys, outcome_before, outcome."""
    return _judged_possession(rows).where("label = 'PLAYER' and outcome <> outcome_before").select(*keys, "outcome_before", "outcome")
