"""Joins of boxes: equi keys first (sequence and frame), what is left as a condition."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.storage import cut

KEY = ("seq", "frame")
BOX = ("x1", "y1", "x2", "y2")


def side(df: DataFrame, name: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """df with all columns but the key under a prefix."""
    return df.select(*(F.col(c) if c in key else F.col(c).alias(f"{name}_{c}") for c in df.columns))


def pairs_by_iou(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY, min_iou: float = 0.0, iou_fn=g.iou) -> DataFrame:
    """All pairs of a frame with at least min_iou, columns prefixed a_ and b_.

    Where min_iou is above 0 and iou_fn is 0 for boxes apart, pairs that don't overlap end at the join's four comparisons.
    """
    both = side(a, "a", key).join(side(b, "b", key), list(key))
    if min_iou > 0 and iou_fn is g.iou:
        both = both.where((F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2")))
    return both.withColumn("iou", iou_fn(g.box("a_"), g.box("b_"))).where(F.col("iou") >= min_iou)


def nearest_human(tracks: DataFrame, ball: DataFrame, max_px: float = 70.0, classes: tuple[str, ...] = ("player", "goalkeeper")) -> DataFrame:
    """For each ball row the human whose nearer foot is closest and under max_px: possessor_id, possessor_cls, team, distance.

    Ties: players before goalkeepers, then the smaller track_id.
    """
    humans = tracks.where(F.col("cls").isin(*classes)).select(*KEY, *(F.col(c).alias(f"h_{c}") for c in BOX), "track_id", "cls", "team")
    d = g.foot_distance(g.box("h_"), g.center(g.box()))
    near = ball.select(*KEY, *BOX).join(humans, list(KEY)).withColumn("distance", d).where(F.col("distance") < max_px)
    rank = F.when(F.col("cls") == "player", 0).otherwise(1)
    best = near.groupBy(*KEY).agg(F.min_by(F.struct("track_id", "cls", "team", "distance"), F.struct("distance", rank, "track_id")).alias("b"))
    return best.select(*KEY, F.col("b.track_id").alias("possessor_id"), F.col("b.cls").alias("possessor_cls"), F.col("b.team").alias("team"), F.col("b.distance").alias("distance"))


def attach_segment(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points with the first segment (by load order ``ord``) of their sequence that covers the frame; seg_ord is null outside.

    The segments of a sequence are one array, so each point is one row throughout and repeated points stay apart.
    """
    each = segments.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("seg_ord"), "f0", "f1", "h"))).alias("segments"))
    first = F.get(F.filter("segments", lambda s: F.col("frame").between(s["f0"], s["f1"])), F.lit(0))
    rows = points.join(each, "seq", "left").withColumn("first", first)
    return rows.select(*points.columns, "first.seg_ord", "first.h")


def nearest_frame(points: DataFrame, queries: DataFrame, by: str = "track_id") -> DataFrame:
    """For each query (by, frame) the point of least distance in frames; ties: the earlier.  Queries of a track without points have no row.

    Two passes over points and queries together, one in each direction, carry the last point seen.  Of the points of one frame the least counts.
    """
    rest = [c for c in points.columns if c not in (by, "frame")]
    point = F.struct(F.col("frame").alias("at_frame"), *rest)
    known = points.groupBy(by, "frame").agg(F.min(point).alias("p"))
    asked = queries.select(by, "frame").distinct().withColumn("asked", F.lit(True))
    both = known.join(asked, [by, "frame"], "full_outer")
    up, down = (Window.partitionBy(by).orderBy(o("frame")).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    rows = both.withColumn("before", F.last("p", ignorenulls=True).over(up)).withColumn("after", F.last("p", ignorenulls=True).over(down))
    later = F.col("after.at_frame") - F.col("frame") < F.col("frame") - F.col("before.at_frame")
    best = F.when(F.col("before").isNull() | later, F.col("after")).otherwise(F.col("before"))
    return rows.where("asked").withColumn("p", best).where("p is not null").select(by, "frame", "p.*")


def adjacent_pairs(boxes: DataFrame, min_iou: float = 0.4, cls: str = "cls") -> DataFrame:
    """Boxes of frames t and t + 1, of one class, that are each other's best (by IoU, then id): a_det_id, b_det_id, iou."""
    rows = boxes.select(*KEY, cls, "det_id", *BOX)
    both = pairs_by_iou(rows, rows.withColumn("frame", F.col("frame") - 1), (*KEY, cls), min_iou)
    ra = F.row_number().over(Window.partitionBy("a_det_id").orderBy(F.desc("iou"), "b_det_id"))
    rb = F.row_number().over(Window.partitionBy("b_det_id").orderBy(F.desc("iou"), "a_det_id"))
    return both.withColumn("ra", ra).withColumn("rb", rb).where("ra = 1 and rb = 1").select(*KEY, "a_det_id", "b_det_id", "iou")


def orphan_labels(images: DataFrame, labels: DataFrame, key: str = "image") -> DataFrame:
    """Keys of one side only, with the kind: label_without_image or image_without_label."""
    one = labels.select(key).distinct().join(images, key, "left_anti").select(key, F.lit("label_without_image").alias("kind"))
    return one.union(images.select(key).distinct().join(labels, key, "left_anti").select(key, F.lit("image_without_label")))


def roundtrip_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str] = list(BOX)) -> DataFrame:
    """Rows of both tables by key: status (same key in both, dropped, extra) and the largest deviation of the values."""
    left, right = (t.select(*keys, *(F.col(v).alias(f"{n}_{v}") for v in values), F.lit(True).alias(f"in_{n}")) for t, n in ((a, "a"), (b, "b")))
    both = left.join(right, keys, "full_outer")
    status = F.when(F.col("in_b").isNull(), "dropped").when(F.col("in_a").isNull(), "extra").otherwise("both")
    return both.select(*keys, status.alias("status"), F.greatest(*(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values)).alias("deviation"))


#: Bits of a hash.
BITS = 64
#: Probes of a task.
PROBES = 2_000_000


def _bands(max_dist: int, bands: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, most differing bits) of each band: of two hashes that differ in max_dist bits or fewer, some band differs that little.

    If the first a + 1 bands all differed in more than r bits and the rest in more than r - 1, where max_dist = bands * r + a, that would be
    bands * r + a + 1 bits.  A band that may differ in less than 0 bits is left out.
    """
    r, a = divmod(max_dist, bands)
    edges = [BITS * i // bands for i in range(bands + 1)]
    return [(x, y - x, r - (i > a)) for i, (x, y) in enumerate(zip(edges, edges[1:])) if r - (i > a) >= 0]


def _flips(bits: int, most: int) -> int:
    return sum(comb(bits, k) for k in range(most + 1))


def choose_bands(max_dist: int, probing: int, indexed: int) -> int:
    """How many bands make the fewest rows, probes and expected candidates of random hashes together; those that make candidates of fewer than 1 % of all pairs with at most 1,000 probes a hash go first."""
    costs = []
    for n in range(3, 17):
        bands = _bands(max_dist, n)
        probes, share = sum(_flips(b, m) for _, b, m in bands), sum(_flips(b, m) / 2**b for _, b, m in bands)
        if probes <= 30_000:
            costs.append((share > 0.01 or probes > 1000, probing * probes + probing * indexed * share, n))
    return min(costs)[2] if costs else 16


def near_hashes(left: DataFrame, right: DataFrame, max_dist: int, keep: tuple[str, ...] = (), bands: int | None = None) -> DataFrame:
    """(dhash, other, distance) of all pairs of distinct 64-bit hashes (column dhash) of two tables that differ in at most max_dist bits, exactly and each once.

    Multi-index hashing: right is indexed by the bits of a few wide bands; each hash of left looks up, in every band, all values within the few bits
    that the band may differ in.  A pair that meets in several bands counts in the first.  keep: columns that must be equal, too.  The number of
    bands follows from how many hashes there are, unless it is given.
    """
    a, c = (t.where("dhash is not null").select("dhash", *keep).distinct() for t in (left, right))
    n = a.count()
    if not bands:
        bands = choose_bands(max_dist, n, n if left is right else c.count())
    of = _bands(max_dist, bands)
    # a hash is a few bytes but up to thousands of probes, so hashes are dealt by their work: dealt by their bytes, one task would have them all
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * sum(_flips(b, m) for _, b, m in of) // PROBES)
    a = a.repartition(parts)
    part = lambda h, x, n: F.shiftrightunsigned(h, x).bitwiseAND(F.lit((1 << n) - 1))
    flips = lambda n, most: F.split(F.lit(",".join(str(sum(1 << i for i in c)) for k in range(most + 1) for c in combinations(range(n), k))), ",").cast("array<bigint>")
    entry = lambda i, v: F.struct(F.lit(i).alias("band"), v.alias("bits"))
    flipped = lambda i, x, n, m: F.transform(flips(n, m), lambda v: entry(i, part("dhash", x, n).bitwiseXOR(v)))
    probes = F.concat(*(flipped(i, *b) for i, b in enumerate(of)))
    looked = a.select("dhash", *keep, F.explode(probes).alias("p")).select("dhash", *keep, "p.band", "p.bits")
    index = c.select(F.col("dhash").alias("other"), *keep, F.explode(F.array(*(entry(i, part("dhash", x, n)) for i, (x, n, _) in enumerate(of)))).alias("p")).select("other", *keep, "p.band", "p.bits")
    differ = F.col("dhash").bitwiseXOR(F.col("other"))
    met = looked.join(index, ["band", "bits", *keep]).where(F.bit_count(differ) <= max_dist)
    for i, (x, n, m) in enumerate(of[:-1]):
        met = met.where((F.col("band") <= i) | (F.bit_count(part(differ, x, n)) > m))
    return met.select("dhash", "other", F.bit_count(differ).alias("distance"), *keep)


def classes(images: DataFrame, *content: str) -> DataFrame:
    """images with rep: the smallest image_id of those with the same content."""
    of = images.groupBy(*(F.col(c).alias(f"of_{c}") for c in content)).agg(F.min("image_id").alias("rep"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in content]
    return images.join(of, same).select(*images.columns, "rep")


def hamming_pairs(images: DataFrame, max_dist: int = 8, group_col: str | None = None) -> DataFrame:
    """(a, b, distance) of images whose 64-bit hashes differ in at most max_dist bits, exactly.

    Images of one hash are a class: its smallest image_id stands for it in pairs with other classes, and is paired at distance 0 with each of its other
    members, so a class of n images has n - 1 rows of its own.
    """
    keep = (group_col,) if group_col else ()
    named = cut(classes(images.where("dhash is not null").select("image_id", "dhash", *keep), "dhash", *keep))
    reps = named.where("image_id = rep")
    near = near_hashes(reps, reps, max_dist, keep).where("dhash < other")
    both = near.join(reps.select("dhash", F.col("rep").alias("a"), *keep), ["dhash", *keep]).join(reps.select(F.col("dhash").alias("other"), F.col("rep").alias("b"), *keep), ["other", *keep])
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    return pairs.union(named.where("image_id <> rep").select("rep", "image_id", F.lit(0)))


def center_matches(preds: DataFrame, gt: DataFrame, k: float = 1.5, floor_px: float = 8.0) -> DataFrame:
    """For each truth box the first prediction (by id) whose centre is within max(k * width, floor_px)."""
    both = side(gt, "g").join(side(preds, "p"), list(KEY)).withColumn("d", g.dist(g.center(g.box("g_")), g.center(g.box("p_"))))
    near = both.where(F.col("d") <= F.greatest(F.lit(k) * g.width(g.box("g_")), F.lit(floor_px)))
    return near.groupBy(*KEY, "g_det_id").agg(F.min("p_det_id").alias("p_det_id"))


def fill_run(rows: DataFrame) -> DataFrame:
    """Rows without a run take their image's (the largest name), else "other"."""
    of = rows.groupBy("image").agg(F.max("run").alias("image_run"))
    return rows.join(of, "image", "left").withColumn("run", F.coalesce("run", "image_run", F.lit("other"))).drop("image_run")
