"""Teams from colours: clustering, change points and switches within a track."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_observation(obs: DataFrame, pixels: int = 150, not_green: float = 0.40) -> DataFrame:
    """Observations with enough pixels of which enough aren't grass (columns pixels, not_green)."""
    return obs.where((F.col("pixels") >= pixels) & (F.col("not_green") >= not_green))


def track_medians(desc: DataFrame, most: int = 9) -> DataFrame:
    """track_id, d (array): the median of each dimension over a track's first ``most`` observations (by ord)."""
    first = desc.withColumn("rn", F.row_number().over(Window.partitionBy("track_id").orderBy("ord"))).where(F.col("rn") <= most)
    each = first.select("track_id", F.posexplode("d").alias("i", "v")).groupBy("track_id", "i").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return each.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("d"))


def assign_teams(desc: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """track_id, team (1..k): k-means on standardised track medians; teams are numbered by the first coordinate of their centres.

    Scaling is by the population deviation; a dimension without any stays 0.
    """
    med = track_medians(desc).persist()
    s = med.select(F.posexplode("d").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = {r.i: (r.m, r.s) for r in s.collect()}  # two numbers for each dimension
    means, spreads = (F.array(*(F.lit(float(scale[i][j] or 0.0)) for i in sorted(scale))) for j in (0, 1))
    scaled = med.select("track_id", F.transform(F.arrays_zip(F.col("d").alias("v"), means.alias("m"), spreads.alias("s")), lambda q: F.when(q["s"] > 0, (q["v"] - q["m"]) / q["s"]).otherwise(0.0)).alias("z"))
    model = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="c").fit(scaled.withColumn("f", array_to_vector("z")))
    order = sorted(range(k), key=lambda c: tuple(model.clusterCenters()[c]))
    names = F.create_map(*(F.lit(x) for t, c in enumerate(order, 1) for x in (c, t)))
    out = model.transform(scaled.withColumn("f", array_to_vector("z"))).select("track_id", F.element_at(names, F.col("c")).alias("team"))
    med.unpersist()
    return out


def _medians(part: Column) -> Column:
    """The median of each dimension of an array of vectors."""
    n = F.size(part)
    ranked = lambda i: F.array_sort(F.transform(part, lambda v: F.get(v, i)))
    at = lambda i, k: F.get(ranked(i), F.floor(k).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.size(F.get(part, F.lit(0))) - 1), lambda i: (at(i, (n - 1) / 2) + at(i, n / 2)) / 2)


def _apart(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def change_point(desc: DataFrame, min_regime: int = 3, ratio: float = 3.0) -> DataFrame:
    """track_id, split (place of the second regime's first observation, by ord), score, changed: the split of highest distance of medians over mean spread.

    Of equal scores the first split counts; split is null where the score is below ``ratio``, score too where a track has fewer than two regimes' observations.
    Every split of a track is a row that carries the track's observations as one array.
    """
    each = desc.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "d"))), lambda o: o["d"]).alias("x"))
    n = F.size("x")
    tried = F.when(n >= 2 * min_regime, F.sequence(F.lit(min_regime), n - min_regime))
    rows = each.select("track_id", "x", F.explode_outer(tried).alias("at"))
    rows = rows.select("track_id", "at", F.slice("x", 1, F.col("at")).alias("a"), F.slice("x", F.col("at") + 1, n).alias("b"))
    rows = rows.withColumn("ma", _medians(F.col("a"))).withColumn("mb", _medians(F.col("b")))
    spread = lambda part, m: F.aggregate(part, F.lit(0.0), lambda s, v: s + _apart(v, F.col(m))) / F.size(part)
    score = _apart(F.col("ma"), F.col("mb")) / F.greatest((spread("a", "ma") + spread("b", "mb")) / 2, F.lit(1e-6))
    best = rows.withColumn("score", score).groupBy("track_id").agg(F.max_by(F.struct("at", "score"), F.struct("score", -F.col("at"))).alias("s"))
    changed = F.coalesce(F.col("s.score") >= ratio, F.lit(False))
    return best.select("track_id", F.when(changed, F.col("s.at")).alias("split"), F.col("s.score").alias("score"), changed.alias("changed"))


def switch_classes(obs: DataFrame, dims: int, rounds: int = 5, least: int = 4, share: float = 0.15, separation: float = 2.0, gap: int = 3, sustained: float = 0.7) -> DataFrame:
    """track_id, n, minority, separation, longest, kind: whether a track's descriptors fall into two groups, and whether the smaller one is one stretch.

    obs: track_id, frame, d (dims numbers).  Two groups by ``rounds`` of 2-means from the observation farthest from the track's mean and the
    one farthest from that (ties: the earlier); of equal groups the second is the smaller.  A stretch ends where more than ``gap`` frames lack.
    kind: too_short, unimodal, sustained (one stretch spans ``sustained`` times the group's size) or intermittent.
    """
    gone = lambda a, b: F.sqrt(sum(F.pow(F.col(a)[i] - F.col(b)[i], 2) for i in range(dims)))
    mean = lambda c: F.array(*(F.avg(c(i)) for i in range(dims)))
    centres = obs.groupBy("track_id").agg(mean(lambda i: F.col("d")[i]).alias("m"))
    for name, of in (("a", "m"), ("b", "a")):
        kept = [c for c in ("a",) if c in centres.columns]
        rows = obs.join(centres, "track_id")
        centres = rows.groupBy("track_id").agg(F.max_by("d", F.struct(gone("d", of), -F.col("frame"))).alias(name), *(F.first(c).alias(c) for c in kept))
    second = lambda df: df.withColumn("side", (gone("d", "b") < gone("d", "a")).cast("int"))
    for _ in range(rounds):
        moved = lambda c, k: F.array(*(F.coalesce(F.avg(F.when(F.col("side") == k, F.col("d")[i])), F.max(F.col(c)[i])) for i in range(dims))).alias(c)
        centres = second(obs.join(centres, "track_id")).groupBy("track_id").agg(moved("a", 0), moved("b", 1))
    rows = second(obs.join(centres, "track_id")).withColumn("off", F.when(F.col("side") == 0, gone("d", "a")).otherwise(gone("d", "b")))
    count = lambda k: F.sum((F.col("side") == k).cast("int"))
    wide = lambda k: F.stddev_pop(F.when(F.col("side") == k, F.col("off")))
    stats = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), count(0).alias("n0"), count(1).alias("n1"), wide(0).alias("s0"), wide(1).alias("s1"), F.first(gone("a", "b")).alias("far"))
    s = lambda k: F.when(F.col(f"n{k}") > 1, F.col(f"s{k}")).otherwise(0.0)
    spread = F.when((F.col("n0") > 1) & (F.col("n1") > 1), (s(0) + s(1)) / 2).otherwise(F.greatest(s(0), s(1)))
    stats = stats.withColumn("few", F.when(F.col("n0") < F.col("n1"), 0).otherwise(1)).withColumn("minority", F.least("n0", "n1") / F.col("n")).withColumn("separation", F.col("far") / F.greatest(spread, F.lit(1e-6)))
    small = rows.join(stats.select("track_id", "few"), "track_id").where("side = few").select("track_id", "frame")
    by = Window.partitionBy("track_id").orderBy("frame")
    begins = F.coalesce((F.col("frame") - F.lag("frame").over(by) > gap).cast("int"), F.lit(0))
    runs = small.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by)).groupBy("track_id", "run").agg((F.max("frame") - F.min("frame") + 1).alias("length"))
    out = stats.join(runs.groupBy("track_id").agg(F.max("length").alias("longest")), "track_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
    two = (F.col("minority") >= share) & (F.col("separation") >= separation)
    one_run = F.col("longest") / F.greatest(F.least("n0", "n1"), F.lit(1)) >= sustained
    kind = F.when(F.col("n") < least, "too_short").when(~two, "unimodal").when(one_run, "sustained").otherwise("intermittent")
    return out.select("track_id", "n", "minority", "separation", "longest", kind.alias("kind"))


def odd_kit(colors: DataFrame, bins: int = 12, hue: float = 22.0, saturation: float = 60.0, least: int = 6) -> DataFrame:
    """track_id, h, s and odd: the hue is far from the two most common of its group's 12 hue bins (colors: grp, track_id, h 0-180, s)."""
    vivid = colors.where(F.col("s") > saturation)
    width = 180 / bins
    counts = vivid.groupBy("grp", F.floor(F.col("h") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("rk", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "bin"))).where("rk <= 2")
    centres = top.groupBy("grp").agg(F.collect_list((F.col("bin") + 0.5) * width).alias("centres"), F.count(F.lit(1)).alias("k"))
    valid = vivid.groupBy("grp").agg(F.count(F.lit(1)).alias("valid"))
    rows = colors.join(centres, "grp", "left").join(valid, "grp", "left")
    far = F.forall("centres", lambda c: F.least(F.abs(F.col("h") - c), 180 - F.abs(F.col("h") - c)) > hue)
    return rows.select("grp", "track_id", "h", "s", F.coalesce((F.col("valid") >= least) & (F.col("s") > saturation) & far, F.lit(False)).alias("odd"))
