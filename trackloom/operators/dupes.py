"""Duplicates, leakage and completeness of image collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.storage import cut
from .joins import classes, near_hashes


def exact_groups(images: DataFrame, sha: str = "sha", collection: str = "grp") -> DataFrame:
    """Groups of equal hashes: sha, copies, collections, and whether they cross collections."""
    found = images.where(F.col(sha).isNotNull()).groupBy(sha).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(collection).alias("collections")).where("copies > 1")
    return found.withColumn("crosses", F.col("collections") > 1)


def augmentation_copies(images: DataFrame, stem: str = "stem", order: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """images with copies (of their stem) and keep: the first of each stem."""
    w = Window.partitionBy(stem)
    return images.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("keep", F.row_number().over(w.orderBy(*order)) == 1)


def _verdict():
    return (
        F.when(F.col("same"), "EXACT")
        .when((F.col("ncc") >= 0.985) & (F.col("moved") <= 0.02), "NEAR_IDENTICAL")
        .when((F.col("ncc") >= 0.95) & (F.col("moved") <= 0.10), "SAME_SCENE")
        .otherwise("DISTINCT")
    )


def near_duplicates(images: DataFrame, max_dist: int = 8, moved_over: float = 12.0) -> DataFrame:
    """a, b, distance, ncc, moved, verdict of pairs whose difference hashes are close: the cheap gate first, then the signatures.

    Images of one signature and hash are a class, which its smallest image_id stands for; its other members are EXACT pairs with that one.
    """
    named = cut(classes(images.where("dhash is not null").select("image_id", "dhash", "sig"), "dhash", "sig"))
    reps = named.where("image_id = rep")
    near = near_hashes(reps, reps, max_dist).where("dhash <= other")
    one = lambda s, h: reps.select(F.col("dhash").alias(h), F.col("rep").alias(s), F.col("sig").alias(f"s{s}"))
    both = near.join(one("a", "dhash"), "dhash").join(one("b", "other"), "other").where("dhash < other or a < b")
    swap = F.col("a") > F.col("b")
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", F.when(swap, F.col("sb")).otherwise(F.col("sa")).alias("sa"), F.when(swap, F.col("sa")).otherwise(F.col("sb")).alias("sb"))
    scored = both.select("a", "b", "distance", g.ncc(F.col("sa"), F.col("sb")).alias("ncc"), g.moved_frac(F.col("sa"), F.col("sb"), moved_over).alias("moved"), F.lit(False).alias("same"))
    members = named.where("image_id <> rep").select(F.col("rep").alias("a"), F.col("image_id").alias("b"), F.lit(0).alias("distance"), g.ncc(F.col("sig"), F.col("sig")).alias("ncc"), F.lit(0.0).alias("moved"), F.lit(True).alias("same"))
    return scored.union(members).withColumn("verdict", _verdict()).drop("same")


def group_similarity(images: DataFrame, group: str, most: int = 2000, tile: int = 64) -> DataFrame:
    """Pairwise correlation within small groups: pairs, median, p90, and how many reach 0.985.

    The work is a group's size squared: a group of more than ``most`` images has its pairs counted and no figures (null), and those
    of any other are dealt out by tiles of ``tile`` x ``tile`` images, so no task takes a whole group.  Signatures are centred and scaled once, so a pair costs one product.
    """
    size = images.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy(group).orderBy("image_id")) - 1
    placed = images.join(size.where(F.col("n") <= most), group).select(group, "n", "image_id", g.unit(F.col("sig")).alias("u"), place.alias("place"))
    placed = placed.withColumn("block", F.expr(f"CAST(place div {tile} AS INT)")).withColumn("blocks", F.expr(f"CAST((n - 1) div {tile} AS INT)"))
    rows = placed.select(group, F.col("place").alias("a"), F.col("u").alias("ua"), F.col("block").alias("i"), F.explode(F.sequence("block", "blocks")).alias("j"))
    columns = placed.select(group, F.col("place").alias("b"), F.col("u").alias("ub"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    pairs = rows.join(columns, [group, "i", "j"]).where("a < b").withColumn("ncc", g.dot(F.col("ua"), F.col("ub")))
    told = pairs.groupBy(group).agg(F.percentile("ncc", F.lit(0.5)).alias("median"), F.percentile("ncc", F.lit(0.9)).alias("p90"), F.sum((F.col("ncc") >= 0.985).cast("int")).alias("alike"))
    return size.join(told, group, "left").select(group, F.expr("n * (n - 1) div 2").alias("pairs"), "median", "p90", "alike")


def completeness(images: DataFrame, boxes: DataFrame, by: str = "source") -> DataFrame:
    """Per source: images, share without a box, and the verdict BALL_ONLY, PARTIAL (over 5 % empty), PLAYER_ONLY or FULL."""
    per = boxes.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("cls") == "ball").cast("int")).alias("ball"), F.max((F.col("cls") != "ball").cast("int")).alias("human"))
    s = images.join(per, "image", "left").groupBy(by).agg(F.count(F.lit(1)).alias("images"), F.avg(F.col("n").isNull().cast("int")).alias("empty"), F.coalesce(F.max("ball"), F.lit(0)).alias("ball"), F.coalesce(F.max("human"), F.lit(0)).alias("human"))
    verdict = F.when((F.col("ball") == 1) & (F.col("human") == 0), "BALL_ONLY").when(F.col("empty") > 0.05, "PARTIAL").when(F.col("ball") == 0, "PLAYER_ONLY").otherwise("FULL")
    return s.select(by, "images", "empty", verdict.alias("verdict"))


def candidate_index(images: DataFrame, reasons: dict[str, DataFrame]) -> DataFrame:
    """images with reasons (all that hold, in the given order of precedence) and status (the first, or ELIGIBLE).

    reasons: name -> the image ids (column image) that it holds for.
    """
    out = images
    for k, (name, ids) in enumerate(reasons.items()):
        out = out.join(ids.select("image", F.lit(name).alias(f"r{k}")).distinct(), "image", "left")
    flags = F.filter(F.array(*(F.col(f"r{k}") for k in range(len(reasons)))), lambda x: x.isNotNull())
    return out.withColumn("reasons", flags).withColumn("status", F.coalesce(*(F.col(f"r{k}") for k in range(len(reasons))), F.lit("ELIGIBLE"))).drop(*(f"r{k}" for k in range(len(reasons))))


def split_leaks(images: DataFrame) -> DataFrame:
    """What ties splits together: kind (image_in_two_splits, match_in_two_splits), name, splits."""
    two = lambda c, kind: images.groupBy(c).agg(F.countDistinct("split").alias("splits")).where("splits > 1").select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"), "splits")
    return two("image", "image_in_two_splits").union(two("match", "match_in_two_splits"))


def srswor(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Simple random sample without replacement: the n rows of smallest hash of (key, seed), ties by key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """A population's name whatever its order: the sum of row hashes (two parts) and the number of rows."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("low"), part(13).alias("high"))


def stratified_round_robin(df: DataFrame, strata: list[str], k: int, seed: int, key: str) -> DataFrame:
    """k rows in turns over the strata: the first of each stratum by hash, then the second, …"""
    h = lambda *c: F.md5(F.concat_ws(":", *(F.col(x).cast("string") for x in c), F.lit(str(seed))))
    rows = df.withColumn("turn", F.row_number().over(Window.partitionBy(*strata).orderBy(h(key), key))).where(F.col("turn") <= k)
    return rows.orderBy("turn", h(*strata), *strata).limit(k)


def select_tracks(tracks: DataFrame, min_len: int = 15, top: int = 30) -> DataFrame:
    """Tracks of at least min_len points, the top ones of each sequence by (points, smaller id)."""
    n = tracks.groupBy("seq", "track_id").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= min_len)
    return n.withColumn("rk", F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("points"), "track_id"))).where(F.col("rk") <= top)
