"""Checks of annotations: every rule is a named condition, and violations are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .joins import BOX, KEY, pairs_by_iou


def _violations(df: DataFrame, key: list[str], rules: dict) -> DataFrame:
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*key, F.explode(found).alias("rule"))


def label_errors(labels: DataFrame, classes: int = 4, near: float = 0.90) -> DataFrame:
    """image, line_no, rule of label lines (image, line_no, line: "cls cx cy w h"): fields, number, class, size, range, edge, repeat, near_repeat."""
    # each line is split once
    rows = labels.select("image", "line_no", "line", F.split(F.trim("line"), r"\s+").alias("parts"))
    rows = rows.select("image", "line_no", "line", F.size("parts").alias("fields"), *(F.get("parts", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("c", "cx", "cy", "w", "h"))))
    ok = (F.col("fields") == 5) & F.col("c").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("image", F.trim("line")).orderBy("line_no")))
    inside = (F.col("cx").between(0, 1)) & F.col("cy").between(0, 1) & (F.col("w") <= 1) & (F.col("h") <= 1)
    edge = (F.col("cx") - F.col("w") / 2 < -1e-6) | (F.col("cx") + F.col("w") / 2 > 1 + 1e-6) | (F.col("cy") - F.col("h") / 2 < -1e-6) | (F.col("cy") + F.col("h") / 2 > 1 + 1e-6)
    one = _violations(rows, ["image", "line_no"], {
        "fields": F.col("fields") != 5, "number": (F.col("fields") == 5) & ~ok, "class": ok & ((F.col("c") < 0) | (F.col("c") >= classes) | (F.col("c") != F.floor("c"))),
        "size": ok & ((F.col("w") <= 0) | (F.col("h") <= 0)), "range": ok & ~inside, "edge": ok & inside & (F.col("w") > 0) & (F.col("h") > 0) & edge, "repeat": F.col("rn") > 1,
    })
    good = rows.where(ok & (F.col("rn") == 1) & (F.col("w") > 0) & (F.col("h") > 0)).select("image", "c", "line_no", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    twice = pairs_by_iou(good, good, ("image", "c"), near).where("a_line_no < b_line_no").select("image", F.col("b_line_no").alias("line_no"), F.lit("near_repeat").alias("rule")).distinct()
    return one.union(twice)


def identity_violations(boxes: DataFrame, frames: int, width: float, height: float, roles: tuple[str, ...] = ("player", "goalkeeper", "referee")) -> DataFrame:
    """seq, frame, track_id, rule of identity truth (seq, frame, track_id, box, cls)."""
    again = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "track_id"))
    same = F.count(F.lit(1)).over(Window.partitionBy(*KEY, *BOX))
    kinds = boxes.groupBy("seq", "track_id").agg(F.countDistinct("cls").alias("kinds"))
    rows = boxes.withColumn("again", again).withColumn("same", same).join(kinds, ["seq", "track_id"])
    return _violations(rows, [*KEY, "track_id"], {
        "id_positive": F.col("track_id") <= 0, "frame_range": ~F.col("frame").between(0, frames - 1), "extent": (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")),
        "bounds": (F.col("x1") < -1) | (F.col("y1") < -1) | (F.col("x2") > width + 1) | (F.col("y2") > height + 1), "role": ~F.col("cls").isin(*roles), "number": F.greatest(*(F.isnan(c) for c in BOX)),
        "repeated_id": F.col("again") > 1, "repeated_box": F.col("same") > 1, "role_changes": F.col("kinds") > 1,
    })


def frozen_set_check(boxes: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a frozen set: missing, extra and repeated ones with how often they occur."""
    n = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    e = expected.select(*keys).distinct().withColumn("want", F.lit(1))
    both = n.join(e, keys, "full_outer").na.fill(0, ["n", "want"])
    return both.withColumn("problem", F.when(F.col("n") == 0, "missing").when(F.col("want") == 0, "extra").when(F.col("n") > 1, "repeated")).where("problem is not null").select(*keys, "problem", "n")


def subset_equal(a: DataFrame, b: DataFrame, cols: list[str], places: int = 12) -> DataFrame:
    """Rows of one side only, with how often: only_a or only_b; none if the two hold the same rows in any order."""
    tidy = lambda t: t.select(*(F.round(c, places).alias(c) if t.schema[c].dataType.simpleString() == "double" else F.col(c) for c in cols))
    x, y = tidy(a), tidy(b)
    return x.exceptAll(y).withColumn("side", F.lit("only_a")).union(y.exceptAll(x).withColumn("side", F.lit("only_b"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """source, problem of a manifest (source, n) against files (source, name): count_differs, not_listed, no_files, repeated_name."""
    n = files.groupBy("source").agg(F.count(F.lit(1)).alias("there"), F.countDistinct("name").alias("names"))
    both = manifest.join(n, "source", "full_outer")
    return _violations(both, ["source"], {"not_listed": F.col("n").isNull(), "no_files": F.col("there").isNull(), "count_differs": F.col("n") != F.col("there"), "repeated_name": F.col("names") < F.col("there")})


def ball_human_overlap(tracks: DataFrame, ball: DataFrame) -> DataFrame:
    """Ball rows that coincide with a human's box: must be empty."""
    return ball.join(tracks.where("cls <> 'ball'").select(*KEY, *BOX, "track_id"), [*KEY, *BOX]).select(*KEY, "track_id")
