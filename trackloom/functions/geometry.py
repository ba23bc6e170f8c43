"""Box geometry as Column expressions: everything stays in generated code, no UDF.

A box is any Column of struct type with x1, y1, x2, y2; ``box()`` makes one of four columns.  Null boxes give null.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "", suffix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}{suffix}").alias(c) for c in ("x1", "y1", "x2", "y2")))


def _of(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def _positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def area(b: Column) -> Column:
    return _positive(width(b)) * _positive(height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return _positive(w) * _positive(h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def expand(b: Column, r: float) -> Column:
    """The box with r of its width and height added on each side."""
    if r < 0:
        raise ValueError("the buffer ratio must not be negative")
    w, h = width(b) * r, height(b) * r
    return _of(b["x1"] - w, b["y1"] - h, b["x2"] + w, b["y2"] + h)


def buffered_iou(a: Column, b: Column, r: float = 0.3) -> Column:
    return iou(expand(a, r), expand(b, r))


def _hull(a: Column, b: Column) -> Column:
    return _of(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def giou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union, hull = area(a) + area(b) - both, area(_hull(a, b))
    return iou(a, b) - F.when(hull > 0, (hull - union) / hull).otherwise(0.0)


def _centre_term(a: Column, b: Column) -> Column:
    """Squared distance of centres over the squared diagonal of the hull."""
    h = _hull(a, b)
    d = F.pow((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2, 2) + F.pow((a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2, 2)
    diagonal = F.pow(width(h), 2) + F.pow(height(h), 2)
    return F.when(diagonal > 0, d / diagonal).otherwise(0.0)


def diou(a: Column, b: Column) -> Column:
    return iou(a, b) - _centre_term(a, b)


def ciou(a: Column, b: Column) -> Column:
    angle = lambda x: F.when(height(x) > 0, F.atan(width(x) / height(x))).otherwise(F.lit(pi / 2))
    v = F.pow(angle(a) - angle(b), 2) * (4 / pi**2)
    inside = iou(a, b)
    alpha = F.when(1 - inside + v > 0, v / (1 - inside + v)).otherwise(0.0)
    return inside - _centre_term(a, b) - alpha * v


def fuse_unit(similarity: Column) -> Column:
    """A similarity from -1 to 1 as one from 0 to 1."""
    return (similarity + 1) / 2


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a that b covers."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1e-6))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def center(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def center_int(b: Column) -> Column:
    """Centre, cut toward zero."""
    return point(((b["x1"] + b["x2"]) / 2).cast("int"), ((b["y1"] + b["y2"]) / 2).cast("int"))


def foot_int(b: Column) -> Column:
    return point(((b["x1"] + b["x2"]) / 2).cast("int"), b["y2"].cast("int"))


def ground_point(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, b["y2"])


def dist(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def foot_distance(b: Column, p: Column) -> Column:
    """From the nearer of the two lower corners to p."""
    return F.least(dist(point(b["x1"], b["y2"]), p), dist(point(b["x2"], b["y2"]), p))


def bottom_edge_point(b: Column, p: Column) -> Column:
    return point(F.least(F.greatest(p["x"], b["x1"]), b["x2"]), b["y2"])


def xyxy_to_xywh(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), width(b).alias("w"), height(b).alias("h"))


def xywh_to_xyxy(b: Column) -> Column:
    return _of(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])


def xyxy_to_xcycsr(b: Column) -> Column:
    """Centre, area and aspect ratio; a ratio of 0 where there is no height."""
    s = width(b) * height(b)
    r = F.when(height(b) != 0, width(b) / height(b)).otherwise(0.0)
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("xc"), ((b["y1"] + b["y2"]) / 2).alias("yc"), s.alias("s"), r.alias("r"))


def xcycsr_to_xyxy(b: Column) -> Column:
    w = F.sqrt(_positive(b["s"] * b["r"]))
    h = F.when(w > 0, b["s"] / w).otherwise(0.0)
    return _of(b["xc"] - w / 2, b["yc"] - h / 2, b["xc"] + w / 2, b["yc"] + h / 2)


def normalize(b: Column, w: float, h: float) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2 / w).alias("cx"), ((b["y1"] + b["y2"]) / 2 / h).alias("cy"), (width(b) / w).alias("w"), (height(b) / h).alias("h"))


def denormalize(b: Column, w: float, h: float) -> Column:
    return _of((b["cx"] - b["w"] / 2) * w, (b["cy"] - b["h"] / 2) * h, (b["cx"] + b["w"] / 2) * w, (b["cy"] + b["h"] / 2) * h)


def clamp(b: Column, w: float, h: float) -> Column:
    """The part inside the frame; null if it has no area."""
    inside = _of(F.greatest(b["x1"], F.lit(0.0)), F.greatest(b["y1"], F.lit(0.0)), F.least(b["x2"], F.lit(float(w))), F.least(b["y2"], F.lit(float(h))))
    return F.when((width(inside) > 0) & (height(inside) > 0), inside)


def polygon_box(xy: Column) -> Column:
    """Enclosing box of an array x1, y1, x2, y2, …"""
    xs, ys = F.filter(xy, lambda _, i: i % 2 == 0), F.filter(xy, lambda _, i: i % 2 == 1)
    return _of(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def crop_transform(b: Column, crop: Column, scale: float = 1.0, min_px: float = 2.0, min_area: float = 0.6) -> Column:
    """The box in a crop's coordinates; null if a side is under min_px or too little of its area is left."""
    shifted = _of(*(F.least(F.greatest((b[c] - crop[o]) * scale, F.lit(0.0)), (crop[e] - crop[o]) * scale) for c, o, e in (("x1", "x1", "x2"), ("y1", "y1", "y2"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))))
    whole = area(b) * scale * scale
    return F.when((width(shifted) >= min_px) & (height(shifted) >= min_px) & (whole > 0) & (area(shifted) >= min_area * whole), shifted)


def tile_grid(w: float, h: float, cols: int, rows: int, overlap: float = 0.2) -> Column:
    """The tiles of an image as an array of boxes with col and row: equal ones, each sharing ``overlap`` of its side with the next."""
    tw, th = w / (cols - (cols - 1) * overlap), h / (rows - (rows - 1) * overlap)
    tiles = [(c, r, c * tw * (1 - overlap), r * th * (1 - overlap)) for r in range(rows) for c in range(cols)]
    return F.array(*(F.struct(F.lit(c).alias("col"), F.lit(r).alias("row"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + tw).alias("x2"), F.lit(y + th).alias("y2")) for c, r, x, y in tiles))


def untile(b: Column, tile: Column, scale: float = 1.0) -> Column:
    """A box of a tile in the coordinates of the whole image."""
    return _of(b["x1"] / scale + tile["x1"], b["y1"] / scale + tile["y1"], b["x2"] / scale + tile["x1"], b["y2"] / scale + tile["y1"])


def project(h: Column, p: Column) -> Column:
    """p through a homography of nine numbers in row order; null where the third coordinate vanishes."""
    row = lambda i: h[i] * p["x"] + h[i + 1] * p["y"] + h[i + 2]
    w = row(6)
    return F.when(F.abs(w) >= 1e-12, point(row(0) / w, row(3) / w))


def warp_box(a: Column, b: Column) -> Column:
    """Enclosing box of the corners under an affine map of six numbers in row order."""
    xs = [a[0] * b[x] + a[1] * b[y] + a[2] for x in ("x1", "x2") for y in ("y1", "y2")]
    ys = [a[3] * b[x] + a[4] * b[y] + a[5] for x in ("x1", "x2") for y in ("y1", "y2")]
    return _of(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def to_native(b: Column, mode: Column, w: Column, h: Column, content_h: Column) -> Column:
    """A stored box in 1920 x 1080: "stretch" scales both axes, "fill" by width against the content's height, else unchanged."""
    sx = F.when(mode.isin("stretch", "fill"), 1920.0 / w).otherwise(1.0)
    sy = F.when(mode == "stretch", 1080.0 / h).when(mode == "fill", 1080.0 / content_h).otherwise(1.0)
    return _of(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def hue_dist(a: Column, b: Column) -> Column:
    """Distance on a circle of 180 degrees."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def kit_dist(a: Column, b: Column) -> Column:
    """Weighted distance of two colours (h, s, v)."""
    return F.sqrt(2.2 * F.pow(hue_dist(a["h"], b["h"]), 2) + 0.6 * F.pow(a["s"] - b["s"], 2) + 0.6 * F.pow(a["v"] - b["v"], 2))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _fold(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def mad(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda x: x) / F.size(a)


def moved_frac(a: Column, b: Column, t: float = 12) -> Column:
    """Share of places that differ by more than t."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d > t)) / F.size(a)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it; f(value) would compute it anew for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(a: Column) -> Column:
    """An array less its mean, at length 1; zeros where it is constant.  The product of two of them is their ncc."""
    named = F.struct(F.transform(a, lambda x: x.cast("double")).alias("a"), (_fold(a, lambda x: x) / F.size(a)).alias("mean"))
    centred = _let(named, lambda t: F.transform(t["a"], lambda x: x - t["mean"]))
    sized = _let(centred, lambda c: F.struct(c.alias("c"), F.sqrt(_fold(c, lambda x: x * x)).alias("length")))
    return _let(sized, lambda t: F.transform(t["c"], lambda x: F.when(t["length"] > 0, x / t["length"]).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y), lambda x: x)


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation; 0 where one side is constant."""
    return dot(unit(a), unit(b))


def size_bucket(w: Column) -> Column:
    return F.when(w <= 5, "<=5").when(w <= 8, "<=8").when(w <= 12, "<=12").otherwise(">12")


def game_seconds(clock: Column) -> Column:
    """Seconds of a clock like "1 - 12:34" within its half."""
    return F.regexp_extract(clock, r"(\d+):(\d+)\s*$", 1).cast("int") * 60 + F.regexp_extract(clock, r"(\d+):(\d+)\s*$", 2).cast("int")


def loose_name(name: Column) -> Column:
    """Lower-cased ASCII letters and digits of a name."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def source_stem(file: Column) -> Column:
    """A file name without folder, extension and the export suffix _jpg.rf.<hash>."""
    bare = F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(bare, r"_(jpg|jpeg|png)\.rf\.[0-9A-Za-z]+$", "")


def frame_index(stem: Column) -> Column:
    """The last number of a stem; null without one."""
    digits = F.regexp_extract(stem, r"(\d+)(?!.*\d)", 1)
    return F.when(digits != "", digits.cast("long"))
