"""Queries over detections, tracks and balls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import filters, joins, kinematics
from . import adapters as ad
from .adapters import with_adapters

_IOU = """CASE WHEN {u} > 0 THEN {i} / ({u}) ELSE 0.0 END"""


def iou_sql(a: str, b: str) -> str:
    i = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda p: f"greatest(0.0, {p}x2 - {p}x1) * greatest(0.0, {p}y2 - {p}y1)"
    return _IOU.format(u=f"{area(a)} + {area(b)} - {i}", i=i)


def class_normalization(spark: SparkSession, sf: str) -> DataFrame:
    named = ad.detections(spark, sf).withColumn("cls", F.when(F.col("det_id") % 7 == 0, F.lit(" Person ")).when(F.col("det_id") % 11 == 0, F.lit("drone")).otherwise(F.upper("cls")))
    return filters.tag_confidence(filters.normalize_classes(named)).groupBy("cls", "state").agg(F.count(F.lit(1)).alias("n"))


def plausibility(spark: SparkSession, sf: str) -> DataFrame:
    return filters.plausible(ad.detections(spark, sf), 25, 55, 0.3, 1.0).select("det_id", "reason")


def subsampled_positions(spark: SparkSession, sf: str) -> DataFrame:
    return filters.add_position(filters.subsample(filters.accepted_only(ad.detections(spark, sf)), 4)).select("seq", "frame", "det_id", "px", "py")


def camera_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    dets = filters.add_position(ad.detections(spark, sf))
    flow = dets.select("seq", "frame", F.col("det_id").alias("feature"), (F.col("det_id") % 13 - 6).cast("double").alias("dx"), (F.col("det_id") % 7 - 3).cast("double").alias("dy"), (F.col("det_id") % 5 > 0).alias("valid"))
    return filters.adjust_for_camera(dets, filters.dominant_motion(flow)).select("det_id", "ax", "ay")


def same_frame_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf).select("seq", "frame", "det_id", *joins.BOX, "cls")
    p = joins.pairs_by_iou(d, d, (*joins.KEY, "cls"), 0.3).where("a_det_id < b_det_id")
    kinds = {"biou": g.buffered_iou, "giou": g.giou, "diou": g.diou, "ciou": g.ciou, "cover": g.overlap_ratio}
    # a step of its own for the pairs that are left: with these long formulas in it, the code of the join grows too long to be compiled
    told = F.transform(F.array(F.struct(g.box("a_").alias("a"), g.box("b_").alias("b"))), lambda x: F.struct(*(F.round(f(x["a"], x["b"]), 6).alias(n) for n, f in kinds.items())))[0]
    return p.select("a_det_id", "b_det_id", F.round("iou", 6).alias("iou"), told.alias("told")).select("a_det_id", "b_det_id", "iou", *(F.col(f"told.{n}").alias(n) for n in kinds))


def _tracks(spark, sf):
    return ad.track_points(spark, sf).withColumn("cls", F.when(F.col("track_id") % 15 == 0, "goalkeeper").otherwise("player"))


def _balls(spark, sf):
    best = ad.ball_candidates(spark, sf).where("conf >= 0.25").groupBy("seq", "frame").agg(F.max_by(F.struct(*joins.BOX), F.struct("conf", -F.col("x1"), "cand_id")).alias("b"))
    return best.select("seq", "frame", "b.*")


def possession(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.possession(_tracks(spark, sf), _balls(spark, sf), ad.frames(spark, sf))


def possession_share(spark: SparkSession, sf: str) -> DataFrame:
    shared = kinematics.possession_share(possession(spark, sf))
    return shared.select("seq", "frame", "possessor_id", "team", F.round("share1", 6).alias("share1"), F.round("share2", 6).alias("share2"))


def nearest_player(spark: SparkSession, sf: str) -> DataFrame:
    near = joins.nearest_human(_tracks(spark, sf), _balls(spark, sf), 120.0, ("player",))
    return near.select("seq", "frame", "possessor_id", "team", F.round("distance", 6).alias("distance"))


def _points(spark, sf):
    return ad.track_points(spark, sf).select("seq", "track_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("px"), F.col("y2").alias("py"), "team")


def track_speed(spark: SparkSession, sf: str) -> DataFrame:
    s = kinematics.speed_distance(_points(spark, sf), 5.0)
    return s.select("seq", "track_id", "frame", F.round("speed", 6).alias("speed"), F.round("distance", 6).alias("distance"))


def track_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    moved = p.join(kinematics.speed_distance(p, 5.0), ["seq", "track_id", "frame"], "left")
    s = kinematics.track_stats(moved)
    return s.select("seq", "track_id", F.round("max_speed", 6).alias("max_speed"), F.round("max_distance", 6).alias("max_distance"), "appearances", "team")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.run_summary(ad.track_points(spark, sf), ad.frames(spark, sf))


def _segments(spark, sf):
    ranges = ad.table(spark, sf, "region").select(F.expr("CAST(r_regionkey AS INT)").alias("ord")).where("ord < 3")
    h = F.expr("array(0.1D, 0.01D * ord, 1D, 0D, 0.2D, 2D + ord, 0D, 0.0005D, 1D)")
    return ranges.select("ord", (F.col("ord") * 30).alias("f0"), (F.col("ord") * 40 + 35).alias("f1"), h.alias("h"))


def calibrated_speed(spark: SparkSession, sf: str) -> DataFrame:
    seqs = ad.track_points(spark, sf).select("seq").distinct()
    # three segments for every sequence: ranges that overlap, so that the first of them counts
    segments = seqs.crossJoin(F.broadcast(_segments(spark, sf)))  # three rows at most
    s = kinematics.metric_speed(_points(spark, sf), segments, 3, 5.0)
    return s.select("seq", "track_id", "frame", F.round("displacement", 6).alias("displacement"), F.round("speed", 6).alias("speed"))


def adjacent_links(spark: SparkSession, sf: str) -> DataFrame:
    return joins.adjacent_pairs(ad.detections(spark, sf), 0.3).select("seq", "frame", "a_det_id", "b_det_id", F.round("iou", 6).alias("iou"))


def nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    points = ad.track_points(spark, sf).where("frame % 3 <> 1").select("track_id", "frame", "x1", "y1")
    queries = ad.track_points(spark, sf).where("frame % 3 = 1").select("track_id", "frame")
    return joins.nearest_frame(points, queries)


def roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    back = d.where("det_id % 17 <> 0").withColumn("x1", F.col("x1") + F.when(F.col("det_id") % 5 == 0, 0.25).otherwise(0.0)).withColumn("det_id", F.when(F.col("det_id") % 101 == 0, -F.col("det_id")).otherwise(F.col("det_id")))
    return joins.roundtrip_diff(d, back, ["seq", "frame", "det_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("deviation").alias("worst"))


def orphan_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = ad.table(spark, sf, "documents"), ad.table(spark, sf, "labels")
    images = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("image"))
    return joins.orphan_labels(images, labels.select(F.col("doc_id").alias("image")))


def centre_matches(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    return joins.center_matches(d.withColumn("x1", F.col("x1") + F.col("det_id") % 40).withColumn("x2", F.col("x2") + F.col("det_id") % 40), d.where("det_id % 3 <> 0"))


def repaired_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.detections(spark, sf).select("det_id", F.concat_ws("-", "seq", "frame").alias("image"), F.when(F.col("det_id") % 3 == 0, F.concat(F.lit("run"), (F.col("det_id") % 4).cast("string"))).alias("run"))
    return joins.fill_run(rows).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (class_normalization, plausibility, subsampled_positions, camera_adjusted, same_frame_overlaps, possession, possession_share, nearest_player, track_speed, track_statistics, run_summary, calibrated_speed, adjacent_links, nearest_frame, roundtrip, orphan_labels, centre_matches, repaired_runs)}

_HUMANS = "h AS (SELECT *, CASE WHEN track_id % 15 = 0 THEN 'goalkeeper' ELSE 'player' END cls FROM track_points)"
_BALL = "ball AS (SELECT seq, frame, x1, y1, x2, y2 FROM ball_candidates WHERE conf >= 0.25 QUALIFY row_number() OVER (PARTITION BY seq, frame ORDER BY conf DESC, x1, cand_id DESC) = 1)"
_FOOT = "least(sqrt(pow(h.x1 - (b.x1+b.x2)/2, 2) + pow(h.y2 - (b.y1+b.y2)/2, 2)), sqrt(pow(h.x2 - (b.x1+b.x2)/2, 2) + pow(h.y2 - (b.y1+b.y2)/2, 2)))"
_NEAR = f"near AS (SELECT b.seq, b.frame, h.track_id possessor_id, h.cls possessor_cls, h.team, {_FOOT} distance FROM ball b JOIN h USING (seq, frame) WHERE {_FOOT} < 70 QUALIFY row_number() OVER (PARTITION BY b.seq, b.frame ORDER BY {_FOOT}, CASE WHEN h.cls = 'player' THEN 0 ELSE 1 END, h.track_id) = 1)"
_POSS = f"{_HUMANS}, {_BALL}, {_NEAR}, poss AS (SELECT f.seq, f.frame, possessor_id, possessor_cls, CAST(coalesce(CASE WHEN possessor_cls = 'goalkeeper' THEN 0 ELSE team END, 0) AS INT) team FROM frames f LEFT JOIN near USING (seq, frame))"
_PTS = "p AS (SELECT seq, track_id, frame, (x1+x2)/2 px, y2 py, team FROM track_points)"
_SPEED = f"""{_PTS}, n AS (SELECT seq, max(frame) n1 FROM p GROUP BY 1),
s AS (SELECT p.*, least(frame + 5, n1) e FROM p JOIN n USING (seq) WHERE frame % 5 = 0),
w AS (SELECT s.seq, s.track_id, s.frame st, s.e, sqrt(pow(s.px-q.px, 2)+pow(s.py-q.py, 2))/12 m FROM s JOIN p q ON q.seq = s.seq AND q.track_id = s.track_id AND q.frame = s.e),
v AS (SELECT *, CASE WHEN e > st THEN m / ((e - st) / 5.0::DOUBLE) * 3.6 ELSE 0 END speed, sum(m) OVER (PARTITION BY seq, track_id ORDER BY st) distance FROM w),
x AS (SELECT p.seq, p.track_id, p.frame, speed, distance FROM v JOIN p ON p.seq = v.seq AND p.track_id = v.track_id AND p.frame BETWEEN st AND e QUALIFY row_number() OVER (PARTITION BY p.seq, p.track_id, p.frame ORDER BY st DESC) = 1)"""

ORACLE_SQL = {
    "class_normalization": with_adapters("""SELECT c cls, CASE WHEN conf >= 0.25 THEN 'observed' ELSE 'candidate_low_conf' END state, count(*) n
 FROM (SELECT CASE WHEN det_id % 7 = 0 THEN 'player' WHEN det_id % 11 = 0 THEN NULL ELSE cls END c, conf FROM detections) WHERE c IS NOT NULL AND conf >= 0.10 GROUP BY 1, 2""", "detections"),
    "plausibility": with_adapters("SELECT det_id, CASE WHEN x2-x1 <= 0 OR y2-y1 <= 0 THEN 'degenerate' WHEN x2-x1 < 25 THEN 'too_narrow' WHEN x2-x1 > 55 THEN 'too_wide' WHEN (x2-x1)/(y2-y1) < 0.3 THEN 'too_tall' WHEN (x2-x1)/(y2-y1) > 1.0 THEN 'too_flat' END reason FROM detections", "detections"),
    "subsampled_positions": with_adapters("SELECT seq, frame // 4 frame, det_id, CAST(trunc((x1+x2)/2) AS INT) px, CAST(trunc(CASE WHEN cls = 'ball' THEN (y1+y2)/2 ELSE y2 END) AS INT) py FROM detections WHERE conf >= 0.25 AND frame % 4 = 0", "detections"),
    "camera_adjusted": with_adapters("""SELECT det_id, px - CASE WHEN still THEN 0.0 ELSE dx END ax, py - CASE WHEN still THEN 0.0 ELSE dy END ay
 FROM (SELECT seq, frame, det_id, CAST(trunc((x1+x2)/2) AS INT) px, CAST(trunc(CASE WHEN cls = 'ball' THEN (y1+y2)/2 ELSE y2 END) AS INT) py FROM detections)
 LEFT JOIN (SELECT seq, frame, dx, dy, sqrt(dx*dx+dy*dy) <= 5 OR frame = 0 still FROM (SELECT seq, frame, det_id, CAST(det_id%13-6 AS DOUBLE) dx, CAST(det_id%7-3 AS DOUBLE) dy FROM detections WHERE det_id % 5 > 0)
  QUALIFY row_number() OVER (PARTITION BY seq, frame ORDER BY sqrt(dx*dx+dy*dy) DESC, det_id) = 1) USING (seq, frame)""", "detections"),
    "possession": with_adapters(f"WITH {_POSS} SELECT * FROM poss", "track_points", "ball_candidates", "frames"),
    "possession_share": with_adapters(f"""WITH {_POSS} SELECT seq, frame, possessor_id, team, round(CASE WHEN k > 0 THEN a / k ELSE 0 END, 6) share1, round(CASE WHEN k > 0 THEN b / k ELSE 0 END, 6) share2
 FROM (SELECT *, sum(CAST(team > 0 AS INT)) OVER w k, CAST(sum(CAST(team = 1 AS INT)) OVER w AS DOUBLE) a, CAST(sum(CAST(team = 2 AS INT)) OVER w AS DOUBLE) b FROM poss WINDOW w AS (PARTITION BY seq ORDER BY frame))""", "track_points", "ball_candidates", "frames"),
    "nearest_player": with_adapters(f"""WITH {_HUMANS}, {_BALL} SELECT b.seq, b.frame, h.track_id possessor_id, h.team, round({_FOOT}, 6) distance FROM ball b JOIN h USING (seq, frame) WHERE h.cls = 'player' AND {_FOOT} < 120
 QUALIFY row_number() OVER (PARTITION BY b.seq, b.frame ORDER BY {_FOOT}, h.track_id) = 1""", "track_points", "ball_candidates"),
    "track_speed": with_adapters(f"WITH {_SPEED} SELECT seq, track_id, frame, round(speed, 6) speed, round(distance, 6) distance FROM x", "track_points"),
    "track_statistics": with_adapters(f"WITH {_SPEED} SELECT p.seq, p.track_id, round(max(speed), 6) max_speed, round(max(distance), 6) max_distance, count(*) appearances, CAST(arg_min(team, p.frame) AS INT) team FROM p LEFT JOIN x USING (seq, track_id, frame) GROUP BY 1, 2", "track_points"),
    "run_summary": with_adapters("""SELECT f.seq, f.n frames, coalesce(t.ids, 0) track_ids, coalesce(t.k, 0) in_first_frame FROM (SELECT seq, count(*) n, min(frame) a FROM frames GROUP BY 1) f
 LEFT JOIN (SELECT seq, count(DISTINCT track_id) ids, count(*) FILTER (WHERE frame = (SELECT min(frame) FROM frames g WHERE g.seq = t.seq)) k FROM track_points t GROUP BY 1) t USING (seq)""", "track_points", "frames"),
    "calibrated_speed": with_adapters(f"""WITH {_PTS}, sg AS (SELECT r_regionkey o, r_regionkey*30 f0, r_regionkey*40+35 f1 FROM region WHERE r_regionkey < 3),
m AS (SELECT p.seq, track_id, frame, o, (CAST(0.1 AS DOUBLE)*px + CAST(0.01 AS DOUBLE)*o*py + 1)/(CAST(0.0005 AS DOUBLE)*py + 1) mx, (CAST(0.2 AS DOUBLE)*py + 2 + o)/(CAST(0.0005 AS DOUBLE)*py + 1) my FROM p LEFT JOIN sg ON frame BETWEEN f0 AND f1
 QUALIFY row_number() OVER (PARTITION BY p.seq, track_id, frame ORDER BY o NULLS LAST) = 1)
SELECT a.seq, a.track_id, a.frame, round(CASE WHEN a.o = b.o THEN sqrt(pow(a.mx-b.mx, 2)+pow(a.my-b.my, 2)) END, 6) displacement, round(CASE WHEN a.o = b.o THEN sqrt(pow(a.mx-b.mx, 2)+pow(a.my-b.my, 2)) / CAST(0.6 AS DOUBLE) END, 6) speed
FROM m a JOIN m b ON a.seq = b.seq AND a.track_id = b.track_id AND b.frame = a.frame + 3""", "track_points"),
    "adjacent_links": with_adapters(f"""WITH p AS (SELECT a.seq, a.frame, a.det_id a_det_id, b.det_id b_det_id, {iou_sql('a.', 'b.')} iou FROM detections a JOIN detections b ON a.seq = b.seq AND b.frame = a.frame + 1 AND a.cls = b.cls)
SELECT seq, frame, a_det_id, b_det_id, round(iou, 6) iou FROM (SELECT *, row_number() OVER (PARTITION BY a_det_id ORDER BY iou DESC, b_det_id) ra, row_number() OVER (PARTITION BY b_det_id ORDER BY iou DESC, a_det_id) rb FROM p WHERE iou >= 0.3) WHERE ra = 1 AND rb = 1""", "detections"),
    "nearest_frame": with_adapters("""SELECT q.track_id, q.frame, p.frame at_frame, p.x1, p.y1 FROM track_points q JOIN track_points p ON p.track_id = q.track_id AND p.frame % 3 <> 1 WHERE q.frame % 3 = 1
 QUALIFY row_number() OVER (PARTITION BY q.track_id, q.frame ORDER BY abs(p.frame - q.frame), p.frame) = 1""", "track_points"),
    "roundtrip": with_adapters("""SELECT CASE WHEN b.det_id IS NULL THEN 'dropped' WHEN a.det_id IS NULL THEN 'extra' ELSE 'both' END status, count(*) n, max(abs(a.x1 - b.x1)) worst FROM detections a
 FULL JOIN (SELECT seq, frame, CASE WHEN det_id % 101 = 0 THEN -det_id ELSE det_id END det_id, x1 + CASE WHEN det_id % 5 = 0 THEN 0.25 ELSE 0 END x1 FROM detections WHERE det_id % 17 <> 0) b ON a.seq = b.seq AND a.frame = b.frame AND a.det_id = b.det_id GROUP BY 1""", "detections"),
    "orphan_labels": "SELECT DISTINCT doc_id image, 'label_without_image' kind FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) UNION ALL SELECT DISTINCT doc_id, 'image_without_label' FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "centre_matches": with_adapters("""SELECT g.seq, g.frame, g.det_id g_det_id, min(p.det_id) p_det_id FROM detections g JOIN detections p USING (seq, frame) WHERE g.det_id % 3 <> 0
 AND sqrt(pow((g.x1+g.x2)/2 - (p.x1+p.x2)/2 - p.det_id % 40, 2) + pow((g.y1+g.y2)/2 - (p.y1+p.y2)/2, 2)) <= greatest(1.5*(g.x2-g.x1), 8) GROUP BY 1, 2, 3""", "detections"),
    "repaired_runs": with_adapters("""SELECT coalesce(run, max_run, 'other') run, count(*) n FROM (SELECT *, max(run) OVER (PARTITION BY seq, frame) max_run FROM (SELECT seq, frame, CASE WHEN det_id % 3 = 0 THEN 'run' || CAST(det_id % 4 AS VARCHAR) END run FROM detections)) GROUP BY 1""", "detections"),
}
_HULL = "((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)))"
_INTER = "(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_UNION = f"((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - {_INTER})"
_CENTRE = "((pow((a.x1+a.x2-b.x1-b.x2)/2, 2) + pow((a.y1+a.y2-b.y1-b.y2)/2, 2)) / (pow(greatest(a.x2, b.x2) - least(a.x1, b.x1), 2) + pow(greatest(a.y2, b.y2) - least(a.y1, b.y1), 2)))"
_WIDE = "(least(a.x2 + {r}*(a.x2-a.x1), b.x2 + {r}*(b.x2-b.x1)) - greatest(a.x1 - {r}*(a.x2-a.x1), b.x1 - {r}*(b.x2-b.x1))) * (least(a.y2 + {r}*(a.y2-a.y1), b.y2 + {r}*(b.y2-b.y1)) - greatest(a.y1 - {r}*(a.y2-a.y1), b.y1 - {r}*(b.y2-b.y1)))".format(r="CAST(0.3 AS DOUBLE)")
ORACLE_SQL["same_frame_overlaps"] = with_adapters(f"""WITH p AS (SELECT a.det_id a_det_id, b.det_id b_det_id, {_INTER} / {_UNION} iou, {_HULL} hull, {_UNION} u, {_CENTRE} c, {_INTER} / ((a.x2-a.x1)*(a.y2-a.y1)) cover, {_WIDE} wi, CAST(2.56 AS DOUBLE)*((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1)) wa,
 pow(atan((a.x2-a.x1)/(a.y2-a.y1)) - atan((b.x2-b.x1)/(b.y2-b.y1)), 2) * 4 / pow(pi(), 2) v FROM detections a JOIN detections b USING (seq, frame, cls) WHERE a.det_id < b.det_id)
SELECT a_det_id, b_det_id, round(iou, 6) iou, round(wi / (wa - wi), 6) biou, round(iou - (hull - u) / hull, 6) giou, round(iou - c, 6) diou, round(iou - c - CASE WHEN 1 - iou + v > 0 THEN v / (1 - iou + v) * v ELSE 0 END, 6) ciou, round(cover, 6) cover FROM p WHERE iou >= 0.3""", "detections")
