"""Queries that match, dedupe and link boxes, and evaluate matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, matching
from . import adapters as ad
from .adapters import with_adapters
from .play import iou_sql
from .storage import cut


def _gt(spark, sf, boxes: DataFrame | None = None):
    return (ad.detections(spark, sf) if boxes is None else boxes).where("det_id % 3 <> 0")


def _preds(spark, sf, keep: str = "true", boxes: DataFrame | None = None):
    """All detections, moved by det_id % 5 pixels."""
    d = (ad.detections(spark, sf) if boxes is None else boxes).where(keep)
    return d.withColumn("x1", F.col("x1") + F.col("det_id") % 5).withColumn("x2", F.col("x2") + F.col("det_id") % 5)


def greedy_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_one_to_one(_gt(spark, sf), _preds(spark, sf), 0.3).select("g_det_id", "p_det_id", F.round("iou", 6).alias("iou"))


def centre_matched(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_one_to_one(_gt(spark, sf), _preds(spark, sf), cost="center", max_dist=40.0).select("g_det_id", "p_det_id", F.round("d", 6).alias("d"))


def confidence_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_by_confidence(_gt(spark, sf), _preds(spark, sf), 0.3).select("p_det_id", "g_det_id", F.round("iou", 6).alias("iou"))


def suppressed_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return matching.suppress_duplicates(ad.detections(spark, sf), "player", 0.3).select("det_id", "cls")


def merged_centres(spark: SparkSession, sf: str) -> DataFrame:
    return matching.merge_by_center(ad.detections(spark, sf), 25.0).select("det_id")


def deduped_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    twice = d.unionByName(d.where("det_id % 9 = 0").withColumn("det_id", -F.col("det_id")))
    return matching.dedupe_labels(twice, 0.3).select("det_id")


def annotation_agreement(spark: SparkSession, sf: str) -> DataFrame:
    d = cut(ad.detections(spark, sf))  # both sides are read several times
    changed = _preds(spark, sf, "det_id % 4 <> 0", d).withColumn("cls", F.when(F.col("det_id") % 10 == 0, "referee").otherwise(F.col("cls")))
    return matching.agreement(_gt(spark, sf, d), changed, 0.3).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tracklets(spark: SparkSession, sf: str) -> DataFrame:
    return matching.adjacent_tracklets(cut(ad.detections(spark, sf)), 0.2)


def identity_mapping(spark: SparkSession, sf: str) -> DataFrame:
    points = ad.track_points(spark, sf).withColumn("seq", (F.col("track_id") % 10).cast("int"))  # all tracks of a tenth of the users compete
    moved = points.withColumn("x1", F.col("x1") + F.col("frame") % 31).withColumn("x2", F.col("x2") + F.col("frame") % 31)
    moved = moved.withColumn("track_id", F.col("track_id") * 2 + (F.col("frame") > 60).cast("int"))
    return matching.identity_map(moved, points.withColumnRenamed("track_id", "gt_id"))


def linked_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return matching.link_tracks(cut(ad.detections(spark, sf)), 30.0).select("seq", "frame", "det_id", "track_id")


def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.pr_by_class(_gt(spark, sf), _preds(spark, sf), 0.25, 0.5), "precision", "recall")


def role_confusion(spark: SparkSession, sf: str) -> DataFrame:
    changed = _preds(spark, sf).withColumn("cls", F.when(F.col("det_id") % 10 == 0, "referee").otherwise(F.col("cls")))
    return evaluate.role_confusion(_gt(spark, sf), changed, 0.5)


def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    d = cut(ad.detections(spark, sf))
    return _rounded(evaluate.threshold_grid(_gt(spark, sf, d), _preds(spark, sf, boxes=d), [0.1, 0.25, 0.5, 0.75], 0.5), "precision", "recall")


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = cut(ad.detections(spark, sf))
    return evaluate.average_precision(_gt(spark, sf, d), _preds(spark, sf, boxes=d), [0.5, 0.75]).select("cls", "iou", F.round("ap", 6).alias("ap"))


def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = cut(ad.detections(spark, sf))
    found = evaluate.mean_average_precision(_gt(spark, sf, d), _preds(spark, sf, "seq % 3 <> 1 or cls <> 'ball'", d))
    return _rounded(found, "ap50", "ap75", "map")


def paired_models(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.paired_compare(_gt(spark, sf), _preds(spark, sf, "det_id % 7 <> 0"), _preds(spark, sf, "det_id % 4 <> 0"), 0.5)
    return _rounded(found, "mean_iou_a", "mean_iou_b", "p_value")


def geometry_errors(spark: SparkSession, sf: str) -> DataFrame:
    m = matching.match_one_to_one(_gt(spark, sf), _preds(spark, sf), 0.3)
    return _rounded(evaluate.geometry_error(m, _gt(spark, sf), _preds(spark, sf)), "mean_centre", "median_centre", "p90_centre", "mean_area_ratio", "within_2px")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


QUERIES = {f.__name__: f for f in (greedy_matches, centre_matched, confidence_matches, suppressed_duplicates, merged_centres, deduped_labels, annotation_agreement, tracklets, identity_mapping, linked_tracks, precision_recall, role_confusion, threshold_grid, average_precision, mean_average_precision, paired_models, geometry_errors)}

_SETS = """gt AS (SELECT * FROM detections WHERE det_id % 3 <> 0),
pr AS (SELECT seq, frame, det_id, x1 + det_id % 5 AS x1, y1, x2 + det_id % 5 AS x2, y2, cls, conf FROM detections)"""


def _greedy(pairs: str, group: str, name: str = "m") -> str:
    """Common table expressions: name(g, p, v) of pairs(grp, i, g, p, v) taken in the order of i while both sides are free."""
    return f"""{name}_p AS ({pairs}),
{name}_r AS (SELECT {group} grp, g, p, v, row_number() OVER (PARTITION BY {group} ORDER BY o, g, p) i FROM {name}_p),
{name}_f AS (SELECT grp, CAST(0 AS BIGINT) i, CAST([] AS BIGINT[]) ug, CAST([] AS BIGINT[]) up, false took, CAST(NULL AS BIGINT) g, CAST(NULL AS BIGINT) p, CAST(NULL AS DOUBLE) v FROM (SELECT DISTINCT grp FROM {name}_r)
 UNION ALL SELECT f.grp, r.i, CASE WHEN list_contains(f.ug, r.g) OR list_contains(f.up, r.p) THEN f.ug ELSE list_append(f.ug, r.g) END,
  CASE WHEN list_contains(f.ug, r.g) OR list_contains(f.up, r.p) THEN f.up ELSE list_append(f.up, r.p) END, NOT (list_contains(f.ug, r.g) OR list_contains(f.up, r.p)), r.g, r.p, r.v
 FROM {name}_f f JOIN {name}_r r ON r.grp = f.grp AND r.i = f.i + 1),
{name} AS (SELECT g, p, v FROM {name}_f WHERE took)"""


def _iou_pairs(gt: str = "gt", pr: str = "pr", by_class: bool = True, thr: float = 0.3) -> str:
    on = "USING (seq, frame, cls)" if by_class else "USING (seq, frame)"
    return f"SELECT * FROM (SELECT seq, frame, {'cls, ' if by_class else ''}a.det_id g, b.det_id p, {iou_sql('a.', 'b.')} v, -({iou_sql('a.', 'b.')}) o FROM {gt} a JOIN {pr} b {on}) WHERE v >= {thr}"


_CLS = "(seq, frame, cls)"
_FRAME = "(seq, frame)"


def _apart(source: str, group: str, order: str, same: str) -> str:
    """Rows kept in turn: each unless ``same`` as one kept before (k: kept, r: new)."""
    return f"""s_r AS (SELECT {group} grp, det_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY {group} ORDER BY {order}) i FROM {source}),
s_f AS (SELECT grp, i, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] kept, det_id, true took FROM s_r WHERE i = 1
 UNION ALL SELECT grp, i, CASE WHEN hit THEN kept ELSE list_append(kept, b) END, det_id, NOT hit FROM (SELECT r.grp, r.i, f.kept, r.det_id, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}} b,
  len(list_filter(f.kept, lambda k: {same})) > 0 hit FROM s_f f JOIN s_r r ON r.grp = f.grp AND r.i = f.i + 1))"""


_PR = "round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS \"precision\", round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 6) recall"
_MOVED = "(SELECT seq, frame, det_id, x1 + det_id % 5 AS x1, y1, x2 + det_id % 5 AS x2, y2, cls, conf FROM detections WHERE {})"

ORACLE_SQL = {
    "greedy_matches": with_adapters(f"WITH RECURSIVE {_SETS}, {_greedy(_iou_pairs(), _CLS)} SELECT g g_det_id, p p_det_id, round(v, 6) iou FROM m", "detections"),
    "centre_matched": with_adapters(f"WITH RECURSIVE {_SETS}, {_greedy('SELECT * FROM (SELECT seq, frame, cls, a.det_id g, b.det_id p, sqrt(pow((a.x1+a.x2)/2-(b.x1+b.x2)/2, 2)+pow((a.y1+a.y2)/2-(b.y1+b.y2)/2, 2)) v, v o FROM gt a JOIN pr b USING (seq, frame, cls)) WHERE v < 40', _CLS)} SELECT g g_det_id, p p_det_id, round(v, 6) d FROM m", "detections"),
    "confidence_matches": with_adapters(f"""WITH RECURSIVE {_SETS}, {_greedy(f"SELECT seq, frame, cls, g, p, v, row_number() OVER (PARTITION BY seq, frame, cls ORDER BY conf DESC, p, v DESC, g) o FROM ({_iou_pairs()}) JOIN (SELECT det_id p, conf FROM pr) USING (p)", _CLS)}
SELECT pr.det_id p_det_id, m.g g_det_id, round(m.v, 6) iou FROM pr LEFT JOIN m ON m.p = pr.det_id""", "detections"),
    "suppressed_duplicates": with_adapters(f"WITH RECURSIVE src AS (SELECT * FROM detections WHERE cls = 'player'), {_apart('src', _FRAME, 'conf DESC, det_id', iou_sql('k.', 'r.') + ' >= 0.3')} SELECT det_id, cls FROM detections WHERE cls <> 'player' OR det_id IN (SELECT det_id FROM s_f WHERE took)", "detections"),
    "merged_centres": with_adapters(f"WITH RECURSIVE {_apart('detections', _FRAME, 'conf DESC, det_id', 'sqrt(pow((k.x1+k.x2)/2-(r.x1+r.x2)/2, 2)+pow((k.y1+k.y2)/2-(r.y1+r.y2)/2, 2)) <= 25')} SELECT det_id FROM s_f WHERE took", "detections"),
    "deduped_labels": with_adapters(f"""WITH RECURSIVE src AS (SELECT * FROM (SELECT * FROM detections UNION ALL SELECT seq, frame, -det_id, x1, y1, x2, y2, cls, conf FROM detections WHERE det_id % 9 = 0)
 QUALIFY row_number() OVER (PARTITION BY seq, frame, cls, x1, y1, x2, y2 ORDER BY det_id) = 1), {_apart('src', _CLS, '(x2-x1)*(y2-y1) DESC, det_id', iou_sql('k.', 'r.') + ' >= 0.3')} SELECT det_id FROM s_f WHERE took""", "detections"),
    "annotation_agreement": with_adapters(f"""WITH RECURSIVE gt AS (SELECT * FROM detections WHERE det_id % 3 <> 0), pr AS (SELECT seq, frame, det_id, x1, y1, x2, y2, CASE WHEN det_id % 10 = 0 THEN 'referee' ELSE cls END cls FROM {_MOVED.format('det_id % 4 <> 0')}),
{_greedy(_iou_pairs(by_class=False), _FRAME)},
t AS (SELECT CASE WHEN gt.cls <> pr.cls THEN 'role_differs' WHEN v < 0.8 THEN 'loose' ELSE 'matched' END status FROM m JOIN gt ON gt.det_id = g JOIN pr ON pr.det_id = p
 UNION ALL SELECT 'missing' FROM gt WHERE det_id NOT IN (SELECT g FROM m) UNION ALL SELECT 'extra' FROM pr WHERE det_id NOT IN (SELECT p FROM m)) SELECT status, count(*) n FROM t GROUP BY 1""", "detections"),
    "tracklets": with_adapters(f"""WITH RECURSIVE p AS (SELECT a.det_id a, b.det_id b, {iou_sql('a.', 'b.')} v FROM detections a JOIN detections b ON a.seq = b.seq AND b.frame = a.frame + 1 AND a.cls = b.cls),
e AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) ra, row_number() OVER (PARTITION BY b ORDER BY v DESC, a) rb FROM p WHERE v >= 0.2) WHERE ra = 1 AND rb = 1),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (SELECT det_id a, det_id b FROM detections UNION SELECT w.a, s.b FROM w JOIN s ON s.a = w.b),
t AS (SELECT a det_id, min(b) tracklet FROM w GROUP BY 1) SELECT det_id, tracklet, count(*) OVER (PARTITION BY tracklet) length FROM t""", "detections"),
    "identity_mapping": with_adapters(f"""WITH tp AS (SELECT * REPLACE (CAST(track_id % 10 AS INT) AS seq) FROM track_points), t AS (SELECT seq, frame, track_id*2 + CAST(frame > 60 AS INT) track_id, x1 + frame%31 x1, y1, x2 + frame%31 x2, y2 FROM tp),
b AS (SELECT a.seq, a.frame, a.track_id, g.track_id gt_id FROM t a JOIN tp g USING (seq, frame) WHERE {iou_sql('a.', 'g.')} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.seq, a.frame, a.track_id ORDER BY {iou_sql('a.', 'g.')} DESC, g.track_id) = 1),
v AS (SELECT seq, track_id, gt_id, count(*) votes, row_number() OVER (PARTITION BY seq, track_id ORDER BY count(*) DESC, gt_id) rk FROM b GROUP BY 1, 2, 3),
s AS (SELECT seq, track_id, count(DISTINCT frame) frames FROM t GROUP BY 1, 2),
r AS (SELECT s.seq, s.track_id, s.frames, a.gt_id, a.votes, CASE WHEN frames < 2 THEN 'too_short' WHEN a.votes IS NULL THEN 'no_support' WHEN a.votes < 0.5*frames THEN 'low_support_rate' WHEN coalesce(n.votes, 0)*2 > a.votes THEN 'not_dominant' ELSE 'mapped' END reason
 FROM s LEFT JOIN (SELECT * FROM v WHERE rk = 1) a USING (seq, track_id) LEFT JOIN (SELECT * FROM v WHERE rk = 2) n USING (seq, track_id)),
c AS (SELECT x.seq, x.track_id, max(CASE WHEN y.votes > x.votes THEN 2 WHEN y.votes = x.votes THEN 1 ELSE 0 END) worst FROM r x JOIN r y ON x.seq = y.seq AND x.gt_id = y.gt_id AND x.track_id <> y.track_id
 WHERE x.reason = 'mapped' AND y.reason = 'mapped' AND EXISTS (SELECT 1 FROM t p JOIN t q ON p.seq = q.seq AND p.frame = q.frame WHERE p.seq = x.seq AND p.track_id = x.track_id AND q.track_id = y.track_id) GROUP BY 1, 2)
SELECT r.seq, r.track_id, frames, votes, CASE worst WHEN 2 THEN 'conflict_lost' WHEN 1 THEN 'conflict_tied' ELSE reason END reason, CASE WHEN reason = 'mapped' AND coalesce(worst, 0) = 0 THEN gt_id END gt_id FROM r LEFT JOIN c USING (seq, track_id)""", "track_points"),
    "precision_recall": with_adapters(f"""WITH RECURSIVE {_SETS}, q AS (SELECT * FROM pr WHERE conf >= 0.25), {_greedy(_iou_pairs(pr='q', thr=0.5), _CLS)},
c AS (SELECT cls, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM (SELECT cls, CAST(det_id IN (SELECT p FROM m) AS INT) tp, CAST(det_id NOT IN (SELECT p FROM m) AS INT) fp, 0 fn FROM q UNION ALL SELECT cls, 0, 0, CAST(det_id NOT IN (SELECT g FROM m) AS INT) FROM gt) GROUP BY 1)
SELECT cls, tp, fp, fn, {_PR} FROM c""", "detections"),
    "role_confusion": with_adapters(f"""WITH RECURSIVE gt AS (SELECT * FROM detections WHERE det_id % 3 <> 0), pr AS (SELECT seq, frame, det_id, x1, y1, x2, y2, CASE WHEN det_id % 10 = 0 THEN 'referee' ELSE cls END cls FROM {_MOVED.format('true')}), {_greedy(_iou_pairs(by_class=False, thr=0.5), _FRAME)},
j AS (SELECT gt.cls, pr.cls pcls FROM gt LEFT JOIN m ON m.g = gt.det_id LEFT JOIN pr ON pr.det_id = m.p)
SELECT cls, count(*) FILTER (WHERE pcls = 'player') player, count(*) FILTER (WHERE pcls = 'goalkeeper') goalkeeper, count(*) FILTER (WHERE pcls = 'referee') referee, count(*) FILTER (WHERE pcls = 'ball') ball,
 count(*) FILTER (WHERE pcls = cls) correct, count(*) FILTER (WHERE pcls <> cls) wrong_role, count(*) FILTER (WHERE pcls IS NULL) missed FROM j GROUP BY 1""", "detections"),
    "threshold_grid": with_adapters(f"""WITH RECURSIVE {_SETS}, th AS (SELECT unnest([0.1, 0.25, 0.5, 0.75]::DOUBLE[]) threshold), g2 AS (SELECT * FROM gt, th), q AS (SELECT * FROM pr, th WHERE conf >= threshold),
{_greedy(f"SELECT * FROM (SELECT a.seq, a.frame, a.cls, a.threshold, a.det_id g, b.det_id p, {iou_sql('a.', 'b.')} v, -({iou_sql('a.', 'b.')}) o FROM g2 a JOIN q b USING (seq, frame, cls, threshold)) WHERE v >= 0.5", "(seq, frame, cls, threshold)")},
mm AS (SELECT grp, g, p FROM m_f WHERE took), k AS (SELECT struct_extract(grp, 'threshold') threshold, count(*) tp FROM mm GROUP BY 1),
c AS (SELECT threshold, coalesce(tp, 0) tp, (SELECT count(*) FROM q WHERE q.threshold = th.threshold) - coalesce(tp, 0) fp, (SELECT count(*) FROM gt) - coalesce(tp, 0) fn FROM th LEFT JOIN k USING (threshold))
SELECT threshold, tp, fp, fn, {_PR} FROM c""".replace("(seq, frame, cls, threshold) grp", "{'seq': seq, 'frame': frame, 'cls': cls, 'threshold': threshold} grp"), "detections"),
    "paired_models": with_adapters(f"""WITH RECURSIVE gt AS (SELECT * FROM detections WHERE det_id % 3 <> 0), pa AS {_MOVED.format('det_id % 7 <> 0')}, pb AS {_MOVED.format('det_id % 4 <> 0')},
{_greedy(_iou_pairs(pr='pa', thr=0.5), _CLS, 'ma')}, {_greedy(_iou_pairs(pr='pb', thr=0.5), _CLS, 'mb')},
j AS (SELECT a.v va, b.v vb FROM gt LEFT JOIN ma a ON a.g = det_id LEFT JOIN mb b ON b.g = det_id),
c AS (SELECT count(*) FILTER (WHERE va IS NOT NULL AND vb IS NOT NULL) AS "both", count(*) FILTER (WHERE va IS NOT NULL AND vb IS NULL) a_only, count(*) FILTER (WHERE va IS NULL AND vb IS NOT NULL) b_only, count(*) FILTER (WHERE va IS NULL AND vb IS NULL) neither,
 avg(va) FILTER (WHERE vb IS NOT NULL) mean_iou_a, avg(vb) FILTER (WHERE va IS NOT NULL) mean_iou_b FROM j)
SELECT "both", a_only, b_only, neither, round(mean_iou_a, 6) mean_iou_a, round(mean_iou_b, 6) mean_iou_b,
 round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(a_only+b_only+1) - lgamma(i+1) - lgamma(a_only+b_only-i+1) + (a_only+b_only)*ln(CAST(0.5 AS DOUBLE))) FOR i IN range(least(a_only, b_only)+1)])) END, 6) p_value FROM c""", "detections"),
    "geometry_errors": with_adapters(f"""WITH RECURSIVE {_SETS}, {_greedy(_iou_pairs(), _CLS)},
e AS (SELECT gt.cls, sqrt(pow((gt.x1+gt.x2)/2-(pr.x1+pr.x2)/2, 2)+pow((gt.y1+gt.y2)/2-(pr.y1+pr.y2)/2, 2)) c, (pr.x2-pr.x1)*(pr.y2-pr.y1)/((gt.x2-gt.x1)*(gt.y2-gt.y1)) a FROM m JOIN gt ON gt.det_id = g JOIN pr ON pr.det_id = p)
SELECT cls, count(*) n, round(avg(c), 6) mean_centre, round(quantile_cont(c, 0.5), 6) median_centre, round(quantile_cont(c, 0.9), 6) p90_centre, round(avg(a), 6) mean_area_ratio, round(avg(CAST(c <= 2 AS INT)), 6) within_2px FROM e GROUP BY 1""", "detections"),
}
_AP = f"""WITH RECURSIVE {_SETS}, th AS (SELECT unnest([0.5, 0.75]::DOUBLE[]) iou),
a_r AS (SELECT {{'seq': seq, 'frame': frame, 'cls': cls, 'iou': t}} grp, g, p, row_number() OVER (PARTITION BY seq, frame, cls, t ORDER BY conf DESC, p, v DESC, g) i FROM (SELECT x.*, conf, th.iou t FROM ({_iou_pairs(thr=0.5)}) x JOIN (SELECT det_id p, conf FROM pr) USING (p) JOIN th ON v >= th.iou)),
a_f AS (SELECT grp, CAST(0 AS BIGINT) i, CAST([] AS BIGINT[]) ug, CAST([] AS BIGINT[]) up, false took, CAST(NULL AS BIGINT) p FROM (SELECT DISTINCT grp FROM a_r)
 UNION ALL SELECT f.grp, r.i, CASE WHEN list_contains(f.ug, r.g) OR list_contains(f.up, r.p) THEN f.ug ELSE list_append(f.ug, r.g) END, CASE WHEN list_contains(f.ug, r.g) OR list_contains(f.up, r.p) THEN f.up ELSE list_append(f.up, r.p) END, NOT (list_contains(f.ug, r.g) OR list_contains(f.up, r.p)), r.p
 FROM a_f f JOIN a_r r ON r.grp = f.grp AND r.i = f.i + 1),
hit AS (SELECT grp.iou iou, p FROM a_f WHERE took),
n AS (SELECT cls, count(*) n FROM gt GROUP BY 1),
c AS (SELECT pr.cls, th.iou, pr.conf, pr.det_id, CAST(h.p IS NOT NULL AS INT) tp FROM pr JOIN th ON true LEFT JOIN hit h ON h.iou = th.iou AND h.p = pr.det_id),
d AS (SELECT c.cls, iou, sum(tp) OVER w / CAST(n AS DOUBLE) r, sum(tp) OVER w / CAST(count(*) OVER w AS DOUBLE) q FROM c JOIN n USING (cls) WINDOW w AS (PARTITION BY c.cls, iou ORDER BY conf DESC, det_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT cls, iou, i / CAST(100 AS DOUBLE) at FROM n, th, range(101) t(i))
SELECT k.cls, k.iou, round(avg(coalesce((SELECT max(q) FROM d WHERE d.cls = k.cls AND d.iou = k.iou AND d.r >= k.at - 1e-12), 0)), 6) ap FROM k GROUP BY 1, 2"""
ORACLE_SQL["average_precision"] = with_adapters(_AP.replace("/ CAST(100 AS DOUBLE) at", "/ CAST(100 AS DOUBLE) rc").replace("k.at", "k.rc"), "detections")
_MAP = f"""{_AP[: _AP.index("n AS (SELECT cls")].replace("[0.5, 0.75]", "[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]").replace("cls, conf FROM detections)", "cls, conf FROM detections WHERE seq % 3 <> 1 OR cls <> 'ball')")}parts AS (SELECT DISTINCT seq FROM detections WHERE det_id % 3 <> 0 OR seq % 3 <> 1 OR cls <> 'ball'),
ask AS (SELECT part, cls FROM (SELECT 'all' part UNION ALL SELECT CAST(seq AS VARCHAR) FROM parts), (VALUES ('player'), ('goalkeeper'), ('referee'), ('ball')) c(cls)),
g2 AS (SELECT 'all' part, cls FROM gt UNION ALL SELECT CAST(seq AS VARCHAR), cls FROM gt), n AS (SELECT part, cls, count(*) n FROM g2 GROUP BY 1, 2),
p2 AS (SELECT 'all' part, cls, conf, det_id FROM pr UNION ALL SELECT CAST(seq AS VARCHAR), cls, conf, det_id FROM pr), s AS (SELECT part, cls, count(*) s FROM p2 GROUP BY 1, 2),
c AS (SELECT p2.part, p2.cls, th.iou, p2.conf, p2.det_id, CAST(h.p IS NOT NULL AS INT) tp FROM p2 JOIN th ON true LEFT JOIN hit h ON h.iou = th.iou AND h.p = p2.det_id),
d AS (SELECT part, cls, iou, sum(tp) OVER w / CAST(n AS DOUBLE) r, sum(tp) OVER w / CAST(count(*) OVER w AS DOUBLE) q FROM c JOIN n USING (part, cls) WINDOW w AS (PARTITION BY part, cls, iou ORDER BY conf DESC, det_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT part, cls, iou, CAST(floor(r * 100 + 1e-9) AS INT) l, max(q) q FROM d GROUP BY ALL),
a AS (SELECT part, cls, iou, sum(b) / 101 ap FROM (SELECT n.part, n.cls, th.iou, i, max(l.q) b FROM n JOIN th ON true JOIN range(101) t(i) ON true LEFT JOIN l ON l.part = n.part AND l.cls = n.cls AND l.iou = th.iou AND l.l >= i GROUP BY ALL) GROUP BY ALL)
SELECT part, cls, coalesce(n, 0) truth, round(CASE WHEN n IS NULL THEN CASE WHEN s IS NULL THEN 1 ELSE 0 END ELSE coalesce(max(ap) FILTER (WHERE iou = 0.5), 0) END, 6) ap50, round(CASE WHEN n IS NULL THEN CASE WHEN s IS NULL THEN 1 ELSE 0 END ELSE coalesce(max(ap) FILTER (WHERE iou = 0.75), 0) END, 6) ap75,
 round(CASE WHEN n IS NULL THEN CASE WHEN s IS NULL THEN 1 ELSE 0 END ELSE coalesce(avg(coalesce(ap, 0)), 0) END, 6) AS "map" FROM ask LEFT JOIN n USING (part, cls) LEFT JOIN s USING (part, cls) LEFT JOIN a USING (part, cls) GROUP BY part, cls, n, s"""
ORACLE_SQL["mean_average_precision"] = with_adapters(_MAP, "detections")
