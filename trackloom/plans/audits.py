"""Queries of audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, temporal
from . import adapters as ad
from .adapters import with_adapters
from .play import iou_sql


def label_inventory(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    rows = d.select(F.col("seq").alias("source"), (F.col("det_id") % 5).alias("cls_id"), (F.col("x1") / 580).alias("cx"), (F.col("y1") / 290).alias("cy"), F.when(F.col("det_id") % 33 == 0, 0.0).otherwise(0.125).alias("w"), F.lit(0.25).alias("h"), F.lit(4).alias("classes"))
    return audit.inventory(rows)


def boxes_a_frame(spark: SparkSession, sf: str) -> DataFrame:
    return audit.multi_counts(ad.detections(spark, sf), "player")


def metric_changes(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.table(spark, sf, "documents")
    avg = lambda c: docs.where(c).groupBy(F.concat_ws("-", "source", "lang").alias("metric")).agg(F.avg("n_chars").alias("value"))
    d = audit.metric_delta(avg("doc_id % 3 <> 0"), avg("doc_id % 3 <> 1"))
    return d.select("metric", *(F.round(c, 6).alias(c) for c in ("old", "new", "delta")))


def missed_with_proposal(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    return audit.missed_with_proposal(d.where("det_id % 3 <> 0"), d.where("conf >= 0.4"), d.where("det_id % 5 <> 0"))


def proposal_costs(spark: SparkSession, sf: str) -> DataFrame:
    c = ad.ball_candidates(spark, sf).select("conf", (F.col("cand_id") % 3 == 0).cast("int").alias("hit"))
    f = audit.cost_curve(c, [0.5, 0.8, 0.9, 0.95, 1.0], 100)
    return f.select("target", "threshold", "per_image", F.round("recall", 6).alias("recall"))


def _triaged(spark, sf):
    d = ad.detections(spark, sf)
    boxes = d.where("cls <> 'ball'")
    kits = boxes.where("det_id % 4 <> 0").select("det_id", F.when(F.col("det_id") % 9 == 0, "referee").otherwise(F.col("cls")).alias("kit"))
    return boxes, audit.triage(boxes, d.where("conf >= 0.3"), kits, 0.3)


def role_triage(spark: SparkSession, sf: str) -> DataFrame:
    return _triaged(spark, sf)[1]


def clean_images(spark: SparkSession, sf: str) -> DataFrame:
    boxes, t = _triaged(spark, sf)
    named = t.join(boxes.select("det_id", F.concat_ws("-", "seq", "frame").alias("image")), "det_id")
    return audit.clean_subset(named, 2)


def kit_modes(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    return audit.kit_modes(d.select(F.concat(F.lit("run"), (F.col("seq") % 4).cast("string")).alias("run"), F.col("cls").alias("role"), ((F.col("x1") * 7) % 180).alias("h"), F.col("y1").alias("s"), F.col("y2").alias("v")))


def heldout_leakage(spark: SparkSession, sf: str) -> DataFrame:
    e = ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("sig"), "label")
    held = e.where("image_id % 7 = 0").withColumn("split", F.when(F.col("image_id") % 2 == 0, "val").otherwise("test"))
    # a seventh of the external images are held-out ones turned by a quarter
    turned = audit.oriented(held.select("image_id", "sig"), 8).where("turn = 1").select((F.col("image_id") + 1_000_000).alias("image_id"), "sig")
    found = audit.leakage(e.where("image_id % 7 <> 0").select("image_id", "sig").union(turned), held, 8)
    return found.select("image_id", "held_id", "split", F.round("ncc", 6).alias("ncc"))


def picture_cuts(spark: SparkSession, sf: str) -> DataFrame:
    e = ad.table(spark, sf, "embeddings").select(F.expr("CAST(vec_id div 25 AS INT)").alias("seq"), F.expr("CAST(vec_id % 25 AS INT)").alias("frame"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("sig"))
    return temporal.cut_flags(e, 12.0).select("seq", "frame", "cut")


QUERIES = {f.__name__: f for f in (label_inventory, boxes_a_frame, metric_changes, missed_with_proposal, proposal_costs, role_triage, clean_images, kit_modes, heldout_leakage, picture_cuts)}

_TRIAGE = f"""b AS (SELECT * FROM detections WHERE cls <> 'ball'), s AS (SELECT b.det_id, p.cls seen FROM b JOIN detections p USING (seq, frame) WHERE p.conf >= 0.3 AND {iou_sql('b.', 'p.')} >= 0.3 QUALIFY row_number() OVER (PARTITION BY b.det_id ORDER BY {iou_sql('b.', 'p.')} DESC, p.det_id) = 1),
j AS (SELECT b.det_id, b.seq, b.frame, seen, CASE WHEN b.det_id % 4 <> 0 THEN CASE WHEN b.det_id % 9 = 0 THEN 'referee' ELSE b.cls END END kit FROM b LEFT JOIN s USING (det_id)),
t AS (SELECT det_id, seq, frame, CASE WHEN seen = kit OR seen IS NULL OR kit IS NULL THEN coalesce(seen, kit, 'AMBIGUOUS') ELSE 'AMBIGUOUS' END AS "label", CASE WHEN seen IS NULL AND kit IS NULL THEN 'none' WHEN seen IS NULL OR kit IS NULL THEN 'one' WHEN seen = kit THEN 'both' ELSE 'differ' END agreement FROM j)"""

#: The places of an 8 x 8 signature's values in each of its orientations, in DuckDB SQL; i is a place.
_PLACES = ", ".join(f"[{t} FOR i IN range(64)]" for t in ("i", "(i % 8) * 8 + 7 - i // 8", "(7 - i // 8) * 8 + 7 - i % 8", "(7 - i % 8) * 8 + i // 8", "(i // 8) * 8 + 7 - i % 8", "(7 - i // 8) * 8 + i % 8", "(i % 8) * 8 + i // 8", "(7 - i % 8) * 8 + 7 - i // 8"))
_HASH = "list_sum([CASE WHEN {0}[i + 2] > {0}[i + 1] THEN CAST(1 AS HUGEINT) << i ELSE CAST(0 AS HUGEINT) END FOR i IN range(63)])::BIGINT"
_LEAKAGE = f"""WITH e AS (SELECT vec_id image_id, embedding sig FROM embeddings), places AS (SELECT unnest([{_PLACES}]) p, unnest(range(8)) turn),
turned AS (SELECT image_id, turn, [sig[i + 1] FOR i IN p] sig FROM e, places), x AS (SELECT image_id, sig FROM e WHERE image_id % 7 <> 0 UNION ALL SELECT image_id + 1000000, sig FROM turned WHERE image_id % 7 = 0 AND turn = 1),
o AS MATERIALIZED (SELECT image_id, sig, {_HASH.format('sig')} h FROM (SELECT image_id, [sig[i + 1] FOR i IN p] sig FROM x, places)), k AS MATERIALIZED (SELECT image_id held_id, CASE WHEN image_id % 2 = 0 THEN 'val' ELSE 'test' END split, sig held, {_HASH.format('sig')} hh FROM e WHERE image_id % 7 = 0),
n AS (SELECT image_id, held_id, split, list_cosine_similarity([CAST(v AS DOUBLE) - list_avg(sig) FOR v IN sig], [CAST(v AS DOUBLE) - list_avg(held) FOR v IN held]) ncc FROM o JOIN k ON bit_count(xor(h, hh)) <= 10)
SELECT image_id, held_id, split, round(max(ncc), 6) ncc FROM n WHERE ncc >= 0.95 GROUP BY 1, 2, 3"""

ORACLE_SQL = {
    "label_inventory": with_adapters("""WITH r AS (SELECT seq source, det_id % 5 cls_id, x1/580 cx, y1/290 cy, CASE WHEN det_id % 33 = 0 THEN 0.0 ELSE CAST(0.125 AS DOUBLE) END w, CAST(0.25 AS DOUBLE) h FROM detections),
p AS (SELECT *, cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 i, cx-w/2 < 0 OR cx+w/2 > 1 OR cy-h/2 < 0 OR cy+h/2 > 1 e FROM r),
v AS (SELECT source, 'out_of_range' problem FROM p WHERE NOT i UNION ALL SELECT source, 'out_of_bounds' FROM p WHERE i AND e UNION ALL SELECT source, 'zero_area' FROM p WHERE w*h = 0 UNION ALL SELECT source, 'unknown_class' FROM p WHERE cls_id > 3 UNION ALL SELECT source, 'ok' FROM p WHERE i AND NOT e AND w*h > 0 AND cls_id <= 3)
SELECT source, problem, count(*) n FROM v GROUP BY 1, 2""", "detections"),
    "boxes_a_frame": with_adapters("SELECT boxes, count(*) frames FROM (SELECT seq, frame, count(*) FILTER (WHERE cls = 'player') boxes FROM detections GROUP BY 1, 2) GROUP BY 1", "detections"),
    "metric_changes": """WITH o AS (SELECT source || '-' || lang metric, avg(n_chars) v FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1), n AS (SELECT source || '-' || lang metric, avg(n_chars) v FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1)
SELECT coalesce(o.metric, n.metric) metric, round(o.v, 6) AS "old", round(n.v, 6) AS "new", round(n.v - o.v, 6) delta FROM o FULL JOIN n ON o.metric = n.metric""",
    "missed_with_proposal": with_adapters(f"""WITH v AS (SELECT gt.cls, gt.det_id, max({iou_sql('gt.', 'p.')}) FILTER (WHERE p.conf >= 0.4) a, max({iou_sql('gt.', 'p.')}) FILTER (WHERE p.det_id % 5 <> 0) r FROM (SELECT * FROM detections WHERE det_id % 3 <> 0) gt JOIN detections p USING (seq, frame, cls) GROUP BY 1, 2)
SELECT cls, count(*) truth, count(*) FILTER (WHERE coalesce(a < 0.5, true)) missed, count(*) FILTER (WHERE coalesce(a < 0.5, true) AND coalesce(r >= 0.5, false)) with_proposal FROM v GROUP BY 1""", "detections"),
    "proposal_costs": with_adapters("""WITH p AS (SELECT conf, count(*) n, count(*) FILTER (WHERE cand_id % 3 = 0) h FROM ball_candidates GROUP BY 1), c AS (SELECT conf, sum(n) OVER (ORDER BY conf DESC) k, sum(h) OVER (ORDER BY conf DESC) / CAST(sum(h) OVER () AS DOUBLE) r FROM p), t AS (SELECT unnest([0.5, 0.8, 0.9, 0.95, 1.0]::DOUBLE[]) target)
SELECT target, max(conf) threshold, arg_max(k, conf) / CAST(100 AS DOUBLE) per_image, round(arg_max(r, conf), 6) recall FROM t JOIN c ON r + 1e-12 >= target GROUP BY 1""", "ball_candidates"),
    "role_triage": with_adapters(f'WITH {_TRIAGE} SELECT det_id, "label", agreement FROM t', "detections"),
    "clean_images": with_adapters(f"WITH {_TRIAGE} SELECT CAST(seq AS VARCHAR) || '-' || CAST(frame AS VARCHAR) image, count(*) boxes FROM t GROUP BY 1 HAVING bool_and(agreement = 'both')", "detections"),
    "kit_modes": with_adapters("""WITH c AS (SELECT 'run' || CAST(seq % 4 AS VARCHAR) run, cls AS "role", (x1*7) % 180 h, y1 s, y2 v FROM detections), n AS (SELECT run, "role", count(*) k FROM c GROUP BY 1, 2)
SELECT c.run, c."role", CAST(floor(h/15) AS INT) bucket, count(*) n, quantile_cont(h, 0.5) h, quantile_cont(s, 0.5) s, quantile_cont(v, 0.5) v FROM c JOIN n ON n.run = c.run AND n."role" = c."role" GROUP BY 1, 2, 3, k HAVING count(*) >= 3 AND count(*) >= k * CAST(0.05 AS DOUBLE)""", "detections"),
    "picture_cuts": """WITH e AS (SELECT CAST(vec_id // 25 AS INT) seq, CAST(vec_id % 25 AS INT) frame, embedding sig FROM embeddings), p AS (SELECT *, lag(sig) OVER (PARTITION BY seq ORDER BY frame) b FROM e)
SELECT seq, frame, coalesce(list_avg([abs(CAST(z[1] AS DOUBLE) * 100 - CAST(z[2] AS DOUBLE) * 100) FOR z IN list_zip(sig, b)]) > 12, false) cut FROM p""",
    "heldout_leakage": _LEAKAGE,
}
