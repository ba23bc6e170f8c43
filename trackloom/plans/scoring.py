"""Queries that score possession, rescue the ball and class switches of kit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, evaluate, teams, temporal
from . import adapters as ad
from .adapters import with_adapters
from .more import _descriptors
from .play import _POSS, possession
from .review import _EFF, _observed
from .storage import cut

DIMS = 6


def _answers(spark, sf):
    """Frames with a label of who has the ball and with who was given it: made from the possession of the given tables."""
    has = possession(spark, sf).select("seq", "frame", F.col("possessor_id").alias("assigned"))
    ball = _observed(spark, sf).select("seq", "frame", F.col("state").alias("ball_state"), F.col("x1").isNotNull().alias("ball_present"))
    return has.join(ball, ["seq", "frame"]).selectExpr(
        "seq", "frame", "seq * 100 + frame div 12 AS window", "ball_state", "ball_present", "assigned",
        "CASE (frame * 7 + seq) % 10 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'NO_BALL' WHEN 2 THEN 'NO_CONTROL' ELSE 'PLAYER' END label",
        "CASE WHEN frame % 4 = 0 THEN coalesce(assigned, 0) + 1 ELSE assigned END gt_player",
        "CASE WHEN assigned % 9 <> 0 THEN assigned END mapped", "CASE WHEN assigned % 5 = 0 THEN 0L ELSE assigned END mapped_before",
    )


def possession_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.possession_scores(_answers(spark, sf))


def possession_errors(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.possession_errors(_answers(spark, sf))


def possession_changes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.possession_changes(_answers(spark, sf), "seq", "frame")


def rescued_ball(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.select_ball(ad.ball_candidates(spark, sf), ad.frames(spark, sf), look_ahead=True)


def kit_switches(spark: SparkSession, sf: str) -> DataFrame:
    s = teams.switch_classes(_descriptors(spark, sf).withColumnRenamed("ord", "frame"), DIMS, share=0.15, separation=1.5, sustained=0.5)
    return s.select("track_id", "n", F.round("minority", 6).alias("minority"), F.round("separation", 6).alias("separation"), "longest", "kind")


def exact_intervals(spark: SparkSession, sf: str) -> DataFrame:
    documents = ad.table(spark, sf, "documents").select("doc_id", "source")
    population = documents.groupBy("source").agg(F.count(F.lit(1)).alias("population"))
    asked = ad.table(spark, sf, "labels").where("doc_id % 7 = 0").join(documents, "doc_id").groupBy("source").agg(F.sum(F.col("toxic").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    found = evaluate.exact_intervals(population.join(asked, "source"))
    return found.select("source", "k", "n", "population", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "least", "most")


def _export(spark, sf):
    """A ledger with its decisions, left-out images, ball cases, repairs and added boxes, made from the detections."""
    d = cut(ad.detections(spark, sf)).withColumn("box_id", F.concat(F.lit("box"), F.col("det_id").cast("string"))).withColumn("split", F.expr("CAST(seq % 3 AS INT)")).withColumn("image", F.concat_ws("-", "seq", "frame"))
    box = ["x1", "y1", "x2", "y2"]
    balls = d.where("det_id % 29 = 0").selectExpr("box_id", "CASE det_id % 3 WHEN 0 THEN 'REMOVE_ONLY' WHEN 1 THEN 'RECLASSIFY_TO_BALL' ELSE 'DRAW_BALL_BOX' END action", "x1 + 2 AS x1", "y1", "x2 - 2 AS x2", "y2")
    repairs = d.where("det_id % 19 = 0").selectExpr("box_id", "'player' cls", "x1 + 1 AS x1", "y1", "x2", "y2 + 1 AS y2")
    added = d.where("det_id % 53 = 0").selectExpr("concat('new', det_id) box_id", "split", "image", "'referee' cls", "x1 + 9 AS x1", "y1", "x2 + 9 AS x2", "y2", "CAST(NULL AS STRING) flagged_utc")
    ledger = d.select("box_id", "split", F.col("det_id").alias("id"), "image", "cls", *box)
    return ledger, decisions.effective_state(ad.decisions(spark, sf)), d.where("frame % 23 = 0").select("image").distinct(), balls, repairs, added


def exported_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.apply_decisions(*_export(spark, sf))


def export_conditions(spark: SparkSession, sf: str) -> DataFrame:
    ledger, state, excluded, balls, repairs, added = _export(spark, sf)
    return decisions.export_conditions(ledger, decisions.apply_decisions(ledger, state, excluded, balls, repairs, added), state, excluded, balls)


QUERIES = {f.__name__: f for f in (possession_scores, possession_errors, possession_changes, rescued_ball, kit_switches, exact_intervals, exported_boxes, export_conditions)}

_ANSWERS = f"""{_POSS}, ob AS (SELECT DISTINCT seq, frame FROM ball_candidates WHERE conf >= 0.25),
an AS (SELECT p.seq, p.frame, p.seq * 100 + p.frame // 12 AS "window", CASE WHEN ob.seq IS NULL THEN 'unknown' ELSE 'observed' END ball_state, ob.seq IS NOT NULL ball_present, p.possessor_id assigned,
 CASE (p.frame * 7 + p.seq) % 10 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'NO_BALL' WHEN 2 THEN 'NO_CONTROL' ELSE 'PLAYER' END AS "label", CASE WHEN p.frame % 4 = 0 THEN coalesce(p.possessor_id, 0) + 1 ELSE p.possessor_id END gt,
 CASE WHEN p.possessor_id % 9 <> 0 THEN p.possessor_id END m, CASE WHEN p.possessor_id % 5 = 0 THEN 0 ELSE p.possessor_id END mb FROM poss p LEFT JOIN ob ON ob.seq = p.seq AND ob.frame = p.frame),
ou AS (SELECT *, CASE WHEN "label" = 'PLAYER' THEN CASE WHEN assigned IS NULL THEN 'unassigned' WHEN m IS NULL THEN 'unmappable' WHEN m = gt THEN 'correct' ELSE 'wrong' END
 WHEN "label" <> 'AMBIGUOUS' AND assigned IS NOT NULL THEN 'false' END o, CASE WHEN "label" = 'PLAYER' THEN CASE WHEN assigned IS NULL THEN 'unassigned' WHEN mb = gt THEN 'correct' ELSE 'wrong' END END ob4 FROM an)"""
_COUNTS = """count(*) frames, count(*) FILTER (WHERE "label" = 'AMBIGUOUS') ambiguous, count(*) FILTER (WHERE "label" = 'PLAYER') player, count(*) FILTER (WHERE o IN ('correct', 'wrong')) mappable, count(*) FILTER (WHERE o = 'correct') correct,
 count(*) FILTER (WHERE o = 'wrong') wrong, count(*) FILTER (WHERE o = 'unassigned') unassigned, count(*) FILTER (WHERE o = 'unmappable') unmappable, count(*) FILTER (WHERE "label" = 'NO_CONTROL') no_control,
 count(*) FILTER (WHERE "label" = 'NO_CONTROL' AND o = 'false') false_no_control, count(*) FILTER (WHERE "label" = 'NO_BALL') no_ball, count(*) FILTER (WHERE "label" = 'NO_BALL' AND o = 'false') false_no_ball"""


def _switch_sql(rounds: int = 5) -> str:
    """2-means with its rounds written out, then the stretches of the smaller group."""
    r = range(1, DIMS + 1)
    gone = lambda a, b: "sqrt(" + " + ".join(f"pow({a}[{i}] - {b}[{i}], 2)" for i in r) + ")"
    parts = ["ob AS (SELECT vec_id // 20 t, vec_id % 20 f, [CAST(e AS DOUBLE) FOR e IN embedding[1:6]] d FROM embeddings)"]
    parts.append("m AS (SELECT t, [" + ", ".join(f"avg(d[{i}])" for i in r) + "] m FROM ob GROUP BY 1)")
    parts.append(f"a AS (SELECT t, d a FROM ob JOIN m USING (t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY {gone('d', 'm')} DESC, f) = 1)")
    parts.append(f"c0 AS (SELECT t, a, d b FROM ob JOIN a USING (t) QUALIFY row_number() OVER (PARTITION BY t ORDER BY {gone('d', 'a')} DESC, f) = 1)")
    side = f"CASE WHEN {gone('d', 'b')} < {gone('d', 'a')} THEN 1 ELSE 0 END"
    for k in range(rounds):
        new = lambda c, s: "[" + ", ".join(f"coalesce(avg(d[{i}]) FILTER (WHERE s = {s}), max({c}[{i}]))" for i in r) + f"] {c}"
        parts.append(f"c{k + 1} AS (SELECT t, {new('a', 0)}, {new('b', 1)} FROM (SELECT *, {side} s FROM ob JOIN c{k} USING (t)) GROUP BY 1)")
    parts.append(f"l AS (SELECT *, CASE WHEN s = 0 THEN {gone('d', 'a')} ELSE {gone('d', 'b')} END off, {gone('a', 'b')} far FROM (SELECT *, {side} s FROM ob JOIN c{rounds} USING (t)))")
    parts.append("st AS (SELECT t, count(*) n, count(*) FILTER (WHERE s = 0) n0, count(*) FILTER (WHERE s = 1) n1, coalesce(stddev_pop(off) FILTER (WHERE s = 0), 0) s0, coalesce(stddev_pop(off) FILTER (WHERE s = 1), 0) s1, min(far) far FROM l GROUP BY 1)")
    parts.append("sp AS (SELECT *, far / greatest(CASE WHEN n0 > 1 AND n1 > 1 THEN (s0 + s1) / 2 ELSE greatest(s0, s1) END, 1e-6) q, CASE WHEN n0 < n1 THEN 0 ELSE 1 END few FROM st)")
    parts.append("w AS (SELECT t, f, sum(CASE WHEN f - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY f) run FROM (SELECT l.t, f, lag(f) OVER (PARTITION BY l.t ORDER BY f) p FROM l JOIN sp ON sp.t = l.t AND sp.few = l.s))")
    parts.append("g AS (SELECT t, max(k) longest FROM (SELECT t, max(f) - min(f) + 1 k FROM w GROUP BY t, run) GROUP BY 1)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT sp.t track_id, n, round(least(n0, n1) / CAST(n AS DOUBLE), 6) minority, round(q, 6) separation, coalesce(longest, 0) longest,"
        " CASE WHEN n < 4 THEN 'too_short' WHEN least(n0, n1) / CAST(n AS DOUBLE) < CAST(0.15 AS DOUBLE) OR q < 1.5 THEN 'unimodal' WHEN coalesce(longest, 0) / CAST(greatest(least(n0, n1), 1) AS DOUBLE) >= 0.5 THEN 'sustained' ELSE 'intermittent' END kind"
        " FROM sp LEFT JOIN g USING (t)"
    )


ORACLE_SQL = {
    "possession_scores": with_adapters(f"""WITH {_ANSWERS} SELECT "window", ball_state, CASE grouping("window", ball_state) WHEN 1 THEN 'window' WHEN 2 THEN 'state' ELSE 'all' END AS "by", {_COUNTS} FROM ou GROUP BY GROUPING SETS (("window"), (ball_state), ())""", "track_points", "ball_candidates", "frames"),
    "possession_errors": with_adapters(f"""WITH {_ANSWERS} SELECT error, count(*) n FROM (SELECT CASE o WHEN 'unmappable' THEN 'UNMAPPABLE' WHEN 'unassigned' THEN 'UNASSIGNED_PLAYER' WHEN 'wrong' THEN CASE WHEN ball_present THEN 'WRONG_PLAYER' ELSE 'BALL_MISSING' END WHEN 'false' THEN 'SHOULD_BE_UNKNOWN' END error FROM ou) WHERE error IS NOT NULL GROUP BY 1""", "track_points", "ball_candidates", "frames"),
    "possession_changes": with_adapters(f"""WITH {_ANSWERS} SELECT seq, frame, ob4 outcome_before, o outcome FROM ou WHERE "label" = 'PLAYER' AND o <> ob4""", "track_points", "ball_candidates", "frames"),
    "kit_switches": _switch_sql(),
    "exported_boxes": with_adapters(f"""WITH {_EFF}, d AS (SELECT *, 'box' || CAST(det_id AS VARCHAR) box_id, CAST(seq % 3 AS INT) split, CAST(seq AS VARCHAR) || '-' || CAST(frame AS VARCHAR) image FROM detections),
p AS (SELECT d.*, e."value" v, CASE WHEN frame % 23 = 0 THEN 'excluded' WHEN "action" = 'remove' OR (det_id % 29 = 0 AND det_id % 3 = 0) THEN 'removed' WHEN det_id % 29 = 0 THEN 'ball_fix' WHEN det_id % 19 = 0 THEN 'repaired' WHEN "action" = 'keep' AND e."value" <> cls THEN 'changed' ELSE 'kept' END outcome, det_id % 3 = 2 drawn FROM d LEFT JOIN e USING (box_id))
SELECT split, CASE WHEN outcome NOT IN ('excluded', 'removed') THEN det_id END id, image, CASE outcome WHEN 'ball_fix' THEN 'ball' WHEN 'repaired' THEN 'player' WHEN 'changed' THEN v ELSE cls END cls, x1 + CASE WHEN outcome = 'repaired' THEN 1 WHEN outcome = 'ball_fix' AND drawn THEN 2 ELSE 0 END x1, y1,
 x2 - CASE WHEN outcome = 'ball_fix' AND drawn THEN 2 ELSE 0 END x2, y2 + CASE WHEN outcome = 'repaired' THEN 1 ELSE 0 END y2, outcome, box_id FROM p
UNION ALL SELECT split, m.top + row_number() OVER (PARTITION BY split ORDER BY image, 'new' || CAST(det_id AS VARCHAR)), image, 'referee', x1 + 9, y1, x2 + 9, y2, 'added', 'new' || CAST(det_id AS VARCHAR) FROM d JOIN (SELECT split, max(det_id) top FROM d GROUP BY 1) m USING (split) WHERE det_id % 53 = 0 AND frame % 23 <> 0""", "decisions", "detections"),
}
