"""Queries over time, events, duplicates, quality and decision logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, dupes, evaluate, events, quality, temporal
from . import adapters as ad
from .adapters import with_adapters


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


# ---- balls over time


def selected_ball(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.select_ball(ad.ball_candidates(spark, sf), ad.frames(spark, sf))


def interpolated_ball(spark: SparkSession, sf: str) -> DataFrame:
    f = ad.frames(spark, sf)
    return _rounded(temporal.interpolate_ball(selected_ball(spark, sf), f), "x1", "y1", "x2", "y2")


def _observed(spark, sf):
    best = ad.ball_candidates(spark, sf).where("conf >= 0.25").groupBy("seq", "frame").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "conf"), F.struct("conf", -F.col("x1"), "cand_id")).alias("b"))
    rows = ad.frames(spark, sf).join(best, ["seq", "frame"], "left")
    return rows.select("seq", "frame", F.when(F.col("b").isNull(), "unknown").otherwise("observed").alias("state"), "b.x1", "b.y1", "b.x2", "b.y2", "b.conf")


def short_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(temporal.interpolate_ball(_observed(spark, sf), ad.frames(spark, sf), 0.8), "x1", "y1", "x2", "y2")


def held_ball(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.hold_last(_observed(spark, sf), 6)


def identity_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.identity_gaps(ad.track_points(spark, sf))


def reappearances(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(temporal.reappearances(ad.track_points(spark, sf)), "moved")


def keyframe_boxes(spark: SparkSession, sf: str) -> DataFrame:
    shapes = ad.track_points(spark, sf).withColumn("outside", F.col("frame") % 11 == 0).withColumn("occluded", F.col("frame") % 4 == 0)
    return _rounded(temporal.expand_keyframes(shapes), "x1", "y1", "x2", "y2")


def continuity(spark: SparkSession, sf: str) -> DataFrame:
    breaks = ad.frames(spark, sf).select("seq", "frame", ((F.col("frame") + F.col("seq")) % 29 == 0).alias("broken"))
    return temporal.continuity_runs(breaks, 8, 15)


# ---- events


def _metres(df, *more):
    return df.select("seq", "frame", (F.col("frame") / 5).alias("ts"), ((F.col("x1") + F.col("x2")) / 24).alias("x"), ((F.col("y1") + F.col("y2")) / 24).alias("y"), *more)


def _ball_m(spark, sf):
    return _metres(_observed(spark, sf).where("x1 is not null"))


def _players_m(spark, sf):
    return _metres(ad.track_points(spark, sf), "track_id", "team")


def shot_events(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(events.shots(_ball_m(spark, sf), _players_m(spark, sf), 5.0, 20.0), "mean_speed")


def sprint_events(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(events.sprints(_players_m(spark, sf), 2.0), "mean_speed")


def goal_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.goals(_ball_m(spark, sf), _players_m(spark, sf), (F.col("x") < 8, F.col("x") > 42), near=20.0)


def pass_events(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(events.passes(_ball_m(spark, sf), _players_m(spark, sf), 20.0, 2.0), "length")


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    every = shot_events(spark, sf).select("seq", "type").union(goal_events(spark, sf).select("seq", "type")).union(pass_events(spark, sf).select("seq", "type"))
    return events.event_summary(every)


# ---- duplicates and samples


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.table(spark, sf, "documents").select(F.md5("text").alias("sha"), F.col("source").alias("grp"))
    return dupes.exact_groups(docs)


def augmentation_copies(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.augmentation_copies(ad.images(spark, sf)).select("image_id", "copies", "keep")


def hash_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.joins import hamming_pairs

    return hamming_pairs(ad.images(spark, sf), 14)


def near_duplicate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(dupes.near_duplicates(ad.images(spark, sf), 14, 0.2), "ncc", "moved")


def group_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(dupes.group_similarity(ad.images(spark, sf), "stem"), "median", "p90")


def source_completeness(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf).select(F.concat_ws("-", "seq", "frame").alias("image"), "cls", "seq", "frame", "det_id")
    images = d.select("image", F.col("seq").alias("source")).distinct()
    boxes = d.where("frame % 17 <> 0 and not (seq < 3 and cls <> 'ball') and not (seq between 4 and 6 and cls = 'ball')").select("image", "cls")
    return _rounded(dupes.completeness(images, boxes), "empty")


def candidate_status(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.md5("text").alias("sha"), "n_chars", "lang")
    copies = docs.join(docs.groupBy("sha").agg(F.min("image").alias("first")), "sha").where("image > first")
    reasons = {"EXACT_COPY": copies, "TOO_SHORT": docs.where("n_chars < 200"), "LANGUAGE": docs.where("lang <> 'en'")}
    return dupes.candidate_index(docs.select("image"), reasons).select("image", F.array_join("reasons", "+").alias("reasons"), "status")


def split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.table(spark, sf, "documents").select(F.md5("text").alias("image"), F.col("source").alias("match"), (F.col("doc_id") % 5 == 0).cast("int").alias("split"))
    return dupes.split_leaks(docs)


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.srswor(ad.table(spark, sf, "documents").select("doc_id", "lang"), 50, 7, "doc_id")


def population_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    f = dupes.fingerprint(ad.table(spark, sf, "documents"), "doc_id", "lang", "source")
    return f.select("rows", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.stratified_round_robin(ad.table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 60, 3, "doc_id").select("doc_id", "lang", "source", "turn")


def selected_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.select_tracks(ad.track_points(spark, sf), 15, 10)


# ---- evaluation of labels


def _judged(spark, sf):
    lab = ad.table(spark, sf, "labels").join(ad.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return lab.select(F.col("lang").alias("part"), F.when(F.col("doc_id") % 11 > 0, F.col("quality")).alias("actual"), F.when(F.col("doc_id") % 7 > 0, 1 - F.col("toxic")).alias("predicted"), (F.col("doc_id") % 9 + 1).alias("weight"))


def binary_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.binary_scores(_judged(spark, sf)), "recall", "specificity", "precision", "f1", "balanced", "fp_rate")


def permutation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.permutation_accuracy(_judged(spark, sf).where("actual is not null")), "accuracy", "coverage", "selective", "weighted")


def proportion_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.table(spark, sf, "labels").join(ad.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    i = evaluate.wilson(F.col("k"), F.col("n"))
    return rows.select("source", "k", "n", F.round(i["low"], 6).alias("low"), F.round(i["high"], 6).alias("high"))


def width_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.describe(ad.detections(spark, sf).withColumn("w", F.col("x2") - F.col("x1") - 18), "w", "cls"), "mean", "p10", "p25", "median", "p75", "p90")


def attribute_stability(spark: SparkSession, sf: str) -> DataFrame:
    p = ad.track_points(spark, sf).withColumn("role", F.when(F.col("frame") % 50 == 0, "b").otherwise("a"))
    return evaluate.attribute_stability(p, "team", "role")


def metric_gate(spark: SparkSession, sf: str) -> DataFrame:
    base = ad.table(spark, sf, "documents").groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("base")).withColumn("at_least", F.lit(0.0))
    value = ad.table(spark, sf, "documents").where("lang = 'en'").groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    return _rounded(evaluate.gate(value, base), "value", "base", "delta")


# ---- decisions and checks


def effective_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.effective_state(ad.decisions(spark, sf))


def decisions_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.latest_by_mode(ad.decisions(spark, sf))


def decision_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.conflicts(ad.decisions(spark, sf))


def missing_targets(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.missing_targets(ad.decisions(spark, sf))


def click_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.classify_clicks(ad.decisions(spark, sf))


def _ledger(spark, sf):
    return ad.detections(spark, sf).select(F.concat(F.lit("box"), F.col("det_id").cast("string")).alias("box_id"), "cls", F.concat(F.lit("run"), (F.col("seq") % 4).cast("string")).alias("run"), F.concat_ws("-", "seq", "frame").alias("image"), (F.col("det_id") % 13).alias("priority"), "det_id")


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.review_queue(_ledger(spark, sf), decisions.effective_state(ad.decisions(spark, sf)))


def export_plan(spark: SparkSession, sf: str) -> DataFrame:
    led = _ledger(spark, sf)
    return decisions.export_plan(led, decisions.effective_state(ad.decisions(spark, sf)), led.where("det_id % 19 = 0"))


def review_gate(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.gate_conditions(_ledger(spark, sf), decisions.effective_state(ad.decisions(spark, sf)))


def label_line_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    cls = F.when(F.col("det_id") % 23 == 0, 9).otherwise(F.col("det_id") % 4).cast("string")
    w = F.when(F.col("det_id") % 29 == 0, F.lit("-0.5")).when(F.col("det_id") % 31 == 0, F.lit("x")).otherwise(F.lit("0.25"))
    line = F.concat_ws(" ", cls, ((F.col("det_id") % 8) / 8).cast("string"), F.lit("0.5"), w, F.lit("0.5"), F.when(F.col("det_id") % 37 == 0, F.lit("7")))
    return quality.label_errors(d.select(F.concat_ws("-", "seq", "frame").alias("image"), F.col("det_id").alias("line_no"), line.alias("line")))


def identity_violations(spark: SparkSession, sf: str) -> DataFrame:
    p = ad.track_points(spark, sf).withColumn("track_id", F.when(F.col("track_id") % 50 == 3, 0).otherwise(F.col("track_id"))).withColumn("cls", F.when(F.col("frame") % 40 == 7, "coach").otherwise("player"))
    return quality.identity_violations(p, 110, 600.0, 355.0)


def frozen_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = ad.ball_candidates(spark, sf)
    return quality.frozen_set_check(p, ad.frames(spark, sf).where("frame % 5 <> 2"), ["seq", "frame"])


def accepted_subset(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.detections(spark, sf)
    return quality.subset_equal(d.where("conf >= 0.25"), d.where("conf >= 0.25 and det_id % 41 <> 0").union(d.where("det_id % 97 = 0 and conf < 0.25")), ["seq", "frame", "det_id", "conf"])


def manifest_problems(spark: SparkSession, sf: str) -> DataFrame:
    docs = ad.table(spark, sf, "documents")
    manifest = docs.where("doc_id % 3 <> 1 or source < 'src5'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("source <> 'src3'")
    return quality.manifest_check(manifest, docs.where("source <> 'src7'").select("source", F.md5("text").alias("name")))


QUERIES = {
    f.__name__: f
    for f in (
        selected_ball, interpolated_ball, short_gaps, held_ball, identity_gaps, reappearances, keyframe_boxes, continuity, shot_events, sprint_events, goal_events, pass_events, event_counts,
        exact_duplicates, augmentation_copies, hash_neighbours, near_duplicate_verdicts, group_similarity, source_completeness, candidate_status, split_leaks, seeded_sample, population_fingerprint,
        stratified_sample, selected_tracks, binary_scores, permutation_accuracy, proportion_intervals, width_distribution, attribute_stability, metric_gate, effective_decisions, decisions_by_mode,
        decision_conflicts, missing_targets, click_kinds, review_queue, export_plan, review_gate, label_line_errors, identity_violations, frozen_keys, accepted_subset, manifest_problems,
    )
}

_OBS = "b AS (SELECT * FROM ball_candidates WHERE conf >= 0.25 QUALIFY row_number() OVER (PARTITION BY seq, frame ORDER BY conf DESC, x1, cand_id DESC) = 1), o AS (SELECT f.seq, f.frame, f.ts, f.dt, f.cut, b.x1, b.y1, b.x2, b.y2, b.conf FROM frames f LEFT JOIN b USING (seq, frame))"
_M = "bm AS (SELECT seq, frame, CAST(frame AS DOUBLE)/5 ts, (x1+x2)/24 x, (y1+y2)/24 y FROM o WHERE x1 IS NOT NULL), pm AS (SELECT seq, frame, CAST(frame AS DOUBLE)/5 ts, (x1+x2)/24 x, (y1+y2)/24 y, track_id, team, lead(frame) OVER (PARTITION BY seq, track_id ORDER BY frame) nxt FROM track_points)"
_NEAR = """nl AS (SELECT b.*, p.track_id, p.team, sqrt(pow(b.x-p.x, 2)+pow(b.y-p.y, 2)) distance FROM {src} b LEFT JOIN pm p ON p.seq = b.seq AND b.frame >= p.frame AND (p.nxt IS NULL OR b.frame < p.nxt)
 QUALIFY row_number() OVER (PARTITION BY b.seq, b.frame ORDER BY sqrt(pow(b.x-p.x, 2)+pow(b.y-p.y, 2)), p.track_id) = 1)"""
_SP = """{name} AS (SELECT *, CASE WHEN count(*) OVER l = {n} AND ts - first(ts) OVER l > 0 THEN sum(step) OVER i / (ts - first(ts) OVER l) END mean_speed, first(x) OVER l x0, first(y) OVER l y0
 FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) step FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY frame)) WINDOW l AS (PARTITION BY {k} ORDER BY frame ROWS {m} PRECEDING), i AS (PARTITION BY {k} ORDER BY frame ROWS {j} PRECEDING))"""
_SHOT = f"{_SP.format(name='sp', n=5, m=4, j=3, k='seq', src='bm')}, sh AS (SELECT * FROM sp WHERE mean_speed > 5 AND abs(x-x0) > abs(y-y0)), {_NEAR.format(src='sh')}"
_GOAL = f"g0 AS (SELECT *, CASE WHEN x < 8 THEN 'left' WHEN x > 42 THEN 'right' END side, row_number() OVER (PARTITION BY seq ORDER BY frame) n FROM bm), g1 AS (SELECT * FROM (SELECT *, lag(side) OVER (PARTITION BY seq ORDER BY frame) was FROM g0) WHERE side IS NOT NULL AND was IS NULL AND n >= 10), {_NEAR.format(src='g1')}"
_PASS = f"bn AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame) n FROM bm), {_NEAR.format(src='bn')}, h AS (SELECT *, lag(track_id) OVER w ft, lag(team) OVER w fteam, lag(x) OVER w fx, lag(y) OVER w fy FROM nl WHERE distance < 20 WINDOW w AS (PARTITION BY seq ORDER BY frame)), ps AS (SELECT seq, frame, CASE WHEN fteam = team THEN 'pass' ELSE 'interception' END AS \"type\", ft from_id, track_id to_id, fteam team, sqrt(pow(x-fx, 2)+pow(y-fy, 2)) length FROM h WHERE ft IS NOT NULL AND ft <> track_id AND n >= 20 AND sqrt(pow(x-fx, 2)+pow(y-fy, 2)) > 2)"
_LAST = "row_number() OVER (PARTITION BY {} ORDER BY recorded_utc DESC NULLS LAST, line_no DESC) = 1"
_EFF = f"e AS (SELECT box_id, \"value\", mode, line_no, CASE WHEN \"value\" IN ('player', 'goalkeeper', 'referee') THEN 'keep' WHEN \"value\" IN ('FALSE_POSITIVE', 'NON_TARGET_HUMAN') THEN 'remove' ELSE 'review' END \"action\" FROM decisions QUALIFY {_LAST.format('box_id')})"
_LEDGER = "led AS (SELECT 'box' || CAST(det_id AS VARCHAR) box_id, cls, 'run' || CAST(seq % 4 AS VARCHAR) run, CAST(seq AS VARCHAR) || '-' || CAST(frame AS VARCHAR) image, det_id % 13 priority, det_id FROM detections)"
_JUDGED = "j AS (SELECT lang part, CASE WHEN doc_id % 11 > 0 THEN quality END actual, CASE WHEN doc_id % 7 > 0 THEN 1 - toxic END predicted, doc_id % 9 + 1 weight FROM labels JOIN documents USING (doc_id))"


def _interpolated(source: str, gap: float) -> str:
    a = "{'t': ts, 'd': dt, 'c': cuts, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
    cols = ", ".join(f"round(CASE WHEN ok THEN l.{c} + (r.{c} - l.{c}) * ((ts - l.t) / (r.t - l.t)) ELSE {c} END, 6) {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"""ic AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY seq ORDER BY frame) cuts FROM {source}),
ia AS (SELECT *, last_value(CASE WHEN x1 IS NOT NULL THEN {a} END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) l,
 first_value(CASE WHEN x1 IS NOT NULL THEN {a} END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) r FROM ic),
ib AS (SELECT *, coalesce(x1 IS NULL AND l.c = r.c AND r.t - l.t - r.d > 1e-9 AND r.t - l.t - r.d <= {gap} + 1e-9, false) ok FROM ia)
SELECT seq, frame, CASE WHEN ok THEN 'interpolated_short_gap' ELSE state END state, {cols}, conf FROM ib"""


ORACLE_SQL = {
    "short_gaps": with_adapters(f"WITH {_OBS}, os AS (SELECT *, CASE WHEN x1 IS NULL THEN 'unknown' ELSE 'observed' END state FROM o), {_interpolated('os', 0.8)}", "ball_candidates", "frames"),
    "held_ball": with_adapters(f"""WITH {_OBS}, h AS (SELECT seq, frame, last_value(CASE WHEN x1 IS NOT NULL THEN {{'f': frame, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) l FROM o)
SELECT seq, frame, CASE WHEN frame - l.f <= 6 THEN l.x1 END x1, CASE WHEN frame - l.f <= 6 THEN l.y1 END y1, CASE WHEN frame - l.f <= 6 THEN l.x2 END x2, CASE WHEN frame - l.f <= 6 THEN l.y2 END y2, CASE WHEN frame - l.f <= 6 THEN frame - l.f END held_for FROM h""", "ball_candidates", "frames"),
    "identity_gaps": with_adapters("SELECT seq, track_id, b + 1 gap_from, frame - 1 gap_to FROM (SELECT seq, track_id, frame, lag(frame) OVER (PARTITION BY seq, track_id ORDER BY frame) b FROM track_points) WHERE frame - b > 1", "track_points"),
    "reappearances": with_adapters("""SELECT seq, track_id, frame, round(moved, 6) moved FROM (SELECT *, sqrt(pow((x1+x2)/2-(a1+a2)/2, 2)+pow((y1+y2)/2-(b1+b2)/2, 2)) moved FROM (SELECT *, lag(frame) OVER w f, lag(x1) OVER w a1, lag(x2) OVER w a2, lag(y1) OVER w b1, lag(y2) OVER w b2 FROM track_points WINDOW w AS (PARTITION BY seq, track_id ORDER BY frame)))
 WHERE frame - f > 1 AND moved > 3*(a2-a1)""", "track_points"),
    "keyframe_boxes": with_adapters("""SELECT seq, track_id, CAST(f AS INT) frame, round(x1 + coalesce((n1-x1)*((f-frame)/CAST(nf-frame AS DOUBLE)), 0), 6) x1, round(y1 + coalesce((m1-y1)*((f-frame)/CAST(nf-frame AS DOUBLE)), 0), 6) y1, round(x2 + coalesce((n2-x2)*((f-frame)/CAST(nf-frame AS DOUBLE)), 0), 6) x2, round(y2 + coalesce((m2-y2)*((f-frame)/CAST(nf-frame AS DOUBLE)), 0), 6) y2, frame % 4 = 0 occluded
FROM (SELECT *, unnest(range(frame, coalesce(nf, frame + 1))) f FROM (SELECT *, lead(frame) OVER w nf, lead(x1) OVER w n1, lead(x2) OVER w n2, lead(y1) OVER w m1, lead(y2) OVER w m2 FROM track_points WINDOW w AS (PARTITION BY seq, track_id ORDER BY frame)) WHERE frame % 11 <> 0)""", "track_points"),
    "continuity": with_adapters("""SELECT seq, min(frame) AS "first", max(frame) AS "last", count(*) length, count(*) >= 15 long_enough FROM (SELECT *, frame - row_number() OVER (PARTITION BY seq ORDER BY frame) run FROM (SELECT seq, frame, max(CASE WHEN (frame+seq) % 29 = 0 THEN frame + 9 END) OVER (PARTITION BY seq ORDER BY frame) s FROM frames) WHERE s IS NULL OR frame >= s) GROUP BY seq, run""", "frames"),
    "shot_events": with_adapters(f"WITH {_OBS}, {_M}, {_SHOT} SELECT seq, frame, 'shot' AS \"type\", round(mean_speed, 6) mean_speed, CASE WHEN distance < 20 THEN track_id END track_id, CASE WHEN distance < 20 THEN team END team FROM nl", "ball_candidates", "frames", "track_points"),
    "sprint_events": with_adapters(f"WITH {_OBS}, {_M}, {_SP.format(name='sp', n=10, m=9, j=8, k='seq, track_id', src='pm')} SELECT seq, frame, track_id, team, 'sprint' AS \"type\", round(mean_speed, 6) mean_speed FROM sp WHERE mean_speed > 2", "ball_candidates", "frames", "track_points"),
    "goal_events": with_adapters(f"WITH {_OBS}, {_M}, {_GOAL} SELECT seq, frame, 'goal' AS \"type\", side, CASE WHEN distance < 20 THEN track_id END track_id, CASE WHEN distance < 20 THEN team END team FROM nl", "ball_candidates", "frames", "track_points"),
    "pass_events": with_adapters(f"WITH {_OBS}, {_M}, {_PASS} SELECT seq, frame, \"type\", from_id, to_id, team, round(length, 6) length FROM ps", "ball_candidates", "frames", "track_points"),
    "event_counts": with_adapters(f"""WITH {_OBS}, {_M}, {_SHOT.replace("nl AS", "nsh AS")}, {_GOAL.replace("nl AS", "ngo AS")}, {_PASS} SELECT seq, "type", count(*) n FROM (SELECT seq, 'shot' AS "type" FROM nsh UNION ALL SELECT seq, 'goal' FROM ngo UNION ALL SELECT seq, "type" FROM ps) GROUP BY 1, 2""", "ball_candidates", "frames", "track_points"),
    "exact_duplicates": "SELECT md5(text) sha, count(*) copies, count(DISTINCT source) collections, count(DISTINCT source) > 1 crosses FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "augmentation_copies": with_adapters("SELECT image_id, count(*) OVER (PARTITION BY stem) copies, row_number() OVER (PARTITION BY stem ORDER BY image_id) = 1 AS \"keep\" FROM images", "images"),
    "hash_neighbours": with_adapters("""WITH c AS (SELECT image_id, min(image_id) OVER (PARTITION BY dhash) rep, dhash FROM images), r AS (SELECT rep, dhash FROM c WHERE image_id = rep)
SELECT a.rep a, b.rep b, bit_count(xor(a.dhash, b.dhash)) distance FROM r a JOIN r b ON a.rep < b.rep WHERE bit_count(xor(a.dhash, b.dhash)) <= 14 UNION ALL SELECT rep, image_id, 0 FROM c WHERE image_id <> rep""", "images"),
    "near_duplicate_verdicts": with_adapters("""WITH c AS (SELECT image_id, min(image_id) OVER (PARTITION BY dhash, sig) rep, dhash, sig, [CAST(x AS DOUBLE) - list_avg(sig) FOR x IN sig] u FROM images), r AS (SELECT * FROM c WHERE image_id = rep),
p AS (SELECT a.rep a, b.rep b, bit_count(xor(a.dhash, b.dhash)) distance, list_cosine_similarity(a.u, b.u) ncc, len([1 FOR z IN list_zip(a.sig, b.sig) IF abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) > 0.2]) / CAST(64 AS DOUBLE) moved FROM r a JOIN r b ON a.rep < b.rep WHERE bit_count(xor(a.dhash, b.dhash)) <= 14)
SELECT a, b, distance, round(ncc, 6) ncc, round(moved, 6) moved, CASE WHEN ncc >= 0.985 AND moved <= 0.02 THEN 'NEAR_IDENTICAL' WHEN ncc >= 0.95 AND moved <= 0.10 THEN 'SAME_SCENE' ELSE 'DISTINCT' END verdict FROM p UNION ALL SELECT rep, image_id, 0, 1.0, 0.0, 'EXACT' FROM c WHERE image_id <> rep""", "images"),
    "group_similarity": with_adapters("""WITH c AS (SELECT image_id, stem, [CAST(x AS DOUBLE) - list_avg(sig) FOR x IN sig] u FROM images), p AS (SELECT stem, list_cosine_similarity(a.u, b.u) ncc FROM c a JOIN c b USING (stem) WHERE a.image_id < b.image_id)
SELECT stem, count(*) pairs, round(quantile_cont(ncc, 0.5), 6) median, round(quantile_cont(ncc, 0.9), 6) p90, count(*) FILTER (WHERE ncc >= 0.985) alike FROM p GROUP BY 1""", "images"),
    "population_fingerprint": """WITH h AS (SELECT md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(lang, ''), coalesce(source, ''))) h FROM documents)
SELECT count(*) AS "rows", CAST(sum(CAST('0x' || h[1:12] AS BIGINT)) AS DOUBLE) low, CAST(sum(CAST('0x' || h[13:24] AS BIGINT)) AS DOUBLE) high FROM h""",
    "label_line_errors": with_adapters("""WITH l AS (SELECT CAST(seq AS VARCHAR) || '-' || CAST(frame AS VARCHAR) image, det_id line_no, CASE WHEN det_id % 23 = 0 THEN 9 ELSE det_id % 4 END c, (det_id % 8) / CAST(8 AS DOUBLE) cx, CASE WHEN det_id % 29 = 0 THEN CAST(-0.5 AS DOUBLE) WHEN det_id % 31 = 0 THEN NULL ELSE CAST(0.25 AS DOUBLE) END w, det_id % 37 <> 0 five FROM detections),
n AS (SELECT *, five AND w IS NOT NULL ok, row_number() OVER (PARTITION BY image, c, cx, w, five ORDER BY line_no) rn FROM l),
f AS (SELECT * FROM n WHERE ok AND rn = 1 AND w > 0),
v AS (SELECT image, line_no, 'fields' rule FROM n WHERE NOT five UNION ALL SELECT image, line_no, 'number' FROM n WHERE five AND NOT ok UNION ALL SELECT image, line_no, 'class' FROM n WHERE ok AND c > 3 UNION ALL SELECT image, line_no, 'size' FROM n WHERE ok AND w <= 0
UNION ALL SELECT image, line_no, 'edge' FROM n WHERE ok AND w > 0 AND (cx - w / 2 < -1e-6 OR cx + w / 2 > 1 + 1e-6) UNION ALL SELECT image, line_no, 'repeat' FROM n WHERE rn > 1
UNION ALL SELECT DISTINCT b.image, b.line_no, 'near_repeat' FROM f a JOIN f b ON a.image = b.image AND a.c = b.c AND a.line_no < b.line_no WHERE greatest(0, least(a.cx, b.cx) - greatest(a.cx, b.cx) + 0.25) / (0.5 - greatest(0, least(a.cx, b.cx) - greatest(a.cx, b.cx) + 0.25)) >= 0.9)
SELECT * FROM v""", "detections"),
    "source_completeness": with_adapters("""WITH d AS (SELECT CAST(seq AS VARCHAR) || '-' || CAST(frame AS VARCHAR) image, * FROM detections), i AS (SELECT DISTINCT image, seq FROM d), b AS (SELECT * FROM d WHERE frame % 17 <> 0 AND NOT (seq < 3 AND cls <> 'ball') AND NOT (seq BETWEEN 4 AND 6 AND cls = 'ball')),
p AS (SELECT image, max(CAST(cls = 'ball' AS INT)) ball, max(CAST(cls <> 'ball' AS INT)) human FROM b GROUP BY 1),
s AS (SELECT i.seq source, count(*) images, avg(CAST(p.image IS NULL AS INT)) empty, coalesce(max(ball), 0) ball, coalesce(max(human), 0) human FROM i LEFT JOIN p USING (image) GROUP BY 1)
SELECT source, images, round(empty, 6) empty, CASE WHEN ball = 1 AND human = 0 THEN 'BALL_ONLY' WHEN empty > 0.05 THEN 'PARTIAL' WHEN ball = 0 THEN 'PLAYER_ONLY' ELSE 'FULL' END verdict FROM s""", "detections"),
    "candidate_status": """WITH d AS (SELECT doc_id image, n_chars < 200 s, lang <> 'en' l, doc_id > min(doc_id) OVER (PARTITION BY md5(text)) c FROM documents)
SELECT image, concat_ws('+', CASE WHEN c THEN 'EXACT_COPY' END, CASE WHEN s THEN 'TOO_SHORT' END, CASE WHEN l THEN 'LANGUAGE' END) reasons, CASE WHEN c THEN 'EXACT_COPY' WHEN s THEN 'TOO_SHORT' WHEN l THEN 'LANGUAGE' ELSE 'ELIGIBLE' END status FROM d""",
    "split_leaks": """WITH d AS (SELECT md5(text) image, source m, CAST(doc_id % 5 = 0 AS INT) split FROM documents)
SELECT 'image_in_two_splits' kind, image AS "name", count(DISTINCT split) splits FROM d GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'match_in_two_splits', m, count(DISTINCT split) FROM d GROUP BY 2 HAVING count(DISTINCT split) > 1""",
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 50",
    "stratified_sample": """WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':3'), doc_id) turn FROM documents) SELECT * FROM t ORDER BY turn, md5(lang || ':' || source || ':3'), lang, source LIMIT 60""",
    "selected_tracks": with_adapters("SELECT seq, track_id, points, rk FROM (SELECT seq, track_id, count(*) points, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, track_id) rk FROM track_points GROUP BY 1, 2 HAVING count(*) >= 15) WHERE rk <= 10", "track_points"),
    "binary_scores": f"""WITH {_JUDGED}, c AS (SELECT part, count(*) FILTER (WHERE actual = 1 AND predicted = 1) tp, count(*) FILTER (WHERE actual = 0 AND predicted = 1) fp, count(*) FILTER (WHERE actual = 1 AND predicted = 0) fn, count(*) FILTER (WHERE actual = 0 AND predicted = 0) tn FROM j WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY ROLLUP (part)),
r AS (SELECT *, CASE WHEN tp+fn > 0 THEN tp/CAST(tp+fn AS DOUBLE) END r, CASE WHEN tn+fp > 0 THEN tn/CAST(tn+fp AS DOUBLE) END s FROM c)
SELECT part, tp, fp, fn, tn, round(r, 6) recall, round(s, 6) specificity, round(CASE WHEN tp+fp > 0 THEN tp/CAST(tp+fp AS DOUBLE) END, 6) AS "precision", round(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/CAST(2*tp+fp+fn AS DOUBLE) END, 6) f1, round((r+s)/2, 6) balanced, round(CASE WHEN fp+tn > 0 THEN fp/CAST(fp+tn AS DOUBLE) END, 6) fp_rate FROM r""",
    "permutation_accuracy": f"""WITH {_JUDGED}, n AS (SELECT *, CAST(CASE WHEN swap = 1 THEN 1 - predicted ELSE predicted END = actual AS INT) ok FROM j, (SELECT unnest([0, 1]) swap) WHERE actual IS NOT NULL),
s AS (SELECT part, swap, count(*) n, count(predicted) k, coalesce(sum(ok), 0) r, sum(weight) w, sum(weight * coalesce(ok, 0)) wr FROM n GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY part ORDER BY coalesce(sum(ok), 0) DESC, swap) = 1)
SELECT part, swap, n, round(r/CAST(n AS DOUBLE), 6) accuracy, round(k/CAST(n AS DOUBLE), 6) coverage, round(CASE WHEN k > 0 THEN r/CAST(k AS DOUBLE) END, 6) selective, round(CASE WHEN w > 0 THEN wr/CAST(w AS DOUBLE) END, 6) weighted FROM s""",
    "proportion_intervals": """WITH c AS (SELECT source, CAST(sum(quality) AS DOUBLE) k, CAST(count(*) AS DOUBLE) n, CAST(1.959963984540054 AS DOUBLE) z FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, CAST(k AS BIGINT) k, CAST(n AS BIGINT) n, round((k/n + z*z/(2*n))/(1+z*z/n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))/(1+z*z/n), 6) low, round((k/n + z*z/(2*n))/(1+z*z/n) + z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))/(1+z*z/n), 6) high FROM c""",
    "width_distribution": with_adapters("""SELECT cls, count(*) n, round(avg(w), 6) mean, round(quantile_cont(w, 0.1), 6) p10, round(quantile_cont(w, 0.25), 6) p25, round(quantile_cont(w, 0.5), 6) median, round(quantile_cont(w, 0.75), 6) p75, round(quantile_cont(w, 0.9), 6) p90, count(*) FILTER (WHERE w <= 5) le5, count(*) FILTER (WHERE w <= 8) le8, count(*) FILTER (WHERE w <= 12) le12 FROM (SELECT cls, x2-x1-18 w FROM detections) GROUP BY 1""", "detections"),
    "attribute_stability": with_adapters("SELECT seq, track_id, max(frame)-min(frame)+1 span, count(*) points, count(DISTINCT team) n_team, count(DISTINCT frame % 50 = 0) n_role FROM track_points GROUP BY 1, 2", "track_points"),
    "metric_gate": """SELECT b.metric, round(v.value_, 6) AS "value", round(b.base, 6) base, round(v.value_ - b.base, 6) delta, coalesce(v.value_ - b.base >= 0, false) passed FROM (SELECT source metric, avg(n_chars) base FROM documents GROUP BY 1) b LEFT JOIN (SELECT source metric, avg(n_chars) value_ FROM documents WHERE lang = 'en' GROUP BY 1) v USING (metric)""",
    "effective_decisions": with_adapters(f"WITH {_EFF} SELECT * FROM e", "decisions"),
    "decisions_by_mode": with_adapters(f"SELECT mode, box_id, \"value\", line_no FROM decisions QUALIFY {_LAST.format('mode, box_id')}", "decisions"),
    "decision_conflicts": with_adapters("SELECT box_id, count(DISTINCT \"value\") AS \"values\", count(*) AS events FROM decisions GROUP BY 1 HAVING count(DISTINCT \"value\") > 1", "decisions"),
    "missing_targets": with_adapters("""WITH d AS (SELECT box_id, mode, "value" IN ('FALSE_POSITIVE', 'NON_TARGET_HUMAN') x, row_number() OVER (ORDER BY recorded_utc NULLS FIRST, line_no) k FROM decisions WHERE mode IN ('missed_role', 'missed_role_manual')),
f AS (SELECT box_id, max(k) FILTER (WHERE x) o, max(k) FILTER (WHERE NOT x) b, bool_or(mode = 'missed_role_manual') m, bool_or(mode = 'missed_role') g FROM d GROUP BY 1)
SELECT box_id, CASE WHEN o IS NOT NULL AND (b IS NULL OR o > b) THEN 'EXCLUDED' WHEN m THEN 'BOXED' WHEN o IS NOT NULL THEN 'RETRACTED' ELSE 'PENDING' END state FROM f WHERE g""", "decisions"),
    "click_kinds": with_adapters("""SELECT line_no, box_id, b AS "before", "value", CASE WHEN b IS NULL THEN 'first' WHEN b = "value" THEN 'confirms' ELSE 'changes' END kind FROM (SELECT *, last_value(CASE WHEN mode <> 'missed_role_manual' THEN "value" END IGNORE NULLS) OVER (PARTITION BY box_id ORDER BY recorded_utc NULLS FIRST, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM decisions) WHERE mode = 'missed_role_manual'""", "decisions"),
    "review_queue": with_adapters(f"WITH {_EFF}, {_LEDGER} SELECT run, image, min(priority) priority, count(*) FILTER (WHERE e.box_id IS NULL) AS \"left\", count(e.box_id) prefilled, row_number() OVER (PARTITION BY run ORDER BY min(priority), image) AS \"position\" FROM led LEFT JOIN e USING (box_id) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE e.box_id IS NULL) > 0", "decisions", "detections"),
    "export_plan": with_adapters(f"""WITH {_EFF}, {_LEDGER} SELECT box_id, p AS plan, CASE WHEN p = 'changed' THEN "value" ELSE cls END cls FROM (SELECT led.box_id, cls, "value", CASE WHEN "action" = 'remove' THEN 'removed' WHEN det_id % 19 = 0 THEN 'repaired' WHEN "action" = 'keep' AND "value" <> cls THEN 'changed' ELSE 'kept' END p FROM led LEFT JOIN e USING (box_id))""", "decisions", "detections"),
    "review_gate": with_adapters(f"""WITH {_EFF}, {_LEDGER}, c AS (SELECT count(*) FILTER (WHERE e.box_id IS NULL) a, count(*) FILTER (WHERE "action" = 'review') b, count(*) FILTER (WHERE e.box_id IS NOT NULL AND "value" IS NULL) d FROM led LEFT JOIN e USING (box_id))
SELECT 'all_reviewed' AS "condition", a failing, a = 0 passed FROM c UNION ALL SELECT 'none_uncertain', b, b = 0 FROM c UNION ALL SELECT 'values_present', d, d = 0 FROM c""", "decisions", "detections"),
    "identity_violations": with_adapters("""WITH p AS (SELECT seq, frame, CASE WHEN track_id % 50 = 3 THEN 0 ELSE track_id END track_id, x1, y1, x2, y2, CASE WHEN frame % 40 = 7 THEN 'coach' ELSE 'player' END cls FROM track_points),
q AS (SELECT *, count(*) OVER (PARTITION BY seq, frame, track_id) a, count(*) OVER (PARTITION BY seq, frame, x1, y1, x2, y2) s, min(cls) OVER (PARTITION BY seq, track_id) <> max(cls) OVER (PARTITION BY seq, track_id) k FROM p)
SELECT seq, frame, track_id, 'id_positive' rule FROM q WHERE track_id <= 0 UNION ALL SELECT seq, frame, track_id, 'frame_range' FROM q WHERE frame NOT BETWEEN 0 AND 109 UNION ALL SELECT seq, frame, track_id, 'bounds' FROM q WHERE x2 > 601 OR y2 > 356
UNION ALL SELECT seq, frame, track_id, 'role' FROM q WHERE cls = 'coach' UNION ALL SELECT seq, frame, track_id, 'repeated_id' FROM q WHERE a > 1 UNION ALL SELECT seq, frame, track_id, 'repeated_box' FROM q WHERE s > 1 UNION ALL SELECT seq, frame, track_id, 'role_changes' FROM q WHERE k""", "track_points"),
    "frozen_keys": with_adapters("""SELECT coalesce(n.seq, e.seq) seq, coalesce(n.frame, e.frame) frame, CASE WHEN n.n IS NULL THEN 'missing' WHEN e.seq IS NULL THEN 'extra' ELSE 'repeated' END problem, coalesce(n.n, 0) n FROM (SELECT seq, frame, count(*) n FROM ball_candidates GROUP BY 1, 2) n
 FULL JOIN (SELECT seq, frame FROM frames WHERE frame % 5 <> 2) e ON n.seq = e.seq AND n.frame = e.frame WHERE n.n IS NULL OR e.seq IS NULL OR n.n > 1""", "ball_candidates", "frames"),
    "accepted_subset": with_adapters("SELECT 'only_a' side, count(*) n FROM detections WHERE conf >= 0.25 AND det_id % 41 = 0 HAVING count(*) > 0 UNION ALL SELECT 'only_b', count(*) FROM detections WHERE det_id % 97 = 0 AND conf < 0.25 HAVING count(*) > 0", "detections"),
    "manifest_problems": """WITH m AS (SELECT source, count(*) n FROM documents WHERE (doc_id % 3 <> 1 OR source < 'src5') AND source <> 'src3' GROUP BY 1), f AS (SELECT source, count(*) t, count(DISTINCT md5(text)) k FROM documents WHERE source <> 'src7' GROUP BY 1), b AS (SELECT coalesce(m.source, f.source) source, n, t, k FROM m FULL JOIN f ON m.source = f.source)
SELECT source, 'not_listed' rule FROM b WHERE n IS NULL UNION ALL SELECT source, 'no_files' FROM b WHERE t IS NULL UNION ALL SELECT source, 'count_differs' FROM b WHERE n <> t UNION ALL SELECT source, 'repeated_name' FROM b WHERE k < t""",
}
