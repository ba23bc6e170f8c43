"""Queries of the stateful streams, over the given tables replayed in order of time, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators import decisions as dec
from ..streaming import ordered
from ..streaming.upsert import LatestTable
from . import adapters as ad
from .adapters import with_adapters
from .review import _GOAL, _M, _OBS, _PASS, _SHOT, _interpolated
from .storage import cut, shared_dir

#: Slices of time in which a table is replayed, and the files of a slice, which are one batch: every batch visits the keys with rows or timers, so there are as many at any size.
SLICES = 4
FILES = 16
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _at(frame="frame"):
    """A frame's time: five a second."""
    return F.timestamp_micros((F.lit(1_704_067_200_000_000) + F.col(frame).cast("long") * 200_000).cast("long"))


def replayed(rows: DataFrame, slices: int = SLICES, by: Column | str = "seq") -> DataFrame:
    """rows (seq int, ts, ...) as a stream of files dealt by ``by``, earlier slices of time first, and last a beat of sequence -1 long after them all, which lets the watermark pass.

    Its numbers are -1: a join drops rows without a key before they count for the watermark.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-replay"
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if ends.a is not None:
        long = F.unix_micros("ts") - F.unix_micros(F.lit(ends.a))
        of = F.least(F.lit(slices - 1), F.floor(long * slices / F.greatest(F.lit(1), F.unix_micros(F.lit(ends.b)) - F.unix_micros(F.lit(ends.a)))))
        for k in range(slices):
            rows.where(of == k).repartition(FILES, by).write.mode("append").parquet(path)
    beat = {"seq": F.lit(-1), "ts": F.lit(ends.b) + F.expr("interval 10 days") if ends.b is not None else F.current_timestamp()}
    spark.range(1).select(*(beat.get(f.name, F.lit(-1) if isinstance(f.dataType, NumericType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@contextmanager
def _stateful(spark: SparkSession):
    """The state store that transformWithState needs, for as long as a query runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run(df: DataFrame, kind: str = "append") -> DataFrame:
    """All rows that a streaming query puts out over what is there; each batch is its own folder, so one that runs again writes the same."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}-stream"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/b={number}")

    with _stateful(spark):
        df.writeStream.outputMode(kind).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out").where("seq >= 0")


def _slack(rows: DataFrame) -> str:
    """As long as a slice and a half lasts: within a slice files come in any order."""
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return f"{int((ends.b - ends.a).total_seconds() / SLICES * 1.5) + 2} seconds" if ends.a else "2 seconds"


def _metres(df: DataFrame, kind: str, track, team) -> DataFrame:
    return df.select("seq", _at().alias("ts"), "frame", F.lit(kind).alias("kind"), track.cast("long").alias("track_id"), team.cast("int").alias("team"), ((F.col("x1") + F.col("x2")) / 24).alias("x"), ((F.col("y1") + F.col("y2")) / 24).alias("y"))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    best = ad.ball_candidates(spark, sf).where("conf >= 0.25").groupBy("seq", "frame").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("conf", -F.col("x1"), "cand_id")).alias("b")).select("seq", "frame", "b.*")
    return _metres(best, "ball", F.lit(None), F.lit(None)).union(_metres(ad.track_points(spark, sf), "player", F.col("track_id"), F.col("team")))


def streamed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Goals, shots, passes and interceptions by a stateful stream: the rows of the batch queries."""
    rows = cut(_places(spark, sf))
    found = run(ordered.detect_events(replayed(rows), _slack(rows), 60.0, (8.0, 42.0), 5.0, 20.0, 20.0, 20.0, 2.0))
    return found.select("seq", "frame", "type", "side", "track_id", "team", "from_id", F.round("value", 6).alias("value"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    cands = ad.ball_candidates(spark, sf).groupBy("seq", "frame").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "conf")).alias("cands"))
    return ad.frames(spark, sf).join(cands, ["seq", "frame"], "left").select("seq", _at().alias("ts"), "frame", "dt", "cut", "cands")


def streamed_ball(spark: SparkSession, sf: str) -> DataFrame:
    """The ball of every frame with short gaps filled, by a stream; confident candidates alone are balls here, so that SQL can say it."""
    rows = cut(_frames(spark, sf))
    found = run(ordered.fill_ball_stream(replayed(rows), _slack(rows), floor=0.25, fill=0.8))
    return found.select("seq", "frame", "state", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")), "conf")


def streamed_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Both passes of the ball's recovery by a stream; equal to ``interpolated_ball``."""
    rows = cut(_frames(spark, sf))
    found = run(ordered.fill_ball_stream(replayed(rows), _slack(rows)))
    return found.select("seq", "frame", "state", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")), "conf")


def streamed_possession(spark: SparkSession, sf: str) -> DataFrame:
    """Possession per ten seconds from a stream of frames and one of humans."""
    best = ad.ball_candidates(spark, sf).where("conf >= 0.25").groupBy("seq", "frame").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("conf", -F.col("x1"), "cand_id")).alias("b"))
    frames = cut(ad.frames(spark, sf).join(best, ["seq", "frame"], "left").select("seq", _at().alias("ts"), "frame", "b.*"))
    humans = cut(ad.track_points(spark, sf).select("seq", _at().alias("ts"), "frame", "track_id", F.when(F.col("track_id") % 7 == 0, "goalkeeper").when(F.col("track_id") % 11 == 0, "referee").otherwise("player").alias("cls"), "team", "x1", "y1", "x2", "y2"))
    found = run(ordered.possession_windows(replayed(frames), replayed(humans), "10 seconds", _slack(frames), 150.0))
    return found.select("seq", F.unix_timestamp("start").alias("start"), "unknown", "team1", "team2", F.round("share1", 6).alias("share1"))


def streamed_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks by a stream: the sets of boxes are those of ``linked_tracks``, named by their smallest box."""
    rows = cut(ad.detections(spark, sf).select("seq", _at().alias("ts"), "frame", "det_id", "x1", "y1", "x2", "y2", "conf", "cls"))
    found = run(ordered.link_tracks_stream(replayed(rows, by=ordered.part_of()), 30.0, _slack(rows), 60.0))
    return found.select("seq", "det_id", (F.min("det_id").over(Window.partitionBy("track_id")) + 1).alias("track_id"))


def latest_table(spark: SparkSession, sf: str) -> DataFrame:
    """The latest decision of each box, kept by a stream in buckets."""
    log = ad.decisions(spark, sf).withColumn("seq", F.lit(0)).withColumn("ts", F.col("recorded_utc"))
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # replayed by the order of lines: what was recorded earlier may come later
    for k in range(SLICES):
        log.where(F.col("line_no") % SLICES == k).drop("seq", "ts").write.mode("append").parquet(f"{base}/log")
    stream = spark.readStream.schema(log.drop("seq", "ts").schema).option("maxFilesPerTrigger", 16).parquet(f"{base}/log")
    table = LatestTable(f"{base}/table", ["box_id"], ["recorded_utc", "line_no"])
    table.follow(stream, f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read(spark, log.drop("seq", "ts")).select("box_id", "mode", "value", "line_no")


def latest_repairs(spark: SparkSession, sf: str) -> DataFrame:
    log = ad.decisions(spark, sf).withColumn("mode", F.when(F.col("mode") == "qa_player", "geometry").when(F.col("mode") == "missed_role", "ball_case").otherwise(F.col("mode")))
    log = log.withColumn("value", F.when(F.col("value") == "uncertain", F.lit("RETRACT")).otherwise(F.concat_ws(",", "value", F.col("line_no") % 9)))
    return dec.latest_repairs(log)


QUERIES: dict[str, Callable] = {f.__name__: f for f in (streamed_events, streamed_ball, streamed_recovery, streamed_possession, streamed_tracks, latest_table, latest_repairs)}

_EVENTS = f"""WITH {_OBS}, {_M}, {_SHOT.replace("nl AS", "nsh AS")}, {_GOAL.replace("nl AS", "ngo AS")}, {_PASS}
SELECT seq, frame, 'goal' AS "type", side, CASE WHEN distance < 20 THEN track_id END track_id, CASE WHEN distance < 20 THEN team END team, CAST(NULL AS BIGINT) from_id, CAST(NULL AS DOUBLE) AS "value" FROM ngo
UNION ALL SELECT seq, frame, 'shot', NULL, CASE WHEN distance < 20 THEN track_id END, CASE WHEN distance < 20 THEN team END, NULL, round(mean_speed, 6) FROM nsh UNION ALL SELECT seq, frame, "type", NULL, to_id, team, from_id, round(length, 6) FROM ps"""
ORACLE_SQL = {
    "streamed_events": with_adapters(_EVENTS, "ball_candidates", "frames", "track_points"),
    "streamed_ball": with_adapters(f"WITH {_OBS.replace('cand_id DESC', 'y1')}, os AS (SELECT *, CASE WHEN x1 IS NULL THEN 'unknown' ELSE 'observed' END state FROM o), {_interpolated('os', 0.8)}", "ball_candidates", "frames"),
    "streamed_possession": with_adapters(f"""WITH {_OBS}, h AS (SELECT seq, frame, track_id, team, x1, x2, y2, CASE WHEN track_id % 7 = 0 THEN 1 ELSE 0 END k FROM track_points WHERE track_id % 7 = 0 OR track_id % 11 <> 0),
d AS (SELECT o.seq, o.frame, h.track_id, h.team, h.k, least(sqrt(pow(h.x1-(o.x1+o.x2)/2, 2)+pow(h.y2-(o.y1+o.y2)/2, 2)), sqrt(pow(h.x2-(o.x1+o.x2)/2, 2)+pow(h.y2-(o.y1+o.y2)/2, 2))) d FROM o JOIN h USING (seq, frame)),
n AS (SELECT * FROM d WHERE d < 150 QUALIFY row_number() OVER (PARTITION BY seq, frame ORDER BY d, k, track_id) = 1), t AS (SELECT o.seq, 1704067200 + o.frame // 50 * 10 AS "start", CASE WHEN k = 0 THEN team ELSE 0 END team FROM o LEFT JOIN n USING (seq, frame))
SELECT seq, "start", count(*) FILTER (WHERE coalesce(team, 0) = 0) AS "unknown", count(*) FILTER (WHERE team = 1) team1, count(*) FILTER (WHERE team = 2) team2, round(CASE WHEN count(*) FILTER (WHERE team > 0) > 0 THEN count(*) FILTER (WHERE team = 1) / CAST(count(*) FILTER (WHERE team > 0) AS DOUBLE) ELSE 0 END, 6) share1 FROM t GROUP BY 1, 2""", "ball_candidates", "frames", "track_points"),
    "latest_table": with_adapters("""SELECT box_id, mode, "value", line_no FROM decisions QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY recorded_utc DESC NULLS LAST, line_no DESC) = 1""", "decisions"),
    "latest_repairs": with_adapters("""WITH r AS (SELECT box_id, CASE mode WHEN 'qa_player' THEN 'geometry' WHEN 'missed_role' THEN 'ball_case' END kind, CASE WHEN "value" = 'uncertain' THEN 'RETRACT' ELSE "value" || ',' || CAST(line_no % 9 AS VARCHAR) END v, recorded_utc, line_no FROM decisions WHERE mode IN ('qa_player', 'missed_role')),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY box_id, kind ORDER BY recorded_utc DESC NULLS LAST, line_no DESC) = 1)
SELECT box_id, max(v) FILTER (WHERE kind = 'geometry' AND v <> 'RETRACT') geometry, max(v) FILTER (WHERE kind = 'ball_case' AND v <> 'RETRACT') ball_case, max(line_no) last_line FROM l GROUP BY 1 HAVING count(*) FILTER (WHERE v <> 'RETRACT') > 0""", "decisions"),
}
