"""Match events from ball and player positions in metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ball():
    return Window.partitionBy("seq").orderBy("frame")


def _last(n: int):
    return _ball().rowsBetween(-(n - 1), 0)


def _with_speed(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """points with mean_speed: path length over elapsed time of the last n points (null with fewer)."""
    w = Window.partitionBy(*keys).orderBy("frame")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    rows = points.withColumn("step", step)
    inner, last = w.rowsBetween(-(n - 2), 0), w.rowsBetween(-(n - 1), 0)
    time = F.col("ts") - F.first("ts").over(last)
    return rows.withColumn("mean_speed", F.when((F.count(F.lit(1)).over(last) == n) & (time > 0), F.sum("step").over(inner) / time)).withColumn("x0", F.first("x").over(last)).withColumn("y0", F.first("y").over(last)).drop("step")


def nearest_latest(ball: DataFrame, players: DataFrame, block: int = 64) -> DataFrame:
    """For each ball row the player nearest to it: track_id, team, distance (m).

    A player stands where they were last seen, however long ago; ties: the smaller track_id.  Each stay is dealt to the blocks of
    frames that it covers, up to the sequence's last ball row, so a ball row meets the stays of its own block only.
    """
    of = lambda c: F.floor(F.col(c) / block).cast("int")
    stays = players.withColumn("until", F.lead("frame").over(Window.partitionBy("seq", "track_id").orderBy("frame")))
    stays = stays.join(ball.groupBy("seq").agg(F.max("frame").alias("end")), "seq").where(F.col("frame") <= F.col("end"))
    stays = stays.withColumn("end", F.least(F.col("end"), F.col("until") - 1)).where(F.col("frame") <= F.col("end"))
    p = stays.select("seq", F.explode(F.sequence(of("frame"), of("end"))).alias("block"), F.col("frame").alias("since"), "end", "track_id", "team", F.col("x").alias("px"), F.col("y").alias("py"))
    both = ball.withColumn("block", of("frame")).join(p, ["seq", "block"]).where(F.col("frame").between(F.col("since"), F.col("end")))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    best = both.groupBy("seq", "frame").agg(F.min_by(F.struct("track_id", "team", d.alias("distance")), F.struct(d, "track_id")).alias("p"))
    return ball.join(best, ["seq", "frame"], "left").select(*ball.columns, "p.track_id", "p.team", "p.distance")


def shots(ball: DataFrame, players: DataFrame, speed: float = 15.0, near: float = 2.0) -> DataFrame:
    """Frames in which the ball's mean speed over its last 5 positions is over ``speed`` and it went further in x than in y; the shooter stands within ``near``."""
    rows = _with_speed(ball, ["seq"], 5).where((F.col("mean_speed") > speed) & (F.abs(F.col("x") - F.col("x0")) > F.abs(F.col("y") - F.col("y0"))))
    by = nearest_latest(rows, players)
    who = lambda c: F.when(F.col("distance") < near, F.col(c)).alias(c)
    return by.select("seq", "frame", F.lit("shot").alias("type"), "mean_speed", who("track_id"), who("team"))


def sprints(players: DataFrame, speed: float = 5.5) -> DataFrame:
    """Frames in which a player's mean speed over their last 10 positions is over ``speed``."""
    return _with_speed(players, ["seq", "track_id"], 10).where(F.col("mean_speed") > speed).select("seq", "frame", "track_id", "team", F.lit("sprint").alias("type"), "mean_speed")


def goals(ball: DataFrame, players: DataFrame, zones: tuple[Column, Column], refire: bool = False, near: float = 2.0) -> DataFrame:
    """Entries of the ball into a goal zone (conditions for the left and the right one) after at least 10 ball positions.

    One event for each entry; with ``refire`` one in every frame while the entry is among the last 10 positions.
    """
    side = F.when(zones[0], "left").when(zones[1], "right")
    rows = ball.withColumn("side", side).withColumn("n", F.row_number().over(_ball())).withColumn("was", F.lag("side").over(_ball()))
    rows = rows.withColumn("enters", F.when(F.col("side").isNotNull() & F.col("was").isNull() & (F.col("n") > 1), F.col("side")))
    if refire:
        rows = rows.withColumn("enters", F.last("enters", ignorenulls=True).over(_last(9)))
    found = nearest_latest(rows.where("enters is not null and n >= 10").select("seq", "frame", "ts", "x", "y", "enters"), players)
    who = lambda c: F.when(F.col("distance") < near, F.col(c)).alias(c)
    return found.select("seq", "frame", F.lit("goal").alias("type"), F.col("enters").alias("side"), who("track_id"), who("team"))


def passes(ball: DataFrame, players: DataFrame, near: float = 2.0, least: float = 5.0) -> DataFrame:
    """Changes of possession over more than ``least`` metres after 20 ball positions: pass within a team, else interception; team is the one that had it."""
    rows = nearest_latest(ball.withColumn("n", F.row_number().over(_ball())), players).where(F.col("distance") < near)
    had = F.lag(F.struct("track_id", "team", "x", "y")).over(_ball())
    rows = rows.withColumn("had", had).where("had is not null and had.track_id <> track_id and n >= 20")
    d = F.sqrt(F.pow(F.col("x") - F.col("had.x"), 2) + F.pow(F.col("y") - F.col("had.y"), 2))
    kind = F.when(F.col("had.team") == F.col("team"), "pass").otherwise("interception")
    return rows.withColumn("length", d).where(F.col("length") > least).select("seq", "frame", kind.alias("type"), F.col("had.track_id").alias("from_id"), F.col("track_id").alias("to_id"), F.col("had.team").alias("team"), "length")


def event_summary(events: DataFrame) -> DataFrame:
    """Events per sequence and type."""
    return events.groupBy("seq", "type").agg(F.count(F.lit(1)).alias("n"))
