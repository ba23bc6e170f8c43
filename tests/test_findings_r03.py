"""What the findings of round 3 were about, on small tables."""

import datetime as dt
import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from conftest_helpers import TABLES, compare
from pyspark.sql import functions as F
from test_stateful import at, drained

from trackloom.operators import evaluate, linking, matching
from trackloom.plans import adapters as ad
from trackloom.plans import more, streams
from trackloom.plans.registry import ORACLE_SQL, QUERIES
from trackloom.streaming import ordered


def _events(spark, rows, path):
    """rows (user_id, ts) as an events table, next to empty folders for the others that a comparison names."""
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    made = [(i, ts, u, ("click", "view", "error")[i % 3], 1.0, '{"k": %d}' % (i % 50)) for i, (u, ts) in enumerate(rows)]
    spark.createDataFrame(made, kinds).coalesce(1).write.parquet(f"{path}/events.parquet")
    for t in TABLES:
        if t == "region":
            spark.createDataFrame([(i, str(i)) for i in range(5)], "r_regionkey int, r_name string").coalesce(1).write.parquet(f"{path}/{t}.parquet")
        elif t != "events":
            spark.range(1).coalesce(1).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_periods_round_to_whole_seconds(spark, tmp_path):
    start = dt.datetime(2024, 1, 3)
    ends = [dt.timedelta(hours=6 * h) - dt.timedelta(microseconds=us) for h in range(1, 40) for us in (499_999, 500_000, 500_001, 1_500_000, 0)]
    sf = _events(spark, [(u, start + e) for e in ends for u in (1, 2, 7)], tmp_path / "t")
    for name in ("identity_gaps", "held_ball", "frozen_keys", "keyframe_boxes"):
        compare(spark, sf, QUERIES[name], ORACLE_SQL[name])
    half = spark.createDataFrame([(start + dt.timedelta(hours=6) - dt.timedelta(microseconds=us),) for us in (500_000, 500_001)], "ts timestamp_ntz")
    assert sorted(r[0] for r in half.select(ad._period()).collect()) == [8, 9]  # a half goes to the even second


def test_mcnemar_of_many_pairs(spark):
    def exact(b, c):  # in whole numbers
        n, k = b + c, min(b, c)
        term, total = 1, 0
        for i in range(k + 1):
            total += term
            term = term * (n - i) // (i + 1)
        return min(1.0, float(2 * total * 10**30 // 2**n) / 1e30)

    cases = [(0, 0), (0, 5), (31, 33), (40, 25), (300, 340), (1500, 1500), (1900, 2050)]
    began = time.time()
    big = [(10_000_000, 10_004_000), (20_000_000, 20_000_000)]
    rows = spark.createDataFrame(cases + big, "b long, c long").select("b", "c", evaluate.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert time.time() - began < 60
    for r in rows:
        if (r.b, r.c) in cases:
            assert r.p == pytest.approx(exact(r.b, r.c), rel=1e-9), r
        else:  # by the normal distribution with a correction for continuity
            z = max(0, abs(r.b - r.c) - 1) / math.sqrt(r.b + r.c)
            assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3), r


def test_candidates_wait_over_several_batches(spark, tmp_path):
    kinds = "seq int, ts timestamp, frame int, dt double, cut boolean, cands array<struct<x1: double, y1: double, x2: double, y2: double, conf: double>>"
    row = lambda i: (0, at(i / 5), i, 0.2, False, [(float(i), 0.0, i + 8.0, 8.0, 0.9)] if i % 4 else None)
    beat = (-1, at(900), -1, 0.2, False, None)
    batches = [[row(i) for i in range(a, a + 5)] for a in (0, 5, 10)] + [[beat]]
    got, _ = drained(spark, batches, kinds, lambda s: ordered.fill_ball_stream(s, "60 seconds"), tmp_path)
    assert {r.frame for r in got if r.state == "observed"} == {i for i in range(15) if i % 4} and sorted(r.frame for r in got if r.seq == 0) == list(range(15))


def test_a_replay_is_as_many_files_at_any_size(spark, tmp_path):
    rows = spark.range(4000).selectExpr("CAST(id % 50 AS INT) seq", "timestamp_micros(1704067200000000 + id * 200000) ts").repartition(60)
    stream = streams.replayed(rows)
    found = []
    q = stream.writeStream.foreachBatch(lambda b, n: found.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(found) == 4001 and len(found) <= streams.SLICES + 1


def test_equal_sharpness_is_equal(spark, sf):
    """Means of hundredths don't depend on the order of the rows that they are made of."""
    exact = ad.detections(spark, sf).groupBy("seq", "frame").agg(F.sum(F.round(F.col("conf") * 100).cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = more._features(spark, sf).join(exact, ["seq", "frame"]).collect()
    assert len(rows) > 50 and all(r.sharpness == r.s / (100 * r.n) for r in rows)


def test_every_sequence_is_calibrated(spark, tmp_path):
    start = dt.datetime(2024, 1, 3)
    sf = _events(spark, [(u, start + dt.timedelta(hours=6 * h)) for h in range(12) for u in (1, 49, 50, 51, 700)], tmp_path / "t")
    compare(spark, sf, QUERIES["calibrated_speed"], ORACLE_SQL["calibrated_speed"])
    assert QUERIES["calibrated_speed"](spark, sf).where("seq > 9 and displacement is not null").count() > 0


def test_tracks_of_many_users_compete_for_an_identity(spark, sf):
    """A sequence of identity_mapping is a tenth of the users, not five of them."""
    assert QUERIES["identity_mapping"](spark, sf).where("seq <> (track_id div 2) % 10").count() == 0
    compare(spark, sf, QUERIES["identity_mapping"], ORACLE_SQL["identity_mapping"])


def test_revisits_shuffle_payloads_once(spark):
    from trackloom.llm import revisits

    kinds = "record_id long, url string, at long, kind string, status int, headers map<string,string>, payload string"
    tag = {"etag": "a"}
    rows = [(None, "http://a/", 1, "response", 200, tag, "x"), (0, "http://a/", 3, "response", 200, tag, "y"), (1, "http://a/", 2, "revisit", 304, tag, None), (2, "http://a/", 4, "revisit", 304, tag, None), (3, "http://b/", 4, "revisit", 304, tag, None)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "-1")):
            spark.conf.set(k, v)
        found = revisits.resolve(spark.createDataFrame(rows, kinds))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r["record_id"]: (r["outcome"], r["response_id"], r["payload"]) for r in found.collect()} == {1: ("resolved", None, "x"), 2: ("resolved", 0, "y"), 3: ("no_earlier_response", None, None)}
    assert "Exchange hashpartitioning(of_" not in plan  # payloads, grouped by what the join asks for, are not dealt again


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sliding_medians_sort_without_a_comparator(spark, sf):
    plan = _plan(QUERIES["picked_frames"](spark, sf))
    assert "array_sort(_w" not in plan


def test_code_of_the_overlap_join_can_be_compiled(spark, sf):
    """The JVM leaves methods of over 8,000 bytes uncompiled."""
    conf = "spark.sql.adaptive.enabled"
    spark.conf.set(conf, "false")
    try:
        plan = QUERIES["same_frame_overlaps"](spark, sf)._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(plan)
        sizes = [s._3().maxMethodCodeSize() for s in (stages.apply(i) for i in range(stages.size())) if "Join" in s._1().split("Exchange")[0]]
    finally:
        spark.conf.set(conf, "true")
    assert sizes and max(sizes) < 8000, sizes


def test_confidence_matches_join_before_they_fold(spark, sf):
    assert "filter(truth" not in _plan(QUERIES["confidence_matches"](spark, sf))


def test_label_lines_are_split_once(spark, sf):
    plan = _plan(QUERIES["label_line_errors"](spark, sf))
    assert not any(line.count("split(") > 1 for line in plan.splitlines())


def test_export_deals_boxes_once_and_counts_kept_ids(spark, sf):
    from trackloom.operators import decisions

    assert _plan(QUERIES["export_conditions"](spark, sf)).count("FullOuter") == 1  # all that compares boxes reads one join
    box = "x1 double, y1 double, x2 double, y2 double"
    one = (0.0, 0.0, 1.0, 1.0)
    ledger = spark.createDataFrame([("a", 0, 1, "i", "player", *one), ("b", 0, 2, "i", "player", *one), ("c", 0, 3, "i", "player", *one)], f"box_id string, split int, id long, image string, cls string, {box}")
    told = spark.createDataFrame([(0, 1, "i", "player", *one, "kept", "a"), (0, 9, "i", "player", *one, "kept", "b"), (0, None, "i", "player", *one, "removed", "c"), (0, 10, "i", "referee", *one, "added", "n")], f"split int, id long, image string, cls string, {box}, outcome string, box_id string")
    state = spark.createDataFrame([("c", "FALSE_POSITIVE", "remove")], "box_id string, value string, action string")
    none = spark.createDataFrame([], f"box_id string, action string, {box}")
    found = decisions.export_conditions(ledger, told, state, spark.createDataFrame([], "image string"), none)
    assert {r["condition"]: r["failing"] for r in found.collect() if r["failing"]} == {"ids_are_kept": 1}
    assert found.count() == 8


def test_tracklets_deal_all_boxes_once(spark, sf):
    plan = _plan(QUERIES["tracklets"](spark, sf))
    assert "Window" not in plan and "lineitem" not in plan


def test_near_hashes_are_dealt_by_their_work(spark, sf):
    assert "REPARTITION_BY_NUM" in _plan(QUERIES["hash_neighbours"](spark, sf))


def test_detections_are_made_once(spark, sf):
    for name in ("average_precision", "mean_average_precision", "threshold_grid", "annotation_agreement"):
        assert "lineitem" not in _plan(QUERIES[name](spark, sf)), name


def test_hits_of_a_class_are_not_dealt_by_class_alone(spark, sf):
    """All hits of the whole would be one task's."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "-1")):
            spark.conf.set(k, v)
        plan = _plan(QUERIES["average_precision"](spark, sf))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    at = next(i for i, line in enumerate(plan.splitlines()) if "Generate explode" in line and "seen" in line)
    above = plan.splitlines()[:at]
    assert not any("SortMergeJoin [part" in line and ", Inner" in line for line in above), above


def _one_by_one(boxes):
    """det_id -> track of one sequence and class: boxes of (frame, det_id, box, conf), pairs taken one after the other."""
    live, of, count = {}, {}, 0
    for f in sorted({b[0] for b in boxes}):
        now = sorted(b[1:] for b in boxes if b[0] == f)
        live = {n: t for n, t in live.items() if f - t[0] <= 30}
        used = set()
        for r, least, mine in ((0.3, 0.2, [b for b in now if b[2] >= 0.6]), (0.5, 0.5, [b for b in now if 0.1 < b[2] < 0.6])):
            at = {n: np.array(b) + np.array(v) * (f - last) for n, (last, b, v) in live.items() if n not in used}
            pairs = sorted((-linking.buffered(np.array([b]), at[n][None], r)[0, 0] * (c if r == 0.3 else 1.0), n, d, b) for d, b, c in mine for n in at)
            for s, n, d, b in pairs:
                if -s >= least and n not in used and d not in of:
                    of[d] = n
                    used.add(n)
                    live[n] = (f, b, [(x - y) / (f - live[n][0]) for x, y in zip(b, live[n][1])])
        for d, b, c in now:
            if c >= 0.6 and d not in of:
                count += 1
                of[d], live[count] = count, (f, b, [0.0] * 4)
    return of


@pytest.mark.parametrize("size, pairs, held", [(10_000, 1 << 19, 1 << 19), (7, 3, 20)])
def test_sequences_are_linked_together_as_one_by_one(monkeypatch, size, pairs, held):
    r, rows = random.Random(23), []
    for seq in (5, 0, 9):
        for cls in ("player", "ball"):
            for f in range(40) if seq else (0, 1, 2, 40, 41, 99, 100):
                for k in range(r.randint(0, 5)):
                    x, y = float(r.randrange(90) + 3 * f), float(r.randrange(4) * 20)
                    rows.append((seq, f, len(rows) * 7 % 1009, (x, y, x + 40, y + 40), r.choice([0.05, 0.1, 0.3, 0.6, 0.9]), cls))
    assert len({x[2] for x in rows}) == len(rows)
    want = {}
    for key in {(x[0], x[5]) for x in rows}:
        of = _one_by_one([x[1:5] for x in rows if (x[0], x[5]) == key])
        for d, n in of.items():
            mine = [e for e, m in of.items() if m == n]
            if len(mine) > 1:
                want[d] = min(mine) + 1
    monkeypatch.setattr(linking, "PAIRS", pairs)
    monkeypatch.setattr(matching, "HELD", held)
    flat = pd.DataFrame([(s, f, d, *b, c, k) for s, f, d, b, c, k in sorted(rows, key=lambda x: x[1:3])], columns=["seq", "frame", "det_id", "x1", "y1", "x2", "y2", "conf", "cls"])
    found = list(matching._walk(linking.Linker(30.0), (flat[i : i + size] for i in range(0, len(flat), size))))
    assert {d: t for part in found for d, t in zip(part["det_id"], part["track_id"])} == want and len(want) > 50
    assert held > len(rows) or len(found) > 3  # tracks that have ended are told before the end


def test_tasks_link_many_sequences_in_each_step(spark, sf):
    plan = _plan(QUERIES["linked_tracks"](spark, sf))
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan and "lineitem" not in plan


@pytest.fixture(scope="module")
def close_to_periods(spark, sf, tmp_path_factory):
    """Events of 40 users, a third of them within a second of a period's end, next to the given tables."""
    r, path = random.Random(9), str(tmp_path_factory.mktemp("close"))
    first = dt.datetime(2024, 1, 3)
    near = lambda: dt.timedelta(hours=6 * r.randrange(1, 100)) - dt.timedelta(microseconds=r.choice([1, 400_000, 499_999, 500_000, 500_001, 900_000]))
    rows = [(i, first + (near() if i % 3 == 0 else dt.timedelta(seconds=r.randrange(600 * 3600))), r.randrange(40), r.choice(["click", "view", "error", "signup"]), 1.0, '{"k": %d}' % r.randrange(100)) for i in range(5000)]
    rows += [(5000 + k, first + dt.timedelta(hours=6 * (104 + k)) - dt.timedelta(milliseconds=100), 5 * k, "view", 1.0, '{"k": 1}') for k in range(8)]  # the last of their sequences
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", f"{path}/{t}.parquet")
    return path


ROUNDED = ("ball_ids", "continuity", "held_ball", "identity_gaps", "identity_mapping", "identity_violations", "keyframe_boxes", "nearest_frame", "nearest_player")


@pytest.mark.parametrize("name", ROUNDED)
def test_query_takes_periods_of_whole_seconds(spark, close_to_periods, name):
    assert compare(spark, close_to_periods, QUERIES[name], ORACLE_SQL[name]) > 0
