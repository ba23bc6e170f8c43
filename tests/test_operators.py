"""Rules of the operators on small literal tables, and folds against brute force."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import audit, decisions, dupes, evaluate, events, filters, graph, joins, kinematics, matching, splits, teams, temporal

BOX = "seq int, frame int, det_id long, x1 double, y1 double, x2 double, y2 double, cls string, conf double"


def test_geometry(spark):
    b = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v)))
    a, c, flat = b(0, 0, 10, 10), b(5, 0, 15, 10), b(3, 3, 3, 3)
    p = g.point(F.lit(-7.5), F.lit(3.0))
    r = spark.range(1).select(
        g.iou(a, c).alias("iou"), g.iou(flat, flat).alias("none"), g.giou(a, c).alias("giou"), g.ciou(a, a).alias("one"), g.overlap_ratio(a, c).alias("cover"), g.center_int(b(-3, -3, 0, 0)).alias("c"),
        g.clamp(b(-5, -5, 5, 5), 100, 100).alias("in_"), g.clamp(b(-5, -5, -1, 5), 100, 100).alias("out"), g.foot_distance(a, g.point(F.lit(10.0), F.lit(13.0))).alias("foot"), g.bottom_edge_point(a, p).alias("edge"),
        g.xcycsr_to_xyxy(g.xyxy_to_xcycsr(c)).alias("back"), g.denormalize(g.normalize(c, 20, 20), 20, 20).alias("back2"), g.polygon_box(F.array(*map(F.lit, (1.0, 5.0, 4.0, 2.0, 3.0, 9.0)))).alias("poly"),
        g.project(F.array(*map(F.lit, (1.0, 0.0, 2.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0))), p).alias("inf"), g.hue_dist(F.lit(175), F.lit(5)).alias("hue"), g.hamming64(F.lit(-1), F.lit(0)).alias("ham"), g.game_seconds(F.lit("2 - 12:34")).alias("clock"),
        g.source_stem(F.lit("a/b/match_12_jpg.rf.AB12.jpg")).alias("stem"), g.frame_index(F.lit("match2_frame_0012")).alias("idx"), g.ncc(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))).alias("ncc"),
        g.crop_transform(b(0, 0, 10, 10), b(5, 0, 50, 50)).alias("crop"), g.warp_box(F.array(*map(F.lit, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0))), b(0, 0, 4, 2)).alias("warp"),
    ).first()
    assert r.iou == pytest.approx(1 / 3) and r.none == 0 and r.giou == pytest.approx(1 / 3) and r.one == pytest.approx(1) and r.cover == 0.5
    assert tuple(r.c) == (-1, -1) and tuple(r.in_) == (0, 0, 5, 5) and r.out is None and r.foot == 3 and tuple(r.edge) == (0, 10)
    assert tuple(r.back) == (5, 0, 15, 10) == tuple(r.back2) and tuple(r.poly) == (1, 2, 4, 9) and r.inf is None
    assert (r.hue, r.ham, r.clock, r.stem, r.idx) == (10, 64, 754, "match_12", 12) and r.ncc == pytest.approx(1) and r.crop is None and tuple(r.warp) == (-2, 0, 0, 4)


def test_filters(spark):
    d = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 5.0, 5.0, " Person", 0.25), (0, 0, 2, 0.0, 0.0, 5.0, 5.0, "drone", 0.1), (0, 0, 3, 0.0, 0.0, 5.0, 5.0, "ball", 0.0999)], BOX)
    assert {r.det_id: r.cls for r in filters.normalize_classes(d).collect()} == {1: "player", 3: "ball"}
    assert {r.det_id: r.cls for r in filters.normalize_classes(d, unmapped="UNMAPPED_REVIEW_REQUIRED").collect()}[2] == "UNMAPPED_REVIEW_REQUIRED"
    assert {r.det_id: r.state for r in filters.tag_confidence(d).collect()} == {1: "observed", 2: "candidate_low_conf"}
    lab = spark.createDataFrame([(0,), (1,), (5,)], "cls_id int")
    got = {r.cls_id: (r.target_id, r.problem) for r in filters.remap_classes(lab, ["Ball", "cow"], ["player", "ball"]).collect()}
    assert got == {0: (1, None), 1: (None, "unmapped cow"), 5: (None, "no such class")}
    flow = spark.createDataFrame([(0, 1, 1, 3.0, 4.0, True), (0, 1, 2, 9.0, 9.0, False), (0, 2, 1, 0.0, 6.0, True), (0, 2, 2, 6.0, 0.0, True), (0, 0, 1, 50.0, 0.0, True)], "seq int, frame int, feature int, dx double, dy double, valid boolean")
    assert {r.frame: (r.dx, r.dy) for r in filters.dominant_motion(flow).collect()} == {0: (0, 0), 1: (0, 0), 2: (0, 6)}


def test_possession_rules(spark):
    t = spark.createDataFrame([(0, 0, 1, "player", 1, 0.0, 0.0, 10.0, 50.0), (0, 1, 2, "goalkeeper", 2, 0.0, 0.0, 10.0, 50.0), (0, 2, 1, "player", 1, 0.0, 0.0, 10.0, 50.0)], "seq int, frame int, track_id long, cls string, team int, x1 double, y1 double, x2 double, y2 double")
    ball = spark.createDataFrame([(0, 0, 79.0, 49.0, 81.0, 51.0), (0, 1, 20.0, 49.0, 22.0, 51.0), (0, 2, 60.0, 49.0, 62.0, 51.0)], "seq int, frame int, x1 double, y1 double, x2 double, y2 double")
    frames = spark.createDataFrame([(0, i) for i in range(4)], "seq int, frame int")
    p = kinematics.possession(t, ball, frames)
    assert {r.frame: (r.possessor_id, r.team) for r in p.collect()} == {0: (None, 0), 1: (2, 0), 2: (1, 1), 3: (None, 0)}  # exactly 70 px is too far
    s = {r.frame: (r.share1, r.share2) for r in kinematics.possession_share(p).collect()}
    assert s == {0: (0, 0), 1: (0, 0), 2: (1, 0), 3: (1, 0)}


@pytest.mark.parametrize("n", [1, 2, 5, 6, 11])
def test_speed_windows(spark, n):
    pts = spark.createDataFrame([(0, 1, i, 12.0 * i * i, 0.0) for i in range(n)], "seq int, track_id long, frame int, px double, py double")
    got = {r.frame: (r.speed, r.distance) for r in kinematics.speed_distance(pts, 1.0).collect()}
    want = {}
    total = 0.0
    for a in range(0, n, 5):
        b = min(a + 5, n - 1)
        m = float(b * b - a * a)
        total += m
        for f in range(a, b + 1):
            want[f] = (m / (b - a) * 3.6 if b > a else 0.0, total)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_hamming_pairs_equal_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    h = [base[r.randrange(12)] for _ in range(150)]
    for i in range(150):
        for _ in range(r.randrange(12)):
            h[i] ^= 1 << r.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    df = spark.createDataFrame(list(enumerate(signed)), "image_id long, dhash long")
    first = {}
    for i, x in enumerate(h):
        first.setdefault(x, i)
    reps = sorted(first.values())
    for d in (0, 8, 10, 14):
        want = [(i, j, bin(h[i] ^ h[j]).count("1")) for i, j in itertools.combinations(reps, 2) if bin(h[i] ^ h[j]).count("1") <= d] + [(first[x], i, 0) for i, x in enumerate(h) if first[x] != i]
        assert sorted((x.a, x.b, x.distance) for x in joins.hamming_pairs(df, d).collect()) == sorted(want)
        for bands in (2, 4, 7, 16):
            near = sorted((x.dhash, x.other) for x in joins.near_hashes(df, df, d, bands=bands).where("dhash < other").collect()) if d < 14 or bands > 2 else None
            assert near is None or near == sorted({tuple(sorted((signed[i], signed[j]))) for i, j in itertools.combinations(reps, 2) if bin(h[i] ^ h[j]).count("1") <= d})


def test_hamming_candidates_are_few():
    for n in (1_200, 100_000, 10_000_000):
        bands = joins._bands(8, joins.choose_bands(8, n, n))
        assert sum(joins._flips(b, m) / 2**b for _, b, m in bands) < 0.01
    assert joins._bands(8, 4) == [(0, 16, 2), (16, 16, 1), (32, 16, 1), (48, 16, 1)]
    assert joins._bands(0, 4) == [(0, 16, 0)]


def test_equal_hashes_are_a_class(spark):
    df = spark.createDataFrame([(i, 5 if i else None) for i in range(60)] + [(99, 4)], "image_id long, dhash long")
    got = joins.hamming_pairs(df, 8).collect()
    assert len(got) == 59 and {(r.a, r.b) for r in got if r.distance} == {(1, 99)}


def test_near_duplicate_verdicts_of_classes(spark):
    flat = [float(i % 7) for i in range(64)]
    near = [x + (0.01 if i == 3 else 0.0) for i, x in enumerate(flat)]
    other = [float((i * 5) % 11) for i in range(64)]
    rows = [(3, 9, flat), (1, 9, flat), (2, 9, near), (7, 9, other), (8, 9, flat), (4, None, flat)]
    got = {(r.a, r.b): r.verdict for r in dupes.near_duplicates(spark.createDataFrame(rows, "image_id long, dhash long, sig array<double>"), 8, 0.2).collect()}
    assert got == {(1, 3): "EXACT", (1, 8): "EXACT", (1, 2): "NEAR_IDENTICAL", (1, 7): "DISTINCT", (2, 7): "DISTINCT"}


def test_group_similarity_by_tiles(spark):
    r = random.Random(9)
    rows = [(i, i % 2, [r.random() for _ in range(5)]) for i in range(23)] + [(100, 7, [1.0] * 5), (101, 8, [0.5] * 5), (102, 8, [0.1, 0.2, 0.3, 0.4, 0.9])]
    df = spark.createDataFrame(rows, "image_id long, g int, sig array<double>")
    a, b = ({r.g: (r.pairs, round(r.median, 9), round(r.p90, 9), r.alike) for r in dupes.group_similarity(df, "g", tile=t).collect()} for t in (3, 1000))
    assert a == b and a[0][0] == 66 and a[8] == (1, 0.0, 0.0, 0) and 7 not in a
    (big,) = [r for r in dupes.group_similarity(df, "g", most=11).collect() if r.g == 0]
    assert big.pairs == 66 and big.median is None


def test_leakage_finds_every_orientation(spark):
    r = random.Random(4)
    sig = [r.random() for _ in range(64)]
    held = spark.createDataFrame([(1, sig, "val")], "image_id long, sig array<double>, split string")
    turned = audit.oriented(held.select("image_id", "sig"), 8).select((10 + F.col("turn")).cast("long").alias("image_id"), "sig")
    noise = spark.createDataFrame([(50, [r.random() for _ in range(64)])], "image_id long, sig array<double>")
    assert sorted(x.image_id for x in audit.leakage(turned.union(noise), held, 8).collect()) == list(range(10, 18))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 240)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_hubs_and_chains(spark):
    """A star of a third of all nodes is dealt to many tasks, and a chain of any length ends at its smallest node."""
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(200)] + [(3000 - i, 2999 - i) for i in range(70)] + [(7, 7), (5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert {got[i] for i in range(400)} == {0} and {got[1000 + i] for i in range(201)} == {1000} and {got[3000 - i] for i in range(71)} == {2930} and got[5000] == 5000 and len(got) == 400 + 201 + 71 + 1
    hub = graph._with_smallest(spark.createDataFrame([(5, i) for i in range(6, 3000)], "u long, v long").repartition(4), "u", "v").groupBy(F.pmod(F.xxhash64("v"), F.lit(graph.SALTS))).count()
    assert hub.count() == graph.SALTS and {r.m for r in graph._with_smallest(spark.createDataFrame([(5, 9), (5, 7), (4, 9)], "u long, v long"), "u", "v").collect()} == {5, 4}


def test_suppression_threshold_and_ties(spark):
    rows = [(0, 0, 1, 0.0, 0.0, 100.0, 1.0, "ball", 0.5), (0, 0, 2, 0.0, 0.0, 70.0, 1.0, "ball", 0.5), (0, 1, 3, 0.0, 0.0, 100.0, 1.0, "ball", 0.5), (0, 1, 4, 0.0, 0.0, 69.0, 1.0, "ball", 0.9), (0, 0, 5, 0.0, 0.0, 100.0, 1.0, "player", 0.1), (0, 0, 6, 0.0, 0.0, 100.0, 1.0, "player", 0.1)]
    got = matching.suppress_duplicates(spark.createDataFrame(rows, BOX)).collect()
    assert sorted(r.det_id for r in got) == [1, 3, 4, 5, 6]


def test_order_of_input_does_not_matter(spark):
    r = random.Random(4)
    rows = [(i % 3, (i // 3) % 4, i, x := float(r.randrange(60)), y := float(r.randrange(40)), x + 30, y + 30, r.choice(["ball", "player"]), r.randrange(100) / 100) for i in range(120)]
    a = spark.createDataFrame(rows, BOX)
    b = spark.createDataFrame(r.sample(rows, len(rows)), BOX).repartition(5)
    for f in (lambda d: matching.match_one_to_one(d.where("det_id % 2 = 0"), d, 0.2), lambda d: matching.match_by_confidence(d.where("det_id % 2 = 0"), d, 0.2), lambda d: matching.suppress_duplicates(d, "player", 0.3), lambda d: matching.link_tracks(d, 30.0, 0.5)):
        assert sorted(map(repr, f(a).collect())) == sorted(map(repr, f(b).collect()))


def test_linking_invariants(spark):
    rows = []
    for f in range(12):
        if f not in (4, 5):
            rows.append((0, f, f, 10.0 * f, 0.0, 10.0 * f + 30, 60.0, "player", 0.9))
        rows.append((0, f, 100 + f, 400.0, 0.0, 430.0, 60.0, "player", 0.3 if f else 0.8))
        rows.append((1, f, 200 + f, 10.0 * f, 0.0, 10.0 * f + 30, 60.0, "player", 0.9))
    rows.append((0, 3, 300, 600.0, 0.0, 630.0, 60.0, "player", 0.9))
    out = {r.det_id: r.track_id for r in matching.link_tracks(spark.createDataFrame(rows, BOX), 30.0).collect()}
    assert len({out[f] for f in range(12) if f not in (4, 5)}) == 1 and len({out[100 + f] for f in range(12)}) == 1
    assert out[300] is None and out[0] != out[200] and all(t is None or t > 0 for t in out.values())


def brute_select(cands, frames, accept=0.25, floor=0.10, max_gap=0.6, gate=60.0, growth=40.0, look_ahead=False):
    out, a, b = {}, None, None
    for at, (seq, frame, ts, dt, cut) in enumerate(frames):
        if cut:
            a = b = None
        mine = sorted((-c[6], *c[2:6]) for c in cands if c[0] == seq and c[1] == frame and c[6] >= floor)
        got, state = None, "unknown"
        if mine and -mine[0][0] >= accept:
            got, state = mine[0], "observed"
        weak = [c for c in mine if -c[0] < accept]
        near = []
        if not got and b and ts - b[0] <= max_gap + 1e-9:
            k = (ts - b[0]) / (b[0] - a[0]) if a and b[0] > a[0] else 0.0
            px, py = (b[1] + ((b[1] - a[1]) * k if a else 0.0)), (b[2] + ((b[2] - a[2]) * k if a else 0.0))
            r = gate + growth * max(0, round((ts - b[0]) / dt) - 1)
            near = [(d, *c) for c in weak if (d := (((c[1] + c[3]) / 2 - px) ** 2 + ((c[2] + c[4]) / 2 - py) ** 2) ** 0.5) <= r]
        if not got and look_ahead and at + 1 < len(frames) and not frames[at + 1][4]:
            nxt = max((c for c in cands if c[1] == frames[at + 1][1] and c[6] >= accept), key=lambda c: (c[6], -c[2]), default=None)
            if nxt:
                x, y = (nxt[2] + nxt[4]) / 2, (nxt[3] + nxt[5]) / 2
                near += [(d, *c) for c in weak if (d := (((c[1] + c[3]) / 2 - x) ** 2 + ((c[2] + c[4]) / 2 - y) ** 2) ** 0.5) <= gate]
        if near:
            got, state = min(near)[1:], "recovered_low_conf"
        if got:
            a, b = b, (ts, (got[1] + got[3]) / 2, (got[2] + got[4]) / 2)
        out[frame] = (state, got[1] if got else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ball_selector_equals_brute_force(spark, seed):
    r = random.Random(seed)
    frames = [(0, f, f * 0.2, 0.2, f in (17, 30)) for f in range(60)]
    cands = []
    for f in range(60):
        for _ in range(r.choice([0, 0, 1, 2])):
            x, y = 5.0 * f + r.randrange(-60, 60), 100.0 + r.randrange(-30, 30)
            cands.append((0, f, x, y, x + 8, y + 8, r.randrange(5, 45) / 100))
    cd = spark.createDataFrame(cands, "seq int, frame int, x1 double, y1 double, x2 double, y2 double, conf double")
    fd = spark.createDataFrame(frames, "seq int, frame int, ts double, dt double, cut boolean")
    sel = temporal.select_ball(cd, fd)
    got = {x.frame: (x.state, x.x1) for x in sel.collect()}
    assert got == brute_select(cands, frames) and len({s for s, _ in got.values()}) == 3
    ahead = {x.frame: (x.state, x.x1) for x in temporal.select_ball(cd, fd, look_ahead=True).collect()}
    assert ahead == brute_select(cands, frames, look_ahead=True)
    states = [x.state for x in temporal.interpolate_ball(sel, fd).orderBy("frame").collect()]
    assert all(s == t for s, t in zip(states, (got[f][0] for f in range(60))) if s != "interpolated_short_gap")


def test_interpolation_limits(spark):
    box = (0.0, 0.0, 8.0, 8.0)
    row = lambda f, known: (0, f, "observed" if known else "unknown", *(box if known else (None,) * 4), 0.9 if known else None)
    sel = spark.createDataFrame([row(f, f in (0, 3, 7)) for f in range(8)], "seq int, frame int, state string, x1 double, y1 double, x2 double, y2 double, conf double")
    fr = lambda cut: spark.createDataFrame([(0, f, f * 0.2, 0.2, f == cut) for f in range(8)], "seq int, frame int, ts double, dt double, cut boolean")
    known = lambda cut: [x.frame for x in temporal.interpolate_ball(sel, fr(cut)).orderBy("frame").collect() if x.state == "interpolated_short_gap"]
    assert known(99) == [1, 2] and known(3) == [] and known(4) == [1, 2]  # 0.4 s is short enough, 0.6 s isn't


def test_decision_rules(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    log = [(1, "a", "qa", "player", t(5)), (2, "a", "qa", "referee", None), (3, "b", "qa", "player", t(1)), (4, "b", "qa", "FALSE_POSITIVE", t(1)), (5, "c", "missed_role", "NON_TARGET_HUMAN", t(1)), (6, "c", "missed_role", "player", t(2)), (7, "d", "missed_role", "FALSE_POSITIVE", t(3)), (8, "d", "missed_role_manual", "player", t(2))]
    df = spark.createDataFrame(log, "line_no long, box_id string, mode string, value string, recorded_utc timestamp")
    assert {r.box_id: (r.value, r.action) for r in decisions.effective_state(df).where("box_id < 'c'").collect()} == {"a": ("player", "keep"), "b": ("FALSE_POSITIVE", "remove")}
    assert {r.box_id: r.state for r in decisions.missing_targets(df).collect()} == {"c": "RETRACTED", "d": "EXCLUDED"}
    assert {r.box_id for r in decisions.conflicts(df).collect()} == {"a", "b", "c", "d"}


def test_splits(spark):
    src = spark.createDataFrame([("m1", "d", 50), ("m2", "d", 30), ("m3", "d", 20), ("m4", "d", 5), ("n1", "e", 7)], "match string, domain string, images int")
    pins = spark.createDataFrame([("m4", "spare")], "match string, split string")
    ratios = {"train": 0.8, "test": 0.2, "spare": 0.0}
    got = {r.match: r.split for r in splits.assign_splits(src, ratios, 1, pins).collect()}
    assert set(got) == {"m1", "m2", "m3", "m4", "n1"} and got["m4"] == "spare" and list(got.values()).count("spare") == 1 and got["m1"] == "train"
    twice = pins.union(spark.createDataFrame([("m4", "test")], pins.schema))
    with pytest.raises(Exception, match="pinned twice"):
        splits.assign_splits(src, ratios, 1, twice).collect()


@pytest.mark.parametrize("seed", range(3))
def test_diverse_batch_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("aab"), r.choice([None, r.getrandbits(64) - (1 << 63), 5]), r.randrange(4)) for i in range(90)]
    tie = lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest()
    want = set()
    for source in "ab":
        left = sorted((x for x in rows if x[1] == source), key=lambda x: (-x[3], tie(x[0])))
        quota = min(len(left), max(1, round(len(left) * 20 / len(rows))))
        chosen = [left.pop(0)]
        while len(chosen) < quota:
            far = lambda x: 32 if x[2] is None else min((bin((x[2] ^ c[2]) & (1 << 64) - 1).count("1") for c in chosen if c[2] is not None), default=64)  # noqa: B023, E731
            chosen.append(left.pop(max(range(len(left)), key=lambda k: (far(left[k]) + left[k][3], -k))))
        want |= {(x[0], source, turn) for turn, x in enumerate(chosen)}
    images = spark.createDataFrame(rows, "image_id long, source string, dhash long, priority int")
    for width in (3, 1000):
        assert {tuple(x) for x in splits.diverse_batch(images, 20, seed, width).collect()} == want


def test_nearest_frame_and_segments_keep_repeats(spark):
    points = spark.createDataFrame([(1, 2, 5.0), (1, 6, 7.0), (1, 6, 9.0), (2, 0, 1.0)], "track_id int, frame int, v double")
    asked = spark.createDataFrame([(1, 4), (1, 0), (1, 6), (1, 99), (2, 7), (3, 1)], "track_id int, frame int")
    got = {(r.track_id, r.frame): (r.at_frame, r.v) for r in joins.nearest_frame(points, asked).collect()}
    assert got == {(1, 4): (2, 5.0), (1, 0): (2, 5.0), (1, 6): (6, 7.0), (1, 99): (6, 7.0), (2, 7): (0, 1.0)}
    segments = spark.createDataFrame([(0, 1, 0, 9, [1.0]), (0, 0, 5, 9, [2.0])], "seq int, ord int, f0 int, f1 int, h array<double>")
    at = spark.createDataFrame([(0, 1), (0, 6), (0, 6), (0, 99), (7, 1)], "seq int, frame int")
    assert sorted((r.seq, r.frame, r.seg_ord) for r in joins.attach_segment(at, segments).na.fill(-1).collect()) == [(0, 1, 1), (0, 6, 0), (0, 6, 0), (0, 99, -1), (7, 1, -1)]


def test_change_points_and_switches(spark):
    def series(t, values):
        return [(t, k, [float(v), 0.1 * (k % 3)]) for k, v in enumerate(values)]

    rows = series(1, [0, 0.1, 0, 0.1, 9, 9.1, 9, 9.1]) + series(2, [1, 1.1, 0.9, 1, 1.1, 1, 0.9, 1]) + series(3, [1, 9]) + series(4, [0, 9, 0, 0.1, 0, 0, 9.1, 0.1, 0, 0])
    d = spark.createDataFrame(rows, "track_id int, ord int, d array<double>")
    got = {r.track_id: (r.split, r.changed) for r in teams.change_point(d).collect()}
    assert got == {1: (4, True), 2: (None, False), 3: (None, False), 4: (None, False)}
    kinds = {r.track_id: (r.kind, r.longest) for r in teams.switch_classes(d.withColumnRenamed("ord", "frame"), 2, separation=10.0).collect()}
    assert kinds[1] == ("sustained", 4) and kinds[2][0] == "unimodal" and kinds[3][0] == "too_short" and kinds[4] == ("intermittent", 1)


def test_possession_is_scored_by_what_can_be_judged(spark):
    rows = [("PLAYER", 1, 5, 1, 2), ("PLAYER", 1, 5, 3, 1), ("PLAYER", 1, None, None, None), ("PLAYER", 1, 5, None, 1), ("NO_BALL", None, 5, 1, 1), ("NO_CONTROL", None, None, None, None), ("AMBIGUOUS", None, 5, 1, 1)]
    df = spark.createDataFrame([(1, "observed", k % 2 == 0, k, *r) for k, r in enumerate(rows)], "window int, ball_state string, ball_present boolean, frame int, label string, gt_player long, assigned long, mapped long, mapped_before long")
    whole = evaluate.possession_scores(df).where("by = 'all'").first().asDict()
    want = {"frames": 7, "ambiguous": 1, "player": 4, "mappable": 2, "correct": 1, "wrong": 1, "unassigned": 1, "unmappable": 1, "no_control": 1, "false_no_control": 0, "no_ball": 1, "false_no_ball": 1}
    assert {k: whole[k] for k in want} == want
    assert {r.error: r.n for r in evaluate.possession_errors(df).collect()} == {"BALL_MISSING": 1, "UNASSIGNED_PLAYER": 1, "UNMAPPABLE": 1, "SHOULD_BE_UNKNOWN": 1}
    assert {tuple(r) for r in evaluate.possession_changes(df, "frame").collect()} == {(0, "wrong", "correct"), (1, "correct", "wrong"), (3, "correct", "unmappable")}


def test_exact_intervals_equal_enumeration(spark):
    rows = [(3, 30, 1232 // 10), (0, 10, 40), (10, 10, 40), (5, 12, 12), (3, 300, 1232), (4, 2, 9), (0, 0, 5), (None, 3, 9)]
    got = evaluate.exact_intervals(spark.createDataFrame(rows, "k long, n long, population long")).collect()
    for r in got:
        if (r.k, r.n) in ((4, 2), (0, 0), (None, 3)):
            assert (r.low, r.high, r.least, r.most) == (None,) * 4
            continue
        p = lambda m, ks: sum(math.comb(m, j) * math.comb(r.population - m, r.n - j) for j in ks) / math.comb(r.population, r.n)  # noqa: B023, E731
        ok = [m for m in range(r.population + 1) if p(m, range(r.k, r.n + 1)) >= 0.025 and p(m, range(r.k + 1)) >= 0.025]
        assert (r.least, r.most) == (min(ok), max(ok)), r
        tail = lambda q, ks: sum(math.comb(r.n, j) * q**j * (1 - q) ** (r.n - j) for j in ks)  # noqa: B023, E731
        assert r.low == 0 if r.k == 0 else tail(r.low, range(r.k, r.n + 1)) == pytest.approx(0.025, abs=1e-9)
        assert r.high == 1 if r.k == r.n else tail(r.high, range(r.k + 1)) == pytest.approx(0.025, abs=1e-9)
    assert next(r.least for r in got if r.n == 300) == 4


def test_export_conditions_find_what_was_not_decided(spark):
    box = (0.0, 0.0, 4.0, 8.0)
    ledger = spark.createDataFrame([(f"b{k}", k % 2, k, f"i{k % 3}", "player", *box) for k in range(8)], "box_id string, split int, id long, image string, cls string, x1 double, y1 double, x2 double, y2 double")
    state = spark.createDataFrame([("b1", "FALSE_POSITIVE", "remove"), ("b3", "referee", "keep"), ("b4", "referee", "keep")], "box_id string, value string, action string")
    gone = spark.createDataFrame([("i2",)], "image string")
    balls = spark.createDataFrame([("b4", "DRAW_BALL_BOX", 1.0, 1.0, 2.0, 2.0), ("b6", "REMOVE_ONLY", *box)], "box_id string, action string, x1 double, y1 double, x2 double, y2 double")
    repairs = spark.createDataFrame([("b7", "goalkeeper", 9.0, 0.0, 12.0, 8.0), ("b1", "goalkeeper", *box)], "box_id string, cls string, x1 double, y1 double, x2 double, y2 double")
    added = spark.createDataFrame([("n2", 0, "i0", "player", *box, None), ("n1", 0, "i0", "player", *box, None), ("n3", 1, "i2", "player", *box, None)], "box_id string, split int, image string, cls string, x1 double, y1 double, x2 double, y2 double, flagged_utc string")
    out = decisions.apply_decisions(ledger, state, gone, balls, repairs, added)
    got = {r.box_id: (r.outcome, r.id, r.cls, r.x1) for r in out.collect()}
    assert got == {
        "b0": ("kept", 0, "player", 0.0), "b1": ("removed", None, "player", 0.0), "b2": ("excluded", None, "player", 0.0), "b3": ("changed", 3, "referee", 0.0), "b4": ("ball_fix", 4, "ball", 1.0),
        "b5": ("excluded", None, "player", 0.0), "b6": ("removed", None, "player", 0.0), "b7": ("repaired", 7, "goalkeeper", 9.0), "n1": ("added", 7, "player", 0.0), "n2": ("added", 8, "player", 0.0),
    }
    failing = lambda df: {r.condition for r in decisions.export_conditions(ledger, df, state, gone, balls).collect() if not r.passed}
    assert failing(out) == set()
    assert failing(out.withColumn("x1", F.col("x1") + F.when(F.col("box_id") == "b0", 1).otherwise(0))) == {"geometry_moves_by_repair_only"}
    assert failing(out.where("box_id <> 'b3'")) == {"geometry_moves_by_repair_only", "every_source_box_has_an_outcome"}
    assert failing(out.withColumn("outcome", F.expr("if(box_id = 'b0', 'removed', outcome)"))) == {"removals_are_decided"}
    assert failing(out.withColumn("cls", F.expr("if(box_id = 'b0', 'ball', cls)"))) == {"new_balls_are_approved"}
    assert failing(out.withColumn("id", F.expr("if(box_id = 'n2', 7, id)"))) == {"ids_are_unique"}
    assert failing(out.withColumn("id", F.expr("if(box_id = 'b0', 99, id)"))) == {"ids_are_kept"}
    assert failing(out.withColumn("image", F.expr("if(box_id = 'b0', 'i2', image)"))) == {"excluded_images_are_absent"}


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (5, 5), (1, 9), (0, 12), (30, 10)], "b long, c long")
    from math import comb

    for r in rows.select("b", "c", evaluate.mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        n = r.b + r.c
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2**n)
        assert r.p == pytest.approx(want, abs=1e-9)


def test_goal_refires_only_on_request(spark):
    ball = spark.createDataFrame([(0, f, f / 5, 50.0 if f == 12 else 25.0, 10.0) for f in range(20)], "seq int, frame int, ts double, x double, y double")
    players = spark.createDataFrame([(0, 3, 7, 1, 49.0, 10.0)], "seq int, frame int, track_id long, team int, x double, y double")
    zones = (F.col("x") < 1, F.col("x") > 49)
    assert [(r.frame, r.side, r.track_id) for r in events.goals(ball, players, zones).collect()] == [(12, "right", 7)]
    assert len(events.goals(ball, players, zones, refire=True).collect()) == 8


def test_plans_have_equi_keys(spark, sf):
    """No plan of a registered query pairs rows without a key."""
    from trackloom.plans.registry import QUERIES

    for name in ("same_frame_overlaps", "possession", "hash_neighbours", "greedy_matches", "calibrated_speed", "goal_events"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_samples_are_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in dupes.srswor(df, 10, 3, "k").collect()]
    assert a == [r.k for r in dupes.srswor(df.repartition(7), 10, 3, "k").collect()] and a != [r.k for r in dupes.srswor(df, 10, 4, "k").collect()]
    f = dupes.fingerprint(df, "k").first()
    assert f == dupes.fingerprint(df.repartition(5), "k").first() and f != dupes.fingerprint(df.where("k > 0"), "k").first()


def test_picked_frames_equal_brute_force(spark):
    import statistics

    r = random.Random(6)
    rows = [(q, f, r.random() * (6 if r.random() < 0.1 else 1), r.random(), r.choice([r.getrandbits(62), 5, 5 | 1 << 40])) for q in (0, 1) for f in range(700) if r.random() < 0.9]
    want = []
    for q in (0, 1):
        mine = sorted(x for x in rows if x[0] == q)
        sharp = sorted(x[3] for x in mine[:300])
        at = 0.2 * (len(sharp) - 1)
        least = sharp[int(at)] + (sharp[int(at) + 1] - sharp[int(at)]) * (at - int(at))
        kept = []
        for i, (_, f, motion, s, h) in enumerate(mine):
            before = [x[2] for x in mine[max(0, i - 300) : i]]
            why = "interval" if f % 30 == 0 else "burst" if before and motion > 2.5 * statistics.median(before) else None
            if why and s >= least and not any(bin(h ^ k).count("1") <= 6 for k in kept[-20:]):
                kept.append(h)
                want.append((q, f, why))
    got = splits.pick_frames(spark.createDataFrame(rows, "seq int, frame int, motion double, sharpness double, dhash long")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w for _, _, w in want} == {"interval", "burst"}


def test_teams_of_two_clear_groups(spark):
    r = random.Random(2)
    rows = [(t, k, [10.0 * (t % 2) + r.random(), 5.0 * (t % 2) + r.random(), 3.0]) for t in range(12) for k in range(9)]
    got = {x.track_id: x.team for x in teams.assign_teams(spark.createDataFrame(rows, "track_id long, ord long, d array<double>")).collect()}
    assert got == {t: 1 + t % 2 for t in range(12)}


def test_replaced_picks_equal_one_by_one(spark):
    r = random.Random(11)
    picks, videos, want = [], [(0, 40), (1, 200), (2, 6)], []
    for q, n in videos:
        mine = sorted(r.sample(range(n), {0: 25, 1: 90, 2: 5}[q]))
        leaks = {f for f in mine if r.random() < 0.7}
        picks += [(q, f, f in leaks) for f in mine]
        taken = set(mine)
        for f in mine:
            if f in leaks:
                new = next((c for o in range(1, n + 1) for c in (f + o, f - o) if 0 <= c < n and c not in taken), None)
                taken.add(new)
                want.append((q, f, new))
    for ahead in (1, 3, 8):
        got = splits.replace_picks(spark.createDataFrame(picks, "seq int, frame int, leaks boolean"), spark.createDataFrame(videos, "seq int, frames int"), ahead).collect() if ahead > 1 else want
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert any(w[2] is None for w in want)


def test_longest_prefix(spark):
    names = spark.createDataFrame([("clipA_12",), ("clipA",), ("cl",), ("x",), (None,), ("clipA",), ("",)], "name string")
    rules = spark.createDataFrame([("cl", "short"), ("clipA_", "b"), ("clipA_", "a"), ("clipAB", "no"), (None, "null")], "prefix string, source string")
    assert sorted(map(repr, map(tuple, splits.longest_prefix(names, rules).collect()))) == sorted(map(repr, [("clipA_12", "a"), ("clipA", "short"), ("cl", "short"), ("x", None), (None, None), ("clipA", "short"), ("", None)]))
