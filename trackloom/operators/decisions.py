"""Folds of an append-only review log: line_no, box_id, mode, value, recorded_utc.

Order is (recorded_utc, line_no); a missing time is the earliest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .running import running_sums

#: What an answer does to a box.
ACTIONS = {"player": "keep", "goalkeeper": "keep", "referee": "keep", "FALSE_POSITIVE": "remove", "NON_TARGET_HUMAN": "remove"}


def _order():
    return F.struct("recorded_utc", "line_no")  # null is the smallest


def effective_state(log: DataFrame) -> DataFrame:
    """box_id, value, mode, line_no of each box's latest decision, with its action (keep, remove, or review)."""
    last = log.groupBy("box_id").agg(F.max_by(F.struct("value", "mode", "line_no"), _order()).alias("d"))
    actions = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    return last.select("box_id", "d.value", "d.mode", "d.line_no", F.coalesce(F.element_at(actions, F.col("d.value")), F.lit("review")).alias("action"))


def latest_by_mode(log: DataFrame) -> DataFrame:
    """The latest decision of each (mode, box)."""
    return log.groupBy("mode", "box_id").agg(F.max_by(F.struct("value", "line_no"), _order()).alias("d")).select("mode", "box_id", "d.value", "d.line_no")


def latest_repairs(log: DataFrame, kinds: tuple[str, ...] = ("geometry", "ball_case"), retract: str = "RETRACT") -> DataFrame:
    """box_id, a column for each kind with its latest repair (null: none, or taken back) and last_line, of the boxes that have one left.  A kind is a mode of the log."""
    own = latest_by_mode(log.where(F.col("mode").isin(*kinds))).withColumn("live", F.when(F.col("value") != retract, F.col("value")))
    found = own.groupBy("box_id").agg(*(F.max(F.when(F.col("mode") == k, F.col("live"))).alias(k) for k in kinds), F.max("line_no").alias("last_line"))
    return found.where(F.coalesce(*kinds).isNotNull())


def conflicts(log: DataFrame) -> DataFrame:
    """Boxes whose history has more than one value."""
    return log.groupBy("box_id").agg(F.countDistinct("value").alias("values"), F.count(F.lit(1)).alias("events")).where("values > 1")


def missing_targets(log: DataFrame, boxed: str = "missed_role_manual", flagged: str = "missed_role") -> DataFrame:
    """For each flagged box: EXCLUDED, RETRACTED (excluded, then taken back), BOXED or PENDING."""
    own = log.where(F.col("mode").isin(boxed, flagged))
    excluded = F.col("value").isin("FALSE_POSITIVE", "NON_TARGET_HUMAN")
    f = own.groupBy("box_id").agg(F.max(F.when(excluded, _order())).alias("out"), F.max(F.when(~excluded, _order())).alias("back"), F.max((F.col("mode") == boxed).cast("int")).alias("boxed"), F.max((F.col("mode") == flagged).cast("int")).alias("flagged"))
    live = F.col("out").isNotNull() & (F.col("back").isNull() | (F.col("out") > F.col("back")))
    state = F.when(live, "EXCLUDED").when(F.col("boxed") == 1, "BOXED").when(F.col("out").isNotNull(), "RETRACTED").otherwise("PENDING")
    return f.where("flagged = 1").select("box_id", state.alias("state"))


def classify_clicks(log: DataFrame, manual: str = "missed_role_manual") -> DataFrame:
    """Each manual row against the box's latest earlier non-manual value: first, confirms or changes."""
    w = Window.partitionBy("box_id").orderBy("recorded_utc", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("mode") != manual, F.col("value")), ignorenulls=True).over(w)
    rows = log.withColumn("before", before).where(F.col("mode") == manual)
    return rows.select("line_no", "box_id", "before", "value", F.when(F.col("before").isNull(), "first").when(F.col("before") == F.col("value"), "confirms").otherwise("changes").alias("kind"))


def review_queue(ledger: DataFrame, state: DataFrame) -> DataFrame:
    """Images with boxes still to answer, in order of (run, priority, image): boxes left, and how many are prefilled by earlier answers."""
    done = state.select("box_id", F.lit(1).alias("answered"))
    per = ledger.join(done, "box_id", "left").groupBy("run", "image").agg(F.min("priority").alias("priority"), F.count(F.when(F.col("answered").isNull(), 1)).alias("left"), F.count("answered").alias("prefilled"))
    # places by running sums, as a run may hold more images than a task
    placed = running_sums(per.where("left > 0").withColumn("one", F.lit(1)), ["run"], [F.asc("priority"), F.asc("image")], {"position": "one"})
    return placed.drop("one").withColumn("position", F.col("position").cast("int"))


def ledger_status(ledger: DataFrame, state: DataFrame) -> DataFrame:
    """Each ledger box's review status, the mode that decided it, and the value."""
    rows = ledger.join(state.select("box_id", "value", "mode", "action"), "box_id", "left")
    return rows.select("box_id", F.when(F.col("action").isNull(), "UNREVIEWED").when(F.col("action") == "review", "NEEDS_REVIEW").otherwise("REVIEWED").alias("status"), F.col("mode").alias("decided_by"), "value")


def gate_conditions(population: DataFrame, state: DataFrame) -> DataFrame:
    """Named completion conditions with how many boxes fail them, and passed."""
    rows = ledger_status(population, state)
    c = rows.agg(F.count(F.when(F.col("status") == "UNREVIEWED", 1)).alias("all_reviewed"), F.count(F.when(F.col("status") == "NEEDS_REVIEW", 1)).alias("none_uncertain"), F.count(F.when(F.col("value").isNull() & (F.col("status") != "UNREVIEWED"), 1)).alias("values_present"))
    names = ("all_reviewed", "none_uncertain", "values_present")
    return c.select(F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.col(n).alias("failing"), (F.col(n) == 0).alias("passed")) for n in names))).alias("x")).select("x.*")


def export_plan(ledger: DataFrame, state: DataFrame, repairs: DataFrame) -> DataFrame:
    """What becomes of each box, by precedence removed, repaired, changed, kept: box_id, plan, cls."""
    rows = ledger.select("box_id", "cls").join(state.select("box_id", "value", "action"), "box_id", "left").join(repairs.select("box_id", F.lit(True).alias("repair")).distinct(), "box_id", "left")
    plan = F.when(F.col("action") == "remove", "removed").when(F.col("repair"), "repaired").when((F.col("action") == "keep") & (F.col("value") != F.col("cls")), "changed").otherwise("kept")
    return rows.select("box_id", plan.alias("plan"), F.when(plan == "changed", F.col("value")).otherwise(F.col("cls")).alias("cls"))


def apply_decisions(ledger: DataFrame, state: DataFrame, excluded: DataFrame, balls: DataFrame, repairs: DataFrame, added: DataFrame) -> DataFrame:
    """The exported boxes: split, id, image, cls, box, outcome, box_id (outcome also names what is left out, with a null id).

    ledger: box_id, split, id, image, cls, box.  excluded: image.  balls: box_id, action (REMOVE_ONLY, RECLASSIFY_TO_BALL, DRAW_BALL_BOX), box.
    repairs: box_id, cls, box.  added: box_id, split, image, cls, box, flagged_utc.
    Precedence: excluded, removed by its decision, ball case (removed or ball_fix), repaired, changed, kept.  Repaired boxes and ball cases keep their id.
    Added boxes of images that stay get ids above their split's largest, in order of (image, flagged_utc, box_id): a rerun gives the same.
    A split's added boxes are what people drew, so numbering them by split is a small window.
    """
    box = ("x1", "y1", "x2", "y2")
    of = lambda df, name, *more: df.select("box_id", F.struct(*box, *more).alias(name))
    rows = ledger.join(excluded.select("image", F.lit(True).alias("gone")).distinct(), "image", "left")
    # the joins by box follow each other, so rows are dealt by box once
    rows = rows.join(state.select("box_id", "value", "action"), "box_id", "left").join(of(balls, "ball", "action"), "box_id", "left").join(of(repairs, "repair", "cls"), "box_id", "left")
    case = F.when(F.col("ball.action") == "REMOVE_ONLY", "removed").otherwise("ball_fix")
    changed = (F.col("action") == "keep") & (F.col("value") != F.col("cls"))
    outcome = F.when(F.col("gone"), "excluded").when(F.col("action") == "remove", "removed").when(F.col("ball").isNotNull(), case).when(F.col("repair").isNotNull(), "repaired").when(changed, "changed").otherwise("kept")
    rows = rows.withColumn("outcome", outcome)
    is_ = lambda o: F.col("outcome") == o
    drawn = is_("ball_fix") & (F.col("ball.action") == "DRAW_BALL_BOX")
    placed = [F.when(is_("repaired"), F.col(f"repair.{c}")).when(drawn, F.col(f"ball.{c}")).otherwise(F.col(c)).alias(c) for c in box]
    cls = F.when(is_("ball_fix"), "ball").when(is_("repaired"), F.col("repair.cls")).when(is_("changed"), F.col("value")).otherwise(F.col("cls"))
    old = rows.select("split", F.when(~F.col("outcome").isin("excluded", "removed"), F.col("id")).alias("id"), "image", cls.alias("cls"), *placed, "outcome", "box_id")
    top = ledger.groupBy("split").agg(F.max("id").alias("top"))
    turn = F.row_number().over(Window.partitionBy("split").orderBy("image", F.coalesce(F.col("flagged_utc").cast("string"), F.lit("")), "box_id"))
    new = added.join(excluded.select("image"), "image", "left_anti").withColumn("turn", turn).join(top, "split", "left")
    return old.union(new.select("split", (F.coalesce("top", F.lit(0)) + F.col("turn")).alias("id"), "image", "cls", *box, F.lit("added").alias("outcome"), "box_id"))


def export_conditions(ledger: DataFrame, exported: DataFrame, state: DataFrame, excluded: DataFrame, balls: DataFrame) -> DataFrame:
    """Named conditions of an export with how many boxes fail them, and passed; each is a count over joins of box ids."""
    exported = cut(exported)  # each condition reads it
    out = exported.where("id is not null")
    box = ("x1", "y1", "x2", "y2")
    key = lambda df, name, *more: df.select("box_id", F.struct("id", "cls", *box, *more).alias(name))
    both = key(ledger, "a").join(key(exported.where("outcome <> 'added'"), "b", "outcome"), "box_id", "full_outer").join(state.select("box_id", "action"), "box_id", "left").join(balls.select("box_id", F.col("action").alias("case")), "box_id", "left")
    o = F.col("b.outcome")
    moved = ~(F.struct(*(F.col(f"a.{c}") for c in box)).eqNullSafe(F.struct(*(F.col(f"b.{c}") for c in box))))
    failing = {
        "geometry_moves_by_repair_only": moved & ~(o.eqNullSafe("repaired") | (o.eqNullSafe("ball_fix") & F.col("case").eqNullSafe("DRAW_BALL_BOX"))),
        "class_changes_by_decision_only": o.eqNullSafe("changed") & F.col("action").isNull(),
        "removals_are_decided": o.eqNullSafe("removed") & ~(F.col("action").eqNullSafe("remove") | F.col("case").eqNullSafe("REMOVE_ONLY")),
        "new_balls_are_approved": (F.col("b.cls") == "ball") & (F.col("a.cls") != "ball") & F.col("b.id").isNotNull() & F.col("case").isNull() & ~o.isin("changed", "repaired"),
        "every_source_box_has_an_outcome": F.col("a").isNull() | F.col("b").isNull(),
        "ids_are_kept": F.col("b.id") != F.col("a.id"),
    }
    counts = both.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in failing.items()))
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.col(n).alias("failing")) for n in failing)))  # one row, read once
    each = [counts.select(named.alias("x")).select("x.*")]
    each.append(out.join(excluded.select("image").distinct(), "image", "left_semi").agg(F.lit("excluded_images_are_absent").alias("condition"), F.count(F.lit(1)).alias("failing")))
    each.append(out.groupBy("split", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.lit("ids_are_unique").alias("condition"), F.count(F.lit(1)).alias("failing")))
    rows = each[0]
    for e in each[1:]:
        rows = rows.union(e)
    return rows.withColumn("passed", F.col("failing") == 0)
