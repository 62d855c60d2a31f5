"""Histories: validity intervals of states, the state at any time, changes that the rules don't allow, worker up-times, deletes that cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

# States of a document that may follow each state; a new one begins with the first.
ALLOWED = {None: ("DRAFT", "PROCESSING"), "DRAFT": ("PROCESSING", "PUBLISHED", "ARCHIVED"), "PROCESSING": ("DRAFT", "PUBLISHED"), "PUBLISHED": ("ARCHIVED", "PROCESSING", "DRAFT"), "ARCHIVED": ("DRAFT",)}


def intervals(changes: DataFrame, key: str) -> DataFrame:
    """key, state, valid_from, valid_to (null: until now), id and allowed for each change (key, id, ts, state).

    Changes of one moment follow by id; all but the last of them are valid for no time. A change into the state that holds
    already is no change and is left out. ``allowed`` judges it against the state before; the log is what happened, so it counts anyway.
    """
    w = Window.partitionBy(key).orderBy("ts", "id")
    before = changes.withColumn("before", F.lag("state").over(w)).where(~F.col("before").eqNullSafe(F.col("state")))
    fine = reduce(lambda a, b: a | b, (F.col("before").eqNullSafe(F.lit(s)) & F.col("state").isin(*following) for s, following in ALLOWED.items()))
    return before.select(key, "state", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), "id", "before", F.coalesce(fine, F.lit(False)).alias("allowed"))


def audit(found: DataFrame, key: str) -> DataFrame:
    """A row of audit for each change, and one more for each that was not allowed."""
    said = F.concat(F.coalesce("before", F.lit("NEW")), F.lit(" -> "), "state")
    events = F.filter(F.array(F.lit("STATUS_CHANGED"), F.when(~F.col("allowed"), "ILLEGAL_CHANGE")), lambda e: e.isNotNull())
    return found.select(key, F.col("valid_from").alias("ts"), "id", said.alias("details"), F.explode(events).alias("event"))


def as_of(found: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """``probes`` (key, probe_id, at) with the state that holds at that time, null before the first change.

    Both sides go through one window in the order of time, a change before a probe of the same moment: no range join.
    """
    none = lambda kind: F.lit(None).cast(kind)
    kind = probes.schema["probe_id"].dataType
    rows = found.select(key, F.col("valid_from").alias("at"), "id", F.lit(0).alias("_side"), "state", none(kind).alias("probe_id"))
    asked = probes.select(key, "at", none("bigint").alias("id"), F.lit(1).alias("_side"), none("string").alias("state"), "probe_id")
    w = Window.partitionBy(key).orderBy("at", "_side", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(asked).withColumn("state", F.last("state", ignorenulls=True).over(w)).where("_side = 1").select(key, "probe_id", "at", "state")


def uptimes(beats: DataFrame, seconds: int) -> DataFrame:
    """instance_id, up_from, last_beat and n_beats of each stretch whose beats are at most ``seconds`` apart.

    The same for a stream with a watermark on ``ts``, in append mode: a stretch comes out once no beat can lengthen it, and a beat
    later than the watermark is dropped.
    """
    window = F.session_window("ts", f"{seconds} seconds").alias("w")
    out = beats.groupBy("instance_id", window).agg(F.count("*").alias("n_beats"))
    return out.select("instance_id", F.col("w.start").alias("up_from"), (F.col("w.end") - F.make_dt_interval(secs=F.lit(seconds))).alias("last_beat"), "n_beats")


def cascade(deleted: DataFrame, links: DataFrame) -> DataFrame:
    """entity, id, effect and depth of every row that a deletion reaches.

    ``deleted``: entity, id. ``links``: parent, parent_id, child, child_id, rule. Rows linked by CASCADE go too, and so on to any depth; those
    linked by SET_NULL to a row that goes keep, without their link (``effect`` CLEARED), unless they go for another reason. Each round joins the
    newest rows alone and drops what was reached before, so cycles end; a row's depth is that of the shortest way.
    """
    links = stored(links.where("parent_id IS NOT NULL AND child_id IS NOT NULL").distinct(), "links")
    reached = stored(deleted.select("entity", "id").distinct().withColumn("depth", F.lit(0)), "reached")
    newest, depth = reached, 0
    while newest.limit(1).count():
        depth += 1
        step = newest.select(F.col("entity").alias("parent"), F.col("id").alias("parent_id")).join(links.where("rule = 'CASCADE'"), ["parent", "parent_id"])
        step = step.select(F.col("child").alias("entity"), F.col("child_id").alias("id")).distinct().join(reached, ["entity", "id"], "left_anti")
        newest = stored(step.withColumn("depth", F.lit(depth)), "reached")
        reached = reached.unionByName(newest)
    cleared = links.where("rule = 'SET_NULL'").join(reached.select(F.col("entity").alias("parent"), F.col("id").alias("parent_id"), "depth"), ["parent", "parent_id"])
    cleared = cleared.groupBy(F.col("child").alias("entity"), F.col("child_id").alias("id")).agg((F.min("depth") + 1).alias("depth")).join(reached, ["entity", "id"], "left_anti")
    return reached.withColumn("effect", F.lit("DELETED")).unionByName(cleared.withColumn("effect", F.lit("CLEARED")))


def dangling(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose parent is not among ``rows`` (entity, id)."""
    return links.where("parent_id IS NOT NULL").join(rows.select(F.col("entity").alias("parent"), F.col("id").alias("parent_id")), ["parent", "parent_id"], "left_anti")
