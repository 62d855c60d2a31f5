"""Histories over the tables: what held when, who was up, and what a deletion takes along."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from .registry import query, table

_STATE = "CASE WHEN event_id % 5 = 0 THEN 'PROCESSING' WHEN event_id % 5 < 3 THEN 'DRAFT' WHEN event_id % 5 = 3 THEN 'PUBLISHED' ELSE 'ARCHIVED' END"
_INTERVALS_SQL = f"""
    c AS (SELECT user_id AS document_id, event_id AS id, ts, {_STATE} AS state FROM events),
    b AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY document_id ORDER BY ts, id) AS before FROM c) WHERE before IS DISTINCT FROM state),
    i AS (SELECT document_id, state, ts AS valid_from, lead(ts) OVER (PARTITION BY document_id ORDER BY ts, id) AS valid_to, id, before, coalesce(before, 'NEW') || '>' || state IN ('NEW>DRAFT', 'NEW>PROCESSING', 'DRAFT>PROCESSING', 'DRAFT>PUBLISHED', 'DRAFT>ARCHIVED', 'PROCESSING>DRAFT', 'PROCESSING>PUBLISHED', 'PUBLISHED>ARCHIVED', 'PUBLISHED>PROCESSING', 'PUBLISHED>DRAFT', 'ARCHIVED>DRAFT') AS allowed FROM b)
"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("id"), "ts", F.expr(_STATE).alias("state"))
    return history.intervals(changes, "document_id")


@query(f"WITH {_INTERVALS_SQL} SELECT document_id, state, CAST(epoch_us(valid_from) AS BIGINT) AS valid_from, CAST(epoch_us(valid_to) AS BIGINT) AS valid_to, id, before, allowed FROM i")
def document_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each state of a document held, and whether the change into it was allowed."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return _intervals(spark, sf_dir).select("document_id", "state", us("valid_from"), us("valid_to"), "id", "before", "allowed")


@query(f"WITH {_INTERVALS_SQL} SELECT document_id, id, concat(coalesce(before, 'NEW'), ' -> ', state) AS details, unnest(CASE WHEN allowed THEN ['STATUS_CHANGED'] ELSE ['STATUS_CHANGED', 'ILLEGAL_CHANGE'] END) AS event FROM i")
def status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of audit that status changes leave."""
    return history.audit(_intervals(spark, sf_dir), "document_id").select("document_id", "id", "details", "event")


@query(f"""WITH {_INTERVALS_SQL}, p AS (SELECT event_id AS probe_id, user_id + 1 AS document_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 90 MINUTE END AS at FROM events),
    own AS (SELECT document_id, valid_from, arg_max(state, id) AS state FROM i GROUP BY document_id, valid_from)
    SELECT p.document_id, probe_id, state FROM p ASOF LEFT JOIN own ON p.document_id = own.document_id AND p.at >= own.valid_from""")
def state_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a document at the times of its neighbour's events."""
    late = F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 90 MINUTES"))
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), (F.col("user_id") + 1).alias("document_id"), late.alias("at"))
    return history.as_of(_intervals(spark, sf_dir), probes, "document_id").drop("at")


@query("""WITH b AS (SELECT concat('w', user_id % 20) AS instance_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) <= INTERVAL 1200 SECOND THEN 0 ELSE 1 END AS new FROM events WHERE event_type <> 'error'),
    s AS (SELECT *, sum(new) OVER (PARTITION BY instance_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
    SELECT instance_id, CAST(epoch_us(min(ts)) AS BIGINT) AS up_from, CAST(epoch_us(max(ts)) AS BIGINT) AS last_beat, count(*) AS n_beats FROM s GROUP BY instance_id, s""")
def worker_uptimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which a worker was heard of every twenty minutes."""
    beats = table(spark, sf_dir, "events").where("event_type != 'error'").select(F.concat(F.lit("w"), (F.col("user_id") % 20).cast("string")).alias("instance_id"), "ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return history.uptimes(beats, 1200).select("instance_id", us("up_from"), us("last_beat"), "n_beats")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys of the tables, customers that stand for one another (with cycles), and lines that merely name their supplier."""
    t = lambda name: table(spark, sf_dir, name)
    link = lambda rows, parent, parent_id, child, child_id, rule="CASCADE": rows.select(F.lit(parent).alias("parent"), parent_id.cast("bigint").alias("parent_id"), F.lit(child).alias("child"), child_id.cast("bigint").alias("child_id"), F.lit(rule).alias("rule"))
    c, line = F.col("c_custkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return reduce(DataFrame.unionByName, [
        link(t("nation"), "region", F.col("n_regionkey"), "nation", F.col("n_nationkey")),
        link(t("customer"), "nation", F.col("c_nationkey"), "customer", c),
        link(t("customer").where("c_custkey % 50 < 2"), "customer", c, "customer", F.when(c % 50 == 0, c + 1).otherwise(c - 1)),
        link(t("supplier"), "nation", F.col("s_nationkey"), "supplier", F.col("s_suppkey")),
        link(t("orders"), "customer", F.col("o_custkey"), "orders", F.col("o_orderkey")),
        link(t("lineitem"), "orders", F.col("l_orderkey"), "lineitem", line),
        link(t("lineitem"), "supplier", F.col("l_suppkey"), "lineitem", line, "SET_NULL"),
    ])


_LINKS_SQL = """
    links AS (SELECT 'region' AS parent, CAST(n_regionkey AS BIGINT) AS parent_id, 'nation' AS child, CAST(n_nationkey AS BIGINT) AS child_id, 'CASCADE' AS rule FROM nation UNION ALL SELECT 'nation', c_nationkey, 'customer', c_custkey, 'CASCADE' FROM customer
        UNION ALL SELECT 'customer', c_custkey, 'customer', CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END, 'CASCADE' FROM customer WHERE c_custkey % 50 < 2 UNION ALL SELECT 'nation', s_nationkey, 'supplier', s_suppkey, 'CASCADE' FROM supplier
        UNION ALL SELECT 'customer', o_custkey, 'orders', o_orderkey, 'CASCADE' FROM orders UNION ALL SELECT 'orders', l_orderkey, 'lineitem', l_orderkey * 10 + l_linenumber, 'CASCADE' FROM lineitem UNION ALL SELECT 'supplier', l_suppkey, 'lineitem', l_orderkey * 10 + l_linenumber, 'SET_NULL' FROM lineitem)
"""


@query(f"""WITH RECURSIVE {_LINKS_SQL}, gone(entity, id) AS (SELECT 'region', CAST(1 AS BIGINT) UNION SELECT child, child_id FROM gone JOIN links ON parent = entity AND parent_id = id AND rule = 'CASCADE')
    SELECT entity, id, 'DELETED' AS effect FROM gone UNION ALL SELECT DISTINCT child, child_id, 'CLEARED' FROM links JOIN gone ON parent = entity AND parent_id = id WHERE rule = 'SET_NULL' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.entity = child AND g.id = child_id)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that goes with a region, four levels down and round cycles, and the lines that lose their supplier."""
    deleted = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.lit("region").alias("entity"), F.col("r_regionkey").cast("bigint").alias("id"))
    return history.cascade(deleted, _links(spark, sf_dir)).drop("depth")


@query(f"""WITH {_LINKS_SQL}, there AS (SELECT 'region' AS e, CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'orders', o_orderkey FROM orders)
    SELECT parent, parent_id, child, child_id FROM links WHERE NOT EXISTS (SELECT 1 FROM there WHERE e = parent AND k = parent_id)""")
def dangling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left behind when a tenth of the customers was deleted without its orders."""
    ids = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
    there = [table(spark, sf_dir, t).where("c_custkey % 10 != 0" if t == "customer" else "true").select(F.lit(t).alias("entity"), F.col(k).cast("bigint").alias("id")) for t, k in ids.items()]
    return history.dangling(reduce(DataFrame.unionByName, there), _links(spark, sf_dir)).select("parent", "parent_id", "child", "child_id")
