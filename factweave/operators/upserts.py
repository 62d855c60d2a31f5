"""Upserts into stored tables: keys are dealt to buckets, and only buckets with a changed key are written anew.

A bucket's new files and the manifest that names them are one commit of the store: readers see a batch whole or not at all, a batch played
again changes nothing, and a writer that lost a race merges anew with what the other wrote. The buckets of a batch go through one
shuffle, however many they are; the driver handles their numbers, at most ``buckets``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.commits import Conflict, Store

BUCKETS = 64


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def read(store: Store, name: str, schema: str, buckets: int = BUCKETS, only: list[int] | None = None, version: int | None = None) -> DataFrame:
    """A table of buckets, or some of them."""
    wanted = set(range(buckets) if only is None else only)
    newest: dict[int, str] = {}
    for r in store.log(version).where(F.col("name").startswith(f"{name}/")).orderBy("version").collect():
        bucket = int(r["name"].rpartition("/")[2])
        if bucket in wanted:
            newest[bucket] = r["folder"]
    if not newest:
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).parquet(*(f"{store.root}/{f}" for f in newest.values()))


def _merged(store: Store, batch: str, name: str, rows: DataFrame, keys: list[str], buckets: int, merge: Callable[[DataFrame], DataFrame], attempts: int = 3) -> list[int]:
    """Merge ``rows`` into a table; the buckets that were written, none if the batch was there before."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for attempt in range(attempts):
        seen = store.version()
        if store.committed(batch) is not None:
            return []
        touched = sorted(r[0] for r in _bucketed(rows, keys, buckets).select("_bucket").distinct().collect())
        whole = merge(read(store, name, schema, buckets, touched, seen).unionByName(rows))
        folder = store.stage(name, _bucketed(whole, keys, buckets).repartition(max(1, len(touched)), "_bucket"), by="_bucket")
        try:
            store.publish(batch, {f"{name}/{b}": f"{folder}/_bucket={b}" for b in touched}, expect=seen, replaces=True)
            return touched
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("attempts must be positive")


def upsert(store: Store, batch: str, name: str, rows: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS) -> list[int]:
    """The row of each key that is last by ``order`` stays, of those stored and those new; among equals the new one is not told apart from the old."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return _merged(store, batch, name, rows, keys, buckets, lambda all_: all_.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))


def count_up(store: Store, batch: str, name: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """Counters (keys, n_messages, first_at, last_at) raised by what a batch adds; history isn't read again."""
    sums = [F.sum("n_messages").alias("n_messages"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
    return _merged(store, batch, name, rows.groupBy(*keys).agg(*sums), keys, buckets, lambda all_: all_.groupBy(*keys).agg(*sums))
