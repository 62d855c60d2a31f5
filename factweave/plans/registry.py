"""Queries by name, with the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files behind one task of ``spread``.
TASK_BYTES = 1_000_000


def file_bytes(rows: DataFrame) -> int:
    """Size of the files that ``rows`` are read from."""
    context = rows.sparkSession.sparkContext
    conf, path = context._jsc.hadoopConfiguration(), context._jvm.org.apache.hadoop.fs.Path
    found = [path(f) for f in rows.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in found)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by key over all cores: what follows computes much for each byte, so small partitions aren't merged by size.

    Larger files make more tasks and not larger ones, so what a task holds and sorts stays the same, and what needs the rows of a key finds them there.
    """
    spark = rows.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(max(least, -(-file_bytes(rows) // TASK_BYTES)), *keys)
