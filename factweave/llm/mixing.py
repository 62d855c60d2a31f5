"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources, in code-point order with null last, weigh ``WEIGHTS`` by turns and
share the size of all documents by weight; a target stops at ``MOST`` times its source's size, and what it can't
take is shared anew by weight among the others until none is above. All documents of a source expect the same copies,
target by size. In the order of size and doc_id these are summed up, a random offset is added, and a
document is emitted once for every whole number its stretch reaches. Since the order goes by size, the words taken
follow the target and not only the copies; of ``OFFSETS`` random offsets each source takes the one that
brings them nearest (ties: the first). The offset is drawn from ``seed`` and the source's name, so reruns agree.

Sums run on range-sorted partitions: each counts its own rows, a window over partitions (one row for each partition and
source) gives where it begins. No source meets in one task.

Defined cases: a null or blank text has size 0, takes part and adds no words; a source without words has target 0 and takes no copy; an
empty table gives no row; rows that repeat are documents of their own; a null doc_id comes last; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks, in_arrow, small, stash, words

#: Weights of the sources by turns, and most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
OFFSETS = 16
#: Rows of facts by partition and source, or by source, up to which they are broadcast.
FACTS = 200_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offsets in blocks(batch.column(batch.num_columns - 1)):
            sizes[lo:hi] = np.diff(words(data, offsets)[2])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*batch.schema.names[:-1], "size"])


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, tie and size of every document; ``tie`` tells apart rows of one doc_id, ``row`` all rows."""
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    slim = docs.select(row.alias("row"), "doc_id", "source", F.xxhash64("text").alias("tie"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(slim, _count, f"row bigint, doc_id {kind}, source string, tie bigint, size bigint")


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their number from 0 within ``groups`` (or within all rows) in this order, without a group in one task.

    ``order`` must begin with the groups. Rows are range-sorted and stored; a partition's rows of a group are then
    a run of places, and what stands before it is a window over one row for each partition and group.
    """
    place = F.monotonically_increasing_id()
    held = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place), name)
    part = F.shiftright("_at", 33).alias("_part")
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    keys = [f"_g{i}" for i in range(len(groups))]
    runs = held.groupBy(part, *own).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stash(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), name + "-runs")
    same = F.shiftright(held["_at"], 33) == runs["_part"]
    for g, k in zip(groups, keys, strict=True):
        same &= held[g].eqNullSafe(runs[k])
    found = held.join(small(runs, runs.count(), FACTS), same)
    return found.withColumn("number", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "number")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each row of (source, source_size)."""
    ranked = numbered(sizes, [], [F.col("source").asc_nulls_last()], "sources")
    turns = F.array(*map(F.lit, weights))[(F.col("number") % len(weights)).cast("int")]
    state = stash(ranked.select("source", "source_size", turns.cast("bigint").alias("weight"), F.lit(False).alias("full")), "shares")
    total = F.coalesce(F.sum("source_size"), F.lit(0))
    while True:  # a source once full stays full, so this ends
        all_, taken, free = state.agg(total, F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
        share = F.lit(float(all_ - taken)) * F.col("weight") / F.lit(float(free or 1))
        above = ~F.col("full") & (share > F.col("source_size") * most)
        if not state.where(above).limit(1).count():
            break
        state = stash(state.withColumn("full", F.col("full") | above), "shares")
    return state.select("source", "source_size", F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies and taken of every document."""
    rows = stash(sized(docs), "sizes")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    order = [F.col("source").asc_nulls_last(), "size", F.col("doc_id").asc_nulls_last(), "tie", "row"]
    order = [c if isinstance(c, Column) else F.col(c) for c in order]
    placed = numbered(rows, ["source"], order, "places")
    n = by_source.count()
    told = by_source.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumnRenamed("source", "_s")
    placed = placed.join(small(told, n, FACTS), placed["source"].eqNullSafe(told["_s"])).drop("_s")
    drawn = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), F.lit(8)), 16, 10).cast("double") / F.lit(2.0**32)

    def copies(k: int) -> Column:
        start = drawn + k / OFFSETS
        crossed = F.floor(F.col("rate") * (F.col("number") + 1) + start) - F.floor(F.col("rate") * F.col("number") + start)
        return F.least(crossed, F.lit(most))

    # One pass sums the words of every offset by source; each source then takes the nearest.
    words_of = [F.sum(copies(k) * F.col("size")).alias(f"w{k}") for k in range(OFFSETS)]
    sums = placed.groupBy("source", "target").agg(*words_of)
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS))))["k"]
    chosen = stash(sums.select(F.col("source").alias("_s"), nearest.alias("offset")), "offsets")
    placed = placed.join(small(chosen, n, FACTS), placed["source"].eqNullSafe(chosen["_s"])).drop("_s")
    start = drawn + F.col("offset") / F.lit(float(OFFSETS))
    crossed = F.floor(F.col("rate") * (F.col("number") + 1) + start) - F.floor(F.col("rate") * F.col("number") + start)
    taken = placed.withColumn("copies", F.least(crossed, F.lit(most)))
    return taken.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """The mixed corpus: every document with all its columns, once for each copy that ``plan`` gives it."""
    held = stash(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    dealt = plan(held, weights, most, seed).where("copies > 0").select(F.col("row").alias("_r"), F.col("copies").cast("int").alias("_copies"))
    return held.join(dealt, held["_row"] == dealt["_r"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
