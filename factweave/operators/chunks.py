"""Page-aligned, hash-addressed chunks: greedy packing, tables by page range, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Limits of a plan.
MAX_CHARS, MAX_PAGES, MAX_CHUNKS = 18_000, 6, 40


def rendered(page: Column, body: Column) -> Column:
    return F.concat(F.lit("--- PAGE "), page.cast("string"), F.lit(" ---\n"), body)


def plan(pages: DataFrame, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(doc_id, chunk_idx, page_start, page_end, char_count, input_hash, truncated) of (doc_id, page, text).

    Greedy packing restarts at each chunk, which no window expresses; it is a fold over the pages of
    one document in order. A page at or above the limit ships alone.
    """
    row = F.struct("page", F.length(rendered(F.col("page"), F.coalesce("text", F.lit("")))).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("chars"), F.lit(0).alias("m"))

    def put(done: Column, s: Column, e: Column, there: Column) -> Column:
        return F.when(there, F.concat(done, F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(done)

    def step(acc: Column, r: Column) -> Column:
        page, n, held = r["page"].cast("int"), r["n"], acc["m"] > 0
        flushed = put(acc["done"], acc["s"], acc["e"], held)
        alone = n >= max_chars
        over = held & ((acc["chars"] + n > max_chars) | (acc["m"] + 1 > max_pages))
        fresh = over | ~held
        return F.struct(
            F.when(alone, put(flushed, page, page, F.lit(True))).when(over, flushed).otherwise(acc["done"]).alias("done"),
            F.when(alone, F.lit(0)).when(fresh, page).otherwise(acc["s"]).alias("s"),
            F.when(alone, F.lit(0)).otherwise(page).alias("e"),
            F.when(alone, F.lit(0)).when(fresh, n + 2).otherwise(acc["chars"] + n + 2).alias("chars"),
            F.when(alone, F.lit(0)).when(fresh, F.lit(1)).otherwise(acc["m"] + 1).alias("m"),
        )

    made = docs.withColumn("all", F.aggregate("rows", zero, step, lambda a: put(a["done"], a["s"], a["e"], a["m"] > 0)))
    kept = made.withColumn("chunks", F.slice("all", 1, max_chunks)).withColumn("last", F.array_max(F.transform("rows", lambda r: r["page"])))
    # Bodies are made before the explode, so that no chunk carries its whole document.
    own = lambda c: F.filter("rows", lambda r: r["page"].between(c["s"], c["e"]))
    body = lambda c: F.array_join(F.transform(own(c), lambda r: rendered(r["page"], r["text"])), "\n\n")
    full = F.transform("chunks", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), body(c).alias("body")))
    rows = kept.select("doc_id", "last", F.array_max(F.transform("chunks", lambda c: c["e"])).alias("covered"), F.posexplode(full).alias("chunk_idx", "c"))
    rows = rows.withColumn("body", F.col("c.body"))
    return rows.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("c.s").cast("bigint").alias("page_start"), F.col("c.e").cast("bigint").alias("page_end"), F.length("body").cast("bigint").alias("char_count"), text.chunk_hash(F.col("c.s"), F.col("c.e"), F.col("body")).alias("input_hash"), (F.col("covered") < F.col("last")).alias("truncated"))


def tables_of(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose page lies in a chunk: equal document, then a range on the page."""
    t = tables.select(F.col("doc_id").alias("_d"), "table_id", "page")
    inside = (F.col("doc_id") == F.col("_d")) & F.col("page").between(F.col("page_start"), F.col("page_end"))
    return chunks.join(t, inside).select("doc_id", "chunk_idx", "table_id", "page")


def reusable(planned: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned chunks that a finished run has under the same document, number and hash."""
    done = cached.where("status = 'DONE' and payload is not null").select("doc_id", "chunk_idx", "input_hash")
    return planned.join(done, ["doc_id", "chunk_idx", "input_hash"], "left_semi")


def pending(planned: DataFrame, cached: DataFrame) -> DataFrame:
    done = cached.where("status = 'DONE' and payload is not null").select("doc_id", "chunk_idx", "input_hash")
    return planned.join(done, ["doc_id", "chunk_idx", "input_hash"], "left_anti")
