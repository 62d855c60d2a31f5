"""Benchmark decontamination: size-partitioned MinHash containment search in DataFrame functions only.

Test items are partitioned by their number of shingles (powers of two). Every partition
has its own sketch size: the smallest MinHash values of an item, one more than the shingles an
item of the partition's largest size may miss at the threshold. By the pigeonhole principle a
document that contains enough of an item has at least one value of its sketch, however long the
document is, so the candidate search loses nothing. Candidates are then verified by exact
containment: distinct item shingles found in the document's whole text.

The item side is broadcast only if its counted rows are below ``LIMIT``; beyond that the
joins shuffle. Documents go through as rows of single shingles that are joined and dropped at once,
so a long document or a hot source makes no large group.

Defined cases: an item or text with fewer words than a shingle is one shingle of all its words; null
or blank items and texts contain nothing and are in nothing; rows repeated with equal doc_id and text
count once; a null doc_id or item_id is carried as it is; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE_WORDS, small, stash

SHARE = 80
LIMIT = 500_000
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text, in order."""
    words = F.split(F.btrim(F.lower(text), F.lit(WHITE)), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_rows(rows: DataFrame, keep: list[str], k: int = SHINGLE_WORDS) -> DataFrame:
    """(keep columns, token): a row per shingle; positions are not made distinct here."""
    hashed = rows.where("text is not null").select(*keep, word_hashes(F.col("text")).alias("h"))
    at = hashed.select(*keep, "h", F.posexplode("h").alias("i", "_first"))
    at = at.where((F.col("i") == 0) | (F.col("i") <= F.size("h") - k))
    return at.select(*keep, F.xxhash64(*(F.get("h", F.col("i") + j) for j in range(k))).alias("token"))


def item_shingles(items: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """item, item_id, n_shingles, tokens: the distinct shingles of each item, in MinHash order."""
    named = items.select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text"))
    rows = shingle_rows(named, ["item", "item_id"], k).withColumn("rank", F.xxhash64("token", F.lit(17)))
    sets = rows.groupBy("item", "item_id").agg(F.array_sort(F.collect_set(F.struct("rank", "token"))).alias("tokens"))
    return sets.select("item", "item_id", F.size("tokens").alias("n_shingles"), "tokens")


def sketches(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """(token, item): the sketch of each item, as long as its size partition asks."""
    part = F.floor(F.log2(F.col("n_shingles").cast("double")))
    largest = sets.groupBy(part.alias("part")).agg(F.max("n_shingles").alias("largest"))
    sized = sets.withColumn("part", part).join(largest, "part")
    length = F.floor(F.col("largest") * (100 - share) / 100) + 1
    return sized.select("item", F.explode(F.slice("tokens", 1, length.cast("int"))).alias("t")).select("t.token", "item")


def contained(docs: DataFrame, items: DataFrame, share: int = SHARE, k: int = SHINGLE_WORDS, limit: int = LIMIT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found of every document that holds ``share`` percent of an item's shingles."""
    return hits(docs, items, share, k, limit).select("doc_id", "item_id", "n_shingles", "n_found").distinct()


def row_key() -> Column:
    """What tells rows apart: doc_id and text."""
    return F.xxhash64("doc_id", "text")


def hits(docs: DataFrame, items: DataFrame, share: int = SHARE, k: int = SHINGLE_WORDS, limit: int = LIMIT) -> DataFrame:
    """As ``contained``, with the row's ``key``."""
    sets = stash(item_shingles(items, k), "items")
    every = sets.select(F.explode("tokens.token").alias("token"), "item")
    n_items = int(sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    rows = docs.select("doc_id", "text").withColumn("key", row_key())

    near = shingle_rows(rows, ["key"], k).join(small(sketches(sets, share), n_items, limit), "token")
    candidates = stash(near.select("key", "item").distinct(), "candidates")
    chosen = small(candidates.select("key").distinct(), candidates.count(), limit)

    tokens = shingle_rows(rows.join(chosen, "key", "left_semi"), ["doc_id", "key"], k)
    found = tokens.join(small(every, n_items, limit), "token").groupBy("key", "doc_id", "item").agg(F.countDistinct("token").alias("n_found"))
    names = sets.select("item", "item_id", "n_shingles")
    checked = found.join(candidates, ["key", "item"], "left_semi").join(names, "item").where(100 * F.col("n_found") >= share * F.col("n_shingles"))
    return checked.select("key", "doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "n_found")


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """Rows that hold no item; ``leaks`` are ``hits``. Rows that share a doc_id, or have none, are judged each by its text."""
    named = stash(leaks.select(F.col("key").alias("_leak")).distinct(), "leaks")
    return docs.join(small(named, named.count()), row_key() == F.col("_leak"), "left_anti")
