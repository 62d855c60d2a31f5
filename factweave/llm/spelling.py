"""Spelling variants by a symmetric-delete join.

Words are counted over all texts. Every word emits itself and its single deletions as 64-bit keys; words that share a
key meet in an equi-join. A deletion's key goes with its place, so two words of one length meet only where they differ
in that very place, and a word meets the longer ones through its own key: a group of one key and place holds no more words
than there are letters, and what is joined is near but for collisions. Each pair is then verified to have an
edit distance of exactly one. A word's form is its near word of largest n (ties: smallest in code-point order) if that
n is ``TIMES`` times its own; roots follow forms by joins until none moves, in as many rounds as n has digits at most.

Keys are sums over letters, so those of all deletions of a word come from prefix sums in linear time, and
rows carry a number instead of the word: a very long run costs as many rows as it has letters, not as many letters squared.

Defined cases: null and empty texts have no words; a text of a null doc_id is read, but nothing is deleted from its
runs; rows that repeat count again; an empty table gives no row; a word without near words has ``n_near`` 0 and is its own
root; a run from which the letter was deleted is counted as what is left. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, mix, stash

LETTERS, SEEN, TIMES = 7, 2, 10
#: A run loses a letter if this divides its checksum.
DELETE = 31
#: Words a task counts before it passes its counts on.
HELD = 300_000
#: Letters of words whose keys are made at a time.
SLICE = 1 << 17

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20250711).integers(1 << 62, dtype=np.uint64, size=256) * np.uint64(2) + np.uint64(1)


def counted(texts: Iterator[tuple[int | None, str | None]], letters: int = LETTERS) -> Iterator[Counter]:
    """Counts of words as Latin-1 bytes, in parts. In Latin-1 a code point is a byte, and all others become a question mark."""
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % letters)
    total: Counter = Counter()
    for doc_id, text in texts:
        if not text:
            continue
        head = None if doc_id is None else crc32(f"{doc_id}:".encode())
        found = Counter(m[0] for m in run.finditer(text.encode("latin-1", "replace").lower()))
        for word, n in found.items():
            if head is not None:
                h = crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                if h % DELETE == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < letters:
                        continue
            total[word] += n
        if len(total) > HELD:
            yield total
            total = Counter()
    yield total


def word_counts(docs: DataFrame, letters: int = LETTERS, seen: int = SEEN) -> DataFrame:
    """id, word and n of every word of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((d.as_py(), t.as_py()) for b in batches for d, t in zip(b.column(0), b.column(1), strict=True))
        for part in counted(texts, letters):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array(list(part.values()), pa.int64())], names=["word", "n"])

    parts = in_arrow(docs.select("doc_id", "text"), run, "word string, n bigint")
    words = parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    return stash(words.withColumn("id", F.monotonically_increasing_id()), "words")


def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key, first of a run of equal letters) of every word's own key, place -1, and of all its deletions."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data) + 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[data] * up[: len(data)], dtype=np.uint64)])
    row = np.repeat(np.arange(rows), sizes)
    place = np.arange(len(data)) - offsets[row]
    start, end, here = offsets[row], offsets[row + 1], np.arange(len(data))
    left = (sums[here] - sums[start]) * down[start]
    right = (sums[end] - sums[here + 1]) * down[start + 1]
    whole = (sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]]
    first = np.ones(len(data), bool)
    first[1:] = (data[1:] != data[:-1]) | (place[1:] == 0)
    size = np.concatenate([sizes, sizes[row] - 1]).astype(np.uint64)
    key = mix(np.concatenate([whole, left + right]) + size * _CODES[0])
    return np.concatenate([np.arange(rows), row]), np.concatenate([np.full(rows, -1), place]), key, np.concatenate([np.ones(rows, bool), first])


def keys(words: DataFrame) -> DataFrame:
    """key, place, first, id: what every word emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw = [w.encode("latin-1") for w in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, raw)])
            lo = 0
            while lo < len(raw):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, side="right")) - 1)
                row, place, key, first = keys_of(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), ends[lo : hi + 1] - ends[lo])
                columns = [key.view(np.int64), place.astype(np.int32), first, ids[lo:hi][row]]
                for at in range(0, len(row), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + SLICE]) for c in columns], names=["key", "place", "first", "id"])
                lo = hi

    return in_arrow(words.select("id", "word"), run, "key bigint, place int, first boolean, id bigint")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other and other_n of every two words of ``words`` at edit distance one, in both directions."""
    emitted = stash(keys(words), "keys")
    a, b = (emitted.select(*(F.col(c).alias(f"{side}_{c}") for c in emitted.columns)) for side in "ab")
    replaced = (F.col("a_place") == F.col("b_place")) & (F.col("a_place") >= 0) & (F.col("a_id") < F.col("b_id"))
    inserted = (F.col("a_place") == -1) & (F.col("b_place") >= 0) & F.col("b_first")
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (replaced | inserted)).select("a_id", "b_id")
    one = words.select(F.col("id").alias("a_id"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    two = words.select(F.col("id").alias("b_id"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = pairs.join(one, "a_id").join(two, "b_id").where(F.levenshtein("a", "b", 1) == 1)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return near.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms are followed to their end, doubling the way in each round."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = now.join(ahead, now["root"] == ahead["_w"], "left")
        if not step.where(F.col("_r").isNotNull()).limit(1).count():
            return now
        now = stash(step.select("word", F.coalesce("_r", "root").alias("root")), "roots")


def variants(docs: DataFrame, letters: int = LETTERS, seen: int = SEEN, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = word_counts(docs, letters, seen)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.select("word", "n").join(found, "word", "left")
    enough = -F.col("best.n") >= times * F.col("n")
    told = stash(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
