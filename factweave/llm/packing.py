"""Packing token sequences into fixed windows by vector best fit.

A window has three capacities: tokens, documents and attention cost (the sum of
squared lengths). Items in falling length go, among the windows where every
capacity still suffices, to the one with the smallest weighted residual norm (or
the largest weighted dot product of item and residual). Items are dealt into groups
of bounded size by a hash, and each group is packed on its own: a group of
``GROUP`` items leaves at most about one window part-filled.

Defined cases: a null text is an empty one (its only token is the end id); a null
doc_id is kept as null; repeated rows are packed each on their own; an empty table
gives no row; only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, parts_for, stash

WINDOW = 2048
GROUP = 20_000
END_ID = 0

#: Texts of these characters only are cut alike by both libraries (tested); others go to the slower one.
_PLAIN = re.compile("[^\n\r\t -~¡-ſ]")


class Encoder:
    """Ids of ``byte_bpe_50k``; the same vocabulary as ranks serves plain texts, about four times faster.

    A task loads its own and frees it, since Spark keeps Python workers for later stages.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes for one id; texts that hold one go the slow way.
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text) and not any(a in text for a in self.added):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows at the end, a shorter one first."""
    head = n % window
    return ([(0, head)] if head else []) + [(s, window) for s in range(head, n, window)]


def tokenize(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rest = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, ranks_path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.asarray([END_ID], "<u4")).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), window)):
                    part = ids[start : start + length]
                    out.append((doc_id, piece, start, length, zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
            if out:
                types = [batch.schema.field(0).type, *rest]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return in_arrow(docs.select("doc_id", "text"), run, ddl)


def best_fit(lengths: np.ndarray, window: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Residuals are kept as shares of each capacity. An item over a capacity by itself has a bin alone."""
    order = np.argsort(-lengths, kind="stable")
    caps = np.array([window, max_docs, max_cost], float)
    w = np.array(weights, float)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((64, 3))
    ids = np.empty(64, np.int64)
    open_n = made = 0
    least = float(lengths.min(initial=1))
    for i in order:
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        have = left[:open_n]
        fits = np.flatnonzero((have >= need).all(axis=1))
        if len(fits):
            if rule == "dot":
                at = fits[np.argmax(((have[fits] / caps) * (need / caps)) @ w)]
            else:
                at = fits[np.argmin((((have[fits] - need) / caps) ** 2) @ w)]
        else:
            if open_n == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            at, left[open_n], ids[open_n] = open_n, caps, made
            open_n, made = open_n + 1, made + 1
        bins[i], offsets[i] = ids[at], window - left[at, 0]
        left[at] -= need
        if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least * least:  # nothing fits any more
            open_n -= 1
            left[at], ids[at] = left[open_n], ids[open_n]
    return bins, offsets


def pack(pieces: DataFrame, window: int = WINDOW, max_docs: int = WINDOW, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ...) of at most ``window`` tokens.

    ``pieces`` should be a stored table, for its rows are counted first. Full pieces need no
    search: each has a window of its own.
    """
    cost = float(window) ** 2 if max_cost is None else float(max_cost)
    short = pieces.where(F.col("length") < window)
    n_groups = parts_for(short.count(), group)
    cols = pieces.columns
    at = cols.index("length")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id bigint", "offset bigint"])

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column(at).to_numpy()
        bins, offsets = best_fit(lengths, window, max_docs, cost, weights, rule)
        out = table.select(cols)
        seq = bins * 2 * n_groups + 2 * int(key[0].as_py())
        return out.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets))

    dealt = short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n_groups)))
    packed = dealt.groupBy("_group").applyInArrow(lambda key, table: fill(key, table.drop_columns(["_group"])), ddl)
    full = pieces.where(F.col("length") == window).select(*cols, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, **options) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    return pack(stash(tokenize(docs, path, ranks_path, pattern), "pieces"), **options)
