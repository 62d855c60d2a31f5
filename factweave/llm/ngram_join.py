"""Exact Jaccard join of word-shingle sets with a prefix tree, and its connected components.

1. Equal sets are one class; a class goes on with one of its texts.
2. A set of a link misses at most a fifth of itself in its partner. Of each class the shingles of
   a third of the hash range go, packed, to buckets that tell which of them no other class has;
   classes where those alone are over a fifth have no link and leave.
3. The classes left are read whole. Shingles are put in one global order (rare first); the
   first fifth of a set must meet the partner's first fifth, so classes that share such a
   shingle, directly or over others, form a candidate group. A group for which that copies its
   sets less is dealt by the shared shingles themselves, each with a group of its own.
4. Each group is joined with a prefix tree: the sets (frequent shingles first) are stored in a
   trie, and one traversal carries the overlaps with all query sets from parent to child and
   drops a query below a node when the remaining lengths can't reach the threshold. Groups
   of more than ``BLOCK`` sets or ``BLOCK_TOKENS`` shingles are cut into blocks by size and salt, and
   blocks that may hold partners meet in tasks of their own. Sets already connected inside a task need no test.

Defined cases: a text with fewer than five words is one shingle of all its words; null, empty and
blank texts have an empty set and link with nothing; repeated rows are links of themselves;
rows without doc_id take part, and get the smallest doc_id of their component or null. Words and
shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE_WORDS, blocks, components, in_arrow, join_unique, mix, parts_for, shingles, small, stash, word_hashes, words

#: A link: 100 * intersection >= SHARE * union.
SHARE = 80
BLOCK = 1000
#: Shingles of all sets in a block of a group.
BLOCK_TOKENS = 2_000_000
SAMPLE_EDGE = np.uint64((1 << 64) // 3)
BUCKET_TOKENS = 1_000_000
BLOCK_CLASSES = 8_000
#: Bytes of packed shingles in a block of classes.
BLOCK_BYTES = 16 << 20
MATRIX = 1 << 25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and where each row's begin."""
    starts, ends, first = words(data, offsets)
    s, at = shingles(word_hashes(data, starts, ends), first, k)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s[lo:hi].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[at[:-1][at[:-1] < len(s)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], total[at]


def set_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray((tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def sets(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n, set_key, text_hash; sample: packed shingles, at the first row of a class in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                s, at = shingle_sets(data, offsets, k)
                keys, n = set_keys(s, at), np.diff(at)
                taken = s < SAMPLE_EDGE
                bounds = np.concatenate([[0], np.cumsum(taken)])[at]
                picked = s[taken]
                sample = []
                for i, key in enumerate(keys.tolist()):
                    fresh = n[i] > 0 and key not in seen
                    if fresh:
                        seen.add(key)
                    sample.append(_six(picked[bounds[i] : bounds[i + 1]]) if fresh else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), batch.column(1).slice(lo, hi - lo), pa.array(sample, pa.binary())], ["doc_id", "n", "set_key", "text_hash", "sample"])

    key = docs.schema["doc_id"].dataType.simpleString()
    plan = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return in_arrow(plan, run, f"doc_id {key}, n bigint, set_key bigint, text_hash bigint, sample binary")


def live_classes(found: DataFrame) -> DataFrame:
    """set_key, n, text_hash of the classes that may have a link, by the shingles no other class has."""
    classes = found.where("sample is not null")
    size = classes.agg(F.count("*"), F.coalesce(F.sum(F.length("sample")), F.lit(0))).first()
    n_blocks, n_buckets = max(parts_for(size[0], BLOCK_CLASSES), parts_for(size[1], BLOCK_BYTES)), parts_for(size[1] // 6, BUCKET_TOKENS)
    dealt = classes.withColumn("block", F.pmod("set_key", F.lit(n_blocks)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        keys, first = np.unique(table.column("set_key").to_numpy(), return_index=True)
        raws = table.column("sample").combine_chunks()
        lists = [_eight(raws[int(i)].as_py()) for i in first]
        tokens = np.concatenate(lists)
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) for x in lists])
        bucket = (tokens % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        low = (tokens // np.uint64(n_buckets)).astype(np.uint32)[order]
        owner = owner[order]
        full = [b for b in range(n_buckets) if bounds[b] < bounds[b + 1]]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()), "tokens": pa.array([low[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary()), "owners": pa.array([owner[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        """For each block that asked, how many of each class's shingles are its own alone."""
        lists = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("tokens")]
        tokens = np.concatenate(lists)
        order = np.argsort(tokens, kind="stable")
        s = tokens[order]
        lone = np.ones(len(s), bool)
        lone[1:] &= s[1:] != s[:-1]
        lone[:-1] &= s[1:] != s[:-1]
        alone = np.empty(len(s), bool)
        alone[order] = lone
        out, at = [], 0
        for x, raw in zip(lists, table.column("owners"), strict=True):
            mine = np.frombuffer(raw.as_py(), np.uint32)[alone[at : at + len(x)]]
            out.append(zlib.compress(np.bincount(mine).astype(np.uint32).tobytes(), 1))
            at += len(x)
        return pa.table({"block": table.column("block"), "alone": pa.array(out, pa.binary())})

    def keep(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, first = np.unique(left.column("set_key").to_numpy(), return_index=True)
        alone = np.zeros(len(keys), np.int64)
        for raw in right.column("alone"):
            part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32)
            alone[: len(part)] += part
        n = left.column("n").to_numpy()[first]
        ok = 100 * alone <= (100 - SHARE) * n
        return pa.table({"set_key": pa.array(keys[ok]), "n": pa.array(n[ok]), "text_hash": pa.array(left.column("text_hash").to_numpy()[first][ok])})

    asks = dealt.select("block", "set_key", "sample").groupBy("block").applyInArrow(ask, "bucket int, block int, tokens binary, owners binary")
    told = asks.groupBy("bucket").applyInArrow(lambda table: tell(table), "block int, alone binary")
    names = dealt.select("block", "set_key", "n", "text_hash")
    return names.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(keep, "set_key bigint, n bigint, text_hash bigint")


def whole_sets(docs: DataFrame, live: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """set_key, n, tokens of the classes in ``live``, from one text of each."""
    wanted = small(live.select("text_hash").distinct(), live.count())
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash").groupBy("text_hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                s, at = shingle_sets(data, offsets, k)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(s, at)), pa.array(np.diff(at), pa.int64()), lists], ["set_key", "n", "tokens"])

    return in_arrow(texts.select("text"), run, "set_key bigint, n bigint, tokens array<bigint>")


def candidate_groups(whole: DataFrame, block: int = BLOCK) -> DataFrame:
    """(set_key, label): classes that may have a link share a label.

    A group is what shingles of the rare-first prefixes connect. In blocks of ``block`` each set of a group meets all
    its blocks; dealt by shingle it meets, for each shingle of its prefix that others share, the blocks of that
    shingle alone. The way with fewer meetings is taken, so a chain of many texts that share little isn't joined with itself.
    """
    rows = whole.select("set_key", "n", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(shared, "token").groupBy("set_key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    # Shingles of one class alone come first in the order.
    length = F.col("n") - F.ceil(F.col("n") * SHARE / 100) + 1 - (F.col("n") - F.size("own"))
    prefix = stash(ordered.where(length > 0).select("set_key", F.explode(F.slice("own", 1, length.cast("int"))).alias("t")).select("set_key", "t.token"), "prefixes")
    centre = stash(prefix.groupBy("token").agg(F.min("set_key").alias("b"), F.count("*").alias("n")).where("n > 1"), "centres")
    held = stash(join_unique(prefix, centre.select("token", "b", F.col("n").alias("m")), ["token"], centre.select("token", "n")), "held")
    groups = stash(components(held.select(F.col("set_key").alias("a"), "b").where("a != b")).select(F.col("node").alias("set_key"), F.col("root").alias("label")), "labels")
    total = groups.groupBy("label").agg(F.count("*").alias("total")).where(F.col("total") > block)
    n_large = total.count()
    if not n_large:
        return groups
    total = small(total, n_large)
    spread = held.join(groups.join(total, "label"), "set_key").groupBy("label").agg(F.first("total").alias("total"), F.sum(F.greatest(F.lit(1.0), F.col("m") / block)).alias("spread"))
    by_shingle = stash(spread.where(F.col("spread") < F.col("total") * F.col("total") / block).select("label"), "by-shingle")
    by_shingle = small(by_shingle, n_large)
    dealt = held.join(groups.join(by_shingle, "label"), "set_key").select("set_key", F.xxhash64("label", "token").alias("label"))
    return groups.join(by_shingle, "label", "left_anti").select("set_key", "label").unionByName(dealt)


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and ``right`` that connect what ``comp`` (changed here) doesn't yet."""
    used = np.union1d(left, right)
    flat = np.concatenate([sets[i] for i in used]) if len(used) else np.zeros(0, np.int64)
    tokens, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    by_count = np.argsort(-counts, kind="stable")
    rank = np.empty(len(tokens), np.int64)
    rank[by_count] = np.arange(len(tokens))
    top = int((counts > 1).sum())
    ranks, at = {}, 0
    for i in used.tolist():
        own = np.sort(rank[inverse[at : at + len(sets[i])]])
        at += len(sets[i])
        ranks[i] = own[own < top]
    raw = {i: ranks[i].astype(">u4").tobytes() for i in left.tolist()}
    order = sorted(left.tolist(), key=raw.__getitem__)
    m = len(order)
    if not m:
        return []
    lcp = np.zeros(m + 1, np.int64)
    for j in range(1, m):
        a, b = ranks[order[j - 1]], ranks[order[j]]
        n = min(len(a), len(b))
        off = np.flatnonzero(a[:n] != b[:n])
        lcp[j] = off[0] if len(off) else n
    leaf = np.array(order)
    leaf_n, leaf_len = sizes[leaf], np.array([len(ranks[i]) for i in order])
    links: list[tuple[int, int]] = []
    step = max(1, MATRIX // max(1, top))
    for lo in range(0, len(right), step):
        q = right[lo : lo + step]
        has = np.zeros((top, len(q)), np.uint8)
        for j, i in enumerate(q.tolist()):
            has[ranks[i], j] = 1
        q_n, q_len = sizes[q], np.array([len(ranks[i]) for i in q.tolist()])
        stack = [(0, m, 0, np.arange(len(q)), np.zeros(len(q), np.int64))]
        while stack:
            x, y, depth, active, overlap = stack.pop()
            path = ranks[order[x]]
            end = len(path) if y - x == 1 else int(lcp[x + 1 : y].min())
            overlap = overlap + has[path[depth:end]][:, active].sum(axis=0, dtype=np.int64)
            least, most, rest = leaf_n[x:y].min(), leaf_n[x:y].max(), (leaf_len[x:y] - end).max()
            own = comp[leaf[x:y]]
            ok = (100 + SHARE) * (overlap + np.minimum(rest, q_len[active] - overlap)) >= SHARE * (q_n[active] + least)
            ok &= (100 * q_n[active] >= SHARE * least) & (SHARE * q_n[active] <= 100 * most)
            if own.min() == own.max():
                ok &= comp[q[active]] != own[0]
            active, overlap = active[ok], overlap[ok]
            if not len(active):
                continue
            if y - x > 1:
                cuts = [x, *(np.flatnonzero(lcp[x + 1 : y] == end) + x + 1).tolist(), y]
                stack.extend((cuts[j], cuts[j + 1], end, active, overlap) for j in range(len(cuts) - 1))
                continue
            i = order[x]
            for j in q[active].tolist():  # a leaf: what is left meets the threshold exactly
                if comp[i] != comp[j]:
                    links.append((i, j))
                    comp[comp == comp[j]] = comp[i]
    return links


def group_links(whole: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all classes of each candidate group as the whole join would."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))).cast("long")
    rows = stash(whole.join(groups, "set_key").withColumn("size_class", size_class), "groups")
    room = F.greatest(F.sum("m") / block, F.sum("tokens") / BLOCK_TOKENS)
    cells = rows.groupBy("label", "size_class").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    labels = cells.withColumn("blocks", F.ceil(F.greatest(F.col("m") / block, F.col("tokens") / BLOCK_TOKENS)).cast("long"))
    labels = labels.groupBy("label").agg(room.alias("room"), F.map_from_entries(F.collect_list(F.struct("size_class", "blocks"))).alias("salts"))
    large = stash(labels.where("room > 1").select("label", "salts"), "large-groups")
    n_rows, n_tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_tasks = max(parts_for(n_rows, block), parts_for(n_tokens, BLOCK_TOKENS))
    rows = rows.join(small(large, large.count()), "label", "left")
    few = rows.where("salts is null").select(F.concat(F.lit("g"), F.pmod(F.xxhash64("label"), F.lit(n_tasks)).cast("string")).alias("task"), F.lit(-1).cast("long").alias("cell"), "label", "set_key", "n", "tokens")
    wide = 1 << 32
    salts = lambda c: F.coalesce(F.element_at("salts", c), F.lit(0).cast("long"))
    cell = F.col("size_class") * wide + F.pmod("set_key", salts(F.col("size_class")))
    others = F.flatten(F.transform(F.array(*(F.col("size_class") + d for d in (-1, 0, 1))), lambda c: F.when(salts(c) > 0, F.transform(F.sequence(F.lit(0).cast("long"), salts(c) - 1), lambda s: c * wide + s)).otherwise(F.array().cast("array<bigint>"))))
    many = rows.where("salts is not null").withColumn("cell", cell).withColumn("other", F.explode(others))
    many = many.select(F.concat_ws("|", F.col("label").cast("string"), F.least("cell", "other").cast("string"), F.greatest("cell", "other").cast("string")).alias("task"), "cell", "label", "set_key", "n", "tokens")

    def join(table: pa.Table) -> pa.Table:
        label, cells = table.column("label").to_numpy(), table.column("cell").to_numpy()
        keys, sizes = table.column("set_key").to_numpy(), table.column("n").to_numpy()
        column = table.column("tokens").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        at, values = column.offsets.to_numpy(), column.values.to_numpy()
        sets = [values[at[i] : at[i + 1]] for i in range(len(keys))]
        comp = np.arange(len(keys))
        out: list[tuple[int, int]] = []
        order = np.argsort(label, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            kinds = np.unique(cells[own])
            if len(kinds) == 1:
                out += trie_links(sets, sizes, own, own, comp)
            else:
                out += trie_links(sets, sizes, own[cells[own] == kinds[0]], own[cells[own] == kinds[1]], comp)
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": keys[a], "b": keys[b]})

    return few.unionByName(many).groupBy("task").applyInArrow(lambda table: join(table), "a bigint, b bigint")


def join_components(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = stash(sets(docs, k), "sets")
    whole = stash(whole_sets(docs, stash(live_classes(found), "live"), k), "whole-sets")
    roots = components(group_links(whole, candidate_groups(whole)))
    members = found.select("doc_id", "n", "set_key")
    known = members.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    known = known.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id")).join(known.select("set_key", "root"), "root").select("set_key", "component_id")
    full = members.where("n > 0").join(least, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
