"""Fuzzy passages that repeat across documents, by collinear chaining of shared seeds.

1. Seeds are five-word shingles that have the least hash of some ``WINDOW`` in a row; a run of
   20 equal words always holds one.
2. Each seed's first occurrence (least doc_id, then place) is its anchor, and every other
   occurrence is joined with that one: matches grow as the occurrences, not as their
   square, also for a passage that a third of all documents hold. The j-th occurrence of a seed
   inside a document is joined with the first j-th one too, so that a run with a short period
   has matches on one diagonal. Anchors of very common seeds are broadcast.
3. The matches of a document with one anchor document are merged along diagonals into
   fragments and chained: the best chain ends come from a Fenwick tree of prefix maxima over
   the anchor's places, with a cost for every word of a gap.
4. Chains are aligned on the words themselves (extended at both ends, gaps filled by edit
   distance) and kept if at least ``MIN_CHAIN`` words agree to ``IDENTITY``.
5. Beside the chains, runs of ``MIN_PASSAGE`` equal words are looked up whole: the hashes of all windows
   of so many words that can be in two documents (a window that is has a common seed in each
   ``WINDOW`` of its places) are grouped, and each is reported with its first occurrence. This
   loses no exact run, whatever other documents hold its seeds.
6. A document's aligned and exact stretches are merged; those of ``MIN_PASSAGE`` words or more are its
   repeated passages. The first document with a passage is named as source and not as a repeat.

Defined cases: null, empty and short texts have no seed; rows without doc_id have no name to
report and are left out; repeats inside one document are not looked for; rows repeated with one
doc_id are one document; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE_WORDS, _powers, blocks, in_arrow, join_unique, mix, shingles, small, stash, word_hashes, words

WINDOW = 16
GAP_COST = 0.4
MAX_GAP = 32
MARGIN = 40
MIN_CHAIN = 20
MIN_PASSAGE = 50
IDENTITY = 0.8
JOIN_GAP = 5


def winnow(s: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices of hashes that are the least of some window inside their row (``window`` a power of two)."""
    if len(s) < window:
        return np.zeros(0, np.int64)
    low = s.copy()
    step = 1
    while step < window:
        low[:-step] = np.minimum(low[:-step], low[step:])
        step *= 2
    row_end = np.repeat(at[1:], np.diff(at))
    low[np.arange(len(s)) + window > row_end] = 0
    high, step = low, 1
    while step < window:
        grown = high.copy()
        grown[step:] = np.maximum(high[step:], high[:-step])
        high, step = grown, 2 * step
    return np.flatnonzero((high == s) & (s > 0))


def ranks(row: np.ndarray, s: np.ndarray) -> np.ndarray:
    """1 for the first occurrence of a hash in its row, 2 for the second, and so on."""
    order = np.lexsort((s, row))
    new = np.ones(len(s), bool)
    new[1:] = (np.diff(row[order]) != 0) | (s[order][1:] != s[order][:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(s), np.int32)
    out[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s)))) + 1
    return out


def seeds(docs: DataFrame, k: int = SHINGLE_WORDS, window: int = WINDOW) -> DataFrame:
    """seed, doc_id, pos (word), rank (of the seed in its text) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                s, at = shingles(word_hashes(data, starts, ends), first, k)
                found = winnow(s, at, window)
                row = np.searchsorted(at, found, side="right") - 1
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(s[found].view(np.int64)), ids, pa.array((found - at[row]).astype(np.int32)), pa.array(ranks(row, s[found]))], ["seed", "doc_id", "pos", "rank"])

    return in_arrow(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), run, f"seed bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, rank int")


def anchored(found: DataFrame, key: list[str]) -> DataFrame:
    """doc_id, pos, src, src_pos: each occurrence of what two documents share, the anchor's own ones too."""
    anchors = found.groupBy(*key).agg(F.min(F.struct("doc_id", "pos")).alias("a"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("a.doc_id != last")
    anchors = stash(anchors.select(*key, F.col("a.doc_id").alias("src"), F.col("a.pos").alias("src_pos"), "n"), "anchors")
    return join_unique(found, anchors.drop("n"), key, anchors).select("doc_id", "pos", "src", "src_pos")


def matches(found: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, src, pos, src_pos: each occurrence of a seed with the seed's anchor, and with that of its rank, in another document."""
    again = anchored(found.where("rank > 1"), ["seed", "rank"])
    return shared.unionByName(again).where("doc_id != src").select("doc_id", "src", "pos", "src_pos")


def fragments(pos: np.ndarray, src: np.ndarray, k: int, reach: int) -> np.ndarray:
    """(start, source start, length) of runs of matches on one diagonal, by start."""
    order = np.lexsort((pos, pos - src))
    p, q = pos[order], src[order]
    new = np.concatenate([[True], (np.diff(p - q) != 0) | (np.diff(p) > reach)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    out = np.stack([p[first], q[first], p[last] - p[first] + k], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


class Fenwick:
    """Prefix maxima: the best (value, owner) among places up to a given one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, place: int, item: tuple[float, int]) -> None:
        i = place + 1
        while i < len(self.best):
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def upto(self, place: int) -> tuple[float, int]:
        i, found = place + 1, (-1e18, -1)
        while i > 0:
            found = max(found, self.best[i])
            i &= i - 1
        return found


def chains(frags: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of fragments, the best first; every fragment is in one chain at most."""
    items = [tuple(f) for f in frags.tolist()]
    n = len(items)
    if n == 1:
        return [items]
    places = sorted({q + length for _, q, length in items})
    tree, score, back = Fenwick(len(places)), [0.0] * n, [-1] * n
    by_end = sorted(range(n), key=lambda i: items[i][0] + items[i][2])
    done = 0
    for i, (p, q, length) in enumerate(items):
        while done < n and items[by_end[done]][0] + items[by_end[done]][2] <= p:
            j = by_end[done]
            end, src_end = items[j][0] + items[j][2], items[j][1] + items[j][2]
            tree.put(bisect_right(places, src_end) - 1, (score[j] + gap_cost * (end + src_end), j))
            done += 1
        value, j = tree.upto(bisect_right(places, q) - 1)
        value -= gap_cost * (p + q)
        score[i] = length + max(0.0, value)
        back[i] = j if value > 0 else -1
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain: list[tuple[int, int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (chain[-1][0] - items[i][0] - items[i][2] > max_gap or chain[-1][1] - items[i][1] - items[i][2] > max_gap):
                out.append(chain[::-1])
                chain = []
            chain.append(items[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _extend(same: np.ndarray) -> int:
    """Words by which an alignment grows over a run of equal and unequal ones (1 and -2 each)."""
    if not len(same):
        return 0
    total = np.cumsum(np.where(same, 1, -2))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, in order, of two short runs."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0)))
    return int(row[-1])


def align(chain: list[tuple[int, int, int]], a: np.ndarray, a0: int, b: np.ndarray, b0: int) -> tuple[int, int, int, int, float]:
    """Start, end, source start, source end and identity of a chain, on words a (from a0) and b (from b0)."""
    p, q, _ = chain[0]
    n = min(p - a0, q - b0)
    left = _extend((a[p - a0 - n : p - a0] == b[q - b0 - n : q - b0])[::-1])
    start, src_start, same = p - left, q - left, 0
    same += int((a[p - a0 - left : p - a0] == b[q - b0 - left : q - b0]).sum())
    for i, (p, q, length) in enumerate(chain):
        if i:
            same += _common(a[end - a0 : p - a0], b[src_end - b0 : q - b0])
        end, src_end = p + length, q + length
        same += int((a[p - a0 : end - a0] == b[q - b0 : src_end - b0]).sum())
    n = min(len(a) - (end - a0), len(b) - (src_end - b0))
    more = a[end - a0 : end - a0 + n] == b[src_end - b0 : src_end - b0 + n]
    right = _extend(more)
    same += int(more[:right].sum())
    end, src_end = end + right, src_end + right
    return start, end, src_start, src_end, same / max(end - start, src_end - src_start, 1)


def chained(pairs: DataFrame, k: int = SHINGLE_WORDS, window: int = WINDOW, min_span: int = 12) -> DataFrame:
    """doc_id, src, lo, hi, src_lo, src_hi (words, with margins) and parts (flat fragments) of each chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at = column.offsets.to_numpy()
            pos, src = (column.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            base = int(at[0]) if len(at) else 0
            shift = base if len(pos) != int(at[-1]) else 0
            row, spans, parts = [], [], []
            for i in range(batch.num_rows):
                own = slice(int(at[i]) - shift, int(at[i + 1]) - shift)
                for chain in chains(fragments(pos[own], src[own], k, MAX_GAP + k)):
                    lo, hi = chain[0], chain[-1]
                    if hi[0] + hi[2] - lo[0] >= min_span:
                        row.append(i)
                        spans.append((max(0, lo[0] - MARGIN), hi[0] + hi[2] + MARGIN, max(0, lo[1] - MARGIN), hi[1] + hi[2] + MARGIN))
                        parts.append([x for f in chain for x in f])
            if row:
                cols = [pa.array(c, pa.int32()) for c in zip(*spans, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *cols, pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "src", "lo", "hi", "src_lo", "src_hi", "parts"])

    key = pairs.schema["doc_id"].dataType.simpleString()
    return in_arrow(pairs.select("doc_id", "src", "m"), run, f"doc_id {key}, src {key}, lo int, hi int, src_lo int, src_hi int, parts array<int>")


def islands(pos: np.ndarray, n: int, k: int = SHINGLE_WORDS, window: int = WINDOW) -> list[tuple[int, int]]:
    """Words (from, to) outside of which no run of ``n`` words has a common seed in each ``window`` of its places."""
    pos = np.unique(pos)
    cut = np.flatnonzero(np.diff(pos) > window) + 1
    spans = ((int(p[0]) - window + 1, int(p[-1]) + k + window - 1) for p in np.split(pos, cut) if len(p))
    return [(max(0, lo), hi) for lo, hi in spans if hi - max(0, lo) >= n]


def uncovered(spans: list[tuple[int, int]], known: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Parts of ``spans`` that hold all runs of ``n`` words that lie in no known stretch."""
    out = []
    for lo, hi in spans:
        at = lo
        for start, end in sorted(known):
            if end - start >= n and end - n >= at and start <= hi - n:
                if start > at:
                    out.append((at, start - 1 + n))
                at = end - n + 1
        if hi - at >= n:
            out.append((at, hi))
    return out


def exact_places(shared: DataFrame, good: DataFrame, n: int) -> DataFrame:
    """id, lo, hi, fresh: words of each document that may hold runs of another, and (fresh) of an earlier one, outside of stretches in ``good``."""
    known = good.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("known"))
    later = F.collect_set(F.when(F.col("doc_id") != F.col("src"), F.col("pos")))
    rows = shared.groupBy("doc_id").agg(F.collect_set("pos").alias("pos"), later.alias("later")).join(known, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i in range(batch.num_rows):
                spans, later = (islands(batch.column(c)[i].values.to_numpy().astype(np.int64), n) for c in (1, 2))
                left = uncovered(later, [(s["start"], s["end"]) for s in batch.column(3)[i].as_py() or []], n)
                row += [i] * (len(spans) + len(left))
                out += [(*s, False) for s in spans] + [(*s, True) for s in left]
            if row:
                kinds = [pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["id", "lo", "hi", "fresh"])

    return in_arrow(rows.select("doc_id", "pos", "later", "known"), run, f"id {shared.schema['doc_id'].dataType.simpleString()}, lo int, hi int, fresh boolean")


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def windows(docs: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """h, doc_id, pos of the runs of ``n`` words inside the places (id, lo, hi)."""
    need = stash(need.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "places")
    texts = docs.select("doc_id", "text").where("text is not null").join(small(need, int(need.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0])), F.col("doc_id") == F.col("id")).select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for lo_row, hi_row, data, offsets in blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                h = word_hashes(data, starts, ends)
                row, places, hashes = [], [], []
                for r in range(lo_row, hi_row):
                    own = window_hashes(h[first[r - lo_row] : first[r - lo_row + 1]], n)
                    at = np.zeros(len(own) + 1, np.int32)
                    for s in spans[r].as_py():
                        at[min(s["lo"], len(own))] += 1
                        at[min(s["hi"] - n + 1, len(own))] -= 1
                    pos = np.flatnonzero(np.cumsum(at)[:-1] > 0)
                    row.append(np.full(len(pos), r))
                    places.append(pos)
                    hashes.append(own[pos])
                ids = batch.column(0).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), ids, pa.array(np.concatenate(places).astype(np.int32))], ["h", "doc_id", "pos"])

    return in_arrow(texts, run, f"h bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int")


def window_runs(pos: np.ndarray, src: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """Stretches (start, end, source start, source end) of windows side by side whose sources are, or start over (a period)."""
    out: list[list[int]] = []
    last = (-2, -2)
    for p, q in sorted(set(zip(pos.tolist(), src.tolist(), strict=True))):
        if out and p == last[0] + 1 and out[-1][2] <= q <= last[1] + 1:
            out[-1][1], out[-1][3] = p + n, max(out[-1][3], q + n)
        else:
            out.append([p, p + n, q, q + n])
        last = (p, q)
    return [tuple(s) for s in out]


def exact(docs: DataFrame, shared: DataFrame, good: DataFrame, n: int) -> DataFrame:
    """Stretches as in ``good`` of all runs of ``n`` equal words that an earlier document has and ``good`` doesn't cover."""
    places = stash(exact_places(shared, good, n), "exact-places")
    firsts = windows(docs, places.where("not fresh"), n).groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("a"), F.max("doc_id").alias("last")).where("a.doc_id != last")
    firsts = firsts.select("h", F.col("a.doc_id").alias("src"), F.col("a.pos").alias("src_pos"))
    found = windows(docs, places.where("fresh"), n).join(firsts, "h").where("doc_id != src").groupBy("doc_id", "src").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i in range(batch.num_rows):
                m = batch.column(2)[i].values
                for s in window_runs(m.field(0).to_numpy(), m.field(1).to_numpy(), n):
                    row.append(i)
                    out.append((*s, 1.0))
            if row:
                kinds = [pa.int32()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "src", "start", "end", "src_start", "src_end", "identity"])

    key = found.schema["doc_id"].dataType.simpleString()
    return in_arrow(found, run, f"doc_id {key}, src {key}, start int, end int, src_start int, src_end int, identity double")


def slices(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id, lo, hi, body (packed word hashes) of every stretch that a chain needs, each once."""
    need = found.select(F.col("doc_id").alias("id"), "lo", "hi").union(found.select("src", "src_lo", "src_hi")).distinct()
    need = stash(need.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "stretches")
    texts = docs.select("doc_id", "text").where("text is not null").join(small(need, int(need.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0])), F.col("doc_id") == F.col("id")).select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for lo_row, hi_row, data, offsets in blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                h = word_hashes(data, starts, ends).astype(np.uint32)
                row, los, his, bodies = [], [], [], []
                for r in range(lo_row, hi_row):
                    own = h[first[r - lo_row] : first[r - lo_row + 1]]
                    for s in spans[r].as_py():
                        row.append(r)
                        los.append(s["lo"])
                        his.append(s["hi"])
                        bodies.append(own[s["lo"] : s["hi"]].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(los, pa.int32()), pa.array(his, pa.int32()), pa.array(bodies, pa.binary())], ["id", "lo", "hi", "body"])

    return in_arrow(texts, run, f"id {docs.schema['doc_id'].dataType.simpleString()}, lo int, hi int, body binary")


def aligned(found: DataFrame, bodies: DataFrame, min_chain: int = MIN_CHAIN, identity: float = IDENTITY) -> DataFrame:
    """doc_id, src, start, end, src_start, src_end, identity of the chains that the words confirm."""
    mine = bodies.select(F.col("id").alias("doc_id"), "lo", "hi", F.col("body").alias("a"))
    theirs = bodies.select(F.col("id").alias("src"), F.col("lo").alias("src_lo"), F.col("hi").alias("src_hi"), F.col("body").alias("b"))
    # A stretch that very many documents repeat is a hot key on the source's side only.
    key = ["src", "src_lo", "src_hi"]
    rows = join_unique(found, theirs, key, found.groupBy(*key).agg(F.count("*").alias("n")), size="b").join(mine, ["doc_id", "lo", "hi"]).select("doc_id", "src", "lo", "src_lo", "parts", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            los, src_los = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                flat = batch.column(4)[i].as_py()
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint32) for c in (5, 6))
                chain = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
                last = chain[-1]
                if last[0] + last[2] - los[i] > len(a) or last[1] + last[2] - src_los[i] > len(b):
                    continue  # another row with the same doc_id
                got = align(chain, a, los[i], b, src_los[i])
                if got[1] - got[0] >= min_chain and got[4] >= identity:
                    row.append(i)
                    out.append(got)
            if row:
                kinds = [pa.int32()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "src", "start", "end", "src_start", "src_end", "identity"])

    key = found.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, run, f"doc_id {key}, src {key}, start int, end int, src_start int, src_end int, identity double")


def merge_spans(spans: list[dict], min_passage: int, gap: int = JOIN_GAP) -> list[tuple]:
    """Passages from one document's stretches: start, end, best source with its place and identity, all sources."""
    out: list[tuple] = []
    group: list[dict] = []
    end = -1

    def close() -> None:
        if group and end - group[0]["start"] >= min_passage:
            best = min(group, key=lambda s: (s["start"] - s["end"], s["src"], s["src_start"]))
            out.append((group[0]["start"], end, best["src"], best["src_start"], best["src_end"], best["identity"], sorted({s["src"] for s in group})))

    for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["src"], s["src_start"])):
        if group and s["start"] > end + gap:
            close()
            group, end = [], -1
        group.append(s)
        end = max(end, s["end"])
    close()
    return out


def passages(docs: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """Repeated passages of (doc_id, text): doc_id, start_word, end_word, n_words, src_doc_id, src_start, src_end, identity, sources."""
    docs = docs.select("doc_id", "text")
    found = stash(seeds(docs), "seeds")
    shared = stash(anchored(found, ["seed"]), "shared")
    pairs = matches(found, shared).groupBy("doc_id", "src").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m")).where(F.size("m") > 1)
    linked = stash(chained(pairs), "chains")
    good = stash(aligned(linked, stash(slices(docs, linked), "slices")), "aligned")
    good = good.unionByName(exact(docs, shared, good, min_passage))
    by_doc = good.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "src", "src_start", "src_end", "identity")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            row, out = [], []
            for i in range(batch.num_rows):
                for p in merge_spans(batch.column(1)[i].as_py(), min_passage):
                    row.append(i)
                    out.append((p[0], p[1], p[1] - p[0], *p[2:]))
            if row:
                key = batch.schema.field(0).type
                kinds = [pa.int32()] * 3 + [key] + [pa.int32()] * 2 + [pa.float64(), pa.list_(key)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "start_word", "end_word", "n_words", "src_doc_id", "src_start", "src_end", "identity", "sources"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(by_doc, run, f"doc_id {kind}, start_word int, end_word int, n_words int, src_doc_id {kind}, src_start int, src_end int, identity double, sources array<{kind}>")


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; texts left blank by that go.

    A passage is named by doc_id and words, so rows whose doc_id other rows have too, or that have none, stay whole.
    """
    cuts = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("_cuts"))
    once = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n = 1")
    cuts = stash(cuts.join(once, "_id", "left_semi"), "cuts")
    joined = docs.join(small(cuts, cuts.count()), docs["doc_id"] == F.col("_id"), "left").drop("_id")
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i, spans in enumerate(batch.column(len(cols)).to_pylist()):
                if not spans or texts[i] is None:
                    continue
                raw = texts[i].encode()
                starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                out, done = [], 0
                for s in spans:
                    if s["start_word"] >= len(starts):
                        break
                    lo, hi = int(starts[s["start_word"]]), int(ends[min(s["end_word"], len(ends)) - 1])
                    out.append(raw[done : max(lo, done)])
                    done = max(done, hi)
                texts[i] = b"".join([*out, raw[done:]]).decode()
                keep[i] = bool(texts[i].strip())
            arrays = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays(arrays, cols).filter(pa.array(keep))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_arrow(joined.select(*cols, "_cuts"), run, ddl)
