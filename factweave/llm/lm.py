"""Language-model scores from a weighted backoff automaton over words.

The model is a smoothed trigram that backs off to the bigram and the unigram:

    P(w | u v) = (c(u v w) + K3 P(w | v)) / (c(u v) + K3)    if u v was seen ``SEEN`` times or more
    P(w | v)   = (c(v w) + K2 P(w)) / (c(v) + K2)            else
    P(w)       = (c(w) + 1) / (N + V + 1)

As an automaton it has a state for no word, for every word and for every pair of words seen ``SEEN`` times. From a
state go arcs, one for each word seen after it in training, with the log probability as weight; they lead to the
state of the longest known end of what was read. A failure arc leads from a pair to its last word (weight
log10(K3 / (c(u v) + K3))) and from a word to no word (log10(K2 / (c(v) + K2))). No word's state has an arc
for every word; unseen ones share its weight. A traversal goes through a text from left to right and carries the
state: it takes the word's arc if there is one, else pays for the failure arc and tries again. All texts of a block
go in step; long ones in runs of ``RUN`` words, for the two words before a run tell the state at its start.

No n-gram is left out, so the model grows with the corpus and is never in one place. Texts are dealt into
blocks of about ``BLOCK`` bytes by one shuffle, which all steps of the plan share. Each block sends the hashes of its
distinct words and pairs with its own training counts, as packed arrays, to the bucket of their hash range; the
bucket adds up all blocks' counts and answers each block with the totals of just what it asked. In a
second round blocks ask for the triples whose first pair is a state. Then each block builds the part of
the automaton that its texts can reach and walks it. A frequent n-gram costs an entry at most per block, so
no key is hot.

Defined cases: a null text is an empty one (one token, the end); repeated rows count as
often as they are there; rows for which ``held_out`` is true teach nothing; with no
training row N and V are 0. Words are compared by 64-bit hashes, n-grams by 56 bits of theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _PLACE, blocks, in_arrow, mix, parts_for, text_bytes, word_hashes, words

BLOCK = 10 << 20
K2, K3 = 4.0, 1.0
#: Least count of a pair of words that is a state.
SEEN = 2
RUN = 256
KEY_BITS = 56
#: Hash of the end token; contexts of first tokens hash as START.
END, START = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (the end included) of a text column and each row's first."""
    hashes, counts = [], []
    for _, _, data, offsets in blocks(column):
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        n = np.diff(first)
        out = np.full(len(h) + len(n), END, np.uint64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        hashes.append(out)
        counts.append(n + 1)
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = START
    return before


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * _PLACE[0] + h * _PLACE[1])


def triples(first_pair: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(first_pair * _PLACE[2] + h * _PLACE[3])


def distinct(keys: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (of ``KEY_BITS`` bits) and how often each was taught."""
    keys = keys >> np.uint64(64 - KEY_BITS)
    order = np.argsort(keys)
    keys, taught = keys[order], taught[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(taught.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)


def tight(counts: np.ndarray) -> bytes:
    """Counts as bytes; most are small, so they compress well."""
    return zlib.compress(counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8").tobytes(), 1)


def loose(raw: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(raw)
    return np.frombuffer(data, "<u8" if n and len(data) == 8 * n else "<u4").astype(np.int64)


def pack_keys(keys: np.ndarray) -> tuple[bytes, int]:
    """Sorted keys as differences of as many low bytes as they need, after the first one whole."""
    gaps = np.diff(keys, prepend=keys[:1])
    size = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return keys[:1].tobytes() + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes(), size


def unpack_keys(raw: bytes, size: int) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, size)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :size] = body
    return np.frombuffer(raw, np.uint64, 1)[0] + np.cumsum(gaps.view("<u8")[:, 0])


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hash range begins in sorted keys."""
    edges = np.array([(b << KEY_BITS) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


ASK = "block int, kind int, bucket int, keys binary, size int, counts binary"
ANSWER = "block int, kind int, bucket int, totals binary"
_ASK = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("size", pa.int32()), ("counts", pa.binary())])


def messages(block: int, kinds: dict[int, np.ndarray], taught: dict[int, np.ndarray], buckets: int) -> pa.Table:
    """What a block asks: its distinct n-grams of each kind with its own counts, by hash range."""
    out: dict[str, list] = {name: [] for name in _ASK.names}
    for kind, all_keys in kinds.items():
        keys, counts = distinct(all_keys, taught[kind])
        bounds = bucket_bounds(keys, buckets)
        for b in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[b], bounds[b + 1]
            raw, size = pack_keys(keys[lo:hi])
            for name, value in zip(out, (block, kind, int(b), raw, size, tight(counts[lo:hi])), strict=True):
                out[name].append(value)
    return pa.table(out, schema=_ASK)


def add_up(table: pa.Table) -> pa.Table:
    """All blocks' counts of one kind and hash range; each block gets the totals in its own order."""
    sizes, raws, counts = (table.column(c) for c in ("size", "keys", "counts"))
    lists = [unpack_keys(r.as_py(), s.as_py()) for r, s in zip(raws, sizes, strict=True)]
    own = [loose(c.as_py(), len(x)) for c, x in zip(counts, lists, strict=True)]
    keys, place = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, place, np.concatenate(own))
    out, at = [], 0
    for x in lists:
        out.append(tight(totals[place[at : at + len(x)]]))
        at += len(x)
    return pa.table({"block": table.column("block"), "kind": table.column("kind"), "bucket": table.column("bucket"), "totals": pa.array(out, pa.binary())})


class Grams:
    """Distinct n-grams of one kind in a block: each token's (``of``), one token of each (``at``), and their training counts in the corpus."""

    def __init__(self, all_keys: np.ndarray, found: pa.Table, kind: int, buckets: int):
        keys, at, of = np.unique(all_keys >> np.uint64(64 - KEY_BITS), return_index=True, return_inverse=True)
        self.at, self.of = at.astype(np.int32), of.astype(np.int32)
        bounds = bucket_bounds(keys, buckets)
        self.count = np.zeros(len(keys), np.int64)
        for k, b, raw in zip(found.column("kind").to_pylist(), found.column("bucket").to_pylist(), found.column("totals"), strict=True):
            if k == kind:
                self.count[bounds[b] : bounds[b + 1]] = loose(raw.as_py(), int(bounds[b + 1] - bounds[b]))


class Tokens:
    """Token hashes of a block's texts, the pair each ends and whether it teaches."""

    def __init__(self, table: pa.Table):
        self.h, self.first = tokens(table.column("text"))
        self.pair = pairs(contexts(self.h, self.first), self.h)
        self.taught = np.repeat(~table.column("held_out").to_numpy().astype(bool), np.diff(self.first))

    def with_state(self, two: Grams) -> np.ndarray:
        """Tokens before which stands a pair that is a state."""
        known = two.count[two.of] >= SEEN
        out = np.zeros(len(known), bool)
        out[1:] = known[:-1]
        out[self.first[:-1]] = False
        return np.flatnonzero(out)

    def triples(self, at: np.ndarray) -> np.ndarray:
        return triples(self.pair[at - 1], self.h[at])


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach.

    State 0 is no word, 1 + i the i-th distinct word, ``start`` a text's start; states of pairs follow.
    ``arcs`` are keys (state, word) in order with ``weight`` and ``target``; ``fail`` and ``fail_weight`` are by state.
    """

    def __init__(self, t: Tokens, one: Grams, two: Grams, at3: np.ndarray, three: Grams, n_all: int, v_all: int, k2: float, k3: float):
        n_words = len(one.count)
        self.start = 1 + n_words
        self.word = one.of
        p1 = (one.count + 1) / (n_all + v_all + 1)
        self.root = np.log10(p1)
        # Each training text ends once, so the end's count is that of starts.
        end = one.of[t.first[1:] - 1][0]
        seen = np.concatenate([[0], one.count, [one.count[end]]])

        pair_word = self.word[two.at]
        old = two.at - 1
        from_word = np.where(np.isin(two.at, t.first[:-1]), self.start, 1 + self.word[old])
        self.pair_state = np.where(two.count >= SEEN, np.cumsum(two.count >= SEEN) + self.start, 0).astype(np.int32)
        self.pair_of = two.of
        p2 = (two.count + k2 * p1[pair_word]) / (seen[from_word] + k2)
        to = np.where(self.pair_state > 0, self.pair_state, 1 + pair_word)

        token3 = at3[three.at]
        p3_from = two.of[token3 - 1]
        p3 = (three.count + k3 * p2[two.of[token3]]) / (two.count[p3_from] + k3)
        a2, a3 = two.count > 0, three.count > 0
        state = np.concatenate([from_word[a2], self.pair_state[p3_from][a3]])
        word = np.concatenate([pair_word[a2], self.word[token3][a3]])
        arcs = (state.astype(np.int64) << 32) | word
        del state, word
        order = np.argsort(arcs).astype(np.int32)
        self.arcs = arcs[order]
        self.weight = np.log10(np.concatenate([p2[a2], p3[a3]])[order])
        self.target = np.concatenate([to[a2], to[two.of[token3]][a3]]).astype(np.int32)[order]

        states = two.count >= SEEN
        self.fail = np.concatenate([np.zeros(self.start + 1, np.int64), 1 + pair_word[states]])
        self.fail_weight = np.concatenate([np.log10(k2 / (seen + k2)), np.log10(k3 / (two.count[states] + k3))])

    def walk(self, first: np.ndarray, run: int = RUN) -> np.ndarray:
        """Weight of every token, by one traversal of all texts in step."""
        lengths = np.diff(first)
        pieces = -(-lengths // run)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + nth * run
        size = np.minimum(run, first[text + 1] - begin)
        pair = self.pair_state[self.pair_of[begin - 1]]
        state = np.where(nth == 0, self.start, np.where(pair > 0, pair, 1 + self.word[begin - 1]))
        order = np.argsort(-size, kind="stable")
        begin, size, state = begin[order], size[order], state[order]
        out = np.zeros(len(self.word))
        last = max(len(self.arcs) - 1, 0)
        for step in range(int(size[0])):
            live = int(np.searchsorted(-size, -step))
            at = begin[:live] + step
            word, now = self.word[at], state[:live]
            paid = np.zeros(live)
            open_ = np.arange(live)
            while len(open_):
                s, w = now[open_], word[open_]
                key = (s.astype(np.int64) << 32) | w
                by = np.argsort(key)
                arc = np.empty(len(key), np.int64)
                arc[by] = np.minimum(np.searchsorted(self.arcs, key[by]), last)
                hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
                paid[open_] += np.where(hit, self.weight[arc] if len(self.arcs) else 0, np.where(s == 0, self.root[w], self.fail_weight[s]))
                done = hit | (s == 0)
                now[open_] = np.where(hit, self.target[arc] if len(self.arcs) else 0, np.where(s == 0, 1 + w, self.fail[s]))
                open_ = open_[~done]
            out[at] = paid
        return out


def word_totals(rows: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(tokens(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    counts = in_arrow(rows.where("not held_out").select("text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    got = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return int(got[0]), int(got[1])


def score(docs: DataFrame, block: int = BLOCK, k2: float = K2, k3: float = K3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text, held_out)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    n = parts_for(text_bytes(rows), block)
    n_all, v_all = word_totals(rows)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        t = Tokens(table)
        return messages(key[0].as_py(), {1: t.h, 2: t.pair}, {1: t.taught, 2: t.taught}, n)

    def ask_again(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        t = Tokens(table)
        at = t.with_state(Grams(t.pair, found, 2, n))
        return messages(key[0].as_py(), {3: t.triples(at)}, {3: t.taught[at]}, n)

    def walk(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        t = Tokens(table)
        one, two = Grams(t.h, found, 1, n), Grams(t.pair, found, 2, n)
        at = t.with_state(two)
        machine = Automaton(t, one, two, at, Grams(t.triples(at), found, 3, n), n_all, v_all, k2, k3)
        weights, f = machine.walk(t.first), t.first[:-1]
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(np.diff(t.first), pa.int64()),
                "n_known": pa.array(np.add.reduceat((one.count > 0)[one.of].astype(np.int64), f), pa.int64()),
                "train_tokens": pa.array(np.full(len(f), n_all), pa.int64()),
                "base_score": pa.array(np.add.reduceat(machine.root[machine.word], f)),
                "score": pa.array(np.add.reduceat(weights, f)),
            }
        )

    by_block = lambda df: df.groupBy("block")
    told = lambda asks: asks.groupBy("bucket", "kind").applyInArrow(lambda table: add_up(table), ANSWER)
    first = told(by_block(dealt).applyInArrow(ask, ASK))
    second = told(by_block(dealt).cogroup(by_block(first)).applyInArrow(ask_again, ASK))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return by_block(dealt).cogroup(by_block(first.unionByName(second))).applyInArrow(walk, ddl)
