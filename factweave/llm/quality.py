"""A byte-level convolutional network in numpy that scores text quality.

Bytes are embedded, learned filters of eight bytes run over the whole text with stride
four, their largest answers are pooled in overlapping chunks of 512 bytes (every 256),
and the chunks' mean and maximum are combined by a logistic layer into one probability.

Training takes a bounded sample of labelled rows to the driver: whole texts in the order of a hash of
doc_id, as long as they are ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes at most. Training and scoring cover every
byte of a text alike.

Defined cases: null is an empty text and gets the score of no evidence; without any
labelled row, or with one class only, all scores are the share of class 1 (0.5 when
there is none); equal texts score alike, whatever stands beside them: the trained numbers are put in steps so that
all sums are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, in_arrow

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 4, 24
HOP = 256
SAMPLE = 6000
SAMPLE_BYTES = 24 << 20
STEPS = 127
PIECE = 2 * HOP + WIDTH - STRIDE


class Net:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "w": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None
        self.settle()

    def settle(self) -> None:
        """Put bytes' vectors and filters in steps: sums of 64 products of two numbers up to 127 are exact in four bytes."""
        scale = 1.0
        self.q = {}
        for name in ("emb", "w"):
            step = max(float(np.abs(self.p[name]).max()), 1e-9) / STEPS
            self.q[name] = np.rint(self.p[name] / step).astype(np.float32)
            scale *= step
        self.scale = scale

    def conv(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Filter answers (in steps) at every stride of a byte array (its length a multiple of the stride).

        The windows at ``ends``, the last of each text, read zeros as in training, not the next text.
        """
        half, emb, w = STRIDE * EMBED, self.q["emb"], self.q["w"]
        y = emb[data].reshape(-1, half) @ np.concatenate([w[:half], w[half:]], axis=1)
        out = y[:, :FILTERS]
        last = y[ends, :FILTERS] + np.tile(emb[0], STRIDE) @ w[half:]
        out[:-1] += y[1:, FILTERS:]
        out[ends] = last
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        sizes = np.diff(offsets)
        halves = np.maximum(1, -(-(sizes + WIDTH - STRIDE) // HOP))
        first = np.concatenate([[0], np.cumsum(halves)])
        buf = np.zeros(first[-1] * HOP, np.uint8)
        buf[np.arange(len(data)) + np.repeat(first[:-1] * HOP - offsets[:-1], sizes)] = data
        top = self.conv(buf, first[1:] * (HOP // STRIDE) - 1).reshape(-1, HOP // STRIDE, FILTERS).max(axis=1)
        chunk = top.copy()
        chunk[:-1] = np.maximum(top[:-1], top[1:])
        chunk[first[1:] - 1] = top[first[1:] - 1]  # the last half of a text has no neighbour
        count = np.maximum(halves - 1, 1)
        last = halves > 1
        chunk = np.rint(np.maximum(chunk * self.scale + self.p["b"], 0) * (1 << 16)).astype(np.int64)
        for_mean = chunk.copy()
        for_mean[first[1:][last] - 1] = 0  # it is covered by the chunk before
        mean = np.add.reduceat(for_mean, first[:-1], axis=0) / count[:, None]
        high = np.maximum.reduceat(chunk, first[:-1], axis=0)
        z = (np.concatenate([mean, high], axis=1) / (1 << 16) * self.p["out"].astype(np.float64)).sum(axis=1) + float(self.p["bias"][0])
        return 1 / (1 + np.exp(-z))


def _training_chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks (chunks x PIECE) and each text's first one."""
    counts = [max(1, -(-(len(t) + WIDTH - STRIDE) // HOP) - 1) for t in texts]
    first = np.concatenate([[0], np.cumsum(counts)])
    x = np.zeros((first[-1], PIECE), np.uint8)
    for t, lo, n in zip(texts, first[:-1].tolist(), counts, strict=True):
        for c in range(n):
            part = np.frombuffer(t[c * HOP : c * HOP + PIECE], np.uint8)
            x[lo + c, : len(part)] = part
    return x, first


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 11) -> Net:
    net = Net(seed)
    if not len(labels) or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    x, first = _training_chunks(texts)
    sizes = np.diff(first)
    y = labels.astype(np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    r, step = np.random.default_rng(seed), 0
    half = STRIDE * EMBED
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), batch):
            own = order[lo : lo + batch]
            p, m_own = net.p, sizes[own]
            starts = np.cumsum(m_own) - m_own
            flat = x[np.arange(m_own.sum()) + np.repeat(first[own] - starts, m_own)]
            e = p["emb"][flat].reshape(len(flat), PIECE // STRIDE, half)
            a = e[:, :-1] @ p["w"][:half] + e[:, 1:] @ p["w"][half:]
            at = a.argmax(axis=1)
            top = np.take_along_axis(a, at[:, None], 1)[:, 0] + p["b"]
            h = np.maximum(top, 0)
            doc = np.repeat(np.arange(len(own)), m_own)
            n = m_own[:, None]
            mean, high = np.add.reduceat(h, starts, axis=0) / n, np.maximum.reduceat(h, starts, axis=0)
            z = np.concatenate([mean, high], axis=1) @ p["out"] + p["bias"]
            gz = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(own)
            g = {"out": np.concatenate([mean, high], axis=1).T @ gz + 1e-4 * p["out"], "bias": gz.sum(keepdims=True)}
            gh = (gz[:, None] * p["out"][:FILTERS] / n)[doc] + (gz[:, None] * p["out"][FILTERS:])[doc] * (h == high[doc])
            gh *= top > 0
            g["b"] = gh.sum(axis=0)
            spot = at[:, :, None] * STRIDE + np.arange(WIDTH)
            read = flat[np.arange(len(flat))[:, None, None], spot]
            win = p["emb"][read].reshape(len(flat), FILTERS, WIDTH * EMBED)
            g["w"] = np.einsum("nf,nfk->kf", gh, win)
            gw = (gh[:, :, None] * p["w"].T[None]).reshape(-1, EMBED)
            g["emb"] = np.stack([np.bincount(read.ravel(), gw[:, d], 256) for d in range(EMBED)], axis=1).astype(np.float32)
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= (rate * (0.5 ** (epoch // 3)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.settle()
    return net


def fitting(sizes: list[int], most_bytes: int) -> list[int]:
    """Places of the texts to take: in their order, each that still fits; those over a 64th of all bytes come last, the shortest first.

    A text that doesn't fit is passed over and costs itself alone.
    """
    taken, held = [], 0
    for i in sorted(range(len(sizes)), key=lambda i: max(0, sizes[i] - most_bytes // 64)):
        if held + sizes[i] <= most_bytes:
            taken.append(i)
            held += sizes[i]
    return taken


def sample(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole labelled texts, at most ``limit`` and ``most_bytes`` together, the same for the same rows."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    tagged = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y"))
    chosen = tagged.orderBy(key, "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").where("text is not null")
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("n"), F.first("_y").alias("y")).orderBy(key, "doc_id").collect()
    within = fitting([r.n for r in sizes], most_bytes)
    taken = docs.sparkSession.createDataFrame([(sizes[i].doc_id, int(sizes[i].y)) for i in within], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int")
    # Of rows with one doc_id the shortest text, then the least.
    least = F.min(F.struct(F.octet_length("text").alias("n"), F.col("text").cast("binary").alias("t")))["t"]
    got = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(least.alias("text"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return [bytes(r.text) for r in got], np.array([r.y for r in got], np.int64)


def score(docs: DataFrame, net: Net, text: str = "text") -> DataFrame:
    """Add ``score`` to (key columns, text), in place of a column of that name."""
    keys = [c for c in docs.columns if c not in (text, "score")]
    plan = docs.select(*keys, text)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema if f.name in keys] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [net.score(data, offsets) for _, _, data, offsets in blocks(batch.column(len(keys)), 1 << 19)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + [pa.array(np.concatenate(got) if got else [], pa.float64())], [*keys, "score"])

    return in_arrow(plan, run, ddl)
