"""Hard negatives from k-means inverted lists, exact by the bound of Cauchy and Schwarz.

Centroids are fitted on at most ``SAMPLE`` rows chosen by a hash; every row goes to the list of its nearest centroid, and a
list keeps its radius, the largest distance of a row from the centroid. For an anchor ``a`` no row of a list scores above
``a.c + |a|r`` or below ``a.c - |a|r``. A *goal* is a search of an anchor: the first k rows of the same label, or of
another, with scores from ``low`` to ``high``. Lists are visited by their bound; those outside the window
are skipped, and the search stops where the bound falls strictly below the kth score found. Spark visits in two rounds:
the first eighth of each goal's lists gives the kth score, the second round takes the others that still reach it.

Lists are cut into tiles of about ``TILE_BYTES``, so a hot list is many tiles, dealt by row. Anchors travel in blocks of
``BLOCK`` to the tiles of the lists they visit; a tile multiplies a whole block at once, and returns what can
be among the first k. Nothing but centroids, radii and counts of at most ``LISTS`` lists goes through the driver.

Defined cases: rows without label, vector or vec_id, or with a null or non-finite component, take no part; an
anchor's own row is no partner, but another row of the same vec_id is one; vectors of different
lengths are filled with zeros; a window of a negative score is empty; an empty table gives no row. Scores are exact while
products stay below 2**62, else an OverflowError tells so. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_arrow, small, stash

LISTS, SAMPLE, ROUNDS = 1024, 20_000, 8
TILE_BYTES, BLOCK = 1 << 19, 128
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Bytes of messages to tiles up to which they are broadcast; above, tiles and messages meet by a shuffle.
SENT = 32 << 20
FREE = np.int64(1 << 62)

_HIT = "anchor bigint, goal int, vec_id bigint, score bigint"


def usable(vector: str = "vector") -> Column:
    """Whether a vector of doubles or integers is there with all its components finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def fit(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of Lloyd's algorithm; an empty list keeps its centroid."""
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        own = nearest(vectors, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        n = np.bincount(own, minlength=lists)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every vector, and the distance from it."""
    own = np.zeros(len(vectors), np.int64)
    for lo in range(0, len(vectors), 4096):
        own[lo : lo + 4096] = ((centres**2).sum(axis=1) - 2 * (vectors[lo : lo + 4096] @ centres.T)).argmin(axis=1)
    return own, np.sqrt(((vectors - centres[own]) ** 2).sum(axis=1))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Vectors of an Arrow column of packed numbers."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), dim)


class Index:
    """``tiles``: list, tile, rows (vec_id, row, label, v); centroids, radii, rows and tiles of every list."""

    def __init__(self, rows: DataFrame, dim: int, largest: int, n: int) -> None:
        """``rows``: a stored table of row, vec_id, label and vector (whole numbers); ``largest``: their largest absolute value."""
        if dim * largest**2 >= 1 << 62:
            raise OverflowError("inner products of these vectors do not fit in 64 bits")
        self.dim, self.kind, self.exact = dim, "<i4" if largest < 1 << 31 else "<i8", dim * largest**2 < 1 << 53
        width, kind = dim * int(self.kind[2]), self.kind

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column(3)
                sizes = np.diff(column.offsets.to_numpy())
                m = np.zeros((b.num_rows, dim), kind)
                m[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in m], pa.binary())], names=["row", "vec_id", "label", "v"])

        flat = in_arrow(rows.select("row", "vec_id", "label", "vector"), packed, "row bigint, vec_id bigint, label bigint, v binary")
        share = min(1 << 30, -(-(SAMPLE << 30) // max(n, 1)))
        chosen = flat.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share).select("row", "v").limit(2 * SAMPLE).collect()
        chosen = [bytes(r.v) for r in sorted(chosen)] or [bytes(width)]
        sample = np.frombuffer(b"".join(chosen), self.kind).reshape(-1, dim).astype(np.float64)
        self.centres = centres = fit(sample, min(LISTS, max(1, isqrt(n)), len(sample)))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, far = nearest(_matrix(b.column(3), dim, kind).astype(np.float64), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(far)], names=[*b.schema.names, "list", "far"])

        self.rows = stash(in_arrow(flat, assigned, "row bigint, vec_id bigint, label bigint, v binary, list bigint, far double"), "lists")
        told = self.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        self.counts, self.radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in told:
            self.counts[r["list"]], self.radii[r["list"]] = r["n"], r["far"]
        self.cuts = np.maximum(1, -(-self.counts * width // TILE_BYTES))
        cuts = F.array(*(F.lit(int(c)) for c in self.cuts))[F.col("list").cast("int")]
        tile = F.pmod(F.xxhash64("row"), cuts)
        self.tiles = stash(self.rows.groupBy("list", tile.alias("tile")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "row", "label", "v"))).alias("rows")), "tiles")

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most and least score that a row of each list can have with each anchor, with room for rounding; empty lists have none."""
        middle = anchors @ self.centres.T
        length = np.sqrt((anchors**2).sum(axis=1))[:, None]
        reach = length * self.radii * (1 + 1e-9) + length * np.sqrt((self.centres**2).sum(axis=1)) * 1e-9 + 1e-6
        empty = self.counts == 0
        return np.where(empty, -np.inf, middle + reach), np.where(empty, np.inf, middle - reach)

    def visits(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, again: bool) -> np.ndarray:
        """Which lists a goal visits. First the first eighth by their bound; again: the others. Those out of the window never."""
        most, least = self.bounds(anchors)
        order = np.argsort(-most, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
        early = place < -(-order.shape[1] // 8)
        return (early != again) & (most >= low[:, None]) & (least <= high[:, None])

    def search(self, goals: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor, goal, vec_id, score and place (from 1) of the first ``k`` of each goal.

        ``goals``: anchor (the row), goal, label, v, low, high. Rows of the anchor's label if ``same``, else of others.
        """
        low, high = F.coalesce("low", F.lit(-int(FREE))).alias("low"), F.coalesce("high", F.lit(int(FREE))).alias("high")
        goals = stash(goals.select("anchor", "goal", "label", "v", low, high, F.col("low").isNull().alias("open")), "goals")
        by = Window.partitionBy("anchor", "goal").orderBy(F.col("score").desc(), "vec_id")
        first = lambda df: df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
        early = stash(first(self._visit(goals, k, same, False)), "early")
        kth = early.where(F.col("place") == k).select("anchor", "goal", F.col("score").alias("kth"))
        left = goals.join(kth, ["anchor", "goal"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).drop("kth")
        return first(early.drop("place").unionByName(self._visit(left, k, same, True)))

    def _visit(self, goals: DataFrame, k: int, same: bool, again: bool) -> DataFrame:
        n = goals.count()
        block = F.pmod(F.xxhash64("anchor", "goal"), F.lit(max(1, -(-n // BLOCK))))
        blocks = goals.groupBy(block.alias("block")).agg(F.collect_list(F.struct("anchor", "goal", "label", "low", "high", "v")).alias("goals"))
        index = self.without_tables()

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for group in b.column(1):
                    g = group.values
                    low, high = g.field("low").to_numpy(), g.field("high").to_numpy()
                    who = index.visits(_matrix(g.field("v"), index.dim, index.kind).astype(np.float64), low, high, again)
                    for at in np.flatnonzero(who.any(axis=0)):
                        some = g.take(pa.array(np.flatnonzero(who[:, at])))
                        some = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                        for tile in range(int(index.cuts[at])):
                            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([tile], pa.int64()), some], names=["list", "tile", "goals"])

        shape = "array<struct<anchor:bigint,goal:int,label:bigint,low:bigint,high:bigint,v:binary>>"
        sent = stash(in_arrow(blocks, send, f"list bigint, tile bigint, goals {shape}"), "messages")
        weight = sent.agg(F.coalesce(F.sum(F.size("goals")), F.lit(0))).first()[0] * (40 + self.dim * int(self.kind[2]))
        met = self.tiles.join(F.broadcast(sent) if weight <= SENT else sent, ["list", "tile"])
        # The tile's columns come first; one row of a batch is a tile and the goals that visit it.
        return in_arrow(met.select("rows", "goals"), lambda batches: (index.score(b, k, same) for b in batches), _HIT)

    def without_tables(self) -> Index:
        """What tasks need of the index: centroids, radii and sizes."""
        other = object.__new__(Index)
        other.__dict__.update({key: v for key, v in self.__dict__.items() if key not in ("rows", "tiles")})
        return other

    def score(self, batch: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
        """The first ``k`` hits of every goal in the tile beside it."""
        out: list[list[np.ndarray]] = []
        for i in range(batch.num_rows):
            t, g = batch.column(0)[i].values, batch.column(1)[i].values
            kind = np.float64 if self.exact else np.int64
            scores = (_matrix(g.field("v"), self.dim, self.kind).astype(kind) @ _matrix(t.field("v"), self.dim, self.kind).astype(kind).T).astype(np.int64)
            of = lambda c, n: c.field(n).to_numpy(zero_copy_only=False)
            alike = of(g, "label")[:, None] == of(t, "label")
            ok = alike & (of(g, "anchor")[:, None] != of(t, "row")) if same else ~alike
            ok &= (scores >= of(g, "low")[:, None]) & (scores <= of(g, "high")[:, None])
            goal, at = np.nonzero(ok)
            order = np.lexsort((at, -scores[goal, at], goal))
            goal, at = goal[order], at[order]
            start = np.searchsorted(goal, goal)
            keep = np.arange(len(goal)) - start < k
            goal, at = goal[keep], at[keep]
            out.append([of(g, "anchor")[goal], of(g, "goal")[goal], of(t, "vec_id")[at], scores[goal, at]])
        columns = [np.concatenate([np.zeros(0, np.int64), *(o[c] for o in out)]) for c in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3])], names=["anchor", "goal", "vec_id", "score"])


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, vector (array of whole numbers), anchor (whether the row is one). For each of the first
    ``positives`` rows of an anchor's label: the first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of it.
    """
    whole = F.transform("vector", lambda x: x.cast("bigint"))
    rows = vectors.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor")), "vectors")
    n, dim, largest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    index = Index(rows, max(1, dim or 1), int(largest or 0), n)
    anchors = stash(index.rows.join(rows.where("anchor").select("row"), "row").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    none = F.lit(None).cast("bigint")
    found = index.search(anchors.select("anchor", F.lit(0).alias("goal"), "label", "v", none.alias("low"), none.alias("high")), positives, True)
    found = stash(found.select("anchor", F.col("place").alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    window = found.where(p >= 0).select("anchor", "goal", F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"))
    hits = index.search(window.join(anchors, "anchor").select("anchor", "goal", "label", "v", "low", "high"), negatives, False)
    named = hits.join(found, ["anchor", "goal"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
