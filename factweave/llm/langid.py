"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies)
the vectors of its letters, each permuted (rotated) by its place; a text's vector
bundles (adds) its trigrams; a language's prototype bundles the unit vectors of its
training texts. A text takes the language with the largest cosine.

Defined cases: a null text, an empty text or one without any letter is ``und`` with
score 0; rows with a null language or text teach nothing; without any training row
all texts are ``und``; ties go to the alphabetically first language; equal texts get
equal answers; columns other than the three named are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, in_arrow

DIM = 512
CLASSES = 128
ROWS = 256
SLICE = 4096
SCALE = 1 << 20

_cache: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """Code point to class: 0 is no letter, a-z are 1 to 26, other letters share 101 classes by code point."""
    if "classes" not in _cache:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 101
        _cache["classes"] = table
    return _cache["classes"]


def letter_vectors() -> np.ndarray:
    if "vectors" not in _cache:
        v = np.random.default_rng(7).integers(0, 2, (CLASSES, DIM)) * 2 - 1
        _cache["vectors"] = np.stack([np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v]).astype(np.float32)
    return _cache["vectors"]


def text_vectors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bundled trigram vectors, whether a row has a letter), ``ROWS`` rows at a time.

    Vectors are whole numbers. Trigrams are bound and counted in slices, so that memory follows neither the number of
    different trigrams nor the length of a text.
    """
    n = len(offsets) - 1
    for lo in range(0, n, ROWS):
        hi = min(lo + ROWS, n)
        part = offsets[lo : hi + 1]
        yield lo, hi, *_bundle(data[part[0] : part[-1]], part - part[0])


def _bundle(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = heads[offsets]
    if first[-1] != len(points):  # not valid UTF-8: the replaced text has other places
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(rows)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    kinds = letter_classes()[points]
    # A gap before and after every text; runs of other characters are one gap.
    seq = np.zeros(len(kinds) + 2 * rows, np.uint8)
    row_of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
    seq[np.arange(len(kinds)) + 2 * row_of + 1] = kinds
    owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first) + 2)
    keep = seq > 0
    has = np.bincount(owner[keep], minlength=rows) > 0
    keep[1:] |= seq[:-1] > 0
    keep[np.searchsorted(owner, np.arange(rows))] = True
    seq, owner = seq[keep].astype(np.int32), owner[keep]
    out = np.zeros((rows, DIM))
    if len(seq) < 3:
        return out, has
    ids = (seq[:-2] * CLASSES + seq[1:-1]) * CLASSES + seq[2:]
    ok = (owner[:-2] == owner[2:]) & (seq[1:-1] > 0)
    ids, owner = ids[ok], owner[:-2][ok]
    seen = np.zeros(CLASSES**3, bool)
    seen[ids] = True
    found = np.flatnonzero(seen)
    rank = np.zeros(CLASSES**3, np.int32)
    rank[found] = np.arange(len(found))
    slots = rank[ids]
    a, b, c = letter_vectors()
    if len(found) > SLICE:
        order = np.argsort(slots, kind="stable")
        slots, owner = slots[order], owner[order]
    for lo in range(0, len(found), SLICE):
        f = found[lo : lo + SLICE]
        bound = a[f // CLASSES**2] * b[f // CLASSES % CLASSES] * c[f % CLASSES]
        i, j = (0, len(slots)) if len(found) <= SLICE else np.searchsorted(slots, [lo, lo + len(f)])
        counts = np.bincount(owner[i:j] * len(f) + (slots[i:j] - lo), minlength=rows * len(f)).reshape(rows, len(f))
        # Sums of whole numbers below 2**24 are exact in four bytes, in whatever order they are added.
        kind = np.float32 if j - i < 1 << 24 else np.float64
        out += counts.astype(kind) @ bound.astype(kind, copy=False)
    return out, has


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Prototypes by language in steps of 2**-20: one vector per language reaches the driver, whatever the rows.

    The sums are integers (unit vectors in steps of 2**-20), so they don't depend on the order.
    """
    schema = pa.schema([("lang", pa.string()), ("dim", pa.list_(pa.int64()))])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in blocks(batch.column(1), 1 << 19):
                for i, j, v, has in text_vectors(data, offsets):
                    v = np.rint(_unit(v) * SCALE).astype(np.int64)
                    own = langs[lo + i : lo + j]
                    for name in sorted(set(own)):
                        sums[name] = sums.get(name, 0) + v[has & (own == name)].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], schema[1].type)], schema=schema)

    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = (
        in_arrow(known, bundle, "lang string, dim array<bigint>")
        .select("lang", F.posexplode("dim"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("v"))
        .collect()
    )
    names = sorted({r.lang for r in rows})
    protos = np.zeros((len(names), DIM))
    for r in rows:
        protos[names.index(r.lang), r.pos] = r.v
    return names, np.rint(_unit(protos) * SCALE).astype(np.int64)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (cosine with the best prototype, 0 to 1), in place of columns of these names; the text itself goes on if asked."""
    names, protos = model
    size = np.linalg.norm(protos, axis=1) if len(names) else np.ones(1)
    keys = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    plan = docs.select(*keys, text)
    kept = plan.columns if keep_text else keys
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema if f.name in kept] + ["lang_pred string", "score double"])
    label = np.array([*names, "und"], dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, _, data, offsets in blocks(batch.column(len(keys)), 1 << 19):
                for _, _, v, has in text_vectors(data, offsets):
                    has &= len(names) > 0
                    # Products of whole numbers: equal texts get equal answers whatever stands beside them.
                    dot = v.astype(np.int64) @ protos.T if len(names) else np.zeros((len(v), 1))
                    cos = dot / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None] / size
                    best.append(label[np.where(has, cos.argmax(axis=1), len(names))])
                    score.append(np.where(has, np.clip(cos.max(axis=1), 0, 1), 0))
            cols = [batch.column(i) for i in range(len(kept))]
            cols += [pa.array(np.concatenate(best) if best else [], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "lang_pred", "score"])

    return in_arrow(plan, predict, ddl)


def accepted(score: Column, lang_pred: Column) -> Column:
    """Texts kept by the pipeline: those with a language at all."""
    return (lang_pred != "und") & (score > 0)
