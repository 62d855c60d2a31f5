"""Mixing, spelling variants and hard negatives against brute force on small tables, odd ones among them."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import mixing, negatives, spelling
from factweave.llm.queries import op13_hard_negatives

MIX = "doc_id bigint, source string, text string, size int, number int, row int, target int, tie int"
ODD = (0, 1, 2, 3, 4)


def fair_shares(sizes, weights=(5, 2, 1), most=3):
    """The contract word by word: share, stop what is above, share its excess by weight, until none is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    share = dict.fromkeys(sizes, 0.0)
    rest, free = float(sum(sizes.values())), set(sizes)
    while free and rest > 1e-9:
        each = rest / sum(w[s] for s in free)
        rest = 0.0
        for s in list(free):
            share[s] += each * w[s]
            if share[s] > most * sizes[s] + 1e-9:
                rest += share[s] - most * sizes[s]
                share[s] = most * sizes[s]
                free.discard(s)
    return share


def mix_rows(seed, n=900):
    r = random.Random(seed)
    names = ["é", "b", "a", "B", None, "", "hot", "tiny"]
    rows = []
    for i in range(n):
        s = "hot" if r.random() < 0.4 else r.choice(names)
        words = 2 if s == "tiny" else int(r.paretovariate(1.2) * 5) % 700
        rows.append((i, s, r.choice([" ", "\n\t "]).join(["w"] * words), *ODD))
    return [*rows, (None, "a", "no id", *ODD), (5, "a", None, *ODD), (5, "a", None, *ODD), (7, "a", "x y", *ODD), (7, "a", "x y", *ODD), (8, "blank", " \n ", *ODD), (9, "long", "w " * 200_000, *ODD)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_reaches_its_targets(spark, seed):
    rows = mix_rows(seed)
    docs = spark.createDataFrame(rows, MIX)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[1], size(r[2])) for r in rows)
    sizes = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[1] is None, (r[1] or "").encode())):
        sizes[r[1]] += size(r[2])
    want, taken, largest = fair_shares(sizes), Counter(), Counter()
    for r in got:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in want.items():  # less than the largest document off, wherever the offset falls
        assert abs(taken[s] - t) <= largest[s] or sizes[s] == 0
    again = mixing.plan(docs.repartition(7)).select("doc_id", "source", "size", "taken").collect()
    assert Counter(again) == Counter((r.doc_id, r.source, r["size"], r.taken) for r in got)


def test_mixing_by_plain_prefix_sums(spark):
    """Copies of each document are the whole numbers its stretch reaches, for one of the offsets."""
    rows = mix_rows(3, 300)
    got = mixing.plan(spark.createDataFrame(rows, MIX)).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["size"], r.doc_id is None, r.doc_id or 0)):
        by[r.source].append(r)
    for docs in by.values():
        rate = docs[0].target / docs[0].source_size if docs[0].source_size else 0.0
        counts = [r.copies for r in docs]
        assert set(counts) <= {int(rate), int(rate) + 1}
        sums = np.cumsum(counts)
        assert all(abs(s - rate * (i + 1)) < 1 + 1e-6 for i, s in enumerate(sums))
    whole = [r for r in got if r.copies == 3]
    assert whole and all(r.copies <= 3 for r in got)


def test_mixed_corpus_repeats_whole_rows(spark):
    docs = spark.createDataFrame(mix_rows(4, 200), MIX)
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[r.source] += r.taken
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.select("source", "text").collect():
        words[r.source] += len((r.text or "").split())
    assert words == Counter({s: n for s, n in plan.items() if n})
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def brute_variants(texts):
    n = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = [v for v in n if v != w and near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
        out[w] = (n[w], len(close))
    result = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        result[w] = (form.get(w), root, *out[w], n[form[w]] if w in form else None)
    return result


def spelled(seed):
    """Stems with chains of rarer and rarer misspellings, letters doubled and beyond ASCII."""
    r = random.Random(seed)
    letters = "abeélnßÿÀ×"
    words = []
    for _ in range(25):
        w, n = "".join(r.choice(letters) for _ in range(r.randrange(7, 13))), 300
        while n:
            words += [w.upper() if r.random() < 0.1 else w] * n
            at, kind = r.randrange(len(w)), r.random()
            w = w[:at] + (r.choice(letters) if kind < 0.6 else w[at] * 2 if kind < 0.9 else "") + w[at + (kind < 0.6 or kind >= 0.9) :]
            n //= 11
            words += [w + r.choice(letters) for _ in range(2)] * 2
    r.shuffle(words)
    texts = [(i, " , ".join(words[i * 60 : i * 60 + 60])) for i in range(len(words) // 60 + 1)]
    long = "ab" * 3000
    return [*texts, (None, None), (None, "nameless nameless namelesz namelesz"), (3, ""), (4, "日本 aaaaaaa日aaaaaaa aaaaaaaa aaaaaaaa"), (5, f"{long} {long}1{long}x {long}x"), texts[0], texts[0], (6, "short words are not taken here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_against_brute_force(spark, seed, monkeypatch):
    texts = spelled(seed)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "id")})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == brute_variants(texts)
    assert max(x[3] for x in got.values()) > 1 and any(x[1] != x[0] and x[0] for x in got.values())
    assert spelling.variants(docs.limit(0)).count() == 0


def test_counts_in_parts_and_keys_in_slices(monkeypatch):
    texts = spelled(5)[:40]
    whole = sum(spelling.counted(iter(texts)), Counter())
    monkeypatch.setattr(spelling, "HELD", 3)
    assert len(list(spelling.counted(iter(texts)))) > 3 and sum(spelling.counted(iter(texts)), Counter()) == whole
    words = [b"aabbbcd", b"bookkeeper", b"a" * 9]
    row, place, key, first = spelling.keys_of(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    seen = {}
    for r, p, k, f in zip(row, place, key, first, strict=True):
        w = words[r] if p < 0 else words[r][:p] + words[r][p + 1 :]
        assert seen.setdefault(w, k) == k
        assert p < 1 or f == (words[r][p] != words[r][p - 1])
    assert len(set(seen.values())) == len(seen)


def brute_negatives(rows, positives=5, negatives_=10):
    kept = [(i, v, (l + 1) % 10 if v % 7 == 0 else l, [int(np.floor(256 * x)) for x in e]) for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = Counter()
    for i, a, label, q in kept:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p, strict=False)), v, la == label) for j, v, la, p in kept if j != i), key=lambda t: t[:2])
        for s, v, _ in [t for t in scored if t[2]][:positives]:
            found = [(w, -n) for n, w, alike in scored if not alike and 30 * -s <= 100 * -n <= 90 * -s][:negatives_]
            out.update((a, v, k, w, -s, n) for k, (w, n) in enumerate(found, 1))
    return out


def vector_rows(seed, n=500, spread=0.15):
    """Clusters with a hot one, repeated rows, ties, nulls and components that are no numbers."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, 12))
    which = np.where(r.random(n) < 0.4, 0, r.integers(0, 6, n))
    e = middles[which] + spread * r.normal(size=(n, 12))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    e = np.round(e, 1 if seed == 2 else 6)
    rows = [(i, [float(np.float32(x)) for x in e[i]], int(r.integers(0, 10))) for i in range(n)]
    rows += [rows[100], rows[100], rows[3], (None, rows[5][1], 1), (n, None, 1), (n + 1, rows[7][1], None), (n + 2, [None] * 12, 2), (n + 3, [float("nan")] * 12, 2), (n + 4, [float("inf")] * 12, 2), (n + 5, rows[9][1][:5], 3), (n + 6, [], 4), (200, rows[8][1], 5), (-100, rows[11][1], 6)]
    return rows


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.15), (2, 0.15), (3, 2.0)])
def test_hard_negatives_against_brute_force(spark, tmp_path, monkeypatch, seed, spread):
    monkeypatch.setattr(negatives, "TILE_BYTES", 1024)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    if seed == 2:
        monkeypatch.setattr(negatives, "SENT", 0)
    rows = vector_rows(seed, spread=spread)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row", "v", "list")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in op13_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows) and got


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op13_hard_negatives(spark, str(tmp_path)).count() == 0


def test_lists_outside_the_window_are_skipped():
    index = object.__new__(negatives.Index)
    r = np.random.default_rng(4)
    index.centres, index.radii, index.counts = r.normal(size=(40, 6)) * 50, r.random(40) * 5, np.full(40, 3)
    index.counts[7] = 0
    anchors, low, high = r.normal(size=(9, 6)) * 30, np.full(9, 800.0), np.full(9, 3000.0)
    early, late = (index.visits(anchors, low, high, again) for again in (False, True))
    assert not (early & late).any() and not (early | late)[:, 7].any()
    middle, reach = anchors @ index.centres.T, np.linalg.norm(anchors, axis=1)[:, None] * index.radii
    inside = (middle + reach >= 800) & (middle - reach <= 3000) & (index.counts > 0)
    assert np.array_equal(early | late, inside) and 0 < inside.mean() < 0.5


def test_one_long_text_does_not_end_the_sample(spark):
    from factweave.llm import quality

    sizes = [300] * 200
    for at in (0, 100, 200):
        whole = [*sizes[:at], 32 << 20, *sizes[at:]]
        assert quality.fitting(whole, 24 << 20) == [i for i in range(201) if i != at]
        assert len(quality.fitting([*sizes[:at], 20 << 20, *sizes[at:]], 24 << 20)) == 201
    docs = spark.createDataFrame([(i, "good words " * (4000 if i == 3 else 3)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    texts, y = quality.sample(docs, labels, most_bytes=20_000)
    assert len(texts) == len(y) == 39 and max(map(len, texts)) < 100
