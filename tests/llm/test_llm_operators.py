import random
import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import chaining, containment, extract, langid, lm, ngram_join, packing, quality, shared, tiff, warc
from factweave.llm.queries import tokenizer_files

DOCS = "doc_id bigint, text string"


def make(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, k=5):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus(seed, n=60, vocabulary=400):
    """Texts of which many are near copies at about the threshold, some share passages."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    base = [[r.choice(vocab) for _ in range(r.randrange(3, 90))] for _ in range(n // 4)]
    shared = [r.choice(vocab) for _ in range(60)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if i % 5 == 0:
            w = w[: len(w) // 2] + shared + w[len(w) // 2 :]
        out.append(" ".join(w).title() if i % 3 else "\n ".join(w))
    return [*out, None, "", "  \t", "one", "one", "one two three four", "ONE two three four"]


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_components(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(make(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_trie_links_in_blocks():
    """Two blocks against each other and each alone give the components of the whole."""
    r = np.random.default_rng(3)
    sets = [np.sort(r.choice(60, r.integers(5, 30), replace=False)) for _ in range(40)]
    sets += [np.sort(np.unique(np.concatenate([s[1:], [99 + i]]))) for i, s in enumerate(sets)]
    sizes = np.array([len(s) for s in sets])
    comp, half, rest = np.arange(80), np.arange(0, 80, 2), np.arange(1, 80, 2)
    for a, b in ((half, half), (rest, rest), (half, rest)):
        ngram_join.trie_links(sets, sizes, a, b, comp)
    full = np.arange(80)
    for i in range(80):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 180 * n >= 80 * (sizes[i] + sizes[j]):
                full[full == full[i]] = full[j]
    assert len(set(zip(comp.tolist(), full.tolist(), strict=True))) == len(set(comp.tolist())) == len(set(full.tolist()))


def test_blocks_of_large_groups(spark, monkeypatch):
    texts = corpus(5, 80, 50)
    docs = make(spark, texts)
    found = ngram_join.sets(docs)
    whole = ngram_join.whole_sets(docs, ngram_join.live_classes(found))
    groups = ngram_join.candidate_groups(whole)
    small, large = (ngram_join.components(ngram_join.group_links(whole, groups, b)) for b in (1000, 3))
    kinds = lambda d: sorted(sorted(x) for x in d.groupBy("root").agg(F.collect_list("node").alias("n")).toPandas()["n"].map(list))
    assert kinds(small) == kinds(large)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 100)
    assert kinds(small) == kinds(ngram_join.components(ngram_join.group_links(whole, groups)))


def test_chained_groups_are_dealt_by_shingle(spark):
    """A long chain of texts, each sharing shingles with the next ones, is one group by connection but not by shingle."""
    r = random.Random(9)
    line = [f"c{i}" for i in range(700)]
    texts = []
    for i in range(0, 600, 4):
        w = line[i : i + 60]
        texts.append(" ".join(w))
        if r.random() < 0.5:
            w[r.randrange(60)] = "other"
            texts.append(" ".join(w))
    whole = ngram_join.whole_sets(make(spark, texts), ngram_join.live_classes(ngram_join.sets(make(spark, texts))))
    groups = shared.stash(ngram_join.candidate_groups(whole, 4), "test-groups")
    assert groups.count() > groups.select("set_key").distinct().count()
    kinds = lambda d: sorted(sorted(x) for x in d.groupBy("root").agg(F.collect_list("node").alias("n")).toPandas()["n"].map(list))
    found = kinds(ngram_join.components(ngram_join.group_links(whole, groups, 4)))
    assert found == kinds(ngram_join.components(ngram_join.group_links(whole, ngram_join.candidate_groups(whole))))
    by_key = {k.set_key: i for i, k in enumerate(ngram_join.sets(make(spark, texts)).orderBy("doc_id").collect())}
    roots = brute_components(texts)
    assert sorted(len(x) for x in found) == sorted(n for n in Counter(roots[i][1] for i in set(by_key.values())).values() if n > 1)


def test_containment(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (3, 12, 20, 50, 50, 200)]
    texts = []
    for i in range(40):
        w = " ".join(r.choice(vocab) for _ in range(r.choice([5, 100, 3000])))
        if i % 4 == 0:
            w += "\n" + items[i // 4 % 6].upper() + " tail"
        if i % 9 == 0:
            part = items[5].split()
            w += " " + " ".join(part[: 150 + i])
        texts.append(w)
    texts += [None, "", items[1], items[0]]
    bench = spark.createDataFrame([*enumerate(items), (6, None), (7, " ")], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_found) for x in containment.contained(make(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, q in enumerate(items):
            a, b = shingle_set(q), shingle_set(t)
            if a and 100 * len(a & b) >= 80 * len(a):
                want[(i, j)] = (len(a), len(a & b))
    assert got == want and want
    assert containment.contained(make(spark, texts), bench, limit=0).count() == len(want)  # without broadcasts


def passage_corpus():
    r = random.Random(8)
    vocab = [f"p{i}" for i in range(5000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    exact, short, fuzzy = say(70), say(20), say(120)
    edited = list(fuzzy)
    for i in range(15, 120, 25):
        edited[i] = "edit"
    del edited[60]
    docs = [say(100) + exact + say(30), say(40) + exact, say(80), say(50) + short + say(50), say(10) + short + say(90), say(60) + fuzzy + say(60), say(5) + edited + say(20), exact]
    return [" ".join(d) for d in docs] + [None, ""]


def test_passages(spark):
    got = {(r.doc_id, r.src_doc_id): r for r in chaining.passages(make(spark, passage_corpus())).collect()}
    assert set(got) == {(1, 0), (7, 0), (6, 5)}
    assert (got[1, 0].start_word, got[1, 0].end_word, got[1, 0].src_start, got[1, 0].src_end, got[1, 0].identity) == (40, 110, 100, 170, 1.0)
    assert got[6, 5].n_words >= 110 and 0.9 < got[6, 5].identity < 1


def exact_corpus():
    """Runs with an inner period, and runs whose seeds have their first occurrences in many documents."""
    r = random.Random(11)
    vocab = [f"e{i}" for i in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    mosaic, line = say(60), say(9)
    docs = [say(20) + mosaic[i : i + 21] + say(30) for i in range(0, 60, 3)]
    docs += [say(30) + mosaic + say(10), say(5) + mosaic + say(40), mosaic[3:53]]
    docs += [say(a) + ["same"] * n + say(9) for a, n in ((8, 80), (21, 130), (3, 52), (4, 49))]
    docs += [say(a) + line * n + say(9) for a, n in ((30, 7), (0, 12), (14, 6), (2, 5))]
    return [" ".join(d) for d in docs]


def test_exact_runs_against_brute_force(spark):
    texts = exact_corpus()
    seen, want = set(), set()
    for d, t in enumerate(texts):
        w = t.split()
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        want |= {(d, j) for i, x in enumerate(own) if x in seen for j in range(i, i + 50)}
        seen |= set(own)
    got = {(r.doc_id, j) for r in chaining.passages(make(spark, texts)).collect() for j in range(r.start_word, r.end_word)}
    assert {d for d, _ in want} == {d for d, _ in got} == {21, 22, 24, 25, 28, 29}
    assert want <= got


def test_chains_of_a_run_with_a_short_period(spark):
    """The j-th with the j-th occurrence: a periodic run with some words changed is chained."""
    r = random.Random(12)
    say = lambda n: [f"q{r.randrange(3000)}" for _ in range(n)]
    line = say(9)
    edited = line * 12
    edited[40] = edited[80] = "edit"
    docs = make(spark, [" ".join(say(10) + line * 12 + say(10)), " ".join(say(25) + edited + say(10))])
    (p,) = chaining.passages(docs).collect()
    assert (p.doc_id, p.src_doc_id) == (1, 0) and p.n_words >= 100 and 0.9 < p.identity < 1


def test_cutting_passages(spark):
    docs = make(spark, passage_corpus())
    left = {r.doc_id: r.text for r in chaining.without_passages(docs, chaining.passages(docs)).collect()}
    texts = passage_corpus()
    assert 7 not in left and left[0] == texts[0] and left[1].split() == texts[1].split()[:40] and left[8] is None


def test_words_of_long_texts_are_hashed_by_runs(monkeypatch):
    raw = np.frombuffer((" Aé".join("lorem ipsum dolor" for _ in range(50)) + "x" * 300 + " end").encode(), np.uint8)
    starts, ends, _ = shared.words(raw, np.array([0, len(raw)]))
    whole = shared.word_hashes(raw, starts, ends)
    monkeypatch.setattr(shared, "BLOCK_BYTES", 40)
    assert np.array_equal(shared.word_hashes(raw, starts, ends), whole)


def test_chains_take_the_best_order():
    frags = np.array([[0, 0, 10], [12, 12, 10], [24, 5, 6], [30, 31, 10]])
    assert chaining.chains(frags)[0] == [(0, 0, 10), (12, 12, 10), (30, 31, 10)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["a b", None, "", "word " * 5000, "žluťoučký kůň 😀", "x" * 300, "x <|endoftext|> y"] + ["same text here"] * 30
    rows = packing.pack_documents(make(spark, texts), *tokenizer_files(), group=10).collect()
    t = Tokenizer.from_file(tokenizer_files()[0])
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 2048


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    n = np.random.default_rng(1).integers(1, 100, 300)
    bins, _ = packing.best_fit(n, 100, 4, 6000.0, (1.0, 0.2, 0.2), rule)
    for b in set(bins.tolist()):
        own = n[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= max(6000.0, own[0] ** 2)


def test_warc_reads_back_by_bytes_and_marks_a_hot_payload(spark, monkeypatch):
    """A third of all pages is empty: they stay where they are, and every later one refers to the first."""
    monkeypatch.setattr(warc, "READ_BYTES", 40_000)
    monkeypatch.setattr(shared, "HOT_KEYS", 10)
    rows = [(i, f"u{i}", None if i % 3 == 0 else f"page {i % 50}" * 3_000 if i % 3 == 1 else f"only {i}") for i in range(300)]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sorted(got) == [r[0] for r in rows]
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    for i, _, html in rows:
        r = got[i]
        want = first[html or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if want == i else ("revisit", want))
        assert r.payload_bytes == len(html or "") and (bytes(r.payload).decode() == (html or "") or r.refers_to is not None)


def test_warc(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, "http://c", None), (5, "http://d", ""), (4, "http://e", "ü\r\n\r\nWARC/1.1"), (None, "u", "same"), (1, "http://b", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(pages).collect()), key=str)
    assert got == sorted([(3, "revisit", 1, 4), (1, "response", None, 4), (1, "response", None, 4), (2, "response", None, 0), (5, "revisit", 2, 0), (4, "response", None, 14), (None, "revisit", 1, 4)], key=str)


def test_sidecar_index_and_members(spark, tmp_path):
    """The index beside an archive names each member; each is one record with its mandatory headers."""
    import zlib

    rows = [(i, f"http://h/{i}", None if i % 7 == 3 else f"<p>{i % 5}</p>" * (1 + i % 3)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    raw, clean = f"file://{tmp_path}/raw", f"file://{tmp_path}/clean"
    archives = warc.write_archives(warc.mark_revisits(pages), raw)
    index = warc.normalise(archives, raw, clean)
    assert sorted(index.collect()) == sorted(warc.read_sidecars(archives, clean).collect())
    for name, own in index.toPandas().groupby("archive"):
        data, end = (tmp_path / "clean" / name).read_bytes(), 0
        for r in own.sort_values("offset").itertuples():
            assert r.offset == end
            end += r.length
            d = zlib.decompressobj(31)
            body = d.decompress(data[r.offset : end])
            assert d.eof and not d.unused_data
            ((fields, record),) = warc.records(iter([body]))
            assert record == body and fields["warc-record-id"] == r.record_id
            assert {"warc-type", "warc-date", "warc-record-id", "content-length"} <= set(fields)
        assert end == len(data)


def test_inflating_in_bounded_chunks():
    import gzip
    import io

    body = b"a" * (3 << 20) + bytes(range(256)) * 50
    packed = gzip.compress(body) + gzip.compress(b"second")
    parts = list(warc.inflate(io.BytesIO(packed)))
    assert b"".join(parts) == body + b"second" and max(map(len, parts)) <= warc.CHUNK


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("layout", [{"order": ">"}, {"tile": (16, 32)}, {"predictor": 1, "rows_per_strip": 5}])
def test_tiff_round_trip(compression, layout):
    r = np.random.default_rng(2)
    images = [r.integers(0, 9, (50, 70), np.uint8), r.integers(0, 60000, (20, 33), np.uint16), np.full((40, 40, 3), 7, np.uint8), r.integers(0, 255, (90, 90), np.uint8)]
    back = list(tiff.pages(tiff.encode(images, compression, **layout)))
    assert all(np.array_equal(a if a.ndim == 3 else a[:, :, None], b) for a, b in zip(images, back, strict=True))


def test_text_images(spark):
    import hashlib

    texts = ["abc", None, "ü" * 400_000, "abc"]
    got = {r.doc_id: r for r in tiff.read_features(tiff.store_texts(make(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), crc32(raw[-32:]))
    assert got[0][1:] == got[3][1:]


def test_broken_tiff_files_are_rows(spark):
    import struct

    def with_tag(tag, value):
        raw = bytearray(good)
        at = struct.unpack_from("<I", raw, 4)[0]
        for i in range(struct.unpack_from("<H", raw, at)[0]):
            if struct.unpack_from("<H", raw, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<I", raw, at + 10 + 12 * i, value)
        return bytes(raw)

    good = tiff.encode([np.arange(200, dtype=np.uint8).reshape(10, 20)])
    broken = [b"no", with_tag(tiff.WIDTH, 0), with_tag(tiff.WIDTH, 1 << 31), with_tag(tiff.ROWS_PER_STRIP, 0), with_tag(tiff.STRIP_OFFSETS, 1 << 30), with_tag(tiff.COMPRESSION, 7), good[:40], good[:9]]
    files = spark.createDataFrame([*enumerate([*map(bytearray, broken), bytearray(good)]), (99, None)], "k int, media binary")
    got = tiff.decode(files, "k").collect()
    assert sorted((r.k, r.page) for r in got) == [*((i, -1) for i in range(len(broken))), (len(broken), 0)]
    assert all(r.error for r in got if r.page < 0)


def test_columns_that_clash_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the one and only text", "x", 7.0), (2, None, "y", 8.0)], DOCS + ", lang_pred string, score double")
    found = langid.identify(docs, langid.learn(docs.withColumn("lang", F.lit("en"))), keep_text=True)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"] and sorted((r.doc_id, r.lang_pred) for r in found.collect()) == [(1, "en"), (2, "und")]
    scored = quality.score(docs, quality.train([], np.zeros(0)))
    assert sorted(map(tuple, scored.collect())) == [(1, "x", 0.5), (2, "y", 0.5)]


@pytest.mark.parametrize(("block", "run"), [(500, 256), (1 << 20, 7)])
def test_lm_against_a_plain_backoff_walk(spark, monkeypatch, block, run):
    """Word by word: the state is what is known of the last two words; without an arc the failure arc is paid."""
    monkeypatch.setattr(lm.Automaton.walk, "__defaults__", (run,))
    texts = corpus(6, 40, 40)
    held = [i % 4 == 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], DOCS + ", held_out boolean")
    seqs = [["<s>", *words_of(t), "</s>"] for t in texts]
    uni, two, three, ctx = Counter(), Counter(), Counter(), Counter()
    for s, h in zip(seqs, held, strict=True):
        if not h:
            uni.update(s[1:])
            ctx.update(s[:-1])
            two.update(zip(s, s[1:], strict=False))
            three.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    p2 = lambda u, w: (two[u, w] + lm.K2 * p1(w)) / (ctx[u] + lm.K2)
    paid = 0
    for r in lm.score(docs, block=block).collect():
        s = seqs[r.doc_id]
        full, state = 0.0, ("<s>",)
        for w in s[1:]:
            if len(state) == 2:
                if three[(*state, w)]:
                    full += log10((three[(*state, w)] + lm.K3 * p2(state[1], w)) / (two[state] + lm.K3))
                    state = (state[1], w) if two[state[1], w] >= lm.SEEN else (w,)
                    continue
                full += log10(lm.K3 / (two[state] + lm.K3))
                state, paid = state[1:], paid + 1
            if two[(*state, w)]:
                full += log10(p2(*state, w))
                state = (*state, w) if two[(*state, w)] >= lm.SEEN else (w,)
                continue
            full += log10(lm.K2 / (ctx[state[0]] + lm.K2)) + log10(p1(w))
            state, paid = (w,), paid + 1
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s) - 1, sum(uni[w] > 0 for w in s[1:]), n)
        assert abs(r.base_score - sum(log10(p1(w)) for w in s[1:])) < 1e-6 and abs(r.score - full) < 1e-6
    assert paid > 20


def test_language_id_and_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.identify(docs.where("doc_id % 3 = 1"), langid.learn(docs.where("doc_id % 3 != 1"))).select("doc_id", "lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    labels = spark.read.parquet(f"{base}/labels.parquet")
    net = quality.train(*quality.sample(docs, labels.where("doc_id % 5 != 0")))
    test = quality.score(docs.where("doc_id % 5 = 0").select("doc_id", "text"), net).join(labels, "doc_id").toPandas()
    rank, one = test["score"].rank(), test["quality"] == 1
    assert (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum()) > 0.8


def test_quality_does_not_depend_on_the_next_text():
    """Equal texts before different ones, and at a block's end."""
    net = quality.Net()
    net.p["b"] += 1
    r = np.random.default_rng(5)
    own = r.integers(97, 123, 252, np.uint8).tobytes()
    got = []
    for i in range(40):
        data = own + r.integers(1, 255, 300, np.uint8).tobytes() * (i > 0)
        got.append(net.score(np.frombuffer(data, np.uint8), np.array([0, len(own), len(data)] if i else [0, len(own)]))[0])
    assert len(set(got)) == 1


def test_equal_texts_get_equal_answers_whatever_stands_beside_them(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names, protos = langid.learn(docs)
    net = quality.train(*quality.sample(docs, spark.read.parquet(f"{base}/labels.parquet")))
    own = "the same text in many blocks, that is all there is to say of it".encode()
    r = np.random.default_rng(3)
    scores, vectors = set(), set()
    for n in range(12):
        others = [r.integers(97, 123, int(r.integers(0, 3000)), np.uint8).tobytes() for _ in range(n)]
        texts = [*others[: n // 2], own, *others[n // 2 :]]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        scores.add(float(net.score(data, offsets)[n // 2]))
        vectors |= {v[n // 2 - lo].tobytes() for lo, hi, v, _ in langid.text_vectors(data, offsets) if lo <= n // 2 < hi}
    assert len(scores) == len(vectors) == 1 and protos.dtype == np.int64


def test_trigrams_in_slices(monkeypatch):
    """Many different letters are bound in slices, with the sums of the whole."""
    r = np.random.default_rng(4)
    texts = ["".join(map(chr, r.integers(0x3B1, 0x3F0, n))).encode() for n in (5000, 3, 0, 900)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ((_, _, whole, _),) = langid.text_vectors(data, offsets)
    monkeypatch.setattr(langid, "SLICE", 100)
    monkeypatch.setattr(langid, "ROWS", 3)
    parts = np.concatenate([v for _, _, v, _ in langid.text_vectors(data, offsets)])
    assert np.array_equal(whole, parts)
    a, b, c = langid.letter_vectors()
    kinds = [0, *(langid.letter_classes()[ord(ch)] for ch in texts[1].decode()), 0]
    plain = sum(a[kinds[i]] * b[kinds[i + 1]] * c[kinds[i + 2]] for i in range(len(kinds) - 2))
    assert np.array_equal(whole[1], plain)


ODD = [(1, "some words that are here in a row for all", "a", 1), (1, "some words that are here in a row for all", "a", 1), (None, None, None, None), (None, "null id " * 40, "b", 2), (2, "", "", 3), (3, "long text " * 60_000, "c", 4), (4, "\t \n", "d", 5)]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    """Nulls, repeats, empty and long texts, empty tables and columns whose names clash with inner ones."""
    schema = DOCS + ", n string, block int"
    docs = spark.createDataFrame([] if empty else ODD, schema)
    for c in ("key", "token", "set_key", "seed", "h", "score", "lang", "task", "item"):
        docs = docs.withColumn(c, F.lit("en"))
    n = 0 if empty else len(ODD)
    assert langid.identify(docs.select("doc_id", "text"), langid.learn(docs)).count() == n
    assert ngram_join.join_components(docs).count() == n
    assert packing.pack_documents(docs, *tokenizer_files()).select("doc_id").where("piece = 0").count() == n
    assert tiff.read_features(tiff.store_texts(docs)).count() == n
    assert lm.score(docs.withColumn("held_out", F.lit(None).cast("boolean"))).count() == n
    assert quality.score(docs.select("doc_id", "text"), quality.train([], np.zeros(0))).count() == n
    assert chaining.passages(docs).count() == 0
    assert chaining.without_passages(docs, chaining.passages(docs)).count() == n
    bench = spark.createDataFrame([(0, "null id null id null id"), (None, None)], "item_id bigint, text string")
    assert containment.contained(docs, bench).count() == (0 if empty else 1)
    assert containment.contained(docs, bench.limit(0)).count() == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "key")
    assert extract.extract(pages).count() == n and warc.archive_pages(pages).count() == n


def test_language_id_against_a_plain_loop(spark):
    """Letter by letter: bind, bundle and compare without blocks, slices or packed arrays."""
    a, b, c = langid.letter_vectors()
    classes = langid.letter_classes()

    def bundle(text):
        kinds = [0]
        for ch in text or "":
            k = int(classes[ord(ch)])
            if k or kinds[-1]:
                kinds.append(k)
        kinds += [0] * (kinds[-1] > 0)
        v = np.zeros(langid.DIM)
        for i in range(len(kinds) - 2):
            if kinds[i + 1]:
                v += a[kinds[i]] * b[kinds[i + 1]] * c[kinds[i + 2]]
        return v

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.left("text", F.lit(400)).alias("text"), "lang")
    docs = docs.union(spark.createDataFrame([(10**6, "", "en"), (10**6 + 1, "12 !", "en"), (10**6 + 2, None, "en"), (10**6 + 3, "Straße ñandú", None)], docs.schema))
    rows = docs.collect()
    sums = {}
    for r in rows:
        if r.text is not None and r.lang and any(ch.isalpha() for ch in r.text):
            sums[r.lang] = sums.get(r.lang, 0) + unit(bundle(r.text))
    protos = {k: unit(v) for k, v in sorted(sums.items())}
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), langid.learn(docs)).collect()}
    for r in rows:
        cos = {k: float(unit(bundle(r.text)) @ p) for k, p in protos.items()}
        if not any(ch.isalpha() for ch in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        best = sorted(cos.values())
        assert abs(got[r.doc_id].score - max(0, best[-1])) < 1e-4
        assert best[-1] - best[-2] < 1e-4 or cos[got[r.doc_id].lang_pred] == best[-1]


def test_quality_against_a_plain_convolution():
    """Byte by byte on the settled numbers: windows, chunks, maxima, the mean and the logistic layer."""
    net = quality.Net(3)
    net.p["b"] += 0.2
    emb, w = net.q["emb"].astype(float), net.q["w"].astype(float)
    r = np.random.default_rng(8)
    texts = [r.integers(32, 127, n, np.uint8).tobytes() for n in (0, 1, 7, 251, 252, 253, 256, 508, 509, 700, 1500)]
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, score in zip(texts, got, strict=True):
        halves = max(1, -(-(len(text) + quality.WIDTH - quality.STRIDE) // quality.HOP))
        padded = np.frombuffer(text.ljust(halves * quality.HOP + quality.WIDTH, b"\0"), np.uint8)
        answers = np.array([emb[padded[i : i + quality.WIDTH]].ravel() @ w for i in range(0, halves * quality.HOP, quality.STRIDE)])
        per = quality.HOP // quality.STRIDE
        chunks = [answers[c * per : (c + 2) * per].max(axis=0) for c in range(max(1, halves - 1))]
        h = np.maximum(np.array(chunks) * net.scale + net.p["b"], 0)
        z = np.concatenate([h.mean(axis=0), h.max(axis=0)]) @ net.p["out"] + net.p["bias"][0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_a_plain_loop(rule):
    """Every item looks at every bin ever opened."""
    weights, caps = (1.0, 0.3, 0.2), (100.0, 5.0, 5000.0)
    lengths = np.random.default_rng(2).integers(1, 90, 150)
    bins, offsets = packing.best_fit(lengths, 100, 5, 5000.0, weights, rule)
    left, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        need = (float(lengths[i]), 1.0, float(lengths[i]) ** 2)
        best = None
        for b, have in enumerate(left):
            if all(x >= y for x, y in zip(have, need, strict=True)):
                if rule == "dot":
                    value = -sum(k * (x / c) * (y / c) for k, x, y, c in zip(weights, have, need, caps, strict=True))
                else:
                    value = sum(k * ((x - y) / c) ** 2 for k, x, y, c in zip(weights, have, need, caps, strict=True))
                if best is None or value < best[0] - 1e-12:
                    best = (value, b)
        if best is None:
            left.append(list(caps))
            best = (0, len(left) - 1)
        want[i] = best[1]
        left[best[1]] = [x - y for x, y in zip(left[best[1]], need, strict=True)]
    filled = {}
    for i in np.argsort(-lengths, kind="stable"):
        assert offsets[i] == filled.get(bins[i], 0)
        filled[bins[i]] = offsets[i] + lengths[i]
    assert max(filled.values()) <= 100 and abs(len(filled) - len(left)) <= 1
    assert sum(want[i] == bins[i] for i in range(len(lengths))) >= 0.9 * len(lengths) or len(filled) == len(left)


def test_stored_form_and_feature_against_plain_loops(spark):
    import hashlib
    import io

    texts = ["a", "bright and dark " * 900, "ü" * 5000, None]
    files = {r.doc_id: bytes(r.media) for r in tiff.store_texts(make(spark, texts)).collect()}
    got = {r.doc_id: r for r in tiff.read_features(tiff.store_texts(make(spark, texts))).collect()}
    for i, raw in files.items():
        assert (got[i].media_bytes, got[i].media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        (image,) = tiff.pages(raw)
        a = image[:, :, 0].astype(int)
        h, wide = a.shape
        ys, xs = [k * h // 8 for k in range(9)], [int(k * wide / 9) for k in range(10)]
        cells = [[a[ys[y] : max(ys[y + 1], ys[y] + 1) if h >= 8 else ys[y] + 1, xs[x] : xs[x + 1]].sum() for x in range(9)] for y in range(8)] if h >= 8 else [[a[int(y * (h - 1) / 7), xs[x] : xs[x + 1]].sum() for x in range(9)] for y in range(8)]
        bits = "".join("1" if row[x + 1] > row[x] else "0" for row in cells for x in range(8))
        total, squares, n = int(a.sum()), int((a**2).sum()), a.size
        assert got[i].feature == f"{int(bits, 2):016x}-{total // n}-{(squares - total * total // n) // n}"
        assert io.BytesIO(raw).read(4) == b"II*\0"
