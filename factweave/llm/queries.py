"""One query per operator, over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, containment, extract, langid, lm, mixing, negatives, ngram_join, packing, quality, spelling, tiff, warc
from .shared import crc_mod


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = langid.learn(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), *tokenizer_files())


def tokenizer_files() -> tuple[str, str, str]:
    """Ids' file, the same vocabulary as ranks, and its split pattern."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages")).drop("payload")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_read(spark, sf_dir, "documents"))


def op5_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.read_features(tiff.store_texts(_read(spark, sf_dir, "documents")))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 7) == 2))


def op7_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(_read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_read(spark, sf_dir, "pages"))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    labels = _read(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    net = quality.train(*quality.sample(docs.where("not held_out"), labels))
    scored = quality.score(docs.select("doc_id", "held_out", "text"), net)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").where(negatives.usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return negatives.mine(rows.select("vec_id", label.alias("label"), whole.alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_best_fit_packing, op3_warc_normaliser, op4_ngram_join, op5_tiff_pages, op6_backoff_lm, op7_collinear_chaining, op8_html_extraction, op9_quality_cnn, op10_containment_search, op11_systematic_mixing, op12_spelling_variants, op13_hard_negatives)
}

#: Words and shingles as the contracts of ops 4 and 10 define them.
_SHINGLES = r"""
    SELECT {keys}, list_filter(regexp_split_to_array({lowered}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL
"""
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WINDOWS = "SELECT DISTINCT {keys}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM {words}"

ORACLE_SQL: dict[str, str] = {
    "op3_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_page FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST(concat('0x', substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first_page THEN first_page END AS refers_to
        FROM d
    """,
    "op4_ngram_join": f"""
        WITH RECURSIVE words AS ({_SHINGLES.format(keys="doc_id", lowered=_ASCII_LOWER, table="documents")}),
        sets AS ({_WINDOWS.format(keys="doc_id", words="words")}),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
        roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN roots USING (doc_id)
    """,
    "op11_systematic_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
        w AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {list(mixing.WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER)] AS weight FROM d GROUP BY source),
        o AS (SELECT *, sum({mixing.MOST} * source_size) OVER full_first - {mixing.MOST} * source_size AS taken, sum(weight) OVER () - sum(weight) OVER full_first + weight AS free, sum(source_size) OVER () AS total
            FROM w WINDOW full_first AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT CAST(total - taken AS DOUBLE) AS rest, CAST(free AS DOUBLE) AS free FROM o WHERE CAST(total - taken AS DOUBLE) * weight / free <= {mixing.MOST} * source_size ORDER BY taken LIMIT 1),
        t AS (SELECT source, source_size, least(rest * weight / free, CAST({mixing.MOST} * source_size AS DOUBLE)) AS target, CAST(concat('0x', substr(md5(concat('1:', coalesce(source, ''))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS drawn FROM w, l),
        p AS (SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        k AS (SELECT p.*, k, CAST(least(floor(rate * (i + 1) + (drawn + k / CAST({mixing.OFFSETS} AS DOUBLE))) - floor(rate * i + (drawn + k / CAST({mixing.OFFSETS} AS DOUBLE))), {mixing.MOST}) AS BIGINT) * size AS taken FROM p, range({mixing.OFFSETS}) AS r(k)),
        b AS (SELECT DISTINCT ON (source) source, k FROM (SELECT source, k, any_value(target) AS target, sum(taken) AS s FROM k GROUP BY source, k) ORDER BY source, abs(s - target), k)
        SELECT doc_id, size, source_size, target, taken FROM k JOIN b ON k.k = b.k AND k.source IS NOT DISTINCT FROM b.source
    """,
    "op12_spelling_variants": rf"""
        WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
        runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
        summed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, CAST(flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS BIGINT[])),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h FROM runs, crc WHERE length(run) >= {spelling.LETTERS}),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {spelling.DELETE} = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM summed) WHERE length(word) >= {spelling.LETTERS} GROUP BY word HAVING sum(n) >= {spelling.SEEN}),
        cut AS (SELECT word, n, p, concat(substr(word, 1, p - 1), substr(word, p + 1)) AS k FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM words)),
        one AS (SELECT DISTINCT word, n, k FROM cut),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.k = b.k AND a.p = b.p AND a.word <> b.word
            UNION ALL SELECT a.word, a.n, one.word, one.n FROM words a JOIN one ON a.word = one.k UNION ALL SELECT one.word, one.n, a.word, a.n FROM words a JOIN one ON a.word = one.k),
        best AS (SELECT DISTINCT ON (word) word, CASE WHEN m >= {spelling.TIMES} * n THEN other END AS form, CASE WHEN m >= {spelling.TIMES} * n THEN m END AS form_n FROM near ORDER BY word, m DESC, other),
        sizes AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
        way(word, root, step) AS (SELECT word, form, 1 FROM best WHERE form IS NOT NULL UNION ALL SELECT way.word, best.form, step + 1 FROM way JOIN best ON best.word = way.root WHERE best.form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
        SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n FROM words w LEFT JOIN best USING (word) LEFT JOIN sizes USING (word) LEFT JOIN ends USING (word)
    """,
    "op13_hard_negatives": f"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {negatives.POSITIVES}),
        n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same WHERE {negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.score)
        SELECT * FROM n WHERE rank <= {negatives.NEGATIVES}
    """,
    "op10_containment_search": f"""
        WITH dw AS ({_SHINGLES.format(keys="doc_id", lowered="lower(text)", table="documents")}),
        iw AS ({_SHINGLES.format(keys="item_id", lowered="lower(text)", table="benchmark")}),
        d AS ({_WINDOWS.format(keys="doc_id", words="dw")}), i AS ({_WINDOWS.format(keys="item_id", words="iw")}),
        n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_found FROM d JOIN i USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
    """,
}
