"""Queries on texts and files: values, periods, quotations, chunks, hashes, layout, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import chunks, layout, merge
from ..sources import admission, extraction
from .registry import query, spread, table

AS_OF_YEAR = 2026


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS v2, o_orderkey % 6 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 5 THEN NULL WHEN k = 1 THEN -CAST(v2 AS DOUBLE) / 100 ELSE CAST(v2 AS DOUBLE) / 100 END AS value,
        CASE k WHEN 0 THEN 'INR' WHEN 2 THEN 'USD' END AS currency, CASE k WHEN 0 THEN 'crore' WHEN 2 THEN 'million' END AS scale, CASE k WHEN 3 THEN '%' WHEN 4 THEN 'x' END AS unit FROM o""")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed amounts in six styles, read back."""
    k, v = F.col("o_orderkey") % 6, values.grouped(F.col("o_totalprice").cast("decimal(12,2)"), 2)
    raw = (
        F.when(k == 0, F.concat(F.lit("Rs. "), v, F.lit(" Cr")))
        .when(k == 1, F.concat(F.lit("("), v, F.lit(")")))
        .when(k == 2, F.concat(F.lit("US$ "), v, F.lit(" mn")))
        .when(k == 3, F.concat(v, F.lit("%")))
        .when(k == 4, F.concat(v, F.lit(" times")))
        .otherwise("n/a")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", values.parse_value(raw).alias("p"))
    return rows.select("o_orderkey", F.col("p.value").cast("double").alias("value"), "p.currency", "p.scale", "p.unit")


@query("""WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) % 100 + 2000 AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, o_orderkey % 5 AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN concat('FY', right(CAST(y AS VARCHAR), 2)) WHEN 1 THEN concat('Q', q, 'FY', right(CAST(y AS VARCHAR), 2)) WHEN 2 THEN 'TTM' WHEN 3 THEN concat('FY', right(CAST(y + 1 AS VARCHAR), 2)) END AS label,
        CASE k WHEN 0 THEN 'ANNUAL' WHEN 1 THEN 'QUARTER' WHEN 2 THEN 'TTM' WHEN 3 THEN 'ANNUAL' END AS period_type,
        CAST(CASE k WHEN 0 THEN y * 10 WHEN 1 THEN y * 10 + q WHEN 2 THEN y * 10 + 9 WHEN 3 THEN ((y + 1) % 100 + 2000) * 10 END AS INTEGER) AS sort_key FROM o""")
def parse_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y, q = F.col("o_orderkey") % 5, F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"), F.quarter("o_orderdate").cast("string")
    later = F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0")
    printed = F.when(k == 0, F.concat(F.lit("fy "), y)).when(k == 1, F.concat(q, F.lit("QFY"), y)).when(k == 2, F.concat(F.lit("TTM Mar"), y)).when(k == 3, F.concat(F.lit("FY"), y, F.lit("-"), later, F.lit("E"))).otherwise(F.concat(F.lit("H1FY"), y))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", values.parse_period(printed, AS_OF_YEAR).alias("p"))
    return rows.select("o_orderkey", "p.label", "p.period_type", "p.sort_key")


# Labels with the key each must get, among them those that several patterns match.
LABELS = {
    "Adjusted PAT": "pat_adjusted",
    "PAT margin": "pat_reported",
    "Net profit margin": "pat_reported",
    "Core PAT margin": "net_margin",
    "EBITDA margin": "ebitda_margin",
    "Net debt / EBITDA": "net_debt_ebitda",
    "EBITDA": "ebitda",
    "EBIT": "ebit",
    "Operating profit": "operating_profit",
    "Free cash flow": "fcf",
    "Net sales": "revenue",
    "Order book": "unmapped",
}


def _labels() -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN '{key}'" for i, key in enumerate(LABELS.values())) + " END"


@query(f"WITH l AS (SELECT p_partkey % {len(LABELS)} AS k, count(*) AS n FROM part GROUP BY 1) SELECT {_labels()} AS taxonomy_key, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1")
def taxonomy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % len(LABELS)).cast("int"))
    return table(spark, sf_dir, "part").groupBy(values.taxonomy_key(label).alias("taxonomy_key")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(20,4)) AS v FROM part), f AS (SELECT *, format('{:,}', CAST(round(v, 0) AS BIGINT)) AS g, CAST(round(v, 1) AS DECIMAL(20,1)) AS d FROM p)
    SELECT p_partkey, concat('₹', g, ' cr') AS money, concat('CHF ', g, '/share') AS per_share, concat(format('{:,}', CAST(floor(d) AS BIGINT)), '.', CAST(CAST(d * 10 AS BIGINT) % 10 AS VARCHAR), '%') AS pct,
        concat(format('{:,}', CAST(floor(d) AS BIGINT)), '.', CAST(CAST(d * 10 AS BIGINT) % 10 AS VARCHAR), '×') AS multiple FROM f""")
def format_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_retailprice").cast("decimal(20,4)")
    return table(spark, sf_dir, "part").select("p_partkey", values.format_money(v, F.lit("INR"), F.lit("crore")).alias("money"), values.format_per_share(v, F.lit("CHF")).alias("per_share"), values.format_pct(v).alias("pct"), values.format_multiple(v).alias("multiple"))


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quotes taken from documents in four manners, and the pages they cite."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    piece = F.substring("text", 11, 80)
    k = F.col("doc_id") % 4
    ordered = F.array_join(F.reverse(F.split(piece, " ")), " ")
    quote = F.when(k == 0, piece).when(k == 1, F.upper(F.replace(piece, F.lit(" "), F.lit("  ")))).when(k == 2, ordered).otherwise("zzzz qqqq xxxx")
    # One in nine cites a page that isn't there.
    return pages.select("doc_id", F.when(F.col("doc_id") % 9 == 8, 2).otherwise(1).alias("page"), quote.alias("quote")), pages


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes, pages = _quotes(spark, sf_dir)
    return text.verify_against(quotes, pages, ["doc_id", "page"])


def _canonical_sql(column: str) -> str:
    """The canonical form in SQL, for texts that NFKC leaves as they are (as it does those of the test tables)."""
    steps = [
        ("[\u00ad\u200b-\u200d\u2060\ufeff]", ""),
        ("(\\pL)[-\u2010-\u2013]\\s*\\r?\\n\\s*(\\pL)", "\\1\\2"),
        ("[\u2010-\u2015]", "-"),
        ("[\u2018\u2019\u201a\u201b\u2032]", "''"),
        ("[\u201c-\u201f\u2033]", '"'),
        ("\u2026", "..."),
        ("[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "),
    ]
    for a, b in text.LIGATURES:
        column = f"replace({column}, '{a}', '{b}')"
    for pattern, by in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"lower(trim({column}))"


_CHECKED_SQL = f"""
    d AS (SELECT doc_id, doc_id % 9 = 8 AS lost, doc_id % 4 AS k, text, substr(text, 11, 80) AS piece FROM documents),
    q AS (SELECT doc_id, CASE WHEN lost THEN NULL ELSE text END AS page, trim(coalesce(CASE k WHEN 0 THEN piece WHEN 1 THEN upper(replace(replace(piece, 'ß', 'ss'), ' ', '  ')) WHEN 2 THEN array_to_string(list_reverse(string_split(piece, ' ')), ' ') ELSE 'zzzz qqqq xxxx' END, '')) AS raw FROM d),
    c AS (SELECT doc_id, page, raw, {_canonical_sql("raw")} AS near, {_canonical_sql("coalesce(page, '')")} AS body FROM q),
    t AS (SELECT *, list_filter(string_split(near, ' '), lambda w: length(w) > 2) AS w FROM c),
    s AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(len(list_filter(w, lambda x: contains(body, x))) AS DOUBLE) / len(w) END AS share FROM t),
    checked AS (SELECT doc_id, CASE WHEN near = '' THEN 'UNVERIFIED' WHEN coalesce(page, '') = '' THEN 'UNVERIFIED' WHEN contains(page, raw) THEN 'EXACT_MATCH' WHEN contains(body, near) THEN 'NORMALIZED_MATCH' WHEN share >= 0.8 THEN 'APPROXIMATE_MATCH' ELSE 'UNVERIFIED' END AS status,
        CASE WHEN near = '' THEN NULL WHEN coalesce(page, '') = '' THEN 0.0 WHEN contains(page, raw) OR contains(body, near) THEN NULL ELSE share END AS similarity FROM s)
"""


@query(f"WITH {_CHECKED_SQL} SELECT doc_id, status, CAST(round(similarity, 4) AS DOUBLE) AS similarity FROM checked")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of each quotation against exactly the page it cites."""
    return _checked(spark, sf_dir).select("doc_id", "check.status", F.round("check.similarity", 4).alias("similarity"))


@query(f"WITH {_CHECKED_SQL} SELECT count(*) AS n_quotes, count(*) FILTER (status = 'EXACT_MATCH') AS n_exact FROM checked")
def quote_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quotes among all, whatever their manner."""
    return _checked(spark, sf_dir).agg(F.count("*").alias("n_quotes"), F.count_if(F.col("check.status") == "EXACT_MATCH").alias("n_exact"))


@query(f"""WITH {_CHECKED_SQL}, n AS (SELECT count(*) AS n_quotes, count(*) FILTER (status = 'EXACT_MATCH') AS n_exact, count(*) FILTER (status IN ('EXACT_MATCH', 'NORMALIZED_MATCH')) AS n_verbatim FROM checked)
    SELECT n_quotes, n_exact, n_verbatim, CASE WHEN n_quotes = 0 THEN 0.0 ELSE floor(CAST(n_verbatim AS DOUBLE) / n_quotes * 100 + 0.5) / 100 END AS rate FROM n""")
def quote_verification_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and verbatim-safe quotes among all of them, and their rounded share."""
    status = F.col("check.status")
    return _checked(spark, sf_dir).agg(F.count("*").alias("n_quotes"), F.count_if(status == "EXACT_MATCH").alias("n_exact"), F.count_if(text.verbatim(status)).alias("n_verbatim"), text.verification_rate(status).alias("rate"))


LIMITS = (600, 6, 40)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a line of a document."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")


_CHUNKS_SQL = """
    pages AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, CAST(page AS INTEGER) AS page, concat('--- PAGE ', page, ' ---', chr(10), text) AS body, CAST(length(concat('--- PAGE ', page, ' ---', chr(10), text)) AS INTEGER) AS n FROM pages),
    f(doc_id, page, chunk, chars, m) AS (
        SELECT doc_id, page, 0, CASE WHEN n >= 600 THEN -1 ELSE n + 2 END, 1 FROM p WHERE page = 1
        UNION ALL SELECT p.doc_id, p.page, f.chunk + CASE WHEN p.n >= 600 OR f.chars < 0 OR f.chars + p.n > 600 OR f.m + 1 > 6 THEN 1 ELSE 0 END,
            CASE WHEN p.n >= 600 THEN -1 WHEN f.chars < 0 OR f.chars + p.n > 600 OR f.m + 1 > 6 THEN p.n + 2 ELSE f.chars + p.n + 2 END,
            CASE WHEN p.n >= 600 OR f.chars < 0 OR f.chars + p.n > 600 OR f.m + 1 > 6 THEN 1 ELSE f.m + 1 END
        FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page + 1),
    c AS (SELECT f.doc_id, f.chunk AS chunk_idx, min(f.page) AS s, max(f.page) AS e, string_agg(p.body, chr(10) || chr(10) ORDER BY p.page) AS body FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page WHERE f.chunk < 40 GROUP BY f.doc_id, f.chunk),
    last AS (SELECT doc_id, max(page) AS last FROM p GROUP BY doc_id),
    plan AS (SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(s AS BIGINT) AS page_start, CAST(e AS BIGINT) AS page_end, CAST(length(body) AS BIGINT) AS char_count, left(sha256(concat(s, ':', e, ':', body)), 32) AS input_hash,
        max(e) OVER (PARTITION BY doc_id) < last AS truncated FROM c JOIN last USING (doc_id))
"""


@query(f"WITH RECURSIVE {_CHUNKS_SQL} SELECT * FROM plan")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.plan(_pages(spark, sf_dir), *LIMITS)


@query(f"WITH RECURSIVE {_CHUNKS_SQL} SELECT plan.doc_id, chunk_idx, p.page * 100 AS table_id, p.page FROM plan JOIN p ON p.doc_id = plan.doc_id AND p.page BETWEEN page_start AND page_end WHERE p.page % 5 = 0")
def chunk_tables_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = pages.where("page % 5 = 0").select("doc_id", "page", (F.col("page") * 100).alias("table_id"))
    return chunks.tables_of(chunks.plan(pages, *LIMITS), found)


@query(f"""WITH RECURSIVE {_CHUNKS_SQL} SELECT CASE WHEN chunk_idx % 3 = 0 AND doc_id % 2 = 0 THEN 'reusable' ELSE 'pending' END AS kind, count(*) AS n FROM plan GROUP BY 1""")
def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a run before has finished, and those to do: a semi and an anti join."""
    planned = chunks.plan(_pages(spark, sf_dir), *LIMITS)
    cached = planned.where("chunk_idx % 3 = 0").select("doc_id", "chunk_idx", "input_hash", F.when(F.col("doc_id") % 2 == 0, "DONE").otherwise("FAILED").alias("status"), F.lit("{}").alias("payload"))
    return chunks.reusable(planned, cached).select(F.lit("reusable").alias("kind")).unionByName(chunks.pending(planned, cached).select(F.lit("pending").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey AS id, coalesce(nullif(left(trim(regexp_replace(lower(concat(' ', p_brand, ' / ', p_type, '! ')), '[^a-z0-9]+', '-', 'g'), '-'), 80), ''), 'document') AS slug FROM part),
    r AS (SELECT id, slug, row_number() OVER (PARTITION BY slug ORDER BY id) AS i FROM s) SELECT id, CASE WHEN i = 1 THEN slug ELSE concat(slug, '-', i) END AS slug FROM r""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import versions

    title = F.concat(F.lit(" "), "p_brand", F.lit(" / "), "p_type", F.lit("! "))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.slug(title).alias("slug"))
    return versions.unique_slugs(rows, rows.limit(0))


@query("""SELECT page_id, left(regexp_replace(regexp_extract(url, '[^/\\\\]*$'), '[^A-Za-z0-9._-]', '_', 'g'), 200) AS raw, sha256(coalesce(html, '')) AS checksum,
    left(sha256(concat(page_id, ':', page_id + 1, ':', url)), 32) AS chunk_hash FROM pages""")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.safe_filename(F.col("url"))
    html = F.coalesce("html", F.lit(""))
    empty = F.regexp_extract("url", "[^/\\\\]*$", 0) == ""
    return table(spark, sf_dir, "pages").select("page_id", F.when(empty, "").otherwise(name).alias("raw"), text.checksum(html).alias("checksum"), text.chunk_hash(F.col("page_id"), F.col("page_id") + 1, F.col("url")).alias("chunk_hash"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, sum(length(trim(t))) AS chars, count(*) AS n_pages FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(chars AS BIGINT) AS chars, n_pages, CASE WHEN chars < 50 * n_pages THEN 'OCR_REQUIRED' ELSE 'TEXT_EXTRACTABLE' END AS text_class FROM c""")
def page_text_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.text_class(_pages(spark, sf_dir))


@query("""WITH d AS (SELECT page_id, page_id % 8 AS k, CAST(page_id % 700 AS BIGINT) AS pages FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'BAD_EXTENSION' WHEN 2 THEN 'BAD_MIME' WHEN 3 THEN 'BAD_MAGIC' WHEN 4 THEN 'ENCRYPTED' WHEN 5 THEN 'TRUNCATED' ELSE CASE WHEN pages > 500 THEN 'TOO_MANY_PAGES' ELSE 'ok' END END AS verdict FROM d""")
def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up files around the pages, each with one fault or none."""
    k = F.col("page_id") % 8
    head = F.when(k == 3, "%PNG-1.4\n").otherwise("%PDF-1.4\n")
    tree = F.concat(F.lit("<< /Type /Pages /Kids [] /Count "), (F.col("page_id") % 700).cast("string"), F.lit(" >>\n"))
    tail = F.concat(F.lit("trailer << "), F.when(k == 4, "/Encrypt 5 0 R ").otherwise(""), F.lit(">>\n"), F.when(k == 5, "").otherwise("%%EOF"))
    body = F.when(k == 0, "").otherwise(F.concat(head, tree, tail))
    files = table(spark, sf_dir, "pages").select("page_id", F.when(k == 1, "a.doc").otherwise("a.PDF").alias("name"), F.when(k == 2, "text/html").otherwise("application/pdf").alias("declared_mime"), body.cast("binary").alias("content"))
    return admission.admit(files).select("page_id", "verdict")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages, lines as rows of four items with a little jitter."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", n.alias("l_linenumber"), "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("q"), "l_returnflag", "l_linestatus")
    y = F.col("l_linenumber") * 12 + F.when(F.col("l_linenumber") > 4, 40).otherwise(0)
    cell = lambda n, s, x: F.struct(F.lit(n).alias("n"), s.alias("s"), (F.lit(x) + F.col("l_partkey") % 3).cast("double").alias("x"))
    cells = F.array(cell(0, F.col("q"), 50), cell(1, F.col("l_returnflag"), 100), cell(2, F.col("l_linestatus"), 120), cell(3, F.col("q"), 200))
    flat = li.select(F.col("l_orderkey").alias("doc_id"), y.cast("double").alias("y"), (F.col("l_linenumber") * 10).alias("b"), F.explode(cells).alias("c"))
    return flat.select("doc_id", F.lit(1).alias("page"), (F.col("b") + F.col("c.n")).cast("bigint").alias("item"), F.col("c.s").alias("str"), F.col("c.x").alias("x"), "y", F.lit(10.0).alias("width"), F.lit(8.0).alias("height"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
    SELECT l_orderkey AS doc_id, CAST(n - 1 AS BIGINT) AS line, CAST(50 + l_partkey % 3 AS DOUBLE) AS x, CAST(n * 12 + CASE WHEN n > 4 THEN 40 ELSE 0 END AS DOUBLE) AS y, CAST(210 + l_partkey % 3 AS DOUBLE) AS "right", CAST(4 AS BIGINT) AS n_items,
    concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ' ', l_returnflag, ' ', l_linestatus, ' ', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS text FROM n""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their boxes and texts."""
    return layout.lines(_items(spark, sf_dir)).select("doc_id", "line", "x", "y", "right", "n_items", "text")


@query("""WITH b AS (SELECT l_orderkey AS doc_id, CASE WHEN row_number() OVER (PARTITION BY l_orderkey) > 4 THEN 1 ELSE 0 END AS block FROM lineitem),
    g AS (SELECT doc_id, block, count(*) AS n_rows FROM b GROUP BY doc_id, block HAVING count(*) >= 3)
    SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(n_rows AS INTEGER) AS n_rows, CAST(4 AS BIGINT) AS n_cols, CAST(4 * n_rows AS BIGINT) AS n_cells, CAST(2 * n_rows AS BIGINT) AS n_numeric FROM g""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tables(_items(spark, sf_dir)).drop("page")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS BIGINT) AS chunk_idx, CASE WHEN l_linenumber % 3 = 1 THEN NULL WHEN l_linenumber % 3 = 2 THEN '  ' ELSE l_returnflag END AS a, CASE WHEN l_quantity > 25 THEN l_linestatus END AS b FROM lineitem)
    SELECT doc_id, arg_min(a, (chunk_idx, a)) FILTER (trim(a) <> '') AS a, arg_min(b, (chunk_idx, b)) FILTER (trim(b) <> '') AS b FROM l GROUP BY doc_id""")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n - 1).cast("bigint").alias("chunk_idx"), F.when(n % 3 == 1, None).when(n % 3 == 2, "  ").otherwise(F.col("l_returnflag")).alias("a"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("b"))
    return merge.fill_record(rows, ["doc_id"], ["a", "b"], "chunk_idx")


@query()
def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered fold of the lines' prices per order and flag; a test holds it against a plain loop."""
    tier = F.get(F.array(*map(F.lit, ("UNVERIFIED", "EXACT_MATCH", "NORMALIZED_MATCH"))), (F.col("l_partkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("bigint").alias("chunk_idx"), F.col("l_partkey").alias("item_idx"), F.round(F.col("l_quantity").cast("decimal(20,4)") / 10 + 1000, 1).cast("decimal(20,4)").alias("value"), tier.alias("status"))
    return merge.fold_metrics(rows, ["l_orderkey", "l_returnflag"]).withColumn("value", F.col("value").cast("double")).withColumn("conflicts", F.array_join("conflicts", ","))


@query("""WITH t AS (SELECT conv_id, turn, lower(trim(role)) AS a, left(lower(trim(text)), 120) AS b, CASE WHEN turn % 3 = 2 THEN 4 WHEN turn % 3 = 1 THEN 2 ELSE 1 END AS rank FROM conversations WHERE text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank DESC, conv_id * 1000 + turn) AS r, min(conv_id * 1000 + turn) OVER (PARTITION BY a, b) AS position FROM t)
    SELECT conv_id * 1000 + turn AS ord, position FROM r WHERE r = 1""")
def narrative_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    rows = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "role", "text", F.when(k == 2, "EXACT_MATCH").when(k == 1, "APPROXIMATE_MATCH").otherwise("UNVERIFIED").alias("status"))
    return merge.dedupe_narrative(rows, [], "role", "text", "status", "ord").select("ord", "position")


@query("""SELECT l_orderkey AS doc_id, count(*) AS n_metrics, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unclear FROM lineitem GROUP BY l_orderkey""")
def schema_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON of the lines, some fields missing or of another type, read tolerantly."""
    n = F.col("l_linenumber")
    item = F.concat(F.lit('{"label":'), F.when(n % 4 == 3, "null").otherwise('" Revenue "'), F.lit(',"rawValue":'), F.col("l_quantity").cast("string"), F.lit(',"classificationCode":"'), F.when(n % 2 == 0, "ai").otherwise("a"), F.lit('","sourcePage":"p. 3"}'))
    raw = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list(item), ",").alias("items"))
    fenced = F.concat(F.lit('```json\n{"metrics":['), "items", F.lit("]}\n```"))
    rows = extraction.read_items(extraction.read_chunks(raw.select(F.col("l_orderkey").alias("doc_id"), fenced.alias("payload"))), ("metric",))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_metrics"), F.count_if(F.col("code") == "U").alias("n_unclear"))


@query("""WITH t AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page, l_partkey * 1000 + l_suppkey AS item, l_returnflag AS str, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS up, l_quantity AS w, l_quantity - 10 AS h, l_tax * 100 + 8 AS size, l_discount * 1000 AS tx, l_extendedprice / 200 AS ty FROM lineitem WHERE l_linestatus = 'O'),
    m AS (SELECT *, CASE WHEN up = 1 THEN tx ELSE ty END AS mx, CASE WHEN up = 1 THEN 842 - ty ELSE tx END AS my, CASE WHEN h > 0 THEN h ELSE size END AS high FROM t)
    SELECT doc_id, page, item, str, floor(mx * 100 + 0.5) / 100 AS x, floor((my - high) * 100 + 0.5) / 100 AS y, CASE WHEN page % 3 = 0 THEN 0 ELSE floor(w * 100 + 0.5) / 100 END AS width, floor(high * 100 + 0.5) / 100 AS height, floor(size * 100 + 0.5) / 100 AS font_height, page = 1 AS has_eol FROM m""")
def placed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text matrices composed with the viewports of upright and turned pages."""
    n, size = F.col("l_linenumber"), F.col("l_tax") * 100 + 8
    six = lambda *v: F.array(*((x if isinstance(x, Column) else F.lit(float(x))).cast("double") for x in v))
    viewport = F.when(n % 2 == 1, six(1, 0, 0, -1, 0, 842)).otherwise(six(0, 1, 1, 0, 0, 0))
    text = F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise("")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.cast("int").alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("item"), text.alias("str"), viewport.alias("viewport"),
        six(size, 0, 0, size, F.col("l_discount") * 1000, F.col("l_extendedprice") / 200).alias("transform"), F.when(n % 3 != 0, F.col("l_quantity")).alias("width"), (F.col("l_quantity") - 10).alias("height"), F.when(n == 1, True).alias("has_eol"),
    )
    return layout.placed(raw)
