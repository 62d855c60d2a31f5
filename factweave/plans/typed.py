"""JSON whose values have wrong types, read as the contracts want it; the SQL judges the same texts by their JSON types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import extraction, typed
from ..sources.scratch import stored
from .registry import query, spread, table

_WRONG = ('{"v":1}', "true", "[1]")


def _token(value: Column, field: int) -> Column:
    """A field's token; in one field of most lines a value that no text or number can be."""
    wrong = F.get(F.array(*map(F.lit, _WRONG)), (F.col("l_suppkey") % 3).cast("int"))
    return F.when(F.col("l_partkey") % 11 == field, wrong).otherwise(value)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def metric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk of JSON for each order, a metric for each of its lines."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("n", F.row_number().over(by))
    n, k, price = F.col("n"), F.col("l_partkey"), F.col("l_extendedprice").cast("string")
    label = F.when(n % 3 == 0, F.col("l_quantity").cast("string")).when(n % 3 == 1, _quoted(F.concat(F.lit(" "), "l_returnflag", "l_linestatus", F.lit(" ")))).otherwise("null")
    raw = F.when(n % 2 == 0, price).otherwise(_quoted(F.concat(F.lit("Rs "), price)))
    period = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"period":'), _token(_quoted(F.date_format("l_shipdate", "yyyy")), 2)))
    code = F.when(k % 4 == 0, F.lit(5).cast("string")).otherwise(_quoted(F.lower("l_returnflag")))
    quote = _quoted(F.concat(F.lit('say \\"'), "l_returnflag", F.lit('\\" \\\\ on '), F.date_format("l_shipdate", "yyyy-MM-dd")))
    page = F.when(k % 6 == 0, _quoted(F.concat(F.lit("p. "), n.cast("string"), F.lit("-"), (n + 1).cast("string")))).when(k % 6 == 1, F.concat(n.cast("string"), F.lit(".5"))).when(k % 6 == 2, _quoted(F.lit("none"))).when(k % 6 == 3, "null").otherwise(n.cast("string"))
    item = F.concat(F.lit('{"label":'), _token(label, 0), F.lit(',"rawValue":'), _token(raw, 1), period, F.lit(',"classificationCode":'), _token(code, 3), F.lit(',"sourceQuote":'), _token(quote, 5), F.lit(',"sourcePage":'), _token(page, 6), F.lit("}"))
    grouped = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))), lambda r: r["item"]), ",").alias("items"))
    d = F.col("doc_id") % 13
    identity = F.when(d == 0, '{"companyName":{}}').when(d == 1, '{"companyName":7,"identityPage":"iv"}').otherwise("null")
    payload = F.concat(F.lit('```json\n{"identity":'), identity, F.lit(',"metrics":['), "items", F.lit(']}'), F.when(d == 2, " and so on").otherwise(""), F.lit("\n```"))
    return grouped.select("doc_id", payload.alias("payload"))


#: The same texts in SQL; ``m`` has a row for each metric with its place in the array.
_CHUNKS_SQL = r"""
    l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, ['{"v":1}', 'true', '[1]'][CAST(l_suppkey % 3 + 1 AS INTEGER)] AS wrong, l_partkey % 11 AS f FROM lineitem),
    t AS (SELECT l_orderkey AS doc_id, n, concat('{"label":', CASE WHEN f = 0 THEN wrong WHEN n % 3 = 0 THEN CAST(l_quantity AS VARCHAR) WHEN n % 3 = 1 THEN concat('" ', l_returnflag, l_linestatus, ' "') ELSE 'null' END,
        ',"rawValue":', CASE WHEN f = 1 THEN wrong WHEN n % 2 = 0 THEN CAST(l_extendedprice AS VARCHAR) ELSE concat('"Rs ', l_extendedprice, '"') END,
        CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat(',"period":', CASE WHEN f = 2 THEN wrong ELSE concat('"', year(l_shipdate), '"') END) END,
        ',"classificationCode":', CASE WHEN f = 3 THEN wrong WHEN l_partkey % 4 = 0 THEN '5' ELSE concat('"', lower(l_returnflag), '"') END,
        ',"sourceQuote":', CASE WHEN f = 5 THEN wrong ELSE concat('"say \"', l_returnflag, '\" \\ on ', strftime(l_shipdate, '%Y-%m-%d'), '"') END,
        ',"sourcePage":', CASE WHEN f = 6 THEN wrong WHEN l_partkey % 6 = 0 THEN concat('"p. ', n, '-', n + 1, '"') WHEN l_partkey % 6 = 1 THEN concat(n, '.5') WHEN l_partkey % 6 = 2 THEN '"none"' WHEN l_partkey % 6 = 3 THEN 'null' ELSE CAST(n AS VARCHAR) END, '}') AS item FROM l),
    c AS (SELECT doc_id, CAST(concat('{"identity":', CASE doc_id % 13 WHEN 0 THEN '{"companyName":{}}' WHEN 1 THEN '{"companyName":7,"identityPage":"iv"}' ELSE 'null' END, ',"metrics":[', string_agg(item, ',' ORDER BY n), ']}') AS JSON) AS body FROM t GROUP BY doc_id),
    ok AS (SELECT * FROM c WHERE doc_id % 13 <> 2 AND NOT coalesce(json_type(body, '$.identity.companyName') = 'OBJECT', false)),
    m AS (SELECT doc_id, i, json_extract(body, concat('$.metrics[', i, ']')) AS m FROM ok, range(1000) AS r(i) WHERE i < json_array_length(body, '$.metrics')),
    good AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx FROM m WHERE len(list_filter(['label', 'rawValue', 'period', 'classificationCode', 'sourceQuote', 'sourcePage'], lambda k: json_type(m, concat('$.', k)) IN ('OBJECT', 'ARRAY', 'BOOLEAN'))) = 0)
"""


@query(rf"""WITH {_CHUNKS_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, coalesce(regexp_replace(trim(m ->> '$.label'), '\.0$', ''), '') AS label, coalesce(regexp_replace(m ->> '$.rawValue', CASE WHEN json_type(m, '$.rawValue') = 'VARCHAR' THEN '$^' ELSE '\.0$' END, ''), '') AS raw_value,
    m ->> '$.period' AS period, CASE WHEN upper(m ->> '$.classificationCode') IN ('A', 'R', 'P', 'G', 'E', 'C', 'S', 'U') THEN upper(m ->> '$.classificationCode') ELSE 'U' END AS code, m ->> '$.sourceQuote' AS quote,
    CASE WHEN json_type(m, '$.sourcePage') = 'VARCHAR' THEN TRY_CAST(regexp_extract(m ->> '$.sourcePage', '[0-9]+') AS INTEGER) WHEN json_type(m, '$.sourcePage') IN ('UBIGINT', 'BIGINT') THEN CAST(m ->> '$.sourcePage' AS INTEGER) END AS page FROM good""")
def typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of chunks in which fields are texts, numbers, null, missing, flags, arrays or objects: what conforms is kept, item by item."""
    read = extraction.read_items(extraction.read_chunks(metric_chunks(spark, sf_dir)), ("metric",))
    return read.select("doc_id", F.col("item_idx").alias("idx"), F.col("title").alias("label"), F.col("body").alias("raw_value"), "period", "code", "quote", "page")


@query(f"""WITH {_CHUNKS_SQL} SELECT c.doc_id, ok.doc_id IS NOT NULL AS conforms, CASE WHEN ok.doc_id IS NOT NULL THEN ok.body ->> '$.identity.companyName' END AS company, CAST(coalesce(a.n, 0) AS BIGINT) AS n_items, CAST(coalesce(b.n, 0) AS BIGINT) AS n_kept
    FROM c LEFT JOIN ok USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM good GROUP BY doc_id) b USING (doc_id)""")
def typed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks conform as a whole, and how many of their metrics do."""
    chunks = metric_chunks(spark, sf_dir)
    read = stored(extraction.read_chunks(chunks), "typed-chunks")
    whole = read.select("doc_id", "conforms", F.col("identity.companyName").alias("company"), F.coalesce(F.col("body.given.metrics"), F.lit(0)).cast("bigint").alias("n_items"))
    kept = extraction.read_items(read, ("metric",)).groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    return whole.join(kept, "doc_id", "left").fillna(0, ["n_kept"])


_LEGACY_SQL = r"""
    t AS (SELECT o_orderkey AS id, CAST(concat('{"title":', CASE o_orderkey % 5 WHEN 0 THEN '[1]' WHEN 1 THEN CAST(o_totalprice AS VARCHAR) ELSE concat('" ', o_orderpriority, ' "') END,
        ',"metrics":[{"name":"a","isHistorical":', ['true', '"true"', '1', 'null'][CAST(o_custkey % 4 + 1 AS INTEGER)], ',"page":"', o_custkey, 'e-1 pp"},{"name":"b","page":', ['false', '"x"', concat(o_custkey, '.25')][CAST(o_orderkey % 3 + 1 AS INTEGER)], '}]',
        ',"sections":[{"title":1.50,"pageReferences":', ['"3"', concat('[', o_custkey, ',"', o_custkey, 'x",null,true,{"a":1}]')][CAST(o_orderkey % 2 + 1 AS INTEGER)], '}]}') AS JSON) AS d FROM orders),
    p AS (SELECT id, d, d -> '$.metrics[0]' AS a, d -> '$.metrics[1]' AS b, d -> '$.sections[0]' AS s FROM t WHERE json_type(d, '$.title') <> 'ARRAY')
"""


@query(rf"""WITH {_LEGACY_SQL} SELECT id, regexp_replace(d ->> '$.title', CASE WHEN json_type(d, '$.title') = 'VARCHAR' THEN '$^' ELSE '\.0$' END, '') AS title,
    concat_ws(';', CASE WHEN coalesce(json_type(a, '$.isHistorical'), 'NULL') IN ('BOOLEAN', 'VARCHAR', 'NULL') THEN concat('a', coalesce(a ->> '$.isHistorical' = 'true', false), CAST(regexp_extract(a ->> '$.page', '^[0-9]+') AS DOUBLE) / 10) END,
        CASE json_type(b, '$.page') WHEN 'DOUBLE' THEN concat('bfalse', b ->> '$.page') WHEN 'VARCHAR' THEN 'bfalse' END) AS metrics,
    CASE WHEN json_type(s, '$.pageReferences') = 'ARRAY' THEN concat('1.5:', s ->> '$.pageReferences[0]', '.0,', s ->> '$.pageReferences[0]', '.0,0.0,0.0,0.0') END AS sections FROM p""")
def typed_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contract with values of wrong types: flags, leading numbers, arrays of anything."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda by, *v: F.get(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in v)), (by % len(v)).cast("int"))
    title = F.when(k % 5 == 0, "[1]").when(k % 5 == 1, F.col("o_totalprice").cast("string")).otherwise(_quoted(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))))
    refs = pick(k, '"3"', F.concat(F.lit("["), c.cast("string"), F.lit(',"'), c.cast("string"), F.lit('x",null,true,{"a":1}]')))
    payload = F.concat(F.lit('as asked {"title":'), title, F.lit(',"metrics":[{"name":"a","isHistorical":'), pick(c, "true", '"true"', "1", "null"), F.lit(',"page":"'), c.cast("string"), F.lit('e-1 pp"},{"name":"b","page":'), pick(k, "false", '"x"', F.concat(c.cast("string"), F.lit(".25"))), F.lit('}],"sections":[{"title":1.50,"pageReferences":'), refs, F.lit("}]} done"))
    rows = extraction.read_legacy(spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("id"), payload.alias("payload"))).where("conforms")
    metrics = F.array_join(F.transform("metrics", lambda m: F.concat(m["name"], m["isHistorical"].cast("string"), F.coalesce(m["page"].cast("string"), F.lit("")))), ";")
    section = F.get("sections", F.lit(0))
    sections = F.concat(section["title"], F.lit(":"), F.array_join(section["pageReferences"].cast("array<string>"), ","))
    return rows.select("id", "title", metrics.alias("metrics"), sections.alias("sections"))


@query(r"""WITH t AS (SELECT event_id, concat('{"event":"', event_type, '","n":', CAST(event_id AS VARCHAR), ',"z":{"a":["', user_id, '",', regexp_replace(CAST(value AS VARCHAR), '\.0$', ''), ',null,', regexp_replace(CAST(CAST(concat(value, 'e3') AS DOUBLE) AS VARCHAR), '\.0$', ''), '],"k":', props, '}}') AS canonical FROM events)
    SELECT event_id, regexp_replace(canonical, '"k": ', '"k":') AS canonical, substr(sha256(regexp_replace(canonical, '"k": ', '"k":')), 1, 32) AS fingerprint FROM t""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events, keys in no order and numbers in odd notations, in canonical form and its fingerprint."""
    value = F.col("value").cast("string")
    text = F.concat(F.lit('{ "z":{"k":'), "props", F.lit(', "a":["'), F.col("user_id").cast("string"), F.lit('",'), value, F.lit("0,null,"), value, F.lit('e3]}, "n":'), F.col("event_id").cast("string"), F.lit(', "event":"'), "event_type", F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t")).select("event_id", F.expr(typed.parsed("t")).alias("v"))
    return rows.select("event_id", F.expr(typed.canonical("v")).alias("canonical"), F.expr(typed.fingerprint("v")).alias("fingerprint"))
