"""Reports read by columns and counted at once: the same rows as item by item, nothing sent whole through the driver."""

import json

from pyspark.sql import functions as F

from factweave.operators import checks, persist, report, series
from factweave.plans import reports
from factweave.sources import extraction
from factweave.sources.commits import Store

CHUNKS = "doc_id bigint, chunk_idx int, payload string"
ODD = [
    '```json\n{"identity":{"companyName":" Co ","isin":7,"identityQuote":" q ","identityPage":"p. 9"},"metrics":[{"label":" L ","rawValue":5,"period":null,"classificationCode":"e","sourcePage":2},null,"x",{"label":[]},{"rawValue":1e21,"sourcePage":true},{"sourcePage":1e999},{"label":"kept","sourcePage":2.5}]}\n``` ',
    '{"valuation":{"cmp":100,"rating":" BUY","baseTarget":1.50,"valuationPage":3},"risks":"none","sections":[{"heading":"\\ud800","summary":"\\u00e9","sourceQuote":" s "}]}',
    '{"identity":[],"metrics":[{"label":"lost with its chunk"}]}',
    '{"valuation":{"rating":{}},"risks":[{"name":"lost with its chunk"}]}',
    '{"identity":{"companyName":"a","companyName":"b"}}',
    '{"identity":null,"metrics":{},"catalysts":[{"name":"C","expectedPeriod":"FY25","direction":"up"},{"name":"c","sourceQuote":3}],"thesisPoints":[{"title":"T","explanation":"because"}]}',
    '{"metrics":[{"label":"twice"}]} {}',
    "[1]",
    "```",
    "",
    None,
    "{}",
]


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_rows_by_columns_are_those_of_each_chunk(spark):
    given = [(i // 3, i, t) for i, t in enumerate(ODD + [json.dumps({"metrics": [{"label": "m"}] * 2})] * 1100 + ODD)]
    chunks = spark.createDataFrame(given, CHUNKS).coalesce(1)
    read = extraction.read_chunks(chunks).persist()
    place = ["doc_id", "chunk_idx", "kind", "item_idx", "title", "body", "period", "code", "category", "quote", "page"]
    rows = [tuple(r) for r in extraction.read_rows(chunks).where("identity is null and valuation is null").select(place).collect()]
    want = [tuple(r) for r in extraction.read_items(read).select(place).collect()]
    assert len(rows) > 2200 and sorted(rows, key=repr) == sorted(want, key=repr)
    for kind, names in (("identity", extraction.IDENTITY_FIELDS), ("valuation", extraction.VALUATION_FIELDS)):
        fields = [F.col(kind)[f].alias(f) for f in names]
        got = extraction.read_rows(chunks, kinds=(kind,)).select("chunk_idx", *fields, "quote", "page").collect()
        told = read.where(F.col(kind).isNotNull()).select("chunk_idx", *fields, F.col(kind)[f"{kind}Quote"].alias("quote"), extraction.page(F.col(kind)[f"{kind}Page"]).alias("page")).collect()
        assert len(got) == 2 and sorted(map(tuple, got)) == sorted(map(tuple, told))


def _made(spark):
    payload = json.dumps({"identity": {"companyName": "Co"}, "valuation": {"rating": "BUY", "cmp": 5, "baseTarget": "-1"}, "metrics": [{"label": "EBITDA", "rawValue": "Rs 5 Cr", "period": "FY24"}, {"label": "EBITDA", "rawValue": "US$ 7 mn", "period": "FY25"}]})
    chunks = spark.createDataFrame([(1, 0, payload), (2, 0, None)], CHUNKS)
    pages = spark.createDataFrame([(1, 1, "p")], "doc_id bigint, page int, text string")
    docs = spark.createDataFrame([(1, False), (2, True), (3, False)], "doc_id bigint, is_partial boolean")
    return chunks, pages, docs


def test_a_summary_is_one_aggregate(spark):
    made = report.assemble(*_made(spark), spark.createDataFrame([(1, 4)], "document_id bigint, version int"), 2026)
    assert "Join" not in _plan(made.summary)
    got = {r.doc_id: (r.n_metrics, r.n_charts, r.n_issues, r.n_blockers, r.version, r.status, r.tier) for r in made.summary.collect()}
    assert got == {1: (2, 1, 6, 5, 5, "REVIEW_REQUIRED", "POOR"), 2: (0, 0, 8, 8, 1, "PARTIAL", "POOR"), 3: (0, 0, 8, 8, 1, "REVIEW_REQUIRED", "POOR")}


def test_first_values_and_series_need_no_join(spark):
    rows = [("a", "revenue", "FY24", "A", i, v, "INR", "crore", 240) for i, v in enumerate(("5", "5", "9"))]
    metrics = spark.createDataFrame(rows, "doc_id string, taxonomy_key string, period string, classification_code string, ord int, v string, currency string, scale string, period_sort_key int").withColumn("value", F.col("v").cast("decimal(20,4)"))
    others, points = checks.contradictions(metrics, ["doc_id"]), series.charted(metrics, "doc_id")
    assert "Join" not in _plan(others) + _plan(points)
    assert [(r.ord, r.first_value, r.other_value) for r in others.collect()] == [(2, 5.0, 9.0)] and points.count() == 3


def test_a_commit_sends_no_table_through_the_driver(spark, tmp_path, monkeypatch):
    store, staged, stage = Store(spark, f"file://{tmp_path}/s"), {}, Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, name, rows, by=None: (staged.setdefault(name, _plan(rows)), stage(self, name, rows, by))[1])
    persist.second_contract(store, "run", *_made(spark), 2026, "m")
    assert len(staged) > 8 and not [name for name, plan in staged.items() if "Broadcast" in plan]


def test_metrics_are_read_alone_and_nothing_is_written_between(spark, tmp_path):
    row = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(k, n, n, 1, 5.0, "A", "O") for k in range(1, 4) for n in range(1, 8)], row).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = reports.report_metrics(spark, str(tmp_path))
    assert _plan(found).count("FileScan") == 2 and _plan(found).count("MapInArrow") == 1
    assert found.count() == 12
