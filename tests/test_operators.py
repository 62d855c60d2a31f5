import os
import re
import unicodedata
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave import plans
from factweave.operators import checks, chunks, jobs, layout, merge, report, series, versions

SMALL = "/root/testdata/sf0.001"


def test_merge_fold_depends_on_order(spark):
    rows = [(1, 0, 0, "1000", "UNVERIFIED"), (1, 1, 0, "1004", "EXACT_MATCH"), (1, 2, 0, "1100", "EXACT_MATCH"), (1, 3, 0, "1008", "NORMALIZED_MATCH")]
    facts = spark.createDataFrame(rows, "k int, chunk_idx int, item_idx int, v string, status string").withColumn("value", F.col("v").cast("decimal(20,4)"))
    r = merge.fold_metrics(facts, ["k"]).first()
    assert (r.value, r.conflicts, r.n_raw, r.n_duplicates, r.n_conflicts) == (Decimal(1004), [Decimal(1100)], 4, 2, 1)


def test_merge_metrics_against_a_plain_loop(spark):
    """All folds of the query: the holder, its tier, conflicts and duplicates, value by value."""
    rank = {"EXACT_MATCH": 4, "NORMALIZED_MATCH": 3, "UNVERIFIED": 1}
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        value = (Decimal(str(r.l_quantity)) / 10 + 1000).quantize(Decimal("0.1"), ROUND_HALF_UP)
        lines[r.l_orderkey, r.l_returnflag].append((r.l_linenumber, r.l_partkey, value, ("UNVERIFIED", "EXACT_MATCH", "NORMALIZED_MATCH")[r.l_partkey % 3]))
    want = {}
    for key, rows in lines.items():
        rows.sort()
        holder, conflicts, duplicates = rows[0], [], 0
        for r in rows[1:]:
            if abs(r[2] - holder[2]) <= max(r[2], holder[2]) * Decimal("0.005"):
                duplicates += 1
                holder = r if rank[r[3]] > rank[holder[3]] else holder
            else:
                conflicts.append(r[2])
        want[key] = (float(holder[2]), holder[3], [float(c) for c in conflicts], len(rows), duplicates)
    got = {(r.l_orderkey, r.l_returnflag): (r.value, r.status, [float(c) for c in r.conflicts.split(",") if c], r.n_raw, r.n_duplicates) for r in plans.QUERIES["merge_metrics"](spark, SMALL).collect()}
    assert got == want


def test_slugs_differ_from_one_another_and_from_taken_ones(spark):
    titles = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a-2"), (5, "b"), (6, "a-2-2"), (7, "a"), (8, "a-3")]
    got = {r.id: r.slug for r in versions.unique_slugs(spark.createDataFrame(titles, "id int, slug string"), spark.createDataFrame([("b",), ("a-4",)], "slug string")).collect()}
    assert got == {1: "a", 2: "a-5", 3: "a-2", 4: "a-2-3", 5: "b-2", 6: "a-2-2", 7: "a-6", 8: "a-3"}


def test_illegal_transitions_end_the_job(spark):
    legal = spark.createDataFrame([("PARTIAL", "FAILED")], "from_status string, to_status string")
    assert checks.legal_transitions(legal).count() == 1
    broken = legal.union(spark.createDataFrame([("FAILED", "APPROVED")], legal.schema))
    with pytest.raises(Exception, match="illegal transition FAILED to APPROVED"):
        checks.legal_transitions(broken).collect()


def test_report_of_odd_chunks(spark):
    """Null and malformed payloads, missing arrays and quotes, no page: a row for each document, nothing lost."""
    payloads = [(1, 0, None), (2, 0, "not json"), (3, 0, "{}"), (4, 0, '{"metrics":[{"label":"Revenue","rawValue":"Rs 5 Cr"},null,"x"],"risks":"none","identity":null}'), (4, 1, '{"identity":{"companyName":" Co ","identityPage":"p. 9"},"catalysts":[{"name":"C"},{"name":"c "}]}')]
    chunks_ = spark.createDataFrame(payloads, "doc_id bigint, chunk_idx int, payload string")
    pages = spark.createDataFrame([], "doc_id bigint, page int, text string")
    docs = spark.createDataFrame([(i, False) for i in range(1, 6)], "doc_id bigint, is_partial boolean")
    made = report.assemble(chunks_, pages, docs, spark.createDataFrame([], "document_id bigint, version int"), 2026)
    rows = {r.doc_id: r for r in made.summary.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert [(rows[i].n_metrics, rows[i].n_evidence, rows[i].version, rows[i].tier) for i in (1, 4)] == [(0, 0, 1, "POOR"), (1, 0, 1, "POOR")]
    assert [rows[i].n_blockers for i in (1, 4)] == [8, 7]
    assert [(r.kind, r.title) for r in made.narratives.collect()] == [("catalyst", "C")]
    assert report.compact(made.metrics).first().metrics[0].taxonomy_key == "revenue"


def test_page_classes(spark):
    pages = spark.createDataFrame([(1, "x" * 60, None), (2, "x", None), (3, "x" * 60, "broken")], "doc_id int, text string, error string")
    assert {r.doc_id: r.text_class for r in layout.text_class(pages).collect()} == {1: "TEXT_EXTRACTABLE", 2: "OCR_REQUIRED", 3: "CORRUPTED"}


def test_chunk_plan(spark):
    sizes = [40, 40, 40, 150, 30]
    banner = len("--- PAGE 1 ---\n")
    pages = spark.createDataFrame([(1, i + 1, "x" * (n - banner)) for i, n in enumerate(sizes)], "doc_id int, page int, text string")
    got = [(r.page_start, r.page_end, r.truncated) for r in chunks.plan(pages, 100, 2, 10).orderBy("chunk_idx").collect()]
    assert got == [(1, 2, False), (3, 3, False), (4, 4, False), (5, 5, False)]
    assert chunks.plan(pages, 100, 2, 2).where("truncated").count() == 2


def points(spark, rows):
    raw = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "series string, ord bigint, period string, value double, code string")
    return raw, series.densify(series.parsed_points(raw, 2026))


def test_series(spark):
    _, dense = points(spark, [("FY23", 10.0, "A"), ("FY26", 16.0, "E")])
    got = [(r.label, r.value, r.code, r.data_status) for r in dense.orderBy("sort_key").collect()]
    assert got == [("FY23", 10.0, "A", "REPORTED"), ("FY24", None, "U", "SYSTEM_GENERATED_MISSING"), ("FY25", None, "U", "SYSTEM_GENERATED_MISSING"), ("FY26", 16.0, "E", "REPORTED")]
    _, dense = points(spark, [("Q3FY25", 1.0, "A"), ("Q2FY26", 2.0, "A")])
    assert [r.label for r in dense.orderBy("sort_key").collect()] == ["Q3FY25", "Q4FY25", "Q1FY26", "Q2FY26"]
    raw, dense = points(spark, [("FY24", 1.0, "E"), ("FY25", 2.0, "A")])
    assert [r.issue for r in series.series_issues(raw, dense, 2026).collect()] == ["CHART_FORECAST_BEFORE_ACTUAL"]
    raw, dense = points(spark, [("FY24", 1.0, "A"), ("Q1FY25", 2.0, "A")])
    assert [r.issue for r in series.series_issues(raw, dense, 2026).collect()] == ["CHART_MIXED_PERIOD_TYPES"] and dense.count() == 2


def limit_loop(rows, most, span):
    out, kept = {}, defaultdict(list)
    for key, i, us in sorted(rows, key=lambda r: (r[2], r[1])):
        out[(key, i)] = sum(t > us - span for t in kept[key]) < most
        if out[(key, i)]:
            kept[key].append(us)
    return out


def test_rate_limit_and_duplicates_in_batch_and_stream(spark, tmp_path):
    from factweave.streaming import stateful

    events = spark.read.parquet(f"{SMALL}/events.parquet").select((F.col("user_id") % 3).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    # An hour of the events' month becomes a minute.
    events = events.withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 60).cast("bigint")))
    rows = [(r.key, r.id, r.us) for r in events.select("key", "id", F.unix_micros("ts").alias("us")).collect()]
    expected = limit_loop(rows, 5, 600_000_000)
    assert 0 < sum(expected.values()) < len(expected)
    assert {(r.key, r.id): r.accepted for r in jobs.rate_limited(events, "key").collect()} == expected
    once = limit_loop(rows, 1, 60_000_000)
    assert {(r.key, r.id): r.accepted for r in jobs.duplicates(events, ["key"]).collect()} == once
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, made, want in (("limited", stateful.rate_limit_stream(stream), expected), ("deduped", stateful.suppress_duplicates_stream(stream), once)):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {(int(r.key), r.id): r.accepted for r in spark.table(name).collect()} == want


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    got, want = plans.QUERIES[name](spark, SMALL).toPandas(), c.sql(plans.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    rows = lambda d: sorted(repr(tuple(plain(v) for v in r)) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_quote_verification_rate_against_brute_force(spark):
    """All four manners of quoting are checked, by a plain loop."""
    from factweave.functions import text

    def canonical(s):
        s = unicodedata.normalize("NFKC", s)
        for a, b in text.LIGATURES:
            s = s.replace(a, b)
        s = re.sub("[\u00ad\u200b-\u200d\ufeff\u2060]", "", s)
        s = re.sub(r"([^\W\d_])[-\u2010-\u2013]\s*\n\s*([^\W\d_])", r"\1\2", s)
        s = re.sub("[\u2010-\u2015]", "-", s)
        for marks, one in (("\u2018\u2019\u201a\u201b\u2032", "'"), ("\u201c\u201d\u201e\u201f\u2033", '"')):
            s = re.sub(f"[{marks}]", one, s)
        return re.sub(r"\s+", " ", s).strip(" ").lower()

    n = exact = ok = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n += 1
        piece = (r.text or "")[10:90]
        quote = [piece, piece.replace(" ", "  ").upper(), " ".join(piece.split(" ")[::-1]), "zzzz qqqq xxxx"][r.doc_id % 4].strip(" ")
        if r.doc_id % 9 == 8 or not r.text or not canonical(quote):
            continue
        exact += quote in r.text
        ok += quote in r.text or canonical(quote) in canonical(r.text)
    got = plans.QUERIES["quote_verification_rate"](spark, SMALL).first()
    assert exact == plans.QUERIES["quote_rate"](spark, SMALL).first().n_exact  # all quotes, not a part of them
    assert (got.n_quotes, got.n_exact, got.n_verbatim, got.rate) == (n, exact, ok, int(ok / n * 100 + 0.5) / 100)
    assert spark.createDataFrame([], "s string").agg(text.verification_rate(F.col("s"))).first()[0] == 0


def test_claims_and_upside(spark):
    from factweave.operators import claims

    n = spark.createDataFrame([("a", 0, "20")], "claim_id string, n int, literal string").withColumn("number", F.col("literal").cast("decimal(20,4)"))
    v = spark.createDataFrame([("a", Decimal(120), Decimal(100))], "claim_id string, base_target decimal(20,4), cmp decimal(20,4)")
    assert claims.with_upside(n, v).count() == 1


def test_claims_are_verified_with_the_upside_of_their_report(spark):
    from factweave.operators import claims

    made = spark.createDataFrame([("a", "valuation", "An upside of 20%", ["x"]), ("b", "valuation", "An upside of 20%", ["x"])], "claim_id string, claim_type string, text string, cited_metric_ids array<string>")
    metrics = spark.createDataFrame([("x", "price", 0, Decimal(100))], "metric_id string, taxonomy_key string, period_sort_key int, value decimal(20,4)")
    v = spark.createDataFrame([("a", Decimal(120), Decimal(100)), ("b", Decimal(150), Decimal(100))], "claim_id string, base_target decimal(20,4), cmp decimal(20,4)")
    assert {r.claim_id: r.accepted for r in claims.verify(made, metrics, v).collect()} == {"a": True, "b": False}
    assert claims.verify(made, metrics).where("accepted").count() == 0


def test_conflicts_of_a_merge_block(spark):
    from factweave.operators import checks

    folded = spark.createDataFrame([(1, "revenue", "FY25", Decimal(100), [Decimal("120.5"), None]), (1, "ebitda", None, Decimal(7), [Decimal(9)]), (2, "revenue", "FY25", Decimal(1), [])], "k int, taxonomy_key string, period string, value decimal(20,4), conflicts array<decimal(20,4)>")
    found = merge.conflict_issues(folded, ["k"])
    assert {r.fingerprint for r in found.collect()} == {"conflict:revenue:FY25:100:120.5", "conflict:revenue:FY25:100:null", "conflict:ebitda:null:7:9"}
    metrics = spark.createDataFrame([(1, "EXACT_MATCH"), (2, "EXACT_MATCH")], "k int, evidence_verification string")
    got = {r.k: (r.n_conflicts, r.tier) for r in checks.coverage(metrics, metrics, found, "k").collect()}
    assert got == {1: (3, "FAIR"), 2: (0, "EXCELLENT")}


def test_charts_and_their_issues(spark):
    rows = [(1, 0, "revenue", "FY26", 20260, 2.0, "E", "INR", "crore"), (1, 1, "revenue", "FY25", 20250, 1.0, "A", "USD", None), (1, 2, "tax", "FY25", 20250, 1.0, "A", None, None), (1, 3, "ebitda", None, 0, 1.0, "A", None, None)]
    metrics = spark.createDataFrame(rows, "k int, ord int, taxonomy_key string, period string, period_sort_key int, value double, classification_code string, currency string, scale string")
    got = [(r.series, r.ord, r.period, r.currency, r.scale) for r in series.charted(metrics, "k").orderBy("ord").collect()]
    assert got == [("revenue", 0, "FY25", "INR", "crore"), ("revenue", 1, "FY26", "INR", "crore")]
    raw, dense = points(spark, [("FY24", 1.0, "E"), ("FY25", 2.0, "A")])
    names = spark.createDataFrame([("s",), ("none",)], "series string")
    arrays = spark.createDataFrame([("s", ["FY24"], [1.0, 2.0])], "series string, labels array<string>, data array<double>")
    issues = series.chart_issues(series.series_issues(raw, dense, 2026), names, raw, arrays)
    assert {(r.series, r.code, r.severity) for r in issues.collect()} == {("s", "CHART_FORECAST_BEFORE_ACTUAL", "WARNING"), ("none", "CHART_EMPTY_SERIES", "WARNING"), ("s", "CHART_LABEL_VALUE_MISMATCH", "BLOCKER")}


def test_failed_jobs_release_their_documents(spark):
    from factweave.operators import claims

    made = spark.createDataFrame([(1, 10, "RUNNING"), (2, 20, "RUNNING"), (3, 30, "RUNNING")], "id int, document_id int, status string")
    docs = spark.createDataFrame([(10, "PROCESSING"), (20, "PUBLISHED"), (30, "PROCESSING")], "id int, status string")
    lost = spark.createDataFrame([(1, "x"), (2, "y")], "id int, error string")
    now = F.lit("2026-01-01").cast("timestamp")
    assert {(r.id, r.status, r.error) for r in jobs.failed(made, lost, now).where("(finished_at is null) = (status = 'RUNNING')").collect()} == {(1, "FAILED", "x"), (2, "FAILED", "y"), (3, "RUNNING", None)}
    assert {(r.id, r.status) for r in jobs.released(docs, made, lost).collect()} == {(10, "DRAFT"), (20, "PUBLISHED"), (30, "PROCESSING")}
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(9)], "k int, ord int")
    assert {(r.k, r.ord) for r in claims.prompt_rows(rows, "k", 8).collect()} == {(k, i) for k in (1, 2) for i in range(8)}
