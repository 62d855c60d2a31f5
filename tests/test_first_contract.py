"""The first contract read by columns: the same as value by value, and no work done twice."""

import json

from factweave.operators import persist
from factweave.sources import extraction, reading
from factweave.sources.commits import Store

ROWS = "doc_id bigint, job_id bigint, payload string"
ODD = [
    '{"title":7,"cmp":1.50,"metrics":[{"name":"a","value":2},{"name":[]},5,{"name":null,"isHistorical":"true","page":"3x"},{"value":1e999},{"page":{}}]}',
    '{"title":"\\ud800","metrics":[{"name":"\\ud800","isHistorical":true,"page":2}],"sections":[{"title":"s","pageReferences":[1,"2x",null]},{"pageReferences":1}]}',
    '{"title":{},"metrics":[{"name":"lost with its document"}]}',
    '{"title":"twice","title":"twice"}',
    '{"metrics":{"name":"no array"},"risks":[{"risk":true},{"risk":"é","evidence":3}],"charts":[{"type":"pie","labels":[1,[2]],"series":[{"name":"n","data":["1",{}]},{"data":0}]},{"type":"line","labels":{}},7]}',
    'said {"title":" t ","company":null} so',
    "[1]",
    "",
    None,
    "{}",
]


def _one(text):
    """What a document is, reader by reader."""
    text = text or ""
    try:
        whole = reading.parsed(text[text.find("{") : text.rfind("}") + 1])
        own = reading.record(whole, extraction._OWN)
    except reading.Malformed:
        return None
    return own | {name: reading.records(whole.get(name), readers) for name, readers in extraction._LEGACY.items()}


def test_columns_give_what_each_value_gives(spark):
    texts = ODD + ['{"title":"plain","metrics":[{"name":"n","value":"v"}]}'] * 1200 + ODD
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, payload string").coalesce(1)
    got = {r.id: r.asDict(recursive=True) for r in extraction.read_legacy(rows).collect()}
    assert len(got) == len(texts) > 2 * extraction._AT_ONCE
    for i, text in enumerate(texts):
        expected = _one(text)
        assert got[i].pop("id") == i and got[i].pop("conforms") == (expected is not None)
        assert got[i] == (expected or dict.fromkeys(got[i])), text


def test_fields_not_wanted_are_judged_all_the_same(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, payload string")
    wanted = {"own": ["company"], "metrics": ["name"]}
    whole = {r.id: r for r in extraction.read_legacy(rows).collect()}
    some = extraction.read_legacy(rows, fields=wanted)
    assert some.columns == ["id", "conforms", "company", *extraction._LEGACY]
    for r in some.collect():
        w = whole[r.id]
        assert (r.conforms, r.company, r.sections, r.risks, r.charts) == (w.conforms, w.company, w.sections, w.risks, w.charts)
        assert [m.asDict() for m in r.metrics or []] == [{"name": m.name} for m in w.metrics or []]


def test_numbers_of_values(spark):
    said = ["Rs 12,345.67 Cr", "(5)", "-", "", None, "1-2", "-.5x", "..5", "9" * 400, "1e5", "3.", "FY24 1.2.3"]
    rows = persist.with_number(spark.createDataFrame([(s,) for s in said], "v string"), "v", "n")
    assert [r.n for r in rows.collect()] == [12345.67, 5.0, None, None, None, 1.0, -0.5, None, None, 15.0, 3.0, 241.2]
    assert rows.columns == ["v", "n"]


def test_a_batch_reads_its_rows_once_and_each_number_once(spark, tmp_path, monkeypatch):
    payload = json.dumps({"title": "T", "metrics": [{"name": "m", "value": "7"}]})
    spark.createDataFrame([(1, 10, payload), (None, 20, payload)], ROWS).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    store, staged = Store(spark, f"file://{tmp_path}/s"), {}
    stage = Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, name, rows, by=None: (staged.setdefault(name, rows), stage(self, name, rows, by))[1])
    persist.first_contract(store, "one", rows, "m")
    persist.first_contract(store, "two", rows, "m")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(persist.with_next_versions(store, 1, rows)).count("Location: InMemoryFileIndex(1 paths)[file:" + str(tmp_path / "rows")) == 1
    assert plan(staged["metrics"]).count("regexp_replace(") == 1
    assert sorted((r.doc_id, r.version) for r in persist.current(store).collect()) == [(1, 1), (1, 2)]
    assert [r.numeric_value for r in store.read("metrics").collect()] == [7.0, 7.0]
