"""JSON of every wrong type against plain readings of it, and canonical forms against a plain recursion."""

import json
import math

from pyspark.sql import functions as F

from factweave.sources import extraction, typed

TOKENS = ['"x"', '" y "', "5", "5.0", "550.50", "2.6", "1e3", "1e21", "1e-7", "123456789012345680000", "-0.0", "0.000001", "0.0000001", "1e999", "-1e999", "null", "true", "false", "{}", '{"a":1}', "[]", "[1]", '"3-4"', '"p. 12-13"', '"-"', '"--3"', '"12.5 cr"', '"1e999"', '"5e2x"', '".5"', '""', '"true"']


def js_number(x):
    """The shortest digits of a double, placed as the language of the web places them."""
    if x == 0:
        return "0"
    digits, _, power = f"{abs(x)!r}".partition("e") if "e" in repr(x) else (repr(abs(x)), "", "0")
    whole, _, rest = digits.partition(".")
    every = (whole + rest).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + rest) - len(every))
    every = every.rstrip("0")
    sign = "-" if x < 0 else ""
    if point > 21 or point < -5:
        return sign + every[0] + ("." + every[1:] if len(every) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    if point >= len(every):
        return sign + every.ljust(point, "0")
    return sign + (every[:point] + "." + every[point:] if point > 0 else "0." + "0" * -point + every)


def plain(token):
    v = json.loads(token)
    if isinstance(v, bool) or isinstance(v, (dict, list)) or isinstance(v, (int, float)) and not math.isfinite(float(v)):
        return None
    return (v,)


def test_scalars_of_every_type(spark):
    import re

    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").selectExpr("t", typed.parsed("concat('{\"f\":', t, '}')") + " AS v")
    got = rows.select("t", *(F.expr(typed.record("v", {"f": f})).alias(n) for n, f in (("text", typed.soft_text), ("int", typed.soft_int), ("number", typed.soft_number), ("flag", typed.soft_flag)))).collect()
    for r in got:
        p = plain(r.t)
        assert r.text.ok == r["int"].ok == r.number.ok == (p is not None), r
        assert r.flag.ok == (r.t in ("true", "false", "null") or r.t.startswith('"'))
        if r.flag.ok:
            assert r.flag.value.f == (r.t in ("true", '"true"'))
        if p is None:
            continue
        v = p[0]
        assert r.text.value.f == (None if v is None else v.strip() if isinstance(v, str) else js_number(float(v))), r
        if isinstance(v, str):
            digits = re.match(r"-?[0-9]+", re.sub(r"[^\d-]", "", v))
            assert r["int"].value.f == (float(digits[0]) if digits else None), r
            found = re.match(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", v)
            want = float(found[0]) if found else None
            assert r.number.value.f == (want if want is None or math.isfinite(want) else None), r
        elif v is not None:
            assert r["int"].value.f == r.number.value.f == float(v)
    missing = spark.range(1).select(F.expr(typed.record(typed.parsed("'{}'"), {"f": typed.soft_text})).alias("r")).first().r
    assert missing.ok and missing.value.f is None


def test_malformed_items_cost_themselves_alone(spark):
    good = '{"label":"Revenue","rawValue":5,"sourcePage":2.6}'
    bad = ['{"label":{"a":1}}', '{"label":true}', '{"sourcePage":[4]}', '{"classificationCode":{}}', '{"rawValue":1e999}', "null", "7", '"x"', "[]"]
    payload = '{"metrics":[' + ",".join([*bad[:4], good, *bad[4:], good]) + '],"risks":{"name":"r"},"sections":[{"heading":"h","sourcePage":"3-4"}]}'
    got = extraction.read_items(extraction.read_chunks(spark.range(1).withColumn("payload", F.lit(payload)))).orderBy("kind", "item_idx").collect()
    assert [(m.item_idx, m.title, m.body, m.code, m.quote, m.page) for m in got if m.kind == "metric"] == [(0, "Revenue", "5", "U", "", None), (1, "Revenue", "5", "U", "", None)]
    assert [(m.kind, m.title, m.page) for m in got if m.kind != "metric"] == [("section", "h", 3)]


def test_chunks_that_do_not_conform(spark):
    cases = {"": False, "nope": False, "[1]": False, '{"a":1} and more': False, '{"a":1}{"b":2}': False, "null": False, "{}": True, '```JSON\n{"metrics":null}\n```': True, '{"identity":{"ticker":{}}}': False, '{"identity":{"ticker":5}}': True, '{"valuation":[]}': False, '{"valuation":null,"identity":null}': True, '{"a":1,"a":2}': False}
    chunks = spark.createDataFrame([(k, k) for k in cases] + [(None, None)], "t string, payload string")
    assert {r.t: r.conforms for r in extraction.read_chunks(chunks).collect()} == cases | {None: False}


def test_first_contract_of_every_type(spark):
    text = 'well: {"title":3,"metrics":[{"name":"a","page":"1e999"},{"name":"b","page":1e999},{"name":"c","isHistorical":1},{"name":"d","isHistorical":"true","page":"7%"}],"sections":[{"pageReferences":[1,"2x",null,true,[7,8],{"a":1},1e999]},{"pageReferences":"3"}],"charts":[{"type":"pie","labels":[null,true,1.50,[1,[1,2]],{}],"series":[{"name":"s","data":["x"]},{"name":[],"data":[]},{"name":"t"}]},{"type":{},"title":[]},{"type":"line"}],"risks":[{"risk":null}]} ok'
    r = extraction.read_legacy(spark.range(1).withColumn("payload", F.lit(text))).first()
    assert r.title == "3" and [(m.name, m.page, m.isHistorical) for m in r.metrics] == [("a", None, False), ("d", 7.0, True)]
    assert [s.pageReferences for s in r.sections] == [[1.0, 2.0, 0.0, 0.0, 7.0, 0.0, 0.0]]
    assert [(c.type, c.labels, [(s.name, s.data) for s in c.series]) for c in r.charts] == [("bar", ["", "true", "1.5", "1,1,2", "[object Object]"], [("s", [0.0]), ("t", [])]), ("line", [], [])]
    assert r.risks[0].risk == ""
    bad = spark.createDataFrame([('{"title":{}}',), ("none",), (None,)], "payload string")
    assert all(not r.conforms and r.title is None and r.metrics is None for r in extraction.read_legacy(bad).collect())


def test_canonical_json_at_every_depth(spark):
    texts = ['{"b":[1.0,{"z":null,"a":1e3}],"a":{"y":"q\\"1.0\\"\\u0001\\u00e9","x":[]},"A":-0.0}', "[3,1,2]", '"1.50"', '{"n":1e21,"m":123456789.125,"k":{"j":{"i":{"h":0.1}}}}', "null", "true"]

    def stable(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, (int, float)):
            return js_number(float(v))
        if isinstance(v, list):
            return "[" + ",".join(map(stable, v)) + "]"
        return "{" + ",".join(f"{json.dumps(k)}:{stable(v[k])}" for k in sorted(v)) + "}"

    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", typed.canonical(typed.parsed("t")) + " AS c").collect()
    assert {r.t: r.c for r in rows} == {t: stable(json.loads(t)) for t in texts}


def test_a_text_is_parsed_once_and_read_as_the_expressions_read_it(spark):
    from factweave.sources import reading

    pairs = (("text", typed.soft_text, reading.soft_text), ("same", typed.verbatim_filled, reading.verbatim_filled), ("int", typed.soft_int, reading.soft_int), ("number", typed.soft_number, reading.soft_number), ("flag", typed.soft_flag, reading.soft_flag))
    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").selectExpr("t", typed.parsed("concat('{\"f\":', t, '}')") + " AS v")
    for r in rows.select("t", *(F.expr(typed.record("v", {"f": f})).alias(n) for n, f, _ in pairs)).collect():
        for name, _, f in pairs:
            try:
                got = (True, f(reading.parsed(r.t)))
            except reading.Malformed:
                got = (False, None)
            assert got[0] == r[name].ok and (not got[0] or got[1] == r[name].value.f), (name, r)
    # A filter on what a text holds doesn't parse it a second time.
    for read in (extraction.read_chunks, extraction.read_legacy):
        plan = read(spark.range(1).select(F.col("id").cast("string").alias("payload"))).where("conforms")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "try_variant_get" not in plan


def test_nested_arrays_join_by_commas_and_nothing_else_is_lost(spark):
    text = '{"charts":[{"labels":[["a]b",null,[1e21,"\\"c\\""]],[{}],"\\ud800"]}]}'
    assert extraction.read_legacy(spark.range(1).withColumn("payload", F.lit(text))).first().charts[0].labels == ['a]b,,1e+21,"c"', "[object Object]", "?"]
