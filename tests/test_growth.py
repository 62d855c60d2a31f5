"""What a task holds must not grow with the tables."""

from pyspark.sql import functions as F

from factweave.operators import layout
from factweave.plans import registry, texts


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_larger_files_make_more_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows.parquet")
    spark.range(50_000).select("id", F.rand(1).alias("x")).write.parquet(path)
    rows = spark.read.parquet(path)
    size = registry.file_bytes(rows)
    assert size > 400_000
    monkeypatch.setattr(registry, "TASK_BYTES", size // 40)
    many = registry.spread(rows, "id")
    assert many.rdd.getNumPartitions() >= 40 and many.count() == 50_000
    monkeypatch.setattr(registry, "TASK_BYTES", size)
    assert registry.spread(rows, "id").rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 4)


def test_lines_and_tables_move_their_items_once(spark, tmp_path):
    row = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    lines = [(k, n, n, 1, 5.0, "A", "O") for k in range(3) for n in range(1, 8)]
    spark.createDataFrame(lines, row).write.parquet(str(tmp_path / "lineitem.parquet"))
    for query in (texts.page_lines, texts.page_tables):
        assert _shuffles(query(spark, str(tmp_path))) == 1
    assert sorted((r.doc_id, r.block, r.n_rows, r.n_cells) for r in texts.page_tables(spark, str(tmp_path)).collect()) == [(k, b, n, 4 * n) for k in range(3) for b, n in ((0, 4), (1, 3))]


def test_blocks_skip_short_lines_and_break_at_gaps(spark):
    # Lines of three items at 0, 12 and 24, a line of one item at 36, then a wide gap and two lines of three.
    items = [(1, 1, 10 * i + c, "7", 50.0 * c, float(y), 10.0, 8.0) for i, (y, m) in enumerate(((0, 3), (12, 3), (24, 3), (36, 1), (90, 3), (102, 3))) for c in range(m)]
    rows = spark.createDataFrame(items, "doc_id long, page int, item long, str string, x double, y double, width double, height double")
    got = layout.with_blocks(rows).groupBy("block", "line").agg(F.count("*").alias("n")).orderBy("line").collect()
    assert [tuple(r) for r in got] == [(0, 0, 3), (0, 1, 3), (0, 2, 3)]
    assert [tuple(r) for r in layout.tables(rows).collect()] == [(1, 1, 0, 3, 3, 9, 9)]


def test_ascii_texts_take_the_short_way_to_the_same_form(spark):
    from factweave.functions import text

    said = ["A well-\n known  Fact\t", "a-b - c", "x-\r\ny", "1-\n2", "\x0b q \x0c", "", "--\n a", "Ab-\n\n Cd", "z- \n9"]
    rows = spark.createDataFrame([(s,) for s in said] + [(None,)], "s string")
    # A word of another script before it sends the same text through all rules.
    got = rows.select(text.canonical(F.col("s")).alias("short"), text.canonical(F.concat(F.lit("é | "), F.col("s"))).alias("long")).collect()
    assert all((r.long or "").removeprefix("é |").strip(" ") == r.short for r in got)


def test_texts_without_a_number_have_none(spark):
    from factweave.functions import values

    rows = spark.createDataFrame([("",), ("n/a",), ("FY",), ("FY24",), ("Q3FY25",)], "s string")
    got = rows.select(values.parse_period(F.col("s"), 2026)["label"].alias("p"), values.parse_value(F.col("s"))["value"].cast("int").alias("v"), values.whole_number(F.col("s")).alias("w")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (None, None, None), (None, None, None), ("FY24", 24, 24), ("Q3FY25", 3, 325)]
