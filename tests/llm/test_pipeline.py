from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import containment
from test_llm_operators import brute_components

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 345 !!", "en", "x", 9), (10**6 + 1, None, "en", "x", 0)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()} == {10**6, 10**6 + 1}
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    want = {rows[i][0] for i, (_, root) in brute_components([t for _, t in rows]).items() if i == root}
    kept = stages["near_duplicates"](spark, kept, SMALL)
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
    cut = stages["repeated_passages"](spark, kept, SMALL)
    assert cut.columns == docs.columns and cut.where(F.col("n_chars") != F.length("text")).count() == 0
    clean = stages["decontamination"](spark, cut, SMALL)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert containment.contained(clean, bench).count() == 0
    gone = cut.select("doc_id").subtract(clean.select("doc_id"))
    assert gone.join(containment.contained(cut, bench), "doc_id", "left_anti").count() == 0
    packed = stages["packing"](spark, clean, SMALL)
    assert packed.where("piece = 0").count() == clean.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_rows_without_id_and_rows_that_share_one(spark):
    """Every unique text stays, whatever its doc_id; of repeated ones the one with the smallest doc_id does."""
    say = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("text is not null").first().text
    rows = [(1, say(1)), (None, say(1)), (None, say(2)), (None, say(3)), (None, say(3)), (1, say(4)), (2, say(1)), (2, say(5)), (3, say(6)), (3, say(6)), (None, say(7) + " " + item), (4, say(8) + " " + item), (4, say(9)), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, SMALL)
    want = [(1, say(1)), (None, say(2)), (None, say(3)), (1, say(4)), (2, say(5)), (3, say(6)), (None, say(7) + " " + item), (4, say(8) + " " + item), (4, say(9)), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    clean = stages["decontamination"](spark, kept, SMALL)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((x for x in want if item not in x[1]), key=str)


def test_passages_are_not_cut_out_of_rows_that_share_an_id(spark):
    say = lambda n: " ".join(f"v{n}x{i}" for i in range(80))
    docs = spark.createDataFrame([(1, say(1)), (2, say(2) + " " + say(1)), (3, say(3) + " " + say(1)), (3, say(4) + " " + say(5))], "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    cut = dict(corpus_pipeline.STAGES)["repeated_passages"](spark, docs, SMALL)
    assert sorted((r.doc_id, len(r.text.split())) for r in cut.collect()) == [(1, 80), (2, 80), (3, 160), (3, 160)]
