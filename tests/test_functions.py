from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factweave.functions import calc, contact, text, values

VALUES = [
    ("Rs 741 Cr", "741", "INR", "crore", None),
    ("₹1,234.5", "1234.5", "INR", None, None),
    ("(52.3)", "-52.3", None, None, None),
    ("9.5%", "9.5", None, None, "%"),
    ("3.0x", "3.0", None, None, "x"),
    ("(5.2%)", "5.2", None, None, "%"),
    ("741Cr", "741", None, None, None),
    ("Rs741", "741", None, None, None),
    ("Rs. 741", "741", "INR", None, None),
    ("US$ 12 mn", "12", "USD", "million", None),
    ("120 bps", "120", None, None, "%"),
    ("1,200 lakh", "1200", None, "lakh", None),
    ("2 times", "2", None, None, "x"),
    ("n/a", None, None, None, None),
    ("", None, None, None, None),
    (None, None, None, None, None),
]


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_raw_values(spark):
    got = one(spark, [v[0] for v in VALUES], "a string", values.parse_value(F.col("a")))
    assert [(g.value, g.currency, g.scale, g.unit) for g in got] == [(v and Decimal(v), c, s, u) for _, v, c, s, u in VALUES]


PERIODS = {
    "FY26": ("FY26", "ANNUAL", 2026, None, 20260),
    "fy 2026": ("FY26", "ANNUAL", 2026, None, 20260),
    "FY25-26": ("FY26", "ANNUAL", 2026, None, 20260),
    "FY2025/26": ("FY26", "ANNUAL", 2026, None, 20260),
    "FY26E": ("FY26", "ANNUAL", 2026, None, 20260),
    "Q3FY26": ("Q3FY26", "QUARTER", 2026, 3, 20263),
    "3QFY26": ("Q3FY26", "QUARTER", 2026, 3, 20263),
    "TTM Mar25": ("TTM", "TTM", 2025, None, 20259),
    "TTM": ("TTM", "TTM", 2030, None, 20309),
    "FY123": ("FY23", "ANNUAL", 123, None, 1230),
    "Q5FY26": None,
    "H1FY26": None,
    "2026": None,
    None: None,
}


def test_periods(spark):
    got = one(spark, list(PERIODS), "a string", values.parse_period(F.col("a"), 2030))
    assert [g and tuple(g) for g in got] == list(PERIODS.values())


def test_taxonomy(spark):
    from factweave.plans.texts import LABELS

    assert one(spark, [*LABELS, "", None], "a string", values.taxonomy_key(F.col("a"))) == [*LABELS.values(), "unmapped", "unmapped"]


@pytest.mark.parametrize(
    ("call", "args", "expected"),
    [
        (calc.upside, ("120", "100"), "20"),
        (calc.upside, ("120", "0"), None),
        (calc.margin, ("50", "400"), "12.5"),
        (calc.free_cash_flow, ("100", "-30"), "70"),
        (calc.free_cash_flow, ("100", "30"), "70"),
        (calc.growth, ("110", "100"), "10"),
        (calc.growth, ("5", "-1"), None),
        (calc.growth, ("5", "0"), None),
        (calc.equity_from_ev, ("1000", "200"), "800"),
        (calc.cagr, ("100", "121", "2"), "10"),
        (calc.cagr, ("0", "121", "2"), None),
        (calc.target_from_equity, ("10", "0"), None),
        (calc.growth, (None, "1"), None),
    ],
)
def test_calculators(spark, call, args, expected):
    (got,) = spark.range(1).select(call(*(F.lit(a).cast("decimal(20,4)") for a in args)).alias("r")).first()
    assert got.value == (None if expected is None else Decimal(expected))
    assert (got.reason is None) == (expected is not None)


def test_agreement(spark):
    cases = [("100", "101", True), ("100", "101.01", False), ("0", "0", True), (None, "1", False)]
    got = one(spark, [c[:2] for c in cases], "a string, b string", calc.agrees(F.col("a"), F.col("b"), 0.01))
    assert got == [c[2] for c in cases]


def test_quotes(spark):
    page = "Net reve-\nnue grew strongly in the period."
    quotes = {"grew strongly": "EXACT_MATCH", "NET  REVENUE grew": "NORMALIZED_MATCH", "revenue strongly grew net period": "APPROXIMATE_MATCH", "dividend policy unchanged": "UNVERIFIED", " ": "UNVERIFIED"}
    rows = spark.createDataFrame([(q, page) for q in quotes], "quote string, text string")
    assert {r.quote: r.check.status for r in text.verify_quotes(rows).collect()} == quotes
    odd = spark.createDataFrame([("5″", "x")], "quote string, text string").select(text.canonical(F.col("quote"))).first()[0]
    assert odd == "5''"


def test_hashes_slugs_and_numbers(spark):
    lit = F.lit
    row = spark.range(1).select(
        text.chunk_hash(lit(1), lit(2), lit("abc")),
        text.issue_fingerprint("MISSING_CRITICAL_FIELD", "DocumentAnalysis", lit(None).cast("string"), {"field": lit("cmp")}),
        text.slug(lit("Café Münch Q1")),
        text.slug(lit("  --A  B--  ")),
        text.slug(lit("日本")),
        text.numbers_in(lit("Revenue rose 12.5% to Rs 1,234 Cr in FY26E")),
        text.numbers_in(lit("margin 10-12 in 2025, Q3FY26 up 4")),
    ).first()
    assert list(row) == ["c74102b1d41abdf3adf922d91a7b8040", "de02bd0f2236e2cf1b311d6d27bef635", "cafe-mu-nch-q1", "a-b", "document", ["12.5", "1234"], ["10", "-12", "4"]]


LADDERS = [
    (contact.score_name, "Asha Rao", "ok"),
    (contact.score_name, "aaaa", "repeated_chars"),
    (contact.score_name, "abcdef", "sequential"),
    (contact.score_name, "qwerty", "keyboard_walk"),
    (contact.score_name, "ababab", "repeated_syllables"),
    (contact.score_name, "bcdfg", "no_vowels"),
    (contact.score_name, "Majd", "implausible_bigram"),
    (contact.score_name, None, "format"),
    (contact.score_email, "x", "syntax"),
    (contact.score_email, "test@firm.com", "placeholder_local"),
    (contact.score_email, "jo@mailinator.com", "disposable_domain"),
    (contact.score_email, "jo@qwe.com", "keyboard_domain"),
    (contact.score_phone, "9876501234", "ok"),
    (contact.score_phone, "1234567890", "invalid_prefix"),
    (contact.score_phone, "+1111111111", "repeated_digits"),
    (contact.score_phone, "12345678", "sequential_digits"),
    (contact.score_phone, "+121212121", "alternating_pattern"),
    (contact.score_message, "hello", "too_short"),
    (contact.score_message, "spam spam spam spam words here", "repeated_tokens"),
    (contact.score_message, "please send me the report!!!!", "punctuation_spam"),
    (contact.score_message, "please send me the report", "ok"),
]


def test_ladders(spark):
    got = [spark.range(1).select(f(F.lit(v).cast("string")).alias("r")).first()[0].reason for f, v, _ in LADDERS]
    assert got == [r for _, _, r in LADDERS]
