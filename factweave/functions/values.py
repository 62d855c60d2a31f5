"""Printed values, currencies, scales, fiscal periods and the metric taxonomy.

Word boundaries are spelt out in ASCII: Java's own take accented letters for letters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
DASH = "—"
VALUE = "decimal(20,4)"


def word(pattern: str) -> str:
    return f"{BEFORE}(?:{pattern}){AFTER}"


# Scale words, in the order they are tried, with multiplier and printed form.
SCALES = [
    ("crore", "cr|crore|crores", 10_000_000, "cr"),
    ("lakh", "lakh|lac|lakhs", 100_000, "lakh"),
    ("million", "mn|mm|million|millions", 1_000_000, "mn"),
    ("billion", "bn|billion|billions", 1_000_000_000, "bn"),
    ("thousand", "k|thousand|thousands", 1_000, "k"),
]
#: Lower-case letters without one of which no pattern of that name is found: they spare a text the pattern.
_SCALE_NEEDS = {"crore": ("cr",), "lakh": ("la",), "million": ("m",), "billion": ("b",), "thousand": ("k", "thou")}

# Currency marks, in the order they are tried, with the printed symbol.
CURRENCIES = [
    ("INR", f"₹|{BEFORE}Rs\\.?(?:{AFTER}|(?<=\\.)(?=[A-Za-z0-9_]))|{word('INR')}|{word('Rupees?')}", "₹"),
    ("USD", f"\\$|{word('USD')}", "$"),
    ("EUR", f"€|{word('EUR')}", "€"),
    ("GBP", f"£|{word('GBP')}", "£"),
    ("JPY", f"¥|{word('JPY')}", "¥"),
]

# Metric taxonomy; the first pattern that matches decides.
_PAT = "(?:pat|profit after tax|net profit)"
TAXONOMY = [
    ("pat_adjusted", f"adjusted\\s*{_PAT}|apat"),
    ("pat_reported", f"reported\\s*{_PAT}|^pat{AFTER}|profit after tax|net profit"),
    ("eps_diluted", "diluted\\s*eps|eps.*diluted"),
    ("eps_basic", f"basic\\s*eps|eps.*basic|^eps{AFTER}"),
    ("ebitda_margin", "ebitda\\s*margin"),
    ("net_margin", "net\\s*margin|pat\\s*margin"),
    ("net_debt_ebitda", "net\\s*debt\\s*/?\\s*ebitda"),
    ("net_debt", "net\\s*debt"),
    ("gross_debt", "gross\\s*debt|total\\s*debt"),
    ("ebitda", "ebitda"),
    ("ebit", word("ebit")),
    ("total_operating_income", f"total\\s*operating\\s*income|{word('toi')}"),
    ("operating_profit", "operating\\s*profit"),
    ("operating_income", "operating\\s*income"),
    ("gross_profit", "gross\\s*profit"),
    ("finance_cost", "finance\\s*cost|interest\\s*expense"),
    ("pbt", f"profit\\s*before\\s*tax|{word('pbt')}"),
    ("tax", f"^tax{AFTER}|tax\\s*expense"),
    ("fcf", f"free\\s*cash\\s*flow|{word('fcf')}"),
    ("ocf", f"operating\\s*cash\\s*flow|{word('ocf')}|cash\\s*from\\s*operations"),
    ("capex", "capex|capital\\s*expenditure"),
    ("roce", word("roce")),
    ("roe", word("roe")),
    ("revenue", "revenue|net\\s*sales|turnover"),
]

_TAXONOMY_NEEDS = {
    "pat_adjusted": ("adjusted", "apat"),
    "pat_reported": ("pat", "profit"),
    "eps_diluted": ("eps",),
    "eps_basic": ("eps",),
    "ebitda_margin": ("margin",),
    "net_margin": ("margin",),
    **dict.fromkeys(("net_debt_ebitda", "net_debt", "gross_debt"), ("debt",)),
    "ebit": ("ebit",),
    "total_operating_income": ("operating", "toi"),
    "operating_profit": ("operating",),
    "operating_income": ("operating",),
    "gross_profit": ("gross",),
    "finance_cost": ("finance", "interest"),
    "pbt": ("profit", "pbt"),
    "tax": ("tax",),
    "fcf": ("free", "fcf"),
    "ocf": ("operating", "ocf", "operations"),
    "capex": ("cap",),
    "roce": ("roce",),
    "roe": ("roe",),
}

# Classification codes.
CODES = ("A", "R", "P", "G", "E", "C", "S", "AI", "U")
FORECAST_CODES = ("G", "E", "C", "S", "AI")
ACTUAL_CODES = ("A", "R", "P")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_any(low: Column, needs: tuple[str, ...]) -> Column:
    """Whether a lower-case text has one of some pieces; true where none is named."""
    return reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in needs]) if needs else F.lit(True)


def first_match(text: Column, choices: list[tuple[str, str]], low: Column | None = None, needs: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Name of the first pattern found, ignoring case; null if none is.

    With ``low``, the text in lower case, a pattern is tried only where that has one of the pieces it ``needs``.
    """
    out = F.lit(None).cast("string")
    for name, pattern in reversed(choices):
        found = text.rlike(f"(?i){pattern}")
        out = F.when(found if low is None or name not in (needs or {}) else has_any(low, needs[name]) & found, name).otherwise(out)
    return out


def number_in(text: Column, of: str) -> Column:
    """A text as a number; null if it is none. An empty one isn't tried, for a cast that fails costs more than all around it."""
    return F.nullif(text, F.lit("")).try_cast(of)


def scale_of(text: Column, low: Column | None = None) -> Column:
    return first_match(text, [(name, word(p)) for name, p, _, _ in SCALES], low, _SCALE_NEEDS)


def currency_of(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.coalesce(first_match(text, [(name, p) for name, p, _ in CURRENCIES]), F.when(code.rlike("^[A-Z]{3}$"), code))


def multiplier_of(scale: Column) -> Column:
    out = F.lit(1).cast("bigint")
    for name, _, by, _ in SCALES:
        out = F.when(scale == name, F.lit(by).cast("bigint")).otherwise(out)
    return out


def printed_number(text: Column) -> Column:
    """The first number of a text, commas aside; null if it has none."""
    return let(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), "-?[0-9]+(?:\\.[0-9]+)?", 0), lambda digits: number_in(digits, VALUE))


def bracketed(text: Column) -> Column:
    return F.contains(text, F.lit("(")) & text.rlike("\\(\\s*[0-9,.]+\\s*\\)")


def signed(number: Column, in_brackets: Column) -> Column:
    """A number in brackets is negative."""
    return F.when(in_brackets & (number > 0), (-number).cast(VALUE)).otherwise(number)


def parse_value(raw: Column) -> Column:
    """struct<value, currency, scale, unit, is_percent, is_multiple>; no digits means no value, never zero."""

    def read(t: Column) -> Column:
        return F.struct(printed_number(t).alias("number"), F.lower(t).alias("low"), t.alias("text"))

    # Words are looked for by their pieces before their pattern is tried.
    def marked(p: Column) -> Column:
        t, low = p["text"], p["low"]
        return F.struct(
            p["number"].alias("number"),
            (F.contains(t, F.lit("%")) | (has_any(low, ("percent", "bps")) & t.rlike(f"(?i){word('percent')}|{word('bps')}"))).alias("percent"),
            (has_any(low, ("x", "×", "times")) & t.rlike(f"(?i)[0-9]\\s*[x×]|{word('times')}")).alias("multiple"),
            bracketed(t).alias("bracketed"),
            t.alias("text"),
            low.alias("low"),
        )

    def made(p: Column) -> Column:
        number, found = p["number"], p["number"].isNotNull()
        return F.struct(
            signed(number, p["bracketed"]).alias("value"),
            F.when(found, currency_of(p["text"])).alias("currency"),
            F.when(found, scale_of(p["text"], p["low"])).alias("scale"),
            F.when(found & p["percent"], "%").when(found & p["multiple"], "x").alias("unit"),
            p["percent"].alias("is_percent"),
            p["multiple"].alias("is_multiple"),
        )

    return let(let(let(F.coalesce(F.trim(raw), F.lit("")), read), marked), made)


def value_and_unit(raw: Column) -> Column:
    """The value, currency and scale of ``parse_value``, without what else it looks for."""
    read = lambda t: F.struct(printed_number(t).alias("number"), F.lower(t).alias("low"), t.alias("text"))

    def made(p: Column) -> Column:
        found = p["number"].isNotNull()
        return F.struct(signed(p["number"], bracketed(p["text"])).alias("value"), F.when(found, currency_of(p["text"])).alias("currency"), F.when(found, scale_of(p["text"], p["low"])).alias("scale"))

    return let(let(F.coalesce(F.trim(raw), F.lit("")), read), made)


def strip_number(text: Column) -> Column:
    """A number from digits, dots and minus signs alone; null if they make none."""
    return number_in(F.regexp_replace(text, "[^0-9.-]", ""), VALUE)


def leading_number(text: Column) -> Column:
    """The longest number that the digits, dots and minus signs of a text begin with."""
    return number_in(F.regexp_extract(F.regexp_replace(text, "[^0-9.-]", ""), "^-?[0-9]*\\.?[0-9]+", 0), VALUE)


def whole_number(text: Column) -> Column:
    return number_in(F.regexp_replace(text, "[^0-9-]", ""), "int")


def _year(digits: Column) -> Column:
    n = number_in(digits, "int")
    return F.when(n < 100, n + 2000).otherwise(n)


def _short(year: Column) -> Column:
    return F.right(year.cast("string"), F.lit(2))


def parse_period(text: Column, as_of_year: int) -> Column:
    """struct<label, period_type, fiscal_year_end, quarter, sort_key>, null if it can't be read.

    A trailing year without digits takes ``as_of_year``, never the clock.
    """
    quarterly = "^(?:Q([0-9])FY|([0-9])QFY)([0-9]{2,4})"
    annual = "^FY([0-9]{2,4})(?:[-/]([0-9]{2,4}))?"

    # Parts first, then numbers, for a number's rules name its text several times; no pattern is tried where the text can't begin with what it begins with.
    def parts(t: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(t, pattern, i)
        years, trailing = t.startswith("FY"), t.startswith("TTM")
        other = ~years & ~trailing
        return F.struct(
            F.when(other, F.concat(part(quarterly, 1), part(quarterly, 2))).alias("q"),
            F.when(other, part(quarterly, 3)).alias("q_year"),
            F.when(trailing, part("([0-9]{2,4})", 1)).alias("any_year"),
            F.when(years, part(annual, 1)).alias("from_year"),
            F.when(years, part(annual, 2)).alias("to_year"),
            trailing.alias("trailing"),
        )

    def read(p: Column) -> Column:
        return F.struct(
            number_in(p["q"], "int").alias("q"),
            _year(p["q_year"]).alias("q_year"),
            F.coalesce(_year(p["any_year"]), F.lit(as_of_year)).alias("any_year"),
            _year(F.coalesce(F.nullif(p["to_year"], F.lit("")), p["from_year"])).alias("a_year"),
            p["trailing"].alias("trailing"),
        )

    def period(label: Column, kind: str, year: Column, q: Column, key: Column) -> Column:
        return F.struct(label.alias("label"), F.lit(kind).alias("period_type"), year.alias("fiscal_year_end"), q.alias("quarter"), key.alias("sort_key"))

    def made(p: Column) -> Column:
        none = F.lit(None).cast("int")
        return (
            F.when(p["q"].between(1, 4), period(F.concat(F.lit("Q"), p["q"].cast("string"), F.lit("FY"), _short(p["q_year"])), "QUARTER", p["q_year"], p["q"], p["q_year"] * 10 + p["q"]))
            .when(p["trailing"], period(F.lit("TTM"), "TTM", p["any_year"], none, p["any_year"] * 10 + 9))
            .when(p["a_year"].isNotNull(), period(F.concat(F.lit("FY"), _short(p["a_year"])), "ANNUAL", p["a_year"], none, p["a_year"] * 10))
        )

    return let(let(let(F.regexp_replace(F.upper(F.trim(text)), "\\s+", ""), parts), read), made)


def format_period(text: Column, code: Column, as_of_year: int) -> Column:
    base = F.coalesce(parse_period(text, as_of_year)["label"], F.trim(text), F.lit(""))
    suffix = F.when(code.isin("AI", "U"), "").otherwise(F.coalesce(code, F.lit("")))
    return F.when(base == "", DASH).otherwise(F.concat(base, suffix))


def taxonomy_key(label: Column) -> Column:
    return F.coalesce(let(F.struct(label.alias("text"), F.lower(label).alias("low")), lambda t: first_match(t["text"], TAXONOMY, t["low"], _TAXONOMY_NEEDS)), F.lit("unmapped"))


def grouped(value: Column, decimals: int = 0) -> Column:
    """Fixed decimals, half up, with a comma every three digits."""
    return F.format_number(F.round(value.cast(VALUE), decimals), decimals)


def _symbol(currency: Column) -> Column:
    out = F.when(currency.isNull(), "").otherwise(F.concat(currency, F.lit(" ")))
    for code, _, sign in CURRENCIES:
        out = F.when(currency == code, sign).otherwise(out)
    return out


def format_money(value: Column, currency: Column, scale: Column, decimals: int = 0) -> Column:
    suffix = F.lit("")
    for name, _, _, printed in SCALES:
        suffix = F.when(scale == name, f" {printed}").otherwise(suffix)
    return F.coalesce(F.trim(F.concat(_symbol(currency), grouped(value, decimals), suffix)), F.lit(DASH))


def format_per_share(value: Column, currency: Column, decimals: int = 0) -> Column:
    return F.coalesce(F.concat(_symbol(currency), grouped(value, decimals), F.lit("/share")), F.lit(DASH))


def format_pct(value: Column, decimals: int = 1) -> Column:
    return F.coalesce(F.concat(grouped(value, decimals), F.lit("%")), F.lit(DASH))


def format_multiple(value: Column, decimals: int = 1) -> Column:
    return F.coalesce(F.concat(grouped(value, decimals), F.lit("×")), F.lit(DASH))


def clean_code(code: Column, allowed: tuple[str, ...] = CODES) -> Column:
    """Upper case; anything outside the set is U."""
    c = F.upper(F.trim(code))
    return F.when(c.isin(*allowed), c).otherwise("U")


def is_forecast(code: Column) -> Column:
    return F.coalesce(code.isin(*FORECAST_CODES), F.lit(False))


def is_actual(code: Column) -> Column:
    return F.coalesce(code.isin(*ACTUAL_CODES), F.lit(False))
