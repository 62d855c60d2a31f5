"""Text functions: canonical form for matching, quotation tiers, hashes, slugs, numbers in prose."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Evidence tiers, best first.
TIERS = ("EXACT_MATCH", "NORMALIZED_MATCH", "APPROXIMATE_MATCH", "UNVERIFIED", "CONFLICTING")
APPROXIMATE = 0.8

# Digraph ligatures that NFKC leaves alone.
LIGATURES = [("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")]


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """No built-in function composes Unicode."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def canonical(text: Column, compose: bool = True) -> Column:
    """Composed, ligatures spelt out, invisible characters gone, broken words joined, marks unified, one space, lower case."""
    given = F.coalesce(text, F.lit(""))
    wide = F.octet_length(given) > F.char_length(given)
    # Texts of ASCII alone are composed already and don't go to Python; of the rules below two can change them.
    plain = F.regexp_replace(F.regexp_replace(given, "([A-Za-z])-\\s*\\r?\\n\\s*([A-Za-z])", "$1$2"), "\\s+", " ")
    plain = F.when(given.rlike("[\\t-\\r]|  "), plain).otherwise(given)
    s = F.coalesce(nfkc(F.when(wide, given)), given) if compose else given
    for a, b in LIGATURES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, "[­​‌‍﻿⁠]", "")
    s = F.regexp_replace(s, "(\\p{L})[-‐-–]\\s*\\r?\\n\\s*(\\p{L})", "$1$2")
    s = F.regexp_replace(s, "[‐-―]", "-")
    s = F.regexp_replace(s, "[‘’‚‛′]", "'")
    s = F.regexp_replace(s, "[“”„‟″]", '"')
    s = F.replace(s, F.lit("…"), F.lit("..."))
    s = F.regexp_replace(s, "[   -     　\\s]+", " ")
    return F.lower(F.trim(F.when(wide, s).otherwise(plain)))


def overlap(quote: Column, page: Column) -> Column:
    """Share of a canonical quote's words of three letters or more that the page holds, also inside words."""
    tokens = F.filter(F.split(quote, " "), lambda t: F.length(t) > 2)
    hits = F.size(F.filter(tokens, lambda t: F.contains(page, t)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(hits / F.size(tokens))


def verify_quotes(rows: DataFrame, quote: str = "quote", page: str = "text", threshold: float = APPROXIMATE, compose: bool = True) -> DataFrame:
    """Add ``check``: struct<status, similarity> of a quote against the text of the one page it cites."""
    raw = F.trim(F.coalesce(quote, F.lit("")))
    named = rows.withColumns({"_near": canonical(raw, compose), "_text": canonical(F.col(page), compose)})
    return named.withColumn("check", _check(raw, F.col(page), F.col("_near"), F.col("_text"), threshold)).drop("_near", "_text")


def verify_against(quotes: DataFrame, pages: DataFrame, keys: list[str], quote: str = "quote", page_text: str = "text", threshold: float = APPROXIMATE) -> DataFrame:
    """``quotes`` with ``check`` and ``normalized``; every page is put in canonical form once, before quotes meet it."""
    ready = pages.select(*keys, F.col(page_text).alias("_page"), canonical(F.col(page_text)).alias("_text"))
    raw = F.trim(F.coalesce(quote, F.lit("")))
    named = quotes.withColumn("normalized", canonical(raw)).join(ready, keys, "left")
    return named.withColumn("check", _check(raw, F.col("_page"), F.col("normalized"), F.col("_text"), threshold)).drop("_page", "_text")


def _check(raw: Column, page: Column, near: Column, text: Column, threshold: float) -> Column:
    similarity = overlap(near, text)
    none = F.lit(None).cast("double")
    made = lambda status, s: F.struct(F.lit(status).alias("status"), s.alias("similarity"))
    return (
        F.when(near == "", made("UNVERIFIED", none))
        .when(F.coalesce(page, F.lit("")) == "", made("UNVERIFIED", F.lit(0.0)))
        .when(F.contains(page, raw), made("EXACT_MATCH", none))
        .when(F.contains(text, near), made("NORMALIZED_MATCH", none))
        .when(similarity >= threshold, made("APPROXIMATE_MATCH", similarity))
        .otherwise(made("UNVERIFIED", similarity))
    )


def verbatim(status: Column) -> Column:
    return status.isin("EXACT_MATCH", "NORMALIZED_MATCH")


def verification_rate(status: Column) -> Column:
    """Share of verbatim-safe checks over all, to two places half up; 0 without any (an aggregate)."""
    return F.coalesce(F.floor(F.try_divide(F.count_if(verbatim(status)), F.count("*")) * 100 + 0.5) / 100, F.lit(0.0))


def tier_rank(status: Column) -> Column:
    """4 for the best tier to 0."""
    out = F.lit(0)
    for i, name in enumerate(TIERS):
        out = F.when(status == name, 4 - i).otherwise(out)
    return out


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(32))


def chunk_hash(start: Column, end: Column, text: Column) -> Column:
    return short_hash(F.concat(start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), text))


def issue_fingerprint(code: str, entity_type: str, entity_id: Column, snapshot: dict[str, Column]) -> Column:
    """Hash of an issue's canonical JSON: keys sorted, nulls kept."""
    inner = F.struct(*(snapshot[k].alias(k) for k in sorted(snapshot)))
    whole = F.struct(F.lit(code).alias("code"), entity_id.alias("entityId"), F.lit(entity_type).alias("entityType"), inner.alias("valueSnapshot"))
    return short_hash(F.to_json(whole, {"ignoreNullFields": "false"}))


def slug(title: Column, decompose: bool = True) -> Column:
    s = F.lower(title)
    s = nfkd(s) if decompose else s
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(s, F.lit(80)), F.lit("")), F.lit("document"))


def metric_id(taxonomy_key: Column, period: Column, code: Column) -> Column:
    return F.concat_ws(":", taxonomy_key, F.coalesce(period, F.lit("?")), code)


def run_id(document: Column, input_hash: Column) -> Column:
    """The same for the same input, so that a repeated run finds its own rows."""
    return short_hash(F.concat_ws(":", document.cast("string"), input_hash))


def safe_filename(name: Column) -> Column:
    base = F.regexp_extract(F.coalesce(name, F.lit("")), "[^/\\\\]*$", 0)
    return F.coalesce(F.nullif(F.left(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), F.lit(200)), F.lit("")), F.lit("document.pdf"))


def checksum(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def clean_input(text: Column, limit: int) -> Column:
    """Control characters but line feeds gone, trimmed, capped."""
    return F.left(F.trim(F.regexp_replace(text, "[\\x00-\\x09\\x0B-\\x1F\\x7F]", "")), F.lit(limit))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def short_error(text: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(text, "\\s+", " ")), F.lit(500))


_A, _Z = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
PERIOD_TOKENS = f"(?i){_A}(?:[0-9]{{1,2}}[QHM]|Q[0-9]|H[0-9])?FY\\s?[0-9]{{2,4}}(?:\\s?[-/]\\s?[0-9]{{2,4}})?[AEPGCS]?{_Z}|{_A}Q[0-9]\\s?[0-9]{{2,4}}{_Z}|{_A}TTM{_Z}"


def numbers_in(text: Column) -> Column:
    """Number literals that a sentence asserts; fiscal periods and calendar years are none."""
    plain = F.regexp_replace(text, PERIOD_TOKENS, " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit("-?[0-9][0-9,]*(?:\\.[0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.filter(found, lambda n: ~n.rlike("^(?:19|20)[0-9]{2}$"))
