"""Admission of raw files by size, name, type and bytes: the first rule that fails decides.

Input is the shape of Spark's ``binaryFile`` reader plus name and declared type. Files are read as Latin-1, a
character per byte, so that patterns see bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the worker and of the upload form.
MAX_BYTES, MAX_PAGES, UPLOAD_BYTES = 50 * 1024 * 1024, 500, 25 * 1024 * 1024
# Declared types a file may have.
ACCEPTED = ("application/pdf", "application/x-pdf", "application/octet-stream")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, declared_mime (none) and content of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("declared_mime"), "content", "length")


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def pdf_version(content: Column) -> Column:
    return F.nullif(F.regexp_extract(_latin(F.substring(content, 1, 16)), "%PDF-([0-9]+\\.[0-9]+)", 1), F.lit(""))


def has_end_mark(content: Column) -> Column:
    return F.contains(F.right(_latin(content), F.lit(2048)), F.lit("%%EOF"))


def encrypted(content: Column) -> Column:
    t = _latin(content)
    tail = F.right(t, F.lit(8192)).rlike("/Encrypt(?![A-Za-z0-9_])")
    return tail | (F.contains(t, F.lit("trailer")) & F.substring_index(t, "trailer", -1).rlike("/Encrypt(?![A-Za-z0-9_])"))


def page_count(content: Column) -> Column:
    t = _latin(content)
    counts = F.transform(F.regexp_extract_all(t, F.lit("/Type\\s*/Pages[\\s\\S]{0,200}?/Count\\s+([0-9]+)"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.coalesce(F.array_max(counts), F.regexp_count(t, F.lit("/Type\\s*/Page(?![A-Za-z0-9_])")))


def admit(files: DataFrame, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES) -> DataFrame:
    """Add ``verdict``: ok, or the first rule that fails."""
    c = F.col("content")
    # A declared type counts without its parameters and in any case; none is no fault, a missing name is one.
    mime = F.trim(F.split_part(F.lower(F.coalesce("declared_mime", F.lit(""))), F.lit(";"), F.lit(1)))
    rules = [
        (c.isNull() | (F.length(c) == 0), "EMPTY"),
        (F.length(c) > max_bytes, "TOO_LARGE"),
        (~F.lower(F.trim(F.coalesce("name", F.lit("")))).endswith(".pdf"), "BAD_EXTENSION"),
        ((mime != "") & ~mime.isin(*ACCEPTED), "BAD_MIME"),
        (F.substring(c, 1, 5) != F.lit(b"%PDF-"), "BAD_MAGIC"),
        (encrypted(c), "ENCRYPTED"),
        (~has_end_mark(c), "TRUNCATED"),
        (page_count(c) > max_pages, "TOO_MANY_PAGES"),
    ]
    out = F.lit("ok")
    for broken, why in reversed(rules):
        out = F.when(broken, why).otherwise(out)
    return files.withColumn("verdict", out)


def upload_allowed(length: Column, mime: Column, head: Column) -> Column:
    return F.when(length > UPLOAD_BYTES, "TOO_LARGE").when(mime != "application/pdf", "BAD_MIME").when(F.substring(head, 1, 5) != F.lit(b"%PDF-"), "BAD_MAGIC").otherwise("ok")


def safe_key(key: Column) -> Column:
    """Storage keys can't climb out of their folder."""
    return F.regexp_replace(F.regexp_replace(key, "\\.\\.+", ""), "^/+", "")


def quarantine_key(key: Column) -> Column:
    return F.concat(F.lit("quarantine/"), key)
