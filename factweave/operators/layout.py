"""Positioned text items to lines, column anchors and tables, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds in points and counts.
LINE_GAP, SPACE_GAP, ANCHOR_GAP, BLOCK_FACTOR, BLOCK_LEAST = 2.5, 0.6, 12.0, 1.8, 14.0
LEAST_ITEMS, LEAST_ROWS, LEAST_COLUMNS, NUMERIC_SHARE = 3, 3, 2, 0.25
IMAGE_ONLY_CHARS, OCR_CHARS = 25, 50
PAGE = ["doc_id", "page"]


def affine(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two affine matrices (a, b, c, d, e, f)."""
    return [a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]]


def round_point(x: Column) -> Column:
    """Two decimals, halves upward."""
    return F.floor(x * 100 + 0.5) / 100


def placed(raw: DataFrame) -> DataFrame:
    """Items at their place on the shown page, from (doc_id, page, item, str, transform, viewport, width, height, has_eol).

    The text matrix is composed with the page's viewport, both as arrays of six, so rotation and crop are accounted for; y runs down from
    the top and an item hangs from its baseline. A missing width is 0, a height that isn't positive is the font's; items without text go.
    """
    m = affine(*([F.get(c, F.lit(i)) for i in range(6)] for c in ("viewport", "transform")))
    rows = raw.where(F.length("str") > 0).withColumns({f"_m{i}": c for i, c in enumerate(m)})
    rows = rows.withColumn("_font", F.hypot("_m2", "_m3")).withColumn("_high", F.when(F.col("height") > 0, F.col("height")).otherwise(F.col("_font")))
    at = {"x": F.col("_m4"), "y": F.col("_m5") - F.col("_high"), "width": F.coalesce("width", F.lit(0.0)), "height": F.col("_high"), "font_height": F.col("_font")}
    return rows.select(*PAGE, "item", "str", *(round_point(c).alias(name) for name, c in at.items()), F.coalesce("has_eol", F.lit(False)).alias("has_eol"))


def bounding_box(page: Column, x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    """Corners in two decimals."""
    return F.struct(page.alias("page"), round_point(x).alias("x0"), round_point(y).alias("y0"), round_point(x + width).alias("x1"), round_point(y + height).alias("y1"), F.lit("pt").alias("unit"), F.lit("top-left").alias("origin"), rotation.alias("rotation"))


def image_only(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "\\s", "")) < IMAGE_ONLY_CHARS


def numberish(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike("(?i)^[(+-]?\\s*[₹$€£]?\\s*[0-9,]+(\\.[0-9]+)?\\s*[)%x×]?$") | t.rlike("^\\(?[0-9,]+(\\.[0-9]+)?\\)?$")


def _islands(rows: DataFrame, within: list[str], order: list[str], broken: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(broken, F.lit(False)).cast("int")).over(w))


def with_lines(items: DataFrame) -> DataFrame:
    """Add ``line``: a new one where the item lies lower than the one before by more than the tolerance."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "item")
    return _islands(items.withColumn("_gap", F.abs(F.col("y") - F.lag("y").over(w)) > LINE_GAP), PAGE, ["y", "x", "item"], F.col("_gap"), "line").drop("_gap")


def lines(items: DataFrame) -> DataFrame:
    """Text and box of each line; a space stands only where items leave a gap."""
    rows = with_lines(items)
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "item")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    rows = rows.withColumn("part", F.concat(F.when(gap > SPACE_GAP, " ").otherwise(""), F.col("str")))
    made = rows.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("x", "item", "part"))).alias("p"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max("height").alias("height"), F.count("*").alias("n_items"))
    return made.withColumn("text", F.array_join(F.col("p.part"), "")).drop("p")


def with_blocks(items: DataFrame) -> DataFrame:
    """Items of table rows (lines of three items or more) with ``block``: a new one after a wide vertical gap."""
    # Windows over the page throughout: the items are never moved or made again to meet what their lines add up to.
    line, order = Window.partitionBy(*PAGE, "line"), ["line", "x", "item"]
    rows = with_lines(items).withColumns({"_y": F.min("y").over(line), "_h": F.max("height").over(line), "_m": F.count("*").over(line)}).where(F.col("_m") >= LEAST_ITEMS)
    w = Window.partitionBy(*PAGE).orderBy(*order)
    gap = F.col("_y") - F.lag("_y").over(w) > F.greatest(F.lag("_h").over(w) * BLOCK_FACTOR, F.lit(BLOCK_LEAST))
    first = ~F.lag("line").over(w).eqNullSafe(F.col("line"))
    blocks = _islands(rows.withColumns({"_first": first, "_gap": first & gap}), PAGE, order, F.col("_gap"), "block")
    n_rows = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(*PAGE, "block"))
    return blocks.withColumn("_n", n_rows).where(F.col("_n") >= LEAST_ROWS).drop("_y", "_h", "_m", "_first", "_gap", "_n")


def anchors(items: DataFrame) -> DataFrame:
    """Column anchors of each block: mean centres of items whose centres follow closely."""
    return block_anchors(with_blocks(items))


def block_anchors(blocks: DataFrame) -> DataFrame:
    return _columns(blocks).groupBy(*PAGE, "block", "col").agg(F.avg("cx").alias("anchor"))


def _columns(blocks: DataFrame) -> DataFrame:
    """Items with their centre and the column that it falls in."""
    rows = blocks.withColumn("cx", F.col("x") + F.col("width") / 2)
    w = Window.partitionBy(*PAGE, "block").orderBy("cx", "item")
    return _islands(rows.withColumn("_gap", F.col("cx") - F.lag("cx").over(w) > ANCHOR_GAP), [*PAGE, "block"], ["cx", "item"], F.col("_gap"), "col").drop("_gap")


def cells(items: DataFrame) -> DataFrame:
    """Cells of each table: items go to the nearest anchor (the left one on a tie), those of one cell are joined left to right."""
    # Anchors are few for each block, so each item sees all of its block's.
    rows = _columns(with_blocks(items)).withColumn("anchor", F.avg("cx").over(Window.partitionBy(*PAGE, "block", "col")))
    every = F.array_sort(F.collect_set(F.struct("col", "anchor")).over(Window.partitionBy(*PAGE, "block")))
    rows = rows.withColumn("a", every).where(F.size("a") >= LEAST_COLUMNS)
    nearest = F.array_min(F.transform("a", lambda a: F.struct(F.abs(a["anchor"] - F.col("cx")).alias("d"), a["col"].alias("col"))))
    rows = rows.withColumn("col", nearest["col"])
    made = rows.groupBy(*PAGE, "block", "line", "col").agg(F.array_sort(F.collect_list(F.struct("x", "item", "str"))).alias("p"))
    return made.select(*PAGE, "block", F.dense_rank().over(Window.partitionBy(*PAGE, "block").orderBy("line")).alias("row"), "col", F.array_join(F.col("p.str"), "").alias("text"))


def tables(items: DataFrame) -> DataFrame:
    """Blocks with enough numeric cells, as one row each."""
    found = cells(items).groupBy(*PAGE, "block").agg(F.max("row").alias("n_rows"), F.countDistinct("col").alias("n_cols"), F.count("*").alias("n_cells"), F.count_if(numberish(F.col("text"))).alias("n_numeric"))
    return found.where(F.col("n_numeric") >= NUMERIC_SHARE * F.col("n_cells"))


def grid(table_cells: DataFrame) -> DataFrame:
    """Row-major rows of cell texts, blank where no cell is."""
    rows = table_cells.groupBy(*PAGE, "block", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("col").alias("last"))
    widest = F.max("last").over(Window.partitionBy(*PAGE, "block"))
    return rows.withColumn("w", widest).select(*PAGE, "block", "row", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("w").cast("bigint")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("cells"))


def text_class(pages: DataFrame) -> DataFrame:
    """TEXT_EXTRACTABLE, OCR_REQUIRED below 50 characters a page, or CORRUPTED if a page could not be read (``error``, where the reader gives one)."""
    broken = F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)) if "error" in pages.columns else F.lit(False)
    rows = pages.groupBy("doc_id").agg(F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"), F.count("*").alias("n_pages"), broken.alias("_broken"))
    return rows.withColumn("text_class", F.when(F.col("_broken"), "CORRUPTED").when(F.col("chars") < OCR_CHARS * F.col("n_pages"), "OCR_REQUIRED").otherwise("TEXT_EXTRACTABLE")).drop("_broken")
