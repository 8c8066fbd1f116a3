"""What extractor libraries yield, as tables: text spans of pages, runs of Word documents, fonts, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distance from white per channel, opacity that can be seen, font types that may remap glyphs.
WHITE = 0.08
LEAST_ALPHA = 0.05
FONT_TYPES = ("Type3", "CIDFontType0", "CIDFontType2")


def span_method(strict_zero_font: bool = False) -> Column:
    """Of size, render_mode, origin_x, origin_y, page_w, page_h, alpha (0..255) and color (packed RGB): how
    a span is hidden, or 'visible'; the first that fits.  A font size of exactly 0 means unknown, unless strict."""
    tiny = (F.col("size") < 1) & (F.lit(strict_zero_font) | (F.col("size") != 0))
    inside = F.col("origin_x").between(0, F.col("page_w")) & F.col("origin_y").between(0, F.col("page_h"))
    channel = lambda shift: F.abs(F.shiftright("color", shift).bitwiseAND(255) / F.lit(255.0) - 1) <= WHITE
    return (
        F.when(tiny, "zero_font").when(F.col("render_mode") == 3, "invisible_render").when(F.col("render_mode") == 7, "clip_render").when(~inside, "off_page")
        .when(F.col("alpha") / F.lit(255.0) < LEAST_ALPHA, "transparent").when(channel(16) & channel(8) & channel(0), "color_match").otherwise("visible")
    )


def classify_spans(spans: DataFrame, strict_zero_font: bool = False) -> DataFrame:
    return spans.where(F.trim("text") != "").withColumn("method", span_method(strict_zero_font))


def visible_text(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """Visible spans joined by spaces in order, pages by line ends, white space at the ends removed."""
    rows = classified.where("method = 'visible'").groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct("ord", F.trim("text").alias("t")))).alias("s"))
    pages = rows.select(key, "page", F.array_join(F.transform("s", lambda x: x.t), " ").alias("line"))
    joined = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "line"))).alias("p"))
    return joined.select(key, F.regexp_replace(F.array_join(F.transform("p", lambda x: x.line), "\n"), r"(?U)^\s+|\s+$", "").alias("visible_text"))


def run_method() -> Column:
    """Of vanish, sz (half-points, text) and color (hex text): how a Word run is hidden, null if it isn't."""
    return F.when(F.col("vanish"), "vanish").when(F.col("sz").try_cast("int") < 2, "tiny_font").when(F.upper("color") == "FFFFFF", "color_match")


def classify_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.trim("text") != "").withColumn("method", run_method())


def unusual_fonts(fonts: DataFrame, key: str = "doc_id") -> DataFrame:
    """First sighting of each font of a document, of the types that may remap glyphs; fonts: key, page, ord, font_name, font_type."""
    w = Window.partitionBy(key, "font_name").orderBy("page", "ord", "font_type")
    return fonts.where(F.col("font_type").isin(*FONT_TYPES)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def layer_differences(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hidden layers: pages has key, layer_name, page, off, on (the page's text without and with the layer);
    the texts of changed pages, in order, by layer."""
    rows = pages.where("on <> off").groupBy(key, "layer_name").agg(F.sort_array(F.collect_list(F.struct("page", "on"))).alias("p"))
    return rows.select(key, "layer_name", F.trim(F.array_join(F.transform("p", lambda x: x.on), "\n")).alias("content"))


def first_images(images: DataFrame, key: str = "doc_id", most: int = 20, least_area: int = 2500) -> DataFrame:
    """The first `most` images of a document of enough area; images: key, ord, width, height."""
    big = images.where(F.col("width") * F.col("height") >= least_area)
    return big.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("rank") <= most)
