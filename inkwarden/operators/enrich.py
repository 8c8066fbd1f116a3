"""What is derived from an extracted document before it is scanned: OCR differences and unicode anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.functions import text as T
from inkwarden.operators import unicode


def with_ocr_differences(extracted: DataFrame, applies: Column | None = None) -> DataFrame:
    """Words that only OCR sees and words that only the text layer has join hidden_text, as `ocr_only` and
    `extraction_only` at `ocr_diff`.  applies: which rows (by default those with OCR text)."""
    applies = F.col("ocr_text") != "" if applies is None else applies
    visible, ocr = F.col("visible_text"), F.col("ocr_text")

    def entry(content: Column, method: str) -> Column:
        row = F.struct(F.lit("ocr_diff").alias("location"), content.alias("content"), F.lit(method).alias("method"))
        return F.when(applies & (content != ""), row)

    more = F.array_compact(F.array(entry(T.tokens_only_in(ocr, visible), "ocr_only"), entry(T.tokens_only_in(visible, ocr), "extraction_only")))
    return extracted.withColumn("hidden_text", F.concat("hidden_text", more))


def unicode_scope(ext: Column) -> Column:
    """The text whose characters are looked at: with metadata for PDF, without a separating space for Word
    documents, nothing for images."""
    hidden = F.array_join(F.transform("hidden_text", lambda h: h.content), " ")
    metadata = F.array_join(F.transform(F.filter("metadata", lambda m: m.value != ""), lambda m: m.value), " ")
    return F.when(ext == ".pdf", F.concat("visible_text", F.lit(" "), metadata, F.lit(" "), hidden)).when(ext == ".docx", F.concat("visible_text", hidden)).otherwise("")


def with_unicode_anomalies(extracted: DataFrame, ext: Column | None = None) -> DataFrame:
    """unicode_anomalies filled from the scope that ext (by default the column of that name) implies."""
    out = extracted.withColumn("__scope", unicode_scope(F.col("ext") if ext is None else ext)).withColumn("__letters", unicode.look_alikes("__scope"))
    return out.withColumn("unicode_anomalies", unicode.anomalies(F.col("__scope"), letters=F.col("__letters"))).drop("__scope", "__letters")
