"""Files as rows: extension, size and signature guards, content hash, and extraction by format."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden import schemas
from inkwarden.sources import docx, image, pdf

# What is accepted.
EXTENSIONS = (".pdf", ".docx", ".jpg", ".jpeg", ".png")
MOST_BYTES = 50 * 1024 * 1024
SIGNATURES = {".pdf": "25504446", ".docx": "504B0304", ".jpg": "FFD8FF", ".jpeg": "FFD8FF", ".png": "89504E47"}
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
EXTRACTORS: dict[str, Callable[[bytes], dict]] = {".pdf": pdf.extract, ".docx": docx.extract, ".jpg": image.extract, ".jpeg": image.extract, ".png": image.extract}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./?#]+)(?:[?#].*)?$", 1))


def accepted(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def small_enough(length: Column) -> Column:
    return length <= MOST_BYTES


def signature_fits(content: Column, ext: Column) -> Column:
    """Whether the first bytes are those of the extension's format; unknown extensions pass."""
    head, out = F.hex(F.substring(content, 1, 4)), F
    for e, s in SIGNATURES.items():
        out = out.when(ext == e, head.startswith(s))
    return out.otherwise(F.lit(True))


def media_type(ext: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("image/png"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files under path: path, ext, length, content."""
    return guarded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return guarded(spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").load(path))


def guarded(files: DataFrame) -> DataFrame:
    """Rejected files stay as rows with an error, so that nothing vanishes silently; their content is dropped."""
    ext = extension(F.col("path"))
    error = (
        F.when(~F.coalesce(accepted(F.col("path")), F.lit(False)), F.concat(F.lit("unsupported file type "), ext))
        .when(~small_enough(F.col("length")), "file too large").when(~signature_fits(F.col("content"), ext), "content does not match the file type").otherwise("")
    )
    out = files.select("path", ext.alias("ext"), "length", "content", error.alias("error"))
    return out.withColumn("content", F.when(F.col("error") == "", F.col("content")))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*schemas.EXTRACTED, "error"]
    for batch in batches:
        rows = []
        for ext, content, error in zip(batch["ext"], batch["content"], batch["error"], strict=True):
            row: dict = {}
            if not error:
                try:
                    row = EXTRACTORS[ext](bytes(content))
                except Exception as e:  # a bad file is a row with an error, not a failed job
                    error = f"extraction failed: {type(e).__name__}"
            rows.append({n: row.get(n) for n in schemas.EXTRACTED} | {"error": error})
        out = pd.DataFrame(rows, columns=names)
        yield pd.concat([batch[["path", "ext", "file_hash"]].reset_index(drop=True), out], axis=1)


def extract(files: DataFrame) -> DataFrame:
    """One row per file: path, ext, file_hash, error and the columns of schemas.EXTRACTED, none null."""
    spark = files.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 16:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # files may have 50 MiB each
    schema = "path string, ext string, file_hash string, " + ", ".join(f"{n} {k}" for n, k in schemas.EXTRACTED.items()) + ", error string"
    hashed = files.withColumn("file_hash", content_hash(F.coalesce("content", F.lit(b""))))
    return schemas.completed(hashed.select("path", "ext", "file_hash", "content", "error").mapInPandas(_extract, schema))


def embedded_images(files: DataFrame) -> DataFrame:
    """Images inside Word documents, by their headers: path, ord, location, media_type, width, height, content."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["location", "ext", "width", "height", "content"]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, i, *(x[n] for n in names)) for i, x in enumerate(docx.images(bytes(content)))]
                except Exception:  # a broken archive has no images; `extract` gives its error
                    continue
            yield pd.DataFrame(out, columns=["path", "ord", *names])

    docs = files.where("ext = '.docx' and content is not null").select("path", "content")
    found = docs.mapInPandas(rows, "path string, ord int, location string, ext string, width int, height int, content binary")
    return found.select("path", "ord", "location", media_type(F.col("ext")).alias("media_type"), "width", "height", "content")
