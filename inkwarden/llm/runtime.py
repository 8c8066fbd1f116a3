"""What the operators share: cutting lineage, Arrow batch size, the definition of a word."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, \t, \n, \v, \f and \r (Java and Python syntax).
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"

#: Rows in one Arrow batch: very long texts must not meet by the thousand in a Python worker.
ARROW_ROWS = 256

_own_folder: list[str] = []
#: Folders that materialize wrote, while one or more scratch blocks are open.
_watched: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.  Where that is
    unset, a temporary folder serves local mode only; on a cluster this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="inkwarden-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: later stages restart from the file
    when an executor is lost, and nothing upstream runs twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _watched:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str, tag: str) -> DataFrame:
    """df with a column `name` that tells its rows apart and reads the same each time: of rows of Parquet files the
    file and the place in it, otherwise a running number in a copy that is written out."""
    try:
        place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        return df.withColumn(name, place).select(*df.columns, name)
    except AnalysisException:
        return materialize(df.withColumn(name, F.monotonically_increasing_id().cast("string")), tag)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the folders that materialize writes inside the block and removes, at its end, those that are
    still in the list.  Whatever is lazily read from them must be done by then."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched.remove(paths)
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as keep it from meeting a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fenced(df: DataFrame, names: list[str]) -> DataFrame:
    """df, with the named columns' expressions kept where they are.  A later filter on such a column
    would otherwise be pushed below the projections that build it, which copies their expressions
    into each other's lambdas; filters don't pass a projection that holds a running id."""
    (fence,) = unused(df, "__fence")
    df = df.withColumn(fence, F.monotonically_increasing_id())
    return df.withColumns({n: F.when(F.col(fence) >= 0, F.col(n)) for n in names}).drop(fence)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: ASCII other than digits and letters parts words; A-Z is lower-cased; bytes above ASCII stay.
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    """Words without case and punctuation, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
