"""Continuous scanning: new files become reports, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from inkwarden.operators import enrich, passes, report
from inkwarden.sources import files


def scan(found: DataFrame, folder: str | None = None, model: passes.Model | None = None) -> DataFrame:
    """Reports of guarded files; a file that could not be read has an error and no verdict.  What the files hold
    is used in many places: with a folder (that all executors share) it is written there first, and each file is
    parsed once.  A model's passes need the folder, so that each is run once."""
    held = files.extract(found)
    if folder is not None:
        held.write.mode("overwrite").parquet(folder)
        held = found.sparkSession.read.schema(held.schema).parquet(folder)
    extracted = enrich.with_ocr_differences(held.withColumn("doc_id", F.col("path")), (F.col("ext") == ".pdf") & (F.col("ocr_text") != ""))
    extracted = enrich.with_unicode_anomalies(extracted)
    errors = extracted.select("doc_id", "error")
    documents, semantic = extracted.select("doc_id", F.col("path").alias("file"), "file_hash"), None
    if model is not None and folder is not None:
        passes.layer(extracted, model, files.embedded_images(found).withColumnRenamed("path", "doc_id")).write.mode("overwrite").parquet(f"{folder}-passes")
        layer = found.sparkSession.read.parquet(f"{folder}-passes")
        documents, semantic = documents.join(layer, "doc_id"), passes.findings(layer)
    elif model is not None:
        raise ValueError("a model needs a folder for its results")
    done = passes.rewrite(report.reports(documents, extracted, semantic), model).join(errors, "doc_id")
    failed = F.col("error") != ""
    return done.withColumns({"verdict": F.when(~failed, F.col("verdict")), "score": F.when(~failed, F.col("score")), "exit_code": F.when(failed, 1).otherwise(F.col("exit_code"))})


def start(spark: SparkSession, inbox: str, out: str, checkpoint: str, model: passes.Model | None = None) -> StreamingQuery:
    """Scan what lies in inbox and stop; each micro-batch appends Parquet reports under out."""

    def sink(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure overwrites its own folder, so reports never double.
        # Readers of `out` pass over folders that begin with an underscore.
        scan(batch, f"{out}/_extracted/batch={number}", model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.read_stream(spark, inbox).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps the phases of queries as (phase, detail) in `events`."""

    def __init__(self) -> None:
        self.events: list[tuple[str, str]] = []

    def onQueryStarted(self, event) -> None:
        self.events.append(("start", str(event.id)))

    def onQueryProgress(self, event) -> None:
        self.events.append(("progress", str(event.progress.numInputRows)))

    def onQueryIdle(self, event) -> None:
        self.events.append(("idle", str(event.id)))

    def onQueryTerminated(self, event) -> None:
        self.events.append(("error" if event.exception else "complete", str(event.exception or event.id)))
