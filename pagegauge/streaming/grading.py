"""Continuous grading: captures arrive, report rows are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegauge.functions import urls as U
from pagegauge.plans import reports


def grade_stream(captures: DataFrame, site_files: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Grade each micro-batch with the batch plan and write it to its own folder.

    A batch that is run again after a failure overwrites its folder, so every capture is reported once. ``site_files`` is read
    anew by each batch, so new files count from the next batch on, but only those of the batch's origins are worked out.
    ``trigger`` are the arguments of the stream's trigger; the default reads what is there and stops.
    """

    def grade(batch: DataFrame, batch_id: int) -> None:
        origins = batch.select(U.origin(F.col("final_url")).alias("origin")).distinct()
        reports.build_reports(batch, site_files.join(origins, "origin", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        captures.writeStream.foreachBatch(grade)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
