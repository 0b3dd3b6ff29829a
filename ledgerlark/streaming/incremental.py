"""Incremental forms of two batch jobs.

The load appends files in chunks and the prediction table is upserted in batches;
both carry over to micro-batches of newly arrived files without any state.
"""

from ledgerlark.schemas import CLEAN_LINES
from ledgerlark.sources.tables import CSV_OPTIONS, prepare_lines_for_load, upsert_predictions


def append_new_files(spark, source, target, checkpoint, files_per_batch=1000):
    """Append the clean lines of files not loaded before, exactly once per file, and stop."""
    lines = (
        spark.readStream.schema(CLEAN_LINES)
        .options(**CSV_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(source)
    )
    query = (
        prepare_lines_for_load(lines)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_stream(predictions, root, checkpoint):
    """Upsert a stream of predictions into the partitioned table at ``root``. Replaying
    a batch after a failure writes the same rows again, so the result is unchanged."""

    def upsert(batch, _):
        if not batch.isEmpty():
            upsert_predictions(batch.sparkSession, root, batch)

    return (
        predictions.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
