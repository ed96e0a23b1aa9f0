"""A directory of exports as a stream into the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parlance.plans.update import merge_lines

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_exports(spark: SparkSession, folder: str, root: str, claims: DataFrame, checkpoint: str,
                   chat_id=None, max_files: int = 256) -> StreamingQuery:
    """Merges every new export file of `folder` into the archive under `root`.

    A micro-batch takes whole files, so it runs the batch merge as it is. Late messages go to
    their own place in time, and a batch that is run again adds nothing, since its rows are
    duplicates by then; hence no watermark and no state. The stream lists new files only;
    the batch reads them as text splits. A batch names at most `max_files` files to the driver.
    """
    reader = spark.readStream.format("binaryFile").schema(FILES)
    found = reader.option("maxFilesPerTrigger", max_files).load(folder).select("path")

    def merge_batch(batch: DataFrame, _: int) -> None:
        files = [r["path"] for r in batch.orderBy("path").collect()]
        if files:
            merge_lines(batch.sparkSession, files, root, claims, chat_id)

    return (
        found.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
