"""A watched folder as a stream: every new file is one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: how often the folder is looked at.
POLL = "5 seconds"


def watch_folder(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.csv", format: str = "csv",
    archive: str = "", options: dict[str, str] | None = None,
) -> DataFrame:
    """Stream of the records of files that appear in ``folder`` (not in its subfolders).

    With ``archive`` finished files move there once a later batch has committed. The
    checkpoint, not the move, makes sure that no file is read twice.
    """
    reader = (
        spark.readStream.format(format).schema(schema)
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "false")
        .options(**({"header": "true"} if format == "csv" else {})).options(**(options or {}))
    )
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    return reader.load(folder).select("*", F.col("_metadata.file_name").alias("file_name"))


def run_per_file(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    once: bool = False, format: str = "parquet",
) -> StreamingQuery:
    """Apply ``job`` to every batch of new files and keep one folder per file.

    A batch writes its own ``batch_id`` folder and overwrites it when it is run
    again, so a failure in the middle leaves nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/batch_id={batch_id}"
        job(batch).write.mode("overwrite").format(format).partitionBy("file_name").save(target)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)
    return writer.start()
