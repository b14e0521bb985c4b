"""What a session needs before the operators run in it."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

from reqweave.functions.jsonvals import use_last_duplicate

_SHIPPED: set[str] = set()
#: Bytes of one Arrow batch: what a task hands to its Python worker at a time (one row may be longer).
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="reqweave-")) / "reqweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, source.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, set what results depend on (UTC, last duplicate member wins) and bound the Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    use_last_duplicate(spark)
    return spark
