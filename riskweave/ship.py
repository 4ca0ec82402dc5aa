"""Makes the package importable on executors, and bounds what a Python worker gets at once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
#: Bytes of rows in one batch to a Python worker, whatever the number of rows; long texts make short batches.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to Python workers, once for each context; batches to them are bounded in every session that uses it."""
    context = spark.sparkContext
    if getattr(context, "_riskweave_sent", False) is False:
        folder = Path(tempfile.mkdtemp())
        with zipfile.ZipFile(path := folder / "riskweave.zip", "w") as z:
            for f in sorted(HERE.rglob("*.py")):
                z.write(f, f.relative_to(HERE.parent))
        context.addPyFile(str(path))  # served from there as long as the driver lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._riskweave_sent = True
    spark.conf.set(BATCH[0], BATCH[1])
    return spark
