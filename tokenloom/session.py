"""What a session needs before Python kernels run on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: The setting that bounds the bytes of an Arrow batch, and its value where a session has none: rows vary from a word to megabytes.
BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, and sends this package to the executors once for each Spark context, so that it needn't be installed there."""
    if spark.conf.get(BYTES, None) is None:
        spark.conf.set(BYTES, BATCH)
    context = spark.sparkContext
    if getattr(context, "_tokenloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tokenloom-"), "tokenloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tokenloom", os.path.relpath(full, PACKAGE)))
    context.addPyFile(path)
    context._tokenloom_shipped = True
