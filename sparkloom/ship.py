"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


#: Rows in an Arrow batch, where the session has Spark's own 10000: documents are long, and a Python worker holds a batch or two.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send the package to every executor as a zip file, once for each application, and bound Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
