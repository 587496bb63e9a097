"""Make this package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors through Spark's file server, once an application, unless PYTHONPATH has it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    target = Path(tempfile.mkdtemp(prefix="lectern-ship-")) / "lectern_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "lectern").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
