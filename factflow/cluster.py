"""Getting this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they run: a zip file that Spark hands to each executor.

    Done once for each application. Workers that already find the package keep using theirs.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="factflow-package-")  # executors that start later fetch it too
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = Path(folder) / "factflow_package.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    _shipped.add(app)
