"""Making the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once, unless the workers' path already has it."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quillguard-"), "quillguard.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "quillguard").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(target)  # Spark copies it to every executor, late ones too
    _SHIPPED.add(app)
