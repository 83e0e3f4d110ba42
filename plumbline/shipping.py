"""Give the executors this package where they would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def found(root: Path = ROOT) -> bool:
    """Is the package on the path that Python workers inherit?"""
    inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return any(Path(p).resolve() == root for p in [*inherited, os.getcwd()])


def ship(spark: SparkSession) -> bool:
    """Add the package as a zip to the session's files, once for each application; says whether it did so."""
    app = spark.sparkContext.applicationId
    if app in _SENT or found():
        return False
    path = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "plumbline").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
    return True
