"""Making the code importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, folder: str | Path | None = None) -> None:
    """Send a package, this one by default, to the workers of the session, once.

    Not needed where the package is installed on the cluster or was given with
    --py-files.
    """
    root = Path(folder) if folder else Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if (sc.applicationId, str(root)) in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="prefops-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add((sc.applicationId, str(root)))
