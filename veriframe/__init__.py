"""Record verification and training-data preparation as Spark jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Give the executors this package, once for each application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="veriframe-")) / "veriframe.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target.resolve()))  # as the JVM sees it: a relative or /proc path is not the same there
