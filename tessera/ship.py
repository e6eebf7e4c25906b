"""Makes this package importable on executors, wherever the driver has it from."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of rows that go to or from a Python worker at once, where the session doesn't say otherwise: rows may be long.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors, once for each application; bounds batches for Python workers."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of (spark, ...) that ships the package before it runs."""

    @wraps(query)
    def run(spark: SparkSession, *rest: object) -> DataFrame:
        return query(ship(spark), *rest)

    return run
