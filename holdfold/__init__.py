"""Point-in-time holdings analytics on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def packed(folder: str | None = None) -> str:
    """The package as a zip file, in ``folder`` or a temporary one of the driver's."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder or tempfile.mkdtemp(), "holdfold.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("holdfold", os.path.relpath(full, here)))
    return path


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, for clusters where it isn't installed; the driver serves the file."""
    spark.sparkContext.addPyFile(packed())
