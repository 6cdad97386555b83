"""Analytics over ordered numeric series on PySpark."""

from __future__ import annotations


def ship(spark) -> None:
    """Send this package's source to all Python workers of the session, which must have it where it isn't installed on their machines."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="seriesmith-")  # the driver serves the file from here
    skip = shutil.ignore_patterns("__pycache__")
    shutil.copytree(here, f"{folder}/source/{here.name}", ignore=skip)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/seriesmith", "zip", f"{folder}/source"))
