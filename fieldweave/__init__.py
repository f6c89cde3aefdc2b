"""fieldweave: split, weight and merge local neighbourhoods of fields, on Spark."""

from __future__ import annotations

import os
import shutil
import tempfile


def ship(spark) -> None:
    """Send the package to the executors of a session whose Python workers wouldn't find it.

    They find it by PYTHONPATH, in the folder the session was started from, or where it is
    installed with Python; else it goes out once for each context, as a zip by ``addPyFile``.
    """
    context, here = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = {os.path.abspath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd())}
    if here in found or os.path.basename(here) in ("site-packages", "dist-packages") or getattr(context, "_fieldweave", False):
        return
    folder = tempfile.mkdtemp(prefix="fieldweave-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "fieldweave"), "zip", here, "fieldweave"))
    context._fieldweave = True
