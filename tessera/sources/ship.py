"""Send this package to the executors of a session.

Python functions are pickled by the name of their module, so the workers must
be able to import it.  Where the package isn't installed on every machine,
the driver's file server hands it out; the archive itself is read by the
driver only.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship() -> None:
    """Once per Spark context; nothing without one."""
    sc = SparkContext._active_spark_context
    if sc is None or getattr(sc, "_tessera_shipped", False):
        return
    sc._tessera_shipped = True
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(_ROOT):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tessera", os.path.relpath(path, _ROOT)))
    sc.addPyFile(archive)
