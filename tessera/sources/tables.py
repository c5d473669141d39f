"""Parquet tables of a data directory, and tables written to cut lineage.

``stage`` writes an intermediate result to the shared folder that the cluster
names in ``spark.checkpoint.dir`` and reads it back.  Unlike a
``localCheckpoint`` it survives lost executors, and unlike a plain
``checkpoint`` it is compressed, columnar and carries sizes that the planner
can use when it chooses join strategies.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths staged within the scratch blocks that are open.
_OPEN: list[list[str]] = []
#: Tables that are staged once a session.
_KEPT: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a single file or a folder of files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a session of one machine that names none.

    A session whose executors may be elsewhere must name one: a folder of the
    driver's machine would be another folder on each of theirs.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            named = known.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            named = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, label: str = "t", keep: bool = False, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The files go when the application ends, or earlier through ``drop`` or at
    the end of a ``scratch`` block unless they are to ``keep``.  With ``free``
    the shuffle files of the write go at once, not when the driver happens to
    collect its garbage: for loops whose steps shuffle as much as the input.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    try:
        if free:
            spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(_CLEANUP, before)
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    for made in [] if keep else _OPEN:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def kept(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, staged once a session for each state of the ``source`` that it is made of."""
    where, of_source = _file_system(spark, source)
    _, fs = _file_system(spark, shared_dir(spark))
    key = (spark.sparkContext.applicationId, source, of_source.getFileStatus(where).getModificationTime(), name)
    made = _KEPT.get(key)
    if made is None or not fs.exists(_file_system(spark, made._tessera_path)[0]):  # the folder may have been cleaned
        made = _KEPT[key] = stage(make(), name, keep=True)
    return made


def together(*staged: DataFrame) -> DataFrame:
    """Staged tables of the same columns as one scan: their small files share tasks, and the plan stays small."""
    return staged[0].sparkSession.read.schema(staged[0].schema).parquet(*[df._tessera_path for df in staged])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what is staged within the block when it ends: for callers that are done with an answer by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for path in made:
            where, fs = _file_system(spark, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)


def drop(*staged: DataFrame | None) -> None:
    """Delete staged tables that no later plan reads."""
    for df in staged:
        path = getattr(df, "_tessera_path", None)
        if path:
            where, fs = _file_system(df.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)
