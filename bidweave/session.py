"""Session helpers: shipping the package to Python workers and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH = threading.local()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it.

    Where none is set, a temporary one is set for a local session, as in tests; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="bidweave-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return "/".join([f"{shared_dir(spark)}/bidweave-{spark.sparkContext.applicationId}", *getattr(_SCRATCH, "names", [])])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread's work writes with `written` within the block is deleted at its end, results that were not written elsewhere included."""
    names = _SCRATCH.names = getattr(_SCRATCH, "names", [])
    names.append(f"scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, _folder(spark))
        names.pop()


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this application has written to the shared folder. Results that read them end with them."""
    _delete(spark, _folder(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
