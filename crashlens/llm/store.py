"""Lineage cuts: Parquet tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster sets it. Where it is unset, a session on one
    machine (``local``, ``local[n]``) gets a temporary folder; any other session is refused,
    as its executors would not see the driver's folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that does not exist yet; it is removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later steps read the table, and a lost
    executor costs no more than rereading it."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that tasks find it wherever the
    driver loaded it from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"{here.parent.name}_{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr(f"{here.parent.name}/__init__.py", "")
        for source in sorted(here.glob("*.py")):
            z.write(source, f"{here.parent.name}/{here.name}/{source.name}")
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
