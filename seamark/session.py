"""What a Spark session needs: this library's code on the executors, and a folder that all of them share for tables in between."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that workers can import it wherever it is installed on the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="seamark-code-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seamark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        _remove(spark, path)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/seamark-{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, computed once and written to the shared folder: lineage is cut there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a table of written() that no later plan reads."""
    for f in df.inputFiles()[:1]:
        _remove(df.sparkSession, f.rpartition("/")[0])
