"""Working tables in the folder that driver and executors share.

An operator that needs to cut lineage, to iterate, or to number rows writes a
Parquet table below ``spark.checkpoint.dir`` and reads it again. A lost executor
then costs only the tasks it ran: no result lives on its own disk.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[int, str] = {}
_TO_DROP: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or ``setCheckpointDir`` names.

    Without either, a private one under a local master (tests); on a cluster that
    is an error, for a folder of the driver's machine isn't shared.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    key = id(sc)
    if key not in _OWN_ROOT:
        _OWN_ROOT[key] = "file://" + tempfile.mkdtemp(prefix="twinscope-")
    return _OWN_ROOT[key]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; dropped when the driver's Python ends."""
    path = f"{shared_root(spark)}/twinscope-work/{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    _TO_DROP.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; its lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete a working folder that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _TO_DROP:
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the session may be gone: then the folder's owner clears it
            pass
