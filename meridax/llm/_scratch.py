"""Working tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # by application: a folder made for a local session that names none


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session on one machine (tests) may leave it unset and gets a temporary folder."""
    context = spark.sparkContext
    path = spark.conf.get(_KEY, None) or context.getConf().get(_KEY, None) or _own.get(context.applicationId)
    if not path:
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        path = _own[context.applicationId] = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, path, True)
    return path.rstrip("/")


def staged(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and return a reader of it: a cut of the lineage that survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def discard(spark: SparkSession, frame: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
