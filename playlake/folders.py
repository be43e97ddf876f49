"""A folder for intermediate files that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_FOLDERS: dict[str, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; the folder's owner cleans it then
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, below ``spark.checkpoint.dir``; only a local master may do without that setting.  It goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        master = spark.sparkContext.master
        if not root and master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = root or "file://" + tempfile.mkdtemp(prefix="playlake-core-")
        _FOLDERS[app] = f"{root.rstrip('/')}/playlake-core-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"
