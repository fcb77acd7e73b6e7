"""Session settings that suit the jobs of this library."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "loomline", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the submitter's own settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it wherever the driver runs."""
    context = spark.sparkContext
    if getattr(context, "_loomline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='loomline-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(made)
    context._loomline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a temporary folder as its own; a cluster must name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(folder)
        remove_at_end(spark, folder)
    return folder.rstrip("/")


#: Folders to remove when the driver's Python ends, each with the settings of the file system that it is in.
_REMOVED: dict[str, object] = {}


def remove(path: str, conf) -> None:
    """Delete a folder, also after the session has been stopped; its Java process lives as long as the driver's Python."""
    folder = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    if not _REMOVED:
        atexit.register(remove_all)
    _REMOVED[path] = spark.sparkContext._jsc.hadoopConfiguration()


def remove_all() -> None:
    """Delete all folders that were to go; one that can't be deleted doesn't keep the others."""
    while _REMOVED:
        try:
            remove(*_REMOVED.popitem())
        except Exception as error:  # noqa: BLE001
            print(f"a temporary folder stays: {error}")
