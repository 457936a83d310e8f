"""Tables between the stages of a run, in the folder the cluster shares, and their life.

Staged tables lie in a :class:`Workspace`, a folder of its own under the shared one.  It is deleted as a whole when it is
closed: at the end of its ``with`` block, or, for what is staged outside of any, at the end of the application::

    with Workspace(spark):
        result = run(requests, videos, comments)
        save_csv(...)                       # the results are read here
"""

from __future__ import annotations

import atexit
import uuid
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_innermost: ContextVar["Workspace | None"] = ContextVar("workspace", default=None)
_of_applications: dict[str, "Workspace"] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all in it, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """A folder for the tables of one run; what it holds can be read until it is closed."""

    def __init__(self, spark: SparkSession) -> None:
        self.folder = f"{shared_folder(spark)}/sparkcomments-{uuid.uuid4().hex}"
        self._spark, self._outer = spark, None

    def path(self, name: str) -> str:
        """A new path in the folder."""
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def staged(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """``df``, written once and read back.

        Cuts the lineage at a point where several outputs share costly work: it is
        done once, survives lost executors, and each reader scans only its columns.
        """
        path = self.path(name)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the folder, wherever the shared folder is; closing twice does no harm."""
        delete_folder(self._spark, self.folder)

    def __enter__(self) -> "Workspace":
        self._outer = _innermost.set(self)
        return self

    def __exit__(self, *_) -> None:
        _innermost.reset(self._outer)
        self.close()


def workspace(spark: SparkSession) -> Workspace:
    """The innermost open workspace, else that of the application."""
    return _innermost.get() or _of_applications.setdefault(spark.sparkContext.applicationId, Workspace(spark))


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """:meth:`Workspace.staged` in the workspace in use."""
    return workspace(df.sparkSession).staged(df, name, partition_by)


@atexit.register
def close_applications() -> None:
    """Delete what was staged outside of ``with`` blocks."""
    while _of_applications:
        _, own = _of_applications.popitem()
        try:
            own.close()
        except (Py4JError, OSError, AttributeError):  # the session has gone before
            pass
