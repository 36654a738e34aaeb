"""Written tables between rounds, in the folder that the cluster shares.

Tables that only serve a result are deleted by ``finished`` as soon as that is written; what results still read goes when the
driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Paths of the tables that this thread has written, in order.
_WRITTEN = threading.local()
_LEFT: set[str] = set()


def _paths() -> list[str]:
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    return _WRITTEN.paths


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or a temporary folder where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if not named and app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-ridgeline-")
    return (named or _OWN[app]).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/trails/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _paths().append(path)
    _LEFT.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place among the tables of this thread, for ``finished``."""
    return len(_paths())


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` written, and all tables deleted that this thread has written since ``mark``: only ``df`` read them."""
    out = settled(df, name)
    kept = _paths().pop()
    released(df.sparkSession, since)
    _paths().append(kept)
    return out


def released(spark: SparkSession, since: int) -> None:
    """Delete all tables that this thread has written since ``mark``: nothing reads them any more."""
    for path in _paths()[since:]:
        delete(spark, path)
        _LEFT.discard(path)
    del _paths()[since:]


@atexit.register
def _end() -> None:
    """Delete what results have read, if the session still runs."""
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        for path in list(_LEFT) if spark is not None else ():
            delete(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path`` in its store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: A side is broadcast up to this many rows and bytes, counted before; beyond it is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def fits(df: DataFrame, row_bytes: int = 64) -> bool:
    """Whether df is within the bounds of a broadcast, counted here, a row as ``row_bytes``."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast in a join if it is within the bounds."""
    return F.broadcast(df) if fits(df) else df
