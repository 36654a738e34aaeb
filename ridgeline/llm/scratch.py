"""Written tables that cut lineage, in the folder that the cluster shares.

Tables that only serve others are deleted by ``dropped`` as soon as those are written; what a result still reads stays
until the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Paths of tables that were not dropped yet, by application.
_KEPT: dict[str, set[str]] = {}
#: Bytes of the tables that it is made from, for which a table gets a file.
FILE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-ridgeline-")
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/ridgeline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _KEPT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def gathered(df: DataFrame, *tables: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``df`` in one partition for so many bytes of the written ``tables`` that it is made from, and as many as there are cores at least.

    It never has more partitions than before. For tables that a shuffle deals over more partitions than their rows need:
    every file costs the executor processes of its own where the shared folder is a local one (Hadoop starts ``chmod``).
    """
    spark = df.sparkSession
    size = 0
    for table in tables:
        place, files = _place(spark, table.scratch_path)
        size += files.getContentSummary(place).getLength()
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // file_bytes)))


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)
    _KEPT.get(spark.sparkContext.applicationId, set()).discard(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


@atexit.register
def _end() -> None:
    """Delete what results have read, if the session still runs."""
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        for path in list(_KEPT.get(spark.sparkContext.applicationId, ())) if spark is not None else ():
            _delete(spark, path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, Python workers get at most so many rows at once; for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A side is broadcast up to this many rows and bytes, counted before; beyond it is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def fits(df: DataFrame, text: str | None = None, row_bytes: int = 64) -> bool:
    """Whether df is within the bounds of a broadcast, counted here. A row counts ``row_bytes`` and the length of its column ``text``."""
    extra = F.octet_length(text) if text else F.lit(0)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(extra + row_bytes), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small_side(df: DataFrame, text: str | None = None, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if it is within the bounds; df itself otherwise."""
    return F.broadcast(df) if fits(df, text, row_bytes) else df
