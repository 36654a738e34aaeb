"""Users, profiles and favourites: append logs with latest-row views, a table that is merged into, and inserts that replays don't repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import height_or_null
from ..sources.documents import append_once
from ..sources.scratch import delete, exists, mark, released, settled

#: Parts of a merged table, by the hash of the key; a merge rewrites those that hold a key of its batch.
BUCKETS = 64


def admitted(users: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of ``batch`` with ``ok``: false where the email is taken, in the table or earlier in the batch (ord)."""
    first = F.row_number().over(Window.partitionBy("email").orderBy("ord")) == 1
    taken = users.select("email").distinct().withColumn("_taken", F.lit(True))
    return batch.withColumn("_first", first).join(taken, "email", "left").withColumn("ok", F.col("_first") & F.col("_taken").isNull()).drop("_first", "_taken")


def numbered(rows: DataFrame, last_id: int) -> DataFrame:
    """Rows to insert with ids after ``last_id``: dense within each range of ord, by one small table of range sizes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(n, "ord").withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("ord"))
    return dealt.join(F.broadcast(before), "_part").withColumn("id", F.lit(last_id) + F.col("_before") + place).drop("_part", "_n", "_before")  # a row a partition


def insert_users(users: DataFrame, batch: DataFrame) -> DataFrame:
    """The users to append: those admitted, with ids."""
    last = users.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(admitted(users, batch).filter("ok").drop("ok"), last)


def insert_users_once(rows: DataFrame, table: str, batch: int) -> DataFrame:
    """Insert the users of a batch that are admitted, with ids of their own, however often the batch comes; returns its users.

    An id is the batch times 2 to the 40th and a dense number, so writers of different batches share none. Emails of the
    batch itself, from an earlier try, don't count as taken.
    """
    spark = rows.sparkSession
    users = spark.table(table).filter(F.col("batch") != batch) if spark.catalog.tableExists(table) else rows.select("email").limit(0)
    new = settled(numbered(admitted(users, rows).filter("ok").drop("ok"), batch << 40), "users")
    append_once(new, table, batch)
    return new


def verified(users: DataFrame, attempts: DataFrame, matches: Column) -> DataFrame:
    """attempts (email, password) with ``ok``; an unknown email fails like a wrong password.

    ``matches`` compares password_hash with the password; hashing itself is the caller's.
    """
    known = users.select("email", "password_hash", F.col("id").alias("user_id"))
    return attempts.join(known, "email", "left").withColumn("ok", F.coalesce(F.col("password_hash").isNotNull() & matches, F.lit(False))).drop("password_hash")


def favourite_rows(routes: DataFrame) -> DataFrame:
    """Favourites to append: the path as JSON text."""
    return routes.withColumn("path", F.to_json("path"))


def favourites_of(favourites: DataFrame, user_id: int) -> DataFrame:
    """A user's favourites, the latest first; the filter reaches the scan."""
    return favourites.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("id"))


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key of an append log: what an upsert would have left."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _overwrite(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in the place of the buckets they are of; the other buckets stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a merge that was broken off after its rows were ready, and forget one that was broken off before."""
    pending = f"{path.rstrip('/')}_pending"
    if exists(spark, f"{pending}/_SUCCESS"):
        _overwrite(spark.read.parquet(pending), path)
    delete(spark, pending)


def merge(updates: DataFrame, path: str, key: str, *order: str, buckets: int = BUCKETS) -> None:
    """Update or insert the rows of ``updates`` by ``key``, the last by ``order`` counting, into the Parquet table at ``path``.

    The table is parted by the hash of the key, and only the buckets that hold a key of the batch are read and rewritten, so
    it holds a row a key and reads need no sorting. The new buckets are complete in a table beside it before they take the
    place of the old ones: a merge that breaks off is finished by ``recover``, which every merge calls first. Batches may
    come again and in any order: an older row never takes the place of a newer one. One writer at a time.
    """
    spark = updates.sparkSession
    recover(spark, path)
    columns, bucket = updates.columns, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    began = mark()
    new = settled(latest(updates, key, *order).select(*columns, bucket), "updates")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
    if not touched:
        return
    if exists(spark, path):
        new = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(*columns, "bucket").unionByName(new)
    pending = f"{path.rstrip('/')}_pending"
    latest(new, key, *order).select(*columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(pending)
    released(spark, began)
    recover(spark, path)


def merged_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a merged table, one a key."""
    return spark.read.parquet(path).drop("bucket")


def profiles_of(users: DataFrame, log: DataFrame) -> DataFrame:
    """Every user's latest profile; empty texts where there is none."""
    found = latest(log, "user_id", "updated_at")
    out = users.select(F.col("id").alias("user_id")).join(found, "user_id", "left")
    return out.select("user_id", "height_cm", F.coalesce("experience_level", F.lit("")).alias("experience_level"), F.coalesce("route_preference", F.lit("")).alias("route_preference"))


def profile_updates(batch: DataFrame) -> DataFrame:
    """Profile rows to append: an empty height is null."""
    return batch.withColumn("height_cm", height_or_null(F.col("height_cm")))


def without_orphans(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user exists."""
    return rows.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
