"""Status of requests: what the service would answer, a column for a whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assembly import by_first

MIN_PASSWORD = 6


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def route_status(requests: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests (req_id, start, end) with the first failed check as ``code``: 400, 404, or 200 to go on to the solver."""
    ids = by_first(points, "id").select("id")
    one = requests.join(ids.select(F.col("id").alias("start"), F.lit(True).alias("_a")), "start", "left")
    both = one.join(ids.select(F.col("id").alias("end"), F.lit(True).alias("_b")), "end", "left")
    bad = _empty("start") | _empty("end") | (F.col("start") == F.col("end"))
    return both.withColumn("code", F.when(bad, 400).when(F.col("_a").isNull() | F.col("_b").isNull(), 404).otherwise(200)).drop("_a", "_b")


def route_reasons(checked: DataFrame, routes: DataFrame) -> DataFrame:
    """checked (req_id, start, end, code) with the final ``code`` and its ``reason``; routes: (req_id, routing_start, routing_end, status).

    After the first checks: an end that no node of the graph matches, then ends without a connection, are 404.
    """
    found = checked.join(routes.select("req_id", "routing_start", "routing_end", "status"), "req_id", "left")
    unmatched = F.col("routing_start").isNull() | F.col("routing_end").isNull()
    reason = (
        F.when(_empty("start") | _empty("end"), "missing").when(F.col("code") == 400, "equal").when(F.col("code") == 404, "unknown")
        .when(unmatched, "unmatched").when(F.coalesce("status", F.lit("")) != "ok", "unreachable").otherwise("ok")
    )
    return found.select("req_id", F.when(reason.isin("unmatched", "unreachable"), 404).otherwise(F.col("code")).alias("code"), reason.alias("reason"))


def registration_ok() -> Column:
    """Name, email and password given, the password long enough."""
    return ~(_empty("name") | _empty("email") | _empty("password")) & (F.length("password") >= MIN_PASSWORD)


def favourite_ok() -> Column:
    """User and route name given."""
    return ~(_empty("user_id") | _empty("route_name"))
