"""Point search: one row an id, in the order of Polish names, then the first few that hold the typed text, for one or many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_text
from ..sources.scratch import finished, mark, settled

LIMIT = 8


def unique_points(points: DataFrame) -> DataFrame:
    """One row for each id: the values of its last row at the place of its first."""
    first = F.min("ord").over(Window.partitionBy("id"))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))
    return points.withColumns({"_first": first, "_n": last}).filter("_n = 1").withColumn("ord", F.col("_first")).drop("_first", "_n")


def sorted_points(points: DataFrame) -> DataFrame:
    """Unique points by name under Polish collation, then by place in the file."""
    return unique_points(points).orderBy(F.collate("name", "pl"), "ord")


def matching(points: DataFrame, query: str) -> DataFrame:
    """The points whose name, id or type holds the text, accents and case aside; none for an empty text."""
    text = fold_text(F.trim(F.lit(query)))
    held = [fold_text(F.col(c).cast("string")).contains(text) for c in ("name", "id", "type")]
    return points.filter((text != "") & (held[0] | held[1] | held[2]))


def suggestions(points: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` matches in sorted order."""
    return matching(unique_points(points), query).orderBy(F.collate("name", "pl"), "ord").limit(limit)


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters of a text."""
    n = F.length(text) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def gram_postings(points: DataFrame) -> DataFrame:
    """(gram, id): the runs of one to three characters of the folded name, id and type of every point, each once."""
    folded = [F.coalesce(fold_text(F.col(c).cast("string")), F.lit("")) for c in ("name", "id", "type")]
    grams = F.array_distinct(F.flatten(F.array(*[_grams(t, n) for t in folded for n in (1, 2, 3)])))
    return points.select("id", F.explode(grams).alias("gram"))


def suggestions_for(points: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(q_id, place, id, name, type): the first ``limit`` matches of every query (q_id, query), as ``suggestions`` gives them for one.

    A text of one or two characters is a gram itself: its postings are its matches. A longer one looks among the postings
    of its rarest gram, and is compared with the points there. Equal texts are looked up once.
    """
    began = mark()
    found = settled(unique_points(points).select("id", "name", "type", "ord"), "points")
    asked = settled(queries.select("q_id", F.coalesce(fold_text(F.trim("query")), F.lit("")).alias("text")).filter("text <> ''"), "asked")
    texts = asked.select("text").distinct()
    wanted = texts.select("text", F.explode(F.array_distinct(F.when(F.length("text") < 3, F.array("text")).otherwise(_grams(F.col("text"), 3)))).alias("gram"))
    wanted = settled(wanted, "grams")
    postings = settled(gram_postings(found).join(wanted.select("gram").distinct(), "gram", "left_semi"), "postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no point has leaves its text without a match
    rarest = wanted.join(counts, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).filter("x.n > 0").select("text", "x.gram")
    held = [F.contains(fold_text(F.col(c).cast("string")), F.col("text")) for c in ("name", "id", "type")]
    met = rarest.join(postings, "gram").join(found, "id").filter((F.length("text") < 3) | F.coalesce(held[0], F.lit(False)) | F.coalesce(held[1], F.lit(False)) | F.coalesce(held[2], F.lit(False)))
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.collate("name", "pl"), "ord"))
    best = met.withColumn("place", place).filter(F.col("place") <= limit)
    return finished(asked.join(best, "text").select("q_id", "place", "id", "name", "type"), "suggestions", began)
