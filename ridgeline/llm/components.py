"""Connected components of a link table, by smallest labels and pointer jumping, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, gathered, written


def components(links: DataFrame, start: DataFrame | None = None, made_from: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): the smallest node that links reach.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so
    that chains shorten by powers. Links and labels stay in tables; the driver sees one count a round. ``start`` holds
    labels (node, comp) of some nodes under a part of the links. ``made_from``: the written tables with the links, if known.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(gathered(both, *made_from) if made_from else both, "links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp"))
    if start is not None:
        first = first.join(start.withColumnRenamed("comp", "known"), "node", "left").select("node", F.least("comp", F.coalesce("known", "comp")).alias("comp"))
    labels = written(gathered(first, both), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        best = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = best.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        new = written(gathered(new, both), "labels")
        dropped(labels)
        labels = new
        if new.filter("comp <> old").isEmpty():
            dropped(both)
            return labels
