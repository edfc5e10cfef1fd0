"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component: the smallest id reachable. Ids without links are not listed.

    Each round a vertex takes the least of its label, its neighbours' labels and its label's label;
    labels are summed up before the shuffle, so a vertex with very many links is no burden. The table of
    each round is written to the shared folder, and the one before it removed. Nulls and self-links are
    ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"), F.col("id").alias("was")))
    while labels.where("label <> was").limit(1).count():
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        up = labels.select(F.col("id").alias("_up"), F.col("label").alias("_to"))
        step = labels.join(near, labels["id"] == near["a"]).join(up, labels["label"] == up["_up"])
        old, labels = labels, written(step.select("id", F.least("label", "m", "_to").alias("label"), F.col("label").alias("was")))
        discard(old)
    discard(both)
    return labels.select("id", F.col("label").alias("component"))
