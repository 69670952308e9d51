"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import stored


def components(links: DataFrame) -> DataFrame:
    """id, label of every id in ``links`` (a, b): the least id that can be reached.

    Every round an id takes the least label among its neighbours, then the label of its label, so long chains shorten
    by half.  Rounds end when no label changes; each is written to the shared folder.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label")), "labels")
    changed = True
    while changed:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("own"))
        taken = near.union(labels.select("id", "label", F.col("label").alias("own"))).groupBy("id").agg(F.max("own").alias("label"), F.min("label").alias("taken"))
        jump = labels.select(F.col("id").alias("taken"), F.col("label").alias("further"))
        rows = stored(taken.join(jump, "taken").select("id", F.least("taken", "further").alias("label"), (F.least("taken", "further") < F.col("label")).alias("moved")), "labels")
        changed = not rows.where("moved").isEmpty()
        labels = rows.select("id", "label")
    return labels
