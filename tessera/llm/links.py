"""Connected components of links between ids, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id reachable.

    Each round gives every id the smallest label among its neighbours and then that label's
    own label, so labels travel twice as far with each round. Rounds are written to the
    stage folder; only a yes or no comes to the driver.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_heard"))
        nearer = labels.join(heard, "id").select("id", F.col("component").alias("_was"), F.least("component", "_heard").alias("_now"))
        jump = labels.select(F.col("id").alias("_now"), F.col("component").alias("_jump"))
        after = stage(nearer.join(jump, "_now").select("id", "_was", F.least("_now", "_jump").alias("component")))
        labels = after.select("id", "component")
        if after.filter("component <> _was").isEmpty():
            return labels
