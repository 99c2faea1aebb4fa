"""Connected components of a link table, with no collection to the driver.

Each round hooks a node's root under the smallest grandparent label among its neighbours and halves
the paths, so the number of rounds grows with the logarithm of the component size. Labels are written
to the shared folder after each round. Large components make hot labels: those keys are only met by
partial aggregates and by plain two-sided joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; component is the smallest node of its group.

    Nulls: links with a null end are left out. Self links and repeated links change nothing. An empty
    table gives an empty result. Extra columns are ignored.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edge_path = scratch(spark, "edges")
    both = written(both, "edges", edge_path)
    path = scratch(spark, "labels")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels", path)
    while True:
        up = label.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        grand_path = scratch(spark, "grands")
        grand = written(label.join(up, "label").select("node", "label", "grand"), "grands", grand_path)
        near = both.join(grand.select(F.col("node").alias("v"), F.col("grand").alias("g")), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("near"))
        near_path = scratch(spark, "nears")
        near = written(grand.join(near, "node", "left"), "nears", near_path)
        offers = (
            near.select(F.col("label").alias("node"), F.least("near", "grand").alias("to"))
            .unionByName(near.select("node", F.least("near", "grand").alias("to")))
            .groupBy("node").agg(F.min("to").alias("to"))
        )
        new_path = scratch(spark, "labels")
        new = written(label.withColumnRenamed("label", "old").join(offers, "node", "left").select("node", "old", F.least("old", "to").alias("label")), "labels", new_path)
        moved = new.where("label <> old").limit(1).count()
        for old in (path, grand_path, near_path):
            drop(spark, old)
        label, path = new.select("node", "label"), new_path
        if not moved:
            drop(spark, edge_path)
            return label.select("node", F.col("label").alias("component"))
