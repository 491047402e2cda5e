"""Connected components of links that are spread over the cluster.

Large-star and small-star rounds on a table of links: every node is tied to the
smallest node it knows of, until each component is a star around its smallest
node. Smallest neighbours are found by an aggregation that combines on the map
side, and joined back, so a node with very many links is not gathered in one task
(Spark splits the large side of the join). Each round is written to the shared folder; a
round that is two back is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.staging import new_folder


def _tie(links: DataFrame, small: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest of them and the node itself.

    A large star ties the neighbours above the node, a small star those below it.
    ``links`` holds ``src > dst``.
    """
    both = links if small else links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least")).withColumnRenamed("src", "_node")
    joined = both.join(least, both["src"] == least["_node"])
    ties = joined.where("dst <> least" if small else "dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    if small:
        ties = ties.unionByName(least.select(F.col("_node").alias("src"), F.col("least").alias("dst")))
    return ties.distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    ``links`` has two long columns ``src`` and ``dst`` in any order, repeats and
    self-links allowed. Nodes without a link to another are not in the result.
    """
    spark = links.sparkSession
    root = new_folder(spark, "components")
    current = links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    known = None
    for turn in range(1000):
        path = f"{root}/{turn % 2}"
        (_tie(_tie(current, small=False), small=True) if turn else current).write.mode("overwrite").parquet(path)
        current = spark.read.schema("src long, dst long").parquet(path)
        # Two rounds with the same links are told apart by sums of hashes; equal ones end it.
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if seen == known:
            break
        known = seen
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
