"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) links of long ids -> (id, label): the smallest id reachable, for each linked id.

    Each round takes the smallest label among the neighbours and the label of the label, so chains
    shorten by half and more each time.  Rounds are written to the shared folder, a round's table
    goes when the next has been written; nothing but whether a label changed comes to the
    driver.  A step takes as many tasks as its rows need.  Joins are on ids of written tables, so adaptive execution can split an id with very
    many links.  The result is the table ``{name}`` of the scratch folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = 2 * links.count()
    edges = scratch.write(both.where(F.col("a") != F.col("b")).distinct(), f"{name}-edges", n)
    labels = scratch.write(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), f"{name}-0", n)
    step, changed = 0, True
    while changed:
        near = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("m"))
        up = labels.select(F.col("id").alias("_id"), F.col("label").alias("_up"))
        lower = labels.join(near, F.col("id") == F.col("_a"), "left").join(up, F.col("label") == F.col("_id"), "left")
        moved = scratch.write(lower.select("id", F.col("label").alias("old"), F.least("label", "m", "_up").alias("label")), f"{name}-{step + 1}", n)
        scratch.drop(f"{name}-{step}")
        changed = not moved.where(F.col("old") != F.col("label")).isEmpty()
        labels, step = moved.select("id", "label"), step + 1
    scratch.drop(f"{name}-edges")
    return labels
