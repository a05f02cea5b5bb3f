"""Connected components by alternating stars, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import checkpointed, partitions


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the others) are tied to its smallest neighbour or itself.

    A node's ties are dealt out by salt, one shuffle for both the minimum and the join: the minimum of each (node, salt) is
    taken where the ties are, that of the node goes back to its salts only. So no task gets all ties of a hub.
    """
    # All edges go from the larger node to the smaller one, so the others of a step for smaller neighbours are the edges themselves.
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(partitions(edges.sparkSession))).cast("int")).repartition("u", "salt")
    parts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("salt").alias("salts"))
    tied = both.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"])
    if large:
        # Repeated ties, never more than there are edges, go with the next step.
        return tied.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (u, v: long); component is the smallest node it can reach.

    Loops and repeated edges do no harm; no edges give no rows. Each round halves the paths at least, is checkpointed,
    and only its number of edges and a checksum reach the driver.
    """
    edges = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct())
    last = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == last or state["n"] == 0:
            break
        last = state
        edges = checkpointed(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
