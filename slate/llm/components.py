"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.common import stored

ROUNDS = 100


def connected(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node in ``links`` (a, b); label is the smallest node reachable.

    Alternates two contractions until the links stop changing: each node hands
    its larger neighbours to its smallest one, then its smaller neighbours (and
    itself) to the smallest one.  Every round is two joins on the node; rounds
    grow with the logarithm of the longest path.  Each round's links are written
    to the shared folder, so plans stay short and lost executors cost one round.
    """
    edge = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(ROUNDS):
        both = edge.union(edge.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edge = stored(small.where("u != v").distinct(), "edges")
        # a sum of the links' hashes and their number change as long as links do
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if now == last or now[0] == 0:
            break
        last = now
    return edge.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("label")).union(
        edge.select("v", "v").distinct()).groupBy("node").agg(F.min("label").alias("label"))
