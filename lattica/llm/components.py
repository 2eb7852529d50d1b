"""Connected components of a distributed edge table, by alternating large-star and small-star rounds.

Each round moves every node's neighbours under the smallest one it sees; the number of rounds grows with the
logarithm of the longest path. Edges never come to the driver: a round ends as a checkpoint in the shared folder,
and only a count and a checksum tell whether it changed anything. Stars of any size are safe: the minimum of a node
is pre-aggregated, and its neighbours are joined to it, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import shared_dir


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (u, v long) -> (node, component), the component being its smallest node; one row for each node of an edge.

    Loops and rows with nulls are left out; repeated edges count once. An empty table gives an empty result.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    state = _state(now)
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
