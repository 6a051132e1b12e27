"""Connected components of an edge table by alternating large-star and small-star steps.

No vertex, edge or label goes to the driver; each round is two aggregates and a checkpoint in the
shared folder. Rounds are logarithmic in the size of a component. The edges of a hub (a vertex with a
thousandth of all edges or more) are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm._common import cut, hot_bound, salted


def _with_least(e: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): edges with the least neighbour of u; ``rows`` is the number of edges, or more."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    many, one, keys = salted(e, low, ["u"], F.col("n") >= hot_bound(rows), "v")
    return many.join(one.drop("n"), keys).select("u", "v", "m")


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _with_least(both, 2 * rows).filter("v > u")
    return least.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _with_least(down, rows)
    moved = least.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.filter("v = m").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node that has a link.

    Self-links and repeated links are allowed; null ends are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    before = None
    rows = e.count()
    for _ in range(max_rounds):
        # Few edges need few files a round.
        e = cut(_small_star(_large_star(e, rows), rows).coalesce(rows // 200_000 + 1))
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = row[0]
        now = (row[0], row[1])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
