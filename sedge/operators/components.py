"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sedge.session import discard, stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b) with a > b.

    Large: a node links its greater neighbours to the least of its neighbourhood.
    Small: a node links its lesser neighbours, and itself, to their least.
    """
    if large:
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = links
    least = ends.groupBy("a").agg(F.min("b").alias("m"))
    met = ends.join(least, "a").withColumn("m", F.least("m", "a"))
    if large:
        new = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.least("m", "a").alias("b"))
        )
    return new.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root): root is the least node that can be reached; nodes without links are absent.

    Nulls and self-links say nothing and are left out. Each round is written to the shared folder, so that
    lineage stays short and a lost executor costs one round. Work per round is linear in the links; the least
    neighbour is a partial aggregate, so a node with very many links is no hot spot there, and adaptive
    execution splits it in the join.
    """
    now = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "links",
    )
    state = None
    for _ in range(most_rounds):
        new = stored(_stars(_stars(now, True), False), "links")
        discard(now)
        now = new
        row = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (row[0], row[1]) == state:
            break
        state = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
