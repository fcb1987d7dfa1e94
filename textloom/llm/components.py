"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.shared import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in ``links`` (a, b), both of them longs.

    In every round each node goes up to the one of the least hash among itself and its neighbours, and links are made between
    those: as hashes are in no order, paths of any length shrink by a share, and links that fall together or within one
    node are not joined again. Each round is a written table; only whether links are left reaches the driver. No links
    give no rows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges, ups = stored(both, "edges"), []
    ranked = lambda side: F.struct(F.xxhash64(side), F.col(side).alias("node"))
    while not ups or not edges.isEmpty():
        up = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min(ranked("b")), F.first(ranked("a")))["node"].alias("up"))
        ups.append(stored(up, "ups"))
        of = lambda side: ups[-1].select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
        nearer = edges.where("a != b").join(of("a"), "a").join(of("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        after = stored(nearer.where("a != b").distinct(), "edges")
        discard(edges)
        edges = after
    discard(edges)
    top = ups.pop()
    while ups:
        up = ups.pop()
        upper = top.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after = stored(up.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "ups")
        discard(up, top)
        top = after
    least = top.groupBy("up").agg(F.min("node").alias("root"))
    roots = stored(top.join(least, "up").select("node", "root"), "roots")
    discard(top)
    return roots


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root as by all links of ``roots`` (``connected_components`` of earlier ones) and ``links`` (a, b) together: only
    links between different roots are followed."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = connected_components(stored(ends.where("a != b").distinct(), "ends"))
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(moved.union(tops.join(roots, "node", "left_anti").select("node", "root")), "roots")
