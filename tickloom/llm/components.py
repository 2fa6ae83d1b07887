"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, at_most, sized, stable


def _renamed(edges: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """edges (a, b) with the n names (id, root) of their ends, a the larger; loops and repeated ones are left out."""
    for end in ("a", "b"):
        named = sized(names.select(F.col("id").alias(end), F.col("root").alias("_root")), n)
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _above(roots: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """roots (id, root) with the names (id, root) of their roots."""
    above = sized(names.select(F.col("id").alias("root"), F.col("root").alias("_root")), n)
    return roots.join(above, "root", "left").select("id", F.coalesce("_root", "root").alias("root"))


def _components(links: DataFrame) -> tuple[DataFrame, int]:
    """components(), and a bound of its rows where that is at most BROADCAST_ROWS."""
    edges = stable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    rounds = []
    while n := at_most(edges, BROADCAST_ROWS + 1):
        h = [F.struct(F.xxhash64(end).alias("h"), F.col(end).alias("x")) for end in ("a", "b")]
        up = edges.select(F.greatest(*h).alias("id"), F.least(*h).alias("root")).groupBy(F.col("id.x").alias("id")).agg(F.min("root")["x"].alias("root"))
        names = stable(_above(up, up, n))
        rounds.append((names, n))
        edges = stable(_renamed(edges, names, n))
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root")), 0
    found, n = rounds.pop()
    while rounds:
        names, more = rounds.pop()
        # a name may itself have one, and is then in both tables
        found, n = stable(_above(names, found, n).union(found).filter("id <> root").distinct()), n + more
    return found, n


def components(links: DataFrame) -> DataFrame:
    """(id, root) of the ids (long) in links (a, b) that aren't their component's root, which is some id of it.

    Each round every id takes its first neighbour's first neighbour as a name,
    in order of a hash, if that is before itself, and the links are rewritten to
    names: loops and repeated ones go, so the table shrinks by a share until it
    is empty, for chains in any order of ids too. What a component is called is looked up
    from the last round back, each round's names in the next ones'. Tables stay
    distributed and are written each round; names are broadcast while a count
    shows few enough links, and joined by shuffles beyond that. No links give no
    rows.
    """
    return _components(links)[0]


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots, as components() gives them, with the components that links (a, b) connect made one.

    Only the links between components are looked at, by their roots.
    """
    found, n = _components(_renamed(links.select("a", "b"), roots, at_most(roots, BROADCAST_ROWS + 1)))
    return stable(_above(roots, found, n).union(found)) if n else roots
