"""Connected components by hooking to smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.plans.scratch import discard, materialize, row_count
from surveyloom.plans.skew import lookup


def _renamed(pointers: DataFrame, node: str, to: str) -> DataFrame:
    return pointers.select(F.col("node").alias(node), F.col("to").alias(to))


def _leap(pointers: DataFrame, rows: int) -> DataFrame:
    """Let every pointer skip to where its target points."""
    onward = _renamed(pointers, "to", "next")
    return lookup(pointers, onward, ["to"], rows=rows).select("node", F.coalesce("next", "to").alias("to"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) where root is the smallest node of the component.

    Each round every node points at its smallest neighbour, pointers leap one
    step ahead, and the graph contracts to the nodes pointed at. Neighbour
    minima combine map-side and lookups split hot nodes, so a hub is no burden.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = materialize(both.filter("u != v").distinct(), "links")
    rounds: list[DataFrame] = []
    while links.stored_rows:
        hooks = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")).select(
            "node", F.least("node", "to").alias("to"))
        pointers = materialize(_leap(hooks, links.stored_rows), "pointers")
        rounds.append(pointers)
        ends = lookup(links, _renamed(pointers, "u", "ru"), ["u"], rows=links.stored_rows)
        ends = lookup(ends, _renamed(pointers, "v", "rv"), ["v"], rows=links.stored_rows)
        fewer = materialize(
            ends.select(F.col("ru").alias("u"), F.col("rv").alias("v")).filter("u != v").distinct(), "links")
        discard(links)
        links = fewer
    roots, rows = nodes.select("node", F.col("node").alias("root")), row_count(nodes)
    for pointers in rounds:
        roots = lookup(roots, _renamed(pointers, "root", "to"), ["root"], rows=rows).select(
            "node", F.coalesce("to", "root").alias("root"))
    found = materialize(roots, "roots")
    discard(links, *rounds)
    return found
