"""Connected components of a link table, by union-find inside partitions and star contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def union(a: list[int], b: list[int]) -> dict[int, int]:
    """Union-find over links: the smallest member of each node's group."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


#: Links that are contracted at once.
PIECE = 500_000


def _contract(batches):
    """The links of one partition, a bounded piece at a time, as links from each node to the smallest of its group there."""

    def piece(held):
        a, b = (pa.chunked_array([h.column(k) for h in held]).to_pylist() for k in (0, 1))
        found = [(x, r) for x, r in union(a, b).items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PIECE:
            yield piece(held)
            held, count = [], 0
    if held:
        yield piece(held)


def _smallest(both: DataFrame) -> DataFrame:
    """Of rows (u, v): each u's smallest neighbour, itself included."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): node and component, the smallest node that it reaches. Nodes without a link are not listed.

    Each round contracts inside partitions, links every larger neighbour to the smallest one (large star), then every
    smaller one (small star), until each node has one link, to a node that has none. Neighbourhoods are never gathered:
    both stars are a minimum by key and a join.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    while True:
        links = stage_table(links.mapInArrow(_contract, "a long, b long").distinct(), "links")
        # a forest of stars: every a once, no b among the a
        total, nodes = links.agg(F.count("*"), F.countDistinct("a")).first()
        if total == nodes and not links.select("b").join(links.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = links.selectExpr("a u", "b v").unionByName(links.selectExpr("b u", "a v"))
        large = both.join(_smallest(both), "u").filter("v > u").selectExpr("v a", "m b").filter("a <> b")
        down = large.selectExpr("greatest(a, b) u", "least(a, b) v").distinct()
        low = _smallest(down)
        links = down.join(low, "u").selectExpr("v a", "m b").unionByName(low.selectExpr("u a", "m b")).filter("a <> b").distinct()
