"""Connected components of links in a distributed table: union-find in each task, then star contraction between tasks.

Links are dealt to tasks of CHUNK links. Each joins its own with union-find and passes on a spanning forest of them; if
one task is enough that is all. Else large-star and
small-star steps alternate: every node points its larger, then its smaller neighbours at the smallest node it knows,
until every component is a star; the number of rounds is logarithmic in practice. Minima are combined on the map side, so a hub
that links a third of all nodes sends one row a task. Each round is cut off by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.llm.common import checkpointed


#: Links that one task holds at most, about.
CHUNK = 200_000


class UnionFind:
    """Sets of values; the smallest value of a set is its root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's links, each node linked to the smallest one it is connected with."""
    uf, kind = UnionFind(), None
    for b in batches:
        kind = b.schema.types[0]
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            uf.union(u, v)
    if kind is not None:
        nodes = [x for x in uf.parent if uf.find(x) != x]
        roots = [uf.find(x) for x in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(roots, kind)], names=["u", "v"])


def _stars(links: DataFrame) -> DataFrame:
    """(node, root) of links that all lead to a root."""
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for each node that links (u, v) name; root is the smallest node of the component."""
    kind = dict(links.dtypes)["u"]
    links = links.select("u", "v").where("u <> v")
    tasks = max(1, -(-links.count() // chunk))
    links = checkpointed(links.repartition(tasks).mapInArrow(_forest, f"u {kind}, v {kind}"))
    if tasks == 1:  # one task has seen all links
        return _stars(links)
    links = links.distinct()
    while True:
        # large-star: a node's larger neighbours are linked to the smallest of its neighbours and itself
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours are linked to the smallest of these
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        down = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # done when every node has one link, to a node that has none: all components are stars
        ends = links.select(F.col("u").alias("n"), F.lit(1).alias("k"))
        ends = ends.unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("k")).distinct())
        if ends.groupBy("n").agg(F.sum("k").alias("out"), F.count("*").alias("all")).where("out > 1 or all > 1").isEmpty():
            return _stars(links)
