"""Connected components of links by alternating large and small stars, without collecting anything.

Each step is an aggregation and a join on node ids; its result is written to the shared folder, so
lineage stays short and lost executors cost one step.  The number of steps grows with the logarithm
of the longest chain.  Every step is a dozen jobs, of which the driver remembers much; so few links
are joined in one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, release, stored

#: Links that one task joins at most; and the types of nodes that Python orders as Spark does.
FEW = 1 << 17
ORDERED = ("tinyint", "smallint", "int", "bigint", "string")


def _least(edges: DataFrame, by: str, value: Column) -> DataFrame:
    """One row (``by``, m) for each node; dealt again, so that Spark can split the join's rows of a node with very many neighbours."""
    return edges.groupBy(by).agg(value.alias("m")).repartition(by, "m")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", F.least(F.min("b"), F.col("a")))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = _least(edges, "b", F.min("a"))
    joined = edges.join(least, "b")
    return joined.select(
        F.col("m").alias("a"), F.col("a").alias("b")
    ).unionByName(least.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """Every node but the roots (b) with its root (a), by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        root: dict = {}

        def find(x):
            up = root.setdefault(x, x)
            while up != x:
                root[x] = up = root[up]
                x, up = up, root[up]
            return x

        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = [x for x in root if root[x] != x]
        for at in range(0, len(nodes), 10_000):
            own = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in own], kind), pa.array(own, kind)], names=["a", "b"])

    kinds = dict(edges.dtypes)
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for each node of ``links`` (a, b) but the roots.

    Links may repeat, run either way or join a node to itself.  Nodes are of any ordered type.
    """
    edges = stored(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    if 0 < seen[0] <= FEW and {kind for _, kind in edges.dtypes} <= set(ORDERED):
        joined = stored(_at_once(edges), "links")
        drop_stored(edges)
        return joined.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(most):
        if not seen[0]:
            break
        after = stored(_small(_large(edges)), "links")
        now = mark(after)
        drop_stored(edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
