"""Connected components by alternating star rounds, wholly in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task thins out at once; it holds a parent for each of their nodes.
EDGES_AT_ONCE = 500_000


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), without those whose ends earlier ones of the task connect."""
    up: dict = {}
    for batch in batches:
        keep = []
        for i, (u, v) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            for x in (u, v):
                up.setdefault(x, x)
            while up[u] != u:
                up[u] = u = up[up[u]]
            while up[v] != v:
                up[v] = v = up[up[v]]
            if u != v:
                up[max(u, v)] = min(u, v)
                keep.append(i)
        if len(up) > 2 * EDGES_AT_ONCE:
            up.clear()
        yield batch.take(pa.array(keep, pa.int64()))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another, but the roots; root is the component's smallest node.

    A large-star round links the larger neighbours of each node to the smallest one, a small-star round the others
    (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Both need a minimum for each node, which
    is pre-aggregated, and a join back, where a node with very many edges is split by the adaptive skew join. The
    edges never outnumber the first round's, and a logarithmic number of rounds is enough. Each round is written to
    the shared folder. Only a count and a checksum go to the driver. Before the first round each task leaves out those of
    its edges that close a circle, so that a dense group is a few trees. Null ends and self loops are ignored; the result
    for no edges is empty.
    """
    edges = edges.where(F.col(a) != F.col(b))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "edges")
    parts = 1 + edges.count() // EDGES_AT_ONCE
    edges, before = stored(edges.coalesce(parts).mapInArrow(_thinned, edges.schema), "edges"), None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(rest.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
