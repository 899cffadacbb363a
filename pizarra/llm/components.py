"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pizarra.llm.common import cut, handed_on, release

#: Links that are contracted together, by one task.
LINKS = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, smallest node of its component) that join what the links
    (a, b) join: each root takes the smallest root that one of its nodes is linked
    to, then nodes follow their roots to the last, until nothing moves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def contracted(links: DataFrame, most: int) -> DataFrame:
    """Links (a, b), a > b, that join the same nodes: of every ``most`` links or so
    that lie in one partition only a star for each of their components is left."""

    def run(batches):
        handed_on()
        held: list[np.ndarray] = []
        rows = 0

        def stars():
            a, b = _stars(*np.concatenate(held, axis=1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")]))
            rows += batch.num_rows
            if rows >= most:
                yield stars()
                held, rows = [], 0
        if held:
            yield stars()

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of long node numbers: (node, root), root being the
    smallest node of its component, for every node that has a link.

    First, blocks of up to ``LINKS`` links or so are contracted, each in its task. One
    block holds all links between its nodes, and that is the result. Of several, what
    is left goes through alternating large-star and small-star steps: each node's
    larger (then its smaller) neighbours are linked to its smallest one, until nothing
    moves. The number of links never grows; rounds are logarithmic in practice. A hub's
    minimum is taken with map-side aggregation and joined back (from a cut table,
    so that Spark can split a hub's rows): no node's neighbours are ever gathered."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    blocks = -(-links.count() // LINKS)
    # a block's rows are in one partition, and a single block is contracted whole
    links = cut(contracted(links.coalesce(max(1, blocks)), 2 * LINKS))
    return _rooted(links if blocks <= 1 else _star_joins(links))


def _rooted(links: DataFrame) -> DataFrame:
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _star_joins(links: DataFrame) -> DataFrame:
    """The links (node, smallest node of its component) of links (a, b), a > b."""
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # a node that is its own minimum stays linked from its larger neighbours
        links = cut(large.where("a <> b").distinct())
        low = cut(links.groupBy("a").agg(F.min("b").alias("low")))
        joined = links.join(low, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(joined.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        links = cut(small.distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        release(links.sparkSession)
    return links
