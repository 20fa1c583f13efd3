"""Distributed union-find: connected components of an edge table by alternating star contraction.

What is small enough for one task is settled in one task: rounds of joins over few edges cost mostly their many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import NARROW_ROWS, PLAIN, discard, stage

#: Edges that one task connects (16 bytes each, some 100 MB at work); more are contracted by all tasks in rounds.
AT_ONCE = 1 << 20
#: Nodes that a task remembers while it drops edges inside what it has connected.
REMEMBERED = 200_000


class Joined:
    """Union-find over the numbers that one task has seen."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(x), self.find(y)
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return a != b


def spanning_forest(pairs) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given pairs (one task's own pairs)."""
    joined = Joined()
    return [(x, y) for x, y in pairs if joined.join(x, y)]


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))  # u and v are roots
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if own:
        nodes, roots = smallest_reached(np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own]))
        for k in range(0, len(nodes), NARROW_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + NARROW_ROWS]), pa.array(roots[k : k + NARROW_ROWS])], ["node", "root"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges without those that connect nothing new, as far as the task remembers."""
    joined = Joined()
    for b in batches:
        good = [joined.join(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if len(joined.parent) > REMEMBERED:
            joined.parent.clear()
        yield b.filter(pa.array(good, pa.bool_()))


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node it reaches.

    Up to ``at_once`` edges are connected by one task. More are first reduced to a forest of each task's own edges, and
    if they are still more, contracted in rounds. Each round connects every node's larger neighbours to its smallest one (large star), then a node and its
    smaller neighbours to the smallest of them (small star); hubs are reduced by map-side minima, and every
    round is written to the shared folder. Rounds grow with the logarithm of a component's diameter.
    Self-loops and rows with a null end are ignored; an empty table gives an empty result.
    """
    given = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "edges", NARROW_ROWS, PLAIN)
    if (n := given.count()) > at_once:
        forests = stage(given.mapInArrow(_forests, "hi long, lo long"), "edges", NARROW_ROWS, PLAIN)
        discard(given)
        given, n = forests, forests.count()
    if n <= at_once:
        out = stage(given.coalesce(1).mapInArrow(_in_one_task, "node long, root long"), "components", NARROW_ROWS, PLAIN)
        discard(given)
        return out
    e = stage(given.distinct(), "edges", codec=PLAIN)
    discard(given)
    seen = None
    for _ in range(max_rounds):
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("hi"), F.col("e.m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        after = stage(small, "edges", codec=PLAIN)
        discard(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.expr("xxhash64(hi, lo) % 1000003")), F.sum(F.expr("hash(lo, hi) % 1000033"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
