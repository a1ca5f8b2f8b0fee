"""Connected components of links: forests within tasks, alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.session import materialise

#: Links that a task holds at a time.
TASK_LINKS = 1 << 20
#: A node with more than this share of all links is a hub; there are at most twice as many hubs.
HUB_SHARE = 4096
_LINKS = "a bigint, b bigint"


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components in one link per node: to the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _forests(limit: int):
    """Links of a task as forests; one that grows beyond ``limit`` links is passed on, and the next begins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _forest(*(np.concatenate(side) for side in zip(*held)))

        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            if sum(len(a) for a, _ in held) > 2 * limit:
                held = [merged()]
                if len(held[0][0]) > limit:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return run


def _beside(links: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """``a, b`` and the least ``m`` of ``a``: links of hubs stay where they are, only those of other nodes move."""
    few = F.broadcast(hubs.select("a"))
    return links.join(F.broadcast(hubs), "a").unionByName(links.join(few, "a", "left_anti").join(least.join(few, "a", "left_anti"), "a"))


def _hubs(found: DataFrame, links: int) -> DataFrame:
    return found.where(F.col("n") > links // HUB_SHARE).select("a", "m")


def _stars(links: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours, itself and its smaller ones are tied to the smallest of them all; ``n``: how many links there are."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    facts = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")))
    least = facts.select("a", "m")
    # large star: a node's larger neighbours go to the least of the node and all its neighbours
    large = _beside(both.where(F.col("b") > F.col("a")), least, _hubs(facts, n)).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = materialise(large.unionAll(least.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))).distinct())
    # small star: a node and its smaller neighbours go to the least of these
    facts = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    lowest = facts.select("a", "m")
    small = _beside(large, lowest, _hubs(facts, n)).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct()


def _unfinished(links: DataFrame) -> bool:
    """Whether some node is neither the smallest of its neighbourhood nor tied to one smaller node alone."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    facts = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count(F.lit(1)).alias("n"))
    return facts.where("low < a AND (high > a OR n > 1)").agg(F.count(F.lit(1))).first()[0] > 0


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` bigint): the root is the smallest node that can be reached.

    Every task first makes a forest of the links that it reads, one link per node.  What is left of a graph that fits a task, at most
    ``TASK_LINKS``, ends in one more such step.  Links of a larger graph become stars around smaller and smaller nodes until only stars are
    left, after a number of rounds logarithmic in the longest path.  Each round is stored, so lost executors cost no more than one round; only
    two figures per round come to the driver.  Hubs are joined where their links lie, so no task gets all links of a node.
    """
    plain = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    now = materialise(plain.mapInArrow(_forests(TASK_LINKS), _LINKS))
    n = now.count()
    while n > TASK_LINKS and _unfinished(now):
        now = materialise(_stars(now, n))
        n = now.count()
    if n <= TASK_LINKS:
        now = materialise(now.coalesce(1).mapInArrow(_forests(TASK_LINKS), _LINKS))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
