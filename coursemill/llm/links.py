"""Counting links inside groups of any size, and connected components of what is linked.

``blocked`` spreads each group over blocks of bounded weight and sends every pair of blocks to a
task of its own, so neither a task nor the driver ever holds a whole group. A task compares the
rows of its two blocks and returns, per row, the weight of its partners, and a spanning forest of
the links (fewer edges than rows). No pairs are emitted.

``components`` turns forest edges into the smallest reachable id per node, by alternating large-star
and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"). Each step is
a written table, so lost executors recompute one step only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.session import materialise

#: Steps after which `components` gives up; the number needed grows with the square of log(nodes).
MOST_ROUNDS = 60


class Forest:
    """Union-find whose roots are smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) replaced, task by task, by the spanning forest of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
            if len(forest.up) > 500_000:
                found = forest.edges()
                yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
                forest = Forest()
        found = forest.edges()
        yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs from one smaller root and no root hangs from another."""
    rows, nodes, upward = edges.agg(F.count(F.lit(1)), F.count_distinct("a"), F.max((F.col("b") >= F.col("a")).cast("int"))).first()
    if rows != nodes or upward:
        return False
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(roots, "a", "left_semi").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b), ids as longs; component is the smallest member.

    Loops and repeated edges do no harm; null ends are left out. No edges, no rows.
    """
    current = materialise(contracted(edges.where("a <> b")), name)
    for _ in range(MOST_ROUNDS):
        if _stars(current):
            break
        current = materialise(contracted(_small_star(_large_star(current))), name)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def blocked(rows: DataFrame, group: list[str], weight: str, most: int, key: Column) -> DataFrame:
    """``rows`` once for each pair of blocks they are in: adds _i, _j (the pair) and _own (the row's block).

    A group has ceil(weight / most) blocks; ``key`` spreads its rows over them. Small groups have the
    one pair (0, 0). A row of a group of n blocks appears n times, so the work per row grows with
    its group, as the number of comparisons does, but each task stays within two blocks.
    """
    sizes = rows.groupBy(*group).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    counted = sizes.select(*group, F.ceil(F.col("_w") / F.lit(most)).cast("int").alias("_blocks"))
    placed = rows.join(counted, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        placed.withColumn("_other", other)
        .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        .drop("_other", "_blocks")
    )


COUNTED = "kind int, a long, b long"


def count_links(
    pairs: DataFrame, group: list[str], columns: list[str], link: Callable[[pd.DataFrame], np.ndarray], least_tasks: int
) -> DataFrame:
    """Rows (kind, a, b): kind 0, the weight ``b`` of partners of ``a``; kind 1, a forest edge.

    ``pairs`` comes from `blocked` with columns id and copies. ``link`` gets the rows of a block pair
    and returns a square boolean matrix of which rows are linked. Pairs within a block count in the
    pair of that block with itself only.
    """
    parts = [*group, "_i", "_j"]
    held = pairs.select(*parts, "_own", "id", "copies", *columns).repartition(least_tasks, *parts).sortWithinPartitions(*parts)

    def results(frame: pd.DataFrame) -> tuple[list, list]:
        ids, copies, own = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["_own"].to_numpy()
        linked = link(frame)
        np.fill_diagonal(linked, False)
        if frame["_i"].iat[0] != frame["_j"].iat[0]:
            linked &= own[:, None] != own[None, :]
        weights = linked @ copies
        forest = Forest()
        # a row joins its first partner and each later one that is not yet in its tree
        label = np.arange(len(ids))
        for i in range(len(ids)):
            near = np.flatnonzero(linked[i, : i + 1])
            if len(near):
                labels = np.unique(label[near])
                low = min(labels.min(), label[i])
                for old in np.append(labels, label[i]):
                    if old != low:
                        forest.join(int(ids[old]), int(ids[low]))
                        label[label == old] = low
        return [(int(a), int(w)) for a, w in zip(ids, weights) if w], forest.edges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: list[tuple[int, int]] = []
        edges: list[tuple[int, int]] = []
        waiting: pd.DataFrame | None = None

        def flush() -> pa.RecordBatch:
            kinds = [0] * len(weights) + [1] * len(edges)
            both = weights + edges
            return pa.record_batch(
                [pa.array(kinds, pa.int32()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())],
                ["kind", "a", "b"],
            )

        def done(frame: pd.DataFrame) -> None:
            if len(frame) > 1:
                w, e = results(frame.reset_index(drop=True))
                weights.extend(w)
                edges.extend(e)

        for batch in batches:
            frame = batch.to_pandas()
            if waiting is not None:
                frame = pd.concat([waiting, frame], ignore_index=True)
            if not len(frame):
                continue
            changes = np.flatnonzero(np.any([frame[c].to_numpy()[1:] != frame[c].to_numpy()[:-1] for c in parts], axis=0)) + 1
            cuts = [0, *changes.tolist()]
            for start, end in zip(cuts, cuts[1:]):
                done(frame.iloc[start:end])
            waiting = frame.iloc[cuts[-1] :]
            if len(weights) + len(edges) > 100_000:
                yield flush()
                weights, edges = [], []
        if waiting is not None:
            done(waiting)
        yield flush()

    return held.mapInArrow(run, COUNTED)


def tasks_for(rows: int, each: int, least: int) -> int:
    return max(least, ceil(rows / each))
