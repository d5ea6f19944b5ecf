"""Near-duplicate embeddings through a pivot-permutation index.

Reference points (pivots) are drawn from the vectors by a hash. A vector is described by its nearest
pivots in order; near vectors have mostly the same ones. Inverted lists, one for each label and
pivot, hold the vectors that have the pivot among their first ``PREFIX``. Two vectors of a list are
candidates if they share at least ``LEAST_SHARED`` of these, which a product of membership rows
counts, and they are compared in the list of their first shared pivot only. Candidates are verified
by cosine in double precision. Lists of any length are spread over tasks in blocks (`links.blocked`).

Equal vectors of one label are one entry of the index with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.links import blocked, components, count_links, tasks_for
from coursemill.session import materialise

#: Bounds of the number of pivots, which otherwise follows the square root of the number of vectors.
LEAST_PIVOTS, MOST_PIVOTS = 16, 4096
PREFIX = 12
LEAST_SHARED = 2
BLOCK_ROWS = 1024

INDEXED = "id long, copies long, label int, dim int, pivots array<int>, vector binary"


def comparable(embedding: str, label: str):
    """Whether a vector can link at all: a label, and finite components that aren't all zero."""
    e = F.col(embedding)
    numbers = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & numbers & F.exists(e, lambda x: x != 0), F.lit(False))


def pivots_of(entries: DataFrame, count: int) -> np.ndarray:
    """``count`` unit vectors (at most), the first by a hash of the id; a bounded, repeatable sample."""
    chosen = entries.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(count).select("id", "embedding").collect()
    dims = [len(r["embedding"]) for r in chosen]
    if not dims:
        return np.zeros((0, 0))
    dim = max(set(dims), key=dims.count)
    rows = np.array([r["embedding"] for r in chosen if len(r["embedding"]) == dim], dtype=float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def describe(entries: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """Adds each entry's unit vector and its nearest pivots in order.

    Entries of another length than the pivots' have all pivots equally near: they share list 0.
    """
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = shared.value
        for batch in batches:
            names, vectors = [], []
            for v in batch["embedding"]:
                x = np.asarray(v, dtype=float)
                scale = np.abs(x).max()
                x = x / scale  # so that squares of tiny or huge components stay in range
                x = x / np.linalg.norm(x)
                vectors.append(x.tobytes())
                if len(x) == points.shape[1]:
                    near = points @ x
                    names.append(np.lexsort((np.arange(len(near)), -near))[:prefix].astype("int32"))
                else:
                    names.append(np.arange(LEAST_SHARED, dtype="int32"))
            yield batch[["id", "copies", "label"]].assign(dim=batch["embedding"].map(len), pivots=names, vector=vectors)

    return entries.select("id", "copies", "label", "embedding").mapInPandas(run, INDEXED)


def _linked(threshold: float, least_shared: int):
    def link(frame: pd.DataFrame) -> np.ndarray:
        n, here = len(frame), frame["pivot"].iat[0]
        lists = frame["pivots"].tolist()
        names, place = np.unique(np.concatenate(lists), return_inverse=True)
        member = np.zeros((n, len(names)), dtype=np.float32)
        member[np.repeat(np.arange(n), [len(x) for x in lists]), place] = 1
        before = member[:, names < here]
        least = np.float32(min(least_shared, min(len(x) for x in lists)))
        candidates = (member @ member.T >= least) & (before @ before.T == 0)
        vectors = np.frombuffer(b"".join(frame["vector"]), dtype=float).reshape(n, -1)
        a, b = np.nonzero(np.triu(candidates, 1))
        linked = np.zeros((n, n), dtype=bool)
        for at in range(0, len(a), 200_000):
            i, j = a[at : at + 200_000], b[at : at + 200_000]
            near = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= threshold
            linked[i[near], j[near]] = True
        return linked | linked.T

    return link


def near_duplicates(
    vectors: DataFrame,
    threshold: float,
    prefix: int = PREFIX,
    least_shared: int = LEAST_SHARED,
    block_rows: int = BLOCK_ROWS,
    most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label).

    Rows link if their labels are equal and their cosine is at least ``threshold``. Rows without
    label or vector, with a null, infinite or NaN component, all zeros, or without vec_id link with
    nothing. Every row is a vector of its own, so repeated rows link with each other. Vectors of
    different lengths never link. Other columns are ignored; an empty table gives an empty result.
    """
    held = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("int"))
    usable = comparable("embedding", "label") & F.col("vec_id").isNotNull()
    key = F.when(usable, F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>"))))
    rows = materialise(held.withColumn("key", key), "vectors")
    entries = materialise(
        rows.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min_by(F.struct("label", "embedding"), "vec_id").alias("v"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .select("key", "id", "copies", "v.label", "v.embedding"),
        "entries",
    )
    count = entries.count()
    wanted = min(max(LEAST_PIVOTS, round(sqrt(count))), most_pivots)
    described = describe(entries, pivots_of(entries, wanted), prefix)
    lists = materialise(described.withColumn("pivot", F.explode("pivots")), "pivot-lists")
    group = ["label", "dim", "pivot"]
    pairs = blocked(lists.withColumn("_one", F.lit(1)), group, "_one", block_rows, F.col("id"))
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(
        count_links(pairs, group, ["pivots", "vector"], _linked(threshold, least_shared), tasks_for(count * prefix, 50_000, least)),
        "links",
    )
    partners = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("partners"))
    reach = components(found.where("kind = 1").select("a", "b"), "vector-components").withColumnRenamed("node", "id")
    facts = (
        entries.select("key", "id", "copies")
        .join(partners, "id", "left")
        .join(reach, "id", "left")
        .select("key", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    return rows.join(facts, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
