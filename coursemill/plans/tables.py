"""Course tables that join without a shuffle, and the wide export from positions.

A table that several joins read is written once, clustered into buckets by its keys (``bucketed``). Joins and
groupings on these keys then read matching buckets side by side, whatever their number.

A presence family becomes one row per course with an array of feature positions (``position_table``).
Positions are the ranks of the (family, feature) names in a repeatable random order, found without a
single-task window and without a vocabulary on the driver. Only the wide export needs all names there, as its
columns; it lays out each batch of rows at once (``expand_positions``), so no plan has an expression per column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.operators.ranking import shuffled_rank
from coursemill.operators.reshape import FAMILY, FEATURE, family_safe, quoted
from coursemill.plans.cohort import KEYS
from coursemill.session import materialise, partitions, shared_dir

#: Cells of the wide export that are laid out at a time.
CELLS = 1 << 23
_SEED = 220


def bucketed(df: DataFrame, name: str, keys: Iterable[str] = KEYS, buckets: int | None = None, by: Iterable[str] | None = None, split: Iterable[str] | None = None) -> DataFrame:
    """``df`` written in the shared folder, clustered by ``by`` (default: ``keys``) in ``buckets`` parts, sorted by ``keys``, and read back.

    With ``split``, ``df`` comes from tables clustered alike and is not shuffled again; it is written apart by these columns.

    ``buckets`` defaults to the session's shuffle partitions. The table is registered under a name of its own
    in the session's catalog, which is how Spark knows the buckets. As each bucket is one sorted file, the session is told
    to trust that order: a join of many tables in one stage would otherwise hold a sort buffer for each. It is also told
    that tables clustered alike by some of a join's keys (the patient) need no shuffle for the others (a bucket of days).
    """
    spark, keys = df.sparkSession, list(keys)
    by = keys if by is None else list(by)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    buckets = buckets or partitions(spark)
    table = f"coursemill_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/coursemill/{table}"
    clustered = df.repartition(buckets, *by) if split is None else df
    writer = clustered.write if split is None else clustered.write.partitionBy(*split)
    writer.format("parquet").bucketBy(buckets, *by).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table).select(*df.columns)


def join_bucketed(spine: DataFrame, tables: Iterable[DataFrame], keys: Iterable[str] = KEYS) -> DataFrame:
    """``spine`` with the columns of all ``tables`` (left joins), all bucketed alike by ``keys``.

    Merge joins are asked for, as they need neither exchange nor memory here, however small a table looks.
    """
    joined = spine
    for table in tables:
        joined = joined.join(table.hint("merge"), list(keys), "left")
    return joined


def feature_positions(store: DataFrame) -> DataFrame:
    """(family, feature, name, position): names are told apart between families, positions start at 0."""
    names = store.select(FAMILY, FEATURE).distinct().withColumn("_own", F.col(FEATURE))
    told = materialise(family_safe(names).withColumnsRenamed({FEATURE: "name", "_own": FEATURE}), "feature-names")
    ranked = shuffled_rank(told, [FAMILY, FEATURE], _SEED, "_rank")
    return materialise(ranked.select(FAMILY, FEATURE, "name", (F.col("_rank") - 1).cast("int").alias("position")), "feature-positions")


def position_table(store: DataFrame, positions: DataFrame, column: str, keys: Iterable[str] = KEYS) -> DataFrame:
    """One row per key with the sorted positions of its stored features."""
    placed = store.join(positions.select(FAMILY, FEATURE, "position"), [FAMILY, FEATURE])
    return placed.groupBy(*keys).agg(F.sort_array(F.collect_set("position")).alias(column))


def expand_positions(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """``rows`` with one 0/1 column per name in place of the array ``column`` of their positions; null is none."""
    others = [c for c in rows.columns if c != column]
    fields = [rows.schema[c] for c in others] + [T.StructField(n, T.IntegerType(), False) for n in names]
    width, step = len(names), max(1, CELLS // max(1, len(names)))

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                lists = part.column(len(others)).fill_null([])
                sizes = lists.value_lengths().to_numpy()
                cells = np.zeros((width, part.num_rows), dtype=np.int32)
                cells[lists.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), sizes)] = 1
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(others))), *map(pa.array, cells)], names=[f.name for f in fields]
                )

    return rows.select(*[quoted(c) for c in others], quoted(column)).mapInArrow(laid_out, T.StructType(fields))
