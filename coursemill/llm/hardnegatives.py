"""Hard negatives by exact integer scores, from tables of anchor subset sums (the method of the Four Russians).

Components become integers, and a vector's integers are stored as bit planes, eight dimensions to a byte. For
each group of eight dimensions an anchor has a table of its 256 subset sums. A byte of a candidate's plane
is an index into the table of its group: the looked-up sums of a plane, added over the groups and
shifted by the plane's weight, add up to the full inner product, exactly.

All scores are wanted once. Positives come from the scores within a label, negatives from those between
labels. Candidates and anchors are dealt into blocks, each pair of blocks is scored in one task, and only the best
rows of a block leave it. Labels with few rows share a block; one with a third of all rows has many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import materialise

#: What a component is multiplied by before it is rounded down.
SCALE = 256
#: Integers beyond this either way are set to it, so that scores of up to 16,384 dimensions are whole numbers of 64 bits.
MOST = 1 << 24
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Rows of a block of candidates (by the number of all: a 64th, within these bounds) and of one of anchors.
LEAST_ROWS, MOST_ROWS, ANCHORS = 4096, 1 << 18, 8192
#: Anchors with tables at a time, and candidates scored at a time.
TABLES, SLICE = 64, 4096


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, planes, groups) bytes of whole numbers in two's complement, lowest plane first."""
    groups = -(-values.shape[1] // 8)
    padded = np.zeros((len(values), groups * 8), dtype=np.int64)
    padded[:, : values.shape[1]] = values
    out = np.empty((len(values), bits, groups), dtype=np.uint8)
    for plane in range(bits):
        out[:, plane] = np.packbits(((padded >> plane) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of ``planes_of``, padded to full groups."""
    rows, bits, groups = planes.shape
    out = np.zeros((rows, groups * 8), dtype=np.int64)
    for plane in range(bits):
        weight = -(1 << plane) if plane == bits - 1 else 1 << plane
        out += np.unpackbits(planes[:, plane], axis=1, bitorder="little").astype(np.int64) * weight
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each group's eight components."""
    groups = anchors.shape[1] // 8
    parts = anchors.T.reshape(groups, 8, len(anchors)).astype(kind)
    tables = np.zeros((groups, 256, len(anchors)), dtype=kind)
    for bit in range(8):
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + parts[:, bit : bit + 1]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products, by lookups alone."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
    looked = np.empty_like(total)
    index = np.ascontiguousarray(planes.transpose(1, 2, 0)).astype(np.intp)
    for plane in range(bits - 1, -1, -1):
        total <<= 1
        for group in range(groups):
            np.take(tables[group], index[plane, group], axis=0, out=looked, mode="clip")
            total += looked
        if plane == bits - 1:  # the sign's weight is negative
            np.negative(total, out=total)
    return total


class Block:
    """Rows of an Arrow table in order of vec_id, with their planes."""

    def __init__(self, table: pa.Table, bits: int):
        self.table = table.sort_by("vec_id")
        self.ids = self.table["vec_id"].to_numpy()
        self.labels = np.array(self.table["label"].to_pylist(), dtype=object)
        blobs = self.table["planes"].to_pylist()
        width = len(blobs[0]) // bits if blobs else 0
        self.planes = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), bits, width)


def _kind(dimensions: int, bits: int) -> type:
    return np.int32 if dimensions << (2 * bits - 2) < 1 << 31 else np.int64


def _scored(anchors: Block, which: np.ndarray, candidates: Block, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of anchors, their scores with the ``rows`` of the candidates) for a few anchors at a time."""
    _, bits, groups = candidates.planes.shape
    for begin in range(0, len(which), TABLES):
        some = which[begin : begin + TABLES]
        tables = subset_sums(values_of(anchors.planes[some]), _kind(groups * 8, bits))
        parts = [scores(tables, candidates.planes[rows[i : i + SLICE]]) for i in range(0, len(rows), SLICE)]
        yield some, np.ascontiguousarray(np.concatenate(parts).T)


BEST = pa.schema([("anchor", pa.int64()), ("vector", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
CHOSEN = pa.schema([("anchor", pa.int64()), ("vector", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """Rows of (anchor's values ..., ids, scores) as one table."""
    if not rows:
        return schema.empty_table()
    sizes = [len(r[-1]) for r in rows]
    keys = [np.repeat(np.array([r[i] for r in rows], dtype=np.int64), sizes) for i in range(len(schema) - 2)]
    columns = [*keys, *(np.concatenate([r[i] for r in rows]) for i in (-2, -1))]
    return pa.table([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def best_of_label(anchors: Block, candidates: Block, count: int) -> pa.Table:
    """The best rows of other ids for each anchor, of its own label."""
    vectors = anchors.table["vector"].to_numpy()
    out = []
    for label in set(anchors.labels.tolist()):
        rows = np.flatnonzero(candidates.labels == label)
        if not len(rows):
            continue
        ids = candidates.ids[rows]
        for some, found in _scored(anchors, np.flatnonzero(anchors.labels == label), candidates, rows):
            for a, line in zip(some.tolist(), found):
                other = np.flatnonzero(ids != anchors.ids[a])
                line = line[other]
                if len(line) > count:  # all that tie with the last one, and more
                    near = np.flatnonzero(line >= np.partition(line, len(line) - count)[len(line) - count])
                    other, line = other[near], line[near]
                order = np.argsort(-line.astype(np.int64), kind="stable")[:count]
                if len(order):
                    out.append((anchors.ids[a], vectors[a], ids[other[order]], line[order]))
    return _table(out, BEST)


def best_between(anchors: Block, candidates: Block, count: int, least: int, most: int) -> pa.Table:
    """For each anchor and positive, the best rows of other labels whose score is in the positive's range."""
    vectors, positives = anchors.table["vector"].to_numpy(), anchors.table["positives"].to_pylist()
    names = {label: i for i, label in enumerate(set(anchors.labels.tolist()) | set(candidates.labels.tolist()))}
    theirs, own = (np.array([names[label] for label in x], dtype=np.int64) for x in (candidates.labels.tolist(), anchors.labels.tolist()))
    out = []
    for some, found in _scored(anchors, np.arange(len(anchors.ids)), candidates, np.arange(len(candidates.ids))):
        for a, line in zip(some.tolist(), found):
            ranges = [(i, -(-least * p["score"] // 100), most * p["score"] // 100) for i, p in enumerate(positives[a])]
            low, high = min(r[1] for r in ranges), max(r[2] for r in ranges)
            inside = np.flatnonzero((line >= low) & (line <= high) & (theirs != own[a]))
            line = line[inside].astype(np.int64)
            order = np.argsort(-line, kind="stable")
            down = -line[order]
            for place, low, high in ranges:
                begin, end = np.searchsorted(down, -high, side="left"), np.searchsorted(down, -low, side="right")
                if end > begin:
                    top = order[begin : min(end, begin + count)]
                    out.append((anchors.ids[a], vectors[a], place, candidates.ids[inside[top]], line[top]))
    return _table(out, CHOSEN)


def _dealt(rows: DataFrame, anchors: DataFrame, by_label: bool, total: int) -> tuple[DataFrame, DataFrame]:
    """Both with (cell, of_label, row_block, anchor_block); each pair of blocks of a label, or of all, has a cell."""
    size = min(MOST_ROWS, max(LEAST_ROWS, total // 64))
    counts = rows.groupBy("label" if by_label else F.lit(None).alias("none")).agg(F.count(F.lit(1)).alias("n_rows"))
    own = anchors.groupBy("label" if by_label else F.lit(None).alias("none")).agg(F.count(F.lit(1)).alias("n_anchors"))
    if by_label:
        sizes = counts.join(own, "label")
    else:
        sizes = None
        n_rows, n_anchors = (x.first()[1] if x.first() else 0 for x in (counts, own))

    def with_blocks(df: DataFrame) -> DataFrame:
        df = df.join(sizes, "label") if by_label else df.withColumns({"n_rows": F.lit(n_rows), "n_anchors": F.lit(n_anchors)})
        df = df.selectExpr("*", f"int(ceil(n_rows / {size})) AS row_blocks", f"int(ceil(n_anchors / {ANCHORS})) AS anchor_blocks")
        if not by_label:
            return df.selectExpr("*", "0L AS cell", "cast(null AS string) AS of_label")
        small = "row_blocks = 1 AND anchor_blocks = 1"
        shared = max(1, -(-total // size))
        return df.selectExpr("*", f"IF({small}, pmod(xxhash64(label), {shared}), -1L) AS cell", f"IF({small}, null, string(label)) AS of_label")

    dealt_rows = with_blocks(rows).selectExpr(
        "*", "int(pmod(xxhash64(vec_id, planes), row_blocks)) AS row_block", "explode(sequence(0, anchor_blocks - 1)) AS anchor_block"
    )
    dealt_anchors = with_blocks(anchors).selectExpr(
        "*", "int(pmod(xxhash64(vec_id, vector), anchor_blocks)) AS anchor_block", "explode(sequence(0, row_blocks - 1)) AS row_block"
    )
    dropped = ["n_rows", "n_anchors", "row_blocks", "anchor_blocks"]
    return dealt_rows.drop(*dropped), dealt_anchors.drop(*dropped)


CELL = ["cell", "of_label", "row_block", "anchor_block"]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST_SHARE,
    most: int = MOST_SHARE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    ``is_anchor`` is an SQL condition on vec_id. An anchor's positives are its best rows of the same label
    and another vec_id; for each, its negatives are the best rows of another label that score from ``least`` to ``most``
    hundredths of the positive. Best is the higher score, then the smaller vec_id. A component is
    rounded down after multiplication by ``SCALE``, and bounded by ``MOST``.

    Rows take no part whose vec_id, label or vector is null, or any of whose components is null or not finite.
    Vectors of different lengths meet as if the shorter one went on with zeros. Labels may have any type. Repeated
    rows are different candidates; as anchors equal rows count once, and different rows of one vec_id are
    each an anchor. Other columns are not read. Without rows, anchors or positives there is no result.
    """
    fit = vectors.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL"
        " AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(double(x)) = double('infinity'))"
    ).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.expr("transform(embedding, x -> double(x))").alias("embedding"))
    widest, largest, total = fit.agg(
        F.max(F.size("embedding")), F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))), F.count(F.lit(1))
    ).first()
    dimensions = max(widest or 0, 1)
    bits = int(min(MOST, SCALE * (largest or 0.0) + 1)).bit_length() + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            values = np.zeros((len(lists), dimensions), dtype=np.int64)
            whole = np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64)
            values[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
            blobs = pa.array([p.tobytes() for p in planes_of(values, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), blobs], ["vec_id", "label", "planes"])

    label = fit.schema["label"].dataType.simpleString()
    rows = materialise(fit.mapInArrow(packed, f"vec_id long, label {label}, planes binary"), "negatives-rows")
    anchors = rows.where(is_anchor).distinct().withColumn("vector", F.xxhash64("label", "planes"))
    anchors = materialise(anchors, "negatives-anchors")

    def of_label(mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return BEST.empty_table()
        return best_of_label(Block(asked, bits), Block(mine, bits), positives)

    def between(mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return CHOSEN.empty_table()
        return best_between(Block(asked, bits), Block(mine, bits), negatives, least, most)

    left, right = _dealt(rows, anchors, True, total)
    best = left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInArrow(of_label, "anchor long, vector long, id long, score long")
    order = [F.desc("score"), "id"]
    first = best.withColumn("turn", F.row_number().over(Window.partitionBy("anchor", "vector").orderBy(*order))).where(F.col("turn") <= positives)
    listed = first.groupBy("anchor", "vector").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "score"))).alias("positives"))
    listed = materialise(listed.withColumnRenamed("anchor", "vec_id"), "negatives-positives")

    left, right = _dealt(rows, anchors.join(listed, ["vec_id", "vector"]), False, total)
    chosen = left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInArrow(between, "anchor long, vector long, place int, id long, score long")
    line = Window.partitionBy("anchor", "vector", "place").orderBy(*order)
    ranked = chosen.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= negatives)
    asked = listed.selectExpr("vec_id AS anchor", "vector", "posexplode(positives) AS (place, positive)")
    return ranked.join(asked, ["anchor", "vector", "place"]).selectExpr(
        "anchor AS anchor_id", "positive.id AS positive_id", "rank", "id AS negative_id", "positive.score AS positive_score", "score AS negative_score"
    )
