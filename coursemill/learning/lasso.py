"""L1 logistic regression along a path of penalties, for all rows and for every fold at once.

A fit minimises the mean log loss plus ``penalty * sum(|coefficient| * deviation of its column)``; the
intercept is free. The rows are packed once into sparse blocks in the shared folder. One pass over the
blocks gives, for every fit, the gradient of all coefficients, and the curvature among the *working set*:
the coefficients that are not zero, or that the strong rule cannot rule out for the next penalty. A
coordinate descent on this quadratic, small and on the driver, gives the next coefficients, from which the
path goes on. A penalty is done when every coefficient of every fit, in the working set or not, meets its
optimality condition, so what the strong rule wrongly left out comes in.

A fold's fit leaves the fold's rows out. Its curvature is that of all rows, weighted by the fit to all rows, less
the fold's part, so that all fits take the work of one; conditions are checked with each fit's own gradient.
Where that does not settle, as with few rows for the columns, each fit's own curvature is summed up, and at
last an upper bound of it.

Passes return one row per group of tasks, added up in two levels. The driver holds coefficients and the
curvature of the working set, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.session import materialise

#: Rows of a block.
BLOCK_ROWS = 4096
#: Blocks that are handed on together. A block counts as one row for Spark, whose own limits would let a task hold 10,000.
BLOCKS_AT_ONCE = 4
#: Columns up to which a block is laid out whole, once for all its sums.
LAID_OUT = 1024
#: A condition may be off by so much of the penalty.
TOLERANCE = 5e-3
#: Tasks whose sums are added up on the driver; those of more are added up in groups first.
DIRECT = 64
#: Penalties ahead for which the strong rule is asked, so that one pass serves several.
AHEAD = 4
#: Passes for one penalty after which each fit's curvature takes the fit's own weights, and those after which it takes the
#: largest weight there is, with which no step overshoots.
OWN, BOUNDED = 6, 30
#: Passes for one penalty, after which an error is raised.
MOST_PASSES = 200

_BATCHES = (
    "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.inMemoryColumnarStorage.batchSize", "spark.sql.execution.arrow.maxRecordsPerBatch",
)
BLOCK = pa.schema([("rows", pa.int32()), *[(c, pa.binary()) for c in ("labels", "folds", "sizes", "indices", "values")]])
_BLOCK_DDL = "rows int, labels binary, folds binary, sizes binary, indices binary, values binary"


@dataclass(frozen=True)
class Rows:
    """Sparse rows in blocks; fold -1 belongs to no fold."""

    blocks: DataFrame
    width: int
    folds: int
    files: int


def packed(df: DataFrame, width: int, folds: int = 0) -> Rows:
    """From ``label double, indices array<int>, values array<double>`` and, with ``folds``, ``fold int`` from 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                label, fold, indices, values = batch.slice(begin, BLOCK_ROWS).columns
                blobs = [
                    label.to_numpy().astype(np.float64),
                    fold.to_numpy().astype(np.int32),
                    indices.value_lengths().to_numpy().astype(np.int32),
                    indices.flatten().to_numpy().astype(np.int32),
                    values.flatten().to_numpy().astype(np.float64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([len(label)], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], schema=BLOCK)

    fold = F.col("fold").cast("int") if folds else F.lit(-1)
    rows = df.select(F.col("label").cast("double"), fold.alias("fold"), "indices", F.col("values").cast("array<double>"))
    blocks = materialise(rows.mapInArrow(pack, _BLOCK_DDL), "lasso-blocks")
    return Rows(blocks, width, folds, blocks.select(F.input_file_name()).distinct().count())


class _Block:
    def __init__(self, row: dict, width: int):
        self.n, self.width = row["rows"], width
        self.y = np.frombuffer(row["labels"], np.float64)
        self.fold = np.frombuffer(row["folds"], np.int32)
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.index = np.frombuffer(row["indices"], np.int32)
        self.value = np.frombuffer(row["values"], np.float64)
        self.row = np.repeat(np.arange(self.n), self.sizes)
        self.whole = None
        if width <= LAID_OUT and (np.diff(self.index)[np.diff(self.row) == 0] > 0).all():  # no cell comes twice
            self.whole = np.zeros((self.n, width))
            self.whole[self.row, self.index] = self.value

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """(rows, columns) of some columns."""
        if self.whole is not None:
            return self.whole[:, columns]
        place = np.full(self.width, -1, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        at = place[self.index]
        kept = at >= 0
        out = np.zeros((self.n, len(columns)))
        out[self.row[kept], at[kept]] = self.value[kept]
        return out

    def totals(self, weights: np.ndarray) -> np.ndarray:
        """(fits, width): the columns' sums under each fit's row weights (rows, fits)."""
        if self.whole is not None:
            return weights.T @ self.whole
        return np.stack([np.bincount(self.index, self.value * w[self.row], self.width) for w in weights.T])


def _added(rows: Rows, names: Sequence[str], one: callable) -> dict[str, np.ndarray]:
    """Sums over all blocks of the arrays that ``one`` returns for a block, in the order of ``names``."""
    width = rows.width
    ddl = "slot int, " + ", ".join(f"{n} binary" for n in names)
    schema = pa.schema([("slot", pa.int32()), *[(n, pa.binary()) for n in names]])

    def row_of(slot: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], schema=schema)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {"rows": batch.column(0)[i].as_py()} | {c: batch.column(c)[i].as_buffer() for c in BLOCK.names[1:]}
                parts = one(_Block(row, width))
                total = parts if total is None else [a + b for a, b in zip(total, parts)]
                count += row["rows"]
        if total is not None:
            yield row_of(count % slots, [np.asarray(t, dtype=np.float64) for t in total])

    def in_slot(table: pa.Table) -> pa.Table:
        parts = [sum(np.frombuffer(b, np.float64) for b in table[n].to_pylist()) for n in names]
        return pa.Table.from_batches([row_of(table["slot"][0].as_py(), parts)])

    # tasks are as many as the table's files at most; a small number of sums goes to the driver at once
    slots = max(1, int(rows.files**0.5))
    found = rows.blocks.mapInArrow(in_task, ddl)
    if rows.files > DIRECT:
        found = found.groupBy("slot").applyInArrow(in_slot, ddl)
    with _few_at_once(rows.blocks.sparkSession):
        found = found.toPandas()
    return {n: sum((np.frombuffer(b, np.float64) for b in found[n]), np.zeros(0) if found.empty else 0.0) for n in names}


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Meanwhile batches of the reader, the executors' cache and Arrow hold ``BLOCKS_AT_ONCE`` rows, which are blocks."""
    before = {c: spark.conf.get(c) for c in _BATCHES}
    for c in before:
        spark.conf.set(c, str(BLOCKS_AT_ONCE))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def _squares(x: np.ndarray) -> np.ndarray:
    """Products of all columns with each other: a matrix with itself is half the work of one with another."""
    return x.T @ x


@dataclass
class Path:
    """Fits by penalty: fit 0 is to all rows, fit 1 + k leaves out fold k."""

    penalties: np.ndarray
    intercepts: np.ndarray  # (steps, fits)
    coefficients: np.ndarray  # (steps, fits, width)
    passes: int


def _in_fit(fold: np.ndarray, fits: int) -> np.ndarray:
    """(rows, fits): whether a fit sees a row."""
    return np.stack([np.ones(len(fold), bool), *(fold != k for k in range(fits - 1))], axis=1).astype(np.float64)


def moments(rows: Rows) -> dict[str, np.ndarray]:
    """For each fit: its rows, sum of labels, and every column's deviation and covariance with the label."""
    fits, width = rows.folds + 1, rows.width

    def one(block: _Block) -> list[np.ndarray]:
        seen = _in_fit(block.fold, fits)
        squares = np.stack([np.bincount(block.index, block.value**2 * w[block.row], width) for w in seen.T])
        return [seen.sum(0), block.y @ seen, block.totals(seen).ravel(), squares.ravel(), block.totals(seen * block.y[:, None]).ravel()]

    t = _added(rows, ["n", "ones", "sums", "squares", "products"], one)
    n = t["n"][:, None]
    mean = t["sums"].reshape(fits, width) / n
    deviation = np.sqrt(np.maximum(t["squares"].reshape(fits, width) / n - mean**2, 0))
    deviation[deviation < 1e-9 * (1 + np.abs(mean))] = 0.0
    covariance = t["products"].reshape(fits, width) / n - mean * (t["ones"] / t["n"])[:, None]
    return {"n": t["n"], "ones": t["ones"], "deviation": deviation, "covariance": covariance}


def penalties_for(m: dict[str, np.ndarray], steps: int = 100, ratio: float = 0.05) -> np.ndarray:
    """From the smallest penalty that leaves no coefficient of the fit to all rows, down to ``ratio`` times it."""
    s = m["deviation"][0]
    largest = float(np.max(np.abs(m["covariance"][0][s > 0]) / s[s > 0], initial=0.0)) or 1.0
    return largest * ratio ** (np.arange(steps) / max(1, steps - 1))


def _descended(curve: np.ndarray, slope: np.ndarray, at: np.ndarray, bound: np.ndarray, enough: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Near the least of each fit's quadratic around ``at`` plus ``bound * |coefficient|``, by coordinates, all fits at once.

    Shapes are (fits, size, size) and (fits, size). A round goes over the coefficients that are not zero, or that their slope
    moves, in some fit. It ends when no step changes a slope by more than ``enough``, or the rounds are over: the next
    pass over the rows goes on from there.
    """
    x, g = at.copy(), slope.copy()  # g: slope of the quadratics at x
    diagonal = np.maximum(np.diagonal(curve, axis1=1, axis2=2), 1e-12)
    columns = np.ascontiguousarray(curve.transpose(2, 0, 1))
    step, shrink = np.ascontiguousarray((1 / diagonal).T), np.ascontiguousarray((bound / diagonal).T)
    limit = np.ascontiguousarray((enough / diagonal).T)
    for _ in range(rounds):
        moving = False
        for j in np.flatnonzero(((x != 0) | (np.abs(g) > bound)).any(0)):
            raw = x[:, j] - g[:, j] * step[j]
            new = np.sign(raw) * np.maximum(np.abs(raw) - shrink[j], 0.0)
            moved = new - x[:, j]
            if moved.any():
                g += columns[j] * moved[:, None]
                x[:, j] = new
                moving = moving or bool((np.abs(moved) > limit[j]).any())
        if not moving:
            break
    return x


def fit_path(rows: Rows, penalties: Sequence[float] | None = None, tolerance: float = TOLERANCE) -> Path:
    """Coefficients of every fit at every penalty, in falling order. Executors keep the blocks for its many passes."""
    with _few_at_once(rows.blocks.sparkSession):  # a cached table keeps the settings it was marked under
        rows.blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return _fitted_path(rows, penalties, tolerance)
        finally:
            rows.blocks.unpersist()


def _fitted_path(rows: Rows, penalties: Sequence[float] | None, tolerance: float) -> Path:
    m = moments(rows)
    fits, width = rows.folds + 1, rows.width
    penalties = penalties_for(m) if penalties is None else np.sort(np.asarray(penalties, dtype=np.float64))[::-1]
    n, s = m["n"], m["deviation"]
    share = np.clip(m["ones"] / n, 1e-9, 1 - 1e-9)
    intercept, beta = np.log(share / (1 - share)), np.zeros((fits, width))
    gradient = m["covariance"].copy()  # of the mean log likelihood; at the start only the intercept is fitted
    before = float(np.max(np.abs(gradient[s > 0]) / s[s > 0], initial=0.0))
    intercepts, coefficients, passes = [], [], 0

    def through(columns: np.ndarray, attempt: int) -> dict[str, np.ndarray]:
        b, c = beta[:, columns].T.copy(), intercept.copy()
        size = len(columns) + 1
        own, bounded = OWN <= attempt < BOUNDED, attempt >= BOUNDED

        def one(block: _Block) -> list[np.ndarray]:
            x = np.concatenate([np.ones((block.n, 1)), block.dense(columns)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x[:, 1:] @ b + c, -40, 40)))
            seen = _in_fit(block.fold, fits)
            rest = (block.y[:, None] - p) * seen
            curve = np.zeros((fits, size, size))
            if own:
                for f in range(fits):
                    curve[f] = _squares(x * np.sqrt(p * (1 - p) * seen)[:, f : f + 1])
            else:
                x *= 0.5 if bounded else np.sqrt(p[:, :1] * (1 - p[:, :1]))
                for k in range(fits - 1):
                    curve[k + 1] = _squares(x[block.fold == k])
                # all rows are those of the folds and of none
                curve[0] = curve[1:].sum(0) + _squares(x[~np.isin(block.fold, np.arange(fits - 1))])
            return [rest.sum(0), block.totals(rest).ravel(), curve.ravel()]

        t = _added(rows, ["rest", "gradient", "curve"], one)
        curve = t["curve"].reshape(fits, size, size)
        if not own:
            curve[1:] = curve[0] - curve[1:]
        return {"rest": t["rest"], "gradient": t["gradient"].reshape(fits, width), "curve": curve}

    columns, t = np.zeros(0, dtype=np.int64), None
    for step, penalty in enumerate(penalties):
        # the strong rule: a coefficient stays zero if its gradient is below twice the penalty less the last one
        ahead = penalties[min(step + AHEAD, len(penalties) - 1)]
        may_enter = ((np.abs(gradient) >= (2 * penalty - before) * s) & (s > 0)).any(0)
        working = (beta != 0).any(0) | may_enter
        if t is None or not np.isin(np.flatnonzero(working), columns).all():  # those of the next few penalties come along
            working |= ((np.abs(gradient) >= (2 * ahead - before) * s) & (s > 0)).any(0)
            t = None
        else:  # the last pass was at these coefficients and has the curvature
            working[columns] = True
        for attempt in range(MOST_PASSES):
            if t is None:
                columns = np.flatnonzero(working)
                t = through(columns, attempt)
                passes += 1
                gradient = t["gradient"] / n[:, None]
            off = np.where(beta != 0, np.abs(gradient - penalty * s * np.sign(beta)), np.maximum(np.abs(gradient) - penalty * s, 0.0))
            off = np.where(s > 0, off / np.where(s > 0, s, 1.0), 0.0)
            if off.max(initial=0.0) <= tolerance * penalty and np.abs(t["rest"] / n).max() <= tolerance * penalty:
                break
            late = (off > tolerance * penalty).any(0) & ~working
            if late.any():  # wrongly left out: next pass has their curvature
                working |= late
            # the intercept is solved for, which leaves the curvature of columns centred under the fit's weights
            curve, slope = t["curve"] / n[:, None, None], -t["gradient"][:, columns] / n[:, None]
            shared = curve[:, 1:, 0] / curve[:, :1, 0]
            lift = -t["rest"] / n
            own = curve[:, 1:, 1:] - shared[:, :, None] * curve[:, None, 1:, 0]
            bound = np.where(s[:, columns] > 0, penalty * s[:, columns], 1e300)
            found = _descended(own, slope - shared * lift[:, None], beta[:, columns], bound, 0.1 * tolerance * penalty * s[:, columns])
            intercept = intercept - lift / curve[:, 0, 0] - (shared * (found - beta[:, columns])).sum(1)
            beta, t = beta.copy(), None
            beta[:, columns] = found
        else:
            raise RuntimeError(f"the path does not meet its conditions at penalty {penalty}")
        before = penalty
        intercepts.append(intercept.copy())
        coefficients.append(beta.copy())
    return Path(np.asarray(penalties), np.array(intercepts), np.array(coefficients), passes)


def scored(df: DataFrame, path: Path, steps: Iterable[int], fit: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, fold, step, score): each row under each penalty; ``fit="fold"`` uses the fit without its fold.

    ``df`` has ``label, indices, values`` (and ``fold``); scores are probabilities of label 1.
    """
    steps = list(steps)
    used = np.flatnonzero((path.coefficients[steps] != 0).any((0, 1)))
    width = path.coefficients.shape[2]
    b, c = path.coefficients[steps][:, :, used], path.intercepts[steps]
    number = F.col("fold").cast("int") + 1 if fit == "fold" else F.lit(0)
    kept = [*keys, "label"] + (["fold"] if fit == "fold" else [])
    place = np.full(width, -1, dtype=np.int64)
    place[used] = np.arange(len(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                which, indices, values = part.columns[-3:]
                at, row = place[indices.flatten().to_numpy()], np.repeat(np.arange(part.num_rows), indices.value_lengths().to_numpy())
                x = np.zeros((part.num_rows, len(used)))
                x[row[at >= 0], at[at >= 0]] = values.flatten().to_numpy()[at >= 0]
                which, margin = which.to_numpy(), np.empty((part.num_rows, len(steps)))
                for number in np.unique(which):
                    margin[which == number] = x[which == number] @ b[:, number].T + c[:, number]
                each = np.repeat(np.arange(part.num_rows), len(steps))
                repeated = [column.take(pa.array(each)) for column in part.columns[:-3]]
                step = pa.array(np.tile(np.array(steps, dtype=np.int32), part.num_rows))
                score = pa.array(1 / (1 + np.exp(-np.clip(margin.ravel(), -700, 700))))
                yield pa.RecordBatch.from_arrays([*repeated, step, score], names=[*kept, "step", "score"])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join([*(f"`{k}` {fields[k]}" for k in kept), "step int", "score double"])
    return df.select(*kept, number.alias("_fit"), "indices", F.col("values").cast("array<double>")).mapInArrow(run, ddl)
