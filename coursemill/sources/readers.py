"""File sources. Nothing here infers types from the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.functions.dates import parse_date
from coursemill.sources.names import syntactic_names

MISSING = "NA"
ORDINAL = "source_order"

# Values of a ``types`` entry that stand for a date with a demanded clock part.
_DATE_KINDS = {"date": "none", "date_minute": "minute", "date_second": "second"}


def _position() -> Column:
    """Sortable place of a row: file, then byte block, then order within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _typed(column: str, kind: str) -> Column:
    raw = F.col(f"`{column}`")
    if kind == "string":
        # A literal NA is missing while an empty field is an empty string.
        return F.when(raw == MISSING, F.lit(None)).otherwise(F.coalesce(raw, F.lit("")))
    present = F.nullif(raw, F.lit(MISSING))
    if kind in _DATE_KINDS:
        return parse_date(present, _DATE_KINDS[kind])
    return F.trim(present).try_cast(kind)


def read_table(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, str] | None = None,
    ordered: bool = False,
    rename: Mapping[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV table with a header row.

    ``multi_line`` allows line breaks inside quoted fields; a file is then read by one task.

    ``types`` maps repaired column names to ``string``, ``double``, ``int``, ``date``,
    ``date_minute`` or ``date_second``; when given, only those columns are read on. Values that
    do not fit become null. ``ordered`` adds the sortable ``source_order`` column for
    first-in-file rules.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    order = [_position().alias(ORDINAL)] if ordered else []
    raw = raw.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, syntactic_names(raw.columns))], *order
    )
    kinds = types or {c: "string" for c in raw.columns if c != ORDINAL}
    names = rename or {}
    return raw.select(
        *[_typed(c, kind).alias(names.get(c, c)) for c, kind in kinds.items()],
        *([F.col(ORDINAL)] if ordered else []),
    )


def read_folder(
    spark: SparkSession, folder: str, pattern: str = "*.csv", types: Mapping[str, Mapping[str, str]] | None = None
) -> dict[str, DataFrame]:
    """One table per matching file, keyed by file name. Lists file names only, reads no content."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    )
    paths = sorted(row.path for row in listing.collect())
    wanted = types or {}
    return {p.rsplit("/", 1)[-1]: read_table(spark, p, wanted.get(p.rsplit("/", 1)[-1])) for p in paths}


def read_crosswalk(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """Whitespace-delimited, headerless, all text; keeps ``source_order``."""
    fields = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).select("value", _position().alias(ORDINAL)).where(F.trim("value") != "")
    return lines.select(*[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(columns)], ORDINAL)


def read_positional(
    spark: SparkSession, path: str, positions: Mapping[str, int], separator: str = "|"
) -> DataFrame:
    """A headerless delimited file; ``positions`` maps names to 1-based field numbers.

    Short lines are filled, fields beyond the last position are not read.
    """
    width = max(positions.values())
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(1, width + 1)])
    raw = spark.read.schema(schema).csv(path, sep=separator, quote='"', mode="PERMISSIVE")
    return raw.select(*[_typed(f"f{i}", "string").alias(name) for name, i in positions.items()])


def union_by_name(frames: Iterable[DataFrame], distinct: bool = False) -> DataFrame:
    """Stack frames by column name; columns a frame lacks are null."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.distinct() if distinct else stacked
