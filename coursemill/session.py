"""Session settings and lineage cuts shared by every job in the package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Left to Spark at run time: partition counts, broadcast choice and skew splitting. No job in this
# package hints a broadcast of a frame that grows with the data; AQE measures the finished shuffle
# and only then swaps in a broadcast join, so an oversized dictionary falls back to a sort-merge join.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


_FALLBACKS: dict[str, str] = {}

#: Bytes of the largest table's files for one shuffle partition.
PARTITION_BYTES = 4 << 20
_SIZES: dict[tuple[str, str], int] = {}


def fit_partitions(spark: SparkSession, path: str) -> None:
    """Let shuffles start with one partition for every ``PARTITION_BYTES`` of the files at ``path``, if that is more than now.

    A task's memory then stays the same as tables grow; AQE puts small partitions together again. Sizes come from a listing.
    """
    key = (spark.sparkContext.applicationId, path)
    if key not in _SIZES:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        _SIZES[key] = listed.selectExpr("coalesce(sum(length), 0)").first()[0]
        wanted = -(-_SIZES[key] // PARTITION_BYTES)
        if wanted > partitions(spark):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with."""
    fixed = spark.conf.get("spark.sql.shuffle.partitions")
    return max(int(fixed), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, which ``spark.checkpoint.dir`` names.

    Where none is configured, a local session (tests) gets a temporary one; on a cluster executors would
    write to their own disks, so that raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _FALLBACKS:
        _FALLBACKS[application] = tempfile.mkdtemp(prefix="coursemill-")
    return _FALLBACKS[application]


def checkpoint_ready(spark: SparkSession) -> None:
    """Point reliable checkpoints (used by iterative learners) at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    For frames that several branches read (the spine, the model matrix): the branches then share
    one computed copy that outlives lost executors, keeps column pruning and has true size
    statistics for join planning.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    """The path in the shared folder that ``df`` is written to as Parquet."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/coursemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
