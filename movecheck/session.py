"""Session settings the jobs are written for, and the reliable checkpoint helper."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Partial aggregation runs before every shuffle; a task only ever holds a split
    # of this size plus its hash table.
    "spark.sql.files.maxPartitionBytes": "128m",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # A path is not a table name: SQL text reads registered views only.
    "spark.sql.runSQLOnFiles": "false",
    # Column objects do not need the Python line that made them; recording it costs
    # more than planning for the wider jobs.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "movecheck", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``CONF`` applied; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): str(value) for key, value in conf.items()}
    for key, value in {**CONF, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only on a local master; on a cluster a machine-local
    folder would not outlive its machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="movecheck-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def scratch_folder(spark: SparkSession) -> str:
    """A new, empty place under the checkpoint folder, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files (an action)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 * 1024 * 1024


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written to the checkpoint folder, and broadcast if it proves small (an action).

    For lookup tables the planner cannot size, such as the result of another job: without
    a size it would shuffle the big side before finding out. Rows and bytes (of the
    values as text) are measured on what was written. Beyond either limit the join is
    left to the planner, which splits skewed partitions at run time.
    """
    written = checkpointed(df)
    text = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns])
    rows, size = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(written) if rows <= max_rows and size <= max_bytes else written
