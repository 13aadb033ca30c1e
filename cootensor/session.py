"""Session helpers: one place for the settings every job here relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Name of the value column of every tensor and matrix (the reference convention).
VALUE = "product"

# Largest factor (rows) we broadcast after counting it.  A factor row is three
# narrow columns, so 2M rows is about 50 MB in the broadcast relation.
BROADCAST_MAX_ROWS = 2_000_000
# ... and its largest size in bytes, for labels and struct keys.
BROADCAST_MAX_BYTES = 96 << 20

# Side of the dense tile a Gram or cross-moment task fills: 2048^2 doubles = 32 MB.
TILE_DIM = 2048
# Largest mode dimension whose d x d matrix the one-task eigen and ridge solvers take.
MAX_LOCAL_DIM = 2048


def get_session(master: str | None = None, app: str = "cootensor",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the engine expects.

    On a cluster pass ``master=None`` and let spark-submit decide; locally the
    tests use ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         # iterative jobs checkpoint every step: drop files nothing references
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Only a local session (tests) may get a folder of
    our own when none is set; on a cluster a machine-local folder would be lost
    with its executor, so we refuse instead.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared (HDFS/object store) folder")
    d = tempfile.mkdtemp(prefix="cootensor-ckpt-")
    sc.setCheckpointDir(d)
    return d


def run_dir(spark: SparkSession, run_id: str | None = None) -> str:
    """A per-run folder under the checkpoint root (never a fixed shared name)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)
    root = root.rstrip("/")
    rid = run_id or uuid.uuid4().hex[:12]
    return f"{root}/cootensor-runs/{rid}"
