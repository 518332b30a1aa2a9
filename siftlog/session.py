"""Session defaults and the shared scratch location for written cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set at session start; a running session keeps its own values for static ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    # Call sites in error messages cost several gateway round trips for each column
    # expression: half of the time it takes to build the interpretation plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# HotSpot never compiles a method above 8000 bytes of bytecode. A projection with
# hundreds of expressions fused into one method would therefore run interpreted;
# with this limit such stages use split projections, and small ones stay fused.
HUGE_METHOD_LIMIT = "8000"


def build_session(master: str = "local[*]", app: str = "siftlog", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on: UTC and compilable method sizes."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT)):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


#: Rows of one task of CPU-bound work, at one or two milliseconds a row.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to tasks of at most `ROWS_PER_TASK`, and to every core.

    Interpretation is CPU-bound, and the splits of a Parquet file say little about its
    rows: they all lie in the splits that hold the middle of a row group. The number of
    tasks follows the number of rows, which a scan without columns tells. Deal narrow
    columns and widen them afterwards: what stands below runs in the tasks of the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))


#: Folders of local sessions without a shared one, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    A local-mode session without the setting gets one of its own, as in tests. Any
    other is refused: a machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="siftlog-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
