"""Raw capture files as they arrive: deframed, judged and stored as receipts or rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlog import vocab
from siftlog.functions.hashing import stable_uuid
from siftlog.sources import evidence
from siftlog.streaming.jobs import StreamingQuery, run_available

#: Most tasks of a job that lists files.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Triggers between two times that Spark writes its list of all files seen anew.
COMPACTION = "spark.sql.streaming.fileSource.log.compactInterval"
CAPTURE = "path string, modificationTime timestamp, length bigint, content binary"


def capture_stream(spark: SparkSession, path: str, files_per_trigger: int, pattern: str = "*") -> DataFrame:
    """Files below `path`, at most `files_per_trigger` in a trigger; a file is read once, when it is first seen."""
    files = spark.readStream.format("binaryFile").schema(CAPTURE).option("maxFilesPerTrigger", files_per_trigger)
    return files.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def deframe(captures: DataFrame, tenant: str, listener: str, max_bytes: int) -> DataFrame:
    """Frames of octet-counted captures, ready to be judged.

    A receipt's id follows from its capture and place, so a replayed trigger gives
    the same receipts; a frame without bytes keeps the fault that ended its capture.
    """
    read = captures.select(F.col("path").alias("capture_id"), F.unix_micros("modificationTime").alias("us"), F.col("content").alias("data"))
    return evidence.split_octet_counted(read, max_bytes, carry=("us",)).select(
        stable_uuid(F.col("capture_id"), F.col("frame_no")).alias("receipt_id"), F.lit(tenant).alias("tenant_id"), F.lit(listener).alias("listener_id"),
        F.lit("syslog_tcp").alias("transport"), F.lit("octet_counting").alias("framing_mode"), F.col("error").isNull().alias("frame_complete"),
        (F.col("us") * 1000).alias("received_at_ns"), F.col("frame").alias("raw"), "error")


def stream_admit(
    captures: DataFrame, tenant: str, listener: str, table: str, checkpoint: str, name: str, max_bytes: int = vocab.MAX_INPUT_BYTES
) -> StreamingQuery:
    """New capture files -> receipts and rejects below `table`, one run for each trigger.

    A trigger reads its files once, in one stage. Spark looks up their sizes in a job of a task
    for each file; here that job has a few tasks a core. Spark writes the list of all files ever
    seen anew every ten triggers, which grows with the square of their number; here every hundred.
    """
    spark = captures.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        evidence.write_receipts(evidence.judge(deframe(batch, tenant, listener, max_bytes), max_bytes), table, f"{name}-{number}")

    own = {LISTING: str(4 * spark.sparkContext.defaultParallelism), COMPACTION: "100"}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        return run_available(captures, checkpoint, each)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
