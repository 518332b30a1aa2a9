"""Backfill that reprocesses: queued jobs run again with the bundle they name.

Two tables are committed, one after the other. `results` gets the new revisions,
each with its envelope, and the jobs that could not run with the reason.
`settlements` then gets the outcome of each job, read from what is stored in
`results`. Wherever a run dies, running it again (under its own name or another)
ends in the same jobs and revisions: committed parts are kept, others replaced,
and a revision key that is stored already is not interpreted again.

Defined results: a job that is not QUEUED is left alone. The first of these ends
a job as FAILED: no receipt, a bundle that is not installed, raw bytes gone, raw
bytes altered, a result under another bundle than the job's (none of its
fingerprints matched). Repeated jobs of one key share its revision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlog.operators.detect import READ_COLUMN, Fingerprint, Routes, detect
from siftlog.operators.envelope import build_envelopes, with_json
from siftlog.operators.mapping import Mapping, apply_mappings
from siftlog.operators.parse import parse
from siftlog.operators.revisions import REVISION_KEY
from siftlog.sources import commits

RESULTS = commits.columns(
    "job_id string, receipt_id string, pipeline_version string, bundle_sha256 string, revision_id string, status string, created_at_ns bigint, "
    "raw_sha256 string, raw_size bigint, envelope_json string, problem string")
SETTLEMENTS = commits.columns("job_id string, status string, completed_revision_id string, last_error_code string")


@dataclass(frozen=True, eq=False)
class Bundle:
    """An installed bundle: its fingerprints and its rules per parser implementation."""

    digest: str
    fingerprints: tuple[Fingerprint, ...]
    mappings: dict[str, Mapping]
    selector_keys: frozenset[str] = frozenset()


def current_jobs(root: str, jobs: DataFrame) -> DataFrame:
    """The job table with the outcome of all committed runs."""
    settled = commits.read_runs(jobs.sparkSession, f"{root}/settlements", SETTLEMENTS)
    once = settled.groupBy("job_id").agg(F.min(F.struct("status", "completed_revision_id", "last_error_code")).alias("_s"))
    rest = [c for c in jobs.columns if c not in SETTLEMENTS.fieldNames()]
    known = [c for c in ("completed_revision_id", "last_error_code") if c in jobs.columns]
    before = {c: F.col(c) if c in known else F.lit(None).cast("string") for c in ("completed_revision_id", "last_error_code")}
    return jobs.join(once, "job_id", "left").select(
        "job_id", *rest, F.coalesce("_s.status", "status").alias("status"),
        *[F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(was).alias(c) for c, was in before.items()])


def stored_revisions(spark: SparkSession, root: str) -> DataFrame:
    """Revisions of all committed runs, one per key."""
    good = commits.read_runs(spark, f"{root}/results", RESULTS).filter(F.col("problem").isNull())
    keep = [c for c in RESULTS.fieldNames() if c not in REVISION_KEY and c != "problem"]
    first = F.min_by(F.struct(*keep), F.struct("created_at_ns", "revision_id", "job_id"))
    return good.groupBy(*REVISION_KEY).agg(first.alias("_r")).select(*REVISION_KEY, "_r.*")


def _refusal(bundles: list[Bundle]) -> Column:
    """Why a job cannot run; null if it can."""
    raw = F.col("raw")
    return (
        F.when(~F.col("bundle_sha256").isin([b.digest for b in bundles]), "BUNDLE_UNAVAILABLE")
        .when(raw.isNull() | ~F.coalesce("raw_available", F.lit(False)), "EVIDENCE_UNAVAILABLE")
        .when((F.octet_length(raw) != F.col("raw_size")) | (F.sha2(raw, 256) != F.col("raw_sha256")), "EVIDENCE_INTEGRITY")
    )


def read_evidence(ready: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """Jobs with their receipt and raw bytes, detected by their own bundle's fingerprints alone and parsed; written once for all bundles."""
    routes = Routes({b.digest: list(b.fingerprints) for b in bundles})
    return commits.stored(parse(detect(ready, bundle="bundle_sha256", routes=routes)).drop("raw", READ_COLUMN), "parsed")


def reprocess(parsed: DataFrame, bundle: Bundle, processed_at: Column) -> DataFrame:
    """Results of parsed jobs by the rules of their bundle."""
    key = F.when(F.col("parsed.status") != "INVALID", F.col("detection.impl"))
    found = apply_mappings(parsed.withColumn("_key", key), bundle.mappings, "_key", "parsed.fields", set(bundle.selector_keys)).drop("_key")
    built = with_json(build_envelopes(found, processed_at, F.col("pipeline_version"), keep=["job_id", "pipeline_version", "bundle_sha256"]))
    digest = F.col("processing.parser.bundle_sha256")
    problem = F.when(~F.coalesce(digest == F.col("bundle_sha256"), F.lit(False)), "BUNDLE_MISMATCH")
    return built.select(
        "job_id", F.col("receipt.id").alias("receipt_id"), "pipeline_version", "bundle_sha256", F.col("processing.revision_id").alias("revision_id"),
        F.col("processing.status").alias("status"), (F.unix_micros(F.col("processing.timestamps.completed_at")) * 1000).alias("created_at_ns"),
        F.col("raw.sha256").alias("raw_sha256"), F.col("raw.size_bytes").alias("raw_size"), "envelope_json", problem.alias("problem"))


def run_backfill(root: str, run: str, jobs: DataFrame, receipts: DataFrame, bundles: list[Bundle], processed_at: Column) -> DataFrame:
    """Run the queued jobs, commit their results, settle them, and return the job table.

    `receipts` carry `raw`; `processed_at` is a value of the run, so that a task that runs again writes the same revision.
    """
    spark = jobs.sparkSession
    results, settlements = f"{root}/results", f"{root}/settlements"
    if not commits.is_committed(spark, settlements, run):
        queued = current_jobs(root, jobs).filter(F.col("status") == "QUEUED").select("job_id", *REVISION_KEY)
        if queued.isEmpty():
            return current_jobs(root, jobs)
        known = stored_revisions(spark, root).select(*REVISION_KEY)
        todo = queued.join(known, REVISION_KEY, "left_anti")
        wanted = {r[0] for r in todo.select("bundle_sha256").filter(F.col("bundle_sha256").isin([b.digest for b in bundles])).distinct().collect()}
        # Inner, so that few jobs can be sent to many receipts; only ids of receipts are needed to find jobs without one.
        found = receipts.join(todo, "receipt_id").withColumn("refusal", _refusal(bundles))
        lost = todo.join(receipts.select("receipt_id"), "receipt_id", "left_anti").withColumn("refusal", F.lit("RECEIPT_UNAVAILABLE"))
        keys = ["job_id", *REVISION_KEY, "refusal"]
        refused = found.filter(F.col("refusal").isNotNull()).select(*keys).unionByName(lost.select(*keys)).withColumnRenamed("refusal", "problem")
        if not commits.is_committed(spark, results, f"{run}-refused"):
            commits.write_run(refused.select(*[
                F.col(f.name) if f.name in refused.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULTS]), results, f"{run}-refused")
        open_parts = {b: f"{run}-{b.digest[:16]}" for b in bundles if b.digest in wanted and not commits.is_committed(spark, results, f"{run}-{b.digest[:16]}")}
        if open_parts:
            ready = found.filter(F.col("refusal").isNull() & F.col("bundle_sha256").isin([b.digest for b in open_parts])).drop("refusal")
            parsed = read_evidence(ready, list(open_parts))
            for bundle, part in open_parts.items():
                commits.write_run(reprocess(parsed.filter(F.col("bundle_sha256") == bundle.digest), bundle, processed_at), results, part)
        commits.write_run(settle(spark, root, queued), settlements, run)
    return current_jobs(root, jobs)


def settle(spark: SparkSession, root: str, queued: DataFrame) -> DataFrame:
    """Outcomes of queued jobs by what is stored: a revision under the job's key, or else the reason there is none."""
    done = stored_revisions(spark, root).select(*REVISION_KEY, F.col("revision_id").alias("completed_revision_id"))
    why = commits.read_runs(spark, f"{root}/results", RESULTS).filter("problem IS NOT NULL").groupBy("job_id").agg(F.min("problem").alias("why"))
    finished = F.col("completed_revision_id").isNotNull()
    return queued.join(done, REVISION_KEY, "left").join(why, "job_id", "left").filter(finished | F.col("why").isNotNull()).select(
        "job_id", F.when(finished, "COMPLETE").otherwise("FAILED").alias("status"), "completed_revision_id",
        F.when(~finished, F.col("why")).alias("last_error_code"))
