"""Bundle regression jobs over tables of fixtures and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlog.functions.text import rfc3339


def canonical_event(event: Column) -> Column:
    """Event JSON in one key order with RFC 3339 times and no NULL fields."""
    return F.to_json(F.parse_json(F.to_json(event.withField("time", rfc3339(event["time"])))))


def fixture_failures(run: DataFrame, expected: DataFrame) -> DataFrame:
    """Valid fixtures that were not selected, not complete, or differ from the expected event.

    `run`: fixture, outcome, parse_status, mapped. `expected`: fixture, event_json.
    """
    m = F.col("mapped")
    joined = run.join(expected, "fixture", "left")
    same = canonical_event(m["event"]) == F.to_json(F.parse_json("event_json"))
    problem = (
        F.when(F.col("outcome") != "SELECTED", "NOT_SELECTED").when(F.col("parse_status") != "PARSED", "NOT_PARSED")
        .when(m["event"].isNull() | (F.size(m["issues"]) > 0) | (m["required_present"] != m["required_total"]), "NOT_NORMALIZED")
        .when(F.col("event_json").isNull(), "NO_EXPECTED_EVENT").when(~F.coalesce(same, F.lit(False)), "EVENT_DIFFERS")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("fixture", "problem")


def wrongly_selected(invalid: DataFrame, run: DataFrame) -> DataFrame:
    """Invalid fixtures that some fingerprint selected."""
    # Aggregate first: a filter on the outcome itself would be pushed into the
    # detection projections and repeat their expressions.
    verdicts = run.groupBy("fixture").agg(F.max(F.col("outcome") == "SELECTED").alias("selected"))
    return invalid.join(verdicts.filter("selected"), "fixture", "left_semi")


def nondeterministic_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that two runs do not share; the columns must be comparable."""
    return first.exceptAll(second).withColumn("run", F.lit(1)).unionByName(second.exceptAll(first).withColumn("run", F.lit(2)))


def run_fingerprint(run: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, sum_hash, xor_hash): one row per key, equal for equal multisets of rows whatever their order and partitions.

    Rows that cancel in a sum do not cancel in the exclusive or of another hash.
    """
    values = [c for c in run.columns if c not in keys]
    one, two = F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)
    return run.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(one.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(two).alias("xor_hash"))


def unstable_keys(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows two runs do not share: of other values, repeated, or missing in one.

    Only fingerprints are joined, so runs of wide rows are compared at the cost of two hashes a row.
    """
    a, b = run_fingerprint(first, keys).alias("a"), run_fingerprint(second, keys).alias("b")
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    differ = F.lit(False)
    for c in ("rows", "sum_hash", "xor_hash"):
        differ = differ | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same_key, "full").filter(differ).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys])


def capture_failures(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """Capture fixtures whose match verdict or exact field map differs.

    `parsed`: fixture, status, fields MAP. `expected`: fixture, matches, fields MAP.
    """
    want = expected.select("fixture", F.col("matches"), F.col("fields").alias("_want"))
    hit = F.col("status").isin("PARSED", "PARTIALLY_PARSED")
    same = F.array_sort(F.map_entries("fields")) == F.array_sort(F.map_entries("_want"))
    problem = F.when(hit != F.col("matches"), "MATCH_DIFFERS").when(hit & ~F.coalesce(same, F.lit(False)), "FIELDS_DIFFER")
    return parsed.join(want, "fixture").withColumn("problem", problem).filter("problem IS NOT NULL").select("fixture", "problem")


def artifact_drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Declared artifacts that are missing or have another digest. Both: path, sha256."""
    have = files.select("path", F.col("sha256").alias("_have"))
    kind = F.when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("sha256"), "changed")
    return manifest.join(have, "path", "left").withColumn("drift", kind).filter("drift IS NOT NULL").select("path", "drift")


def version_key(version: Column) -> Column:
    """Struct that orders like semantic versions, prereleases included."""
    core = F.split(F.regexp_extract(version, r"^([0-9]+\.[0-9]+\.[0-9]+)", 1), r"\.")
    pre = F.regexp_extract(version, r"^[0-9.]+-([0-9A-Za-z.\-]+)", 1)

    def part(p: Column) -> Column:
        number = p.rlike(r"^[0-9]+\z")
        # Numeric identifiers sort below alphanumeric ones and by value.
        return F.struct((~number).alias("text"), F.when(number, p.try_cast("bigint")).otherwise(0).alias("n"), F.when(number, "").otherwise(p).alias("s"))

    return F.struct(
        *[F.get(core, F.lit(i)).try_cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"))],
        (pre == "").alias("release"), F.when(pre != "", F.transform(F.split(pre, r"\."), part)).alias("pre"))


def incompatible_bundles(bundles: DataFrame, schema: str, taxonomy: str, engine: str) -> DataFrame:
    """Bundles this engine may not load: (bundle_id, reason).

    `bundles`: bundle_id, envelope_schema, taxonomy_version, minimum_engine, maximum_engine.
    """
    own = version_key(F.lit(engine))
    top = F.nullif(F.col("maximum_engine"), F.lit(""))
    reason = (
        F.when(F.col("envelope_schema") != schema, "SCHEMA").when(F.col("taxonomy_version") != taxonomy, "TAXONOMY")
        .when(own < version_key(F.col("minimum_engine")), "ENGINE_TOO_OLD").when(top.isNotNull() & (own > version_key(top)), "ENGINE_TOO_NEW")
    )
    return bundles.withColumn("reason", reason).filter("reason IS NOT NULL").select("bundle_id", "reason")
