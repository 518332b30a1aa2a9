"""Governed dataset export: selection, features, split, digests, manifest."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from siftlog import vocab
from siftlog.functions.hashing import split_bucket
from siftlog.functions.ip import canonical_ip
from siftlog.functions.text import json_escape_html, parse_rfc3339, rfc3339
from siftlog.sources import commits
from siftlog.sources.commits import stored

HASH_BYTES = 32
#: Text bytes of a dataset file, and of a row beside its features.
FILE_BYTES, ROW_BYTES = 256 << 20, 400

FEATURE_NAME = r"^[a-z][a-z0-9_]{0,63}$"
FEATURE_PATH = r"^[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+$"


@dataclass(frozen=True)
class Feature:
    name: str
    type: str
    source_path: str
    null_policy: str = "nullable"
    description: str = ""


@dataclass(frozen=True)
class FeatureSet:
    id: str
    version: str
    features: tuple[Feature, ...]

    def problems(self) -> list[str]:
        out = []
        names = [f.name for f in self.features]
        paths = [f.source_path for f in self.features]
        if not 1 <= len(names) <= vocab.MAX_FEATURES:
            out.append("feature count is out of bounds")
        if not re.match(vocab.RECORD_ID, self.id) or not re.match(vocab.VERSION, self.version):
            out.append("id or version is invalid")
        if names != sorted(set(names)):
            out.append("names must be unique and ordered")
        if len(set(paths)) != len(paths):
            out.append("source paths must be unique")
        for f in self.features:
            fine = re.match(FEATURE_PATH, f.source_path) and (f.source_path.startswith("event.") or f.source_path in vocab.FEATURE_META_PATHS)
            if not re.match(FEATURE_NAME, f.name) or f.type not in vocab.FEATURE_TYPES or f.null_policy not in ("required", "nullable") or not fine:
                out.append(f"feature {f.name} is invalid")
        return out

    def digest(self) -> str:
        if self.problems():
            raise ValueError("; ".join(self.problems()))
        body = {"contract_version": vocab.FEATURE_SET_CONTRACT, "id": self.id, "version": self.version, "envelope_schema_version": vocab.SCHEMA_VERSION,
                "features": [{k: v for k, v in f.__dict__.items() if v} for f in self.features]}
        return hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Split:
    seed: str
    train: int
    validation: int
    test: int

    def check(self) -> None:
        if not self.seed.strip() or len(self.seed) > 128 or re.search("[\r\n\0]", self.seed):
            raise ValueError("seed is invalid")
        if min(self.train, self.validation, self.test) < 0 or self.train + self.validation + self.test != 10_000:
            raise ValueError("basis points must be non-negative and sum to 10000")


def select_envelopes(envelopes: DataFrame, tenant: str, from_ns: int, to_ns: int, statuses: list[str], partial: str) -> DataFrame:
    """Half-open time selection; `reject` fails the job on a partial revision."""
    if from_ns >= to_ns or partial not in ("include", "exclude", "reject") or statuses != sorted(set(statuses)) or not statuses:
        raise ValueError("selection is invalid")
    at = F.col("receipt.received_at_ns")
    rows = envelopes.filter((F.col("receipt.tenant_id") == tenant) & (at >= from_ns) & (at < to_ns) & F.col("processing.status").isin(statuses))
    is_partial = F.col("processing.status") == "PARTIALLY_PARSED"
    if partial == "exclude":
        return rows.filter(~is_partial)
    if partial == "reject":
        stop = F.raise_error(F.concat(F.lit("partial revision rejected by dataset policy: "), F.col("processing.revision_id")))
        return rows.filter(F.when(is_partial, stop.cast("boolean")).otherwise(True))
    return rows


def _strict(value: Column, kind: Column, wanted: str, cast) -> Column:
    """The value as the wanted feature type, NULL when its own type is another one.

    `kind` is the value's type (of its column, or of the VARIANT); `cast` converts
    it. Only whole numbers pass as integers and only text as text: nothing is coerced.
    """
    whole = kind.isin("tinyint", "smallint", "int", "bigint")
    numeric = whole | kind.isin("float", "double") | kind.startswith("decimal")
    text = F.when(kind == "string", cast("string"))
    number = F.when(numeric, cast("double"))
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if wanted == "timestamp":
        return F.when(kind.startswith("timestamp"), rfc3339(cast("timestamp"))).otherwise(rfc3339(parse_rfc3339(text)))
    if wanted == "ip":
        return canonical_ip(text, unmap=False)
    if wanted == "integer":
        return F.when(whole, cast("bigint")).when(number == F.floor(number), cast("bigint"))
    if wanted == "number":
        return number
    if wanted == "boolean":
        return F.when(kind == "boolean", cast("boolean"))
    return text


def feature_column(feature: Feature) -> Column:
    """Typed feature value; a wrong type or a missing required value fails the job."""
    parts = feature.source_path.split(".")
    value = F.col(parts[0])
    if parts[:2] == ["event", "extensions"] and len(parts) > 2:
        value = F.try_variant_get(F.col("event.extensions"), "$." + ".".join(parts[2:]), "variant")
        value = F.when(~F.is_variant_null(value), value)
        out = _strict(value, F.lower(F.schema_of_variant(value)), feature.type, lambda to: F.try_variant_get(value, "$", to))
    else:
        for part in parts[1:]:
            value = value[part]
        out = _strict(value, F.typeof(value), feature.type, value.try_cast)

    def fail(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"feature {feature.name} {text} in revision "), F.col("processing.revision_id")))

    checked = F.when(value.isNotNull() & out.isNull(), fail(f"is not of type {feature.type}"))
    if feature.null_policy == "required":
        checked = checked.when(value.isNull(), fail("is missing"))
    return F.coalesce(checked.cast(_sql_type(feature.type)), out)


def _sql_type(kind: str) -> str:
    return {"integer": "bigint", "number": "double", "boolean": "boolean"}.get(kind, "string")


def features_json(features: FeatureSet) -> Column:
    """Feature object with sorted keys and explicit nulls."""
    body = F.struct(*[feature_column(f).alias(f.name) for f in sorted(features.features, key=lambda f: f.name)])
    return json_escape_html(F.to_json(body, {"ignoreNullFields": "false"}))


def assign_split(revision_id: Column, split: Split) -> Column:
    split.check()
    bucket = split_bucket(split.seed, revision_id)
    return F.when(bucket < split.train, "train").when(bucket < split.train + split.validation, "validation").otherwise("test")


def dataset_rows(selected: DataFrame, features: FeatureSet, split: Split) -> DataFrame:
    """The 15-column dataset with its lineage fields."""
    if features.problems():
        raise ValueError("; ".join(features.problems()))
    p = F.col("processing")
    return selected.select(
        F.col("receipt.id").alias("receipt_id"), p["revision_id"].alias("revision_id"), F.col("receipt.tenant_id").alias("tenant_id"),
        F.col("receipt.received_at_ns").alias("received_at_ns"), F.col("raw.sha256").alias("raw_sha256"), p["pipeline_version"].alias("pipeline_version"),
        F.coalesce(p["parser"]["id"], F.lit("")).alias("parser_id"), F.coalesce(p["parser"]["version"], F.lit("")).alias("parser_version"),
        p["mapping_version"].alias("mapping_version"), F.col("schema_version"), p["status"].alias("status"), F.col("quality.score").alias("quality_score"),
        F.transform(p["issues"], lambda i: i["code"]).alias("issue_codes"), assign_split(p["revision_id"], split).alias("split"),
        features_json(features).alias("features_json"),
    )


def duplicate_revisions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("revision_id").count().filter("count > 1")


def _children(nodes: DataFrame, level: int) -> DataFrame:
    """One node per prefix of `level` bytes: the digest of its children by their next byte; an only child stands for its parent."""
    below = F.array_sort(F.collect_list(F.struct(F.substring("prefix", 2 * level + 1, 2).alias("byte"), "digest", "depth", "ids")))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["byte"], F.lit("="), x["digest"], F.lit("\n"))), "")
    many, deepest = F.size("c") > 1, F.array_max(F.transform("c", lambda x: x["depth"]))
    return nodes.groupBy(F.substring("prefix", 1, 2 * level).alias("prefix")).agg(below.alias("c")).select(
        "prefix", F.when(many, F.sha2(text, 256)).otherwise(F.get("c", F.lit(0))["digest"]).alias("digest"),
        F.when(many, F.greatest(deepest, F.lit(level + 1))).otherwise(deepest).alias("depth"),
        F.aggregate("c", F.lit(0).cast("bigint"), lambda n, x: n + x["ids"]).alias("ids"))


def revision_digest(rows: DataFrame, width: int | None = None) -> DataFrame:
    """(revisions, depth, revision_digest) of a set of revision ids, whatever their order and number.

    The ids form a tree by the bytes of their own SHA-256: a leaf's digest is that
    hash, a node's that of its children, at most 256, and a node with one child
    stands for it. The tree follows from the set alone, so 1,000 and 10^11 ids are
    digested by one rule, no list grows with the data, and `width`, the level at
    which the work begins, does not change the result. Ids that still share
    `width` bytes, few of them, are told apart level by level.

    An id that occurs twice makes the digest null; an empty set has that of the
    empty text and depth 0.
    """
    # A narrow cut: hashes and counts, written once.
    ids = stored(rows.groupBy("revision_id").agg(F.count(F.lit(1)).alias("n")).select(F.sha2("revision_id", 256).alias("prefix"), "n"), "revision-ids")
    total, twice = ids.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)) > 1).first()
    spark = rows.sparkSession
    if not total or twice:
        return spark.range(1).select(
            F.lit(total).cast("bigint").alias("revisions"), F.lit(0).alias("depth"), F.when(F.lit(not twice), F.sha2(F.lit("").cast("binary"), 256)).alias("revision_digest"))
    level = width or min(HASH_BYTES, max(1, -(-(total - 1).bit_length() // 8) + 1))
    rest = ids.select("prefix", F.col("prefix").alias("digest"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("ids"))
    alone: dict[int, DataFrame] = {}
    while True:
        counted = stored(rest.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(F.substring("prefix", 1, 2 * level)))), "id-prefixes")
        alone[level] = counted.filter("same = 1").drop("same")
        rest = counted.filter("same > 1").drop("same")
        if level == HASH_BYTES or rest.isEmpty():
            break
        level += 1
    nodes = alone[level]
    for k in range(level - 1, -1, -1):
        nodes = _children(nodes, k)
        nodes = nodes.unionByName(alone[k]) if k in alone else nodes
    return nodes.select(F.col("ids").alias("revisions"), "depth", F.col("digest").alias("revision_digest"))


def identity_text(tenant: str, features: FeatureSet, selection: dict, revisions: object, digest: str, split: Split) -> str:
    body = {
        "contract_version": vocab.DATASET_CONTRACT, "tenant_id": tenant, "envelope_schema_version": vocab.SCHEMA_VERSION,
        "feature_set": {"id": features.id, "version": features.version, "sha256": features.digest()}, "selection": selection,
        "revisions": {"count": revisions, "sha256": digest},
        "split": {"algorithm": vocab.SPLIT_ALGORITHM, "seed": split.seed, "train_basis_points": split.train,
                  "validation_basis_points": split.validation, "test_basis_points": split.test},
        "lineage_fields": vocab.LINEAGE_FIELDS,
    }
    return json.dumps(body, separators=(",", ":"))


def dataset_identity(tenant: str, features: FeatureSet, selection: dict, revisions: int, digest: str, split: Split) -> str:
    """Stable id of the selected inputs; where the files lie is not part of it."""
    return hashlib.sha256(identity_text(tenant, features, selection, revisions, digest, split).encode()).hexdigest()


def sorted_dataset(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Global revision order in files of about `file_bytes` of text: ranges over the files, sorted inside each."""
    size = rows.agg(F.sum(F.octet_length("features_json") + ROW_BYTES)).first()[0] or 0
    return rows.repartitionByRange(max(1, -(-size // file_bytes)), "revision_id").sortWithinPartitions("revision_id")


def rows_fingerprint(rows: DataFrame) -> Row:
    """(rows, sum and xor of row hashes): equal for equal multisets of rows, whatever their order and files."""
    one, two = F.xxhash64(*rows.columns), F.xxhash64(F.lit("second"), *rows.columns)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"),
        F.coalesce(F.bit_xor(two), F.lit(0)).cast("string").alias("xor_hash")).first()


MANIFEST = "dataset_id string, tenant_id string, revision_sha256 string, digest_depth int, sum_hash string, xor_hash string, total_rows bigint, file string, rows bigint, size_bytes bigint, sha256 string"


def _describe(spark: SparkSession, base: str, folder: str) -> DataFrame:
    """(file, rows, size_bytes, sha256) of the files of a folder, read back as bytes and as rows."""
    name = F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.col("path"), "/"), -1)).alias("file")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{base}/{folder}")
    digests = raw.select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    counts = spark.read.parquet(f"{base}/{folder}").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return digests.join(counts.select(name, "rows"), "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def manifest_of(spark: SparkSession, root: str, tenant: str, dataset_id: str) -> DataFrame | None:
    """The manifest rows, one per file; None if the dataset is not published."""
    path = f"{root}/tenant={tenant}/dataset={dataset_id}/manifest"
    return spark.read.schema(MANIFEST).json(path) if commits.exists(spark, f"{path}/{commits.MARKER}") else None


def publish(rows: DataFrame, root: str, tenant: str, dataset_id: str, digest: Row, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write an immutable dataset and return its manifest.

    The files go below a folder of their own and are read back for their digests
    and rows; the manifest is written last and is the commit: readers see the files
    it names and no others. What a run without a manifest left is removed. A
    published id must hold the same rows, in files of the recorded bytes; else it is an error.
    `digest` is the row of `revision_digest`.
    """
    spark = rows.sparkSession
    base = f"{root}/tenant={tenant}/dataset={dataset_id}"
    print_ = rows_fingerprint(rows)
    known = manifest_of(spark, root, tenant, dataset_id)
    if known is None:
        for left in commits.folders(spark, base):
            commits.remove(spark, f"{base}/{left}")
        folder = f"run={uuid.uuid4().hex}"
        sorted_dataset(rows, file_bytes).write.mode("errorifexists").parquet(f"{base}/{folder}")
        back = rows_fingerprint(spark.read.schema(rows.schema).parquet(f"{base}/{folder}"))
        if back != print_:
            raise ValueError("the files do not hold the rows that were to be published")
        fixed = {"dataset_id": dataset_id, "tenant_id": tenant, "revision_sha256": digest["revision_digest"], "digest_depth": digest["depth"],
                 "sum_hash": print_["sum_hash"], "xor_hash": print_["xor_hash"], "total_rows": print_["rows"]}
        lines = _describe(spark, base, folder).select(*[F.lit(v).alias(k) for k, v in fixed.items()], "file", "rows", "size_bytes", "sha256")
        # One line a file: small even for a large dataset.
        lines.coalesce(1).sortWithinPartitions("file").write.mode("errorifexists").json(f"{base}/manifest")
        return manifest_of(spark, root, tenant, dataset_id)
    verify_published(spark, root, tenant, dataset_id)
    row = known.first()
    if (row["total_rows"], row["sum_hash"], row["xor_hash"]) != (print_["rows"], print_["sum_hash"], print_["xor_hash"]):
        raise ValueError("dataset id exists with different rows")
    return known


def verify_published(spark: SparkSession, root: str, tenant: str, dataset_id: str) -> None:
    """Files of a published dataset that are gone or have other bytes than recorded are an error."""
    base, known = f"{root}/tenant={tenant}/dataset={dataset_id}", manifest_of(spark, root, tenant, dataset_id)
    folders = [r[0] for r in known.select(F.substring_index("file", "/", 1)).distinct().collect()]  # one run wrote them all
    held = _describe(spark, base, folders[0]).select("file", F.col("sha256").alias("held"))
    if not known.join(held, "file", "left").filter(~F.col("sha256").eqNullSafe(F.col("held"))).isEmpty():
        raise ValueError("dataset files differ from their manifest")


def read_dataset(spark: SparkSession, root: str, tenant: str, dataset_id: str) -> DataFrame:
    """The rows of a published dataset: the files that its manifest names."""
    known = manifest_of(spark, root, tenant, dataset_id)
    if known is None:
        raise ValueError("the dataset is not published")
    return spark.read.parquet(*[f"{root}/tenant={tenant}/dataset={dataset_id}/{r[0]}" for r in known.select("file").collect()])


def split_balance(rows: DataFrame, split: Split) -> DataFrame:
    """Rows and share per split against the expected basis points."""
    expected = F.create_map(*[F.lit(x) for pair in (("train", split.train), ("validation", split.validation), ("test", split.test)) for x in pair])
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    # At most three rows: the total over them is a bounded window.
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return counts.select("split", "rows", F.try_element_at(expected, "split").alias("expected_bp"), F.round(F.col("rows") * 10000 / total).cast("bigint").alias("actual_bp"))


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Checks of manifest rows: (dataset_id, problem).

    `manifests`: dataset_id, tenant_id, received_from_ns, received_to_ns, statuses,
    partial_policy, revision_count, revision_sha256, seed, train, validation, test,
    artifact_format, artifact_path, artifact_sha256, artifact_rows.
    """
    def no(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    path = F.col("artifact_path")
    safe = (path != "") & (F.octet_length(path) <= 1024) & ~path.rlike(r"^/|\\|\x00|(?:^|/)\.{1,2}(?:/|$)|//|/$")
    checks = F.array(
        F.when(no(F.col("tenant_id").rlike(vocab.RECORD_ID)), "TENANT"),
        F.when(no(F.col("received_from_ns") <= F.col("received_to_ns")), "BOUNDS"),
        F.when(no((F.size("statuses") > 0) & (F.array_sort(F.array_distinct("statuses")) == F.col("statuses"))), "STATUSES"),
        F.when(no(F.col("partial_policy").isin("include", "exclude", "reject")), "PARTIAL_POLICY"),
        F.when(no((F.col("revision_count") >= 1) & F.col("revision_sha256").rlike(vocab.DIGEST)), "REVISIONS"),
        F.when(no((F.trim("seed") != "") & (F.octet_length("seed") <= 128)), "SEED"),
        F.when(no((F.least("train", "validation", "test") >= 0) & (F.col("train") + F.col("validation") + F.col("test") == 10_000)), "BASIS_POINTS"),
        F.when(no((F.col("artifact_format") == "parquet") & safe & F.col("artifact_sha256").rlike(vocab.DIGEST)), "ARTIFACT"),
        F.when(no(F.col("artifact_rows") == F.col("revision_count")), "ROW_COUNT"),
    )
    return manifests.select("dataset_id", F.explode(F.array_compact(checks)).alias("problem"))


def feature_violations(features: DataFrame) -> DataFrame:
    """Table form of the feature-set checks: set_id, position, name, type, source_path, null_policy."""
    by_set = Window.partitionBy("set_id").orderBy("position")
    ordered = features.withColumn("_prev", F.lag("name").over(by_set))
    path = F.col("source_path")
    allowed = path.rlike(FEATURE_PATH) & (path.startswith("event.") | path.isin(vocab.FEATURE_META_PATHS))
    checks = F.array(
        F.when(~F.col("name").rlike(FEATURE_NAME), "NAME"), F.when(~F.col("type").isin(vocab.FEATURE_TYPES), "TYPE"),
        F.when(~F.col("null_policy").isin("required", "nullable"), "NULL_POLICY"), F.when(~allowed, "SOURCE_PATH"),
        F.when(F.col("_prev") >= F.col("name"), "NOT_ORDERED"),
    )
    rows = ordered.select("set_id", "name", F.explode(F.array_compact(checks)).alias("problem"))
    twice = features.groupBy("set_id", "source_path").count().filter("count > 1").select("set_id", F.col("source_path").alias("name"), F.lit("DUPLICATE_PATH").alias("problem"))
    return rows.unionByName(twice)
