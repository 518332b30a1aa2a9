"""Bundle files as tables: strict rule, vocabulary and fingerprint scans.

A file is one JSON value. Its keys are listed level by level by exploding the
VARIANT laterally, so a key that nobody reads cannot hide in a schema that leaves
it out. Files are rows: many bundles are checked in one job, and what is wrong
with a file is a row that says where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: the keys of each kind of file, at the top and in each element of its list
TOP_KEYS = {
    "mapping": ["config_version", "id", "version", "rules", "taxonomies"],
    "taxonomies": ["config_version", "taxonomies"],
    "parser": ["config_version", "id", "version", "format"],
    "fingerprints": ["config_version", "fingerprints"],
}
ELEMENTS = {
    "mapping": ("rules", ["id", "from", "to", "convert", "lookup", "required", "timestamp_layouts", "timezone"]),
    "fingerprints": ("fingerprints", ["parser_id", "required_literals", "score", "specificity"]),
}
_RULE = (
    "struct<id: string, `from`: string, `to`: string, convert: string, lookup: string, required: boolean, timestamp_layouts: array<string>, timezone: string>")


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, kind, body) of whole files, one JSON value each."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.lit(kind).alias("kind"), F.col("value").alias("body"))


def _members(rows: DataFrame, value: Column) -> DataFrame:
    """Every (key, member) of an object or (pos, member) of an array, beside the row's own columns."""
    tvf = rows.sparkSession.tvf
    return rows.lateralJoin(tvf.variant_explode(value.outer()))


def documents(files: DataFrame) -> DataFrame:
    """Files with `doc`, their VARIANT; null for text that is not one JSON value."""
    return files.withColumn("doc", F.try_parse_json("body"))


def _among(keys: dict[str, list[str]]) -> Column:
    """Whether `key` is known for the row's kind."""
    known = F.lit(False)
    for kind, names in keys.items():
        known = known | ((F.col("kind") == kind) & F.col("key").isin(names))
    return known


def config_violations(files: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(file, place, problem, key) of files (file, kind, body); `versions` names the config_version of each kind.

    NOT_JSON, NOT_AN_OBJECT, CONFIG_VERSION, UNKNOWN_KEY (at the top, or in an element with its position),
    NOT_A_LIST (what should hold the elements) and REPEATED_ALIAS (two meanings in one vocabulary).
    """
    docs = documents(files)
    is_object = F.schema_of_variant("doc").startswith("OBJECT")
    version = F.lit(None).cast("string")
    for kind, wanted in versions.items():
        version = F.when(F.col("kind") == kind, wanted).otherwise(version)
    whole = F.when(F.col("doc").isNull(), "NOT_JSON").when(~is_object, "NOT_AN_OBJECT").when(
        ~F.try_variant_get("doc", "$.config_version", "string").eqNullSafe(version), "CONFIG_VERSION")
    none = F.lit(None).cast("string")
    top = F.lit("$")
    out = docs.select("file", top.alias("place"), whole.alias("problem"), none.alias("key"))
    objects = docs.filter(is_object).select("file", "kind", "doc")
    keys = _members(objects, F.col("doc"))
    out = out.unionByName(keys.filter(~_among(TOP_KEYS)).select("file", top.alias("place"), F.lit("UNKNOWN_KEY").alias("problem"), "key"))
    for kind, (name, known) in ELEMENTS.items():
        holder = F.try_variant_get("doc", f"$.{name}", "variant")
        lists = objects.filter(F.col("kind") == kind).select("file", "kind", holder.alias("held"))
        is_list = F.coalesce(F.schema_of_variant("held").startswith("ARRAY"), F.lit(False))
        out = out.unionByName(lists.filter(~is_list).select("file", F.lit(f"$.{name}").alias("place"), F.lit("NOT_A_LIST").alias("problem"), none.alias("key")))
        elements = _members(lists.filter(is_list), F.col("held")).select("file", "kind", F.col("pos").alias("at"), F.col("value").alias("element"))
        inner = _members(elements, F.col("element"))
        place = F.concat(F.lit(f"$.{name}["), F.col("at").cast("string"), F.lit("]"))
        out = out.unionByName(inner.filter(~_among({kind: known})).select("file", place.alias("place"), F.lit("UNKNOWN_KEY").alias("problem"), "key"))
    twice = alias_rows(files).groupBy("file", "taxonomy", "alias").agg(F.count_distinct("canonical").alias("n")).filter("n > 1")
    out = out.unionByName(twice.select("file", F.concat(F.lit("$.taxonomies."), "taxonomy").alias("place"), F.lit("REPEATED_ALIAS").alias("problem"), F.col("alias").alias("key")))
    return out.filter(F.col("problem").isNotNull())


def alias_rows(files: DataFrame) -> DataFrame:
    """(file, taxonomy, alias, canonical) of mapping and vocabulary files; a canonical value names itself."""
    held = documents(files).filter(F.col("kind").isin("mapping", "taxonomies")).select("file", F.try_variant_get("doc", "$.taxonomies", "variant").alias("held"))
    names = _members(held, F.col("held")).select("file", F.col("key").alias("taxonomy"), F.col("value").alias("entries"))
    entries = _members(names, F.col("entries")).select("file", "taxonomy", F.col("key").alias("canonical"), F.try_variant_get("value", "$", "array<string>").alias("aliases"))
    every = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entries.select("file", "taxonomy", F.explode(every).alias("alias"), "canonical").distinct()


def rule_rows(files: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Rules of the mapping files that have no violation, in rule order."""
    bad = config_violations(files, versions).select("file").distinct()
    good = documents(files).filter(F.col("kind") == "mapping").join(bad, "file", "left_anti")
    head = good.select(
        "file", F.try_variant_get("doc", "$.id", "string").alias("mapping_id"), F.try_variant_get("doc", "$.version", "string").alias("mapping_version"),
        F.try_variant_get("doc", "$.rules", "variant").alias("held"))
    rule = F.try_variant_get("value", "$", _RULE)
    return _members(head, F.col("held")).withColumn("r", rule).select(
        "file", "mapping_id", "mapping_version", F.col("pos").alias("rule_ord"), F.col("r.id").alias("rule_id"), F.col("r.from").alias("source"), F.col("r.to").alias("target"),
        F.col("r.convert").alias("convert"), F.coalesce("r.lookup", F.lit("")).alias("lookup"), F.coalesce("r.required", F.lit(False)).alias("required"))
