"""Paths into VARIANT documents: resolution and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlog.functions.text import count_char


def key_path(segment: str) -> str:
    return f"$['{segment}']"


def is_type(value: Column, name: str) -> Column:
    return F.schema_of_variant(value) == name


def text_of(value: Column) -> Column:
    """Text of a string or of UTF-8 bytes; NULL for every other type."""
    kind = F.schema_of_variant(value)
    data = F.try_variant_get(value, "$", "binary").cast("string")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        (kind == "BINARY") & F.is_valid_utf8(data), data
    )


def integer_of(value: Column) -> Column:
    """Strict base-10 BIGINT of an integer or of digits in a string."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(
        (kind == "STRING") & text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")
    )


def _element_names(element: Column) -> Column:
    """Texts an array element can be chosen by: its string id, name and key."""
    def own(name: str) -> Column:
        return F.when(
            is_type(F.try_variant_get(element, f"$.{name}", "variant"), "STRING"), F.try_variant_get(element, f"$.{name}", "string"))

    return F.array_compact(F.array(own("id"), own("name"), own("key")))


def resolve_paths(
    df: DataFrame, document: str, paths: list[list[str]], selectors: bool, selectable: set[tuple] | None = None,
    gates: dict[str, Column] | None = None,
) -> tuple[DataFrame, dict]:
    """Add one column set per path that leads to others, level by level.

    Returns the frame and {path tuple: (value, concrete path, ambiguous)}. Shared
    prefixes are read once, and no expression repeats its parent. Paths that lead to
    no other are expressions over their parent's columns, for the caller to place: as
    columns, most of them NULL, they would be copied from projection to projection.
    `selectors` allows array elements to be chosen by their id, name or key, for all prefixes
    or only for the `selectable` ones. `gates` tells by first segment on which rows
    a path is wanted at all; on others nothing is looked for below it.
    """
    known: dict[tuple, tuple[Column, Column, Column]] = {}
    tags: dict[tuple, str] = {}
    prefixes = {tuple(p[:n]) for p in paths for n in range(1, len(p) + 1)}
    inner = {p[:-1] for p in prefixes}
    chosen = selectable if selectable is not None else prefixes
    for level in range(1, max((len(p) for p in prefixes), default=0) + 1):
        here = sorted(p for p in prefixes if len(p) == level)
        by_name = {p for p in here if level > 1 and selectors and p in chosen and not p[-1].isdigit()}
        # Elements and their names are read once per parent, not once per child.
        items, names, flat, back = {}, {}, {}, {}
        for parent in sorted({p[:-1] for p in by_name}):
            tag = tags[parent]
            items[f"{tag}_n"] = F.try_variant_get(F.col(f"{tag}v"), "$", "array<variant>")
            names[f"{tag}_k"] = F.transform(F.col(f"{tag}_n"), _element_names)
            # Where every element bears one name, several are looked up in one list, without a lambda.
            if sum(p[:-1] == parent for p in by_name) > 1:
                flat[f"{tag}_o"] = F.when(F.forall(f"{tag}_k", lambda k: F.size(k) == 1), F.flatten(f"{tag}_k"))
                back[f"{tag}_r"] = F.reverse(f"{tag}_o")
        for step in (items, names, flat, back):
            df = df.withColumns(step) if step else df
        columns = {}
        for prefix in here:
            segment = prefix[-1]
            if level == 1:
                parent, path, ambiguous = F.col(document), F.lit("fields"), F.lit(False)
            else:
                parent, path, ambiguous = known[prefix[:-1]]
            value = F.try_variant_get(parent, key_path(segment), "variant")
            if level == 1 and gates is not None:
                value = F.when(gates[segment], value)
            where = F.concat(path, F.lit("." + segment))
            # The root is always an object, so arrays can only appear below it.
            if level > 1 and segment.isdigit():
                value = F.coalesce(value, F.try_variant_get(parent, f"$[{int(segment)}]", "variant"))
                where = F.concat(path, F.lit(f".{int(segment)}"))
            elif prefix in by_name:
                value, where, ambiguous = _choose(tags[prefix[:-1]], segment, f"{tags[prefix[:-1]]}_o" in flat, value, where, path, ambiguous)
            known[prefix] = value, where, ambiguous
            if prefix in inner:
                tag = tags[prefix] = f"_v{level}_{len(known)}"
                columns |= {f"{tag}v": value, f"{tag}p": where, f"{tag}a": ambiguous}
                known[prefix] = F.col(f"{tag}v"), F.col(f"{tag}p"), F.col(f"{tag}a")
        df = df.withColumns(columns) if columns else df
    return df, known


def _choose(up: str, segment: str, listed: bool, value: Column, where: Column, path: Column, ambiguous: Column) -> tuple[Column, Column, Column]:
    """Member of an object, or the one element that bears the name; `listed` names are also held in one list."""
    is_array = F.col(f"{up}_n").isNotNull()
    hits = F.transform(F.col(f"{up}_k"), lambda k: F.array_contains(k, segment))
    place, many = F.array_position(hits, True), F.size(F.filter(hits, lambda h: h)) > 1
    if listed:
        one = F.col(f"{up}_o")
        first = F.array_position(one, segment)
        place = F.when(one.isNotNull(), first).otherwise(place)
        # The first and the last element of that name are the same if there is one.
        several = (first > 0) & (first + F.array_position(F.col(f"{up}_r"), segment) != F.size(one) + 1)
        many = F.when(one.isNotNull(), several).otherwise(many)
    at = (place - 1).cast("int")
    element = F.when(~many & (at >= 0), F.get(F.col(f"{up}_n"), at))
    return (
        F.when(is_array, element).otherwise(value),
        F.when(is_array, F.concat(path, F.lit("."), at.cast("string"))).otherwise(where),
        ambiguous | F.coalesce(is_array & many, F.lit(False)),
    )


def _expand(entry: Column) -> Column:
    value, path = entry["v"], entry["p"]
    members = F.try_variant_get(value, "$", "map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>")

    def row(p: Column, v: Column, leaf: bool) -> Column:
        return F.struct(p.alias("p"), v.alias("v"), F.lit(leaf).alias("leaf"))

    return (
        F.when(entry["leaf"], F.array(entry))
        .when(F.size(members) > 0, F.transform(F.map_entries(members), lambda kv: row(F.concat(path, F.lit("."), kv["key"]), kv["value"], False)))
        .when(F.size(items) > 0, F.transform(items, lambda x, i: row(F.concat(path, F.lit("."), i.cast("string")), x, False)))
        .otherwise(F.array(row(path, value, True)))
    )


def flatten_document(document: Column, root: str = "fields") -> Column:
    """ARRAY<STRUCT(p, v, leaf)> of every leaf with its path, inside the row, at any depth.

    Levels are expanded by an array fold, so there is no explode, no shuffle and
    no Python. Most documents are done after a few levels. Others go on for as many
    levels as their text has opening brackets, which no nesting can exceed; once all
    entries are leaves a level costs nothing.
    """
    start = F.array(F.struct(F.lit(root).alias("p"), document.alias("v"), F.lit(False).alias("leaf")))

    def expanded(entries: Column) -> Column:
        return F.flatten(F.transform(entries, _expand))

    def done(entries: Column) -> Column:
        return F.forall(entries, lambda e: e["leaf"])

    def level(entries: Column, _i: Column) -> Column:
        return F.when(done(entries), entries).otherwise(expanded(entries))

    def deeper(state: Column, _i: Column) -> Column:
        return F.when(state["done"], state).otherwise(F.struct(done(state["entries"]).alias("done"), expanded(state["entries"]).alias("entries")))

    early = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, level)
    # A leaf expands to itself, so the step that finds all of them done changes nothing.
    late = F.aggregate(F.sequence(F.lit(0), count_char(F.to_json(document), "{[")), F.struct(F.lit(False).alias("done"), early.alias("entries")), deeper)["entries"]
    return F.filter(F.when(done(early), early).otherwise(late), lambda e: e["leaf"])


def document_rows(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys..., path, value): one row per leaf of every document."""
    leaves = df.select(*keys, F.explode_outer(flatten_document(F.col(document))).alias("_l"))
    return leaves.filter("_l IS NOT NULL").select(*keys, F.col("_l.p").alias("path"), F.col("_l.v").alias("value"))
