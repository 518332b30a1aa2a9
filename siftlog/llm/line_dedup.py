"""Line dedup: drop long lines that many documents share.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; lines over the threshold go, and the rest is reassembled by position.

Only (hash, doc_id, position) rows of long lines are written and shuffled, for the counts and the lookup.
The count is a two-level distinct aggregate, so a line held by a third of all
documents is combined before each shuffle. The lookup reads the frequent
hashes from a written table, which leaves both join sides plain exchanges that
adaptive execution splits when one hash is hot.

Defined results: null or empty text is one empty line. Lines of rows with a
null id count for no document and stay. Rows that repeat an id are one
document; each keeps its own lines. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlog.llm.common import SPACES, lowered, stored, whole_text


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, result: str = "line_dedup") -> DataFrame:
    """`docs` with shared lines removed from `text_col`, plus a struct column `result` (n_lines, n_dropped).

    A key of at least `min_chars` code points in at least `min_docs` documents
    stays only in the largest id holding it. A column of that name in the input is replaced.
    """
    base = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col(id_col).alias("id"),
        whole_text(text_col).alias("txt"),
    ).withColumn("version", F.xxhash64("txt"))
    # the length is tested before lower-casing, which does not change it; the rows are written once for count and lookup
    lines = stored(
        base.select("id", "version", F.posexplode(F.split("txt", "\n", -1)).alias("pos", "line"))
        .withColumn("trimmed", F.btrim("line", F.lit(SPACES)))
        .filter((F.char_length("trimmed") >= min_chars) & F.col("id").isNotNull())
        .withColumn("key", lowered(F.col("trimmed")))
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2")),
        "long-lines",
    )
    frequent = stored(
        lines.groupBy("h1", "h2")
        .agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper"),
        "frequent-lines",
    )
    gone = (
        lines.join(frequent, ["h1", "h2"])
        .filter(F.col("id") != F.col("keeper"))
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("gone"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    out = (
        base.join(gone, ["id", "version"], "left")
        .withColumn("parts", F.split("txt", "\n", -1))
        .withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
        .withColumn(
            "kept",
            F.when(F.col("gone").isNull(), F.col("txt")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("parts", i + 1)), "\n")),
        )
    )
    columns = [F.col("kept").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != result]
    return out.select(*columns, F.struct(F.size("parts").cast("long").alias("n_lines"), "n_dropped").alias(result))
