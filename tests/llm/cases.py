"""Small documents with nulls, empty and long texts, ties, repeats and clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, line_dedup string, shard int, row string, id string, key string"
LINE = "The same license line that quite a few documents carry."


def odd_rows() -> list[tuple]:
    texts = [
        None, "", " ", "\n\n", "one", "two words", "a b c d", f"{LINE}\nown line 5", f"  {LINE.upper()}\t\nx", f"{LINE}\n{LINE}", f"{LINE}\r\ny", f"{LINE}", f"{LINE}\nz",
        "word " * 20000, "é ü ñ ß " * 40, "x" * 30000, "tab\tand\x0bmore\x0cspace\r\nend", " odd  spaces   here\n \n", "token=abcdefgh secret: token: abcdefgh", None,
    ]
    rows = [(k, t, "en" if k % 3 else None, "s", len(t or ""), "q", "l", 1, "r", "i", "k") for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (7, "another text of an id", "fr", None, None, None, None, None, None, None, None), (None, f"{LINE}\nno id", None, None, None, None, None, None, None, None, None)]
    return rows


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def some_documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{DATA}/documents.parquet")
