"""Helpers the training-data operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlog.session import shared_dir

#: White space of the operators: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: a cut that outlives its executors."""
    path = shared_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once_per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What `make` gives, made once in a Python worker and used by all of its tasks.

    Functions travel by value, so their globals are new in each task; the module table is the process's own.
    """
    held = sys.modules.setdefault("_siftlog_llm_held", ModuleType("_siftlog_llm_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str | Column) -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; null counts as the empty text."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary")) % modulus
