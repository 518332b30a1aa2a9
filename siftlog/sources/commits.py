"""Tables of runs: each run writes a folder of its own, and Spark's success marker is its commit.

A run that died has no marker: readers do not see it, and the same run writes its
folder anew. Nothing else is ever deleted or changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from siftlog.session import shared_dir

MARKER = "_SUCCESS"
#: For writes of very many small files: tasks move their own files in place, where the driver would move all of them one by one.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
_TYPES = {"string": StringType, "bigint": LongType, "int": IntegerType, "double": DoubleType, "boolean": BooleanType}


def columns(text: str) -> StructType:
    """Schema of `name type` pairs; unlike a DDL string it needs no session."""
    out = StructType()
    for pair in text.split(","):
        name, kind = pair.split()
        out.add(name, _TYPES[kind]())
    return out


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _hadoop(spark, path)
    return system.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it is absent."""
    place, system = _hadoop(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files in a folder, sorted."""
    place, system = _hadoop(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isFile() and s.getPath().getName()[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    place, system = _hadoop(spark, path)
    system.delete(place, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a marker."""
    place, system = _hadoop(spark, path)
    system.create(place, True).close()


def is_committed(spark: SparkSession, table: str, run: str) -> bool:
    return exists(spark, f"{table}/run={run}/{MARKER}")


def write_run(rows: DataFrame, table: str, run: str) -> None:
    """Write a run's folder; what an earlier attempt of the same run left there is replaced."""
    rows.write.mode("overwrite").parquet(f"{table}/run={run}")


def read_runs(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The rows of all committed runs."""
    paths = [f"{table}/{name}" for name in folders(spark, table) if name.startswith("run=") and exists(spark, f"{table}/{name}/{MARKER}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write a cut point below the shared folder and read it back."""
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
