"""Tables written version by version: readers see whole versions only.

A version is a folder of its own; it counts once its marker is written, which happens after all its files are there. A run that
fails leaves no marker, and is simply run again under the same name. A version that is there is never written twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions, in order; one small row for each."""
    try:
        marks = spark.read.schema("version string").json(f"{path}/commits/*")
    except AnalysisException:
        return []
    return sorted(r["version"] for r in marks.distinct().collect())


def write_version(df: DataFrame, path: str, version: str, fmt: str = "parquet", **options) -> bool:
    """Write `df` as a version and mark it; False if it was there already."""
    spark = df.sparkSession
    if version in committed(spark, path):
        return False
    df.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/versions/{version}")
    mark = spark.createDataFrame([(version,)], "version string").coalesce(1)
    mark.write.mode("overwrite").json(f"{path}/commits/{version}")
    return True


def read_versions(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", latest: bool = False) -> DataFrame:
    """Rows of all whole versions, or of the `latest` one; none if there is no version."""
    names = committed(spark, path)[-1 if latest else 0 :]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load([f"{path}/versions/{n}" for n in names])
