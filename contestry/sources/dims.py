"""Curated dimension files and result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_csv_dim(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A curated CSV with a header; every value is text, the consumer casts."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)


POINTER = "CURRENT"


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a result: a new version is written beside the old one, then a pointer to it is renamed into place.

    A failing write leaves the old result as it was. ``read_result`` follows the pointer; older versions stay
    until ``drop_old_results`` is called, so readers that have begun with one can finish.
    """
    version = f"version-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{path}/{version}")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target, draft = fs.Path(f"{path}/{POINTER}"), fs.Path(f"{path}/{POINTER}-{version}")
    out = draft.getFileSystem(conf).create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    replace = df.sparkSession.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    replace[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, replace)


def _current(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def read_result(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(f"{path}/{_current(spark, path)}")


def drop_old_results(spark: SparkSession, path: str) -> None:
    """Delete the versions that the pointer does not name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    current = _current(spark, path)
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("version-") and name != current:
            files.delete(entry.getPath(), True)
