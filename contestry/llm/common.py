"""What the training-data operators share: reading, spooling, Arrow rows, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from contestry.session import materialize, run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Java and RE2 pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, survives lost executors."""
    return materialize(df, run_dir(df.sparkSession, label))


def dropped(*tables: DataFrame) -> None:
    """Delete the files of spooled ``tables`` that no later job reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, with underscores in front until no column of ``df`` has such a name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return tuple(out)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node of its connected component.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each round is joins and
    aggregations by node and ends in a written table, so lineage stays short; the number of rounds
    grows with the logarithm of the longest chain. Empty edges give an empty result.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    stars = spool(start, "stars")
    before = None
    for _ in range(max_rounds):
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())
        if now == before or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(stars.select("v", "v").distinct())
        before = now
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = spool(small.union(least.select("u", "m")).distinct(), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
