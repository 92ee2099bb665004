"""Tables that streams maintain: buckets rewritten where touched, and a ledger that commits a batch with one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Ledger:
    """A small JSON document in the shared folder: what each committed batch made current.

    A batch writes its files first, beside the old ones, then replaces the document by one rename. A batch that
    failed before that is computed again from the old document; one that was committed is not applied twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def read(self) -> dict:
        file = self.fs.Path(f"{self.path}/LEDGER")
        if not file.getFileSystem(self.conf).exists(file):
            return {"batch": -1}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(file.toString()).collect()))

    def commit(self, batch: int, **entries) -> dict:
        doc = self.read() | entries | {"batch": batch}
        target, draft = self.fs.Path(f"{self.path}/LEDGER"), self.fs.Path(f"{self.path}/_draft-{uuid.uuid4().hex}")
        out = draft.getFileSystem(self.conf).create(draft)
        out.write(bytearray(json.dumps(doc, indent=0).encode()))
        out.close()
        replace = self.spark.sparkContext._gateway.new_array(self.fs.Options.Rename, 1)
        replace[0] = self.fs.Options.Rename.OVERWRITE
        self.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, replace)
        return doc


class BucketTable:
    """One row per key, in ``buckets`` folders by key hash. A version is a mapping of bucket to folder.

    ``stage`` reads and rewrites only the buckets that hold a key of the new rows; the others keep their folders. The
    mapping becomes current when a ledger commits it. Choose ``buckets`` so that one fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)))

    def touched(self, rows: DataFrame) -> list[str]:
        """Buckets of the keys of ``rows``: at most ``buckets`` values reach the driver."""
        return sorted(str(r[0]) for r in self._bucketed(rows.select(*self.keys)).select(BUCKET).distinct().collect())

    def read(self, files: dict[str, str], only: list[str] | None = None) -> DataFrame:
        paths = [f"{folder}/{BUCKET}={b}" for b, folder in files.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def stage(self, files: dict[str, str], rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> dict[str, str]:
        """The mapping after ``rows``; ``merge`` turns old and new rows of the touched buckets into one row per key."""
        names, only = self.schema.fieldNames(), self.touched(rows)
        if not only:
            return files
        folder = self._write(merge(self.read(files, only).unionByName(rows.select(*names))))
        return {b: f for b, f in files.items() if b not in only} | dict.fromkeys(only, folder)

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        self._bucketed(rows.select(*self.schema.fieldNames())).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return folder

    def merged(self, mappings: list[dict[str, str]], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """One row per key of several mappings."""
        first, *others = [self.read(files) for files in mappings] or [self.read({})]
        return merge(reduce(DataFrame.unionByName, others, first)).select(*self.schema.fieldNames()) if others else first

    def combine(self, mappings: list[dict[str, str]], merge: Callable[[DataFrame], DataFrame]) -> dict[str, str]:
        """One mapping in place of several."""
        return dict.fromkeys(sorted(set().union(*mappings)), self._write(self.merged(mappings, merge)))

    def vacuum(self, *kept: dict[str, str]) -> None:
        """Delete the folders of buckets that none of the ``kept`` mappings names."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        named = {(folder.rsplit("/", 1)[1], b) for mapping in kept for b, folder in mapping.items()}
        folders = {name for name, _ in named}
        for version in files.listStatus(root) if files.exists(root) else []:
            name = version.getPath().getName()
            if name not in folders:
                files.delete(version.getPath(), True)
                continue
            for bucket in files.listStatus(version.getPath()):
                part = bucket.getPath().getName()
                if part.startswith(f"{BUCKET}=") and (name, part.split("=")[1]) not in named:
                    files.delete(bucket.getPath(), True)
