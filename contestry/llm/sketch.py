"""Threshold-scaled sketches of documents.

A sketch keeps every shingle hash below a fixed fraction of the hash range. The same threshold holds for
all documents, so sketches of parts merge by union, and containment can be estimated between a short and
a very long document. A text whose hashes all lie above the threshold keeps its smallest one, so that no
text with words is without a sketch; such a sketch tells equal texts, but no containment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType

from contestry.llm.common import query, record, slices, table

SHINGLE, FRACTION = 5, 1 / 8
#: Rows of a range bucket, about; the buckets' bounds are broadcast, at most MAX_BUCKETS numbers.
BUCKET_ROWS, MAX_BUCKETS = 4000, 1 << 16
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketch(text: str, fraction: float = FRACTION) -> np.ndarray:
    """Ascending hashes of the kept shingles of lower-cased words; fewer than five words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(line)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes).tolist(), ends[SHINGLE - 1:].tolist())
    hashes = np.fromiter((digest(line[s:e]) for s, e in spans), np.uint64, len(words) - SHINGLE + 1)
    kept = hashes[hashes < np.uint64(int(fraction * (1 << 64)))]
    return np.unique(kept) if len(kept) else hashes.min(keepdims=True)


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two parts together: their union; a smallest hash above the threshold yields to real ones."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64(int(fraction * (1 << 64)))]
    return kept if len(kept) else both[:1]


def stands_in(a: np.ndarray, fraction: float = FRACTION) -> bool:
    """Whether a sketch is the smallest hash of a text that has none below the threshold."""
    return len(a) == 1 and int(a[0]) >= int(fraction * (1 << 64))


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float | None:
    """Share of the shingles of ``a`` that ``b`` has, estimated; without words: 1 in anything.

    None where ``a`` has no hash below the threshold and ``b`` differs, since then nothing is known of the share.
    """
    if stands_in(a, fraction) and not np.array_equal(a, b):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness; two texts without words are alike (1)."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str, np.ndarray] = ("", sketch(""))
    for batch in slices(batches, 500):
        rows = []
        for doc, text, after in zip(*(c.to_pylist() for c in batch.columns)):
            text, after = text or "", after or ""
            own = last[1] if last[0] == text else sketch(text)
            last = (after, sketch(after))
            half = len(text) // 2
            edited = text[:len(text) - half] + after[:half]
            changed = sketch(edited)
            rows.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, last[1])))
        yield record(SCHEMA, list(zip(*rows)) or [[]] * len(SCHEMA))


def _bucket(bounds: list[int]):
    @F.pandas_udf(IntegerType())
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64), side="left"), dtype="int32")

    return bucket


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): the text of the next row in descending id, after the last row the first.

    Ids are dealt into range buckets of about BUCKET_ROWS rows; the first row of a bucket is also sent to the
    end of the bucket before it, so every row finds its successor inside its own bucket and texts move once.
    Null ids come last; equal ids are ordered by text hash and text, so only equal rows are interchangeable.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("key", key)
    count = rows.count()
    buckets = min(MAX_BUCKETS, count // BUCKET_ROWS + 1)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(rows.agg(F.percentile_approx("key", shares, 10 * buckets)).first()[0] or [])) if shares else []
    dealt = rows.withColumn("bucket", _bucket(bounds)("key"))
    highs = sorted(map(tuple, dealt.groupBy("bucket").agg(F.max("key")).collect()))
    before = {high: highs[(i + 1) % len(highs)][0] for i, (_, high) in enumerate(highs)}
    first = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "first_key long, halo int").limit(len(before))
    # at most MAX_BUCKETS rows
    dealt = dealt.join(F.broadcast(first), F.col("key") == F.col("first_key"), "left")
    own, halo = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("halo")), F.struct(F.col("halo").alias("b"), F.lit(1).alias("halo"))
    sent = dealt.select("doc_id", "key", "text", F.explode(F.when(F.col("halo").isNull(), F.array(own)).otherwise(F.array(own, halo))).alias("to"))
    order = Window.partitionBy("to.b").orderBy("to.halo", F.desc("key"), F.xxhash64("text"), "text")
    return sent.withColumn("next_text", F.lead("text").over(order)).where("to.halo = 0").select("doc_id", "text", "next_text")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every document and of its edited text, and the likeness of sketches, a row per row of ``docs``.

    The edited text is the document's with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending id, after the last the first. Null texts count as empty; texts without
    words have an empty fingerprint. A single row is its own next; an empty table gives no rows. Of a text without a
    hash below the threshold only its smallest one is compared.
    """
    return with_next(docs, id_col, text_col).mapInArrow(_compared, DDL)


@query("op6_sketch")
def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
