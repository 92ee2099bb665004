"""SimHash near-duplicate classes by pigeonhole blocks.

A pair of 64-bit fingerprints that differs in at most three bits agrees on at least three of six
blocks. Every distinct fingerprint is filed under its twenty triples of blocks (32 to 33 bits each),
and only fingerprints filed together are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from contestry.llm.common import components, fresh, query, spool, table

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a key that one task compares; a fuller key is cut in tiles, each pair of tiles is a task's work.
TILE = 2048


def _masks() -> list[int]:
    starts = np.cumsum((0, *BLOCKS))
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts)]
    masks = [sum(c) for c in combinations(blocks, len(BLOCKS) - MAX_BITS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``, repeats included; no word: 0."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes).tolist(), ends[SHINGLE - 1:].tolist())
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t.encode()) if isinstance(t, str) else 0 for t in texts], dtype="int64")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Tree edges that join distinct fingerprints wherever a chain of close pairs does."""
    left, edges = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= MAX_BITS
            if near.any():
                queue.extend(left[near])
                edges.extend((int(at), int(x)) for x in left[near])
                left = left[~near]
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = [e for members in batch.column(0) for e in forest(np.unique(members.values.to_numpy(zero_copy_only=False)))]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(values: DataFrame, column: str) -> DataFrame:
    """Edges (a, b) between values at most three bits apart, enough to connect whatever is connected.

    Not all pairs: every key yields a spanning forest of its members, so output stays linear in the
    members even where thousands of near copies share a key. No key is capped.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks())])
    keys = values.select(F.col(column).alias("f")).distinct().select("f", F.explode(entries).alias("e")).select("f", "e.t", "e.k")
    shared = keys.withColumn("n", F.count("*").over(Window.partitionBy("t", "k"))).where("n > 1")
    cold = shared.where(F.col("n") <= TILE).groupBy("t", "k").agg(F.collect_list("f").alias("members")).select("members")
    tiles = F.ceil(F.col("n") / TILE)
    hot = shared.where(F.col("n") > TILE).withColumn("p", F.pmod(F.xxhash64("f"), tiles))
    hot = hot.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    hot = hot.select("f", "t", "k", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).repartition("t", "k", "p", "q")
    hot = hot.groupBy("t", "k", "p", "q").agg(F.collect_list("f").alias("members")).select("members")
    return cold.union(hot).mapInArrow(_forests, "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; null text counts as empty and gets fingerprint 0."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), _fingerprints(f"`{text_col}`").alias("fp"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id), one row per row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included; null where no row of
    the class has an id. Repeated rows, equal ids and null ids stay separate rows. Empty texts share
    fingerprint 0 and are linked like any other. Only fixed-size columns are shuffled, never texts.
    """
    narrow = spool(fingerprints(docs, id_col, text_col), "simhash")
    nodes = narrow.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = components(links(nodes, "fp"), "a", "b").withColumnRenamed("node", "fp")
    nodes = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    roots = nodes.groupBy("label").agg(F.min("low").alias("component_id"))
    return narrow.join(nodes.join(roots, "label").select("fp", "label", "component_id"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each class stays.

    The row with the smallest id stays (null ids last, then the smallest text hash; of equal rows any).
    All columns of ``docs`` are returned, whatever their names.
    """
    found = classes(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    ki, kh, ri, rh = fresh(docs, "_keep_i", "_keep_h", "_row_i", "_row_h")
    kept = found.groupBy("label").agg(F.min(order).alias("r")).select(F.col("r.i").alias(ki), F.col("r.h").alias(kh))
    rows = docs.withColumns({ri: F.col(f"`{id_col}`"), rh: F.xxhash64(f"`{text_col}`")})
    rows = rows.join(kept, F.col(ri).eqNullSafe(F.col(ki)) & (F.col(rh) == F.col(kh)), "left_semi")
    return rows.dropDuplicates([ri, rh]).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
