"""Sharding by a weighted hash tree: region, then rack, then shard.

At every level each child draws -ln(u) / weight with u from a hash of (doc_id, child), and the smallest
draw wins: children are chosen in proportion to their weights, and a changed weight moves rows only into
or out of that child. Movement so stays inside the subtrees on the path to a changed leaf. A further
shard joins as a rack and region of its own, so it takes rows only into itself; folding it into a full
region later is a change of weights of those two subtrees. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from contestry.llm.common import query, spool, table

#: (shard, region, rack, weight)
Tree = list[tuple[int, int, int, float]]
SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 24, 2, 4


def regular_tree(shards: int = SHARDS, racks: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK) -> Tree:
    """Equal shards in full racks and regions."""
    return [(s, s // (racks * per_rack), s // per_rack, 1.0) for s in range(shards)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` and one more shard, in a region of its own."""
    return [*tree, tuple(max(leaf[i] for leaf in tree) + 1 for i in range(3)) + (weight,)]


def _pick(key: Column, level: int, weights: dict[int, float]) -> Column:
    """The child of ``weights`` with the smallest weighted draw; ties go to the smallest number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    unit = lambda child: (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    draws = [F.struct((-F.log(unit(c)) / F.lit(w)).alias("draw"), F.lit(c).alias("child")) for c, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["child"]


def _inside(parent: Column, key: Column, level: int, children: dict[int, dict[int, float]]) -> Column:
    found = None
    for p, weights in sorted(children.items()):
        choice = _pick(key, level, weights)
        found = F.when(parent == p, choice) if found is None else found.when(parent == p, choice)
    return found


def assign(rows: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """``rows`` with the shard of ``key`` in ``out``; the key and the tree alone decide. Null keys share a shard."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for shard, region, rack, weight in tree:
        if weight > 0:
            regions[region] = regions.get(region, 0.0) + weight
            racks.setdefault(region, {})[rack] = racks.get(region, {}).get(rack, 0.0) + weight
            shards.setdefault(rack, {})[shard] = weight
    region, rack = f"{out}_region", f"{out}_rack"
    at = rows.withColumn(region, _pick(F.col(key), 1, regions))
    at = at.withColumn(rack, _inside(F.col(region), F.col(key), 2, racks))
    return at.withColumn(out, _inside(F.col(rack), F.col(key), 3, shards)).drop(region, rack)


def shard(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), a row per row of ``docs``.

    size is the text's UTF-8 bytes plus 8; null text has 0 bytes and the crc32 of nothing. Slots are
    gapless from 0 within a shard. They follow the reading tasks, not the key, so that neither a hot shard
    nor repeated ids put many rows in one task: every (shard, reading task) is numbered on its own from an
    offset. Texts are read once; only the written narrow rows are shuffled.
    """
    tree = tree or regular_tree()
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = spool(assign(assign(rows, "doc_id", tree, "shard"), "doc_id", grown(tree), "grown_shard"), "shards")
    # one row per shard and reading task
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")))
    placed = numbered.join(counts.select("shard", "part", before.alias("before")), ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("k") - 1).alias("slot"), "grown_shard")


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))
