"""The trie of conversation prefixes, built by union-find over the LCP edges of sorted neighbours.

Conversations are sorted by their sequences of turns. Every partition of the order joins neighbours in descending
depth of their common prefix: where components merge, a branching node arises. Nodes inside a partition are
finished there. A partition's forest is contracted to its two outer spines, the prefixes of its first and last
conversation, which may go on in other partitions; spines of equal prefix are merged by sums. What a subtree adds
up to is a difference of running sums over the order, so merging needs no walk over the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from contestry.llm.common import dropped, query, spool, table

#: Hexadecimal digits of a turn in a path.
TURN = 32
#: Rows of merged spines up to which they are broadcast; they number partitions times depth of the outer prefixes.
SPINES = 200_000
LONGS = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "total", "distinct", "below")
FIELDS = [("kind", pa.string()), ("pid", pa.int64()), ("node", pa.string()), ("parent", pa.string()), *[(c, pa.int64()) for c in LONGS],
          ("left", pa.bool_()), ("right", pa.bool_()), ("ends", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("sizes", pa.list_(pa.int64()))]
DDL = "kind string, pid long, node string, parent string, " + ", ".join(f"{c} long" for c in LONGS) + ", left boolean, right boolean, ends array<long>, first string, last string, sizes array<long>"


@dataclass
class Branch:
    """A node where components merge, or where a conversation ends; the depths down to ``up`` + 1 have the same members."""

    depth: int
    lo: int
    hi: int
    low: int
    ends: int = 0
    inner: int = 0
    children: int = 0
    up: int = -1
    parent: int = -1


def common(a: str, b: str) -> int:
    """Turns that two paths share at their front."""
    lo, hi = 0, min(len(a), len(b)) // TURN
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid * TURN]) else (lo, mid - 1)
    return lo


def merged(paths: list[str], ids: list[int], shared: list[int]) -> list[Branch]:
    """Branches of sorted ``paths``; ``shared[i]`` is the common depth of paths i and i + 1."""
    n = len(paths)
    branches = [Branch(len(p) // TURN, i, i, c, ends=1) for i, (p, c) in enumerate(zip(paths, ids))]
    root, top = list(range(n)), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for e in sorted(range(n - 1), key=lambda e: -shared[e]):
        depth, a, b = shared[e], find(e), find(e + 1)
        x, y = branches[top[a]], branches[top[b]]
        if x.depth == depth:
            at = top[a]
        else:  # the left component is deeper: a node arises
            at = len(branches)
            branches.append(Branch(depth, x.lo, x.hi, x.low))
        node = branches[at]
        for part in (x, y):
            if part is node:
                continue
            if part.depth == depth:  # the same node: conversations that end here
                node.ends += part.ends
                node.children, node.inner = node.children + part.children, node.inner + part.inner
                part.up = depth
            else:
                part.up, part.parent = depth, at
                node.children += 1
                node.inner += part.lo > 0 and part.hi < n - 1
        node.hi, node.low = y.hi, min(node.low, y.low)
        root[b] = a
        top[a] = at
    return branches


def _name(path: str, depth: int) -> str:
    return hashlib.md5(path[:depth * TURN].encode()).hexdigest()


def _rows(pid: int, paths: list[str], ids: list[int], sizes: list[list[int]]) -> Iterator[tuple]:
    n = len(paths)
    shared = [common(a, b) for a, b in zip(paths, paths[1:])]
    branches = merged(paths, ids, shared)
    names: dict[tuple[int, int], str] = {}
    upto = [[0, *accumulate(s)] for s in sizes]  # bytes of the first d turns
    total = [0, *accumulate(u[-1] for u in upto)]
    fresh = [0, *accumulate(u[-1] - u[k] for u, k in zip(upto, [0, *shared]))]
    leaves = [0, *accumulate([int(len(p) // TURN > k) for p, k in zip(paths, shared)]), 0]
    leaves[n] = leaves[n - 1]  # the last one's place is known only beside the next partition

    def name(lo: int, depth: int) -> str:
        if (lo, depth) not in names:
            names[lo, depth] = _name(paths[lo], depth)
        return names[lo, depth]

    for b in branches:
        if b.up == b.depth:
            continue
        lo, hi, members = b.lo, b.hi, b.hi - b.lo + 1
        spine = lo == 0 or hi == n - 1
        above = branches[b.parent] if b.parent >= 0 else None
        over = above is not None and (above.lo == 0 or above.hi == n - 1)
        for depth in range(b.up + 1, b.depth + 1):
            before = upto[lo][depth - 1] if depth else 0
            tip = depth == b.depth
            whole = total[hi + 1] - total[lo] - members * before
            once = upto[lo][-1] - before + fresh[hi + 1] - fresh[lo + 1]
            ends = ids[lo:lo + b.ends] if tip else []
            if spine:
                yield ("spine", pid, name(lo, depth), name(lo, depth - 1) if depth else None, depth, b.low, None, members, b.inner if tip else 0,
                       leaves[hi + 1] - leaves[lo], whole, once, before, lo == 0, hi == n - 1, ends, None, None, None)
            else:
                parent_low = b.low if depth > b.up + 1 else above.low
                parent = name(above.lo, above.depth) if over and depth == b.up + 1 else None
                yield ("node", pid, None, parent, depth, b.low, parent_low, members, b.children if tip else 1,
                       leaves[hi + 1] - leaves[lo], whole, once, before, False, False, ends, None, None, None)
    yield ("edge", pid, *[None] * 14, paths[0], paths[-1], sizes[0])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
    schema, held = pa.schema(FIELDS), []
    if rows:
        paths, ids, sizes = map(list, zip(*rows))
        for row in _rows(TaskContext.get().partitionId(), paths, ids, sizes):
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, shared, shared_bytes, leaf): what a partition's first row shares with the row before, whether its last row is a leaf."""
    for batch in batches:
        out = []
        for pid, first, last, sizes, before, after in zip(*(batch.column(i).to_pylist() for i in range(6))):
            k = -1 if before is None else common(before, first)
            out.append((pid, k, sum(sizes[:max(k, 0)]), int(after is None or common(last, after) < len(last) // TURN)))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pid", "shared", "shared_bytes", "leaf"])


@dataclass
class Trie:
    """``nodes``: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends.

    ``ends``: ascending ids of the conversations that end at a node; null where partitions cut the node: those have
    their ``node`` name and lie in ``parts`` (node, pid, ends), ascending by pid.
    """

    nodes: DataFrame
    parts: DataFrame


def trie(turns: DataFrame, conversations: DataFrame) -> Trie:
    """The prefix trie of ``turns`` (conv_id, at, role, text), in order of ``at``, over all ids of ``conversations`` (conv_id).

    A node is a distinct sequence of first turns (role, text); the root is the empty one. Rows without conv_id belong
    to no conversation; null role or text is empty; conversations without turns end at the root. ``at`` orders a
    conversation's turns without ties. Copies of a whole conversation are members of one node. Empty tables
    give no nodes. A task holds 32 bytes a turn of the conversations of its partition, texts are not moved; a single
    conversation is one row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct("at", F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")).alias("k"), F.octet_length(text).cast("long").alias("b"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    own = conversations.where("conv_id is not null").select("conv_id").distinct().join(own, "conv_id", "left")
    none = F.coalesce("t", F.expr("cast(array() as array<struct<at:long,k:string,b:long>>)"))
    paths = spool(own.select(F.array_join(F.transform(none, lambda x: x["k"]), "").alias("path"), "conv_id", F.transform(none, lambda x: x["b"]).alias("sizes")), "paths")
    order = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = spool(order.mapInArrow(_forest, DDL), "forest")
    by = Window.orderBy("pid")  # one row a partition
    border = rows.where("kind = 'edge'").select("pid", "first", "last", "sizes", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    border = spool(border.mapInArrow(_borders, "pid long, shared long, shared_bytes long, leaf long"), "borders")
    spine = rows.where("kind = 'spine'").join(F.broadcast(border), "pid")
    goes_on = F.col("left") & (F.col("depth") <= F.col("shared"))
    spines = spine.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum(F.col("n_leaves") + F.when(F.col("right"), F.col("leaf")).otherwise(0)).alias("n_leaves"),
        F.sum(F.col("total") - F.col("distinct") + F.when(goes_on, F.col("shared_bytes") - F.col("below")).otherwise(0)).alias("saved_tokens"))
    spines = spool(spines, "spines")
    kids = spines.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("outer"))
    small = spines.count() <= SPINES
    names = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    names = F.broadcast(names) if small else names
    spines = spines.join(kids, "node", "left").join(names, "parent", "left").select(
        "node", "conv_id", "depth", F.col("of_parent").alias("parent_conv_id"), "n_convs", (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("n_children"),
        "n_leaves", "saved_tokens", F.lit(None).cast("array<long>").alias("ends"))
    inside = rows.where("kind = 'node'").join(names, "parent", "left").select(
        "node", "conv_id", "depth", F.coalesce("of_parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("distinct")).alias("saved_tokens"), "ends")
    dropped(paths)
    return Trie(inside.unionByName(spines), rows.where("kind = 'spine' and size(ends) > 0").select("node", "pid", "ends"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): conversations whose first turns are those of the next lower multiple of five.

    Turns are ordered by turn, null first, then role and text.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long") - 1)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(9))
    heads = rows.where("at < 8").select(F.col("conv_id").alias("base"), "at", "role", "text")
    ids = conversations.where("conv_id is not null").select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    front = ids.join(heads, "base").where("at < h")
    return front.select("conv_id", "at", "role", "text").unionByName(rows.where(F.col("at") >= h).select("conv_id", "at", "role", "text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of parts (node, ids) in order; the ids of a node are hashed as they come."""
    node, digest, out = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest, between = name, hashlib.sha256(), ""
            digest.update((between + ",".join(map(str, ids))).encode())
            between = ","
    if node is not None:
        out.append((node, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], names=["node", "ends_sha256"])


CRC = """xor(4294967295, list_reduce([4294967295::UBIGINT] || [ord(x)::UBIGINT for x in string_split(conv_id::VARCHAR, '')], lambda a, b:
    list_reduce([xor(a, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

SQL = f"""WITH conv AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS p, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT c, pos, role, text FROM conv JOIN t ON t.conv_id = p AND pos < h UNION ALL SELECT c, pos, role, text FROM conv JOIN t ON t.conv_id = c AND pos >= h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, md5(length(role) || ':' || role || text) AS k, strlen(text) AS b FROM u),
x AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, b FROM s UNION ALL SELECT c, 0, '', 0 FROM conv),
n AS (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n, min(b) AS b FROM x GROUP BY 1, 2),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (path)),
a AS (SELECT left(path, 32 * j) AS path, sum((n - 1) * b) AS saved, count(*) FILTER (children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM f) GROUP BY 1),
e AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM x GROUP BY 1) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.children::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves,
    a.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN a USING (path) LEFT JOIN e USING (path) LEFT JOIN f p ON f.depth > 0 AND p.path = left(f.path, 32 * (f.depth - 1))"""


@query("op12_trie", SQL)
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = trie(rebuilt(conversations), conversations)
    parts = found.parts.repartition("node").sortWithinPartitions("node", "pid").select("node", "ends")
    digests = parts.mapInArrow(_digests, "node string, ends_sha256 string")
    own = F.sha2(F.array_join(F.transform(F.coalesce("ends", F.expr("cast(array() as array<long>)")), lambda x: x.cast("string")), ","), 256)
    return found.nodes.join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", own).alias("ends_sha256"))
