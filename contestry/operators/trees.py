"""Boosted trees for a yes/no target, each grown best first on summed gradient histograms.

Rows are binned once, at most 255 bins a feature, and written as blocks of arrays. To grow a tree, tasks add
gradients, curvatures and counts per (node, feature, bin), which are added over tasks; their size does not depend on the
rows. The children of all leaves that may still be split are searched in one pass, so a tree takes about as
many passes as it is deep; a pass is one job over blocks that tasks keep. A table that fits one task needs no passes: only children of nodes that are split are searched.
Of two children the smaller one is added up, the other is what the node holds besides. Gradients are added as whole numbers of 2^-30: sums, and so trees, do not depend on the
order or the number of tasks.

A null or NaN feature lies below every value. Rows with a null target or weight teach nothing; weights are at most 1.
An empty table gives a model of probability 1/2. Equal gains go to the first feature, then the lowest cut.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contestry.session import materialize, run_dir

UNIT = 2.0 ** 30
BINS = 256
#: Tables up to this many rows are fitted in one task, with the same trees: a pass is a job, which takes longer than to add up so many rows in a core.
TASK_ROWS = 1_000_000
#: Tables of more rows are dealt out before their quantiles are taken.
DEALT_ROWS = 100_000
#: Trees between two writings of the rows' scores, and between two states of the scores that tasks keep.
KEEP_EVERY, HELD_EVERY = 25, 5
#: Rows that a task holds at once in a pass, and tasks whose sums are added without a step between.
BLOCK_ROWS, DIRECT_TASKS = 200_000, 64
MIN_CURVATURE = 1e-3
BLOCK = "bins binary, target binary, weight binary, score binary"
NODE = "round int, node long, feature int, bin int, value double"


@dataclass(frozen=True)
class Limits:
    rounds: int = 250
    rate: float = 0.04
    leaves: int = 15
    leaf_rows: int = 35
    penalty: float = 3.0


class Split(NamedTuple):
    """Sums of a node and its best cut; a gain of 0 means that the node stays a leaf."""

    gain: float
    feature: int
    bin: int
    g: int
    h: int
    left_g: int
    left_h: int


class Tree(NamedTuple):
    """Node n has the children 2n + 1 (bin <= cut) and 2n + 2."""

    splits: dict[int, tuple[int, int]]
    values: dict[int, float]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for f, edges in enumerate(cuts):
        column = values[:, f]
        out[:, f] = np.where(np.isnan(column), 0, 1 + np.searchsorted(edges, column, "left"))
    return out


def placed(bins: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    at = np.zeros(len(bins), np.int64)
    for node in sorted(splits):
        feature, cut = splits[node]
        rows = np.flatnonzero(at == node)
        at[rows] = 2 * node + 1 + (bins[rows, feature] > cut)
    return at


def add_tree(score: np.ndarray, bins: np.ndarray, tree: Tree) -> None:
    """Adds the value of every row's leaf. A cut bars the leaves left of it to rows that go right: a row's leaf is the first one open."""
    if len(tree.values) > 16:
        at = placed(bins, tree.splits)
        for leaf, value in tree.values.items():
            score[at == leaf] += value
        return
    leaves: list[float] = []
    barred = np.zeros(len(bins), np.uint16)

    def walk(node: int) -> int:
        if node not in tree.splits:
            leaves.append(tree.values[node])
            return 1 << len(leaves) - 1
        left = walk(2 * node + 1)
        feature, cut = tree.splits[node]
        np.bitwise_or(barred, (bins[:, feature] > cut) * np.uint16(left), out=barred)
        return left | walk(2 * node + 2)

    walk(0)
    value = np.zeros(1 << 15 | 1)
    value[1 << np.arange(len(leaves))] = leaves
    score += value.take(~barred & barred + np.uint16(1))


def nodes_reached(bins: np.ndarray, splits: dict[int, tuple[int, int]], nodes: list[int]) -> dict[int, np.ndarray]:
    """Rows of each of ``nodes``, whose parents are all split."""
    above = set()
    for n in nodes:
        while n := n and (n - 1) // 2:
            above.add(n)
    rows = {0: np.arange(len(bins))}
    for n in sorted(above | ({0} if nodes != [0] else set())):
        feature, cut = splits[n]
        right = bins[rows[n], feature] > cut
        rows[2 * n + 1], rows[2 * n + 2] = rows[n][~right], rows[n][right]
    return {n: rows[n] for n in nodes}


def gradients(score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return np.rint((p - target) * weight * UNIT), np.rint(p * (1 - p) * weight * UNIT)


def column_histogram(columns: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``histogram`` of some rows of bins that are stored feature by feature."""
    whole = len(rows) == columns.shape[1]
    own_g, own_h = (g, h) if whole else (g[rows], h[rows])
    out = np.empty((3, len(columns), BINS), np.int64)
    for f, column in enumerate(columns):
        at = (column if whole else column[rows]).astype(np.intp)
        out[:, f] = np.bincount(at, own_g, BINS), np.bincount(at, own_h, BINS), np.bincount(at, minlength=BINS)
    return out


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(3, features, bins) of gradients, curvatures and counts."""
    n_features = bins.shape[1]
    at = (bins + np.arange(n_features, dtype=np.int64) * BINS).ravel()
    size = n_features * BINS
    sums = [np.bincount(at, np.repeat(g, n_features), size), np.bincount(at, np.repeat(h, n_features), size), np.bincount(at, minlength=size)]
    return np.stack([s.astype(np.int64) for s in sums]).reshape(3, n_features, BINS)


def best_split(sums: np.ndarray, limits: Limits) -> Split:
    total = sums[:, 0].sum(axis=-1)
    left = sums.cumsum(axis=-1)[..., :-1]
    right = total[:, None, None] - left

    def worth(part):
        h = part[1] / UNIT
        return np.divide((part[0] / UNIT) ** 2, h + limits.penalty, out=np.zeros(h.shape), where=h + limits.penalty > 0)

    gain = worth(left) + worth(right) - worth(total)
    barred = np.minimum(left[2], right[2]) < max(1, limits.leaf_rows)
    gain[barred | (np.minimum(left[1], right[1]) < MIN_CURVATURE * UNIT)] = 0.0
    feature, cut = (int(i) for i in np.unravel_index(np.argmax(gain), gain.shape))
    return Split(max(0.0, float(gain[feature, cut])), feature, cut, *(int(x) for x in (total[0], total[1], left[0, feature, cut], left[1, feature, cut])))


def chosen(found: dict[int, Split], leaves: int, ahead: bool = True) -> tuple[list[int], list[int]]:
    """Nodes split so far, best gain first, and the nodes that must be searched before the next one.

    With ``ahead`` those that may be needed later are searched too.
    """
    heap = [(-found[0].gain, 0)] if found[0].gain > 0 else []
    inner: list[int] = []
    while heap and len(inner) < leaves - 1:
        node = heapq.heappop(heap)[1]
        inner.append(node)
        children = (2 * node + 1, 2 * node + 2)
        if len(inner) < leaves - 1 and children[0] not in found:
            parents = [node, *(n for _, n in heap)] if ahead else [node]
            return inner, [c for n in parents for c in (2 * n + 1, 2 * n + 2) if c not in found]
        for c in children:
            if c in found and found[c].gain > 0:
                heapq.heappush(heap, (-found[c].gain, c))
    return inner, []


def grow(search, limits: Limits, ahead: bool = True) -> Tree:
    """One tree; ``search(nodes, splits)`` gives the Split of each node, ``splits`` being all cuts above them."""
    found = search([0], {})
    while True:
        inner, wanted = chosen(found, limits.leaves, ahead)
        if not wanted:
            break
        found |= search(wanted, {n: (s.feature, s.bin) for n, s in found.items() if s.gain > 0})
    value = lambda g, h: -limits.rate * (g / UNIT) / (h / UNIT + limits.penalty) if h or limits.penalty else 0.0
    values = {} if inner else {0: value(found[0].g, found[0].h)}
    for n in inner:
        s = found[n]
        for child, g, h in ((2 * n + 1, s.left_g, s.left_h), (2 * n + 2, s.g - s.left_g, s.h - s.left_h)):
            if child not in inner:
                values[child] = value(g, h)
    return Tree({n: (found[n].feature, found[n].bin) for n in inner}, values)


def _unpacked(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[np.ndarray, ...]]:
    for row in batch.to_pylist():
        yield (np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features), *(np.frombuffer(row[c]) for c in ("target", "weight", "score")))


def _packed(bins: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    values = [bins.tobytes(), *(c.astype(np.float64).tobytes() for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["bins", "target", "weight", "score"])


def _blocks(cuts: list[np.ndarray], base: float):
    """Blocks of the rows: the features, then target and weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *features, target, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(target):
                yield _packed(binned(np.column_stack(features), cuts), target, weight, np.full(len(target), base))

    return run


def _rescored(trees: list[Tree], n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, target, weight, score in _unpacked(batch, n_features):
                score = score.copy()
                for tree in trees:
                    add_tree(score, bins, tree)
                yield _packed(bins, target, weight, score)

    return run


def _held(n_features: int):
    """Blocks of stored rows, put together; bins stand feature by feature."""
    def run(rows):
        blocks, size = [], 0
        for row in rows:
            blocks.append((np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features), *(np.frombuffer(row[c]) for c in ("target", "weight", "score"))))
            size += len(blocks[-1][1])
            if size >= BLOCK_ROWS:
                yield _joined(blocks)
                blocks, size = [], 0
        if blocks:
            yield _joined(blocks)

    return run


def _joined(blocks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    bins, *columns = (np.concatenate(c) for c in zip(*blocks))
    return np.ascontiguousarray(bins.T), *columns


def _with_trees(trees: list[Tree]):
    def run(blocks):
        for columns, target, weight, score in blocks:
            score = score.copy()
            for tree in trees:
                add_tree(score, columns.T, tree)
            yield columns, target, weight, score

    return run


def _sums(trees: list[Tree], nodes: list[int], splits: dict[int, tuple[int, int]], n_features: int):
    """Sums of a task per node, feature and bin; ``trees`` are those that the scores lack."""
    def run(blocks):
        sums = np.zeros((len(nodes), 3, n_features, BINS), np.int64)
        for columns, target, weight, score in _with_trees(trees)(blocks):
            g, h = gradients(score, target, weight)
            for own, rows in zip(sums, nodes_reached(columns.T, splits, nodes).values()):
                own += column_histogram(columns, rows, g, h)
        yield sums

    return run


def _spread(stored: DataFrame, n: int, n_features: int, limits: Limits) -> list[Tree]:
    """Trees of a table of any size: a job per pass over blocks that tasks keep, scores written again every KEEP_EVERY trees.

    The driver holds the sums of the nodes of one tree.
    """
    tasks = max(stored.sparkSession.sparkContext.defaultParallelism, -(-n // (5 * BLOCK_ROWS)))
    kept_as = StorageLevel.MEMORY_AND_DISK
    deal = lambda df: df.repartition(tasks).rdd.mapPartitions(_held(n_features)).persist(kept_as)
    trees: list[Tree] = []
    kept = has = 0  # trees in the written scores and in the held ones
    held, past = deal(stored), []

    def added(nodes, splits):
        parts = held.mapPartitions(_sums(trees[has:], nodes, splits, n_features))
        return sum(parts.collect()) if tasks <= DIRECT_TASKS else parts.treeReduce(np.add)

    for done in range(1, limits.rounds + 1):
        sums: dict[int, np.ndarray] = {}

        def search(nodes, splits, sums=sums):
            few = [0] if nodes == [0] else []
            for parent in dict.fromkeys((c - 1) // 2 for c in nodes if c):
                feature, cut = splits[parent]
                count = sums[parent][2, feature]
                few.append(2 * parent + (1 if 2 * count[:cut + 1].sum() <= count.sum() else 2))
            for c, own in zip(few, added(few, splits)):
                sums[c] = own
                if c:
                    sums[c - 1 if c % 2 == 0 else c + 1] = sums[(c - 1) // 2] - own
            while past:  # what is held now has been computed
                past.pop().unpersist()
            return {c: best_split(sums[c], limits) for c in nodes}

        trees.append(grow(search, limits))
        if done % KEEP_EVERY == 0 and done < limits.rounds:
            stored = materialize(stored.mapInArrow(_rescored(trees[kept:], n_features), BLOCK), run_dir(stored.sparkSession, "boosted-scores"))
            past, held, kept, has = [*past, held], deal(stored), done, done
        elif done % HELD_EVERY == 0 and done < limits.rounds:
            past, held, has = [*past, held], held.mapPartitions(_with_trees(trees[has:])).persist(kept_as), done
    for blocks in (*past, held):
        blocks.unpersist()
    return trees


def _one_task(n_features: int, limits: Limits):
    """Trees of a small table, as rows of nodes; a leaf has feature -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [block for batch in batches for block in _unpacked(batch, n_features)]
        if not blocks:
            return
        bins, target, weight, score = (np.concatenate(c) for c in zip(*blocks))
        columns = np.ascontiguousarray(bins.T)
        for done in range(limits.rounds):
            g, h = gradients(score, target, weight)
            rows = {0: np.arange(len(bins))}
            sums = {0: column_histogram(columns, rows[0], g, h)}

            def part(n, feature, cut):
                right = columns[feature][rows[n]] > cut
                rows[2 * n + 1], rows[2 * n + 2] = rows[n][~right], rows[n][right]

            def search(nodes, splits):
                for n in {(n - 1) // 2 for n in nodes if n}:
                    part(n, *splits[n])
                    less, more = sorted((2 * n + 1, 2 * n + 2), key=lambda c: len(rows[c]))
                    sums[less] = column_histogram(columns, rows[less], g, h)
                    sums[more] = sums[n] - sums[less]
                return {n: best_split(sums[n], limits) for n in nodes}

            tree = grow(search, limits, ahead=False)
            for n, value in tree.values.items():
                if n not in rows:  # of the last split
                    part((n - 1) // 2, *tree.splits[(n - 1) // 2])
                score[rows[n]] += value
            nodes = [(done, n, f, b, 0.0) for n, (f, b) in tree.splits.items()] + [(done, n, -1, 0, v) for n, v in tree.values.items()]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes), kinds)], names=["round", "node", "feature", "bin", "value"])

    return run


class Boosted:
    """Fitted trees; ``predict`` scores rows in tasks."""

    def __init__(self, columns: list[str], cuts: list[np.ndarray], base: float, trees: list[Tree]):
        self.columns, self.cuts, self.base, self.trees = columns, cuts, base, trees

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        cuts, base, trees = self.cuts, self.base, self.trees

        @F.pandas_udf("double")
        def probability(rows: pd.DataFrame) -> pd.Series:
            bins = binned(rows.to_numpy(np.float64), cuts)
            score = np.full(len(bins), base)
            for tree in trees:
                add_tree(score, bins, tree)
            return pd.Series(1 / (1 + np.exp(-score)))

        named = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(self.columns)]
        return df.withColumn(name, probability(F.struct(*named)))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: the feature and the largest value that goes left (null: only null does), or a leaf's value."""
        out = []
        for i, tree in enumerate(self.trees):
            for n, (f, b) in tree.splits.items():
                out.append((i, n, self.columns[f], float(self.cuts[f][b - 1]) if b else None, None))
            out += [(i, n, None, None, float(v)) for n, v in tree.values.items()]
        return spark.createDataFrame(out, "round int, node long, feature string, cut double, value double")


def fit(df: DataFrame, columns: list[str], target: str = "target", weight: Column | None = None,
        limits: Limits = Limits(), task_rows: int = TASK_ROWS) -> Boosted:
    """Trees on the log loss of ``target`` (0 or 1), rows counting by ``weight`` (at most 1)."""
    features = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(columns)]
    rows = df.select(*features, F.col(f"`{target}`").cast("double").alias("y"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"))
    rows = rows.where("y is not null and w is not null")
    n = rows.count()
    if n > DEALT_ROWS:  # few bytes, and so few tasks, but the quantiles are much work
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // DEALT_ROWS))
        rows = materialize(rows.repartition(tasks), run_dir(df.sparkSession, "boosted-rows"))
    places = [i / (BINS - 1) for i in range(1, BINS - 1)]
    whole = lambda c: F.sum(F.round(c * UNIT).cast("long"))
    known = [F.percentile_approx(F.when(~F.isnan(f"f{i}"), F.col(f"f{i}")), places) for i in range(len(columns))]
    *quantiles, all_w, yes_w = rows.agg(*known, whole(F.col("w")), whole(F.col("w") * F.col("y"))).first()
    cuts = [np.unique(np.array(q or [], np.float64)) for q in quantiles]
    mean = min(1 - 1e-9, max(1e-9, yes_w / all_w)) if all_w else 0.5
    base = math.log(mean / (1 - mean))
    stored = materialize(rows.mapInArrow(_blocks(cuts, base), BLOCK), run_dir(df.sparkSession, "boosted"))
    if n > task_rows:
        return Boosted(columns, cuts, base, _spread(stored, n, len(columns), limits))
    trees: dict[int, Tree] = {}
    for r in stored.coalesce(1).mapInArrow(_one_task(len(columns), limits), NODE).collect():
        tree = trees.setdefault(r["round"], Tree({}, {}))
        if r.feature < 0:
            tree.values[r.node] = r.value
        else:
            tree.splits[r.node] = (r.feature, r.bin)
    return Boosted(columns, cuts, base, [trees[i] for i in sorted(trees)])
