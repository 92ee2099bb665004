"""Near-duplicate classes by SuperMinHash: signatures, banding, confirmation on full sets, union-find.

Every shingle draws a random permutation of the SLOTS signature slots, one step at a time. What it offers to the
slot of its j-th step lies between j and j + 1, so a shingle's ranks are correlated: it is early in some slots
and late in the others, which gives estimates of lower variance than independent hashes (Ertl, 2017). A text
stops drawing once all its slots hold values below the next step.

Texts whose signatures agree in a whole band of slots are filed together. Filed texts are compared by signature,
what can be alike is confirmed on the full shingle sets, and links are grouped by union-find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from contestry.llm.common import as_bytes, components, dropped, query, slices, spool, table

#: Slots of a signature; one byte of each is kept.
SLOTS = 140
#: Shingles that draw together.
CHUNK = 4096
#: Texts that one task compares at a time; a fuller band is cut in tiles, each pair of tiles is a task's work.
TILE = 1024
#: Up to so many text hashes (8 bytes each) are broadcast to pick the texts that are to be confirmed.
PICKED = 500_000
GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Law:
    """Links texts with ``share[1] * common >= share[0] * union`` of their ``width``-word shingles.

    ``rows`` slots make a band. A pair at the threshold of share 0.85 (rows 5) misses all 28 bands with chance
    8e-8, at 0.8 (rows 4) all 35 with chance 1e-8. ``least``: the share of equal slots below which no set is fetched,
    six standard deviations under the threshold.
    """

    width: int
    share: tuple[int, int]
    rows: int
    least: float

    @property
    def bands(self) -> int:
        return SLOTS // self.rows

    def alike(self, common, a, b):
        return self.share[1] * common >= self.share[0] * (a + b - common)


LAW = Law(3, (85, 100), 5, 0.66)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered in two generations of bounded size."""

    def __init__(self, most: int = 100_000):
        self.most, self.new, self.old = most, {}, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, words))
        if None in found:
            for word in {w for w, x in zip(words, found) if x is None}:
                self.new[word] = self.old.get(word) or xxhash.xxh64_intdigest(word)
            found = [self.new[w] if x is None else x for w, x in zip(words, found)]
        return np.fromiter(found, np.uint64, len(found))


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def forget() -> None:
    """Give back the memory of remembered words at the end of a task; a waiting worker should hold little."""
    word_hashes.cache_clear()
    pa.default_memory_pool().release_unused()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Ascending hashes of the distinct word shingles; fewer words are one shingle, no word: none."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    hashes, n = word_hashes()(words), len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(GOLDEN) + hashes[k:k + n] + np.uint64(k + 1))
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS values of a set: step in the upper half, draw in the lower; of every slot the smallest one offered."""
    best = np.full(SLOTS, (1 << 64) - 1, np.uint64)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        every, order, first = np.arange(len(part)), None, None
        for j in range(SLOTS):
            if int(best.max() >> half) < j:
                break
            x = mixed(part + np.uint64((j + 1) * GOLDEN & (1 << 64) - 1))
            k = (j + ((x >> half) * np.uint64(SLOTS - j) >> half).astype(np.int64))
            if j == 0:
                slot = first = k
            else:
                if order is None:  # the permutations, needed only by texts that a first step doesn't fill
                    order = np.tile(np.arange(SLOTS, dtype=np.int16), (len(part), 1))
                    order[every, first], order[:, 0] = 0, first
                slot = order[every, k]
                order[every, k] = order[:, j]
                order[:, j] = slot
            np.minimum.at(best, slot, x & low | np.uint64(j) << half)
    return best


def node_of(hashes: np.ndarray) -> int:
    """64-bit identity of a shingle set; texts of equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a shingle set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _signed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, tuple] = {}
    for batch in slices(batches, 200):
        rows = []
        for h, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            row = seen.get(h)  # copies are signed once
            if row is None:
                if len(seen) >= 20_000:
                    seen.clear()
                hashes = shingles(text, width)
                row = seen[h] = (len(hashes), node_of(hashes), simhash(hashes), (signature(hashes) & np.uint64(255)).astype(np.uint8).tobytes()) if len(hashes) else (0, 0, 0, None)
            rows.append(row)
        n, node, fp, sig = zip(*rows) if rows else ((), (), (), ())
        arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n", "node", "fp", "sig"])
    seen.clear()
    forget()


def signed(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n, node, fp, sig) of every row: text hash, size and identity of the shingle set, SimHash, signature.

    Null and empty texts and texts without words have n = 0, node 0 and no signature.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(partial(_signed, width), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, n long, node long, fp long, sig binary")


def _estimated(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of columns (a, b, sig of a, sig of b) with enough equal slots."""
    for batch in slices(batches, 4096):
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
        keep = pa.array((x == y).sum(1) >= least * SLOTS)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with the same first two columns, of batches sorted by them."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]):
            if (int(x[s]), int(y[s])) != key:
                if held:
                    yield key, held
                key, held = (int(x[s]), int(y[s])), []
            held.append(batch.slice(s, e - s))
    if held:
        yield key, held


def _column(parts: list[pa.RecordBatch], i: int) -> pa.Array:
    return pa.concat_arrays([p.column(i) for p in parts])


def forest(sets: list[np.ndarray], labels: np.ndarray, sigs: np.ndarray, law: Law) -> list[tuple[int, int]]:
    """Links (i, j) that join whatever chains of alike sets join; sets of one label need no link."""
    label, out = labels.copy(), []
    for i in range(len(sets) - 1):
        near = (sigs[i + 1:] == sigs[i]).sum(1) >= law.least * SLOTS
        for j in (np.flatnonzero(near & (label[i + 1:] != label[i])) + i + 1).tolist():
            if label[i] != label[j] and law.alike(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _confirmed(law: Law, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of groups: rows (g, tile, node, label, sig, text), sorted by the first two."""
    for _, parts in _groups(batches):
        node = _column(parts, 2).to_numpy(zero_copy_only=False)
        _, at = np.unique(node, return_index=True)
        sigs = np.frombuffer(b"".join(_column(parts, 4).to_pylist()), np.uint8).reshape(-1, SLOTS)[at]
        texts = as_bytes(_column(parts, 5))
        sets = [shingles(texts[i], law.width) for i in at.tolist()]
        links = forest(sets, _column(parts, 3).to_numpy(zero_copy_only=False)[at], sigs, law)
        node = node[at]
        yield pa.RecordBatch.from_arrays([pa.array([int(node[x[k]]) for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    forget()


def _met(law: Law, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, tile, node) of the nodes with a partner of another label that may be alike and first meets them in this band.

    Rows (g, tile, band, node, label, sig), sorted by the first two.
    """
    for (g, tile), parts in _groups(batches):
        band = parts[0].column(2)[0].as_py()
        node, label = (_column(parts, i).to_numpy(zero_copy_only=False) for i in (3, 4))
        sigs = np.frombuffer(b"".join(_column(parts, 5).to_pylist()), np.uint8).reshape(-1, SLOTS)
        hit = np.zeros(len(node), bool)
        for i in range(len(node) - 1):
            same = sigs[i + 1:] == sigs[i]
            near = np.flatnonzero((same.sum(1) >= law.least * SLOTS) & (label[i + 1:] != label[i]))
            if len(near):
                first = same[near][:, :law.bands * law.rows].reshape(len(near), law.bands, law.rows).all(2).argmax(1)
                near = near[first == band]
                hit[near + i + 1] = True
                hit[i] |= len(near) > 0
        found = np.unique(node[hit])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), g)), pa.array(np.full(len(found), tile)), pa.array(found)], names=["g", "tile", "node"])


def _texts(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of ``nodes`` (node, h); texts are moved only where the hashes are too many to broadcast."""
    small = nodes.count() <= PICKED
    rows = docs.select(F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text"))
    wanted = F.broadcast(nodes) if small else nodes
    if small:  # one row of each text; most copies are gone before anything moves
        rows = rows.join(F.broadcast(nodes.select("h")), "h", "left_semi")
    return rows.dropDuplicates(["h"]).join(wanted, "h").select("node", "text")


def _confirm(docs: DataFrame, groups: DataFrame, nodes: DataFrame, law: Law, text_col: str) -> DataFrame:
    """Confirmed links of ``groups`` (g, tile, node, label), each group on one task; written out."""
    groups = spool(groups, "groups")
    wanted = spool(nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "h", "sig"), "wanted")
    texts = spool(_texts(docs, wanted.select("node", "h"), text_col).join(wanted.select("node", "sig"), "node"), "texts")
    rows = groups.join(texts, "node").select("g", "tile", "node", "label", "sig", "text")
    links = spool(rows.repartition("g", "tile").sortWithinPartitions("g", "tile").mapInArrow(partial(_confirmed, law), "a long, b long"), "links")
    dropped(groups, wanted, texts)
    return links


def confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, law: Law, text_col: str = "text", label: DataFrame | None = None) -> DataFrame:
    """Confirmed links among nodes that ``pairs`` (a, b) join to the same a; ``label`` (node, label) marks what is linked already."""
    sizes = pairs.groupBy("a").count()
    stars = pairs.join(sizes, "a").withColumn("tile", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / TILE)))
    hubs = sizes.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("count") / TILE) - 1)).alias("tile"), F.col("a").alias("node"))
    groups = stars.select(F.col("a").alias("g"), "tile", F.col("b").alias("node")).unionByName(hubs)
    if label is None:
        groups = groups.withColumn("label", F.col("node"))
    else:
        groups = groups.join(label, "node", "left").select("g", "tile", "node", F.coalesce("label", "node").alias("label"))
    return _confirm(docs, groups, nodes, law, text_col)


def _tiled(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` (g, node, ...) with a column ``tile``: groups above TILE rows (column ``size``) are cut, each pair of cuts meets once."""
    cuts = F.ceil(F.col(size) / TILE)
    few = rows.where(F.col(size) <= TILE).withColumn("tile", F.lit(0).cast("long"))
    many = rows.where(F.col(size) > TILE).withColumn("_p", F.pmod(F.xxhash64("node"), cuts)).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)))
    many = many.withColumn("tile", F.greatest("_p", "_q") * cuts + F.least("_p", "_q")).drop("_p", "_q")
    return few.unionByName(many).drop(size)


def links(docs: DataFrame, nodes: DataFrame, law: Law, text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(node, label) of the nodes that are linked to another one; label is the smallest node reachable.

    ``nodes``: node, h, sig, one row per distinct set. ``known``: links (a, b) already confirmed. Two passes: every
    node is confirmed against the smallest node of each of its bands, then only bands whose members still have
    different labels are compared in full. No band is capped and no pair table is built.
    """
    file = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * law.rows + 1}, {law.rows})")).alias("g")) for i in range(law.bands)]))
    filed = nodes.select("node", file.alias("e")).select("node", "e.band", "e.g")
    bands = spool(filed.groupBy("g").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"), "bands")
    shared = spool(filed.join(bands, "g"), "shared")
    pairs = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sigs = nodes.select("node", "sig")
    for c in ("a", "b"):
        pairs = pairs.join(sigs.select(F.col("node").alias(c), F.col("sig").alias(f"of_{c}")), c)
    pairs = spool(pairs.select("a", "b", "of_a", "of_b").mapInArrow(partial(_estimated, law.least), "a long, b long"), "pairs")
    label = None if known is None else components(known, "a", "b")
    if label is not None:  # what is linked already needs no set
        for c in ("a", "b"):
            pairs = pairs.join(label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
        pairs = pairs.where("of_a <> of_b").select("a", "b")
    found = confirmed(docs, pairs, nodes, law, text_col, label)
    found = found if known is None else found.union(known)
    label = components(found, "a", "b")
    rows = shared.drop("hub").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = rows.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("g")
    rows = _tiled(rows.join(open_, "g").join(sigs, "node"), "size").select("g", "tile", "band", "node", "label", "sig")
    met = rows.repartition("g", "tile").sortWithinPartitions("g", "tile").mapInArrow(partial(_met, law), "g long, tile long, node long")
    met = met.join(label, "node", "left").select("g", "tile", "node", F.coalesce("label", "node").alias("label"))
    more = _confirm(docs, met, nodes, law, text_col)
    out = components(found.union(more), "a", "b")
    dropped(bands, shared, pairs)
    return out


def node_rows(rows: DataFrame) -> DataFrame:
    """One row per distinct shingle set of ``signed`` rows: node, h, sig, fp; written out."""
    return spool(rows.where("n > 0").groupBy("node").agg(F.min("h").alias("h"), F.min("fp").alias("fp"), F.min("sig").alias("sig")), "nodes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", law: Law = LAW) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included; null where no row of the class
    has an id. Texts without words are linked with nothing, their own copies included. Repeated rows and equal ids
    stay separate rows. Very long texts are read whole, in chunks of CHUNK shingles. An empty table gives no rows;
    further columns are ignored. Memory of a task: TILE texts.
    """
    rows = spool(signed(docs, law.width, id_col, text_col).drop("fp").withColumn("fp", F.lit(0)), "signatures")
    nodes = node_rows(rows)
    label = links(docs, nodes, law, text_col)
    lows = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = lows.groupBy("label").agg(F.min("low").alias("component_id"))
    lows = lows.join(roots, "label").select("node", "component_id")
    out = rows.where("n > 0").join(lows, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS gs FROM w),
t AS (SELECT gs, min(doc_id) AS low, row_number() OVER () AS k FROM (SELECT doc_id, list_sort(gs) AS gs FROM s WHERE len(gs) > 0) GROUP BY gs),
g AS (SELECT k, len(gs) AS n, unnest(gs) AS gram FROM t),
p AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b USING (gram) WHERE a.k < b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.k, b.k HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(k, o) AS (SELECT k, k FROM t UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.k),
c AS (SELECT r.k, min(o.low) AS low FROM r JOIN t o ON o.k = r.o GROUP BY 1),
x AS (SELECT list_sort(t.gs) AS gs, c.low FROM t JOIN c USING (k))
SELECT s.doc_id, len(s.gs)::BIGINT AS n_shingles, coalesce(x.low, s.doc_id) AS component_id, coalesce(x.low, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN x ON x.gs = list_sort(s.gs)"""


@query("op11_superminhash", SQL)
def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
