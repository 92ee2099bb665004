"""Periodic runs of words: maximal stretches that repeat with a smallest period three times or more.

A run of 24 words or more and three periods or more holds, at a distance of its period, equal windows of 16 words
that cover it. So only stretches covered by windows that recur within a third of the stretch are searched; all
others cannot hold a run. A stretch is searched by the runs theorem (Bannai et al., 2017): every run has a Lyndon
root that is the longest Lyndon word at its place in one of two opposite orders of the alphabet. Each such word is
extended both ways by longest common extensions, which are lowest common ancestors in the Ukkonen suffix trees of
the stretch and of its reversal, answered in constant time from Euler tours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contestry.llm.common import SPACE, as_bytes, fresh, query, slices, table
from contestry.llm.superminhash import GOLDEN, forget, mixed, word_hashes

#: A run has so many words and so many periods, at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Windows of a run that recur within it; a power of two.
WINDOW = MIN_WORDS - MIN_WORDS // MIN_PERIODS
BLOCK = 16
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (1 and above) and an end mark 0, with an Euler tour of string depths."""

    def __init__(self, symbols: list[int]):
        self.symbols = [*symbols, 0]
        self.first, self.last, self.next = [0], [0], [{}]
        self._build()

    def _node(self, first: int, last: int) -> int:
        self.first.append(first)
        self.last.append(last)
        self.next.append({})
        return len(self.first) - 1

    def _build(self) -> None:
        s, first, last, children, node_of = self.symbols, self.first, self.last, self.next, self._node
        n, link = len(s), {}
        node = at = length = waiting = 0  # the active point, and suffixes not yet in the tree
        for i, c in enumerate(s):
            waiting += 1
            open_ = 0  # an inner node whose suffix link is still missing
            while waiting:
                if not length:
                    at = i
                child = children[node].get(s[at])
                if child is None:
                    children[node][s[at]] = node_of(i, n)
                    if open_:
                        link[open_] = node
                    open_ = 0
                else:
                    edge = (last[child] if last[child] <= i else i + 1) - first[child]
                    if length >= edge:
                        at, length, node = at + edge, length - edge, child
                        continue
                    if s[first[child] + length] == c:
                        length += 1
                        if open_:
                            link[open_] = node
                        break
                    inner = node_of(first[child], first[child] + length)
                    children[node][s[at]] = inner
                    children[inner][c] = node_of(i, n)
                    first[child] += length
                    children[inner][s[first[child]]] = child
                    if open_:
                        link[open_] = inner
                    open_ = inner
                waiting -= 1
                if node:
                    node = link.get(node, 0)
                elif length:
                    length -= 1
                    at = i - waiting + 1

    def suffixes(self, descending: bool = False, tour: bool = False) -> np.ndarray:
        """Rank of every suffix; symbols ascend or descend, the end mark is smallest either way. May keep the Euler tour."""
        n, first, last, children = len(self.symbols), self.first, self.last, self.next
        rank, count = np.empty(n, np.int64), 0
        depths, seen = [], np.empty(n, np.int64)
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back from a child
                depths.append(depth)
                continue
            below = children[node]
            if tour:
                if not below:
                    seen[n - depth] = len(depths)
                depths.append(depth)
            if not below:
                rank[n - depth] = count
                count += 1
                continue
            marks = sorted(below, reverse=not descending)  # the last one pushed is visited first
            if descending and marks[0] == 0:
                marks = [*marks[1:], 0]
            for c in marks:
                child = below[c]
                if tour:
                    stack.append((-1, depth))
                stack.append((child, depth + last[child] - first[child]))
        if tour:
            self.minima, self.seen = Minima(np.array(depths, np.int32)), seen
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of places i and j."""
        x, y = self.seen[i], self.seen[j]
        return self.minima(np.minimum(x, y), np.maximum(x, y))


class Minima:
    """Range minima in constant time: a sparse table over blocks, running minima inside them. Linear memory."""

    def __init__(self, values: np.ndarray):
        full = np.full(-(-len(values) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        full[:len(values)] = values
        blocks = full.reshape(-1, BLOCK)
        self.values = full
        self.left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            x, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(x[:-step], x[step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.right[lo], self.left[hi])
        inside = np.flatnonzero(a == b)
        if len(inside):
            out[inside] = self.values[lo[inside]]
            for k in range(1, BLOCK):
                step = inside[lo[inside] + k <= hi[inside]]
                out[step] = np.minimum(out[step], self.values[lo[step] + k])
        width = b - a - 1
        for k, level in enumerate(self.levels):
            some = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
            if len(some):
                out[some] = np.minimum(out[some], np.minimum(level[a[some] + 1], level[b[some] - (1 << k)]))
        return out


def lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every place: up to the next smaller suffix."""
    rank = rank.tolist()
    n = len(rank)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j = i + 1
        while j < n and rank[j] > rank[i]:
            j = after[j]
        after[i] = j
    return np.array(after, np.int64) - np.arange(n)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``symbols`` (1 and above), by start, then period."""
    n = len(symbols)
    forward, back = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    ranks = forward.suffixes(tour=True)[:n], forward.suffixes(descending=True)[:n]
    back.suffixes(tour=True)
    period = np.concatenate([lyndon(r) for r in ranks])
    start = np.tile(np.arange(n), 2)
    some = MIN_PERIODS * period <= n
    start, period = start[some], period[some]
    end = start + period + forward.common(start, start + period)
    # place n of the reversal is the empty suffix, so nothing lies left of place 0
    start = start - back.common(n - start, n - start - period)
    rows = np.stack([start, end - start, period], axis=1)
    return np.unique(rows[rows[:, 1] >= np.maximum(MIN_WORDS, MIN_PERIODS * period)], axis=0)


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Parts [start, end) of the words that may hold runs."""
    n = len(hashes)
    if n < MIN_WORDS:
        return []
    windows, width = hashes, 1
    while width < WINDOW:
        windows = mixed(windows[:-width] * np.uint64(GOLDEN) + windows[width:])
        width *= 2
    order = np.argsort(windows, kind="stable")
    gap = np.where(windows[order[1:]] == windows[order[:-1]], order[1:] - order[:-1], n)
    near = np.full(len(windows), n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    open_ = np.flatnonzero(MIN_PERIODS * near <= n)
    while len(open_):
        first = np.flatnonzero(np.diff(open_, prepend=-n) > WINDOW)
        starts, ends = open_[first], open_[np.append(first[1:], len(open_)) - 1] + WINDOW
        sizes = (ends - starts)[np.searchsorted(starts, open_, "right") - 1]
        left = open_[(MIN_PERIODS * near[open_] <= sizes) & (sizes >= MIN_WORDS)]
        if len(left) == len(open_):
            return list(zip(starts.tolist(), ends.tolist()))
        open_ = left
    return []


def runs(words: list[bytes]) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``words``, by start, then period."""
    hashes = word_hashes()(words)
    found = [np.empty((0, 3), np.int64)]
    for s, e in stretches(hashes):
        found.append(runs_of(np.unique(hashes[s:e], return_inverse=True)[1] + 1) + (s, 0, 0))
    return np.concatenate(found)


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: those behind the first period of a run go."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 100):
        n, rows, texts = [], [], []
        for text in as_bytes(batch.column(1)):
            words = text.split()
            own = runs(words)
            if len(own):
                words_left = [words[i] for i in np.flatnonzero(kept(len(words), own)).tolist()]
            n.append(len(words))
            rows.append(own)
            texts.append(b" ".join(words_left if len(own) else words))
        flat = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    forget()


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of ``docs``; nothing is shuffled.

    ``runs``: all runs (start, length, period) in words, by start, then period. ``collapsed``: the words that are
    not a repetition, joined by one space. Null and empty texts have no words, no runs and an empty collapsed text.
    Every row stands for itself: repeated rows, equal and null ids are kept; an empty table gives no rows; further
    columns are ignored. A very long text is read whole; memory is linear in its words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_found, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where one text in ten has a periodic end, chosen by the id; other texts are left as they are."""
    (code,) = fresh(docs, "_code")
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    g = F.floor(F.col(code) / 10)

    def end(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        at = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.concat(
            F.slice(words, F.lit(1), x["a"].cast("int")),
            F.transform(F.sequence(F.lit(0).cast("long"), n - 1 - x["a"]), lambda i: F.get(words, (x["a"] + F.pmod(i, x["p"])).cast("int")))))
        return F.when(n > 0, F.array_join(at[0], " ")).otherwise(F.lit(""))

    words = F.array_remove(F.split(F.col(f"`{text_col}`"), f"{SPACE}+"), "")
    chosen = F.col(code).isNotNull() & (F.pmod(F.col(code), F.lit(10)) == 0)
    return docs.withColumn(code, h).withColumn(text_col, F.when(chosen, F.transform(F.array(words), end)[0]).otherwise(F.col(f"`{text_col}`"))).drop(code)


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(with_periods(table(spark, sf_dir, "documents")))
    longer = lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
