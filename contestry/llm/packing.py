"""Packing token sequences by balanced cost.

A piece of n tokens costs n + n^2 / QUADRATIC: linear work of every layer plus attention, which is
confined to its own document. Pieces go in descending order to the cheapest sequence that still has
room, so that sequences of equal length also take about equal time.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from contestry.llm.common import query, record, table

LENGTH, END_ID, QUADRATIC = 2048, 1, 4096.0
#: Tokens packed together; bounds a task's memory whatever the partition holds.
WINDOW = 1 << 21
#: Bytes of text encoded together.
BYTES = 1 << 23
#: Encoded parts that outlive a task.
KEPT = 100_000
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordEncoder:
    """Ids of whole texts, encoding each distinct word between white space once.

    The tokenizer drops white space before it looks for words and never joins across it, so a text's ids
    are those of its words in order. Arrow and the tokenizer agree on white space, apart from the controls in
    ODD, which only Arrow counts; texts with these are encoded whole.

    Punctuation behind an ASCII letter or digit is a token run of its own, so it is encoded apart; behind any
    other character it is not, as normalisation may end the word in a mark. Encoded parts are kept in two generations
    of bounded size; a bounded part of them outlives a task.
    """

    ODD = r"[\x1c-\x1f]"
    TRAILING = ".,!?;:#$%&*|"

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.new, self.old = {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.new.get, parts))
        missing = [x for x, ids in zip(parts, found) if ids is None]
        fresh = [x for x in missing if x not in self.old]
        self.new.update(zip(fresh, self._encode(fresh)))
        self.new.update((x, self.old[x]) for x in missing if x in self.old)
        found = [self.new[x] if ids is None else ids for x, ids in zip(parts, found)] if missing else found
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        return found

    def forget(self) -> None:
        """Give back memory: a worker that waits for its next task holds the first KEPT parts it met, most of them common ones."""
        first = self.old or self.new
        self.new, self.old = {}, dict(islice(first.items(), KEPT))
        pa.default_memory_pool().release_unused()

    def _split(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Bare parts and trailing punctuation of distinct words, as dictionaries."""
        base = pc.utf8_rtrim(words, characters=self.TRAILING)
        apart = pc.and_(pc.match_substring_regex(base, "[0-9A-Za-z]$"), pc.less(pc.binary_length(base), pc.binary_length(words)))
        tail = pc.struct_field(pc.extract_regex(words, "(?P<t>[" + self.TRAILING + "]*)$"), "t")
        base, tail = pc.if_else(apart, base, words), pc.if_else(apart, tail, "")
        plain = pc.and_(pc.string_is_ascii(base), pc.invert(pc.match_substring(base, "<")))  # a special token is told by its case
        return pc.if_else(plain, pc.ascii_lower(base), base).dictionary_encode(), tail.dictionary_encode()

    def __call__(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every text of a string column or list; null is empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).cast(pa.string())).fill_null("")
        odd = pc.match_substring_regex(texts, self.ODD)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        words = lists.flatten().dictionary_encode()
        base, tail = self._split(words.dictionary)
        ids = [*self._known(base.dictionary.to_pylist()), *self._known(tail.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        pairs = np.stack([base.indices.to_numpy(), tail.indices.to_numpy() + len(base.dictionary)], axis=1)
        index = pairs[words.indices.to_numpy()].ravel()
        own = sizes[index]
        ends = np.concatenate([[0], np.cumsum(own)])
        every = flat[np.repeat(starts[index] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]).tolist()
        out = [every[s:e] for s, e in zip(cuts, cuts[1:])]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, whole in zip(at, self._encode([texts[i].as_py() for i in at])):
            out[i] = whole
        return out


def parted(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of ``most`` bytes of text or a single row."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cost(n):
    return n + n * n / QUADRATIC


def pack(lengths: np.ndarray, room: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in piece, length, sequence, offset) for pieces of 1 to ``room`` tokens.

    Whole pieces of ``room`` tokens are sequences. The others go, longest first (ties by position), to the
    cheapest of floor(total / room) sequences with enough room; where none has enough, the piece is cut and
    fills the cheapest open one. What exceeds the last full sequence is cut to powers of two, which need no
    padding. Every token lands in exactly one place.
    """
    out = [(int(i), 0, room, s, 0) for s, i in enumerate(np.flatnonzero(lengths == room))]
    rest = np.flatnonzero(lengths < room)
    n_full, first = int(lengths[rest].sum()) // room, len(out)
    free, load = np.full(n_full, room, np.int64), np.zeros(n_full)
    over = []
    for i in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        at, left = 0, int(lengths[i])
        while left and n_full:
            open_to = free >= left
            if not open_to.any():
                open_to = free > 0
                if not open_to.any():
                    break
            s = int(np.where(open_to, load, np.inf).argmin())
            take = min(left, int(free[s]))
            out.append((i, at, take, first + s, room - int(free[s])))
            free[s] -= take
            load[s] += cost(take)
            at, left = at + take, left - take
        if left:
            over.append([i, at, left])
    total, s = sum(x[2] for x in over), first + n_full
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        filled = 0
        while filled < size:
            piece = over[0]
            take = min(piece[2], size - filled)
            out.append((piece[0], piece[1], take, s, filled))
            filled += take
            piece[1], piece[2] = piece[1] + take, piece[2] - take
            if not piece[2]:
                over.pop(0)
        s += 1
    return out


def _packed(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = _encoder(path), TaskContext.get().partitionId() << 33, 0
        end = np.array([END_ID], "<u4").tobytes()
        held, size = [], 0

        def flush():
            nonlocal held, size, made
            pieces = [(d, ids, at, min(LENGTH, len(ids) // 4 - at)) for d, ids in held for at in range(0, len(ids) // 4, LENGTH)]
            rows = []
            for i, at, n, s, offset in pack(np.array([p[3] for p in pieces], np.int64)):
                doc, ids, begin, _ = pieces[i]
                own = ids[4 * (begin + at):4 * (begin + at + n)]
                rows.append((doc, begin + at, n, zlib.crc32(own), len(ids) // 4, base + made + s, offset, own if with_ids else None))
            made += 1 + max((r[5] - base - made for r in rows), default=-1)
            held, size = [], 0
            return record(SCHEMA, list(zip(*rows)))

        for batch in parted(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= WINDOW:
                    yield flush()
        if held:
            yield flush()
        encode.forget()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian).

    A task tokenizes and packs its own rows in windows of WINDOW tokens, so nothing is shuffled and memory is
    bounded. Null and empty texts are the end id alone. Equal or null ids and repeated rows are packed as
    separate documents. sequence_id is unique, not gapless: it holds the partition's number.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_packed(path, with_ids), DDL)
    return out if with_ids else out.drop("ids")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
