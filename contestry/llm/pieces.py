"""SentencePiece encoding by suffix-array matching, and decoding.

The new parts of a batch of texts are concatenated and their suffixes sorted. Binary search finds the range of
suffixes that every piece begins, so all occurrences of all pieces come out at once as edges. Edges are
sorted by where they end inside their word and relaxed in that order: an edge is taken if its piece may
follow the piece that the encoding of the text before it ends with. In a byte-pair model exactly one edge
into every position is taken, and the last pieces of all prefixes spell the encoding backwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from contestry.llm.common import as_bytes, query, slices, table
from contestry.llm.packing import parted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of a suffix that are sorted; longer pieces are compared further at each place found.
DEPTH = 16
UNREACHED, UNKNOWN = -2, -1
#: Bytes of words indexed together.
INDEXED = 1 << 20
#: Bytes of text encoded together.
BYTES = 1 << 22
ENCODED = pa.schema([("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])


def surfaces(model) -> list[bytes]:
    """The bytes that every piece stands for; none for control pieces."""
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        out.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else name.encode())
    return out


class Pieces:
    """Tables of a byte-pair model whose pieces hold white space at their front only."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        self.surface = surfaces(model)
        normal = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                normal.append(i)
        if any(SPACE in names[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece has white space inside; words cannot be encoded apart")
        met = {name[k:k + 2] for name in (names[i] for i in normal) for k in range(len(name) - 1)}
        chars = sorted({c for pair in met for c in pair})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kind[ord(" ")] = self.kind[ord(SPACE)]
        self.kinds = len(chars) + 1
        self.unmet = np.ones(self.kinds * self.kinds, bool)
        self.unmet[[self.kind[ord(a)] * self.kinds + self.kind[ord(b)] for a, b in met]] = False
        by_name = {names[i]: i for i in normal}
        self.rank = np.full(n, -1, np.int64)
        for rank, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i))):
            if len(names[i]) > 1:
                self.rank[i] = rank
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        usable, pairs = [], {}
        for i in normal:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = by_name.get(name[:cut]), by_name.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = int(self.rank[i])
            parts = [by_name.get(c, -1) for c in name]
            last = None
            while len(parts) > 1 and -1 not in parts:
                options = [(int(self.rank[by_name[joined]]), k) for k in range(len(parts) - 1) if (joined := names[parts[k]] + names[parts[k + 1]]) in by_name]
                if not options:
                    break
                k = min(options)[1]
                last = (parts[k], parts[k + 1])
                parts[k:k + 2] = [by_name[names[parts[k]] + names[parts[k + 1]]]]
            if parts == [i]:
                usable.append(i)
                if last:
                    self.left[i], self.right[i] = last
        self.n = n
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.ids = np.array(usable, np.int64)
        texts = [self.surface[i] for i in usable]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.single = np.array([len(names[i]) == 1 for i in usable])
        self.low = np.array([t[:DEPTH] for t in texts], f"S{DEPTH}")
        self.high = np.array([t[:DEPTH].ljust(DEPTH, b"\xff") for t in texts], f"S{DEPTH}")
        self.piece_length = np.zeros(n, np.int64)
        self.piece_length[self.ids] = self.lengths

    def apart(self, points: np.ndarray) -> np.ndarray:
        """Whether each code point and the next stand side by side in no piece; the space is U+2581."""
        kind = self.kind[points]
        return self.unmet[kind[:-1] * self.kinds + kind[1:]]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart where they meet: their merges are undone, latest first, and at no
        time may the two symbols that touch have merged before the merge that used one of them up."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b, limit = a[at].astype(np.int64), b[at].astype(np.int64), np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = a * self.n + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merges = (self.pair_keys[place] == key) & (self.pair_ranks[place] < limit)
            ok[at[merges]] = False
            undo_a = self.rank[a] > self.rank[b]
            latest = np.where(undo_a, self.rank[a], self.rank[b])
            go = ~merges & (latest >= 0)
            at, a, b, undo_a, latest = at[go], a[go], b[go], undo_a[go], latest[go]
            limit = np.where(undo_a, latest, latest + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, piece, length) of every piece's every occurrence, and of characters that are no piece."""
        padded = np.r_[text, np.full(DEPTH, 0xFF, np.uint8)]
        chars = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
        windows = np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[chars]
        halves = windows.view(">u8").astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        suffixes, ordered = chars[order], windows[order].view(f"S{DEPTH}").ravel()
        low, high = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = high - low
        piece = np.repeat(np.arange(len(self.ids)), count)
        position = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        keep = np.ones(len(piece), bool)
        for i in np.flatnonzero((self.lengths[piece] > DEPTH)).tolist():
            whole = self.surface[self.ids[piece[i]]]
            keep[i] = text[position[i]:position[i] + len(whole)].tobytes() == whole
        piece, position = piece[keep], position[keep]
        known = np.zeros(len(text), bool)
        known[position[self.single[piece]]] = True
        odd = chars[~known[chars]]
        lead = text[odd]
        size = np.where(lead == 0xFE, 1, 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0))
        return np.r_[position, odd], np.r_[self.ids[piece], np.full(len(odd), UNKNOWN)], np.r_[self.lengths[piece], size]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            upto, size = at, 0
            while upto < len(words) and (upto == at or size + len(words[upto]) < INDEXED):
                size += len(words[upto]) + 1
                upto += 1
            out += self._words(words[at:upto])
            at = upto
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        # 0xFF ends a word, 0xFE stands for NUL; neither occurs in UTF-8
        text = np.frombuffer(b"\xff".join(words).replace(b"\x00", b"\xfe") + b"\xff", np.uint8)
        ends = np.flatnonzero(text == 0xFF)
        starts = np.r_[0, ends[:-1] + 1]
        position, piece, length = self._edges(text)
        origin = np.repeat(starts, ends - starts + 1)
        reach = position + length
        order = np.argsort(reach - origin[position], kind="stable")
        position, piece, length, reach = position[order], piece[order], length[order], reach[order]
        offset = reach - origin[position]
        last, size = np.full(len(text) + 1, UNREACHED, np.int64), np.zeros(len(text) + 1, np.int64)
        cuts = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1], True]) if len(offset) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, p = position[lo:hi], piece[lo:hi]
            before = last[s]
            first = s == origin[s]
            take = first | (before != UNREACHED)
            take[take] &= first[take] | self.may_follow(before[take], p[take])
            last[reach[lo:hi][take]], size[reach[lo:hi][take]] = p[take], length[lo:hi][take]
        owner, step, found, place = [], [], [], []
        word, here, k = np.arange(len(words)), ends.copy(), 0
        while True:
            on = here > starts[word]
            word, here = word[on], here[on]
            if not len(word):
                break
            owner.append(word)
            step.append(np.full(len(word), -k))
            found.append(last[here])
            here = here - size[here]
            place.append(here)
            k += 1
        if not owner:
            return [b""] * len(words)
        owner, step, found, place = (np.concatenate(x) for x in (owner, step, found, place))
        order = np.lexsort((step, owner))
        owner, found, place = owner[order], found[order], place[order]
        edges = np.searchsorted(owner, np.arange(len(words) + 1))
        odd = set(owner[found == UNKNOWN].tolist())
        flat = found.astype("<u4").tobytes()
        out = [flat[4 * a:4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for w in odd:
            ids = []
            for piece_id, at in zip(found[edges[w]:edges[w + 1]].tolist(), place[edges[w]:edges[w + 1]].tolist()):
                raw = words[w][at - starts[w]:][:1 if piece_id != UNKNOWN else 4]
                if piece_id == UNKNOWN:
                    lead = raw[0]
                    ids += self.byte_id[list(raw[:1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)])].tolist()
                else:
                    ids.append(piece_id)
            out[w] = np.array(ids, "<u4").tobytes()
        return out


class Codec:
    """Encodes whole texts part by part; encoded parts are kept in two generations of bounded size.

    No merge joins two characters that stand side by side in no piece, so texts are cut there: between words, mostly
    before and after punctuation, and around characters that are no piece. Arrow numbers the distinct parts of a
    batch, and only those are looked up.
    """

    def __init__(self, path: str, most: int = 250_000):
        self.path, self.pieces, self.most = path, Pieces(path), most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts, and how many of them come before each text and in all."""
        whole = "".join([" " + t if t else "" for t in texts])
        starts = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        raw = whole.encode()
        first = np.ones(len(whole), bool)
        first[1:] = self.pieces.apart(np.frombuffer(whole.encode("utf-32-le"), "<u4"))
        first[starts[starts < len(whole)]] = True
        at = np.flatnonzero(first)
        before = np.searchsorted(at, starts)
        if len(raw) > len(whole):
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[at]
        offsets = np.append(at, len(raw)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), before

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, parts))
        missing = [p for p, ids in zip(parts, found) if ids is None]
        new = [p for p in missing if p not in older]
        known.update((p, older[p]) for p in missing if p in older)
        known.update(zip(new, self.pieces.words([p.replace(b" ", SPACE.encode()) for p in new])))
        return [known[p] if ids is None else ids for p, ids in zip(parts, found)]

    def flat(self, texts: list[str]) -> tuple[bytes, list[int]]:
        """Little-endian ids of all texts, one after the other, and the bytes before each text and in all."""
        parts, before = self._split(texts)
        coded = parts.dictionary_encode()
        ids, offsets = joined(pa.array(self._ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices))
        return ids, offsets[before].tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, cuts = self.flat(texts)
        return [ids[s:e] for s, e in zip(cuts, cuts[1:])]

    def decode(self, ids: list[int]) -> str:
        return speller(self.path)(pa.array([ids], pa.list_(pa.int32())))[0]


class Speller:
    """Texts of lists of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        spelled = [x.replace(SPACE.encode(), b" ") for x in surfaces(SentencePieceProcessor(model_file=path))]
        self.spelled = pa.array(spelled, pa.binary())

    def __call__(self, lists: pa.Array) -> list[str]:
        """Null lists give the empty text."""
        raw, offsets = joined(self.spelled.take(lists.flatten()))
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        cuts = [0, *offsets[ends].tolist()]
        texts = [raw[s:e].decode(errors="replace").replace(SPACE, " ") for s, e in zip(cuts, cuts[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts]


def joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All values of a binary column, which is no slice, in one, and the bytes before each and in all."""
    if not len(column):
        return b"", np.zeros(1, np.int32)
    _, offsets, data = column.buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int32, len(column) + 1)


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(2)
def speller(path: str) -> Speller:
    return Speller(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in parted(batches, 1, BYTES):
            texts = as_bytes(batch.column(1))
            ids, cuts = own.flat([t.decode() for t in texts])
            values = pa.ListArray.from_arrays(pa.array(np.array(cuts) // 4, pa.int32()), pa.array(np.frombuffer(ids, "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(t) for t in texts], pa.int64()), values,
                                              pa.array([zlib.crc32(ids[s:e]) for s, e in zip(cuts, cuts[1:])], pa.int64())], schema=ENCODED)

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = speller(path)
        for batch in slices(batches, 500):
            texts = own(batch.column("ids"))
            rest = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], names=[*rest.schema.names, "text"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, text_crc32, ids, ids_crc32): ids of the whole text, a row per row of ``docs``.

    Null and empty texts have no ids. Characters that are no piece become their UTF-8 bytes' pieces. Equal
    texts have equal ids; nothing is shuffled. ids_crc32 is over little-endian 32-bit ids.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_encoded(path), "doc_id long, text_crc32 long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``text`` in place of the array column ``ids``; null ids give the empty text.

    U+2581 and the space are the same to the model, so either decodes to a space.
    """
    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    return encoded.mapInArrow(_decoded(path), ddl)


@query("op1_pieces")
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.size("ids").cast("long"))
    return decode(encoded).select("doc_id", "n_tokens", "ids_crc32", (F.crc32("text") == F.col("text_crc32")).alias("round_trip"))
