"""Fuzzy matching of curated names and phrases in text, and clean-up of the readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from contestry.functions import text as tx
from contestry.session import materialize, run_dir


#: Bytes of a text as they stand in keys: letters and digits, all else as a space; marks inside a token (see TOKEN) are left out.
KEY_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
MARKS = b"_`[].-"


def _distinct_tokens(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys((text or b"").translate(KEY_BYTES, MARKS).split())) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat], schema=schema)

    return run


def tokens(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Distinct normalised tokens per document, from the whole text: ``ascii_key`` of every match of ``TOKEN``.

    A token is what lies between bytes that cannot be in one, without its marks; marks in front of a token are no part of it either.
    """
    rows = texts.select(F.col(key), F.col(column).cast("string"))
    schema = StructType([texts.schema[key], StructField("token", StringType())])
    return rows.mapInArrow(_distinct_tokens(to_arrow_schema(schema)), schema)


def _variants(folded):
    """The string and all strings with one character left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(folded)), lambda i: F.concat(
        F.substr(folded, F.lit(1), i - 1), F.substr(folded, i + 1, F.length(folded))))
    return F.array_distinct(F.array_append(cut, folded))


def _spans(length, edits):
    """``edits`` + 1 parts (part, at, to) of a string of this length."""
    cut = lambda i: F.round(i * length / (edits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(i.alias("part"), cut(i).alias("at"), cut(i + 1).alias("to")))


def _by_parts(tokens_: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of a token and a long name of about its length that share a part of the name, shifted by the allowed edits at most.

    d edits leave one of d + 1 parts unchanged, so no close pair is missed.
    """
    edits = F.floor((F.col("nl") + 1) * (1 - LONG_LIMIT) + 1e-9).cast("int")
    named = long.withColumn("d", edits).select("*", F.explode(_spans(F.col("nl"), F.col("d"))).alias("s"))
    named = named.withColumn("piece", F.substr("fn", F.col("s.at") + 1, F.col("s.to") - F.col("s.at"))).withColumn("part", F.col("s.part")).drop("s", "d")
    seen = tokens_.select("*", F.explode(F.sequence(F.col("tl") - 1, F.col("tl") + 1)).alias("nl")).where(F.col("nl") >= LONG).withColumn("d", edits)
    seen = seen.select("*", F.explode(_spans(F.col("nl"), F.col("d"))).alias("s")).select("*", F.explode(F.sequence(-F.col("d"), F.col("d"))).alias("shift"))
    seen = seen.where(F.col("s.at") + F.col("shift") >= 0).select(
        "token", "ft", "tl", "nl", F.col("s.part").alias("part"), F.substr("ft", F.col("s.at") + F.col("shift") + 1, F.col("s.to") - F.col("s.at")).alias("piece"))
    return seen.join(named, ["nl", "part", "piece"]).drop("part", "piece")


#: From this many characters on a name allows more than one edit, at this similarity.
LONG, LONG_LIMIT = 14, 0.86


def fuzzy_tokens(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name, score, exact) above the name's threshold, over distinct tokens.

    Names below 14 characters allow one edit: two such strings share a one-deletion variant, so an
    equi join on variants finds every pair. Longer names are joined by unchanged parts.
    """
    t = vocabulary.select("token").distinct().withColumn("ft", tx.fold_confusable(F.col("token"))).withColumn("tl", F.length("token"))
    n = (names.select("name", tx.ascii_key(F.col("name")).alias("key")).withColumn("nl", F.length("key")).where("nl > 2")
         .withColumn("fn", tx.fold_confusable(F.col("key"))).withColumn("limit", tx.name_threshold(F.col("nl"))).distinct())
    short, long = n.where(F.col("nl") < LONG), n.where(F.col("nl") >= LONG)
    # lengths differ by one at most: longer tokens have no variant to share
    by_variant = (t.where(F.col("tl") <= LONG).withColumn("v", F.explode(_variants(F.col("ft"))))
                  .join(short.withColumn("v", F.explode(_variants(F.col("fn")))), "v").drop("v"))
    pairs = by_variant.unionByName(_by_parts(t, long).select(*by_variant.columns)).distinct()
    exact = F.col("ft") == F.col("fn")
    close = (F.col("nl") >= 4) & (F.abs(F.col("nl") - F.col("tl")) <= 1)
    score = F.when(exact, 0.995).when(close, tx.similarity(F.col("ft"), F.col("fn")))
    return pairs.select("token", "name", score.alias("score"), exact.alias("exact"), "limit").where("score >= limit").drop("limit")


def fuzzy_token_match(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Best token per (document, name). The vocabulary is written, as short and long names read it, and matched once. Its hits
    are written too: they are few, so that the tokens of all documents need not move to be joined with them."""
    t = tokens(texts)
    vocabulary = materialize(t.select("token").distinct(), run_dir(texts.sparkSession, "vocabulary"))
    hits = materialize(fuzzy_tokens(vocabulary, names), run_dir(texts.sparkSession, "hits"))
    return t.join(hits, "token").groupBy("doc_id", "name").agg(
        F.max("score").alias("score"), F.max(F.col("exact").cast("long")).alias("exact"))


def phrase_targets(aliases: dict[str, list[str]], threshold: float) -> list[tuple]:
    """(label, key, minimum score, order, edits allowed, parts) per alias."""
    rows = []
    for label, names in aliases.items():
        for name in names:
            key = "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
            limit = 0.99 if len(key) <= 3 else threshold
            rows.append((label, key, limit, len(rows), tx.edits_allowed(len(key), limit), tx.pieces(key, limit)))
    return rows


#: Codes of the letters and digits that stand in keys; 0 is what is left out, and what stands between lines.
KEY_CODES = np.array([KEY_BYTES[b] * (KEY_BYTES[b] != 32) for b in range(256)], np.uint8)
#: The letters outside ASCII whose small letter is one of ASCII.
OTHER_LETTERS = {"\u212a": "k", "\u0130": "i"}
#: Bytes of lines that are matched at once, and stretches of them that are read side by side.
CHUNK_BYTES, LANES = 4_000_000, 16_384


def _coded(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of lines without nulls, one behind the other with a 0 after each, and the line of every code."""
    for other, small in OTHER_LETTERS.items():
        if pc.any(pc.match_substring(lines, other)).as_py():
            lines = pc.replace_substring(lines, other, small)
    lines = lines.cast(pa.binary()).cast(pa.large_binary())
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int64)[lines.offset:lines.offset + len(lines) + 1]
    codes = KEY_CODES.take(np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]])
    of = np.repeat(np.arange(len(lines)), np.diff(at))
    kept = np.flatnonzero(codes)
    out = np.zeros(len(kept) + len(lines), np.uint8)
    of = of[kept]
    out[np.arange(len(kept)) + of] = codes[kept]
    return out, np.repeat(np.arange(len(lines)), np.bincount(of, minlength=len(lines)) + 1)


def _edits(key: bytes, steps: Iterator[np.ndarray], lanes: int, anywhere: bool) -> Iterator[np.ndarray]:
    """After every step the edits between ``key`` and what each lane has read: from its start, or with ``anywhere`` from the best place in it.

    ``steps``: one code per lane. A column of the table of edits is kept as two words of bits, where it rises and where it falls (Myers 1999).
    """
    size = len(key)
    kind = next((t for t in (np.uint16, np.uint32, np.uint64) if size <= np.dtype(t).itemsize * 8), None)
    if kind is None:
        column = np.repeat(np.arange(size + 1, dtype=np.int32)[:, None], lanes, axis=1)
        for code in steps:
            before, column = column, np.empty_like(column)
            column[0] = 0 if anywhere else before[0] + 1
            for i, k in enumerate(key, 1):
                column[i] = np.minimum(np.minimum(before[i], column[i - 1]) + 1, before[i - 1] + (code != k))
            yield column[size]
        return
    table = np.zeros(256, kind)
    for i, k in enumerate(key):
        table[k] |= kind(1 << i)
    top, one, first = kind(1 << size - 1), kind(1), kind(0 if anywhere else 1)
    rises, falls = np.full(lanes, np.iinfo(kind).max, kind), np.zeros(lanes, kind)
    edits = np.full(lanes, size, np.int32)
    same, x, up, down = (np.empty(lanes, kind) for _ in range(4))
    for code in steps:
        table.take(code, out=same, mode="clip")
        np.bitwise_and(same, rises, out=x)
        x += rises
        x ^= rises
        x |= same
        np.bitwise_or(x, rises, out=up)
        np.invert(up, out=up)
        up |= falls
        np.bitwise_and(rises, x, out=down)
        edits += (up & top) != 0
        edits -= (down & top) != 0
        up <<= one
        up |= first
        down <<= one
        same |= falls
        np.bitwise_or(same, up, out=rises)
        np.invert(rises, out=rises)
        rises |= down
        np.bitwise_and(up, same, out=falls)
        yield edits


def _ends(key: bytes, codes: np.ndarray, most: int) -> np.ndarray:
    """Places where a stretch of the codes ends that is within ``most`` edits of ``key``, perhaps across lines."""
    lead = len(key) + most  # such a stretch is not longer
    width = max(4 * lead, -(-len(codes) // LANES))
    lanes = -(-len(codes) // width)
    padded = np.zeros(lanes * width + lead, np.uint8)
    padded[lead:lead + len(codes)] = codes
    across = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width + lead)[::width].T)
    found = [np.empty(0, np.intp)]
    for step, edits in enumerate(_edits(key, (c.astype(np.intp) for c in across), lanes, True)):
        if step >= lead:
            near = edits <= most
            if near.any():
                found.append(np.flatnonzero(near) * width + step - lead)
    ends = np.concatenate(found)
    return ends[ends < len(codes)]


def _scores(key: bytes, limit: float, most: int, codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per line 0.99 if ``key`` is in it, else the best similarity to one of its windows that has about the key's size."""
    best = np.zeros(n)
    if not key:
        return np.full(n, 0.99)
    ends = _ends(key, codes, most)
    for size in (len(key) - 1, len(key), len(key) + 1):
        starts = ends - size + 1
        ok = (starts >= 0) & (size > (1 if size != len(key) else 0))
        last, starts = ends[ok], starts[ok]
        inside = (codes[last] != 0) & (of[starts] == of[last])
        last, starts = last[inside], starts[inside]
        if len(last):
            *_, edits = _edits(key, (codes[starts + i].astype(np.intp) for i in range(size)), len(starts), False)
            score = np.where((edits <= most) & ((size > 1) | (edits == 0)), 1 - edits / max(size, len(key)), 0.0)
            np.maximum.at(best, of[last], score)
    best[best == 1.0] = 0.99  # the key itself
    return best


def _best_phrases(groups: dict[str | None, list[tuple]], column: int, longer_first: bool, schema: pa.Schema):
    def found(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        rows = rows.filter(pc.is_valid(rows.column(column)))
        if not len(rows):
            return
        codes, of = _coded(pa.concat_arrays(rows.column(column).cast(pa.string()).chunks))
        for kind, targets in groups.items():
            best, size, which = np.zeros(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
            for i, (_, key, limit, _, most, _) in sorted(enumerate(targets), key=lambda t: t[1][3]):
                score = _scores(key.encode(), limit, most, codes, of, len(rows))
                own = len(key) if longer_first else 0
                better = (score >= limit) & ((which < 0) | (score > best) | ((score == best) & (own > size)))
                best[better], size[better], which[better] = score[better], own, i
            at = np.flatnonzero(which >= 0)
            if len(at):
                out = rows.take(pa.array(at))
                extra = [] if kind is None else [pa.array([kind] * len(at), pa.string())]
                extra += [pa.array([t[0] for t in targets], pa.string()).take(pa.array(which[at])), pa.array(best[at])]
                yield from pa.Table.from_arrays([*out.columns, *extra], schema=schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from found(waiting)
                waiting, size = [], 0
        if waiting:
            yield from found(waiting)

    return run


def _phrases(lines: DataFrame, groups: dict[str | None, list[tuple]], line: str, longer_first: bool) -> DataFrame:
    spread = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = [] if None in groups else [StructField("kind", StringType())]
    schema = StructType([*lines.schema.fields, *kind, StructField("label", StringType()), StructField("score", DoubleType())])
    return spread.mapInArrow(_best_phrases(groups, lines.columns.index(line), longer_first, to_arrow_schema(schema)), schema)


def fuzzy_phrase_match(lines: DataFrame, targets: list[tuple], line: str = "line", longer_first: bool = True) -> DataFrame:
    """Best target per line: a contained phrase scores 0.99, else the best window similarity.

    Of equal scores the longer phrase wins if ``longer_first``, then the one listed first.
    Lines are spread first: few bytes of text are much work. A task reads the keys of many lines side by side, one code of each a
    step, and keeps where a stretch ends that is within the edits allowed of a target; only windows that end there are compared.
    """
    return _phrases(lines, {None: targets}, line, longer_first)


def title_match(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, label, score): the best title of every kind in the first line of a text, from TITLE_LIMIT on.

    Titles are looked for as phrases, of all kinds in one pass; one of fewer than two letters or digits matches nothing.
    """
    first = texts.select(*keys, F.get(F.split(text, "\n"), F.lit(0)).alias("line"))
    groups = {kind: [t for t in phrase_targets({t: [t] for t in titles}, tx.TITLE_LIMIT) if len(t[1]) > 1] for kind, titles in tx.TITLES.items()}
    return _phrases(first, groups, "line", longer_first=False).select(*keys, "kind", "label", "score")


def extract_measures(lines: DataFrame, line: str = "line") -> DataFrame:
    c = F.col(line)
    return lines.select("*", tx.percentage(c).alias("percent"), tx.tier_number(c).alias("tier"), tx.trait_of(c).alias("trait"))


DETAILS = ("tier", "trait", "trait_bonus")


def _kept_readings(keys: list[str], columns: list[str], gap: float):
    """Fold readings sorted by keys and slot; only the kept readings of the current key are in memory."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept, out = None, [], []

        def finished() -> list[tuple]:
            return [(*current, r["multiplier"], r["slot"], *[r[c] for c in DETAILS], r["confidence"], r["readings"]) for r in kept]

        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    out += finished() if kept else []
                    current, kept = key, []
                m = row["multiplier"]
                row["readings"] = 1
                at = next((i for i, r in enumerate(kept) if m is not None and r["multiplier"] is not None and abs(r["multiplier"] - m) <= gap), None)
                if at is None:
                    kept.append(row)
                    continue
                held = kept[at]
                detail = [sum(r[c] is not None for c in DETAILS) for r in (row, held)]
                better = (row["confidence"] or 0) > (held["confidence"] or 0) or detail[0] > detail[1]
                first, second = (row, held) if better else (held, row)
                filled = {c: second[c] if first[c] is None else first[c] for c in DETAILS}
                kept[at] = first | filled | {"slot": min(held["slot"], row["slot"]), "readings": held["readings"] + 1}
            yield pd.DataFrame(out, columns=columns, dtype=object)
            out = []
        yield pd.DataFrame(finished() if kept else [], columns=columns, dtype=object)

    return fold


def dedupe_readings(readings: DataFrame, keys: list[str], gap: float = 5) -> DataFrame:
    """The readings kept of every key: a reading whose multiplier is within ``gap`` of a kept one is merged into it.

    Readings come in order of ``slot``. The more confident or more detailed one of the two keeps its values, its gaps
    are filled from the other, and the lower slot stays; later readings are compared with what was kept. The rule
    depends on the order, so a key is one sequence: its rows are streamed through one task, sorted on disk where
    they are many, and only the kept readings are held. Null multipliers match nothing.
    """
    numbers = ["multiplier", "slot", *DETAILS, "confidence"]
    rows = readings.select(*keys, *numbers)
    schema = rows.schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", readings long"
    order = rows.repartition(*keys).sortWithinPartitions(*keys, "slot", "multiplier", F.desc("confidence"))
    return order.mapInPandas(_kept_readings(keys, [*keys, *numbers, "readings"], gap), schema)
