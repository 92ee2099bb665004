"""Phrase matching against plain comparisons with every window."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contestry.functions import text as tx
from contestry.operators import match


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_score(s, key):
    if key in s:
        return 0.99
    sizes = [n for n in (len(key) - 1, len(key), len(key) + 1) if 1 < n <= len(s)]
    return max((1 - distance(s[i:i + n], key) / max(n, len(key)) for n in sizes for i in range(len(s) - n + 1)), default=0.0)


def plain_best(s, targets, longer_first):
    scored = [(plain_score(s, key), len(key) if longer_first else 0, -order, label) for label, key, limit, order, _, _ in targets if plain_score(s, key) >= limit]
    return max(scored, default=None)


def odd_lines(keys, rows=100, seed=4):
    rng, out = random.Random(seed), ["", " ", "é-ß", "TOKENS", "WİNS", "wat", "chers", "wards" * 30]
    while len(out) < rows:
        word = list(rng.choice(keys))
        for _ in range(rng.randrange(5)):
            word[rng.randrange(len(word)):][:1] = []
            word.insert(rng.randrange(len(word) + 1), rng.choice("abcdes1 -É"))
        out.append("".join(rng.choice(["", "x ", "Some. ", "de"]) + rng.choice(["", "".join(word), "".join(word).upper()]) for _ in range(rng.randrange(4))))
    return out


KEYS = {"Kills": ["kills", "hero kills"], "Wins": ["wins", "w"], "Tokens": ["tokens"], "CS": ["cs"], "Watchers": ["watchers taken", "watchers"],
        "Two words": ["kxlls"], "Long": ["abcdefghijklmnopqrstuvwxyz" * 3], "Middle": ["observer wards planted observer"]}


@pytest.mark.parametrize("longer_first", [True, False])
@pytest.mark.parametrize("threshold", [0.72, 0.58, 0.2])
def test_best_phrase_of_every_line(spark, threshold, longer_first):
    targets = match.phrase_targets(KEYS, threshold)
    lines = odd_lines([k for _, k, *_ in targets])
    df = spark.createDataFrame([*((i, x) for i, x in enumerate(lines)), (-1, None)], "id int, line string")
    keys = {r.id: r.s for r in df.select("id", tx.ascii_key(F.col("line")).alias("s")).collect()}
    got = {r.id: (r.score, r.label) for r in match.fuzzy_phrase_match(df, targets, longer_first=longer_first).collect()}
    want = {i: plain_best(s, targets, longer_first) for i, s in keys.items() if s is not None}
    assert got == {i: (w[0], w[3]) for i, w in want.items() if w}
    assert len(got) > 25


def test_keys_of_lines_are_the_keys_of_the_column(spark):
    lines = [*odd_lines(["kills", "tokens"]), "".join(map(chr, range(1, 0x600))), "KİıſẞＡ"]
    codes, of = match._coded(pa.array(["cut off", *lines], pa.string())[1:])
    ours = [bytes(codes[of == i]).decode() for i in range(len(lines))]
    theirs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, line string").orderBy("id").select(tx.ascii_key(F.col("line"))).collect()
    assert ours == [r[0] + "\0" for r in theirs]


def test_places_where_close_stretches_end():
    codes = np.frombuffer(b"xxkilsxx\0abkillsab\0" * 50, np.uint8)
    ends = match._ends(b"kills", codes, 1)
    want = [e for e in range(len(codes)) if min(distance(bytes(codes[max(0, e + 1 - n):e + 1]), b"kills") for n in range(4, 7)) <= 1]
    assert sorted(ends) == want and len(want) == 50 * 4


def test_titles_of_all_kinds_are_found_in_one_pass(spark):
    texts = spark.createDataFrame([(1, "Crimsen the Luckie\nRoyal"), (2, "nothing"), (3, None), (4, "GOLDEN")], "id int, text string")
    out = match.title_match(texts, ["id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.id, r.kind, r.label) for r in out.collect()} == {(1, "prefix", "Crimson"), (1, "suffix", "the Lucky"), (4, "prefix", "Golden")}
