"""URL filter: listed rules first, then naive Bayes over the words of host and path.

Host names run words together. A unigram model of the pages' own words splits them (Viterbi), and
multinomial naive Bayes scores the words of host and path. Its training labels are weak: a page whose
segmented host has a word of SEEDS counts as unwanted, every other page as wanted; the model then learns
which further words go with these hosts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contestry.llm.common import as_bytes, query, slices, spool, table

#: (host, path, verdict) of the listed rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Words that mark a host as unwanted.
SEEDS = frozenset("adult ads bet bets betting casino cialis dating escort gambling jackpot loan loans lottery payday pills poker porn porno sex slots spam tracker viagra xxx".split())
#: Entries of a table that go to every task, the most frequent first; the others are looked up by a join.
HOT = 20_000
#: Words up to this length (at most 26 + 26^2 + 26^3) go to every task.
SHORT = 3
MAX_WORD = 24
#: Share of all words that a seed word has at least.
SEED_SHARE = 1e-6
WORD = re.compile(rb"[a-z]{1,%d}" % MAX_WORD)
MARKUP = re.compile(rb"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Entries a task counts before it passes its sums on.
FLUSH = 200_000


def _counted(words_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            keys = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in slices(batches, 200):
            words_of(counts, batch)
            if len(counts) > FLUSH:
                yield out()
        yield out()

    return run


def _page_words(counts: Counter, batch: pa.RecordBatch) -> None:
    for html in as_bytes(batch.column(0)):
        counts.update(w.decode() for w in WORD.findall(MARKUP.sub(b" ", html.lower())))


class Segmenter:
    """Most probable split of a run of letters under a unigram model; unknown words pay by length."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = max(1, sum(counts.values()) if total is None else total)
        counts = counts | {s: max(counts.get(s, 0), total * SEED_SHARE) for s in SEEDS}
        self.cost = {w: math.log10(total / c) for w, c in counts.items()}
        self.unknown = [math.log10(total / 10) + size for size in range(MAX_WORD + 1)]

    def split(self, text: str) -> tuple[str, ...]:
        best, step = [0.0], [0]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - MAX_WORD), end):
                word = text[start:end]
                options.append((best[start] + self.cost.get(word, self.unknown[end - start]), start))
            least, start = min(options)
            best.append(least)
            step.append(start)
        words, end = [], len(text)
        while end:
            words.append(text[step[end]:end])
            end = step[end]
        return tuple(reversed(words))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` and for null."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = url.isNotNull() & url.contains("://")
    lower = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, F.regexp_extract(url, shape, 2)).otherwise("")


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def looked_up(rows: DataFrame, entries: DataFrame, key: str | list[str], frequent: DataFrame) -> DataFrame:
    """``rows`` joined with ``entries`` on ``key``, whatever the size of either.

    ``frequent`` (key, n) tells how often ``rows`` has a key: the HOT most frequent are joined in place, so that
    every other key has at most a HOT-th of the rows.
    """
    keys = [key] if isinstance(key, str) else key
    top = spool(frequent.where("n > 1").orderBy(F.desc("n"), *keys).limit(HOT).select(*keys), "hot")
    placed = rows.join(F.broadcast(top.withColumn("hot", F.lit(True))), keys, "left")
    near, far = placed.where("hot").drop("hot"), placed.where("hot is null").drop("hot")
    return near.join(F.broadcast(entries.join(F.broadcast(top), keys, "left_semi")), keys).unionByName(far.join(entries, keys))


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        for text in batch.column(0).to_pylist():
            found = list({text[a:b] for a in range(len(text)) for b in range(a + 1, min(len(text), a + MAX_WORD) + 1)})
            for at in range(0, len(found), FLUSH):
                own = found[at:at + FLUSH]
                yield pa.RecordBatch.from_arrays([pa.array([text] * len(own), pa.string()), pa.array(own, pa.string())], names=["part", "word"])


def split_parts(letters: DataFrame, words: DataFrame) -> DataFrame:
    """(part, tokens): the distinct runs of letters ``part`` split under all ``words`` (word, n).

    A task sees of the words those that occur in its run.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = letters.mapInArrow(_substrings, "part string, word string")
    short = F.length("word") <= SHORT
    found = inside.where(short).join(F.broadcast(words.where(short)), "word").unionByName(inside.where(~short).join(words.where(~short), "word"))
    found = found.groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("own"))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([list(Segmenter({} if o is None else {x["word"]: x["n"] for x in o}, total).split(t)) for t, o in zip(texts, own)], dtype=object)

    return letters.join(found, "part", "left").select("part", split("part", "own").alias("tokens"))


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, tokens) of distinct hosts: the words of runs of letters; a run of digits is one token, 0."""
    own = F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), F.lit(0))
    placed = spool(hosts.select("host", F.posexplode_outer(own).alias("at", "part")), "host_parts")
    letter = F.col("part").rlike("^[a-z]+$")
    letters = spool(placed.where(letter).groupBy("part").agg(F.count("*").alias("n")), "letters")
    split = spool(split_parts(letters.select("part"), words), "split")
    found = looked_up(placed.where(letter), split, "part", letters).select("host", "at", "tokens")
    digits = F.when(F.col("part").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("0")))
    others = placed.where(F.col("part").isNull() | ~letter).select("host", "at", digits.alias("tokens"))
    rows = found.unionByName(others).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("x"))
    return rows.select("host", F.flatten("x.tokens").alias("tokens"))


def odds(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(host, path, n, odds) of the distinct (host, path) of ``urls``: log-odds of a page to be unwanted.

    Words, tokens and weights are tables of any size; every word and every token counts.
    """
    words = spool(pages.select("html").mapInArrow(_counted(_page_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # tokens carry a number in place of host and path, which may be long; it is fixed once written
    distinct = spool(urls.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("url", F.monotonically_increasing_id()), "urls")
    hosts = spool(distinct.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    of_host = spool(host_tokens(hosts.select("host"), words), "host_tokens")
    lower = F.filter(F.split(F.lower("path"), SPLIT.pattern), lambda x: x != "")
    of_path = F.transform(lower, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x)))
    found = looked_up(distinct, of_host, "host", hosts)
    unwanted = F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in sorted(SEEDS)]))
    found = spool(found.select("url", "host", "path", "n", unwanted.alias("unwanted"), F.concat(F.transform("tokens", lambda x: F.concat(F.lit("h:"), x)), of_path).alias("tokens")), "url_tokens")
    side = lambda yes: F.sum(F.when(F.col("unwanted") == yes, F.col("n")).otherwise(0))
    pages_b, pages_a = (x or 0 for x in found.agg(side(True), side(False)).first())
    each = found.select("url", "n", "unwanted", F.explode("tokens").alias("word"))
    tokens = spool(each.groupBy("word").agg(side(True).alias("b"), side(False).alias("a"), F.count("*").alias("n")), "tokens")
    v, b, a = (x or 0 for x in tokens.agg(F.count("*"), F.sum("b"), F.sum("a")).first())
    weights = tokens.select("word", (F.log((F.col("b") + 1) / F.lit(float(b + v + 1))) - F.log((F.col("a") + 1) / F.lit(float(a + v + 1)))).alias("w"))
    weighed = looked_up(each.select("url", "word"), weights, "word", tokens.select("word", "n"))
    # summed in one order, so that results do not depend on how rows arrive
    prior = F.lit(math.log((pages_b + 1) / (pages_a + 1)))
    sums = weighed.groupBy("url").agg(F.aggregate(F.array_sort(F.collect_list("w")), prior, lambda x, w: x + w).alias("odds"))
    return spool(found.select("url", "host", "path", "n").join(sums, "url", "left").drop("url").withColumn("odds", F.coalesce("odds", prior)), "odds")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, odds), a row per row of ``pages``.

    The verdict is the longest listed rule's, else block where the odds to be unwanted are above 0. A null
    url, or one without ``://``, has empty parts, no rule and the prior's verdict; null html teaches nothing.
    Repeated rows and equal or null ids are judged one by one and teach once each. Urls, hosts and pages of any
    length count whole; an empty table gives no rows. Other columns of ``pages`` are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    found = odds(pages.select(F.col(f"`{html_col}`").alias("html")), rows)
    rows = looked_up(rows, found.drop("n"), ["host", "path"], found.select("host", "path", "n"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "listed": verdict})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), "odds")


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("odds")
