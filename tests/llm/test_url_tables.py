import math
from collections import Counter

import pytest

from contestry.llm import url_filter


def pages(spark, hosts):
    """Every word of the hosts stands in a page, many words once."""
    rows = [(i, f"http://{h}/{p}", f"<p>{words}</p>") for i, (h, p, words) in enumerate(hosts)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


HOSTS = [("greencasino.org", "a/1", "green casino"), ("redcasino.org", "b", "red casino"), ("redhouse.org", "b", "red house"), ("greenhouse.org", "c/Rare", "green house"),
         ("zebrahouse.org", "c", "zebra house"), ("zebrahouse.org", "c", "zebra " * 9), ("greencasino.org", "z/x", "filler"), ("", "", "")]


def expected(hosts):
    """Odds of every (host, path) with all words and all tokens, by a plain loop."""
    counts = Counter(w for *_, words in hosts for w in words.split())
    model = url_filter.Segmenter(dict(counts))
    own = [([w for part in h.split(".") if part for w in model.split(part)], [x.lower() for x in p.split("/") if x]) for h, p, _ in hosts]
    own = [["h:" + w for w in h] + ["p:" + ("0" if w.isdigit() else w) for w in p] for h, p in own]
    bad = [any(t[2:] in url_filter.SEEDS for t in tokens if t[0] == "h") for tokens in own]
    side = {k: Counter(t for tokens, x in zip(own, bad) if x == k for t in tokens) for k in (True, False)}
    v = len(side[True] | side[False])
    of = lambda t: math.log((side[True][t] + 1) / (side[True].total() + v + 1)) - math.log((side[False][t] + 1) / (side[False].total() + v + 1))
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    return [prior + sum(map(of, tokens)) for tokens in own]


@pytest.mark.parametrize("hot", [1, 20_000])
def test_every_word_and_token_counts(spark, monkeypatch, hot):
    """Sums over all words and tokens, with one or all frequent keys joined in place."""
    monkeypatch.setattr(url_filter, "HOT", hot)
    got = {r.page_id: r.odds for r in url_filter.judge(pages(spark, HOSTS)).collect()}
    assert len(got) == len(HOSTS) and all(math.isclose(got[i], x, abs_tol=1e-9) for i, x in enumerate(expected(HOSTS)))


def test_words_of_any_rank_split(spark):
    """A word behind 60,000 more frequent ones still splits a host."""
    rare = [("filler.org", "", " ".join(f"q{a}{b}{c}{d}" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz")) for a in "abcd"]
    rare = [(h, p, f"{words} {words}") for h, p, words in rare]
    words = pages(spark, [*rare, ("x.org", "", "zyzzyva walrus")]).select("html").mapInArrow(url_filter._counted(url_filter._page_words), "word string, n long").groupBy("word").sum("n").toDF("word", "n")
    assert words.count() > 60_000
    got = url_filter.host_tokens(spark.createDataFrame([("zyzzyvawalrus.x",), ("",)], "host string"), words).collect()
    assert {r.host: r.tokens for r in got} == {"zyzzyvawalrus.x": ["zyzzyva", "walrus", "x"], "": []}


def test_hosts_of_letters_and_digits_split(spark):
    """Seeds are found inside runs of letters next to digits, and such pages teach the unwanted side."""
    hosts = [("bet365casino.net", "bet casino"), ("casino24.net", "casino"), ("xxxporn4u.net", "porn"), ("garden24.org", "garden")] + [("garden.org", "garden")] * 5
    found = url_filter.judge(pages(spark, [(h, "q", w) for h, w in hosts])).collect()
    odds = {r.host: r.odds for r in found}
    assert all(odds[h] > 0 for h, _ in hosts[:3]) and odds["garden.org"] < 0
    words = spark.createDataFrame([("bet", 9), ("casino", 9), ("porn", 9), ("filler", 10**6)], "word string, n long")
    tokens = {r.host: r.tokens for r in url_filter.host_tokens(spark.createDataFrame([(h,) for h, _ in hosts[:3]], "host string"), words).collect()}
    assert tokens["bet365casino.net"][:3] == ["bet", "0", "casino"] and tokens["casino24.net"][:2] == ["casino", "0"] and tokens["xxxporn4u.net"][:2] == ["xxx", "porn"]
