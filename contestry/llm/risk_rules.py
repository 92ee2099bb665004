"""Quality rules whose cutoffs come from labelled holdouts with a risk guarantee.

Each metric has a fixed chain of cutoffs from lenient to strict. On labelled good documents that the
base rules keep, the exact binomial test asks for every stratum, metric and cutoff whether the share of
good documents beyond the cutoff is at most RISK / number of metrics. A chain is walked from its lenient
end and stops at its first cutoff that is not certified (fixed-sequence testing); chains share the
error DELTA by Bonferroni over strata and metrics. So with probability 1 - DELTA the rules reject at most
RISK of the good documents of every stratum. A stratum with too few labels certifies nothing and rejects
nothing. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from contestry.llm.common import SPACE, fresh, query, spool, table

RISK, DELTA = 0.05, 0.05
FEW = 500_000
#: Cutoffs from lenient to strict; a document is beyond a cutoff if its metric is larger.
CHAINS = {
    "symbol_rate": (3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "upper_rate": (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, by 64-bit hashes of the windows."""
    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(-5).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(5), p - a["at"])).alias("n"))
        return F.aggregate(_let(placed, places), start, step, lambda a: a["n"])

    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 5), window)
    some = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= 5, some).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str = "text", out: str = "_q") -> DataFrame:
    """``docs`` with a struct ``out`` of the base counts, base_failed and the metrics.

    Null text counts as empty: all counts are zero and the base rules reject it.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n = F.size(words).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            _repeat_words(words).alias("n_repeat_words"))

    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    counted = docs.withColumn(out, _let(words, of))
    q = lambda c: F.col(f"{out}.{c}")
    rate = lambda a, b: q(a) / F.greatest(q(b), F.lit(1))
    return counted.withColumn(out, F.struct(
        *[q(c).alias(c) for c in BASE],
        ((q("n_words") < 10) | (100 * q("n_repeat_words") > 20 * q("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbol_rate"), rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate")))


def _tail(n: Column, k: Column, p: Column) -> Column:
    """P(X <= k) of a binomial of n draws with chance p, summed term by term in logarithms."""
    odds = F.log(p) - F.log1p(-p)
    start = F.struct((n * F.log1p(-p)).alias("t"), F.exp(n * F.log1p(-p)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    return F.when(k <= 0, F.exp(n * F.log1p(-p))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda a: a["s"]))


def certified(good: DataFrame, strata: int, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): one row per stratum, with a struct of the strictest certified cutoff per metric.

    ``good`` has a column ``stratum`` (``strata`` different values) and one per metric, a row per labelled
    good document. A metric without a certified cutoff is null in ``cuts``.
    """
    share, names = risk / len(CHAINS), list(CHAINS)
    beyond = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(j).alias("level"), F.lit(c).alias("cut"), (F.col(m) > c).cast("long").alias("hit"))
                       for m in names for j, c in enumerate(CHAINS[m])])
    # sums per (stratum, metric, level) are taken before anything moves: 41 levels a stratum
    hits = good.select("stratum", F.explode(beyond).alias("b")).groupBy("stratum", "b.metric", "b.level", "b.cut").agg(F.count("*").alias("n"), F.sum("b.hit").alias("k"))
    # more hits than expected at that risk cannot pass; where Chernoff's bound of the tail is small enough already,
    # the sum of n * share terms at most is not needed
    n, k, level = F.col("n"), F.least("k", F.ceil(F.col("n") * share)), delta / (strata * len(names))
    apart = F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0) + (n - k) * F.log((n - k) / (n * (1 - share)))
    passes = (F.col("k") <= n * share) & ((F.exp(-apart) <= level) | (_tail(n, k, F.lit(share)) <= level))
    chain = Window.partitionBy("stratum", "metric").orderBy("level")
    held = hits.withColumn("ok", F.min(passes.cast("int")).over(chain)).where("ok = 1")
    best = held.groupBy("stratum").pivot("metric", names).agg(F.min("cut"))
    return best.select("stratum", F.struct(*[F.col(m) for m in names]).alias("cuts"))


def cutoffs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, cuts) of all labelled documents; every language that has a good one is a stratum of its own.

    ``rows``: doc_id, lang and the struct _q of ``measured``. A document is good if all its labels say
    quality 1; labels without an id or quality count for nothing.
    """
    good = _good(labels)
    rows = rows.where("not _q.base_failed").select("doc_id", _stratum("lang").alias("stratum"), *[F.col(f"_q.{m}") for m in CHAINS])
    rows = spool(rows.join(good, "doc_id", "left_semi").drop("doc_id"), "labelled")
    return spool(certified(rows, max(1, rows.select("stratum").distinct().count())), "cutoffs")


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def _narrow(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{stratum_col}`").alias("lang"))
    return measured(rows).drop("text")


def _applied(rows: DataFrame, cuts: DataFrame, stratum_col: str, q: str, kept: str) -> DataFrame:
    """``rows`` with ``kept``. A language without cutoffs has none applied."""
    stratum, cut = fresh(rows, "_stratum", "_cuts")
    rows = rows.withColumn(stratum, _stratum(stratum_col))
    rows = rows.join(cuts.select(F.col("stratum").alias(stratum), F.col("cuts").alias(cut)), stratum, "left")
    rejected = F.col(f"{q}.base_failed")
    for m in CHAINS:
        rejected = rejected | F.coalesce(F.col(f"{q}.{m}") > F.col(f"{cut}.{m}"), F.lit(False))
    return rows.withColumn(kept, ~rejected).drop(stratum, cut)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, lang, _q, _kept), a row per row of ``docs``: counts and metrics, and the verdict.

    Every row is judged on its own, so repeated rows, equal or null ids get equal verdicts. Without labels
    only the base rules reject.
    """
    rows = spool(_narrow(docs, id_col, text_col, stratum_col), "measured")
    return _applied(rows, cutoffs(rows, labels), "lang", "_q", "_kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Labelled good documents are measured for the cutoffs, then all documents where they are filtered: that costs less
    than moving texts to their verdicts. Up to FEW labels (8 bytes each) are broadcast, so that no other text is
    measured for the cutoffs; more labels are joined to the measures of all documents.
    """
    q, kept = fresh(docs, "_q", "_kept")
    good = spool(_good(labels), "good")
    taught = docs.join(F.broadcast(good.select(F.col("doc_id").alias(kept))), F.col(f"`{id_col}`") == F.col(kept), "left_semi") if good.count() <= FEW else docs
    found = cutoffs(_narrow(taught, id_col, text_col, stratum_col), labels)
    # measures come out of a generator: no later step can take them apart and compute them again
    rows = measured(docs, text_col, q).withColumn(q, F.explode(F.array(q)))
    return _applied(rows, found, stratum_col, q, kept).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _chains_sql() -> str:
    return ", ".join(f"('{m}', {j}, {c}::DOUBLE)" for m, cuts in CHAINS.items() for j, c in enumerate(cuts))


RULES_SQL = rf"""w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 4] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, gram)),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY 1),
b AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN rw USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_rate,
    n_upper / greatest(word_chars, 1) AS upper_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate FROM b),
gd AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
v AS (UNPIVOT (SELECT lang, doc_id, symbol_rate, upper_rate, repeat_rate, dup_line_rate FROM m SEMI JOIN gd USING (doc_id) WHERE NOT base_failed)
    ON symbol_rate, upper_rate, repeat_rate, dup_line_rate INTO NAME metric VALUE val),
h AS (SELECT lang, metric, level, cut, count(*) AS n, count(*) FILTER (val > cut) AS k
    FROM v JOIN (VALUES {_chains_sql()}) c(metric, level, cut) USING (metric) GROUP BY ALL),
t AS (SELECT *, k <= n * {RISK / len(CHAINS)} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(CHAINS)}) + (n - i) * ln(1 - {RISK / len(CHAINS)})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {DELTA} / ((SELECT count(DISTINCT lang) FROM h) * {len(CHAINS)}) AS ok FROM h),
p AS (SELECT lang, metric, cut, min(ok::INT) OVER (PARTITION BY lang, metric ORDER BY level) AS ok FROM t),
z AS (SELECT lang, metric, min(cut) AS cut FROM p WHERE ok = 1 GROUP BY 1, 2),
kept AS (SELECT m.*, NOT base_failed AND NOT EXISTS (SELECT 1 FROM z WHERE z.lang = m.lang AND CASE metric WHEN 'symbol_rate' THEN symbol_rate
    WHEN 'upper_rate' THEN upper_rate WHEN 'repeat_rate' THEN repeat_rate ELSE dup_line_rate END > cut) AS kept FROM m)"""


@query("op10_risk_rules", f"WITH {RULES_SQL} SELECT doc_id, {', '.join(BASE)}, base_failed, kept FROM kept")
def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"_q.{c}") for c in BASE], F.col("_q.base_failed"), F.col("_kept").alias("kept"))
