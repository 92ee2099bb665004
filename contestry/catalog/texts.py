from pyspark.sql import functions as F

from contestry.catalog.registry import query, rounded
from contestry.functions import text as tx
from contestry.operators import match
from contestry.sources import sample_tables as st

FOLD = "translate({0}, '1l0', 'iio')"
NAMES_SQL = """names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT lower(r_name) FROM region
  UNION SELECT lower(c_mktsegment) FROM customer UNION
  SELECT DISTINCT tok FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM benchmark))"""
TOKENS_SQL = """toks AS (SELECT DISTINCT doc_id, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS token FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_`\\[\\].-]*')) AS raw FROM documents))"""


def names(spark, d):
    words = st.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    more = st.table(spark, d, "region").select(F.lower("r_name")).union(st.table(spark, d, "customer").select(F.lower("c_mktsegment")))
    tokens = st.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("name"))
    return words.union(more).union(tokens).distinct()


@query("q_fuzzy_token_match", f"""WITH {NAMES_SQL}, {TOKENS_SQL},
n AS (SELECT name, {FOLD.format('name')} AS fn, length(name) AS nl FROM names WHERE length(name) > 2),
v AS (SELECT DISTINCT token, {FOLD.format('token')} AS ft, length(token) AS tl FROM toks),
s AS (SELECT token, name, nl, CASE WHEN ft = fn THEN 0.995e0 WHEN nl >= 4 AND abs(nl - tl) <= 1 THEN 1 - levenshtein(ft, fn) / greatest(nl, tl) END AS score, ft = fn AS exact FROM v, n
   WHERE abs(nl - tl) <= 1),
h AS (SELECT * FROM s WHERE score >= CASE WHEN nl <= 3 THEN 0.995e0 WHEN nl <= 5 THEN 0.79e0 WHEN nl <= 7 THEN 0.82e0 ELSE 0.86e0 END)
SELECT doc_id, name, round(max(score), 6) AS score, max(CASE WHEN exact THEN 1 ELSE 0 END) AS exact FROM toks JOIN h USING (token) GROUP BY 1, 2""")
def fuzzy_token_match(spark, d):
    return rounded(match.fuzzy_token_match(st.table(spark, d, "documents").select("doc_id", "text"), names(spark, d)))


TARGETS = match.phrase_targets(tx.METRIC_ALIASES, 0.72)
TARGET_SQL = "targets AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{label}', '{key}', {limit}e0, {order})" for label, key, limit, order, _, _ in TARGETS) + ") t(label, key, lim, ord))"
LINES_SQL = """lines AS (SELECT conv_id, turn, n, line, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS s FROM (
  SELECT conv_id, turn, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)))"""


def lines(spark, d):
    return st.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query("q_fuzzy_phrase_match", f"""WITH {LINES_SQL}, {TARGET_SQL},
w AS (SELECT conv_id, turn, n, label, key, lim, ord, 1 - list_min(list_transform(range(1, length(s) - length(key) - e + 2),
    lambda i: levenshtein(substring(s, i, length(key) + e), key))) / greatest(length(key), length(key) + e) AS score
  FROM lines, targets, (VALUES (-1), (0), (1)) x(e) WHERE length(key) + e > 1 AND length(s) >= length(key) + e AND NOT contains(s, key)
  UNION ALL SELECT conv_id, turn, n, label, key, lim, ord, 0.99e0 FROM lines, targets WHERE contains(s, key)),
b AS (SELECT conv_id, turn, n, label, key, lim, ord, max(score) AS score FROM w GROUP BY ALL)
SELECT conv_id, turn, n, label, round(score, 6) AS score FROM b WHERE score >= lim
QUALIFY row_number() OVER (PARTITION BY conv_id, turn, n ORDER BY score DESC, length(key) DESC, ord) = 1""")
def fuzzy_phrase_match(spark, d):
    return rounded(match.fuzzy_phrase_match(lines(spark, d), TARGETS).select("conv_id", "turn", "n", "label", "score"))


TITLE_SQL = "titles AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS key FROM (VALUES " + ", ".join(
    f"('{kind}', '{title}', {i})" for kind, titles in tx.TITLES.items() for i, title in enumerate(titles)) + ") t(kind, label, ord))"


@query("q_title_match", f"""WITH l AS (SELECT conv_id, turn, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', '', 'g') AS s FROM conversations), {TITLE_SQL},
w AS (SELECT conv_id, turn, kind, label, ord, 1 - list_min(list_transform(range(1, length(s) - length(key) - e + 2),
    lambda i: levenshtein(substring(s, i, length(key) + e), key))) / greatest(length(key), length(key) + e) AS score
  FROM l, titles, (VALUES (-1), (0), (1)) x(e) WHERE length(s) >= length(key) + e AND NOT contains(s, key)
  UNION ALL SELECT conv_id, turn, kind, label, ord, 0.99e0 FROM l, titles WHERE contains(s, key))
SELECT conv_id, turn, kind, label, round(score, 6) AS score FROM w WHERE score >= {tx.TITLE_LIMIT}
QUALIFY row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY round(score, 9) DESC, ord) = 1""")
def title_match(spark, d):
    return rounded(match.title_match(st.table(spark, d, "conversations"), ["conv_id", "turn"]))


READING_LINE = ("CASE xp_per_min % 6 WHEN 0 THEN 'Kills ' || CAST(100 + gold_per_min % 260 AS VARCHAR(9)) || '%' "
                "WHEN 1 THEN 'GPM ' || CAST(100 + gold_per_min % 260 AS VARCHAR(9)) || '9 Yo, seen' "
                "WHEN 2 THEN 'Stuns ' || CAST(10 + assists AS VARCHAR(9)) || '.' || CAST(10 + last_hits % 89 AS VARCHAR(9)) || '%' "
                "WHEN 3 THEN 'Tier ' || CAST(1 + kills % 7 AS VARCHAR(9)) || ' +' || CAST((1 + deaths) * 10 AS VARCHAR(9)) || '%' "
                "WHEN 4 THEN 'a tier' || CASE kills % 5 WHEN 0 THEN ' IV' WHEN 1 THEN ' !|' WHEN 2 THEN 'v' WHEN 3 THEN ' iii' ELSE ' none' END || ' Vampi-ric' "
                "ELSE 'Friendly Unique ' || CAST(gold_per_min AS VARCHAR(9)) END AS line")


FRONTS = "list_transform(string_split_regex(line, '{0}')[:-2], lambda x: regexp_replace(string_split(rtrim(x), ' ')[-1], '[^0-9]', '', 'g'))"


@query("q_extract_measures", f"""WITH {st.SQL_MEMBERS}, t AS (SELECT contest_id, slot, {READING_LINE} FROM members),
m AS (SELECT *, list_filter(list_transform(list_transform({FRONTS.format(tx.PERCENT_MARK)}, lambda x: TRY_CAST(x AS BIGINT)), lambda n: CASE WHEN n BETWEEN 100 AND 350 THEN n
    WHEN n % 10 IN (0, 9) AND n // 10 BETWEEN 100 AND 350 THEN n // 10 END), lambda n: n IS NOT NULL)[1] AS percent,
  coalesce({FRONTS.format('%')}[1], '') AS bonus, ltrim(lower(substring(translate(line, '1|!]', 'IIII'), strpos(lower(line), 'tier') + 4))) AS behind,
  regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS key FROM t)
SELECT contest_id, slot, percent, CASE WHEN contains(lower(line), 'tier') THEN
    CASE WHEN bonus LIKE '%100' THEN 4 WHEN bonus LIKE '%150' THEN 5 WHEN bonus LIKE '%10' THEN 1 WHEN bonus LIKE '%30' THEN 2 WHEN bonus LIKE '%60' THEN 3
      WHEN starts_with(behind, 'iii') THEN 3 WHEN starts_with(behind, 'ii') THEN 2 WHEN starts_with(behind, 'iv') THEN 4 WHEN starts_with(behind, 'i') THEN 1
      WHEN starts_with(behind, 'v') THEN 5 ELSE TRY_CAST(regexp_extract(behind, '^[1-5]') AS INT) END END AS tier,
  CASE WHEN contains(key, 'fractal') THEN 'Fractal' WHEN contains(key, 'friendly') THEN 'Friendly' WHEN contains(key, 'vampiric') THEN 'Vampiric'
    WHEN contains(key, 'unique') THEN 'Unique' WHEN contains(key, 'benevolent') THEN 'Benevolent' END AS trait FROM m""")
def extract_measures(spark, d):
    rows = st.members(spark, d).selectExpr("contest_id", "slot", READING_LINE)
    return match.extract_measures(rows).select("contest_id", "slot", "percent", "tier", "trait")


READINGS = ("coalesce(series_id, -1 - contest_id) AS source_id", "CAST(kills % 3 AS BIGINT) AS metric", "100 + gold_per_min % 60 AS multiplier", "slot * 10000000 + contest_id AS slot",
            "(xp_per_min % 90) / 100.0E0 AS confidence", "CASE WHEN kills % 4 = 0 THEN NULL ELSE 1 + kills % 5 END AS tier",
            "CASE WHEN deaths % 3 = 0 THEN NULL ELSE deaths END AS trait", "CASE WHEN assists % 2 = 0 THEN NULL ELSE assists * 5 END AS trait_bonus")


def _held(ours, theirs):
    """SQL of the merged reading of x (kept) and y (new) where p says whether the new one is preferred."""
    fills = [f"{c} := CASE WHEN {P} THEN coalesce({theirs}.{c}, {ours}.{c}) ELSE coalesce({ours}.{c}, {theirs}.{c}) END" for c in ("tier", "trait", "trait_bonus")]
    return (f"struct_pack(multiplier := CASE WHEN {P} THEN {theirs}.multiplier ELSE {ours}.multiplier END, slot := least({ours}.slot, {theirs}.slot), {', '.join(fills)}, "
            f"confidence := CASE WHEN {P} THEN {theirs}.confidence ELSE {ours}.confidence END, readings := {ours}.readings + 1)")


DETAIL = "(CASE WHEN {0}.tier IS NULL THEN 0 ELSE 1 END + CASE WHEN {0}.trait IS NULL THEN 0 ELSE 1 END + CASE WHEN {0}.trait_bonus IS NULL THEN 0 ELSE 1 END)"
P = f"(y[1].confidence > x.confidence OR {DETAIL.format('y[1]')} > {DETAIL.format('x')})"


@query("q_dedupe_readings", f"""WITH {st.SQL_MEMBERS}, r AS (SELECT {', '.join(READINGS)} FROM members),
g AS (SELECT source_id, metric, list([struct_pack(multiplier := multiplier, slot := slot, tier := tier, trait := trait, trait_bonus := trait_bonus, confidence := confidence, readings := 1::BIGINT)] ORDER BY slot) AS items
  FROM r GROUP BY 1, 2),
k AS (SELECT source_id, metric, unnest(list_reduce(items, lambda a, y: CASE WHEN len(list_filter(a, lambda x: abs(x.multiplier - y[1].multiplier) <= 5)) = 0 THEN a || y
    ELSE list_transform(a, lambda x, i: CASE WHEN i = list_position(list_transform(a, lambda z: abs(z.multiplier - y[1].multiplier) <= 5), true) THEN {_held('x', 'y[1]')} ELSE x END) END)) AS v FROM g)
SELECT source_id, metric, v.multiplier, v.slot, v.tier, v.trait, v.trait_bonus, v.confidence, v.readings FROM k""")
def dedupe_readings(spark, d):
    rows = st.members(spark, d).selectExpr(*READINGS)
    return match.dedupe_readings(rows, ["source_id", "metric"])


@query("q_text_keys", """SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS name_key, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS ascii_key FROM documents""")
def text_keys(spark, d):
    from contestry.operators.roster import name_key
    return st.table(spark, d, "documents").select("doc_id", name_key(F.col("text")).alias("name_key"), tx.ascii_key(F.col("text")).alias("ascii_key"))


@query("q_key_values", f"""WITH {st.SQL_MEMBERS}, e AS (SELECT member_id, item_id % 8 AS p, count(*) AS n FROM members GROUP BY 1, 2) SELECT member_id, p, CAST(n AS DOUBLE) AS rate FROM e""")
def key_values(spark, d):
    counts = st.members(spark, d).groupBy("member_id", (F.col("item_id") % 8).alias("p")).agg(F.count("*").alias("n"))
    packed = counts.groupBy("member_id").agg(F.array_join(F.collect_list(F.concat_ws(":", "p", "n")), ",").alias("listing"))
    return packed.select("member_id", F.explode(tx.key_values(F.col("listing"))).alias("p", "rate")).select(
        "member_id", F.col("p").cast("long").alias("p"), "rate")


HANDLE = "CASE member_id % 3 WHEN 0 THEN 'King-Jungles' WHEN 1 THEN 'MARL1NE.' ELSE 'Player ' || member_id END"


@query("q_handle_key", f"""WITH {st.SQL_MEMBERS}, h AS (SELECT DISTINCT member_id, {HANDLE} AS handle FROM members WHERE member_id IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(handle), '[^a-z0-9]', '', 'g') AS key FROM h)
SELECT member_id, CASE key WHEN 'kingjungles' THEN 'kj' WHEN 'marl1ne' THEN 'malr1ne' ELSE key END AS handle_key FROM k""")
def handle_key(spark, d):
    names = st.members(spark, d).where("member_id is not null").selectExpr("member_id", f"{HANDLE} AS handle").distinct()
    return names.select("member_id", tx.handle_key(F.col("handle")).alias("handle_key"))
