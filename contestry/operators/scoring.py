"""Member scoring: points, profiles, titles, advice, series scores and leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestry.functions import rules
from contestry.operators import hot
from contestry.operators.project import STAT_COLUMNS, infer_role, position_label


def unpivot_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., metric, value), one row per rule."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c, _, _ in rules.STAT_RULES]
    return df.select(*keep, F.explode(F.array(*entries)).alias("v")).select(*keep, "v.*")


def stat_points(long: DataFrame) -> DataFrame:
    """Points of (metric, value) rows by the rules table; an unknown metric fails the job."""
    r = F.broadcast(rules.rules_table(long.sparkSession))  # eighteen rows
    j = long.join(r, "metric", "left")
    clipped = F.when(F.col("low").isNull(), F.col("value")).otherwise(F.least("high", F.greatest("low", "value")))
    points = F.when(F.col("slope").isNull(), F.raise_error(F.concat(F.lit("unknown metric "), "metric"))).otherwise(
        F.col("base") + F.col("slope") * clipped)
    return j.select(*long.columns, points.alias("points"))


def member_contests(members: DataFrame) -> DataFrame:
    """One row per (contest, member): defaults applied, the last slot wins where a member has two."""
    stats = [c for c in STAT_COLUMNS]
    packed = F.struct(*stats, "slot", "lane_role")
    m = (members.where(F.col("member_id").isNotNull())
         .groupBy("contest_id", "member_id", "ts", "series_id", "duration", "pool").agg(F.max_by(packed, "slot").alias("v")))
    filled = [F.coalesce(F.col(f"v.{c}").cast("double"), F.lit(0.0)).alias(c) for c in stats]
    return (m.select("contest_id", "member_id", "ts", "series_id", "duration", "pool", F.col("v.lane_role").alias("lane_role"), *filled)
            .withColumn("creeps", F.col("last_hits") + F.col("denies")))


def member_profile(rows: DataFrame, since: int, minimum: int = 3) -> DataFrame:
    """Averages, lane counts and last time per member with at least ``minimum`` contests since ``since``."""
    averages = [c for c in [*STAT_COLUMNS, "creeps"]]
    lanes = [F.sum((F.col("lane_role") == n).cast("long")).alias(f"{lane}_contests") for n, lane in ((1, "safe"), (2, "mid"), (3, "off"))]
    return (rows.where(F.col("ts") >= since).groupBy("member_id")
            .agg(F.count("*").alias("contests"), *[F.avg(c).alias(c) for c in averages], *lanes, F.max("ts").alias("last_ts"),
                 F.max("pool").alias("pool"))
            .where(F.col("contests") >= minimum))


def with_roles(profile: DataFrame, codes: Column, registered: Column) -> DataFrame:
    role = infer_role(codes, F.col("safe_contests"), F.col("mid_contests"), F.col("off_contests"),
                      F.col("gold_per_min"), F.col("wards"), F.col("last_hits"))
    role = F.when(registered == 2, "Mid").when(registered.isin(1, 3), "Core").when(registered.isNotNull(), "Support").otherwise(role)
    return profile.withColumn("role", role).withColumn(
        "position", position_label(F.col("role"), F.col("safe_contests"), F.col("off_contests"), registered))


def signal_index(profile: DataFrame) -> DataFrame:
    """Weighted composite scaled to 40..100 over all members."""
    raw = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in rules.SIGNAL_WEIGHTS.items()])
    scored = profile.withColumn("raw", raw)
    low, high = scored.agg(F.min("raw")).scalar(), scored.agg(F.max("raw")).scalar()
    return scored.withColumn(
        "signal", F.round(40.0 + 60.0 * (F.col("raw") - low) / F.greatest(high - low, F.lit(1e-9)), 1)).drop("raw")


def weighted_points(long_points: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of points x multiplier / 100 over the chosen (role, metric) rows; a best series is twice that."""
    j = long_points.join(weights, ["role", "metric"])
    return j.groupBy(*keys).agg(F.sum(F.col("points") * F.col("multiplier") / 100.0).alias("per_game")).withColumn(
        "best_series", F.col("per_game") * 2)


def flat_points(df: DataFrame, stage: str) -> DataFrame:
    """Preferred-metric points per row of a wide frame with ``role``; no unpivot."""
    total = None
    for role in rules.PATTERNS:
        value = reduce(lambda a, b: a + b, [rules.points_of(m) for m in rules.preferred_metrics(role, stage)])
        total = F.when(F.col("role") == role, value) if total is None else total.when(F.col("role") == role, value)
    return df.withColumn("per_game", total)


def expected_factor(titled: DataFrame, prefix_rates: DataFrame) -> DataFrame:
    """1 + prefix bonus x prefix rate + suffix bonus x activation chance."""
    j = titled.join(prefix_rates, ["member_id", "prefix"], "left")
    prefix = F.coalesce(F.col("prefix_bonus") / 100.0 * F.col("prefix_rate") / 100.0, F.lit(0.0))
    suffix = F.coalesce(F.col("suffix_bonus") / 100.0 * rules.suffix_activation(F.col("suffix")), F.lit(0.0))
    return j.select(*titled.columns, F.coalesce("prefix_rate", F.lit(0.0)).alias("prefix_rate"), (1 + prefix + suffix).alias("factor"))


def advice(emblems: DataFrame, stage_slots: int) -> DataFrame:
    """The rule of ``rules.ADVICE`` that applies to every emblem."""
    p = F.broadcast(rules.priority_table(emblems.sparkSession))  # forty-two rows
    bonus = F.element_at(F.array(*[F.lit(float(b)) for b in rules.TIER_BONUS]), (F.coalesce("tier", F.lit(0)) + 1).cast("int"))
    aim = F.when(F.col("tier").isNotNull(), 60.0 - bonus).otherwise(180.0 - F.col("multiplier"))
    j = emblems.join(p, ["role", "color", "metric"], "left").withColumns({
        "stage_slots": F.lit(stage_slots),
        "fit": F.coalesce(1 - F.col("place") / F.col("size") * 0.72, F.lit(0.2)),
        "quality": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("multiplier") - 100) / 200.0)),
        "gap": F.greatest(F.lit(0.0), aim)})
    j = j.withColumn("trait_fit", rules.first_fitting([(c, F.lit(v)) for c, v in rules.TRAIT_SCORES]))
    action = rules.first_fitting([(c, F.lit(a)) for c, a, _, _ in rules.ADVICE])
    priority = rules.first_fitting([(c, F.expr(v)) for c, _, v, _ in rules.ADVICE]).cast("long")
    uplift = rules.js_round(rules.first_fitting([(c, F.expr(v)) for c, _, _, v in rules.ADVICE]), 1)
    return j.select(*emblems.columns, action.alias("action"), priority.alias("priority"), uplift.alias("expected_uplift"))


def ranked_advice(advised: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Add ``rank`` within ``keys``: highest priority first, then highest uplift, then ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("priority"), F.desc("expected_uplift"), tie)
    return advised.withColumn("rank", F.row_number().over(w))


# --- groups of members -------------------------------------------------------------------------

def group_contests(rows: DataFrame, groups: DataFrame, values: list[str]) -> DataFrame:
    """Contests in which all members of a group appear, with the mean of each value over them.

    ``groups``: (group_id, member_id). Partial aggregation keeps a frequent member cheap.
    """
    sizes = groups.groupBy("group_id").agg(F.countDistinct("member_id").alias("size"))
    sized = groups.distinct().join(sizes, "group_id")
    j = rows.join(sized, "member_id")
    return (j.groupBy("group_id", "contest_id", "size")
            .agg(F.count("*").alias("_n"), F.max("ts").alias("ts"), F.max("series_id").alias("series_id"),
                 F.max("duration").alias("duration"), *[F.avg(v).alias(v) for v in values])
            .where(F.col("_n") == F.col("size")).drop("_n", "size"))


def conditional_bonus(scored: DataFrame, flag: Column, factor: float = rules.LUCKY_FACTOR) -> DataFrame:
    return scored.withColumn("bonus_points", F.when(flag, F.col("points") * factor).otherwise(F.col("points")))


def best_series(scored: DataFrame) -> DataFrame:
    """Per group: the best sum of a series' two highest contests, with counts.

    The top two per series are found by a limited rank before and after the shuffle.
    """
    w = Window.partitionBy("group_id", "series_id").orderBy(F.desc("bonus_points"), "contest_id")
    top = scored.where(F.col("series_id").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    series = top.groupBy("group_id", "series_id").agg(
        F.sum("points").alias("points"), F.sum("bonus_points").alias("bonus_points"))
    return series.groupBy("group_id").agg(
        F.max_by("series_id", F.struct(F.round("bonus_points", 6), -F.col("series_id"))).alias("best_series_id"),
        F.max(F.round("bonus_points", 6)).alias("best_points"), F.count("*").alias("series_scored"))


def series_scores(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("group_id", "series_id").orderBy(F.desc("points"), "contest_id")
    top = scored.where(F.col("series_id").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    return top.groupBy("group_id", "series_id").agg(F.sum("points").alias("score"), F.min("ts").alias("ts"))


def running_best(series: DataFrame, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """Highest series score of the group so far, in order of time."""
    s = hot.slice_hot_keys(series, ["group_id"], ["ts", "series_id"], hot_rows)
    w = Window.partitionBy("group_id", hot.SLICE).orderBy("ts", "series_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("group_id").orderBy(hot.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("_m", F.max("score").over(w))
    carry = hot.hot_slices(s).groupBy("group_id", hot.SLICE).agg(F.max("score").alias("_t")).select(
        "group_id", hot.SLICE, F.max("_t").over(before).alias("_c"))
    return hot.attach_carry(local, carry, ["group_id"]).select(*series.columns, F.greatest("_m", "_c").alias("best_so_far"))


def third_game_rate(contests: DataFrame, since: int) -> DataFrame:
    """Share of decided best-of-three series that needed a third contest; 0.4 when there is none."""
    per = (contests.where((F.col("series_type") == 1) & (F.coalesce("series_id", F.lit(0)) != 0) & (F.col("ts") >= since))
           .groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n").isin(2, 3)))
    third = F.sum((F.col("n") == 3).cast("double"))
    return per.agg(F.coalesce(third / F.when(F.count("*") > 0, F.count("*")), F.lit(0.4)).alias("rate"), F.count("*").alias("sample"))


def mixture_projection(summaries: DataFrame, weights: DataFrame, values: list[str]) -> DataFrame:
    """Sum over k of weight(k) x summary(k), per group."""
    j = summaries.join(weights, ["group_id", "k"])
    return j.groupBy("group_id").agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values])


# --- pools and leaderboards --------------------------------------------------------------------

def pool_percentile(df: DataFrame, group: list[str], value: str, lower_is_better: bool = False) -> DataFrame:
    """(rows of the pool at or below - 1) / (n - 1); nulls count as 0 in the pool and score 0.5."""
    filled = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    counts = hot.cumulative_counts(filled, group, "_v")
    raw = (F.col("n_le") - 1) / (F.col("n_all") - 1)
    raw = 1 - raw if lower_is_better else raw
    return filled.join(counts.select(*group, "_v", "n_le", "n_all"), [*group, "_v"]).select(
        *df.columns, F.when((F.col("n_all") < 2) | F.col(value).isNull(), 0.5).otherwise(raw).alias("percentile"))


def pool_minmax(long: DataFrame, group: list[str], value: str) -> DataFrame:
    """Min-max scaling within (role, metric): 0.5 where the value is missing or the range is flat."""
    span = long.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col(value).isNull() | (F.col("_lo") == F.col("_hi")), 0.5).otherwise(
        (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return long.join(span, group).select(*long.columns, scaled.alias("scaled"))


def blend_fit(fits: DataFrame, keys: list[str]) -> DataFrame:
    """0.7 guide + 0.3 pool percentile averaged over a member's metrics, in whole percent.

    The average is cut to six places first, so that the order of summation cannot move a half.
    """
    share = F.avg(0.7 * F.col("scaled") + 0.3 * F.col("percentile"))
    return fits.groupBy(*keys).agg(rules.js_round(F.round(share * 100, 6)).cast("long").alias("fit"))


def per_group_top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def role_leaders(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    return per_group_top_n(df, ["role"], [F.desc(score), F.asc(key)], n)


def metric_board(long: DataFrame, key: str) -> DataFrame:
    """Per (role, metric): median, upper quartile, the leading key and its peak."""
    q = hot.exact_quantiles(long, ["role", "metric"], "value", {"median": 0.5, "upper": 0.75})
    top = long.groupBy("role", "metric").agg(
        F.max_by(key, F.struct("value", -F.col(key))).alias("leader"), F.max("value").alias("peak"))
    return q.join(top, ["role", "metric"])


def _boards(leaders: DataFrame) -> DataFrame:
    """The three short role boards as arrays in one row."""
    pick = lambda r: F.collect_list(F.when(F.col("role") == r, F.struct("entity", "score")))
    return leaders.agg(pick("Core").alias("cores"), pick("Mid").alias("mids"), pick("Support").alias("supports"))


def _combinations(leaders: DataFrame) -> DataFrame:
    return (_boards(leaders).select(F.explode("cores").alias("c"), "mids", "supports")
            .select("c", F.explode("mids").alias("m"), "supports").select("c", "m", F.explode("supports").alias("s"))
            .select(F.col("c.entity").alias("core"), F.col("m.entity").alias("mid"), F.col("s.entity").alias("support"),
                    F.round(F.col("c.score") + F.col("m.score") + F.col("s.score"), 6).alias("expected")))


def combo_top_n(scores: DataFrame, n: int = 10) -> DataFrame:
    """Best ``n`` line-ups of one core, mid and support.

    A combination among the best n uses nobody ranked below n in their role, so the boards are cut
    to n first and the product is n ** 3 rows whatever the input size.
    """
    best = per_group_top_n(scores, ["role"], [F.desc("score"), F.asc("entity")], n)
    order = [F.desc("expected"), F.asc("core"), F.asc("mid"), F.asc("support")]
    top = _combinations(best).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def combo_constrained(scores: DataFrame, current: tuple, current_score: float, board: int = 16) -> DataFrame:
    """Best line-up of three different entities other than ``current``, and its gain."""
    best = per_group_top_n(scores, ["role"], [F.desc("score"), F.asc("entity")], board)
    ok = (F.col("core") != F.col("mid")) & (F.col("core") != F.col("support")) & (F.col("mid") != F.col("support"))
    same = (F.col("core") == current[0]) & (F.col("mid") == current[1]) & (F.col("support") == current[2])
    top = _combinations(best).where(ok & ~same).orderBy(F.desc("expected"), "core", "mid", "support").limit(1)
    return top.withColumn("improvement", F.round(F.col("expected") - current_score, 6))
