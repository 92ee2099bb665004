"""Scoring rules and guide tables, with the expressions built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Metric, stat column, points at zero, points per unit.
STAT_RULES = [
    ("Kills", "kills", 0.0, 107.0),
    ("Deaths", "deaths", 1950.0, -195.0),
    ("Creeps", "creeps", 0.0, 3.0),
    ("GPM", "gold_per_min", 0.0, 2.0),
    ("Madstones", "madstones", 0.0, 13.0),
    ("Towers", "tower_kills", 0.0, 352.0),
    ("Wards", "wards", 0.0, 117.0),
    ("Camps stacked", "camps_stacked", 0.0, 234.0),
    ("Runes", "runes", 0.0, 141.0),
    ("Watchers", "watchers", 0.0, 147.0),
    ("Lotuses", "lotuses", 0.0, 176.0),
    ("Roshan", "roshan_kills", 0.0, 1172.0),
    ("Teamfight", "teamfight", 0.0, 2124.0),
    ("Stuns", "stuns", 0.0, 10.0),
    ("Tormentor", "tormentors", 0.0, 879.0),
    ("Courier kills", "courier_kills", 0.0, 703.0),
    ("First blood", "first_blood", 0.0, 1934.0),
    ("Smokes", "smokes", 0.0, 293.0),
]
# The only metric whose input is clipped, and its range.
CLIPPED = {"Teamfight": (0.0, 1.0)}

# Slot colours per role and stage.
STAGES = {"group": 0, "final": 1}
PATTERNS = {
    "Core": (["Red", "Green", "Red"], ["Red", "Green", "Red", "Green", "Red"]),
    "Mid": (["Red", "Blue", "Green"], ["Red", "Blue", "Green", "Red", "Green"]),
    "Support": (["Blue", "Green", "Blue"], ["Blue", "Green", "Blue", "Green", "Blue"]),
}
# Metrics by priority per role and colour.
PRIORITIES = {
    "Core": {
        "Red": ["Creeps", "GPM", "Deaths", "Towers", "Kills", "Madstones"],
        "Green": ["Teamfight", "Roshan", "Tormentor", "Stuns", "Courier kills", "First blood"],
    },
    "Mid": {
        "Red": ["Creeps", "GPM", "Deaths", "Kills", "Madstones", "Towers"],
        "Green": ["Teamfight", "Stuns", "Tormentor", "Roshan", "Courier kills", "First blood"],
        "Blue": ["Runes", "Camps stacked", "Lotuses", "Wards", "Smokes", "Watchers"],
    },
    "Support": {
        "Blue": ["Wards", "Smokes", "Lotuses", "Camps stacked", "Watchers", "Runes"],
        "Green": ["Teamfight", "Tormentor", "Courier kills", "Stuns", "First blood", "Roshan"],
    },
}
# Metrics counted for the projection of a role.
ROLE_METRICS = {
    "Core": ["Creeps", "GPM", "Teamfight"],
    "Mid": ["Creeps", "Runes", "Teamfight"],
    "Support": ["Wards", "Smokes", "Teamfight"],
}
# Chance that a suffix title is active; any other title, and no title.
SUFFIX_ACTIVATION = {
    "the lucky": 0.1, "the underdog": 0.44, "the clutch": 0.34, "the tormented": 0.04, "the cruel": 0.04,
    "the decisive": 0.05, "the flayed twins acolyte": 0.05, "the patient": 0.01,
}
OTHER_ACTIVATION = 0.08
# Weights of the signal index.
SIGNAL_WEIGHTS = {
    "kills": 1.0, "deaths": -0.45, "creeps": 0.004, "gold_per_min": 0.002, "tower_kills": 1.5, "roshan_kills": 2.0,
    "teamfight": 4.0, "wards": 0.35, "camps_stacked": 0.45, "runes": 0.15, "first_blood": 2.0, "stuns": 0.025,
    "smokes": 0.4, "tormentors": 1.5, "courier_kills": 1.0,
}
# Quality bonus in percent by tier 0 to 5.
TIER_BONUS = [0, 10, 30, 60, 100, 150]
LUCKY_FACTOR = 1.21
# Worth of a trait; the first condition that holds counts.
TRAIT_SCORES = [
    ("trait IS NULL", 0.45), ("trait_bonus >= 40", 0.92), ("trait_bonus > 0", 0.74), ("trait_bonus < 0", 0.12),
    ("trait = 'Friendly' AND trait_bonus = 0", 0.34), ("trait = 'Friendly' AND role = 'Core'", 0.46), ("trait = 'Friendly'", 0.82),
    ("trait = 'Vampiric' AND slot IN (1, stage_slots)", 0.9), ("trait = 'Vampiric'", 0.58),
    ("trait = 'Benevolent' AND slot = ceil(stage_slots / 2)", 0.86), ("trait = 'Benevolent'", 0.5), ("trait = 'Unique'", 0.42),
    ("true", 0.3),
]
# Advice; the first condition that holds counts. Action, priority, uplift before rounding to a tenth.
ADVICE = [
    ("fit < 0.55", "REROLL STAT", "90 + floor((0.55D - fit) * 10 + 0.5D)", "(0.86D - fit) * greatest(30.0D, multiplier - 100)"),
    ("(tier IS NULL AND quality < 0.25) OR tier <= 2", "RAISE QUALITY", "65", "gap * fit"),
    ("trait_fit < 0.48", "REROLL TRAIT", "42", "(0.72D - trait_fit) * greatest(20.0D, multiplier - 100)"),
    ("true", "KEEP", "10", "0.0D"),
]


def first_fitting(cases: list[tuple[str, Column]]) -> Column:
    """Value of the first case whose SQL condition holds."""
    out = F.lit(None)
    for condition, value in reversed(cases):
        out = F.when(F.expr(condition), value).otherwise(out)
    return out


def rule_points(metric: str, value: Column) -> Column:
    for name, _, base, slope in STAT_RULES:
        if name == metric:
            if name in CLIPPED:
                low, high = CLIPPED[name]
                value = F.least(F.lit(high), F.greatest(F.lit(low), value))
            return base + slope * value
    raise KeyError(metric)


def points_of(metric: str) -> Column:
    column = {name: c for name, c, _, _ in STAT_RULES}[metric]
    return rule_points(metric, F.col(column))


def rules_table(spark: SparkSession) -> DataFrame:
    """The eighteen rules as rows (metric, base, slope, low, high)."""
    rows = [(m, b, s, *CLIPPED.get(m, (None, None))) for m, _, b, s in STAT_RULES]
    return spark.createDataFrame(rows, "metric string, base double, slope double, low double, high double")


def preferred_metrics(role: str, stage: str) -> list[str]:
    pattern = PATTERNS[role][STAGES[stage]]
    return [m for color in ("Red", "Green", "Blue") for m in PRIORITIES[role].get(color, [])[:pattern.count(color)]]


def preferred_table(spark: SparkSession) -> DataFrame:
    """(role, stage, place, metric) for the three roles and two stages."""
    rows = [(r, s, i + 1, m) for r in PATTERNS for s in STAGES for i, m in enumerate(preferred_metrics(r, s))]
    return spark.createDataFrame(rows, "role string, stage string, place int, metric string")


def priority_table(spark: SparkSession) -> DataFrame:
    """(role, color, metric, place, size) of the priorities."""
    rows = [(r, c, m, i, len(ms)) for r, by in PRIORITIES.items() for c, ms in by.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "role string, color string, metric string, place int, size int")


def js_round(value: Column, digits: int = 0) -> Column:
    """Rounding with halves up, as in the browser."""
    scale = 10 ** digits
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + 0.5)


def suffix_activation(key: Column) -> Column:
    p = F.when(key.isNull(), 0.0)
    for name, chance in SUFFIX_ACTIVATION.items():
        p = p.when(F.lower(key) == name, chance)
    return p.otherwise(OTHER_ACTIVATION)
