"""Ordered windows that stay parallel when one key holds a large part of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here the few keys above
``hot_rows`` rows are cut into slices of about equal numbers of rows, along the full order: the first order
column is cut at its quantiles, and a single value that fills several slices is cut by the second one. The
window runs per (key, slice), and what earlier slices contribute is added from a table with one row per slice of a
hot key. Other keys keep a single slice; without hot keys the plan is the plain window.

Which keys are hot and where they are cut is decided when the plan is built: at most ``MAX_HOT_KEYS`` keys with a
bounded number of cuts each reach the driver, so the broadcast has a fixed size. A key outside that list holds
fewer than 1 / MAX_HOT_KEYS of all rows and needs no cut. Cuts change the work, never the result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType

from contestry.session import materialize, run_dir

HOT_ROWS = 2_000_000
MAX_HOT_KEYS = 2_000
#: Slices of a hot key: as many as its rows ask for, between these bounds; of a single value of the first order column.
LEAST_SLICES, MOST_SLICES, TIE_SLICES = 128, 4096, 64
CHUNK = 64

SLICE = "_slice"
SLICES = "_slices"


def _fractions(pieces: int) -> Column:
    return F.array(*[F.lit(i / pieces) for i in range(1, pieces)])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[f"_k{i}"] for i, k in enumerate(keys)])


def _named(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *more)


def _cuts(df: DataFrame, keys: list[str], order: list[str], hot: list, schema: StructType, most: int) -> DataFrame:
    """(keys, _tops, _parts, _ties) of the hot keys: cuts of the first order column in chunks, cuts of values that fill slices."""
    spark, first = df.sparkSession, order[0]
    right = _named(spark.createDataFrame(hot, schema), keys)
    rows = df.join(F.broadcast(right), _same(df, right, keys)).select(*keys, *order[:2])
    pieces = min(MOST_SLICES, max(LEAST_SLICES, most))
    found = {tuple(r[k] for k in keys): r["c"] for r in rows.groupBy(*keys).agg(
        F.percentile_approx(first, _fractions(pieces), F.lit(20 * pieces)).alias("c")).collect()}
    kind = df.schema[first].dataType
    heavy = [(*k, v) for k, c in found.items() for v in sorted({x for x, y in zip(c, c[1:]) if x == y})]
    ties: dict[tuple, dict] = {}
    tie_kind = LongType()
    if heavy and len(order) > 1:
        tie_kind = df.schema[order[1]].dataType
        wanted = _named(spark.createDataFrame(heavy, StructType([df.schema[k] for k in keys] + [StructField("_v", kind)])), keys, "_v")
        same = rows.join(F.broadcast(wanted), _same(rows, wanted, keys) & (rows[first] == wanted["_v"]))
        for r in same.groupBy(*keys, first).agg(F.percentile_approx(order[1], _fractions(TIE_SLICES), F.lit(20 * TIE_SLICES)).alias("c")).collect():
            ties.setdefault(tuple(r[k] for k in keys), {})[r[first]] = sorted(set(r["c"]))
    out = []
    for k, c in found.items():
        c = sorted(set(c))
        parts = [c[i:i + CHUNK] for i in range(0, len(c), CHUNK)]
        out.append((*k, [p[-1] for p in parts], parts, ties.get(k, {})))
    fields = [*[df.schema[k] for k in keys], StructField("_tops", ArrayType(kind)), StructField("_parts", ArrayType(ArrayType(kind))), StructField("_ties", MapType(kind, ArrayType(tie_kind)))]
    return spark.createDataFrame(out, StructType([StructField(f.name, f.dataType, True) for f in fields]))


def _below(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def _placed(df: DataFrame, keys: list[str], order: list[str], cuts: DataFrame) -> DataFrame:
    right = _named(cuts, keys, "_tops", "_parts", "_ties")
    first = F.col(order[0])
    chunk = _below(F.col("_tops"), first)
    rank = chunk * CHUNK + F.coalesce(F.when(chunk < F.size("_tops"), _below(F.get("_parts", chunk), first)), F.lit(0))
    # a value that is cut is the last one of its slice: it comes behind the other values there
    tie = F.try_element_at(F.col("_ties"), first)
    deep = F.when(tie.isNotNull(), 1 + _below(tie, F.col(order[1]))).otherwise(0) if len(order) > 1 else F.lit(0)
    number = F.when(F.col("_tops").isNotNull(), rank * (TIE_SLICES + 1) + deep).otherwise(0)
    joined = df.join(F.broadcast(right), _same(df, right, keys), "left")
    return joined.withColumn(SLICE, number).withColumn(SLICES, F.when(F.col("_tops").isNotNull(), MOST_SLICES).otherwise(1)).drop(
        "_tops", "_parts", "_ties", *[f"_k{i}" for i in range(len(keys))])


def slice_hot_keys(df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``_slice`` (0 for ordinary keys) and ``_slices`` (above 1 for hot keys). Slices ascend along ``order``.

    ``hot_rows`` None: the caller knows that no key is hot, so keys are not counted.

    Rows with a null key match no hot key and stay whole; they are still right, only not cut. The first two columns of
    ``order`` must be numeric.
    """
    if hot_rows is None:
        return df.withColumns({SLICE: F.lit(0), SLICES: F.lit(1)})
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = counts.orderBy(F.desc("_n"), *keys).limit(MAX_HOT_KEYS).collect()
    hot = [r for r in hot if all(r[k] is not None for k in keys)]
    if not hot:
        return df.withColumns({SLICE: F.lit(0), SLICES: F.lit(1)})
    return _placed(df, keys, order, _cuts(df, keys, order, hot, counts.schema, math.ceil(hot[0]["_n"] / hot_rows)))


def attach_carry(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join the per-slice table of the hot keys (empty when there are none).

    Plain equality on (keys, slice): the rows already lie and are sorted that way for their window,
    so only the small side moves.
    """
    right = carry.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_ks"),
        *[c for c in carry.columns if c not in keys and c != SLICE])
    condition = reduce(lambda a, b: a & b, [local[k] == right[f"_k{i}"] for i, k in enumerate(keys)])
    condition = condition & (local[SLICE] == right["_ks"])
    return local.join(right, condition, "left").drop("_ks", *[f"_k{i}" for i in range(len(keys))])


def hot_slices(sliced: DataFrame) -> DataFrame:
    return sliced.where(F.col(SLICES) > 1)


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    hot_rows: int | None = HOT_ROWS,
    inclusive: bool = False,
) -> DataFrame:
    """Add, per key, the sum of each expression over the rows strictly before the current one.

    ``order[0]`` must be numeric; the full order must be total within a key.
    """
    named = df.select("*", *[expr.alias(f"_v_{n}") for n, expr in sums.items()])
    sliced = slice_hot_keys(named, keys, order, hot_rows)
    last = 0 if inclusive else -1
    local_w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    before_w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(local_w), F.lit(0)).alias(f"_l_{n}") for n in sums])
    totals = hot_slices(sliced).groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    carry = totals.select(*keys, SLICE, *[F.sum(f"_t_{n}").over(before_w).alias(f"_c_{n}") for n in sums])
    joined = attach_carry(local, carry, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums])


def global_index(df: DataFrame, order: list[str], name: str = "idx", slice_rows: int = HOT_ROWS) -> DataFrame:
    """0-based position in one global order without a single-task sort.

    The whole table is cut like a hot key: slices of about equal numbers of rows along the order, rows that share one
    moment included. Offsets come from one row per slice.
    """
    keyed = df.withColumn("_g", F.lit(0))
    total = df.count()
    if not total:
        return df.withColumn(name, F.lit(0).cast("long"))
    schema = keyed.select("_g").schema
    sliced = _placed(keyed, ["_g"], order, _cuts(keyed, ["_g"], order, [(0,)], schema, math.ceil(total / slice_rows)))
    before = Window.partitionBy(F.lit(0)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(SLICE).agg(F.count("*").alias("_n")).select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(SLICE).orderBy(*order)
    return (
        sliced.withColumn("_i", F.row_number().over(within) - 1)
        .join(offsets, SLICE)
        .withColumn(name, (F.col("_i") + F.col("_offset")).cast("long"))
        .drop("_g", "_i", "_offset", SLICE, SLICES)
    )


#: Distinct values of a group up to which one task sorts it.
SORTED_VALUES = 100_000


def cumulative_counts(df: DataFrame, group: list[str], value: str, buckets: int = 256, sorted_values: int = SORTED_VALUES) -> DataFrame:
    """Distinct (group, value) with ``n`` rows, ``n_lt`` below, ``n_le`` at or below and ``n_all``.

    Equal values collapse first and are written, so the input is read once. A group of up to ``sorted_values`` distinct
    values is summed up in one window. The order within a larger one is built from ``buckets`` ranges that hold about as many distinct
    values each, wherever these lie: a group with most of the rows is sorted by many tasks. Where the ranges are cut does not
    change the result. Rows with a null in the group have no counts.
    """
    named = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in [*group, value]])
    base = df.where(named).groupBy(*group, value).agg(F.count("*").alias("n"))
    base = materialize(base, run_dir(df.sparkSession, "counts"))
    # Groups to be cut are few: rows / sorted_values at most.
    many = base.groupBy(*group).agg(F.count("*").alias("_d")).where(F.col("_d") > sorted_values).drop("_d")
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(20 * buckets))
    span = base.join(many, group, "left_semi").groupBy(*group).agg(F.array_distinct(cuts).alias("_cuts"), F.sum("n").alias("_all"))
    span = materialize(span, run_dir(df.sparkSession, "cuts"))  # both uses below must see the same cuts
    below = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(value)))).otherwise(0)
    placed = base.join(span, group, "left").withColumn("_b", below).drop("_cuts")
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.where("_all IS NOT NULL").groupBy(*group, "_b").agg(F.sum("n").alias("_t")).select(
        *group, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_c"))
    part = Window.partitionBy(*group, "_b")
    summed = placed.withColumns({"_le": F.sum("n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_slice": F.sum("n").over(part)})
    upto = F.coalesce(F.col("_c"), F.lit(0)) + F.col("_le")
    return summed.join(offsets, [*group, "_b"], "left").select(
        *group, value, "n", (upto - F.col("n")).alias("n_lt"), upto.alias("n_le"), F.coalesce("_all", "_slice").alias("n_all"))


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], mean: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs``, and the mean in a column of that name."""
    counts = cumulative_counts(df, group, value)
    columns = [(F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias(mean)] if mean else []
    for name, q in probs.items():
        h = F.lit(q) * (F.col("n_all") - 1)
        low = F.max(F.when((F.col("n_lt") <= F.floor(h)) & (F.floor(h) < F.col("n_le")), F.col(value)))
        high = F.max(F.when((F.col("n_lt") <= F.ceil(h)) & (F.ceil(h) < F.col("n_le")), F.col(value)))
        frac = F.max(h - F.floor(h))
        columns.append((low + (high - low) * frac).alias(name))
    return counts.groupBy(*group).agg(*columns)


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``name``: the value of the preceding row of the same key, null for the first."""
    s = slice_hot_keys(df, keys, order, hot_rows)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("_prev", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    ends = hot_slices(s).groupBy(*keys, SLICE).agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("_end"))
    carry = ends.select(*keys, SLICE, F.last("_end").over(before).alias("_c"))
    joined = attach_carry(local, carry, keys)
    return joined.select(*df.columns, F.when(F.col("_first"), F.col("_c")[value]).otherwise(F.col("_prev")).alias(name))
