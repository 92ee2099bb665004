"""Idempotent ingestion: merges by key, child replacement, snapshots, worklists and audit rows."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_non_null(records: DataFrame, key: str, version: str, overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by key: the newest non-null value wins per column; ``overwrite`` columns follow the newest record.

    Works on old and new records in one frame, so a re-delivered record changes nothing. Only
    partial aggregates: a key with very many versions is combined before the shuffle. Of equal versions
    the greatest value wins.
    """
    columns = [c for c in records.columns if c not in (key, version)]
    return records.groupBy(key).agg(*[
        F.max_by(c, F.struct(version, c) if c in overwrite else F.when(F.col(c).isNotNull(), F.struct(version, c))).alias(c)
        for c in columns])


def merge_sticky_detail(records: DataFrame, key: str, version: str, detailed: str = "detailed", payload: str = "payload") -> DataFrame:
    """``detailed`` never falls back; the payload is replaced by a newer one only if that is at least as detailed."""
    return records.groupBy(key).agg(
        F.max(detailed).alias(detailed), F.max_by(payload, F.struct(F.col(detailed), F.col(version))).alias(payload))


def merge_latest(records: DataFrame, key: str, version: str, required: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest record per key, nulls included; records lacking a required column are dropped first.

    Of equal versions the one with the greatest ``tie`` columns wins, then one by a hash of the whole record.
    """
    kept = records
    for c in required:
        kept = kept.where(F.col(c).isNotNull())
    w = Window.partitionBy(key).orderBy(F.desc(version), *[F.desc(c) for c in tie], F.xxhash64(*records.columns))
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of reloaded parents are replaced as a whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unpivot_brackets(wide: DataFrame, ids: list[str], brackets: range = range(1, 9)) -> DataFrame:
    """Columns ``1_pick, 1_win, ...`` to rows (bracket, picks, wins); null counts as zero."""
    entries = [F.struct(F.lit(b).cast("long").alias("bracket"), F.coalesce(f"{b}_pick", F.lit(0)).cast("long").alias("picks"),
                        F.coalesce(f"{b}_win", F.lit(0)).cast("long").alias("wins")) for b in brackets]
    return wide.select(*ids, F.explode(F.array(*entries)).alias("v")).select(*ids, "v.*")


def latest_snapshot(snapshots: DataFrame, at: str = "collected_at") -> DataFrame:
    """Rows of the newest collection: a one-value join that prunes to the last partition."""
    newest = snapshots.agg(F.max(at).alias(at))
    return snapshots.join(F.broadcast(newest), at, "left_semi")


def pending_worklist(contests: DataFrame, since: int, limit: int, leagues: list[int] | None = None,
                     entities: list[int] | None = None, newest_first: bool = True) -> DataFrame:
    rows = contests.where((F.col("detailed") == 0) & (F.col("ts") >= since))
    if leagues:
        rows = rows.where(F.col("league_id").isin(leagues))
    if entities:
        rows = rows.where(F.col("a_id").isin(entities) | F.col("b_id").isin(entities))
    order = [F.desc("ts"), F.desc("contest_id")] if newest_first else [F.asc("ts"), F.asc("contest_id")]
    return rows.orderBy(*order).limit(limit)


def audited_write(df: DataFrame, path: str, audit_path: str, source: str, entity: str) -> None:
    """Write ``df`` and append one audit row.

    Rows are counted from the footers of the written files. An ``Observation`` would count during
    the write, but once a session has used one, closures that hold the session (MLlib's among
    them) no longer serialise.
    """
    spark = df.sparkSession
    started = int(time.time())
    status, error, rows = "complete", None, None
    try:
        df.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
    except Exception as failure:
        status, error = "failed", str(failure)[:500]
        raise
    finally:
        spark.createDataFrame(
            [(source, entity, started, int(time.time()), rows, status, error)],
            "source string, entity string, started long, completed long, rows_written long, status string, error string",
        ).write.mode("append").parquet(audit_path)


def audit_report(audit: DataFrame) -> DataFrame:
    return audit.groupBy("source", "entity", "status").agg(
        F.count("*").alias("runs"), F.sum("rows_written").alias("rows_written"))


def table_status(tables: dict[str, DataFrame], time_column: dict[str, str], detailed: dict[str, Column]) -> DataFrame:
    """Row count, detailed count and time range per table."""
    parts = []
    for name, df in tables.items():
        ts = F.col(time_column[name]) if name in time_column else F.lit(None)
        flag = detailed.get(name, F.lit(None))
        parts.append(df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.sum(flag.cast("long")).alias("detailed"),
            F.min(ts.cast("long")).alias("first_ts"), F.max(ts.cast("long")).alias("last_ts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


