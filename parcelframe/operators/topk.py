"""Top-k groups, semi-joins on them, deterministic sampling.

A top-k result is at most ``n`` rows, so it is a proven-small side: joins
against it are hinted as broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def top_n_groups_by_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null keys (ties broken by key)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(n))


def top_n_groups_by_sum(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total"))
            .orderBy(F.desc("total"), F.asc(key)).limit(n))


def semi_top_n(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows whose group is in the top list (left-semi join; ``top`` has ≤ n rows)."""
    return df.join(F.broadcast(top.select(key)), key, "left_semi")


def semi_min_obs(df: DataFrame, key: str, min_obs: int = 20) -> DataFrame:
    """Rows of series with at least ``min_obs`` rows.

    Counts come from a group-by (map-side partial counts); the key list is
    joined back with a left-semi join, so a hot series is never gathered in
    one window partition.
    """
    keep = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_obs).select(key)
    return df.join(keep, key, "left_semi")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key_cols=None) -> DataFrame:
    """Repeatable sample of ``n`` rows: smallest hash of (key, seed).

    Runs as a per-partition top-n followed by one merge of n rows per task.
    """
    keys = [F.col(c) for c in (key_cols or df.columns)]
    return df.withColumn("_h", F.xxhash64(*keys, F.lit(seed))).orderBy("_h").limit(n).drop("_h")


def aggregate_top_groups(df: DataFrame, key: Column, group: str, value: str, n: int,
                         rank_by: str = "count") -> tuple[DataFrame, list]:
    """Read the rows once for a "top-n groups, then per key" report.

    Rows are aggregated to (key, group) → sum of ``value`` and row count and
    checkpointed (keys × groups rows, small next to the input). The top ``n``
    groups — by row count or by summed value, ties by name — are ranked on that
    small table. Returns the small table restricted to those groups (columns
    ``_key``, ``group``, ``_v``, ``_n``) and the ordered group list.
    """
    fine = materialize(df.groupBy(key.alias("_key"), F.col(group))
                       .agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n")))
    score = F.sum("_n") if rank_by == "count" else F.sum("_v")
    ranked = (fine.filter(F.col(group).isNotNull()).groupBy(group).agg(score.alias("_s"))
              .orderBy(F.desc("_s"), F.asc(group)).limit(n).collect())
    top = [r[group] for r in ranked]
    return fine.filter(F.col(group).isin(*top)), top
