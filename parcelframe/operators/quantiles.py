"""Exact quantiles by brackets, without ordering or gathering the values.

* Sketch: one pass builds a mergeable rank sketch of each group (Spark's
  ``percentile_approx``, whose ranks are right to 1 / ``ACCURACY`` of the rows), and
  any other aggregates the caller wants. Probes some ranks below and above a
  quantile give a bracket that holds it for certain.
* Narrowing: where a bracket may hold more than ``HELD`` values, another pass
  sketches only the values inside; each such pass makes it some forty times
  smaller, so a trillion rows take two.
* Tally: a last pass counts values. Inside a bracket each value is counted by
  itself, all others only by the side of the brackets they lie on. The few
  rows left, at most ``HELD`` values a bracket, are ranked and give the
  quantile, linearly interpolated between neighbours.

All passes aggregate before they shuffle, so a hot group costs a row for each
value in its brackets and no more. Brackets of up to ``GROUPS`` groups travel as
a broadcast, of more as a table that Spark joins by group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Ranks are right to a 1 / ACCURACY share; probes lie MARGIN such shares away; groups of at most ACCURACY values are counted whole.
ACCURACY, MARGIN = 2000, 4
#: Steps of the grid that narrows a bracket, and how many steps around the target stay.
GRID, AROUND = 250, 2
HELD, GROUPS = 200_000, 10_000


def _keys(n: int) -> list[str]:
    return [f"_k{i}" for i in range(n)]


@dataclass
class _Heads:
    """The group rows: on the driver too, if they're few (then they're broadcast)."""

    df: DataFrame
    rows: list | None

    @property
    def held(self) -> float:
        """The most values that a bracket may hold."""
        if self.rows is None:
            return self.df.agg(F.max("_held")).first()[0] or 0
        return max((r["_held"] or 0 for r in self.rows), default=0)


def _settled(heads: DataFrame) -> _Heads:
    """The group rows as values: local if they're few, else written."""
    rows = heads.limit(GROUPS + 1).collect()
    if len(rows) > GROUPS:
        return _Heads(materialize(heads), None)
    return _Heads(F.broadcast(heads.sparkSession.createDataFrame(rows, heads.schema)), rows)


def _joined(values: DataFrame, heads: _Heads, keys: list[str]) -> DataFrame:
    """Values with their group's brackets."""
    if not keys:  # one row
        row = heads.rows[0]
        array = lambda xs: F.array(*[F.lit(x).cast("double") for x in xs])
        return values.select("*", F.lit(row["_n"]).alias("_n"), array(row["_lo"]).alias("_lo"), array(row["_hi"]).alias("_hi"))
    own = heads.df.select(*[F.col(k).alias(f"{k}h") for k in keys], "_n", "_lo", "_hi")
    return values.join(own, [F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys])


def _grouped(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def _sketched(source: DataFrame, keys: list[str], ps: list[float], extra: list[Column]) -> DataFrame:
    """Group rows: the caller's aggregates, _n, and the first brackets (_lo, _hi)."""
    away = MARGIN / ACCURACY
    probes = [max(p - away, 0.0) for p in ps] + [min(p + away, 1.0) for p in ps]
    v = F.col("_v")
    found = _grouped(source, keys).agg(*extra, F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"),
                                       F.percentile_approx(v, F.array(*map(F.lit, probes)), ACCURACY).alias("_at"))
    whole = F.col("_n") <= ACCURACY
    lo = F.array(*[F.when(whole | F.lit(p <= away), F.col("_min")).otherwise(F.col("_at")[i]) for i, p in enumerate(ps)])
    hi = F.array(*[F.when(whole | F.lit(p >= 1 - away), F.col("_max")).otherwise(F.col("_at")[len(ps) + i]) for i, p in enumerate(ps)])
    held = F.when(whole, F.col("_n")).otherwise(F.col("_n") * F.lit(2 * (MARGIN + 1) / ACCURACY))
    return found.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_held", held).drop("_at", "_min", "_max")


def _targets(p: float) -> tuple[Column, Column]:
    """0-based ranks around a quantile of _n values."""
    at = (F.col("_n") - 1) * F.lit(float(p))
    return F.floor(at), F.ceil(at)


def _narrowed(values: DataFrame, heads: _Heads, keys: list[str], ps: list[float]) -> DataFrame:
    """Group rows with brackets narrowed by a sketch of the values inside each."""
    v, grid = F.col("_v"), F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    aggs = []
    for i in range(len(ps)):
        lo, hi = F.col("_lo")[i], F.col("_hi")[i]
        inside = F.when((v > lo) & (v < hi), v)
        aggs += [F.count(F.when(v <= lo, 1)).alias(f"_b{i}"), F.count(inside).alias(f"_m{i}"), F.percentile_approx(inside, grid, 8 * GRID).alias(f"_g{i}")]
    found = _grouped(_joined(values, heads, keys), keys).agg(*aggs)
    renamed = found.select(*[F.col(k).alias(f"{k}f") for k in keys], *[c for c in found.columns if c not in keys])
    both = heads.df.join(renamed, [F.col(k).eqNullSafe(F.col(f"{k}f")) for k in keys], "left") if keys else heads.df.join(renamed)  # one row each
    los, his, held = [], [], F.lit(0.0)
    for i, p in enumerate(ps):
        low, high = _targets(p)
        below, mid, g, lo, hi = F.col(f"_b{i}"), F.coalesce(F.col(f"_m{i}"), F.lit(0)), F.col(f"_g{i}"), F.col("_lo")[i], F.col("_hi")[i]
        step = lambda k: F.floor((k - below) * GRID / mid).cast("int")
        first, last = step(low) - AROUND, step(high) + 1 + AROUND
        new_lo = F.when(high < below, lo).when(low >= below + mid, hi).when((low < below) | (first < 0), lo).otherwise(F.get(g, first))
        new_hi = F.when(high < below, lo).when(low >= below + mid, hi).when((high >= below + mid) | (last > GRID), hi).otherwise(F.get(g, last))
        los.append(F.when(mid == 0, lo).otherwise(new_lo))
        his.append(F.when(mid == 0, hi).otherwise(new_hi))
        held = F.greatest(held, mid * F.lit((2 * AROUND + 3) / GRID))
    rest = [c for c in heads.df.columns if c not in ("_lo", "_hi", "_held")]
    return both.select(*rest, F.array(*los).alias("_lo"), F.array(*his).alias("_hi"), held.alias("_held"))


def _tallied(values: DataFrame, heads: _Heads, keys: list[str], ps: list[float]) -> DataFrame:
    """(keys, _v, _c, _in): each value inside a bracket with its count; between brackets one row (_in false)."""
    joined = _joined(values, heads, keys)
    v = F.col("_v")
    lo, hi = [F.col("_lo")[i] for i in range(len(ps))], [F.col("_hi")[i] for i in range(len(ps))]
    inside = reduce(Column.__or__, [(v >= a) & (v <= b) for a, b in zip(lo, hi)])
    side = reduce(Column.__add__, [(v > b).cast("int") for b in hi])  # values of one side have no bracket's value between them
    marked = joined.select(*keys, "_n", "_v", inside.alias("_in"), F.when(inside, v).alias("_own"), F.when(~inside, side).alias("_side"))
    return marked.groupBy(*keys, "_n", "_in", "_own", "_side").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"))


def exact_quantiles(df: DataFrame, value: Column, ps: dict[str, float], by=(), extra: list[Column] = ()) -> DataFrame:
    """(by…, extra…, one column per entry of ``ps``): linearly interpolated quantiles of each group.

    NULL and NaN are left out. A group without values has no row, or NULL quantiles where ``extra`` is asked for.
    ``extra`` are aggregates over the group's rows (with the value as ``_x``),
    computed by the sketch's pass."""
    by, names, points = list(by), list(ps), [float(p) for p in ps.values()]
    keys = _keys(len(by))
    x = value.cast("double")
    source = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], x.alias("_x"), F.when(~F.isnan(x), x).alias("_v"))
    heads = _settled(_sketched(source, keys, points, list(extra)))
    values = source.where("_v IS NOT NULL").select(*keys, "_v")
    while heads.held > HELD:
        heads = _settled(_narrowed(values, heads, keys, points))
    order = W.partitionBy(*keys).orderBy("_v")
    ranked = _tallied(values, heads, keys, points).withColumn("_r", F.sum("_c").over(order) - F.col("_c"))
    out = []
    for name, p in zip(names, points):
        low, high = _targets(p)
        hit = lambda k: (F.col("_r") <= k) & (k < F.col("_r") + F.col("_c"))
        exact = F.when(F.col("_in"), F.col("_v")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
        left, right = F.max(F.when(hit(low), exact)), F.max(F.when(hit(high), exact))
        out.append((left + (right - left) * F.max((F.col("_n") - 1) * F.lit(p) - low)).alias(name))
    found = _grouped(ranked, keys).agg(*out)
    found = found.select(*[F.col(k).alias(f"{k}q") for k in keys], *names)
    others = [f for f in heads.df.schema.fields if f.name not in (*keys, "_n", "_lo", "_hi", "_held")]
    if not keys:
        return found.select(*[F.lit(heads.rows[0][f.name]).cast(f.dataType).alias(f.name) for f in others], *names)
    both = heads.df.join(found, [F.col(k).eqNullSafe(F.col(f"{k}q")) for k in keys], "left" if extra else "inner")
    return both.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *[f.name for f in others], *names)
