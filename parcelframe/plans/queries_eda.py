"""Registered queries: exploration statistics, top-k, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import eda, reshape, topk
from ..sources.fixtures import by_source, national


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals, ties to even (stable comparison across engines)."""
    return df.select([F.bround(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`")
                      for c, t in df.dtypes])


def _delays(df: DataFrame) -> DataFrame:
    d = F.datediff(F.col("last_event_date"), F.col("deposit_date")).alias("delay_days")
    return df.select(d).filter(F.col("delay_days").between(0, 30))


DELAY_SQL = ("(SELECT delay_days FROM (SELECT CAST(datediff('day', deposit_date, last_event_date) AS INTEGER) AS delay_days "
             "FROM national) WHERE delay_days BETWEEN 0 AND 30)")

MISSING_COLS = ["crbt_amount", "next_region", "interval_days", "last_event", "weight_kg", "revenue_ca"]


@register("missing_profile",
          "SELECT column_name, missing, round(missing * 100.0 / n, 2) AS missing_pct FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) "
                               f"AS missing, count(*) AS n FROM national" for c in MISSING_COLS)
          + ") WHERE missing > 0")
def q_missing_profile(spark, sf):
    return eda.missing_profile(national(spark, sf), MISSING_COLS)


def _describe_sql(col: str, src: str = "national", by: str | None = None) -> str:
    x = f"CAST({col} AS DOUBLE)"
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}CAST(count({x}) AS BIGINT) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM {src}{group}")


@register("describe", _describe_sql("weight_kg"))
def q_describe(spark, sf):
    return r6(eda.describe(national(spark, sf), "weight_kg"))


@register("describe_by_region", _describe_sql("revenue_ca", by="depot_region"))
def q_describe_by_region(spark, sf):
    return r6(eda.describe(national(spark, sf), "revenue_ca", by=["depot_region"]))


def _hist_sql(expr: str, where: str, bins: int = 60) -> str:
    return (
        f"WITH src AS (SELECT {expr} AS v FROM national WHERE {where}), "
        "st AS (SELECT min(v) AS lo, max(v) AS hi FROM src), "
        f"wd AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END AS w FROM st), "
        f"c AS (SELECT least(CAST(floor((v - lo) / w) AS INTEGER), {bins - 1}) AS bin, count(*) AS n "
        "FROM src, wd GROUP BY 1) "
        "SELECT CAST(r.range AS INTEGER) AS bin, round(wd.lo + r.range * wd.w, 6) AS lower, "
        "round(wd.lo + (r.range + 1) * wd.w, 6) AS upper, CAST(coalesce(c.n, 0) AS BIGINT) AS n "
        f"FROM range({bins}) r CROSS JOIN wd LEFT JOIN c ON c.bin = r.range")


@register("histogram", _hist_sql("CAST(weight_kg AS DOUBLE)", "weight_kg IS NOT NULL"))
def q_histogram(spark, sf):
    return r6(eda.histogram(national(spark, sf), "weight_kg", 60))


@register("histogram_log", _hist_sql("log10(CAST(revenue_ca AS DOUBLE))", "revenue_ca > 0"))
def q_histogram_log(spark, sf):
    """log10-scale histogram of revenue over positive values."""
    return r6(eda.histogram(national(spark, sf), "revenue_ca", 60, log10=True))


@register("weight_class_share",
          "WITH c AS (SELECT CASE WHEN weight_kg >= 0 AND weight_kg < 1 THEN '<1 kg' "
          "WHEN weight_kg >= 1 AND weight_kg < 5 THEN '1-5 kg' WHEN weight_kg >= 5 AND weight_kg < 10 THEN '5-10 kg' "
          "WHEN weight_kg >= 10 AND weight_kg < 30 THEN '10-30 kg' WHEN weight_kg >= 30 AND weight_kg < 70 "
          "THEN '30-70 kg' WHEN weight_kg >= 70 THEN '>70 kg' END AS weight_class, count(*) AS n FROM national "
          "GROUP BY 1), k AS (SELECT * FROM (VALUES (0, '<1 kg'), (1, '1-5 kg'), (2, '5-10 kg'), (3, '10-30 kg'), "
          "(4, '30-70 kg'), (5, '>70 kg')) t(class_order, weight_class)) "
          "SELECT k.class_order, k.weight_class, CAST(coalesce(c.n, 0) AS BIGINT) AS n, "
          "round(coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (), 4) AS share_pct "
          "FROM k LEFT JOIN c ON k.weight_class = c.weight_class")
def q_weight_class_share(spark, sf):
    return eda.weight_class_share(national(spark, sf))


@register("corr_pair",
          "SELECT round(corr(CAST(weight_kg AS DOUBLE), CAST(revenue_ca AS DOUBLE)), 6) AS corr FROM national")
def q_corr_pair(spark, sf):
    return r6(eda.corr_pair(national(spark, sf), "weight_kg", "revenue_ca"))


CORR_COLS = ["weight_kg", "revenue_ca", "crbt_amount", "interval_days"]


@register("corr_matrix",
          " UNION ALL ".join(
              f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) "
              f"AS corr FROM national" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]))
def q_corr_matrix(spark, sf):
    return r6(eda.corr_matrix(national(spark, sf), CORR_COLS))


@register("ols_trend",
          "SELECT round(regr_slope(CAST(revenue_ca AS DOUBLE), weight_kg), 6) AS slope, "
          "round(regr_intercept(CAST(revenue_ca AS DOUBLE), weight_kg), 6) AS intercept, "
          "round(regr_r2(CAST(revenue_ca AS DOUBLE), weight_kg), 6) AS r2, "
          "CAST(regr_count(CAST(revenue_ca AS DOUBLE), weight_kg) AS BIGINT) AS n FROM national")
def q_ols_trend(spark, sf):
    return r6(eda.ols_trend(national(spark, sf), "revenue_ca", "weight_kg"))


@register("box_by_weekday",
          "WITH d AS (SELECT deposit_date, CAST(isodow(deposit_date) - 1 AS INTEGER) AS weekday, sum(weight_kg) AS v "
          "FROM national WHERE deposit_date IS NOT NULL GROUP BY deposit_date), "
          "q AS (SELECT weekday, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
          "quantile_cont(v, 0.75) AS q3, count(v) AS n FROM d GROUP BY weekday) "
          "SELECT q.weekday, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
          "CAST(q.n AS BIGINT) AS n, "
          "round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low, "
          "round(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, "
          "CAST(count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) "
          "AS outliers FROM d JOIN q ON d.weekday = q.weekday GROUP BY q.weekday, q1, median, q3, q.n")
def q_box_by_weekday(spark, sf):
    """Box statistics of daily shipped weight per weekday (Mon = 0)."""
    daily = (national(spark, sf).filter(F.col("deposit_date").isNotNull())
             .groupBy("deposit_date").agg(F.sum("weight_kg").alias("v"))
             .withColumn("weekday", F.weekday("deposit_date")))
    return r6(eda.box_by_group(daily, "weekday", "v"))


@register("delay_distribution", _describe_sql("delay_days", DELAY_SQL))
def q_delay_distribution(spark, sf):
    return r6(eda.describe(_delays(national(spark, sf)), "delay_days"))


@register("ecdf_delay",
          f"SELECT delay_days, CAST(count(*) AS BIGINT) AS n, round(sum(count(*)) OVER (ORDER BY delay_days) "
          f"/ sum(count(*)) OVER (), 6) AS ecdf FROM {DELAY_SQL} GROUP BY delay_days")
def q_ecdf_delay(spark, sf):
    return r6(eda.ecdf(_delays(national(spark, sf)), "delay_days"))


@register("period_span",
          "SELECT min(deposit_date) AS first_day, max(deposit_date) AS last_day, "
          "CAST(datediff('day', min(deposit_date), max(deposit_date)) AS INTEGER) + 1 AS span_days, "
          "CAST(count(DISTINCT deposit_date) AS BIGINT) AS distinct_days FROM national")
def q_period_span(spark, sf):
    return eda.period_span(national(spark, sf), "deposit_date")


# ── top-k ─────────────────────────────────────────────────────────────────────

@register("top_n_groups_by_count",
          "SELECT depot_office, CAST(count(*) AS BIGINT) AS n FROM national WHERE depot_office IS NOT NULL "
          "GROUP BY depot_office ORDER BY n DESC, depot_office LIMIT 10")
def q_top_n_groups_by_count(spark, sf):
    return topk.top_n_groups_by_count(national(spark, sf), "depot_office", 10)


@register("top_n_groups_by_sum",
          "SELECT depot_office, CAST(sum(revenue_ca) AS DECIMAL(38,3)) AS total FROM national "
          "WHERE depot_office IS NOT NULL GROUP BY depot_office ORDER BY total DESC, depot_office LIMIT 8")
def q_top_n_groups_by_sum(spark, sf):
    return topk.top_n_groups_by_sum(national(spark, sf), "depot_office", "revenue_ca", 8) \
        .withColumn("total", F.col("total").cast("decimal(38,3)"))


@register("top_events",
          "SELECT last_event, CAST(count(*) AS BIGINT) AS n FROM national WHERE last_event IS NOT NULL "
          "GROUP BY last_event ORDER BY n DESC, last_event LIMIT 15")
def q_top_events(spark, sf):
    return topk.top_n_groups_by_count(national(spark, sf), "last_event", 15)


@register("semi_top_n",
          "SELECT mailitm_fid, depot_office FROM national WHERE depot_office IN (SELECT depot_office FROM "
          "(SELECT depot_office, count(*) AS n FROM national WHERE depot_office IS NOT NULL GROUP BY depot_office "
          "ORDER BY n DESC, depot_office LIMIT 6))")
def q_semi_top_n(spark, sf):
    nat = national(spark, sf)
    top = topk.top_n_groups_by_count(nat, "depot_office", 6)
    return topk.semi_top_n(nat, top, "depot_office").select("mailitm_fid", "depot_office")


@register("semi_min_obs",
          "SELECT mailitm_fid, last_event_office FROM national WHERE last_event_office IN "
          "(SELECT last_event_office FROM national GROUP BY last_event_office HAVING count(*) >= 20)")
def q_semi_min_obs(spark, sf):
    return topk.semi_min_obs(national(spark, sf), "last_event_office", 20).select("mailitm_fid", "last_event_office")


@register("sample_rows")
def q_sample_rows(spark, sf):
    """Repeatable 500-row sample of the national rows (a sampling operator; rows-only)."""
    return topk.sample_rows(national(spark, sf).select("mailitm_fid", "weight_kg"), 500, 42, ["mailitm_fid"])


# ── reshaping ─────────────────────────────────────────────────────────────────

@register("union_sources",
          "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(CASE WHEN source = 'import' THEN 0 "
          "ELSE count(revenue_ca) END AS BIGINT) AS with_revenue FROM shipments GROUP BY source")
def q_union_sources(spark, sf):
    """The three sources unioned by name; the import extract has no revenue / type columns."""
    nat, exp = by_source(spark, sf, "national"), by_source(spark, sf, "export")
    imp = by_source(spark, sf, "import").drop("revenue_ca", "shipment_type")
    u = reshape.union_all([nat, exp, imp])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("revenue_ca").alias("with_revenue"))


@register("dedup_rows", "SELECT DISTINCT depot_region, deposit_date, weight_kg FROM national")
def q_dedup_rows(spark, sf):
    return reshape.dedup_rows(national(spark, sf).select("depot_region", "deposit_date", "weight_kg"))


@register("count_duplicates",
          "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM "
          "(SELECT depot_office, deposit_date, count(*) AS n FROM national GROUP BY depot_office, deposit_date)")
def q_count_duplicates(spark, sf):
    return reshape.count_duplicates(national(spark, sf).select("depot_office", "deposit_date"))


@register("pivot_year_month",
          "SELECT CAST(year(deposit_date) AS INTEGER) AS year, "
          + ", ".join(f"sum(weight_kg) FILTER (WHERE month(deposit_date) = {m}) AS \"{m}\"" for m in range(1, 13))
          + " FROM national GROUP BY 1")
def q_pivot_year_month(spark, sf):
    return reshape.pivot_year_month(national(spark, sf), "deposit_date", "weight_kg")


# The ten busiest offices of the test tables are ranked by the statement itself;
# a column list can't be, so the pivot's rows are compared in long form.
@register("pivot_group_month",
          "WITH top AS (SELECT depot_office FROM national WHERE depot_office IS NOT NULL GROUP BY depot_office "
          "ORDER BY count(*) DESC, depot_office LIMIT 10), "
          "src AS (SELECT strftime(deposit_date, '%Y-%m') AS month, depot_office, weight_kg FROM national "
          "WHERE depot_office IN (SELECT depot_office FROM top)) "
          "SELECT m.month, t.depot_office, coalesce(sum(s.weight_kg), 0.0) AS poids FROM (SELECT DISTINCT month FROM src) m "
          "CROSS JOIN top t LEFT JOIN src s ON s.month IS NOT DISTINCT FROM m.month AND s.depot_office = t.depot_office GROUP BY 1, 2")
def q_pivot_group_month(spark, sf):
    """Monthly weight of the 10 busiest depot offices, one column each, 0 when absent; unpivoted again
    for comparison (the column names follow the data)."""
    wide = reshape.pivot_group_month(national(spark, sf), "deposit_date", "depot_office", "weight_kg", 10)
    return wide.unpivot("month", [c for c in wide.columns if c != "month"], "depot_office", "poids")


@register("monthly_volume",
          "SELECT strftime(deposit_date, '%Y-%m') AS month, sum(weight_kg) AS poids, "
          "CAST(count(weight_kg) AS BIGINT) AS n FROM national WHERE deposit_date IS NOT NULL GROUP BY 1")
def q_monthly_volume(spark, sf):
    nat = national(spark, sf).filter(F.col("deposit_date").isNotNull())
    return nat.groupBy(F.date_format("deposit_date", "yyyy-MM").alias("month")).agg(
        F.sum("weight_kg").alias("poids"), F.count("weight_kg").alias("n"))


@register("monthly_by_top_group",
          "SELECT strftime(deposit_date, '%Y-%m') AS month, depot_office, sum(weight_kg) AS poids FROM national "
          "WHERE depot_office IN (SELECT depot_office FROM national WHERE depot_office IS NOT NULL "
          "GROUP BY depot_office ORDER BY count(*) DESC, depot_office LIMIT 6) GROUP BY 1, 2")
def q_monthly_by_top_group(spark, sf):
    fine, _ = topk.aggregate_top_groups(national(spark, sf), F.date_format("deposit_date", "yyyy-MM"),
                                        "depot_office", "weight_kg", 6, "count")
    return fine.select(F.col("_key").alias("month"), "depot_office", F.col("_v").alias("poids"))


@register("month_average",
          "SELECT month, round(avg(total), 6) AS avg_monthly_weight FROM (SELECT year(deposit_date) AS year, "
          "CAST(month(deposit_date) AS INTEGER) AS month, sum(weight_kg) AS total FROM national WHERE deposit_date IS NOT NULL "
          "GROUP BY 1, 2) GROUP BY month")
def q_month_average(spark, sf):
    nat = national(spark, sf).filter(F.col("deposit_date").isNotNull())
    m = nat.groupBy(F.year("deposit_date").alias("year"), F.month("deposit_date").alias("month")) \
        .agg(F.sum("weight_kg").alias("total"))
    return r6(m.groupBy("month").agg(F.avg("total").alias("avg_monthly_weight")))
