"""Registered queries: filters, KPIs, dashboard group-bys and BI views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import grouped as grp
from ..sources.fixtures import national, shipments

# Parameters of the filtered variants (regions of the test tables).
NEXT_REGIONS = ["AMERICA", "(VIDE)"]
CATEGORIES = ["agences", "centres"]

DELIVERED = "CAST(count(*) FILTER (WHERE is_delivered) AS BIGINT)"
SANE_AVG = "avg(CASE WHEN is_delivered AND interval_days >= 0 THEN CAST(interval_days AS DOUBLE) END)"


# ── filters (§2.2) ────────────────────────────────────────────────────────────

def _ids(df, *cols):
    return df.select("mailitm_fid", *cols)


@register("filter_region", "SELECT mailitm_fid, depot_region FROM national WHERE depot_region = 'ASIA'")
def q_filter_region(spark, sf):
    return _ids(flt.filter_region(national(spark, sf), "ASIA"), "depot_region")


@register("filter_region_stripped",
          "SELECT mailitm_fid, last_event_region FROM national WHERE trim(last_event_region) = 'EUROPE'")
def q_filter_region_stripped(spark, sf):
    return _ids(flt.filter_region_stripped(national(spark, sf), "EUROPE", "last_event_region"),
                "last_event_region")


@register("filter_next_region",
          "SELECT mailitm_fid, next_region FROM national "
          "WHERE next_region IN ('AMERICA') OR next_region IS NULL OR next_region = ''")
def q_filter_next_region(spark, sf):
    return _ids(flt.filter_next_region(national(spark, sf), NEXT_REGIONS), "next_region")


@register("filter_category",
          "SELECT mailitm_fid, depot_office FROM national WHERE depot_office ILIKE '%agence%' "
          "OR depot_office ILIKE '%centre%' OR depot_office ILIKE '%cdc%'")
def q_filter_category(spark, sf):
    return _ids(flt.filter_category(national(spark, sf), CATEGORIES), "depot_office")


@register("filter_category_bureaux",
          "SELECT mailitm_fid, depot_office FROM national WHERE NOT depot_office ILIKE '%agence%' "
          "AND NOT depot_office ILIKE '%centre%' AND NOT depot_office ILIKE '%cdc%'")
def q_filter_category_bureaux(spark, sf):
    return _ids(flt.filter_category(national(spark, sf), ["bureaux"]), "depot_office")


@register("filter_combined",
          "SELECT mailitm_fid, depot_region, next_region, depot_office FROM national "
          "WHERE depot_region = 'ASIA' AND (next_region IN ('AMERICA') OR next_region IS NULL OR next_region = '') "
          "AND (depot_office ILIKE '%agence%' OR depot_office ILIKE '%centre%' OR depot_office ILIKE '%cdc%')")
def q_filter_combined(spark, sf):
    df = flt.filter_combined(national(spark, sf), "ASIA", NEXT_REGIONS, CATEGORIES)
    return _ids(df, "depot_region", "next_region", "depot_office")


@register("filter_late", "SELECT mailitm_fid, interval_days FROM national WHERE interval_days > 3")
def q_filter_late(spark, sf):
    return _ids(flt.filter_late(national(spark, sf)), "interval_days")


@register("filter_sane_interval",
          "SELECT mailitm_fid, interval_days FROM national WHERE is_delivered AND interval_days >= 0")
def q_filter_sane_interval(spark, sf):
    return _ids(flt.filter_sane_interval(national(spark, sf)), "interval_days")


@register("filter_date_range",
          "SELECT mailitm_fid, deposit_date FROM national WHERE deposit_date IS NULL "
          "OR deposit_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def q_filter_date_range(spark, sf):
    return _ids(flt.filter_date_range(national(spark, sf), "deposit_date", "1996-01-01", "1997-06-30"),
                "deposit_date")


@register("filter_has_key",
          "SELECT mailitm_fid, depot_office FROM national "
          "WHERE coalesce(trim(mailitm_fid), '') <> '' AND coalesce(trim(depot_office), '') <> ''")
def q_filter_has_key(spark, sf):
    return _ids(flt.filter_has_key(national(spark, sf)), "depot_office")


@register("drop_na",
          "SELECT mailitm_fid, interval_days, next_region FROM national "
          "WHERE interval_days IS NOT NULL AND next_region IS NOT NULL")
def q_drop_na(spark, sf):
    return flt.drop_na(_ids(national(spark, sf), "interval_days", "next_region"),
                       ["interval_days", "next_region"])


@register("drop_all_na",
          "SELECT mailitm_fid, interval_days, next_region, last_event FROM national "
          "WHERE interval_days IS NOT NULL OR next_region IS NOT NULL OR last_event IS NOT NULL")
def q_drop_all_na(spark, sf):
    df = _ids(national(spark, sf), "interval_days", "next_region", "last_event")
    return flt.drop_all_na(df, ["interval_days", "next_region", "last_event"])


_FR = ", ".join(f'{c} AS "{lbl}"' for c, lbl in flt.FRENCH_LABELS)


@register("scan_report_columns",
          f"SELECT {_FR} FROM national WHERE next_region IN ('AMERICA') OR next_region IS NULL OR next_region = ''")
def q_scan_report_columns(spark, sf):
    return flt.scan_report_columns(national(spark, sf), NEXT_REGIONS)


@register("project_french", f"SELECT {_FR} FROM national")
def q_project_french(spark, sf):
    return flt.project_french(national(spark, sf))


@register("scan_ml_columns", f"SELECT {', '.join(flt.ML_COLUMNS)} FROM national")
def q_scan_ml_columns(spark, sf):
    return flt.scan_ml_columns(national(spark, sf))


@register("table_stats",
          "SELECT source, CAST(count(*) AS BIGINT) AS row_count FROM shipments GROUP BY source")
def q_table_stats(spark, sf):
    return shipments(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("row_count"))


# ── global aggregates (§2.4) ──────────────────────────────────────────────────

@register("total_shipments", "SELECT CAST(count(*) AS BIGINT) AS total_shipments FROM national")
def q_total_shipments(spark, sf):
    return agg.total_shipments(national(spark, sf))


@register("total_revenue",
          "SELECT CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS total_revenue FROM national")
def q_total_revenue(spark, sf):
    return agg.total_revenue(national(spark, sf))


@register("total_crbt_amount",
          "SELECT CAST(coalesce(sum(crbt_amount), 0) AS DECIMAL(38,3)) AS total_crbt_amount FROM national")
def q_total_crbt_amount(spark, sf):
    return agg.total_crbt_amount(national(spark, sf))


@register("crbt_count", "SELECT CAST(count(*) FILTER (WHERE is_crbt) AS BIGINT) AS crbt_count FROM national")
def q_crbt_count(spark, sf):
    return agg.crbt_count(national(spark, sf))


@register("delivered_count", f"SELECT {DELIVERED} AS delivered_count FROM national")
def q_delivered_count(spark, sf):
    return agg.delivered_count(national(spark, sf))


@register("average_interval", f"SELECT round_even({SANE_AVG}, 2) AS avg_interval_days FROM national")
def q_average_interval(spark, sf):
    return agg.average_interval(national(spark, sf))


@register("late_count",
          "SELECT CAST(count(*) FILTER (WHERE interval_days > 3) AS BIGINT) AS late_deliveries FROM national")
def q_late_count(spark, sf):
    return agg.late_count(national(spark, sf))


@register("delivery_status_totals",
          f"SELECT {DELIVERED} AS delivered, CAST(count(*) - count(*) FILTER (WHERE is_delivered) AS BIGINT) "
          "AS failed, CAST(count(*) AS BIGINT) AS total FROM national")
def q_delivery_status_totals(spark, sf):
    return agg.delivery_status_totals(national(spark, sf))


@register("weight_stats",
          "SELECT round_even(avg(weight_kg), 2) AS avg_weight, min(weight_kg) AS min_weight, "
          "max(weight_kg) AS max_weight, round_even(coalesce(sum(weight_kg), 0.0), 1) AS total_weight FROM national")
def q_weight_stats(spark, sf):
    return agg.weight_stats(national(spark, sf))


def _kpi_sql(where: str = "", by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}CAST(count(*) AS BIGINT) AS total_shipments, "
        "CAST(round(coalesce(sum(revenue_ca), 0), 2) AS DECIMAL(38,2)) AS total_revenue, "
        "CAST(count(*) FILTER (WHERE is_crbt) AS BIGINT) AS total_crbt_count, "
        "CAST(round(coalesce(sum(crbt_amount), 0), 2) AS DECIMAL(38,2)) AS total_crbt_amount, "
        f"{DELIVERED} AS delivered, "
        "CAST(count(*) - count(*) FILTER (WHERE is_delivered) AS BIGINT) AS failed, "
        "coalesce(round_even(100.0 * CAST(count(*) FILTER (WHERE is_delivered) AS DOUBLE) / nullif(count(*), 0), 1), 0.0)"
        " AS delivery_rate, "
        f"round_even({SANE_AVG}, 2) AS avg_interval_days, "
        "CAST(count(*) FILTER (WHERE interval_days > 3) AS BIGINT) AS late_deliveries, 3 AS late_threshold "
        f"FROM national {where}{group}")


@register("kpi_summary", _kpi_sql())
def q_kpi_summary(spark, sf):
    return agg.kpi_summary(national(spark, sf))


@register("kpi_summary_by_region", _kpi_sql(by="depot_region"))
def q_kpi_summary_by_region(spark, sf):
    """Flagship: the ten KPIs for every depot region in one aggregation."""
    return agg.kpi_summary(national(spark, sf), by=["depot_region"])


@register("kpi_summary_filtered", _kpi_sql(
    "WHERE depot_region = 'ASIA' AND (next_region IN ('AMERICA') OR next_region IS NULL OR next_region = '') "
    "AND (depot_office ILIKE '%agence%' OR depot_office ILIKE '%centre%' OR depot_office ILIKE '%cdc%')"))
def q_kpi_summary_filtered(spark, sf):
    return agg.kpi_summary(flt.filter_combined(national(spark, sf), "ASIA", NEXT_REGIONS, CATEGORIES))


@register("vw_kpi_national",
          "SELECT CAST(count(*) AS BIGINT) AS total_shipments, "
          f"{DELIVERED} AS delivered, "
          "CAST(count(*) FILTER (WHERE NOT is_delivered) AS BIGINT) AS failed, "
          "CAST(100.0 * count(*) FILTER (WHERE is_delivered) / nullif(count(*), 0) AS DECIMAL(5,1)) AS delivery_rate_pct, "
          "CAST(count(*) FILTER (WHERE is_crbt) AS BIGINT) AS crbt_count, "
          "CAST(sum(crbt_amount) AS DECIMAL(38,3)) AS crbt_amount_total, "
          "CAST(sum(revenue_ca) AS DECIMAL(38,3)) AS revenue_total, "
          f"round({SANE_AVG}, 6) AS avg_interval_days, "
          "CAST(count(*) FILTER (WHERE interval_days > 3) AS BIGINT) AS late_deliveries FROM national")
def q_vw_kpi_national(spark, sf):
    return agg.vw_kpi_national(national(spark, sf))


@register("has_data", "SELECT count(*) > 0 AS has_data FROM (SELECT 1 FROM national LIMIT 1)")
def q_has_data(spark, sf):
    return agg.has_data(national(spark, sf))


# ── grouped aggregates (§2.5) ─────────────────────────────────────────────────

@register("count_by_depot_region",
          "SELECT coalesce(nullif(depot_region, ''), '—') AS depot_region, CAST(count(*) AS BIGINT) AS shipments "
          "FROM national GROUP BY depot_region")
def q_count_by_depot_region(spark, sf):
    return grp.count_by_depot_region(national(spark, sf))


@register("count_by_depot_office",
          "SELECT coalesce(nullif(depot_office, ''), '—') AS depot_office, shipments FROM ("
          "SELECT depot_office, CAST(count(*) AS BIGINT) AS shipments FROM national GROUP BY depot_office "
          "ORDER BY shipments DESC, depot_office ASC NULLS FIRST LIMIT 15)")
def q_count_by_depot_office(spark, sf):
    return grp.count_by_depot_office(national(spark, sf), 15)


@register("revenue_by_region",
          "SELECT coalesce(nullif(depot_region, ''), '—') AS depot_region, "
          "CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS revenue FROM national GROUP BY depot_region")
def q_revenue_by_region(spark, sf):
    return grp.revenue_by_region(national(spark, sf))


@register("failure_causes",
          "SELECT coalesce(nullif(last_event, ''), '—') AS last_event, shipments FROM ("
          "SELECT last_event, CAST(count(*) AS BIGINT) AS shipments FROM national WHERE NOT is_delivered "
          "GROUP BY last_event ORDER BY shipments DESC, last_event ASC NULLS FIRST LIMIT 12)")
def q_failure_causes(spark, sf):
    return grp.failure_causes(national(spark, sf), 12)


@register("monthly_evolution",
          "SELECT deposit_year, deposit_month, CASE WHEN deposit_year IS NOT NULL AND deposit_month IS NOT NULL "
          "AND deposit_year <> 0 AND deposit_month <> 0 THEN printf('%d-%02d', deposit_year, deposit_month) "
          "ELSE '—' END AS label, CAST(count(*) AS BIGINT) AS shipments, "
          "CAST(coalesce(sum(revenue_ca), 0) AS DECIMAL(38,3)) AS revenue, "
          f"{DELIVERED} AS delivered FROM national "
          "GROUP BY deposit_year, deposit_month HAVING deposit_year IS NOT NULL OR deposit_month IS NOT NULL")
def q_monthly_evolution(spark, sf):
    return grp.monthly_evolution(national(spark, sf))


@register("weight_buckets",
          "SELECT b.band_order, b.band, CAST(coalesce(c.n, 0) AS BIGINT) AS shipments FROM "
          "(VALUES (0, '0–2'), (1, '2–5'), (2, '5–10'), (3, '10–20'), (4, '20+')) b(band_order, band) "
          "LEFT JOIN (SELECT CASE WHEN weight_kg >= 0 AND weight_kg < 2 THEN '0–2' "
          "WHEN weight_kg >= 2 AND weight_kg < 5 THEN '2–5' WHEN weight_kg >= 5 AND weight_kg < 10 THEN '5–10' "
          "WHEN weight_kg >= 10 AND weight_kg < 20 THEN '10–20' WHEN weight_kg >= 20 AND weight_kg < 9999 "
          "THEN '20+' END AS band, count(*) AS n FROM national GROUP BY 1) c ON b.band = c.band")
def q_weight_buckets(spark, sf):
    return grp.weight_buckets(national(spark, sf))


@register("distinct_regions",
          "SELECT DISTINCT depot_region FROM national WHERE depot_region IS NOT NULL AND depot_region <> ''")
def q_distinct_regions(spark, sf):
    return grp.distinct_regions(national(spark, sf))


@register("distinct_next_regions",
          "SELECT DISTINCT CASE WHEN coalesce(trim(next_region), '') = '' THEN '(VIDE)' ELSE trim(next_region) END "
          "AS next_region FROM national")
def q_distinct_next_regions(spark, sf):
    return grp.distinct_next_regions(national(spark, sf))


# ── BI views ──────────────────────────────────────────────────────────────────

_MONTH_START = ("make_date(CASE WHEN {y} BETWEEN 1753 AND 9999 THEN {y} END, "
                "CASE WHEN {m} BETWEEN 1 AND 12 THEN {m} END, 1)")


@register("vw_national_shipments_clean",
          "SELECT mailitm_fid, weight_kg, crbt_amount, shipment_type, is_crbt, revenue_ca, deposit_date, "
          "deposit_year, deposit_month, "
          + _MONTH_START.format(y="deposit_year", m="deposit_month") + " AS deposit_month_start, "
          "depot_office, depot_region, last_event, last_event_date, last_event_office, last_event_region, "
          "next_region, interval_days, is_delivered, "
          "CASE WHEN is_delivered THEN 'Livré' ELSE 'Non livré' END AS delivery_status FROM national")
def q_vw_national_shipments_clean(spark, sf):
    return grp.vw_national_shipments_clean(national(spark, sf))


@register("vw_shipments_by_region",
          "SELECT depot_region, CAST(count(*) AS BIGINT) AS total_shipments, "
          f"{DELIVERED} AS delivered, CAST(sum(revenue_ca) AS DECIMAL(38,3)) AS revenue_total, "
          "CAST(count(*) FILTER (WHERE is_crbt) AS BIGINT) AS crbt_count, "
          f"round({SANE_AVG}, 6) AS avg_interval_days FROM national GROUP BY depot_region")
def q_vw_shipments_by_region(spark, sf):
    return grp.vw_shipments_by_region(national(spark, sf))


@register("vw_shipments_by_month",
          "SELECT deposit_year, deposit_month, CAST(count(*) AS BIGINT) AS total_shipments, "
          f"{DELIVERED} AS delivered, CAST(sum(revenue_ca) AS DECIMAL(38,3)) AS revenue_total, "
          + _MONTH_START.format(y="deposit_year", m="deposit_month") + " AS month_start "
          "FROM national WHERE deposit_year IS NOT NULL AND deposit_month IS NOT NULL "
          "GROUP BY deposit_year, deposit_month")
def q_vw_shipments_by_month(spark, sf):
    return grp.vw_shipments_by_month(national(spark, sf))


@register("vw_delivery_status",
          "SELECT CASE WHEN is_delivered THEN 'Livré' ELSE 'Non livré' END AS delivery_status, "
          "CAST(count(*) AS BIGINT) AS shipments, CAST(sum(revenue_ca) AS DECIMAL(38,3)) AS revenue_total "
          "FROM national GROUP BY 1")
def q_vw_delivery_status(spark, sf):
    return grp.vw_delivery_status(national(spark, sf))


@register("vw_failure_causes",
          "SELECT coalesce(last_event, '(inconnu)') AS failure_event, last_event_region, "
          "CAST(count(*) AS BIGINT) AS shipments FROM national WHERE NOT is_delivered GROUP BY 1, 2")
def q_vw_failure_causes(spark, sf):
    return grp.vw_failure_causes(national(spark, sf))


@register("stream_kpi_by_region", _kpi_sql(by="depot_region"))
def q_stream_kpi_by_region(spark, sf):
    """The flagship KPIs computed incrementally: the shipment table's files are
    read as a file stream and ``kpi_summary`` runs in complete output mode;
    the result is the stream's final state."""
    import uuid

    from ..sources.fixtures import shipments_path
    from ..streaming.incremental import read_shipment_stream, start_grouped
    path = shipments_path(spark, sf)
    if path is None:  # no materialised folder to stream from: batch result
        return agg.kpi_summary(national(spark, sf), by=["depot_region"])
    name = f"kpi_stream_{uuid.uuid4().hex[:8]}"
    stream = read_shipment_stream(spark, path).filter(F.col("source") == "national")
    q = start_grouped(lambda df: agg.kpi_summary(df, by=["depot_region"]), stream, name)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)
