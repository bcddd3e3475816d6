"""Registered queries: each scalar function (§2.9) applied to every national
row, plus the remaining composite operators (views, bundle, cut-offs,
ordering, clustering steps)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import REGISTRY, register
from ..functions import cleaning as C
from ..functions import formatting as FM
from ..functions import temporal as TM
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import grouped as G
from ..operators import report as rp
from ..operators import series as S
from ..operators import topk
from ..operators.cube import dashboard_bundle
from ..operators.order import with_position
from ..session import materialize
from ..sources.fixtures import national, shipments
from . import clustering as cl
from . import forecast as fc
from .queries_eda import r6
from .queries_ingest import raw_extract
from .queries_series import LONG, PANEL, SPLIT, H, panel, split


def _raw(spark, sf) -> DataFrame:
    return raw_extract(spark, sf, "national")


def _fn(name: str, sql_expr: str, spark_expr, source: str = "national"):
    """Register ``name``: (mailitm_fid, value) for every row."""
    def q(spark, sf):
        df = _raw(spark, sf) if source == "raw" else national(spark, sf)
        key = "MAILITM_FID" if source == "raw" else "mailitm_fid"
        return df.select(F.col(key).alias("mailitm_fid"), spark_expr(df).alias("value"))
    q.__doc__ = f"The ``{name}`` function over every national row."
    register(name, f"SELECT mailitm_fid, {sql_expr} AS value FROM national")(q)


CRBT = "coalesce(upper(trim(shipment_type)) = 'CRBT', false)"

# cleaning functions on the raw text rendering of the national rows
_fn("clean_str", "next_region", lambda d: C.clean_str(d["Region Next"]), "raw")
_fn("clean_str_verbatim", "'X'", lambda d: C.clean_str_verbatim(d["EDI_Event"]), "raw")
_fn("to_float", "weight_kg", lambda d: C.to_float(d["poids"]), "raw")
_fn("to_int", "interval_days", lambda d: C.to_int(d["Intervalle en jours"]), "raw")
_fn("to_datetime", "CAST(last_event_date AS TIMESTAMP)", lambda d: C.to_datetime(d["Date dernier E"]), "raw")
_fn("to_numeric_coerce", "CAST(interval_days AS DOUBLE)", lambda d: C.to_numeric_coerce(d["Intervalle en jours"]),
    "raw")
_fn("parse_amount_or_zero", "round_even(coalesce(CAST(revenue_ca AS DOUBLE), 0), 2)",
    lambda d: C.parse_amount_or_zero(d["CA"]), "raw")
# typed-column functions
_fn("is_delivered", "coalesce(lower(trim(last_event)) LIKE 'envoi liv%', false)",
    lambda d: C.is_delivered(d["last_event"]))
_fn("is_crbt", f"{CRBT} OR coalesce(crbt_amount > 0, false)", lambda d: C.is_crbt(d["shipment_type"], d["crbt_amount"]))
_fn("crbt_flag", CRBT, lambda d: C.crbt_flag(d["shipment_type"]))
_fn("valid_month", "CASE WHEN deposit_month BETWEEN 1 AND 12 THEN deposit_month END",
    lambda d: C.valid_month(d["deposit_month"]))
_fn("valid_year", "CASE WHEN deposit_year BETWEEN 1900 AND 9999 THEN deposit_year END",
    lambda d: C.valid_year(d["deposit_year"]))
_fn("month_start", "make_date(CASE WHEN deposit_year BETWEEN 1753 AND 9999 THEN deposit_year END, "
    "CASE WHEN deposit_month BETWEEN 1 AND 12 THEN deposit_month END, 1)",
    lambda d: C.month_start(d["deposit_year"], d["deposit_month"]))
_fn("delivery_status_label", "CASE WHEN is_delivered THEN 'Livré' ELSE 'Non livré' END",
    lambda d: FM.delivery_status_label(d["is_delivered"]))
_fn("unknown_label", "coalesce(last_event, '(inconnu)')", lambda d: FM.unknown_label(d["last_event"]))
_fn("bureau_category", "CASE WHEN lower(depot_office) LIKE '%agence%' THEN 'agences' WHEN lower(depot_office) "
    "LIKE '%centre%' OR lower(depot_office) LIKE '%cdc%' THEN 'centres' ELSE 'bureaux' END",
    lambda d: C.bureau_category(d["depot_office"]))
_fn("capitalize_type", "concat(upper(substr(trim(shipment_type), 1, 1)), lower(substr(trim(shipment_type), 2)))",
    lambda d: C.capitalize_type(d["shipment_type"]))
_fn("fr_thousands", "CASE WHEN coalesce(CAST(revenue_ca AS DOUBLE), 0) = 0 THEN '' ELSE "
    "replace(format('{:,.0f}', round_even(CAST(revenue_ca AS DOUBLE), 0)), ',', ' ') END",
    lambda d: FM.fr_thousands(d["revenue_ca"]))
_fn("clip_lower_0", "CASE WHEN interval_days IS NOT NULL THEN greatest(interval_days - 5, 0) END", lambda d: C.clip_lower_0(d["interval_days"] - 5))
_fn("date_day", "deposit_date", lambda d: TM.date_day(d["deposit_date"]))
_fn("date_label", "coalesce(strftime(last_event_date, '%Y-%m-%d'), '')", lambda d: TM.date_label(d["last_event_date"]))
_fn("year_month_label", "CASE WHEN deposit_year IS NOT NULL AND deposit_month IS NOT NULL AND deposit_year <> 0 "
    "AND deposit_month <> 0 THEN printf('%d-%02d', deposit_year, deposit_month) ELSE '—' END",
    lambda d: TM.year_month_label(d["deposit_year"], d["deposit_month"]))
_fn("weekday_name_fr", "['Lundi', 'Mardi', 'Mercredi', 'Jeudi', 'Vendredi', 'Samedi', 'Dimanche'][isodow(deposit_date)]",
    lambda d: TM.weekday_name_fr(d["deposit_date"]))
_fn("delay_days", "CAST(datediff('day', deposit_date, last_event_date) AS INTEGER)",
    lambda d: TM.delay_days(d["deposit_date"], d["last_event_date"]))
_fn("weight_class", "CASE WHEN weight_kg >= 0 AND weight_kg < 1 THEN '<1 kg' WHEN weight_kg >= 1 AND weight_kg < 5 "
    "THEN '1-5 kg' WHEN weight_kg >= 5 AND weight_kg < 10 THEN '5-10 kg' WHEN weight_kg >= 10 AND weight_kg < 30 "
    "THEN '10-30 kg' WHEN weight_kg >= 30 AND weight_kg < 70 THEN '30-70 kg' WHEN weight_kg >= 70 THEN '>70 kg' END",
    lambda d: FM.weight_class(d["weight_kg"]))
_fn("weight_band", "CASE WHEN weight_kg >= 0 AND weight_kg < 2 THEN '0–2' WHEN weight_kg >= 2 AND weight_kg < 5 "
    "THEN '2–5' WHEN weight_kg >= 5 AND weight_kg < 10 THEN '5–10' WHEN weight_kg >= 10 AND weight_kg < 20 "
    "THEN '10–20' WHEN weight_kg >= 20 AND weight_kg < 9999 THEN '20+' END",
    lambda d: FM.weight_band(d["weight_kg"]))
_fn("safe_name", "coalesce(regexp_replace(depot_region, '[^A-Za-z0-9_-]', '_', 'g'), 'national')",
    lambda d: FM.safe_name(d["depot_region"]))


# ── composites ───────────────────────────────────────────────────────────────

@register("filter_delay_bounds",
          "SELECT mailitm_fid, delay_days FROM (SELECT mailitm_fid, CAST(datediff('day', deposit_date, last_event_date) AS INTEGER) "
          "AS delay_days FROM national) WHERE delay_days BETWEEN 0 AND 30")
def q_filter_delay_bounds(spark, sf):
    d = national(spark, sf).select("mailitm_fid", TM.delay_days("deposit_date", "last_event_date").alias("delay_days"))
    return FL.filter_delay_bounds(d)


@register("select_numeric",
          "SELECT weight_kg, crbt_amount, revenue_ca, deposit_year, deposit_month, interval_days FROM national")
def q_select_numeric(spark, sf):
    cols = ["mailitm_fid", "weight_kg", "crbt_amount", "revenue_ca", "deposit_year", "deposit_month",
            "interval_days", "depot_region", "is_delivered"]
    return FL.select_numeric(national(spark, sf).select(cols))


BI_VIEWS = {
    "vw_national_shipments_clean": G.vw_national_shipments_clean, "vw_kpi_national": A.vw_kpi_national,
    "vw_shipments_by_region": G.vw_shipments_by_region, "vw_shipments_by_month": G.vw_shipments_by_month,
    "vw_delivery_status": G.vw_delivery_status, "vw_failure_causes": G.vw_failure_causes,
}


def register_bi_views(df: DataFrame) -> list[str]:
    """Create the six reporting views as temporary views over ``df``."""
    for name, op in BI_VIEWS.items():
        op(df).createOrReplaceTempView(name)
    return list(BI_VIEWS)


@register("bi_views",
          "SELECT 'vw_national_shipments_clean' AS view_name, CAST(count(*) AS BIGINT) AS n FROM national "
          "UNION ALL SELECT 'vw_kpi_national', 1 "
          "UNION ALL SELECT 'vw_shipments_by_region', CAST(count(DISTINCT depot_region) + max(CASE WHEN depot_region "
          "IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM national "
          "UNION ALL SELECT 'vw_shipments_by_month', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT deposit_year, "
          "deposit_month FROM national WHERE deposit_year IS NOT NULL AND deposit_month IS NOT NULL) "
          "UNION ALL SELECT 'vw_delivery_status', CAST(count(DISTINCT is_delivered) AS BIGINT) FROM national "
          "UNION ALL SELECT 'vw_failure_causes', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT "
          "coalesce(last_event, '(inconnu)'), last_event_region FROM national WHERE NOT is_delivered)")
def q_bi_views(spark, sf):
    """Register the six views, then count each through Spark SQL."""
    names = register_bi_views(national(spark, sf))
    parts = [spark.sql(f"SELECT '{n}' AS view_name, count(*) AS n FROM {n}") for n in names]
    return reduce(DataFrame.unionByName, parts)


@register("align_features",
          "SELECT trim(last_event_office) AS office, CAST(count(*) AS BIGINT) AS n, "
          "CAST(count(*) FILTER (WHERE is_delivered) AS BIGINT) AS delivered, round(avg(CAST(interval_days AS DOUBLE)), 6) "
          "AS avg_interval, CAST(sum(revenue_ca) AS DECIMAL(38,3)) AS revenue FROM national GROUP BY 1")
def q_align_features(spark, sf):
    """Several per-office series assembled in one multi-aggregate group-by (no joins)."""
    return r6(national(spark, sf).groupBy(C.strip_ws("last_event_office").alias("office")).agg(
        F.count(F.lit(1)).alias("n"), A.count_if(F.col("is_delivered")).alias("delivered"),
        F.avg(F.col("interval_days").cast("double")).alias("avg_interval"),
        F.sum("revenue_ca").cast("decimal(38,3)").alias("revenue")))


@register("self_join_corr",
          "WITH top AS (SELECT depot_region FROM national WHERE depot_region IS NOT NULL GROUP BY 1 "
          "ORDER BY sum(weight_kg) DESC, depot_region LIMIT 5), d AS (SELECT deposit_date AS ds, depot_region, "
          "sum(weight_kg) AS y FROM national WHERE depot_region IN (SELECT * FROM top) GROUP BY 1, 2) "
          "SELECT a.depot_region AS col_a, b.depot_region AS col_b, round(corr(a.y, b.y), 6) AS corr "
          "FROM d a JOIN d b ON a.ds = b.ds AND a.depot_region < b.depot_region GROUP BY 1, 2")
def q_self_join_corr(spark, sf):
    """Correlation of the regions' daily weights: the per-date matrix is built by
    pivoting (bounded top list) instead of a self-join, then all pairs in one aggregation."""
    from ..operators import eda
    fine, top = topk.aggregate_top_groups(national(spark, sf), F.col("deposit_date"), "depot_region",
                                          "weight_kg", 5, "sum")
    top = sorted(top)
    wide = fine.groupBy(F.col("_key").alias("ds")).pivot("depot_region", top).agg(F.sum("_v"))
    return r6(eda.corr_matrix(wide, top))


DASH_KPIS = ["total_shipments", "total_revenue", "total_crbt_count", "total_crbt_amount", "delivered", "failed", "delivery_rate",
             "avg_interval_days", "late_deliveries", "late_threshold"]
DASH_WEIGHTS = ["avg_weight", "min_weight", "max_weight", "total_weight"]


def _dash_sql() -> str:
    from .queries_core import _kpi_sql
    show = "coalesce(nullif({c}, ''), '—')"
    scoped, unscoped = "(SELECT * FROM open WHERE depot_region = 'ASIA')", "open"
    long = lambda part, cols, sql: [f"SELECT '{part}' AS part, '{c}' AS label, CAST({c} AS DOUBLE) AS value FROM ({sql})" for c in cols]
    bands = " ".join(f"WHEN weight_kg >= {lo} AND weight_kg < {hi} THEN '{lbl}'" for lo, hi, lbl in
                     [(lo, 1e18 if hi is None else hi, lbl) for lo, hi, lbl in FM.WEIGHT_BANDS])
    month = "CONCAT(CAST(deposit_year AS VARCHAR), '-', lpad(CAST(deposit_month AS VARCHAR), 2, '0'))"
    parts = [
        "SELECT 'regions' AS part, depot_region AS label, CAST(NULL AS DOUBLE) AS value FROM national WHERE depot_region <> '' GROUP BY 2",
        *long("kpis", DASH_KPIS, _kpi_sql().replace("FROM national", f"FROM {scoped}")),
        f"SELECT 'by_region', {show.format(c='depot_region')}, CAST(count(*) AS DOUBLE) FROM {unscoped} GROUP BY depot_region",
        f"SELECT * FROM (SELECT 'by_office', {show.format(c='depot_office')}, CAST(count(*) AS DOUBLE) FROM {scoped} GROUP BY depot_office "
        "ORDER BY count(*) DESC, depot_office NULLS FIRST LIMIT 15)",
        *long("delivery_status", ["delivered", "failed", "total"], "SELECT count(*) FILTER (WHERE is_delivered) AS delivered, "
              f"count(*) FILTER (WHERE NOT is_delivered) AS failed, count(*) AS total FROM {scoped}"),
        f"SELECT * FROM (SELECT 'failure_causes', {show.format(c='last_event')}, CAST(count(*) AS DOUBLE) FROM {scoped} WHERE NOT is_delivered "
        "GROUP BY last_event ORDER BY count(*) DESC, last_event NULLS FIRST LIMIT 12)",
        f"SELECT 'monthly', {month}, CAST(count(*) AS DOUBLE) FROM {scoped} GROUP BY deposit_year, deposit_month",
        *long("weight_stats", DASH_WEIGHTS, "SELECT round_even(avg(weight_kg), 2) AS avg_weight, min(weight_kg) AS min_weight, "
              f"max(weight_kg) AS max_weight, round_even(coalesce(sum(weight_kg), 0.0), 1) AS total_weight FROM {scoped}"),
        "SELECT 'weight_buckets', k.label, CAST(count(b.label) AS DOUBLE) FROM (SELECT unnest(["
        + ", ".join(f"'{lbl}'" for _, _, lbl in FM.WEIGHT_BANDS) + f"]) AS label) k LEFT JOIN (SELECT CASE {bands} END AS label FROM {scoped}) b "
        "USING (label) GROUP BY k.label",
        f"SELECT 'revenue_by_region', {show.format(c='depot_region')}, CAST(coalesce(sum(revenue_ca), 0) AS DOUBLE) FROM {unscoped} GROUP BY depot_region",
    ]
    return ("WITH open AS (SELECT * FROM national WHERE depot_office ILIKE '%agence%') SELECT part, label, round(value, 6) AS value FROM ("
            + " UNION ALL ".join(parts) + ")")


@register("dashboard_bundle", _dash_sql())
def q_dashboard_bundle(spark, sf):
    """All ten parts of the bundle for region ASIA, agencies only, as (part, label, value) rows."""
    b = dashboard_bundle(national(spark, sf), "ASIA", None, ["agences"])
    row = lambda part, label, value: b[part].select(F.lit(part).alias("part"), F.col(label).alias("label"),
                                                    F.col(value).cast("double").alias("value"))
    wide = lambda part, cols: b[part].select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "label", "value").select(F.lit(part).alias("part"), "label", "value")
    parts = [b["regions"].select(F.lit("regions").alias("part"), F.col("depot_region").alias("label"), F.lit(None).cast("double").alias("value")),
             wide("kpis", DASH_KPIS), row("by_region", "depot_region", "shipments"), row("by_office", "depot_office", "shipments"),
             wide("delivery_status", ["delivered", "failed", "total"]), row("failure_causes", "last_event", "shipments"),
             row("monthly", "label", "shipments"), wide("weight_stats", DASH_WEIGHTS), row("weight_buckets", "band", "shipments"),
             row("revenue_by_region", "depot_region", "revenue")]
    return r6(reduce(DataFrame.union, parts))


@register("feature_cutoff",
          "WITH panel AS (SELECT deposit_date AS ds, coalesce(CAST(depot_region AS VARCHAR), 'INCONNU') AS unique_id, "
          "sum(greatest(coalesce(CAST(weight_kg AS DOUBLE), 0), 0)) AS poids FROM national WHERE deposit_date IS NOT NULL "
          "AND isodow(deposit_date) <= 5 GROUP BY 1, 2), l AS (SELECT unique_id, ds, poids AS y, "
          "lag(poids, 22) OVER (PARTITION BY unique_id ORDER BY ds) AS lag_22 FROM panel WHERE unique_id IN "
          "(SELECT unique_id FROM panel GROUP BY 1 HAVING count(*) >= 20)) "
          "SELECT unique_id, ds, round(y, 6) AS y FROM l WHERE lag_22 IS NOT NULL")
def q_feature_cutoff(spark, sf):
    """Rows kept once the longest lag exists."""
    long = S.to_long_series(panel(spark, sf), "poids", 20)
    return r6(S.lag_features(long, [22]).filter(F.col("lag_22").isNotNull()).select("unique_id", "ds", "y"))


@register("first_per_day",
          "SELECT deposit_date AS day, CAST(isodow(deposit_date) - 1 AS INTEGER) AS day_of_week FROM national "
          "WHERE deposit_date IS NOT NULL GROUP BY deposit_date")
def q_first_per_day(spark, sf):
    """Weekday of each deposit day (a function of the day, so no 'first' aggregate is needed)."""
    return national(spark, sf).filter(F.col("deposit_date").isNotNull()).select(
        F.col("deposit_date").alias("day")).distinct().withColumn("day_of_week", TM.weekday0("day"))


@register("mae",
          "WITH panel AS (SELECT deposit_date AS ds, coalesce(CAST(depot_region AS VARCHAR), 'INCONNU') AS unique_id, "
          "sum(greatest(coalesce(CAST(weight_kg AS DOUBLE), 0), 0)) AS poids FROM national WHERE deposit_date IS NOT NULL "
          "AND isodow(deposit_date) <= 5 GROUP BY 1, 2), long AS (SELECT unique_id, ds, poids AS y FROM panel "
          "WHERE unique_id IN (SELECT unique_id FROM panel GROUP BY 1 HAVING count(*) >= 20)) "
          "SELECT round(avg(abs(y - prev)), 6) AS MAE, round(sqrt(avg((y - prev) * (y - prev))), 6) AS RMSE, "
          "round(avg(CASE WHEN (abs(y) + abs(prev)) / 2 = 0 THEN 0.0 ELSE abs(y - prev) / ((abs(y) + abs(prev)) / 2) END)"
          " * 100, 6) AS SMAPE, round(1.0 - sum((y - prev) * (y - prev)) / nullif(var_pop(y) * count(y), 0), 6) AS R2 "
          "FROM (SELECT y, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS prev FROM long) WHERE prev IS NOT NULL")
def q_mae(spark, sf):
    """MAE, RMSE, SMAPE and R² of one-step naive predictions over all series days."""
    long = S.to_long_series(panel(spark, sf), "poids", 20)
    prev = F.lag("y").over(W.partitionBy("unique_id").orderBy("ds"))
    return r6(fc.metrics(long.select("y", prev.alias("y_hat")).filter(F.col("y_hat").isNotNull())))


# ── clustering steps ─────────────────────────────────────────────────────────

BUREAU_FEATS = ["taux_livraison", "avg_intervalle", "total_colis", "total_ca", "taux_crbt"]


def _bureau_scaled(spark, sf):
    f = materialize(cl.impute_median(cl.features_bureau(national(spark, sf)), BUREAU_FEATS))
    return cl.standardise(f, BUREAU_FEATS)


def _labelled(spark, sf) -> DataFrame:
    """Offices with labels set by a rule that both engines state (by scaled volume and CRBT share):
    what the steps after a clustering do is checked on those, over all offices."""
    rule = F.when(F.col("z_total_colis") > 0.3, 2).when(F.col("z_taux_crbt") > 0, 0).otherwise(1)
    return _bureau_scaled(spark, sf).withColumn("raw", rule.cast("int"))


_LABELLED = (
    "f AS (SELECT trim(depot_office) AS name, avg(CAST(is_delivered AS DOUBLE)) * 100 AS taux_livraison, avg(CAST(interval_days AS DOUBLE)) "
    "AS avg_intervalle, CAST(count(*) AS DOUBLE) AS total_colis, sum(CAST(revenue_ca AS DOUBLE)) AS total_ca, "
    "avg(CAST(is_crbt AS DOUBLE)) * 100 AS taux_crbt FROM national WHERE trim(depot_office) IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), "
    "g AS (SELECT name, " + ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in BUREAU_FEATS) + " FROM f), "
    "z AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS z_{c}"
                                   for c in BUREAU_FEATS) + " FROM g), "
    "raws AS (SELECT *, CASE WHEN z_total_colis > 0.3 THEN 2 WHEN z_taux_crbt > 0 THEN 0 ELSE 1 END AS raw FROM z), "
    "ranks AS (SELECT raw, CAST(row_number() OVER (ORDER BY avg(taux_livraison) DESC, raw) - 1 AS INTEGER) AS cluster FROM raws GROUP BY raw), "
    "labelled AS (SELECT raws.*, cluster FROM raws JOIN ranks USING (raw))")
_LABEL_NAME = "CASE cluster " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cl.NAMES["bureau"].items()) + " END"


def _relabelled(spark, sf) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in cl.NAMES["bureau"].items() for x in kv])
    a = cl.relabel_by_mean(_labelled(spark, sf), "taux_livraison", False)
    return a.withColumn("cluster_label", F.element_at(names, F.col("cluster")))


@register("kmeans")
def q_kmeans(spark, sf):
    """Raw k-means assignment (k=3, best of 10 seeds) of the office features."""
    scaled = _bureau_scaled(spark, sf)
    return cl.kmeans_best(scaled, 3).select("name", F.col("raw").cast("int").alias("raw"))


@register("relabel_by_mean", f"WITH {_LABELLED} SELECT name, cluster, round_even(taux_livraison, 2) AS taux_livraison FROM labelled")
def q_relabel_by_mean(spark, sf):
    """Offices renumbered by descending mean delivery rate of their label."""
    a = _relabelled(spark, sf)
    return a.select("name", F.col("cluster").cast("int").alias("cluster"), F.bround("taux_livraison", 2).alias("taux_livraison"))


_ZS = [f"z_{c}" for c in BUREAU_FEATS]
_INDICES = (
    f"WITH {_LABELLED}, cent AS (SELECT cluster, count(*) AS n, " + ", ".join(f"avg({z}) AS {z}" for z in _ZS) + " FROM labelled GROUP BY cluster), "
    "dist AS (SELECT l.cluster, sqrt(" + " + ".join(f"(l.{z} - c.{z}) ** 2" for z in _ZS) + ") AS d FROM labelled l JOIN cent c USING (cluster)), "
    "spread AS (SELECT cluster, avg(d) AS s, sum(d * d) AS w FROM dist GROUP BY cluster), "
    "pairs AS (SELECT a.cluster, max((sa.s + sb.s) / sqrt(" + " + ".join(f"(a.{z} - b.{z}) ** 2" for z in _ZS) + ")) AS r FROM cent a JOIN cent b "
    "ON a.cluster <> b.cluster JOIN spread sa ON sa.cluster = a.cluster JOIN spread sb ON sb.cluster = b.cluster GROUP BY a.cluster), "
    "mid AS (SELECT " + ", ".join(f"avg({z}) AS {z}" for z in _ZS) + ", count(*) AS total, count(DISTINCT cluster) AS k FROM labelled), "
    "indices AS (SELECT (SELECT avg(r) FROM pairs) AS davies_bouldin, (SELECT sum(n * (" + " + ".join(f"(c.{z} - m.{z}) ** 2" for z in _ZS)
    + ")) FROM cent c, mid m) / (k - 1) / ((SELECT sum(w) FROM spread) / (total - k)) AS calinski_harabasz, k FROM mid) ")


def _indices(spark, sf):
    return cl.quality_indices(_relabelled(spark, sf), len(BUREAU_FEATS))


@register("silhouette",
          f"WITH {_LABELLED}, far AS (SELECT l.name, l.cluster, r.cluster AS other, sum(sqrt(" + " + ".join(f"(l.{z} - r.{z}) ** 2" for z in _ZS)
          + ")) AS d, count(*) AS n FROM labelled l, labelled r GROUP BY 1, 2, 3), "
          "ab AS (SELECT name, max(CASE WHEN other = cluster THEN d / greatest(n - 1, 1) END) AS a, max(CASE WHEN other = cluster THEN n END) AS n, "
          "min(CASE WHEN other <> cluster THEN d / n END) AS b FROM far GROUP BY name) "
          "SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab")
def q_silhouette(spark, sf):
    """Exact mean Euclidean silhouette of the labelled offices."""
    return r6(_indices(spark, sf).select("silhouette"))


@register("davies_bouldin", _INDICES + "SELECT round(davies_bouldin, 6) AS davies_bouldin FROM indices")
def q_davies_bouldin(spark, sf):
    return r6(_indices(spark, sf).select("davies_bouldin"))


@register("calinski_harabasz", _INDICES + "SELECT round(calinski_harabasz, 6) AS calinski_harabasz, CAST(k AS INTEGER) AS n_clusters FROM indices")
def q_calinski_harabasz(spark, sf):
    return r6(_indices(spark, sf).select("calinski_harabasz", "n_clusters"))


@register("grade_metrics", _INDICES + "SELECT round(davies_bouldin, 6) AS davies_bouldin, CASE WHEN davies_bouldin < 0.8 THEN 'good' "
          "WHEN davies_bouldin < 1.5 THEN 'warn' ELSE 'bad' END AS davies_bouldin_grade, round(calinski_harabasz, 6) AS calinski_harabasz, "
          "CASE WHEN calinski_harabasz > 50 THEN 'good' WHEN calinski_harabasz > 20 THEN 'warn' ELSE 'bad' END AS calinski_harabasz_grade FROM indices")
def q_grade_metrics(spark, sf):
    """Quality indices of the labelled offices with good / warn / bad grades."""
    g = cl.grade_metrics(_indices(spark, sf))
    return r6(g.select("davies_bouldin", "davies_bouldin_grade", "calinski_harabasz", "calinski_harabasz_grade"))


@register("cluster_rows")
def q_cluster_rows(spark, sf):
    """Named office clusters with features at 2 dp."""
    rows, _ = cl.cluster_bureau(national(spark, sf))
    return rows


@register("cluster_profile", f"WITH {_LABELLED} SELECT cluster, {_LABEL_NAME} AS cluster_label, CAST(count(*) AS BIGINT) AS n, "
          + ", ".join(f"round_even(avg({c}), 2) AS {c}" for c in BUREAU_FEATS) + " FROM labelled GROUP BY cluster")
def q_cluster_profile(spark, sf):
    """Offices and mean features of each label."""
    return cl.cluster_profile(_relabelled(spark, sf), BUREAU_FEATS).withColumn("cluster", F.col("cluster").cast("int"))


@register("cluster_summary_bureau", f"WITH {_LABELLED} SELECT k.cluster, CAST(count(l.name) AS BIGINT) AS offices, "
          "coalesce(round_even(avg(taux_livraison), 1), 0.0) AS avg_taux, coalesce(round_even(avg(avg_intervalle), 1), 0.0) AS avg_itv "
          "FROM (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS cluster) k LEFT JOIN labelled l USING (cluster) GROUP BY k.cluster")
def q_cluster_summary_bureau(spark, sf):
    """Four slots, one of them empty."""
    return cl.cluster_summary_bureau(_relabelled(spark, sf), 4)


@register("cluster_summary_day",
          "WITH d AS (SELECT deposit_date, CAST(count(*) AS DOUBLE) AS daily_volume, isodow(deposit_date) AS dow FROM national "
          "WHERE deposit_date IS NOT NULL GROUP BY 1), l AS (SELECT *, CASE WHEN dow <= 2 THEN 0 WHEN dow <= 5 THEN 1 ELSE 2 END AS cluster FROM d) "
          "SELECT CAST(cluster AS INTEGER) AS cluster, CASE cluster " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cl.NAMES["day"].items())
          + " END AS cluster_label, CAST(count(*) AS BIGINT) AS days, round_even(avg(nullif(daily_volume, 0)), 1) AS avg_volume FROM l GROUP BY cluster")
def q_cluster_summary_day(spark, sf):
    """Days and mean volume of each day type; types set by weekday."""
    names = F.create_map(*[F.lit(x) for kv in cl.NAMES["day"].items() for x in kv])
    days = cl.features_day(national(spark, sf))
    kind = F.when(F.col("day_of_week") < 2, 0).when(F.col("day_of_week") < 5, 1).otherwise(2).cast("int")
    rows = days.withColumn("cluster", kind).withColumn("cluster_label", F.element_at(names, F.col("cluster")))
    return cl.cluster_summary_day(rows)


@register("sort_cluster_rows", f"WITH {_LABELLED} SELECT name, cluster, CAST(row_number() OVER (ORDER BY cluster, name) - 1 AS BIGINT) AS position FROM labelled")
def q_sort_cluster_rows(spark, sf):
    """Labelled offices with their display position (cluster, then name)."""
    rows = _relabelled(spark, sf).select("name", F.col("cluster").cast("int").alias("cluster"))
    return with_position(rows, ["cluster", "name"])


# ── the region report ────────────────────────────────────────────────────────

REPORT_PARTS = {"report_kpis": "report_kpis_by_region", "depot_kpis": "depot_kpis", "depot_table": "depot_table", "export_table": "depot_table_export",
                "depot_drill": "depot_drill", "export_drill": "export_drill", "depot_slider": "depot_slider", "livraison_kpis": "livraison_kpis",
                "livraison_table": "livraison_table_long", "import_table": "livraison_table_long_import", "livraison_drill": "livraison_drill",
                "import_drill": "import_drill", "livraison_slider": "livraison_slider"}
#: What of each part is compared: # marks doubles, taken to two places.
REPORT_COLUMNS = {"report_kpis": "livres total #taux #avg_intervalle total_ca crbt", "depot_kpis": "scope total crbt ordinaire ca ca_crbt ca_ordinaire",
                  "depot_table": "office is_total crbt ca #poids nb_ids", "export_table": "office is_total crbt ca #poids nb_ids",
                  "depot_drill": "office subkey id ca type", "export_drill": "office subkey id poids ca", "depot_slider": "b d t #c #p",
                  "livraison_kpis": "scope total crbt ordinaire ca #taux #avg_intervalle", "livraison_table": "office is_total event n",
                  "import_table": "office is_total event n", "livraison_drill": "office subkey id event type ca interval poids",
                  "import_drill": "office subkey id event interval poids", "livraison_slider": "b d e t #c #p"}


def _content(part: str) -> str:
    """A row of a part as text, in SQL that both engines read."""
    text = lambda c: f"CAST(CAST(round({c[1:]}, 2) AS DECIMAL(20,2)) AS {{text}})" if c[0] == "#" else f"CAST({c} AS {{text}})"
    return "md5(concat_ws('|', " + ", ".join(f"coalesce({text(c)}, '~')" for c in REPORT_COLUMNS[part].split()) + "))"


def _report_sql() -> str:
    file = "coalesce(regexp_replace(region, '[^A-Za-z0-9_-]', '_', 'g'), 'national')"
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {file} AS region_file, CAST(count(*) AS BIGINT) AS count, "
                              f"CAST(sum(CAST('0x' || {_content(part).format(text='VARCHAR')}[1:12] AS BIGINT)) AS DECIMAL(38,0)) AS content "
                              f"FROM ({REGISTRY[q][1]}) GROUP BY 2" for part, q in REPORT_PARTS.items())


def _written(spark, parts: dict[str, DataFrame]) -> DataFrame:
    """Rows, and the sum of the rows' hashes, of every part and region, as read back from the written report."""
    from ..sources.sinks import scratch_path, write_region_reports
    out = write_region_reports(parts, scratch_path(spark, "region-report"), fmt="parquet")
    number = lambda part: F.conv(F.substring(F.expr(_content(part).format(text="STRING")), 1, 12), 16, 10).cast("decimal(20,0)")
    counts = [spark.read.parquet(p).groupBy("region_file").agg(F.count(F.lit(1)).alias("count"), F.sum(number(name)).cast("decimal(38,0)").alias("content"))
              .withColumn("part", F.lit(name)) for name, p in out.items()]
    return reduce(DataFrame.unionByName, counts)


def register_region_report() -> None:
    """Registered last: its statement is made of the parts' own."""

    @register("region_report", raw_sql=_report_sql())
    def q_region_report(spark, sf):
        """Every region's report, all parts, written in one job per part and partitioned by
        region; rows and a hash of the content by part and region."""
        return _written(spark, rp.region_report(shipments(spark, sf))).select("part", "region_file", "count", "content")

    @register("region_report_scoped",
              "SELECT 'depot_table' AS part, 'ASIA' AS region_file, CAST(count(DISTINCT depot_office) + 1 AS BIGINT) AS count FROM national "
              "WHERE depot_region = 'ASIA' AND next_region IN ('AMERICA') AND depot_office ILIKE '%agence%' UNION ALL "
              "SELECT 'depot_slider', 'ASIA', CAST(count(*) AS BIGINT) FROM national WHERE depot_region = 'ASIA' AND next_region IN ('AMERICA') "
              "AND depot_office ILIKE '%agence%' UNION ALL SELECT 'report_kpis', 'ASIA', 1")
    def q_region_report_scoped(spark, sf):
        """The depot half for one region, next region and office category."""
        parts = rp.region_report(shipments(spark, sf), "ASIA", ["AMERICA"], cat_depot=["agences"], include_livraison=False)
        assert not any(k.startswith("livraison") for k in parts)
        return _written(spark, {k: parts[k] for k in ("report_kpis", "depot_table", "depot_slider")}).select("part", "region_file", "count")


@register("naive_test_window",
          "WITH " + ", ".join([PANEL, LONG(), SPLIT])
          + " SELECT unique_id, CAST(count(*) AS BIGINT) AS test_rows, min(ds) AS first_test_day FROM test GROUP BY 1")
def q_naive_test_window(spark, sf):
    """Test-window rows per series used by the forecast comparison."""
    train, test = split(spark, sf)
    return test.groupBy("unique_id").agg(F.count(F.lit(1)).alias("test_rows"), F.min("ds").alias("first_test_day"))
