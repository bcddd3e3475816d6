"""Registered queries: clustering feature tables (oracle-checked), clustering
runs and boosted-tree forecasting (rows-only: model output)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import series
from ..sources.fixtures import national
from . import clustering as cl
from . import forecast as fc
from .queries_eda import r6
from ..session import materialize
from .queries_series import COMBOS, H, LONG, PANEL, SPLIT, _cmp_spark, all_long, named, split

PCT = "avg(CAST({c} AS DOUBLE)) * 100"


@register("features_bureau",
          "SELECT trim(depot_office) AS name, round(CAST(count(*) AS DOUBLE), 6) AS total_colis, "
          f"round({PCT.format(c='is_delivered')}, 6) AS taux_livraison, round(avg(CAST(interval_days AS DOUBLE)), 6) "
          "AS avg_intervalle, round(sum(CAST(revenue_ca AS DOUBLE)), 6) AS total_ca, "
          f"round({PCT.format(c='is_crbt')}, 6) AS taux_crbt FROM national WHERE trim(depot_office) IS NOT NULL "
          "GROUP BY 1 HAVING count(*) >= 5")
def q_features_bureau(spark, sf):
    return r6(cl.features_bureau(national(spark, sf)))


@register("features_region",
          "SELECT trim(depot_region) AS name, round(CAST(count(*) AS DOUBLE), 6) AS total_colis, "
          f"round({PCT.format(c='is_delivered')}, 6) AS taux_livraison, round(avg(CAST(revenue_ca AS DOUBLE)), 6) AS avg_ca, "
          f"round({PCT.format(c='is_crbt')}, 6) AS taux_crbt, round(avg(CAST(interval_days AS DOUBLE)), 6) AS avg_intervalle "
          "FROM national WHERE coalesce(trim(depot_region), '') <> '' GROUP BY 1")
def q_features_region(spark, sf):
    return r6(cl.features_region(national(spark, sf)))


@register("features_day",
          "SELECT strftime(deposit_date, '%Y-%m-%d') AS name, round(CAST(count(*) AS DOUBLE), 6) AS daily_volume, "
          f"round({PCT.format(c='is_delivered')}, 6) AS daily_taux_liv, round(sum(CAST(revenue_ca AS DOUBLE)), 6) AS daily_ca, "
          "CAST(isodow(deposit_date) - 1 AS DOUBLE) AS day_of_week FROM national WHERE deposit_date IS NOT NULL "
          "GROUP BY deposit_date")
def q_features_day(spark, sf):
    """Per day features; the weekday is a function of the day (first_per_day)."""
    return r6(cl.features_day(national(spark, sf)))


@register("features_vehicle",
          "SELECT name, round(total_colis, 6) AS total_colis, round(total_poids, 6) AS total_poids, "
          "round(avg_poids, 6) AS avg_poids, round(nb_bureaux, 6) AS nb_bureaux, "
          "round(total_colis / nullif(nb_bureaux, 0), 6) AS densite_colis, round(taux_crbt, 6) AS taux_crbt FROM ("
          "SELECT trim(depot_region) AS name, CAST(count(*) AS DOUBLE) AS total_colis, sum(CAST(weight_kg AS DOUBLE)) "
          "AS total_poids, avg(CAST(weight_kg AS DOUBLE)) AS avg_poids, CAST(count(DISTINCT depot_office) AS DOUBLE) "
          f"AS nb_bureaux, {PCT.format(c='is_crbt')} AS taux_crbt FROM national "
          "WHERE coalesce(trim(depot_region), '') <> '' GROUP BY 1)")
def q_features_vehicle(spark, sf):
    return r6(cl.features_vehicle(national(spark, sf)))


_BUREAU_FEATS = ["taux_livraison", "avg_intervalle", "total_colis", "total_ca", "taux_crbt"]


@register("impute_median",
          "WITH f AS (SELECT trim(depot_office) AS name, avg(CAST(interval_days AS DOUBLE)) AS avg_intervalle "
          "FROM national WHERE trim(depot_office) IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) "
          "SELECT name, round(coalesce(avg_intervalle, (SELECT quantile_cont(avg_intervalle, 0.5) FROM f)), 6) "
          "AS avg_intervalle FROM f")
def q_impute_median(spark, sf):
    f = cl.features_bureau(national(spark, sf)).select("name", "avg_intervalle")
    return r6(cl.impute_median(f, ["avg_intervalle"]))


@register("standardise",
          "WITH f AS (SELECT trim(depot_office) AS name, CAST(count(*) AS DOUBLE) AS total_colis FROM national "
          "WHERE trim(depot_office) IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) "
          "SELECT name, round((total_colis - (SELECT avg(total_colis) FROM f)) / (SELECT CASE WHEN stddev_pop(total_colis) "
          "> 0 THEN stddev_pop(total_colis) ELSE 1 END FROM f), 6) AS z_total_colis FROM f")
def q_standardise(spark, sf):
    f = cl.features_bureau(national(spark, sf)).select("name", "total_colis")
    return r6(cl.standardise(f, ["total_colis"]).select("name", "z_total_colis"))


def _rows_and_metrics(rows, metrics, analysis):
    m = metrics.first()
    return rows.withColumn("analysis", F.lit(analysis)).withColumn("silhouette", F.lit(m["silhouette"])) \
        .withColumn("davies_bouldin", F.lit(m["davies_bouldin"])) \
        .withColumn("calinski_harabasz", F.lit(m["calinski_harabasz"]))


@register("cluster_bureau")
def q_cluster_bureau(spark, sf):
    """k-means (k=3, best of 10 seeds) on office features; clusters ordered by delivery rate."""
    rows, metrics = cl.cluster_bureau(national(spark, sf))
    return r6(_rows_and_metrics(rows, metrics, "bureau"))


@register("cluster_parcel")
def q_cluster_parcel(spark, sf):
    """k-means (k=4) over every complete parcel row; per-cluster profile."""
    rows, metrics = cl.cluster_parcel(national(spark, sf))
    prof = cl.cluster_profile(rows, ["_itv", "_ca", "_poids", "_crbt", "_del"])
    m = metrics.first()
    return r6(prof.withColumn("silhouette", F.lit(m["silhouette"])))


@register("cluster_region")
def q_cluster_region(spark, sf):
    rows, metrics = cl.cluster_region(national(spark, sf))
    return r6(_rows_and_metrics(rows, metrics, "region"))


@register("cluster_day")
def q_cluster_day(spark, sf):
    rows, metrics = cl.cluster_day(national(spark, sf))
    return r6(_rows_and_metrics(rows, metrics, "day"))


@register("cluster_vehicle")
def q_cluster_vehicle(spark, sf):
    rows, metrics = cl.cluster_vehicle(national(spark, sf))
    return r6(_rows_and_metrics(rows, metrics, "vehicle"))


@register("cluster_all")
def q_cluster_all(spark, sf):
    """All five analyses from one cached projection; one metrics row each."""
    from ..operators.filters import scan_ml_columns
    nat = national(spark, sf)
    base = nat.select(*scan_ml_columns(nat).columns, "mailitm_fid").cache()
    out = []
    for name, fn in (("bureau", cl.cluster_bureau), ("region", cl.cluster_region), ("day", cl.cluster_day),
                     ("vehicle", cl.cluster_vehicle)):
        _, m = fn(base)
        out.append(m.withColumn("analysis", F.lit(name)))
    _, m = cl.cluster_parcel(base)
    out.append(m.withColumn("analysis", F.lit("parcel")))
    base.unpersist()  # the metrics rows are local; nothing reads the projection any more
    return r6(reduce(lambda a, b: a.unionByName(b), out))


def _gbt_frames(long):
    """Train and test rows of one dataset and target with their features."""
    feats = materialize(series.add_features(long))
    s = series.train_test_cutoff(feats, H)
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


_FITTED: dict[tuple[str, str], list] = {}


def _gbt_all(spark, sf) -> list:
    """(dataset, target, predictions, model, feature names) of every combination; fitted once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _FITTED:
        long, found = all_long(spark, sf), []
        for dataset, target in COMBOS:
            own = long.filter((F.col("dataset") == dataset) & (F.col("target") == target)).select("unique_id", "ds", "y")
            pred, model, feats = fc.gbt_forecast(*_gbt_frames(own))
            found.append((dataset, target, materialize(pred), model, feats))
        _FITTED[key] = found
    return _FITTED[key]


@register("gbt_forecast")
def q_gbt_forecast(spark, sf):
    """Global boosted trees (depth 6, step 0.05, up to 800 rounds, stopped on a chronological
    validation part) per dataset and target; test predictions ≥ 0."""
    return r6(named(fc.union_forecasts([pred for _, _, pred, _, _ in _gbt_all(spark, sf)])))


@register("gbt_metrics")
def q_gbt_metrics(spark, sf):
    """The trees' errors on the test window, per dataset and target."""
    preds = fc.union_forecasts([pred for _, _, pred, _, _ in _gbt_all(spark, sf)])
    return r6(fc.metrics(named(preds), by=["dataset", "target"]).withColumn("model", F.lit("gbt")))


@register("model_comparison_gbt")
def q_model_comparison_gbt(spark, sf):
    """The full comparison: statistical models and boosted trees, all datasets and targets, sorted."""
    return fc.model_comparison([_cmp_spark(spark, sf), q_gbt_metrics(spark, sf)])


@register("tune_gbt")
def q_tune_gbt(spark, sf):
    """Successive halving over 15 settings for every dataset and target; a row a setting and rung."""
    long = all_long(spark, sf)
    frames = {(d, t): _gbt_frames(long.where((F.col("dataset") == d) & (F.col("target") == t)).select("unique_id", "ds", "y"))[0] for d, t in COMBOS}
    return spark.createDataFrame(fc.tune_gbt(frames), "dataset string, target string, config int, max_depth int, step_size double, rung int, rounds int, "
                                                      "best_round int, val_mae double, kept boolean")


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Feature importances of each dataset's and target's trees."""
    parts = [fc.feature_importance(model, feats, spark).withColumn("dataset", F.lit(d)).withColumn("target", F.lit(t))
             for d, t, _, model, feats in _gbt_all(spark, sf)]
    return fc.union_forecasts(parts)


@register("train_test_sizes",
          "WITH " + ", ".join([PANEL, LONG(), SPLIT]) + ", a AS (SELECT unique_id, CAST(count(*) AS BIGINT) AS train_rows "
          "FROM train GROUP BY 1), b AS (SELECT unique_id, CAST(count(*) AS BIGINT) AS test_rows FROM test GROUP BY 1) "
          "SELECT a.unique_id, train_rows, test_rows FROM a LEFT JOIN b USING (unique_id)")
def q_train_test_sizes(spark, sf):
    """Train / test row counts per series of the model split."""
    train, test = split(spark, sf)
    return train.groupBy("unique_id").count().withColumnRenamed("count", "train_rows") \
        .join(test.groupBy("unique_id").count().withColumnRenamed("count", "test_rows"), "unique_id", "left")
