"""Clustering analyses: feature tables → impute → standardise → k-means
(best of several seeds) → relabel by a driver column → quality indices.

Feature tables are group-bys (offices, regions, days) and stay small; the
parcel analysis clusters **every** complete row (no sampling cap). Scalars
(medians, means, standard deviations, centroids: at most k × #features
numbers) are fetched to the driver; per-row work (assignment, distances)
stays in Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..session import materialize
from .restarts import kmeans_restarts, nearest
from .silhouette import silhouette
from .ward import ward

# Cluster names per analysis (cluster id after relabelling → name).
NAMES = {
    "bureau": {0: "Performant", 1: "Standard", 2: "À améliorer", 3: "Critique"},
    "parcel": {0: "Rapide & léger", 1: "Standard", 2: "Lent / problématique", 3: "Hors norme"},
    "region": {0: "Forte demande", 1: "Demande moyenne", 2: "Faible demande"},
    "day": {0: "Jour de pointe", 1: "Jour normal", 2: "Jour creux"},
    "vehicle": {0: "Camion", 1: "Fourgon", 2: "Voiture légère"},
}

# Grading thresholds (good, warn) per index and direction.
GRADES = {"silhouette": (0.5, 0.25, "higher"), "davies_bouldin": (0.8, 1.5, "lower"),
          "calinski_harabasz": (50.0, 20.0, "higher")}

N_RESTARTS = 10
SEED = 42


def _pct(c) -> F.Column:
    return F.avg(F.col(c).cast("double")) * 100


# ── feature tables ───────────────────────────────────────────────────────────

def features_bureau(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Per depot office: rows, delivery %, mean interval, revenue, CRBT %; offices with ≥ 5 rows."""
    g = df.withColumn("name", F.col("depot_office")).filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.count(F.lit(1)).cast("double").alias("total_colis"), _pct("is_delivered").alias("taux_livraison"),
        F.avg(F.col("interval_days").cast("double")).alias("avg_intervalle"),
        F.sum(F.col("revenue_ca").cast("double")).alias("total_ca"), _pct("is_crbt").alias("taux_crbt"))
    return g.filter(F.col("total_colis") >= min_rows)


def features_region(df: DataFrame) -> DataFrame:
    return (df.withColumn("name", F.col("depot_region"))
            .filter(F.coalesce(F.col("name"), F.lit("")) != "").groupBy("name").agg(
                F.count(F.lit(1)).cast("double").alias("total_colis"), _pct("is_delivered").alias("taux_livraison"),
                F.avg(F.col("revenue_ca").cast("double")).alias("avg_ca"), _pct("is_crbt").alias("taux_crbt"),
                F.avg(F.col("interval_days").cast("double")).alias("avg_intervalle")))


def features_day(df: DataFrame) -> DataFrame:
    """Per deposit day: volume, weekday (Mon = 0), delivery %, revenue."""
    d = F.to_date("deposit_date")
    return (df.filter(d.isNotNull()).groupBy(d.alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("daily_volume"), _pct("is_delivered").alias("daily_taux_liv"),
        F.sum(F.col("revenue_ca").cast("double")).alias("daily_ca"))
        .withColumn("day_of_week", F.weekday("day").cast("double"))
        .select(F.date_format("day", "yyyy-MM-dd").alias("name"), "daily_volume", "daily_taux_liv", "daily_ca",
                "day_of_week"))


def features_vehicle(df: DataFrame) -> DataFrame:
    g = (df.withColumn("name", F.col("depot_region")).filter(F.coalesce(F.col("name"), F.lit("")) != "")
         .groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("total_colis"),
                              F.sum(F.col("weight_kg").cast("double")).alias("total_poids"),
                              F.avg(F.col("weight_kg").cast("double")).alias("avg_poids"),
                              F.countDistinct("depot_office").cast("double").alias("nb_bureaux"),
                              _pct("is_crbt").alias("taux_crbt")))
    g = g.withColumn("densite_colis", F.col("total_colis") / F.nullif(F.col("nb_bureaux"), F.lit(0.0)))
    return g.select("name", "total_colis", "total_poids", "avg_poids", "nb_bureaux", "densite_colis", "taux_crbt")


def features_parcel(df: DataFrame) -> DataFrame:
    """Every complete parcel row: interval, revenue, weight, CRBT and delivered flags."""
    return df.select(F.col("mailitm_fid").alias("name"),
                     F.col("interval_days").cast("double").alias("_itv"),
                     F.col("revenue_ca").cast("double").alias("_ca"),
                     F.col("weight_kg").cast("double").alias("_poids"),
                     F.col("is_crbt").cast("double").alias("_crbt"),
                     F.col("is_delivered").cast("double").alias("_del")).dropna()


# ── preprocessing ────────────────────────────────────────────────────────────

def impute_median(df: DataFrame, feats) -> DataFrame:
    """Missing feature → that column's (exact, interpolated) median. Columns without a missing value need none."""
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feats]).first()
    med = {c: exact_quantiles(df, F.col(c), {"m": 0.5}).first()["m"] if gaps[c] else None for c in feats}
    return df.select(*[c for c in df.columns if c not in feats],
                     *[F.coalesce(F.col(c), F.lit(med[c])).alias(c) if med[c] is not None else F.col(c)
                       for c in feats])


def standardise(df: DataFrame, feats, center: bool = True, out: str = "features") -> DataFrame:
    """z-score with the population std (std 0 → divide by 1), assembled into a vector."""
    from pyspark.ml.feature import VectorAssembler
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in feats], *[F.stddev_pop(c).alias(f"s_{c}") for c in feats]).first()
    cols = []
    for c in feats:
        m = st[f"m_{c}"] if center else 0.0
        s = st[f"s_{c}"] or 0.0
        s = s if s > 0 else 1.0
        cols.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"z_{c}"))
    scaled = df.select("*", *cols)
    return VectorAssembler(inputCols=[f"z_{c}" for c in feats], outputCol=out).transform(scaled)


# ── clustering ───────────────────────────────────────────────────────────────

def kmeans_best(df: DataFrame, k: int, restarts: int = N_RESTARTS, seed: int = SEED) -> DataFrame:
    """Rows with their cluster (``raw``) by the best of ``restarts`` k-means fits (seeds
    ``seed … seed+restarts-1``) by cost, ties to the lower seed. All restarts share each scan of the rows."""
    from pyspark.ml.functions import vector_to_array

    fit = kmeans_restarts(df, k, restarts, seed)
    return df.withColumn("raw", nearest(fit.best, vector_to_array("features")))


def relabel_by_mean(assigned: DataFrame, driver: str, ascending: bool) -> DataFrame:
    """Cluster ids ordered by the mean of ``driver`` (k rows ranked, joined back)."""
    means = assigned.groupBy("raw").agg(F.avg(driver).alias("_m"))
    order = F.asc("_m") if ascending else F.desc("_m")
    ranks = means.select("raw", (F.row_number().over(W.orderBy(order, "raw")) - 1).alias("cluster"))
    return assigned.join(F.broadcast(ranks), "raw").drop("raw")


def quality_indices(assigned: DataFrame, dim: int, many: bool = False) -> DataFrame:
    """Silhouette, Davies–Bouldin and Calinski–Harabasz (Euclidean formulas); NULL below two clusters.

    The silhouette is the exact mean over all pairs of rows (``silhouette``). ``many`` says that
    there is a row for each parcel: then Spark's evaluator gives its squared form, whose work is linear.
    One aggregate gives each cluster's size, sums and sums of squares; a second
    the mean distance to its centre. Only those k rows reach the driver."""
    spark = assigned.sparkSession
    schema = "silhouette double, davies_bouldin double, calinski_harabasz double, n_clusters int"
    from pyspark.ml.functions import vector_to_array
    arr = assigned.select("cluster", vector_to_array("features").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    cents = {r["cluster"]: (r["n"], [r[f"c{i}"] for i in range(dim)], r["q"]) for r in arr.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"), *[F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(dim)]).collect()}
    if len(cents) < 2:
        return spark.createDataFrame([(None, None, None, len(cents))], schema)
    if many:
        from pyspark.ml.evaluation import ClusteringEvaluator
        sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(assigned)
    else:
        sil = silhouette(assigned)
    cdf = spark.createDataFrame([(c, v[1]) for c, v in cents.items()], "cluster int, c array<double>")
    dist = arr.join(F.broadcast(cdf), "cluster").select(  # k rows
        "cluster", F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                      lambda acc, x: acc + x)).alias("d"))
    spread = {r["cluster"]: r["s"] for r in dist.groupBy("cluster").agg(F.avg("d").alias("s")).collect()}
    ids = sorted(cents)
    n_total = sum(cents[c][0] for c in ids)
    overall = [sum(cents[c][0] * cents[c][1][i] for c in ids) / n_total for i in range(dim)]

    def d2(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    db = sum(max((spread[i] + spread[j]) / math.sqrt(d2(cents[i][1], cents[j][1]))
                 for j in ids if j != i) for i in ids) / len(ids)
    between = sum(cents[c][0] * d2(cents[c][1], overall) for c in ids)
    within = sum(cents[c][2] - cents[c][0] * sum(x * x for x in cents[c][1]) for c in ids)
    ch = (between / (len(ids) - 1)) / (within / (n_total - len(ids))) if within > 0 and n_total > len(ids) else None
    return spark.createDataFrame([(float(sil) if sil is not None else None, float(db), float(ch) if ch is not None else None, len(ids))], schema)


def grade_metrics(metrics: DataFrame) -> DataFrame:
    """good / warn / bad per index."""
    cols = []
    for m, (good, warn, direction) in GRADES.items():
        x = F.col(m)
        if direction == "higher":
            g = F.when(x > good, "good").when(x > warn, "warn").when(x.isNotNull(), "bad")
        else:
            g = F.when(x < good, "good").when(x < warn, "warn").when(x.isNotNull(), "bad")
        cols.append(g.alias(f"{m}_grade"))
    return metrics.select("*", *cols)


def _run(feat: DataFrame, feats, k: int, driver: str, ascending: bool, analysis: str,
         algo: str = "kmeans", center: bool = True, restarts: int = N_RESTARTS, many: bool = False):
    """Shared pipeline; returns (rows with cluster/label, metrics row).

    The feature table is written once; ``many`` says that it has a row for
    each parcel: those are complete (no median). Vectors are persisted once."""
    spark = feat.sparkSession
    feat = materialize(feat)
    n = feat.count()
    if n < k:
        empty = spark.createDataFrame([], f"name string, cluster int, cluster_label string, "
                                          + ", ".join(f"{c} double" for c in feats))
        msg = spark.createDataFrame([(None, None, None, 0)],
                                    "silhouette double, davies_bouldin double, calinski_harabasz double, n_clusters int")
        return empty, msg.withColumn("message", F.lit(f"too few rows for {analysis} ({n})"))
    scaled = standardise(feat if many else impute_median(feat, feats), feats, center=center).persist()
    found = ward(scaled, k) if algo == "ward" else kmeans_best(scaled, k, restarts)
    assigned = relabel_by_mean(found, driver, ascending)
    names = NAMES[analysis]
    label = F.element_at(F.create_map(*[x for i, nm in names.items() for x in (F.lit(i), F.lit(nm))]),
                         F.col("cluster"))
    metrics = quality_indices(assigned, len(feats), many).withColumn("message", F.lit(None).cast("string"))
    rows = assigned.select("name", F.col("cluster").cast("int").alias("cluster"),
                           F.coalesce(label, F.concat(F.lit("C"), F.col("cluster").cast("string"))).alias("cluster_label"),
                           *[F.bround(F.col(c), 2).alias(c) for c in feats])
    # What is read later comes from the written feature table; the vectors aren't needed any more.
    scaled.unpersist()
    return rows, metrics


def cluster_bureau(df: DataFrame, k: int = 3, restarts: int = N_RESTARTS):
    feats = ["taux_livraison", "avg_intervalle", "total_colis", "total_ca", "taux_crbt"]
    return _run(features_bureau(df), feats, k, "taux_livraison", False, "bureau", restarts=restarts)


def cluster_parcel(df: DataFrame, k: int = 4, restarts: int = N_RESTARTS):
    """Parcel profiles over **all** complete rows; profile per cluster returned as rows."""
    feats = ["_itv", "_ca", "_poids", "_crbt", "_del"]
    return _run(features_parcel(df), feats, k, "_itv", True, "parcel", restarts=restarts, many=True)


def cluster_region(df: DataFrame, k: int = 3):
    """Ward's clustering of std-scaled (not centred) region features; order by volume."""
    feats = ["total_colis", "taux_livraison", "avg_ca", "taux_crbt", "avg_intervalle"]
    return _run(features_region(df), feats, k, "total_colis", False, "region", algo="ward", center=False)


def cluster_day(df: DataFrame, k: int = 3, restarts: int = N_RESTARTS):
    feats = ["daily_volume", "daily_taux_liv", "daily_ca", "day_of_week"]
    return _run(features_day(df), feats, k, "daily_volume", False, "day", restarts=restarts)


def cluster_vehicle(df: DataFrame, k: int = 3, restarts: int = N_RESTARTS):
    feats = ["total_colis", "total_poids", "avg_poids", "nb_bureaux", "densite_colis", "taux_crbt"]
    return _run(features_vehicle(df), feats, k, "total_poids", False, "vehicle", restarts=restarts)


def cluster_profile(rows: DataFrame, feats) -> DataFrame:
    """Per cluster: n and the mean of each feature (2 dp)."""
    return rows.groupBy("cluster", "cluster_label").agg(
        F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(c), 2).alias(c) for c in feats])


def cluster_summary_bureau(rows: DataFrame, k: int = 3) -> DataFrame:
    """Per cluster: offices, mean delivery % and mean interval (1 dp, missing as 0);
    clusters without offices listed with 0."""
    spark = rows.sparkSession
    ids = spark.createDataFrame([(i,) for i in range(k)], "cluster int")
    s = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("offices"),
                                    F.bround(F.avg(F.coalesce("taux_livraison", F.lit(0.0))), 1).alias("avg_taux"),
                                    F.bround(F.avg(F.coalesce("avg_intervalle", F.lit(0.0))), 1).alias("avg_itv"))
    return ids.join(s, "cluster", "left").select(
        "cluster", F.coalesce("offices", F.lit(0)).alias("offices"),
        F.coalesce("avg_taux", F.lit(0.0)).alias("avg_taux"), F.coalesce("avg_itv", F.lit(0.0)).alias("avg_itv"))


def cluster_summary_day(rows: DataFrame) -> DataFrame:
    """Per day type: number of days and mean daily volume over non-zero days."""
    return rows.groupBy("cluster", "cluster_label").agg(
        F.count(F.lit(1)).alias("days"),
        F.bround(F.avg(F.nullif(F.col("daily_volume"), F.lit(0.0))), 1).alias("avg_volume"))
