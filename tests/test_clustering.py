"""Clustering invariants on separable blobs."""

from pyspark.sql import functions as F

from parcelframe.plans import clustering as CL


def _blobs(spark):
    rows = []
    for c, (x, y) in enumerate([(0, 0), (10, 10), (20, 0)]):
        for i in range(12):
            rows.append((f"p{c}_{i}", float(x + (i % 3) * 0.1), float(y + (i % 4) * 0.1), float(c)))
    return spark.createDataFrame(rows, "name string, a double, b double, truth double")


def test_kmeans_relabel_and_indices(spark):
    rows, metrics = CL._run(_blobs(spark), ["a", "b"], 3, "a", True, "day", restarts=3)
    got = rows.groupBy("cluster").agg(F.min("name").alias("n"), F.count(F.lit(1)).alias("c")).collect()
    assert sorted(r["cluster"] for r in got) == [0, 1, 2] and all(r["c"] == 12 for r in got)
    # relabelled by ascending mean of 'a': cluster 0 is the blob at x = 0
    first = rows.filter(F.col("cluster") == 0).select("name").first()["name"]
    assert first.startswith("p0_")
    m = metrics.first()
    assert m["silhouette"] > 0.9 and m["davies_bouldin"] < 0.1 and m["calinski_harabasz"] > 100


def test_grades(spark):
    m = spark.createDataFrame([(0.6, 1.0, 10.0)], "silhouette double, davies_bouldin double, calinski_harabasz double")
    g = CL.grade_metrics(m).first()
    assert (g["silhouette_grade"], g["davies_bouldin_grade"], g["calinski_harabasz_grade"]) == ("good", "warn", "bad")


def test_too_few_rows(spark):
    rows, metrics = CL._run(_blobs(spark).limit(2), ["a", "b"], 3, "a", True, "day")
    assert rows.count() == 0 and metrics.first()["n_clusters"] == 0
