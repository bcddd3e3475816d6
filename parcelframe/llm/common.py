"""Shared helpers: scratch tables, held-out folds, bounded labelled samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path for a table, under the folder that driver and executors share."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/llm-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to a new shared path and read it back: the
    lineage ends there, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables (once all results are written)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int,
                    per_class: int, row_bytes: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled documents of each
    class, the first by a hash of doc_id, none of the held-out fold; whole
    texts, without those of more than ``row_bytes`` bytes.

    The label rows are picked first (ids only); that bounded list is broadcast
    to the scan of the texts, which are never shuffled for it. A doc_id that
    occurs twice in ``labels`` counts once; one that has both labels is left out.
    """
    known = (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()
                          & (fold(F.col("doc_id"), modulus) != held))
             .groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y1"))
             .where("y = y1").select("doc_id", "y", F.xxhash64("doc_id").alias("h")))
    picks = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1]).select("doc_id", "y")
    # at most 2 * per_class rows: a proven bound for the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= row_bytes)


def within(rows: DataFrame, class_bytes: int) -> DataFrame:
    """Of encoded training rows (doc_id, y, size, ...), those that come first by a hash of doc_id while the sizes
    of their class add up to at most ``class_bytes``. The rows are written once; sizes alone are sorted."""
    rows = stored(rows, "training")
    order = W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.select("doc_id", F.sum("size").over(order).alias("run"))  # at most per_class rows a class
    return rows.join(F.broadcast(run.where(F.col("run") <= class_bytes).select("doc_id")), "doc_id")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (Spark's ``--py-files``, once an application).

    A session started from elsewhere than the repository needs it; the archive
    goes through Spark's own file distribution."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_parcelframe_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="parcelframe-py-"), "parcelframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("parcelframe", os.path.relpath(path, top)))
    sc.addPyFile(archive)
    sc._parcelframe_shipped = True
