"""Session helpers.

``build_session`` is for tests, the bench and local runs. On a cluster the
session comes from the platform; the library only reads its settings
(``spark.checkpoint.dir`` in particular) and never assumes a local disk.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session we build uses. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splits hot partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoint files go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide cleaning projections generate methods the JVM will not JIT
    # (> 8000 bytecodes); above that size, use the interpreted path instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "parcelframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("PARCELFRAME_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Where it is unset, a local session gets a scratch folder of its own;
    on any other master executors couldn't read that folder, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="parcelframe-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut the lineage of a small derived frame (daily series, feature tables)
    with a reliable checkpoint in the session's checkpoint directory, so its
    several consumers read the written copy instead of re-deriving it from
    the fact table. Never a local checkpoint: the copy survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (Spark's ``--py-files``, once an application), for
    sessions started from elsewhere than the repository. Spark distributes the archive."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_parcelframe_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="parcelframe-py-"), "parcelframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("parcelframe", os.path.relpath(path, top)))
    sc.addPyFile(archive)
    sc._parcelframe_shipped = True
