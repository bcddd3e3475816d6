"""Sinks: CSV exports and per-region report artefacts.

All writers are task-parallel (one file per partition); nothing is
gathered on the driver. Paths must be on shared storage on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import safe_name
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_region_reports(parts: dict[str, DataFrame], path: str, fmt: str = "json",
                         region_col: str = "region") -> dict[str, str]:
    """Write every report part for all regions at once, one folder per part,
    partitioned by a file-system safe region name (NULL → ``national``)."""
    out = {}
    for name, df in parts.items():
        p = f"{path.rstrip('/')}/{name}"
        (df.withColumn("region_file", safe_name(F.col(region_col)))
         .write.mode("overwrite").partitionBy("region_file").format(fmt).save(p))
        out[name] = p
    return out
