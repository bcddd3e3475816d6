"""Drill tables: the entries behind report cells, clustered so that a lookup reads a few files.

Entries are ordered by (office, subkey, region) over range partitions, with a hash
of the entry as the last part of the order: a cell of many entries spreads over
several files instead of filling one, and equal entries still meet. A second
small table names each file's first and last cell (its zone); a lookup reads
the zones, then only the files that can hold its cell, however many other
offices there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["office", "subkey", "region"]
#: Entries of a file, about.
FILE_ROWS = 1_000_000


def _fields(drill: DataFrame) -> list[str]:
    return [c for c in drill.columns if c not in KEYS]


def write_drill(drill: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """The drill rows at ``path``/entries, a file for about each ``file_rows`` of them, and their zones at ``path``/zones."""
    files = max(1, -(-drill.count() // file_rows))
    spread = F.xxhash64(*_fields(drill))
    dealt = drill.repartitionByRange(files, *KEYS, spread).sortWithinPartitions(*KEYS, spread)
    dealt.write.mode("overwrite").parquet(f"{path.rstrip('/')}/entries")
    rows = drill.sparkSession.read.parquet(f"{path.rstrip('/')}/entries")
    cell = F.struct(*KEYS)
    zones = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(cell).alias("first"), F.max(cell).alias("last"), F.count(F.lit(1)).alias("n"))
    zones.write.mode("overwrite").parquet(f"{path.rstrip('/')}/zones")


def lookup(spark: SparkSession, path: str, office: str, subkey: str = "__all__", region: str | None = None) -> DataFrame:
    """The entries of one cell (of all regions unless one is given), from the files whose zone reaches it."""
    zones = spark.read.parquet(f"{path.rstrip('/')}/zones")
    first, last = F.struct("first.office", "first.subkey"), F.struct("last.office", "last.subkey")
    want = F.struct(F.lit(office).alias("office"), F.lit(subkey).alias("subkey"))
    files = [r.file for r in zones.where((first <= want) & (last >= want)).select("file").collect()]  # those of one cell
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path.rstrip('/')}/entries").limit(0)
    found = rows.filter((F.col("office") == F.lit(office)) & (F.col("subkey") == F.lit(subkey)))
    return found if region is None else found.filter(F.col("region").eqNullSafe(F.lit(region)))


def pages(spark: SparkSession, path: str, page_size: int = 1000) -> DataFrame:
    """(region, office, subkey, page, entries): each cell's different entries with how often they stand there
    (``times``), in pages of at most ``page_size``.

    A page lies within one file, so entries are numbered file by file and never meet
    their cell's size; a page's number counts on over the files before."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/entries").withColumn("_file", F.col("_metadata.file_path"))
    fields = [c for c in rows.columns if c not in (*KEYS, "_file")]
    entries = rows.groupBy("_file", *KEYS, *fields).agg(F.count(F.lit(1)).alias("times"))
    order = W.partitionBy("_file", *KEYS).orderBy(F.xxhash64(*fields), *fields)  # a file's share of a cell
    numbered = entries.withColumn("_page", F.floor((F.row_number().over(order) - 1) / page_size).cast("int"))
    held = numbered.groupBy("_file", *KEYS, "_page").agg(F.sort_array(F.collect_list(F.struct(*fields, "times"))).alias("entries"))
    paged = W.partitionBy(*KEYS).orderBy("_file", "_page")
    number = held.select("_file", *KEYS, "_page", (F.row_number().over(paged) - 1).alias("page"))  # a narrow row a page
    mine = [F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("_file", *KEYS, "_page")]
    both = held.alias("h").join(number.alias("n"), mine)
    return both.select("h.region", "h.office", "h.subkey", "n.page", "h.entries")
