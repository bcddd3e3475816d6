"""Token counts by a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, tokens,
bytes). A run digests every text (null counts as empty), drops the digests
that the cache holds for this tokenizer version, encodes one text of each
remaining digest, appends those counts to the cache, and joins all rows with
the cache. Equal texts are encoded once however often they occur, and a later
run over old and new texts encodes the new ones only.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows
each get a row; an empty table gives none. Content is not normalised beyond
null, as any other change could change the counts.

Skew: copies of one text meet in a partial aggregate before any shuffle, so a
hot digest sends one row from each map task; the join back carries narrow rows
and is a sort-merge join that AQE splits when one digest holds a third of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

CACHE = "tokenizer string, digest binary, n_tokens long, n_bytes long"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version; no rows where no cache exists yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).select("digest", "n_tokens", "n_bytes")


def digest(text):
    """16 bytes that stand for a text's content (half of its sha-256)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def fill_cache(docs: DataFrame, path: str, name: str = "byte_bpe_50k.json") -> None:
    """Append the counts of all texts of ``docs`` that the cache at ``path`` lacks.

    Spark's file commit makes the append appear whole or not at all."""
    spark, version = docs.sparkSession, bpe.version(bpe.vocabulary(name))
    known = read_cache(spark, path, version).select("digest")
    texts = docs.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    # partial aggregation keeps one text of a digest per map task; the final one shares its partitioning with the join
    misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(bpe.vocabulary(name))
        for b in batches:
            texts = b.column("text")
            n = [len(x) for x in e.ids(texts.to_pylist())]
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.record_batch([pa.array([version] * b.num_rows, pa.string()), b.column("digest"),
                                   pa.array(n, pa.int64()), size], ["tokenizer", "digest", "n_tokens", "n_bytes"])

    misses.mapInArrow(count, CACHE).write.mode("append").parquet(path)


def count_tokens(docs: DataFrame, path: str, name: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, by the cache at ``path``, which is filled first."""
    spark, version = docs.sparkSession, bpe.version(bpe.vocabulary(name))
    fill_cache(docs, path, name)
    # runs that overlapped may have stored a digest twice; the counts are the same
    counts = read_cache(spark, path, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"),
                                                                  F.max("n_bytes").alias("n_bytes"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return (rows.join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
