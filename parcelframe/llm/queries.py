"""One registered query per operator: each applies it to its whole table.

``QUERIES`` maps opN_<name> to a callable of (spark, sf_dir); ``ORACLES`` has
DuckDB SQL where SQL can state the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (conversation_repair, decontamination, html_extract, line_rules, near_dedup, packing, pivot_kmeans, pivot_search, quality,
               reshard, token_counts, toxicity, url_filter)
from .common import scratch_path, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the convolutional classifier."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by a digest cache. Each run starts a cache of
    its own, so that its work doesn't depend on runs before it."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))


@query
def op5_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens that hold the corpus's mixture of sources."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op7_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from the files they lie in, rewritten into 16 shards of equal bytes."""
    return reshard.reshard_files(spark, f"{sf_dir}/documents.parquet", 16)


@query
def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


ORACLES["op3_url_filter"] = url_filter.ORACLE
ORACLES["op6_near_dedup"] = near_dedup.ORACLE
ORACLES["op9_pivot_topk"] = pivot_search.ORACLE


@query
def op4_positional_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near_items", "text_key")


ORACLES["op4_positional_decontam"] = decontamination.ORACLE


@query
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency of every document."""
    return line_rules.line_verdicts(table(spark, sf_dir, "documents"))


@query
def op12_laesa_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds, exactly."""
    return pivot_kmeans.kmeans(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest edits of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(rows), rows)


ORACLES["op11_line_rules"] = line_rules.ORACLE
ORACLES["op12_laesa_kmeans"] = pivot_kmeans.ORACLE
ORACLES["op13_conversation_repair"] = conversation_repair.ORACLE
