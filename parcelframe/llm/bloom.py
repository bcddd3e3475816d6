"""A blocked Bloom filter in DataFrame operations.

A block is 512 bits in 8 words; a key sets one bit of each word of one block.
The filter is a table of at most ``MOST_BLOCKS`` rows (about 10 MB), so that its
broadcast is bounded however many keys it holds; more keys only mean more false
positives, which an exact join behind it removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, MOST_BLOCKS, BITS_PER_KEY = 8, 1 << 17, 16


def blocks_for(keys: int) -> int:
    return min(MOST_BLOCKS, max(1, -(-keys * BITS_PER_KEY // 512)))


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(__b_block, __b_w0 ... __b_w7): a row for each block that has bits set."""
    k = F.col(key)
    marked = keys.select(_block(k, blocks).alias("__b_block"), *[m.alias(f"__b_w{i}") for i, m in enumerate(_masks(k))])
    return marked.groupBy("__b_block").agg(*[F.bit_or(f"__b_w{i}").alias(f"__b_w{i}") for i in range(WORDS)])


def flag(rows: DataFrame, key: Column, bloom: DataFrame, blocks: int, name: str = "__b_maybe") -> DataFrame:
    """``rows`` with a boolean column: whether ``key`` may be in the filter."""
    probed = rows.withColumn("__b_key", key).withColumn("__b_at", _block(F.col("__b_key"), blocks))
    probed = probed.join(F.broadcast(bloom), F.col("__b_at") == F.col("__b_block"), "left")
    every = F.col("__b_block").isNotNull()
    for i, m in enumerate(_masks(F.col("__b_key"))):
        every = every & (F.col(f"__b_w{i}").bitwiseAND(m) == m)
    return probed.withColumn(name, F.coalesce(every, F.lit(False))).drop("__b_key", "__b_at", "__b_block", *[f"__b_w{i}" for i in range(WORDS)])


def may_hold(rows: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` may be in the filter."""
    return flag(rows, key, bloom, blocks).where("__b_maybe").drop("__b_maybe")


def id_key(doc_id: Column) -> Column:
    """A filter key for a document id (null is a key too)."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``docs`` less the listed rows. listed: (doc_id, text_key, once); of a row with
    ``once`` one copy stays, of the others none.

    Rows that the filter rules out pass straight through; only possible ones are
    shuffled for the exact join, so texts that stay are not."""
    n = listed.count()
    if not n:
        return docs
    own = [F.col(f"`{c}`") for c in docs.columns]
    blocks = blocks_for(n)
    bloom = build(listed.select(id_key(F.col("doc_id")).alias("k")), "k", blocks)
    flagged = flag(docs.withColumn("__b_text_key", text_key(F.col("text"))), id_key(F.col("doc_id")), bloom, blocks)
    right = listed.select(F.col("doc_id").alias("__b_id"), F.col("text_key").alias("__b_tk"), F.col("once").alias("__b_once"))
    hit = flagged.where("__b_maybe").join(right, F.col("doc_id").eqNullSafe(F.col("__b_id")) & (F.col("__b_text_key") == F.col("__b_tk")), "left")
    plain = hit.where("__b_once IS NULL").select(*own)
    once = hit.where("__b_once").dropDuplicates(["__b_id", "__b_tk"]).select(*own)
    return flagged.where("NOT __b_maybe").select(*own).unionByName(plain).unionByName(once)
