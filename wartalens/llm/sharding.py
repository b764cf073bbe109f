"""Contiguous shards of equal bytes, from global prefix sums. DataFrame functions only.

Documents are put in key order by a range exchange of narrow rows. Each range sums its own bytes and
rows, the ranges' totals (one row each) are summed up in order, and a document's place in the
corpus is its range's base plus its place within the range. Shard ``s`` takes the documents whose
middle byte lies in the ``s``-th equal share of all bytes, so shards are contiguous and differ from
the target by at most one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wartalens.llm.common import quoted
from wartalens.session import stage


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, size, text_crc32)``: UTF-8 bytes plus one; a null text has size 1 and checksum 0."""
    content = F.coalesce(quoted(text).cast("string"), F.lit(""))
    return docs.select(
        quoted(key).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )


def shard_by_bytes(sizes: DataFrame, shards: int = 8) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within the shard) to ``(doc_id, size, ...)`` rows.

    Order: key (nulls first), then the other columns, then the row; repeated rows may hold any
    share of the table, as ranges are cut on all of these. A document larger than a shard's
    share fills it alone and shards may stay empty. An empty table gives no rows.
    """
    columns = sizes.columns
    order = [*columns, "_row"]
    ranged = (
        sizes.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .withColumn("_range", F.spark_partition_id())
    )
    rows = stage(ranged, "shard-rows")
    totals = rows.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    # one row per range of the exchange
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_byte_base"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    ), "shard-bases")
    within = Window.partitionBy("_range").orderBy(*order)
    placed = (
        rows.withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(bases, "_range")
        .withColumn("_twice_middle", 2 * (F.col("_byte_base") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.least(
            F.expr(f"_twice_middle * {int(shards)} div (2 * _all)"), F.lit(shards - 1)).cast("int"))
    )
    # rows of each shard in each range, then the rows of the shard in the ranges before
    counts = placed.groupBy("_range", "shard").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select(
        "_range", "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_slot_base")), "shard-slots")
    nth = F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*order))
    return (
        placed.withColumn("_nth", nth).join(starts, ["_range", "shard"])
        .select(*columns, "shard", (F.col("_slot_base") + F.col("_nth") - 1).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text", key: str = "doc_id") -> None:
    """Write whole documents into one folder per shard, in slot order; keys must be distinct and not null."""
    places = shard_by_bytes(sized(docs, text, key), shards).select(F.col("doc_id").alias("_key"), "shard", "slot")
    (
        docs.join(places, quoted(key) == F.col("_key")).drop("_key")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.mode("errorifexists").partitionBy("shard").parquet(path)
    )


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with its shard under the law ``bytes``."""
    return shard_by_bytes(sized(docs, text, key), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
