"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents with equal texts form a group. Groups are bundled by a hash of the text into at most ``BUNDLES`` items. A
group with more than 1/``FINE`` of all bytes, tokens or rows (there are at most 3 * ``FINE`` of them) is an item of its
own; one with more than 1/``WHOLE`` of a shard's capacity is dealt out over pieces of about that size, so that a text
with a third of all copies does not overfill a shard. All other groups stay together.
Items are vectors of bytes, tokens and rows. They are placed in order of falling size, each into the shard where the
dot product with the residual capacity is highest. The packing sees a bounded number of items at every input size;
everything else is partial aggregation and joins with that bounded table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.shared import stored, table

SHARDS = 16
BUNDLES = 4096
FINE = 1024
WHOLE = 8
LAW = "bytes"


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of nonnegative sizes): dot-product packing with falling item size."""
    total = np.maximum(items.sum(axis=0), 1e-12)
    sizes = items / total
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    at = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-sizes.max(axis=1), kind="stable"):
        at[i] = int(np.argmax(residual @ sizes[i]))
        residual[at[i]] -= sizes[i]
    return at


def pack(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 1; ``tokens`` counts blanks plus 1. The law is ``bytes``: shard sizes
    are near equal (rows and tokens, too); ``grown_shard`` is always NULL. ``slot`` numbers the rows of a shard from 0
    without gaps. Groups stay in one shard unless
    they exceed 1/``WHOLE`` of its capacity. NULL texts count as empty, size 1.
    Repeated rows are rows of their own. Other columns are ignored. An empty table gives no rows.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        documents.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
            F.xxhash64(text).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    totals = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = rows.groupBy("text_key").agg(*totals)
    all_rows = groups.agg(*[F.sum(c).alias(c) for c in ("size", "tokens", "rows")]).first()
    if not all_rows["rows"]:
        return rows.select(
            "doc_id", "size", "text_crc32", "tokens", F.lit(LAW).alias("law"), F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    share = F.greatest(*[F.col(c) / F.lit(float(all_rows[c])) for c in ("size", "tokens", "rows")])
    heavy = groups.where(share > 1.0 / FINE).select(
        "text_key", F.least(F.ceil(share * (WHOLE * shards)).cast("long"), "rows").alias("pieces")
    )
    listed = sorted(heavy.collect())  # at most 3 * FINE rows
    first, known = BUNDLES, []
    for text_key, pieces in listed:
        known.append((text_key, first, pieces))
        first += pieces
    known = spark.createDataFrame(known, "text_key long, first long, pieces long")
    bundle = F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES))
    piece = F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))
    itemised = rows.join(F.broadcast(known), "text_key", "left").withColumn("item", F.coalesce(piece, bundle))
    items = itemised.groupBy("item").agg(*totals).orderBy("item").toPandas()  # at most BUNDLES + 3 * FINE + 6 * WHOLE * shards rows
    items["shard"] = place(items[["size", "tokens", "rows"]].to_numpy(dtype=float), shards)
    items["offset"] = items.groupby("shard")["rows"].cumsum() - items["rows"]
    placed = spark.createDataFrame(
        [tuple(map(int, x)) for x in items[["item", "shard", "offset"]].to_numpy()], "item long, shard int, offset long"
    )
    within = Window.partitionBy("item").orderBy("doc_id", "row")
    return (
        itemised.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(placed), "item")
        .select(
            "doc_id", "size", "text_crc32", "tokens", F.lit(LAW).alias("law"), "shard",
            (F.col("offset") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
