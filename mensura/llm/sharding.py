"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

The law is ``bytes``: shard sizes (UTF-8 bytes plus one per row) come out near
equal, with tokens (words between white space) and rows balanced along.

Rows with equal texts form a group and stay together.  A group above
``1 / (shards * FINE)`` of the bytes, tokens or rows is an item of its own, and
there are at most ``3 * shards * FINE`` such groups.  All smaller groups fall
into ``SMALL`` hash buckets, each an item.  So the packing works on a list whose
length depends on the number of shards alone, whatever the table holds.  Items
go, largest first, where the dot product of their vector with the shard's
residual capacity is highest; the small items at the end even the bytes out.
A group larger than a whole shard cannot stay together under this law: it is
cut into pieces that are items themselves.

Slots count rows inside bounded blocks of a written table, with a short table
of block offsets; no task sees a shard whole.

Null texts have size 1, no tokens, crc32 0 and form one group apart from the
empty text's.  Null ids and repeated rows are rows like others.  Only the id
and text columns are read.  An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mensura.llm.common import written

SHARDS = 16
FINE = 64
SMALL = 4096
BLOCK_ROWS = 10_000
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), placed by residual dot products."""
    totals = items.sum(axis=0)
    share = items / np.where(totals > 0, totals, 1) * shards  # one shard's capacity is 1 in each dimension
    order = np.lexsort((np.arange(len(items)), -share.max(axis=1)))
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    # the largest residual may hide in tokens or rows: items of the last bytes go by bytes alone
    left = np.cumsum(share[order[::-1], 0])[::-1] if len(items) else np.zeros(0)
    for k, i in enumerate(order):
        gap = residual[:, 0].max() - residual[:, 0].min()
        direction = share[i] if left[k] > shards * gap + 0.02 * shards else np.array([1.0] + [0.0] * (items.shape[1] - 1))
        out[i] = int(np.argmax(residual @ direction))
        residual[out[i]] -= share[i]
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("bigint").alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("group"),
    )


def _placement(sized: DataFrame, shards: int) -> DataFrame:
    """``sized`` with its shard."""
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = written(sized.groupBy("group").agg(*sums), "groups")
    totals = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    unit = {d: totals[d] / (shards * FINE) for d in DIMENSIONS}
    is_large = F.lit(False)
    for d in DIMENSIONS:
        is_large = is_large | (F.col(d) > unit[d])
    bucket = F.pmod(F.xxhash64("group"), F.lit(SMALL)).cast("int")
    # at most 3 * shards * FINE rows, since each holds more than that share of a total
    large = groups.filter(is_large).orderBy("group").collect()
    small = groups.filter(~is_large).groupBy(bucket.alias("bucket")).agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
    small = small.orderBy("bucket").collect()  # at most SMALL rows
    capacity = totals["bytes"] / shards
    vectors, names = [], []
    for g in large:
        pieces = max(1, int(np.ceil(g["bytes"] / unit["bytes"]))) if g["bytes"] > capacity and g["rows"] > 1 else 1
        vectors += [[g[d] / pieces for d in DIMENSIONS]] * pieces
        names += [(g["group"], pieces, p) for p in range(pieces)]
    vectors += [[s[d] for d in DIMENSIONS] for s in small]
    placed = pack(np.array(vectors, dtype=float).reshape(-1, 3), shards).tolist()
    spark = sized.sparkSession
    of_group: dict[str, list[int]] = {}
    for (group, _, _), shard in zip(names, placed):
        of_group.setdefault(group, []).append(shard)
    of_bucket = {s["bucket"]: shard for s, shard in zip(small, placed[len(names) :])}
    large_table = spark.createDataFrame(list(of_group.items()), "group string, pieces array<int>")
    by_bucket = F.lit([of_bucket.get(b, 0) for b in range(SMALL)]).cast(T.ArrayType(T.IntegerType()))
    # rows of one text differ in nothing a hash could use but their place in the written table
    piece = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.size("pieces")).cast("int")
    chosen = F.when(F.col("pieces").isNotNull(), F.element_at("pieces", piece + 1)).otherwise(F.element_at(by_bucket, bucket + 1))
    return sized.join(F.broadcast(large_table), "group", "left").select("id", "size", "crc", chosen.alias("shard"))


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless ``slot`` per shard; ``placed`` is a table as written."""
    rows = placed.select(
        "*", F.struct(F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).alias("part")).alias("block"),
        F.col("_metadata.row_index").alias("at"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("at"))
    numbered = rows.withColumn("inside", inside)
    return numbered.join(offsets, ["shard", "block"]).withColumn("slot", F.col("offset") + F.col("inside") - 1)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null under this law)."""
    sized = written(_sized(docs, id_col, text_col), "sized")
    placed = written(_placement(sized, shards), "placed")
    return _slots(placed).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
