"""Exact top-k inner-product search of a stated query set against all rows.

Every component x becomes floor(256 x).  Rows with a null id, a null vector, or
a null or non-finite component take no part; repeated rows with one id count
once.  Only vectors of equal length meet.  Components beyond 64 bits are held at
the nearest 64-bit integer, and so are scores (at -(2**63 - 1) below).

Equal vectors collapse to one row with the k + 1 smallest ids, which is all a
query can ever return of them, so a very common vector costs one comparison.
Distinct query vectors go to the tasks in blocks of at most ``QUERY_BLOCK``
with their cover tree; each task builds cover trees over its data rows and
carries each query's best scores from tree to tree.  Per task and query at most
k + 1 rows leave, ranked with ties to the smaller id.

A query's own id is no candidate.  Only the id and vector columns are read.  An
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mensura.llm.common import shared_folder, written
from mensura.llm.cover_tree import QUERY_LEAF, CoverTree, Search

QUERY_BLOCK = 4096
TREE_ROWS = 8192
SALTS = 64


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (array of whole numbers) of the rows that take part, one per id and vector."""
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("id"), F.transform(parts, lambda x: F.floor(256 * x).cast("bigint")).alias("v"))
    )


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``v``, ``ids``: the ``k + 1`` smallest ids of each vector, ascending."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("r", F.dense_rank().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    few = few.select("v", "id").distinct()
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _search(data: DataFrame, names: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """Best ``k`` data vectors of each query per task: query name, smallest id, score."""
    queries, width = CoverTree(vectors, QUERY_LEAF), vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> None:
            if held:
                search.add(CoverTree(np.concatenate([v for _, v in held])), np.concatenate([i for i, _ in held]))
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                held.append((part.column("id").to_numpy(), _matrix(part.column("v")).reshape(part.num_rows, width)))
                rows += part.num_rows
                if rows >= TREE_ROWS:
                    flush()
                    rows = 0
        flush()
        q, j = np.nonzero(search.scores > Search.LOWEST)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[queries.order[q]]), pa.array(search.ids[q, j]), pa.array(search.scores[q, j])], names=["query", "id", "score"]
        )

    return data.mapInArrow(run, "query bigint, id bigint, score bigint")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score`` of the ``k`` best rows of each query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col)
    data = written(distinct_vectors(rows, k).withColumn("id", F.element_at("ids", 1)).withColumn("n", F.size("v")), "vectors")
    asked = rows.filter(F.col("id") % every == 0).distinct()
    asked = written(asked.join(data.select("v", F.col("id").alias("query")), "v").select("query", F.col("id").alias("query_id")), "asked")
    # the query vectors, named by the smallest id of the vector
    names = asked.select("query").distinct()
    wanted = written(data.join(names, data["id"] == names["query"], "left_semi").select("id", "v", "n", F.xxhash64("id").alias("h")), "queries")
    path = shared_folder(spark, "found")
    schema = "query bigint, id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for size in wanted.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy("n").collect():
        parts = -(-size["rows"] // block) if size["rows"] > block else 1
        parts = parts if parts == 1 else 2 * parts  # hash parts vary: twice as many stay below the block size
        for p in range(parts):
            mine = wanted.filter((F.col("n") == size["n"]) & (F.pmod("h", F.lit(parts)) == p)).orderBy("id").select("id", "v").collect()
            if mine:
                matrix = np.array([r["v"] for r in mine], dtype=np.int64).reshape(len(mine), size["n"])
                found = _search(data.filter(F.col("n") == size["n"]).select("id", "v"), np.array([r["id"] for r in mine]), matrix, k + 1)
                found.write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    vectors_of = found.withColumn("r", best).filter(F.col("r") <= k + 1).select("query", "id", "score")
    members = vectors_of.join(data.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    members = members.withColumn("r", place).filter(F.col("r") <= k + 1).drop("r")
    pairs = asked.join(members, "query").filter(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
