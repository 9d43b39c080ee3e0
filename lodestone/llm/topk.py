"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Queries are dealt into blocks and candidates into shards of bounded bytes; one task multiplies one block with one shard,
keeps the ``k`` best candidates of each query, and passes on k rows a query.  A candidate is copied once a block, a query
once a shard, so blocks and shards are as large as a task can well hold.  Merging goes up a tree of fan-in
``FAN``: a query's lists meet ``FAN`` at a time, so no task gathers the lists of all shards.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Numbers that one side of a tile holds at most: 8 MB in double precision, whatever the vectors' length.
TILE_VALUES = 1 << 20
FAN = 8
#: Integers of a smaller magnitude are exact in double precision.
EXACT = float(1 << 53)


def finite(vector: str) -> Column:
    """True for a vector without null, NaN or infinite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _tile(rows: pa.Table, k: int) -> pa.Table:
    """Best ``k`` candidates of each query of one tile; ties go to the smaller vec_id."""
    asked = rows.column("is_query").to_numpy().astype(bool)
    ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"))
    shard = rows.column("shard")[0].as_py()
    order = np.argsort(ids[~asked], kind="stable")
    candidates, theirs = ids[~asked][order], vectors[~asked][order]
    queries, own = ids[asked], vectors[asked]
    found: tuple[list, list, list] = ([], [], [])
    if len(queries) and len(candidates):
        largest = float(np.abs(own).max(initial=0)) * float(np.abs(theirs).max(initial=0)) * max(1, own.shape[1])
        if largest < EXACT:
            own, theirs = own.astype(np.float64), theirs.astype(np.float64)
        for at in range(0, len(queries), 256):
            scores = own[at : at + 256] @ theirs.T
            for i, row in enumerate(scores):
                query = queries[at + i]
                if len(row) > k + 1:
                    # one more than k, as the query's own row may be among them
                    near = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                else:
                    near = np.arange(len(row))
                near = near[candidates[near] != query]
                best = near[np.argsort(-row[near], kind="stable")[:k]]
                found[0].append(np.full(len(best), query))
                found[1].append(candidates[best])
                found[2].append(row[best].astype(np.int64))
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
    return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2], "node": np.full(len(columns[0]), shard, np.int64)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``vectors`` (vec_id long, vector array<long>) to query_id, rank, vec_id, score: the k largest inner products.

    Rows with a null vec_id or vector take no part; vectors meet only vectors of their own length.  Rows of the query's
    vec_id are the query's own.  A vec_id asks once: of repeated query rows, that with the least vector (by components in
    order) is the query.  Ties go to the smaller vec_id; a repeated candidate row is listed as often as it is there.  Sums
    must fit 64 bits.  Other columns, whatever their names, are not looked at.  An empty table gives an empty result.
    """
    rows = stored(
        vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector", F.size("vector").alias("dim"), is_query.alias("asked")), "vectors"
    )
    asked, n = rows.agg(F.sum(F.when(F.col("asked"), F.col("dim")).otherwise(0)), F.sum("dim")).first()
    blocks, shards = (max(1, -(-(values or 0) // TILE_VALUES)) for values in (asked, n))
    spread = lambda column, many: F.pmod(F.xxhash64(column), F.lit(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    queries = rows.where("asked").groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    left = queries.select("dim", spread(F.col("vec_id"), blocks).alias("block"), every(shards).alias("shard"), F.lit(1).alias("is_query"), "vec_id", "vector")
    right = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "dim", every(blocks).alias("block"), spread(F.col("_row"), shards).alias("shard"), F.lit(0).alias("is_query"), "vec_id", "vector"
    )
    lists = left.union(right).groupBy("dim", "block", "shard").applyInArrow(lambda rows: _tile(rows, k), "query_id long, vec_id long, score long, node long")
    while True:
        shards = -(-shards // FAN)
        order = Window.partitionBy("query_id", "node").orderBy(F.col("score").desc(), "vec_id")
        merged = lists.withColumn("node", F.floor(F.col("node") / FAN)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        lists = merged.drop("rank")
        if shards == 1:
            return merged.select("query_id", "rank", "vec_id", "score")


def op1_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite("embedding"))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return top_k(whole, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
