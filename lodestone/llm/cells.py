"""Embedding near-dedup: spherical k-means assigns vectors to cells, blocked cosine products compare within cells.

Centres are fitted on a bounded sample; every vector is assigned.  A vector x of cell i also visits each cell j > i that
a partner of cosine >= t can lie in.  Such a partner is within the angle arccos(t) of x, and in cell j only if it is
nearer to centre j, so x must lie within that angle of the plane between the two centres:
``x . (ci - cj) <= sqrt(1 - t*t) * |ci - cj|``.  That bound is exact, so no pair is lost whatever the centres are.

Cells are cut into blocks of bounded size and one task compares two blocks, so a crowded cell becomes more tasks, not a
larger one.  Equal vectors are one class and count with their number.  A task returns link counts and a spanning forest
of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components
from .mixing import small
from .topk import finite

#: Vectors and numbers that the centres are fitted on at most.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 8_000_000
MOST_CELLS = 1_024
#: Numbers of one block at most (16 MB), rows of one at least, blocks that one cell holds on average.
BLOCK_VALUES, LEAST_ROWS, CELL_BLOCKS = 1 << 21, 16, 2
ROUNDS = 8
CHUNK = 512


def block_rows(dim: int) -> int:
    """Rows of a block of vectors of ``dim`` numbers: a vector is sent once a block that it meets, so blocks are large."""
    return max(LEAST_ROWS, BLOCK_VALUES // max(1, dim))


def _unit(data: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
        at = at - at[0]
        data = [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
        keys = [xxhash.xxh3_128_digest(x) for x in data]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(at).astype(np.int64)), pa.array(data, pa.binary())], names=["vec_id", "digest", "dim", "data"])


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on unit vectors: ``k`` unit centres at most."""
    rng = np.random.Generator(np.random.PCG64(11))
    k = min(k, len(sample))
    out = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS if k > 1 else 0):
        home = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, home, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        out = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), out)
    return out


def _assign(batches: Iterator[pa.RecordBatch], fitted: dict[int, np.ndarray], t: float) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, many, dim, data) to (dim, cell, home, vec_id, many, data): the home cell and the cells visited."""
    reach = math.sqrt(1 - t * t) + 1e-9
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            middle = fitted.get(int(dim))
            if middle is None or len(middle) == 1:
                take, cell, home = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), np.ones(rows.num_rows, bool)
            else:
                near = _unit(rows.column("data").to_pylist()) @ middle.T
                own = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * (middle @ middle.T)))
                visits = (near.max(axis=1)[:, None] - near <= reach * apart[own]) & (np.arange(len(middle))[None, :] > own[:, None])
                where, other = np.nonzero(visits)
                take, cell = np.concatenate([np.arange(rows.num_rows), where]), np.concatenate([own, other])
                home = np.arange(len(take)) < rows.num_rows
            took = rows.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [took.column("dim"), pa.array(cell.astype(np.int64)), pa.array(home), took.column("vec_id"), took.column("many"), took.column("data")],
                names=["dim", "cell", "home", "vec_id", "many", "data"],
            )


def _links(rows: pa.Table, t: float) -> pa.Table:
    """Compare two blocks (or one with itself): vec_id, vectors linked, smallest vec_id connected within the task."""
    second = rows.column("second").to_numpy(zero_copy_only=False).astype(bool)
    alone = not second.any()
    ids, many = rows.column("vec_id").to_numpy(), rows.column("many").to_numpy().astype(np.float64)
    unit = _unit(rows.column("data").to_pylist())
    one, two = np.flatnonzero(~second), np.flatnonzero(~second if alone else second)
    counts, root = np.zeros(len(ids)), np.arange(len(ids))
    for at in range(0, len(one), CHUNK):
        part = one[at : at + CHUNK]
        near = unit[part] @ unit[two].T >= t
        if alone:
            near[np.arange(len(part)), at + np.arange(len(part))] = False
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            continue
        counts[part] += near @ many[two]
        if not alone:
            counts[two] += many[part] @ near
        for i in hit:
            mine = np.unique(np.append(root[two[near[i]]], root[part[i]]))
            if len(mine) > 1:
                root[np.isin(root, mine)] = mine[0]
    linked = np.flatnonzero(counts > 0)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root[linked], ids[linked])
    return pa.table({"vec_id": ids[linked], "links": counts[linked].astype(np.int64), "low": least[root[linked]]})


def near_vectors(vectors: DataFrame, t: float = 0.9) -> DataFrame:
    """``vectors`` (vec_id, embedding) to one row per row: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do rows with a null
    vec_id (their component is null and they are kept).  Vectors of different lengths are not compared.  Equal vectors
    and repeated rows link with each other; a group's head is its smallest vec_id.  Other columns, whatever their names,
    are not looked at.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = finite("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    packed = stored(rows.where(usable).mapInArrow(_pack, "vec_id long, digest binary, dim long, data binary"), "packed")
    classes = stored(
        packed.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("many"), F.first("dim").alias("dim"), F.first("data").alias("data")), "classes"
    )
    fitted: dict[int, np.ndarray] = {}
    for dim, n in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect():
        k = min(MOST_CELLS, -(-n // (CELL_BLOCKS * block_rows(dim))))
        if k > 1:
            most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, dim)))
            sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("data").collect()
            fitted[dim] = centres(_unit([bytes(x[0]) for x in sample]), k)
    placed = stored(
        classes.select("vec_id", "many", "dim", "data").mapInArrow(partial(_assign, fitted=fitted, t=t), "dim long, cell long, home boolean, vec_id long, many long, data binary"),
        "cells",
    )
    rows_of = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.lit(1), F.col("dim"))))
    blocks = lambda home: F.greatest(F.lit(1), F.ceil(F.sum((F.col("home") == home).cast("long")) / rows_of))
    sizes = stored(placed.groupBy("dim", "cell").agg(blocks(True).alias("homes"), blocks(False).alias("guests"), F.sum((~F.col("home")).cast("long")).alias("n_guests")), "sizes")
    dealt = placed.join(small(sizes), ["dim", "cell"])
    spot = lambda many: F.pmod(F.xxhash64("vec_id"), F.col(many))
    upto = lambda many: F.sequence(F.lit(0).cast("long"), F.col(many) - 1)
    tail = ["vec_id", "many", "data"]
    host = dealt.where("home").withColumn("_b", spot("homes"))
    inner = host.withColumn("_o", F.explode(upto("homes"))).select(
        "dim", "cell", F.lit(0).alias("kind"), F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), (F.col("_b") > F.col("_o")).alias("second"), *tail
    )
    met = host.where("n_guests > 0").withColumn("p", F.explode(upto("guests"))).select("dim", "cell", F.lit(1).alias("kind"), "p", F.col("_b").alias("q"), F.lit(True).alias("second"), *tail)
    guest = dealt.where("not home").withColumn("q", F.explode(upto("homes"))).select("dim", "cell", F.lit(1).alias("kind"), spot("guests").alias("p"), "q", F.lit(False).alias("second"), *tail)
    found = inner.union(met).union(guest).groupBy("dim", "cell", "kind", "p", "q").applyInArrow(lambda rows: _task(rows, t), "vec_id long, links long, low long")
    found = stored(found, "found")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.where("low <> vec_id").select(F.col("low").alias("a"), F.col("vec_id").alias("b")))
    heads = classes.select("digest", F.col("vec_id").alias("_rep"), "many")
    heads = heads.join(counts, heads._rep == counts.vec_id, "left").drop("vec_id").join(parts, F.col("_rep") == F.col("node"), "left")
    own = packed.select("vec_id", "digest").join(heads, "digest").groupBy(F.col("vec_id").alias("_id")).agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.min(F.coalesce("component", "_rep")).alias("_component")
    )
    out = rows.select("vec_id", usable.alias("_ok")).join(own, F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.when(F.col("_ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("_ok"), F.coalesce("_component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _task(rows: pa.Table, t: float) -> pa.Table:
    same = rows.column("kind")[0].as_py() == 0 and rows.column("p")[0].as_py() == rows.column("q")[0].as_py()
    second = rows.column("second").to_numpy(zero_copy_only=False).astype(bool)
    if not same and (second.all() or not second.any()):
        return pa.table({c: pa.array([], pa.int64()) for c in ("vec_id", "links", "low")})
    return _links(rows, t)


def op3_cell_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The same result by brute force over all pairs of vectors.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, len(q) AS dim, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.dim = b.dim AND a.vec_id <> b.vec_id AND list_dot_product(a.q, b.q) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node AND r.low < l.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
