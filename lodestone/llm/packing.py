"""Packing by optimal length buckets: a dynamic program over the global length histogram picks the bucket bounds that
need the least padding; token-budget batches form inside each bucket.

Tokens are the words ``[^\\x20\\x09-\\x0D]+``.  Texts longer than ``longest`` are cut into pieces of that length, so no
token is lost.  The histogram has at most ``longest`` entries, whatever the input; only it goes to the driver.

Sequences of a bucket are numbered without sorting the bucket: each row falls into one of many slices by its hash,
is numbered within its slice, and the slice's offset (a running sum of slice counts) is added.  Batch number and slot
follow from that number, so every batch of a bucket but its last is full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, stored, table
from .mixing import n_words, small

LONGEST = 2048
BUCKETS = 16
BUDGET = 65_536
#: Rows that one slice holds on average.
SLICE_ROWS = 20_000


def bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding, by exact dynamic programming."""
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    n, k = len(lengths), min(buckets, len(lengths))
    # cost[i, j]: padding of one bucket over lengths i .. j
    cost = lengths[None, :] * (rows[None, 1:] - rows[:n, None]) - (tokens[None, 1:] - tokens[:n, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, cuts = cost[0].copy(), []
    for _ in range(1, k):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        at = total.argmin(axis=0)
        better = total[at, np.arange(n)]
        cuts.append(np.where(better < best, at, -1))
        best = np.minimum(best, better)
    out, j = [], n - 1
    for at in reversed(cuts):
        i = int(at[j])
        if i < 0:
            continue
        out.append(int(lengths[j]))
        j = i - 1
    out.append(int(lengths[j]))
    return out[::-1]


def pack(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence: doc_id, piece (from 0), first_token, n_tokens, bucket_len, batch_id, slot.

    ``batch_id`` is unique over all buckets; a batch holds at most ``budget`` padded tokens (one sequence at least).
    Null or wordless texts give one sequence of no tokens with bucket_len 0 and no batch.  Texts of any length are cut
    into pieces.  Repeated rows each give their sequences; sequences of one length are told apart by doc_id and piece.
    Other columns, whatever their names, are not looked at.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text").cast("string")).alias("_n"))
    rows = stored(counted.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    whole, rest = F.floor(F.col("_n") / longest), F.col("_n") % longest
    full = rows.where(f"_n >= {longest}").agg(F.sum(F.floor(F.col("_n") / longest))).first()[0] or 0
    histogram = {int(r["_l"]): int(r["_c"]) for r in rows.groupBy(rest.alias("_l")).agg(F.count("*").alias("_c")).collect()}
    histogram.pop(0, None)
    if full:
        histogram[longest] = histogram.get(longest, 0) + int(full)
    tops = bounds(histogram, buckets)
    each = {top: sum(c for x, c in histogram.items() if low < x <= top) for low, top in zip([0, *tops], tops)}

    pieces = F.greatest(F.lit(1), whole + (rest > 0).cast("long")).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cut = cut.withColumn("first_token", F.col("piece").cast("long") * longest).withColumn("n_tokens", F.least(F.lit(longest), F.col("_n") - F.col("first_token")))
    bucket, capacity, start, slots, offset = F.lit(0), F.lit(1), F.lit(0), F.lit(1), 0
    for top in reversed(tops):
        bucket = F.when(F.col("n_tokens") <= top, F.lit(top)).otherwise(bucket)
    cut = cut.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, bucket).otherwise(F.lit(0)).cast("long"))
    for top in tops:
        size = max(1, budget // top)
        here = F.col("bucket_len") == top
        capacity, start = F.when(here, F.lit(size)).otherwise(capacity), F.when(here, F.lit(offset)).otherwise(start)
        slots = F.when(here, F.lit(max(1, -(-each[top] // SLICE_ROWS)))).otherwise(slots)
        offset += -(-each[top] // size)
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.col("_row")), "piece")
    placed = cut.withColumn("_slice", F.pmod(key, slots))
    counts = placed.groupBy("bucket_len", "_slice").agg(F.count("*").alias("_many"))
    before = Window.partitionBy("bucket_len").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held(counts.select("bucket_len", "_slice", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_from")))
    order = Window.partitionBy("bucket_len", "_slice").orderBy("doc_id", "piece", "_row")
    numbered = placed.withColumn("_turn", F.row_number().over(order)).join(small(offsets), ["bucket_len", "_slice"])
    numbered = numbered.withColumn("_at", F.col("_from") + F.col("_turn") - 1)
    some = F.col("bucket_len") > 0
    return numbered.select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "bucket_len",
        F.when(some, F.floor(F.col("_at") / capacity) + start).cast("long").alias("batch_id"),
        F.when(some, F.col("_at") % capacity).cast("long").alias("slot"),
    )


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that the other stages kept, as :func:`pack` gives them; a document that stands several
    times gives its sequences as often."""
    return pack(docs)


def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, tokens and padding of all buckets together, and the fullest batch in padded tokens."""
    rows = op8_length_buckets(spark, sf_dir).where("bucket_len > 0")
    batches = rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.sum("bucket_len").alias("p"))
    return batches.agg(F.sum("n").alias("sequences"), F.sum("t").alias("tokens"), (F.sum("p") - F.sum("t")).alias("padding"), (F.max("p") <= BUDGET).alias("within"))


#: Least padding of ``BUCKETS`` buckets by a dynamic program in SQL: best(k, i) is that of the first i lengths in k buckets.
PADDING_SQL = rf"""
WITH RECURSIVE t AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT {LONGEST} AS x, sum(n // {LONGEST})::BIGINT AS c FROM t UNION ALL SELECT n % {LONGEST}, count(*) FROM t GROUP BY 1),
h AS (SELECT x, sum(c) AS c FROM s WHERE x > 0 GROUP BY 1 HAVING sum(c) > 0),
p AS (SELECT row_number() OVER (ORDER BY x) AS i, x, sum(c) OVER (ORDER BY x) AS rows, sum(c * x) OVER (ORDER BY x) AS tokens FROM h),
z AS (SELECT 0 AS i, 0 AS x, 0 AS rows, 0 AS tokens UNION ALL SELECT * FROM p),
cost AS (SELECT a.i AS a, b.i AS b, (b.x * (b.rows - a.rows) - (b.tokens - a.tokens))::BIGINT AS pad FROM z a JOIN z b ON a.i < b.i),
best AS (SELECT 1 AS k, b AS i, pad FROM cost WHERE a = 0 UNION ALL SELECT k, i, min(pad) FROM (SELECT best.k + 1 AS k, cost.b AS i, best.pad + cost.pad AS pad FROM best JOIN cost ON cost.a = best.i WHERE best.k < {BUCKETS}) GROUP BY 1, 2)
SELECT (SELECT sum(c) FROM h)::BIGINT AS sequences, (SELECT sum(c * x) FROM h)::BIGINT AS tokens, min(pad)::BIGINT AS padding, true AS within FROM best WHERE i = (SELECT max(i) FROM p)
"""
