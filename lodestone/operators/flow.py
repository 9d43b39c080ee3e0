"""Order-dependent dataflow steps as windows and higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def kept(rows: DataFrame) -> DataFrame:
    """Hold a result that several branches of a plan read, so that it is planned and computed once."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows with each column computed once.

    The optimizer moves a filter before the columns that it reads and computes them there again, and puts a column that is
    named once into a lambda that runs for each element; where such columns stand on one another, the work multiplies.
    Neither passes a generator.
    """
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("_v")).select("_v.*")


#: Bytes of stored input for one task of :func:`dealt`, and input from which its tasks are counted.
TASK_BYTES, MANY_BYTES = 4 << 20, 16 << 20


def dealt(rows: DataFrame, *keys) -> DataFrame:
    """Rows dealt by keys to as many tasks as their stored input needs.

    What follows by these keys is grouped where the rows lie.  Grouped before the shuffle, keys that hardly repeat are held
    twice, and tasks that are merged by the bytes of a shuffle hold more as pairs or sorted rows than they read.  Small
    inputs and those of unknown size are left to the session's settings.
    """
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if not MANY_BYTES < size < 1 << 50:
        return rows.repartition(*keys)
    return rows.repartition(max(-(-size // TASK_BYTES), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def numbered(rows: DataFrame, group: list[str], order: list, name: str = "item_no") -> DataFrame:
    """W-01, W-02: numbers from 1 within a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def request_ids(rows: DataFrame, group: str, order: list) -> DataFrame:
    """W-02: ``group:req_001`` in order."""
    return numbered(rows, [group], order, "_n").withColumn("request_id", F.format_string("%s:req_%03d", F.col(group), F.col("_n"))).drop("_n")


def occurrence_ids(rows: DataFrame, group: str, base: str, order: list) -> DataFrame:
    """W-03: the base id, from the second occurrence on with its number as ``_02``."""
    turn = F.row_number().over(Window.partitionBy(group, base).orderBy(*order))
    return rows.withColumn("_n", turn).withColumn("block_id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.format_string("%s_%02d", F.col(base), F.col("_n")))).drop("_n")


def context(rows: DataFrame, reach: int = 2) -> DataFrame:
    """W-04: seeds with the text blocks within ``reach`` positions of them in the same document.

    ``rows``: notice_id, document_id, pos, is_seed, is_text.  Each seed names its neighbours' positions, which are then
    looked up by equality: no range join.
    """
    near = rows.where("is_seed").select("notice_id", "document_id", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos")).distinct()
    return rows.join(near, ["notice_id", "document_id", "pos"], "left_semi").where("is_text or is_seed")


def islands(rows: DataFrame, group: list[str], pos: str = "pos", gap: int = 1) -> DataFrame:
    """W-05: runs of positions without holes within a group, numbered as ``island``."""
    order = Window.partitionBy(*group).orderBy(pos)
    new = F.coalesce(F.col(pos) - F.lag(pos).over(order) > gap, F.lit(True)).cast("int")
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order)).drop("_new")


def packed(sizes: Column, budget: int, most: int | None = None, start: int = 0) -> Column:
    """W-06, W-07: chunk number of each element of an array of sizes: greedy, a chunk holds up to ``budget`` and
    ``most`` elements (one at least) and starts from ``start``."""
    zero = F.struct(F.lit(start).cast("long").alias("used"), F.lit(0).alias("held"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["held"] > 0) & (acc["used"] + size > budget)
        if most is not None:
            full = full | (acc["held"] >= most)
        chunk = acc["chunk"] + full.cast("int")
        return F.struct(
            (F.when(full, F.lit(start)).otherwise(acc["used"]) + size).cast("long").alias("used"), (F.when(full, 0).otherwise(acc["held"]) + 1).alias("held"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out")
        )

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def segments(text: Column, size: int) -> Column:
    """W-07: pieces of a text with their bounds; nothing for an empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("char_start"), F.least(s + size, F.length(text)).alias("char_end"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def prefix_budget(rows: DataFrame, group: list[str], order: list, size: str, budget: int) -> DataFrame:
    """W-08: rows of a group while the budget lasts; ``room`` is what is left for each, the last one may be cut to it."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("room", F.lit(budget) - before).where("room > 0").withColumn("used", F.least(size, "room"))


def slices_of(rows: DataFrame, group: list[str], order: list, size: int) -> DataFrame:
    """W-09, SRC-07: consecutive chunks of ``size`` rows."""
    return numbered(rows, group, order, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n")


def round_robin(rows: DataFrame, bucket: str, order: list) -> DataFrame:
    """W-10: first of each bucket, second of each bucket, and so on: ``place`` is the turn within the bucket, ``position``
    the place in the interleaved order.

    Before row p of a bucket stand min(size, p - 1) rows of each bucket and the p-th ones of buckets ahead, so positions
    follow from the buckets' sizes (one row a bucket) and no task sees all rows.
    """
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_size")).agg(F.sort_array(F.collect_list(F.struct(F.col(bucket).alias("b"), "_size"))).alias("_sizes"))
    placed = numbered(rows, [bucket], order, "place").withColumn("_one", F.lit(1)).join(F.broadcast(sizes.withColumn("_one", F.lit(1))), "_one")
    ahead = F.transform("_sizes", lambda x: F.least(x["_size"], F.col("place") - 1) + ((x["b"] < F.col(bucket)) & (x["_size"] >= F.col("place"))).cast("long"))
    return placed.withColumn("position", F.aggregate(ahead, F.lit(1).cast("long"), lambda a, x: a + x)).drop("_one", "_sizes")


def first_groups(rows: DataFrame, group: str, pos: str, n: int) -> DataFrame:
    """W-12: rows of the first ``n`` groups by first position."""
    starts = rows.groupBy(group).agg(F.min(pos).alias("_first")).orderBy("_first", group).limit(n)
    return rows.join(starts.select(group), group, "left_semi")


def after_strong(rows: DataFrame, group: str, pos: str, strong: Column, skipped: Column) -> DataFrame:
    """W-13: ``covered`` is true for ``skipped`` rows behind a strong one of their group."""
    past = F.max(strong.cast("int")).over(Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("covered", skipped & (F.coalesce(past, F.lit(0)) == 1))


def carried(rows: DataFrame, group: list[str], pos: str, value: Column, when: Column, name: str) -> DataFrame:
    """S-16, J-21: the last ``value`` of an earlier row of the group for which ``when`` holds."""
    past = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(past))


def even_sample(rows: DataFrame, group: list[str], order: list, budget: int, first: Column) -> DataFrame:
    """SRC-11: ``first`` rows take the budget in order; what is left is spread evenly over the others.

    Of m others and k places, place i takes row round(i * (m - 1) / (k - 1)), half to even; one place takes the middle.
    """
    whole = Window.partitionBy(*group)
    ranked = rows.withColumn("_first", first).withColumn("_turn", F.row_number().over(Window.partitionBy(*group, "_first").orderBy(*order)) - 1)
    ranked = ranked.withColumn("_k", F.greatest(F.lit(0), F.lit(budget) - F.sum(F.col("_first").cast("int")).over(whole))).withColumn("_m", F.sum((~F.col("_first")).cast("int")).over(whole))
    places = F.when(F.col("_k") >= F.col("_m"), F.sequence(F.lit(0).cast("long"), F.col("_m").cast("long"))).when(F.col("_k") == 1, F.array(F.floor(F.col("_m") / 2)))
    places = places.when(F.col("_k") > 1, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_k").cast("long") - 1), lambda i: F.bround(i * (F.col("_m") - 1) / (F.col("_k") - 1)).cast("long")))
    keep = F.when(F.col("_first"), F.col("_turn") < budget).otherwise(F.coalesce(F.array_contains(places, F.col("_turn").cast("long")), F.lit(False)))
    return ranked.where(keep).drop("_first", "_turn", "_k", "_m")


def best_sources(rows: DataFrame, notice: str, source: list[str], score: str, pos: str, least: int, most: int) -> DataFrame:
    """K-10: all rows at or above ``least`` of the ``most`` best sources of a notice, in document order."""
    able = rows.where(F.col(score) >= least)
    tops = able.groupBy(notice, *source).agg(F.max(score).alias("_top"), F.min_by(pos, F.struct(-F.col(score), F.col(pos))).alias("_pos"))
    tops = numbered(tops, [notice], [F.desc("_top"), "_pos"], "_place").where(F.col("_place") <= most)
    return able.join(tops.select(notice, *source), [notice, *source], "left_semi")


def top_per_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """K-09, K-11, K-12: the first ``most`` rows of each group (planned as a two-phase group limit)."""
    return numbered(rows, group, order, "_place").where(F.col("_place") <= most).drop("_place")


def fallback(rows: DataFrame, group: str, score: str, least: int, order: list, most: int, floor: int) -> DataFrame:
    """K-11: rows at or above ``least``; a group without any gives its first ``most`` at or above ``floor``."""
    high = F.max(score).over(Window.partitionBy(group))
    marked = rows.withColumn("_high", high)
    strong = marked.where(F.col(score) >= least).withColumn("fallback", F.lit(False))
    weak = top_per_group(marked.where((F.col("_high") < least) & (F.col(score) >= floor)), [group], order, most).withColumn("fallback", F.lit(True))
    return strong.union(weak).drop("_high")


def latest(rows: DataFrame, key: list[str], seq: list) -> DataFrame:
    """D12, M-07, M-08, T-04: the last row of each key."""
    return numbered(rows, key, [F.desc(s) if isinstance(s, str) else s for s in seq], "_place").where("_place = 1").drop("_place")


def within_budget(rows: DataFrame, group: list[str], order: list, cost: str, limit: float) -> DataFrame:
    """T-06, P-03: rows that start before the budget of their group is spent; the last may overshoot."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("spent_before", before).where(F.col("spent_before") < limit)


def pruned(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M-09: lines of a state log that stay (both outcomes ok), and the notices to try again."""
    good = F.coalesce((F.col("status") == "ok") & (F.col("llm_status") == "ok"), F.lit(False))
    return state.where(good), state.where(~good).select("notice_id").distinct()


def running_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before each, in one order over the whole table: sums by range partition first, then
    within each, so that no task sees all rows."""
    spark = rows.sparkSession
    dealt = kept(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["_s"] for r in dealt.groupBy("_part").agg(F.sum(value).alias("_s")).collect()}  # one row a partition
    base, total = [], 0
    for part in sorted(sums):
        base.append((part, str(total)))
        total = total + (sums[part] or 0)
    kind = dict(dealt.groupBy().agg(F.sum(value).alias("s")).dtypes)["s"]
    offsets = spark.createDataFrame(base, "_part int, _base string").withColumn("_base", F.col("_base").cast(kind))
    past = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(past), F.lit(0))).drop("_part", "_base")


def changes(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """T-01: rows whose value differs from the one before (the first is a change)."""
    past = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("_change", first | ~F.col(value).eqNullSafe(past)).where("_change").drop("_change")


def resumed(work: DataFrame, state: DataFrame, exact: list[str], loose: list[str]) -> DataFrame:
    """M-07, J-19, T-07: each piece of work with its reusable outcome: the exact key first, then any success under the
    loose key.  ``state`` has seq, status and outcome; the last row of a key counts."""
    last = latest(state, exact, ["seq"]).select(*exact, F.col("status").alias("_status"), F.col("outcome").alias("_exact"))
    good = latest(state.where("status = 'success'"), loose, ["seq"]).select(*loose, F.col("outcome").alias("_loose"))
    rows = work.join(last.where("_status in ('success', 'needs_model', 'candidate_only')").drop("_status"), exact, "left").join(good, loose, "left")
    return rows.withColumn("outcome", F.coalesce("_exact", "_loose")).drop("_exact", "_loose").withColumn("todo", F.col("outcome").isNull())


def sampled(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """R-01: ``n`` rows without replacement, the same for the same seed."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)
