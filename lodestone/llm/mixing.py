"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. Sources in code-point order (null last) weigh 5, 2, 1, repeating.  They share all words; a target stops at ``most``
   times its source's words and the excess goes to the others by weight (:func:`water_fill`, a closed form).
2. Within a source, expected copies of a document rise slowly with its size class (:func:`odds`) and stop at ``most``;
   their sum over words is the target.  The whole part of the expectation is taken for certain.
3. The fraction is the inclusion probability p of Pareto order sampling: documents are ranked by
   ``u / (1 - u) / (p / (1 - p))`` with u from a digest of the row, and the first ones are taken until their words reach
   what the source still lacks.  The cut lands within half a document of the target.

The cut is found without sorting a source: words are summed in 4,096 bins of the rank, then in 4,096 bins of the one bin
that holds the cut, then over the few rows left.  A source with a third of all rows costs no more in any one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
#: Per-source tables up to this many rows are broadcast, larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

_BLANK = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0): one mark is left for each word, and marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{_BLANK}]*+[^{_BLANK}]++", "\x01")
    return F.length(F.regexp_replace(marks, rf"[{_BLANK}]++", "")).cast("long")


def size_class(size: Column) -> Column:
    """Whole part of log2(1 + size)."""
    return (F.length(F.bin(size + 1)) - 1).cast("long")


def odds(size_class: Column) -> Column:
    """Relative expected copies of a document; sixteenths, so that sums are exact in any order."""
    return 1 + size_class.cast("double") / 16


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table that is kept after a look at its size; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def water_fill(rows: DataFrame, by: list[str], weight: str, cap: str, total: str) -> DataFrame:
    """Add ``level``: rows of a group get min(cap, level * weight) each, ``total`` in sum; null if all are capped."""
    group = [F.col(c) for c in by] or [F.lit(1)]
    order = Window.partitionBy(*group).orderBy(F.col(cap) / F.col(weight), F.col(weight).desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum(weight).over(Window.partitionBy(*group)) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    )
    tried = rows.withColumn("_level", level).withColumn("_turn", F.row_number().over(order))
    fits = F.when(F.col("_level") * F.col(weight) <= F.col(cap), F.struct("_turn", "_level"))
    return tried.withColumn("level", F.min(fits).over(Window.partitionBy(*group))["_level"]).drop("_level", "_turn")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with _size, _class, _key (32 hex digits from doc_id and text) and _u (from _key, within 0 and 1)."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    draw = (F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return docs.withColumn("_size", n_words(F.col("text"))).withColumn("_class", size_class(F.col("_size"))).withColumn("_key", key).withColumn("_u", draw)


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the class plan and the place _v of a row in the order, between 0 and 1, as bins _b1 and _b2."""
    own = plan.withColumnsRenamed({"source": "_s", "_class": "_c"})
    out = rows.join(small(own), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c"))).drop("_s", "_c")
    rank = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    out = out.withColumn("_v", F.when(F.col("_p") > 0, rank / (1 + rank)))
    first = F.floor(F.col("_v") * BINS)
    return out.withColumn("_b1", first).withColumn("_b2", F.floor((F.col("_v") * BINS - first) * BINS))


def _crossing(binned: DataFrame, by: list[str], key: str) -> DataFrame:
    """The first bin of each source that ends beyond what it lacks, and the words before that bin."""
    sums = binned.groupBy("source", *by).agg(F.sum("_size").alias("_w"), F.min("_lack").alias("_lack"), F.min("_before").alias("_start"))
    sums = sums.withColumn("_end", F.col("_start") + F.sum("_w").over(Window.partitionBy("source").orderBy(*by)))
    return sums.where("_end > _lack and _end - _w <= _lack").select(F.col("source").alias("_s"), F.col(by[0]).alias(key), (F.col("_end") - F.col("_w")).alias(f"_before_{key}"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """From stored (source, _size, _class, _key, _u): the plan by source and class, and the cut by source."""
    classes = sizes.groupBy("source", "_class").agg(F.sum("_size").alias("_words"))
    totals = classes.groupBy("source").agg(F.sum("_words").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    shares = totals.withColumn("_weight", weigh).withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double"))
    shares = water_fill(shares, [], "_weight", "_cap", "_all").withColumn("target", F.least("_cap", F.coalesce(F.col("level") * F.col("_weight"), F.col("_cap"))))
    targets = stored(shares.select(F.col("source").alias("_s"), "source_size", "target"), "targets")
    plan = classes.join(small(targets), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("_weight", F.col("_words") * odds(F.col("_class"))).withColumn("_cap", (most * F.col("_words")).cast("double"))
    filled = water_fill(plan.where("_words > 0"), ["source"], "_weight", "_cap", "target")
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("level") * odds(F.col("_class")), F.lit(float(most))))
    filled = filled.withColumn("_m", copies).withColumn("_sure", F.floor("_m")).withColumn("_p", F.col("_m") - F.floor("_m"))
    filled = filled.withColumn("_lack", F.col("target") - F.sum(F.col("_sure") * F.col("_words")).over(Window.partitionBy("source")))
    columns = ["source", "_class", "source_size", "target", "_sure", "_p", "_lack"]
    empty = plan.where("_words = 0").withColumns({"_sure": F.lit(0).cast("long"), "_p": F.lit(0.0), "_lack": F.lit(0.0)})
    plan = stored(filled.select(columns).unionByName(empty.select(columns)), "plan")

    ranked = _ranked(sizes, plan).where("_v is not null")
    one = stored(_crossing(ranked.withColumn("_before", F.lit(0).cast("long")), ["_b1"], "_cut1"), "cut1")
    inside = ranked.join(small(one), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b1") == F.col("_cut1"))).drop("_s").withColumnRenamed("_before__cut1", "_before")
    two = stored(_crossing(inside, ["_b2"], "_cut2"), "cut2")
    inside = inside.drop("_before").join(small(two), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b2") == F.col("_cut2"))).drop("_s").withColumnRenamed("_before__cut2", "_before")
    ties = inside.groupBy("source", "_v", "_key").agg(F.sum("_size").alias("_w"), F.min("_lack").alias("_lack"), F.min("_before").alias("_start"))
    ties = ties.withColumn("_end", F.col("_start") + F.sum("_w").over(Window.partitionBy("source").orderBy("_v", "_key")))
    last = ties.where("_end - _w / 2 <= _lack").groupBy("source").agg(F.max(F.struct("_v", "_key")).alias("_last"))
    cut = one.join(two, one["_s"].eqNullSafe(two["_s"]), "left").drop(two["_s"])
    cut = cut.join(last, F.col("_s").eqNullSafe(F.col("source")), "left").select("_s", "_cut1", "_cut2", "_last")
    return plan, stored(cut, "cut")


def mixed(rows: DataFrame, plan: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (measured) with source_size, target and _copies, the times that the mix takes each."""
    out = _ranked(rows, plan).join(small(cut), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    here = F.struct("_v", "_key")
    ahead = F.when(F.col("_v").isNull(), False).when(F.col("_cut1").isNull() | (F.col("_b1") < F.col("_cut1")), True).when(F.col("_b1") > F.col("_cut1"), False)
    ahead = ahead.when(F.col("_cut2").isNull() | (F.col("_b2") < F.col("_cut2")), True).when(F.col("_b2") > F.col("_cut2"), False).otherwise(F.coalesce(here <= F.col("_last"), F.lit(False)))
    return out.withColumn("_copies", F.col("_sure") + ahead.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words taken, repeats counted), copies.

    Null or wordless texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; rows
    equal in doc_id and text are taken or left together.  Texts of any length are counted whole.  Other columns, whatever
    their names, are not looked at.  An empty table gives an empty result.
    """
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sizes = stored(measured(own).drop("text"), "sizes")
    out = mixed(sizes, *mix_plan(sizes, weights, most))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document stands as often as it is taken, with all its columns, whatever their names.

    Null sources are a source of their own; null, empty and wordless texts are not taken; an empty table stays empty.
    """
    # documents travel as one struct, so that no column of theirs meets one of the plan
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    own = measured(docs.select(whole, "doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    sizes = stored(own.select("doc_id", "source", "_size", "_class", "_key", "_u"), "sizes")
    out = mixed(own, *mix_plan(sizes)).where("_copies > 0")
    return out.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
m AS (
  SELECT *, (length(bin(size + 1)) - 1)::BIGINT AS c, (('0x' || substr(k, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM sized),
classes AS (SELECT source, c, sum(size)::BIGINT AS words FROM m GROUP BY source, c),
totals AS (SELECT source, sum(words)::BIGINT AS source_size FROM classes GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS whole FROM totals),
tried AS (
  SELECT *, (whole - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS lv,
         row_number() OVER (ORDER BY cap / weight, weight DESC) AS turn FROM weighed
  WINDOW b AS (ORDER BY cap / weight, weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lv, turn) FROM tried WHERE lv * weight <= cap) * weight, cap)) AS target FROM tried),
plan0 AS (
  SELECT x.source, c, words, source_size, target, words * (1 + c::DOUBLE / 16) AS weight, (3 * words)::DOUBLE AS cap
  FROM classes x JOIN targets y ON x.source IS NOT DISTINCT FROM y.source WHERE words > 0),
plan1 AS (
  SELECT *, (target - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER (PARTITION BY source) - coalesce(sum(weight) OVER b, 0.0)) AS lv,
         row_number() OVER (PARTITION BY source ORDER BY cap / weight, weight DESC) AS turn FROM plan0
  WINDOW b AS (PARTITION BY source ORDER BY cap / weight, weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT source, arg_min(lv, turn) FILTER (lv * weight <= cap) AS level FROM plan1 GROUP BY source),
plan2 AS (
  SELECT p.*, least(3.0::DOUBLE, coalesce(level * (1 + c::DOUBLE / 16), 3.0)) AS mm FROM plan1 p JOIN levels l ON p.source IS NOT DISTINCT FROM l.source),
plan AS (
  SELECT *, floor(mm)::BIGINT AS sure, mm - floor(mm) AS p, target - sum(floor(mm)::BIGINT * words) OVER (PARTITION BY source) AS lack FROM plan2),
ranked AS (
  SELECT m.doc_id, m.source, m.size, m.k, plan.sure, plan.p, plan.lack,
         CASE WHEN plan.p > 0 THEN (u / (1 - u)) / (plan.p / (1 - plan.p)) END AS q
  FROM m LEFT JOIN plan ON m.source IS NOT DISTINCT FROM plan.source AND m.c = plan.c),
summed AS (
  SELECT *, q / (1 + q) AS v, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q / (1 + q), k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source, q / (1 + q), k) AS own FROM ranked)
SELECT s.doc_id, s.size, t.source_size, t.target,
       (s.size * (coalesce(sure, 0) + CASE WHEN q IS NOT NULL AND run - own / 2 <= lack THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""
