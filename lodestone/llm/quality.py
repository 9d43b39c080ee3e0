"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score s = weights . features is shared by all grades; ordered thresholds cut it: P(grade <= g) = logistic(c_g - s).
Features are hashed text: mean weight of the text's words and of its byte trigrams, how many words repeat an earlier one
at a few distances, and the share of distinct words in steps; a text of any length is scored whole.  Results are the expected grade and the tail probability
P(grade >= keep_from), by which documents are selected.

Fitting uses at most ``SAMPLE`` rated texts of each grade and ``ENTRIES`` features of all their texts, stated bounds; hashed
counts, not texts, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .words import _VALUE, mix, raw, slices, words

BITS = 16
SAMPLE, ENTRIES = 1_500, 12_000_000
EPOCHS = 24
BATCH = 128
RATE = 0.3
DECAY = 1e-5
_U = np.uint64
_SHIFT = _U(64 - BITS)
_TRIGRAM = 1 << BITS
LAGS = (1, 2, 3, 4, 5, 6, 7, 8)
STEPS = 16
_LAG = 2 * _TRIGRAM
_STEP = _LAG + len(LAGS)
WEIGHTS = _STEP + STEPS


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Slots of the byte trigrams that start at each byte."""
    v = _VALUE[data]
    if len(v) < 3:
        return np.zeros(0, np.int64)
    return (mix(v[:-2] * _U(0x9E3779B97F4A7C15) + v[1:-1] * _U(0xC2B2AE3D27D4EB4F) + v[2:]) >> _SHIFT).astype(np.int64)


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[np.maximum(begin, end)] - total[begin]


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Shared score of each text; nothing to go by (NaN) for texts without words."""
    hashes, _, _, at = words(texts)
    data, offsets = raw(texts)
    n = np.diff(at)
    word = _sums(weights[(hashes >> _SHIFT).astype(np.int64)], at[:-1], at[1:]) / np.maximum(1, n)
    tri = weights[_TRIGRAM + _trigrams(data)]
    last = np.minimum(np.maximum(offsets[:-1], offsets[1:] - 2), len(tri))
    chars = _sums(tri, np.minimum(offsets[:-1], len(tri)), last) / np.maximum(1, last - offsets[:-1])
    again = np.zeros(len(texts))
    owner = np.repeat(np.arange(len(texts)), n)
    for i, lag in enumerate(LAGS):
        same = (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag]) if len(hashes) > lag else np.zeros(0, bool)
        again += weights[_LAG + i] * np.bincount(owner[lag:][same], minlength=len(texts)) / np.maximum(1, n)
    distinct = np.array([_step(hashes[i:j]) for i, j in zip(at[:-1], at[1:])], dtype=np.int64)
    return np.where(n > 0, word + chars + again + weights[_STEP + distinct], np.nan)


def _step(hashes: np.ndarray) -> int:
    """Step of the share of distinct words, longer texts having fewer anyway."""
    if not len(hashes):
        return 0
    return min(STEPS - 1, int(STEPS * len(np.unique(hashes)) / len(hashes)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, grade, id) to (slots, values, grade, id): the same features as in ``scores``, one entry a slot."""
    for batch in batches:
        slots, values = [], []
        for row in range(batch.num_rows):
            texts = batch.column(0).slice(row, 1)
            word = (words(texts)[0] >> _SHIFT).astype(np.int64)
            tri = _trigrams(raw(texts)[0])
            one, many = np.unique(word, return_counts=True)
            two, more = np.unique(tri, return_counts=True)
            hashes = words(texts)[0]
            lags = [(hashes[x:] == hashes[:-x]).sum() / max(1, len(hashes)) for x in LAGS]
            slots.append(np.concatenate([one, two + _TRIGRAM, _LAG + np.arange(len(LAGS)), [_STEP + _step(hashes)]]).astype(np.int32))
            values.append(np.concatenate([many / max(1, len(word)), more / max(1, len(tri)), lags, [1.0]]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), batch.column(1), batch.column(2)], names=["slots", "values", "grade", "id"])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(slots: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, grades: int, weigh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by adaptive gradient steps on the cumulative-link likelihood."""
    weights, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
    raw_cuts, cuts_seen = np.concatenate([[-1.0], np.zeros(grades - 2)]), np.full(grades - 1, 1e-8)
    weigh = np.ones(len(grade)) if weigh is None else weigh
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        order = rng.permutation(len(grade))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            flat, value = np.concatenate([slots[i] for i in rows]), np.concatenate([values[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(slots[i]) for i in rows])
            s = np.bincount(owner, weights[flat] * value, minlength=len(rows))
            cuts = np.cumsum(np.concatenate([raw_cuts[:1], np.exp(raw_cuts[1:])]))
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            g = grade[rows]
            up, down = np.where(g == grades - 1, 1.0, _logistic(edges[g + 1] - s)), np.where(g == 0, 0.0, _logistic(edges[g] - s))
            # d log P / d s for P = up - down, both logistic
            ds = -(1 - up - down) * weigh[rows] / len(rows)
            p = np.maximum(up - down, 1e-9)
            dcut = np.zeros(grades + 1)
            np.add.at(dcut, g + 1, up * (1 - up) / p * weigh[rows] / len(rows))
            np.add.at(dcut, g, -down * (1 - down) / p * weigh[rows] / len(rows))
            dcut = dcut[1:grades]
            tail = np.cumsum(dcut[::-1])[::-1]
            draw = np.concatenate([tail[:1], tail[1:] * np.exp(raw_cuts[1:])])
            step = np.bincount(flat, value * ds[owner], minlength=len(weights)) - DECAY * weights
            seen += step * step
            weights += RATE * step / np.sqrt(seen)
            cuts_seen += draw * draw
            raw_cuts = raw_cuts + 0.1 * draw / np.sqrt(cuts_seen)
    return weights.astype(np.float32), np.cumsum(np.concatenate([raw_cuts[:1], np.exp(raw_cuts[1:])]))


def _rate(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column(1)):
            s = scores(texts, weights.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(s, mask=np.isnan(s))], names=["doc_id", "s"])


def rate(docs: DataFrame, ratings: DataFrame, keep_from: int = 1, cut: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, expected_grade, tail (P(grade >= keep_from)), kept.

    ``ratings`` (doc_id, grade from 0 up): null grades and ids are left out, a doc_id rated twice counts with its lower
    grade; of rated rows with one doc_id, the least text is fitted.  Null, empty and wordless texts have nothing to rate:
    expected_grade 0, tail 0, not kept.  Texts of any length are rated whole; texts whose words were never seen are rated
    by the rest of their features.  Without ratings of two grades nothing can be told: tail 1 and kept for every text with
    words.  Repeated rows are rated each, equal texts alike.  Other columns, whatever their names, are not looked at.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = ratings.where("doc_id is not null and grade >= 0").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("grade").cast("int")).alias("grade"))
    totals = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    grades = max(totals, default=0) + 1
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if len(totals) < 2:
        return own.select("doc_id", F.lit(0.0).alias("expected_grade"), F.when(worded, 1.0).otherwise(0.0).alias("tail"), worded.alias("kept"))
    picked = None
    for g in sorted(totals):
        part = known.where(F.col("grade") == g).orderBy(F.xxhash64(F.col("_id"), F.lit(41)), "_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    ids = stored(picked, "rated")
    # at most ``sample`` ids a grade are broadcast
    rows = own.where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("_id", "grade").agg(F.min("text").alias("text"))
    hashed = rows.select("text", "grade", "_id").repartition(12).mapInArrow(_hashed, "slots array<int>, values array<float>, grade int, id long")
    hashed = stored(hashed, "features")
    # the first of them, in a mixed order, whose features fit the bound; ids and counts of the bounded sample come to the driver
    sizes = sorted((x["_h"], x["id"], x["n"]) for x in hashed.select("id", F.size("slots").alias("n"), F.xxhash64("id", F.lit(43)).alias("_h")).collect())
    many = int(np.searchsorted(np.cumsum([n for _, _, n in sizes]), ENTRIES, "right"))
    if many < len(sizes):
        last = sizes[max(0, many - 1)][0]
        hashed = hashed.where(F.xxhash64("id", F.lit(43)) <= last)
    made = hashed.orderBy("id").toArrow()
    y = made.column("grade").to_numpy().astype(np.int64)

    def parts(name: str) -> list[np.ndarray]:
        column = made.column(name).combine_chunks()
        flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

    have = np.bincount(y, minlength=grades)
    weights, cuts = fit(parts("slots"), parts("values"), y, grades)
    # the sample holds the grades in other shares than the table: thresholds move by the log ratio of the tails
    shift = []
    for g in range(1, grades):
        real = sum(n for x, n in totals.items() if x >= g), sum(n for x, n in totals.items() if x < g)
        drawn = int(have[g:].sum()), int(have[:g].sum())
        shift.append(np.log(max(1, real[0]) / max(1, real[1])) - np.log(max(1, drawn[0]) / max(1, drawn[1])))
    cuts = np.maximum.accumulate(cuts - np.array(shift))
    shared = spark.sparkContext.broadcast(weights)
    rated = own.mapInArrow(partial(_rate, weights=shared), "doc_id long, s double")
    tails = [1 / (1 + F.exp(F.lit(float(c)) - F.col("s"))) for c in cuts]
    empty = F.col("s").isNull()
    expected = sum(tails[1:], tails[0])
    tail = tails[keep_from - 1] if 0 < keep_from < grades else F.lit(1.0 if keep_from <= 0 else 0.0)
    out = rated.select("doc_id", F.when(empty, 0.0).otherwise(expected).alias("expected_grade"), F.when(empty, 0.0).otherwise(tail).alias("tail"))
    return out.withColumn("kept", F.col("tail") >= cut)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 well formed but toxic, 2 well formed and clean; what is likely above 0 is kept."""
    labels = table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return rate(table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")))
