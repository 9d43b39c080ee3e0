"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is cut into overlapping windows of ``WINDOW`` words, ``STEP`` apart, which cover all of it.  Each word enters as a
learned vector of the word (one shared vector for words outside the vocabulary) and the mean of the learned vectors of its
byte trigrams and prefixes, which are hashed.  All of these are learned with the network.  The network scores every
window, and the text's score is that of its worst window, through a calibrated logistic link.

Fitting uses at most ``SAMPLE`` labelled texts of each label, a stated bound; labels are the only inputs besides texts.
The vocabulary holds at most ``VOCABULARY`` words of the sample.  A label belongs to a text, not to a window, so windows
are chosen: at first those with the most telling word (log odds, the text's own count taken out), then, for the second
round of fitting, those that the network itself scores highest, with further windows of clean texts beside them.  Two
fifths of the sample stay out of the fit; they calibrate the link.

One task on an executor fits the network on these windows, a bounded table, so the driver holds a model of 2 MB only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, gru
from .common import stored, table
from .words import pieces, raw, slices, words

WINDOW, STEP = 40, 30
SAMPLE = 5_000
#: Words of the vocabulary at most, and texts of the sample that a word must be in.
VOCABULARY, LEAST = 1 << 16, 3
#: Numbers a word vector and a piece vector have; slots of the pieces.
SIZE, PIECE_BITS = 8, 14
INPUTS = 2 * SIZE + 1
EPOCHS = 3
#: Fewest gradient steps of a round and windows in each, so that small tables are fitted too.
LEAST_STEPS, STEP_ROWS = 300, 128
RATE, WORD_DROP = 0.01, 0.3
#: Fifths of the sample that calibrate.
CALIBRATE = 1
CUT = 0.3
#: Windows scored and bytes of text read at once.
BATCH, SLICE = 2048, 1 << 20
_U = np.uint64
_SHIFT = _U(64 - PIECE_BITS)


def _numbers(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary (sorted ``keys``), from 1; 0 for words outside it."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at + 1, 0)


def _means(vectors: np.ndarray, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean vector of each word's pieces; ``at`` has the offsets of the words in ``slots``."""
    out = np.zeros((len(at) - 1, vectors.shape[1]), np.float32)
    size = np.diff(at)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(vectors[slots], at[:-1][some], axis=0) / size[some, None]
    return out


def inputs(net: dict, numbers: np.ndarray, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Input vectors of words, one row each, and a row of zeros behind them."""
    out = np.zeros((len(numbers) + 1, INPUTS), np.float32)
    out[:-1, :SIZE], out[:-1, SIZE:-1], out[:-1, -1] = net["words"][numbers], _means(net["pieces"], slots, at), 1
    return out


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and first word of every window, given the offsets of the texts in the words."""
    n = np.diff(at)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)), 0)
    owner = np.repeat(np.arange(len(n)), many)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return owner, at[:-1][owner] + turn * STEP


def _laid(at: np.ndarray, owner: np.ndarray, first: np.ndarray, row: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the words of windows (``pad`` beyond the text's end), and which places are words."""
    places = first[:, None] + np.arange(WINDOW)
    real = places < at[1:][owner][:, None]
    return np.where(real, row[np.minimum(places, max(0, len(row) - 1))], pad), real


def _unique(texts: pa.Array, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the row of each word among them, and their pieces with offsets."""
    unique, first, row = np.unique(hashes, return_index=True, return_inverse=True)
    parts, at = pieces(raw(texts)[0], starts[first], ends[first])
    return unique, row, (parts >> _SHIFT).astype(np.int64), at


def window_margins(texts: pa.Array, net: dict) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and score of every window."""
    hashes, starts, ends, at = words(texts, plain=True)
    owner, begin = windows(at)
    out = np.zeros(len(owner))
    if not len(hashes):
        return owner, out
    unique, row, slots, offsets = _unique(texts, hashes, starts, ends)
    vectors = inputs(net, _numbers(net["keys"], unique), slots, offsets)
    for i in range(0, len(owner), BATCH):
        part, b = owner[i : i + BATCH], begin[i : i + BATCH]
        out[i : i + BATCH] = gru.logits(net, vectors, *_laid(at, part, b, row, len(unique)))
    return owner, out


def text_margins(texts: pa.Array, net: dict) -> np.ndarray:
    """Largest window score of each text; minus infinity for texts without words."""
    out = np.full(len(texts), -np.inf, dtype=np.float64)
    np.maximum.at(out, *window_margins(texts, net))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to the distinct words of each text: (word, toxic)."""
    for batch in batches:
        for first, texts in slices(batch.column(0), SLICE):
            hashes, _, _, at = words(texts, plain=True)
            labels = batch.column(1).slice(first, len(texts)).to_numpy()
            own = [np.unique(hashes[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(labels, [len(x) for x in own]))], names=["word", "toxic"])


def _telling(counts: np.ndarray, texts: tuple[int, int], own: int) -> np.ndarray:
    """Log odds of words by texts (clean, toxic) they are in, one text of label ``own`` taken out; 0 if it was the only one."""
    left = counts.astype(np.float64)
    left[:, own] = np.maximum(0, left[:, own] - 1)
    odds = np.log((left[:, 1] + 0.5) / (texts[1] + 1)) - np.log((left[:, 0] + 0.5) / (texts[0] + 1))
    return np.where(left.sum(axis=1) > 0, odds, 0)


def _chosen(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Training windows (text, toxic) of rows (text, toxic): of each text the highest one, of clean ones two more."""
    net = model.value
    telling = [np.append(0, _telling(net["counts"], net["texts"], own)) for own in (0, 1)] if "counts" in net else []
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for row in range(batch.num_rows):
            texts, label = batch.column(0).slice(row, 1), batch.column(1)[row].as_py()
            hashes, starts, ends, at = words(texts, plain=True)
            if not len(hashes):
                continue
            _, begin = windows(at)
            last = max(0, len(hashes) - WINDOW)
            if telling:
                odds = telling[label][_numbers(net["keys"], hashes)]
                picks = {int(np.clip(odds.argmax() - WINDOW // 2, 0, last))}
                picks |= set() if label else {int(begin[0]), int(begin[len(begin) // 2])}
            else:
                best = begin[np.argsort(-window_margins(texts, net)[1], kind="stable")]
                picks = {int(b) for b in best[: 1 if label else 2]} | (set() if label else {int(begin[(7 * len(hashes)) % len(begin)])})
            data = raw(texts)[0]
            for b in sorted(picks):
                out[0].append(data[starts[b] : ends[min(b + WINDOW, len(hashes)) - 1]].tobytes().decode("utf-8", "replace"))
                out[1].append(label)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["text", "toxic"])


def _fit(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """All training windows in one task to one row, the fitted network."""
    rows = pa.Table.from_batches(list(batches))
    if rows.num_rows:
        net = fit(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy(), model.value)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])


def fit(texts: pa.Array, toxic: np.ndarray, net: dict, seed: int = 3) -> dict:
    """Adam on the mean log loss of windows, from a fresh network (``net`` with keys only) or on from a fitted one."""
    hashes, starts, ends, at = words(texts, plain=True)
    unique, row, slots, offsets = _unique(texts, hashes, starts, ends)
    some = np.flatnonzero(np.diff(at))
    places, real = _laid(at, some, at[:-1][some], row, -1)
    y, keys = toxic[some].astype(np.float32), net["keys"]
    rng = np.random.Generator(np.random.PCG64(seed))
    if "words" in net:
        p = {k: v.copy() for k, v in net.items() if k != "keys"}
    else:
        p = gru.start(INPUTS) | {"words": (0.3 * rng.standard_normal((len(keys) + 1, SIZE))).astype(np.float32), "pieces": (0.3 * rng.standard_normal((1 << PIECE_BITS, SIZE))).astype(np.float32)}
        p["words"][0] = 0
    numbers = _numbers(keys, unique)
    one, two = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    steps = max(EPOCHS * -(-len(y) // STEP_ROWS), LEAST_STEPS)
    order, turn = np.zeros(0, np.int64), 0
    for step in range(1, steps + 1):
        if turn + STEP_ROWS > len(order):
            order, turn = np.concatenate([order[turn:], *[rng.permutation(len(y)) for _ in range(1 + STEP_ROWS // max(1, len(y)))]]), 0
        rows = order[turn : turn + STEP_ROWS]
        turn += STEP_ROWS
        used, local = np.unique(places[rows], return_inverse=True)
        pad = used[0] < 0
        mine = used[1:] if pad else used
        local = local.reshape(len(rows), WINDOW) - int(pad)
        local[local < 0] = len(mine)
        many = np.diff(offsets)[mine]
        begin = np.concatenate([[0], np.cumsum(many)])
        own = slots[np.repeat(offsets[:-1][mine] - begin[:-1], many) + np.arange(begin[-1])]
        number = np.where(rng.random(len(mine)) < WORD_DROP, 0, numbers[mine])
        _, g, inner = gru.gradients(p, inputs(p, number, own, begin), local, real[rows], y[rows])
        inner = inner[:-1]
        share = np.repeat(inner[:, SIZE:-1] / np.maximum(1, many)[:, None], many, axis=0)
        for name, ids, part in (("words", number, inner[:, :SIZE]), ("pieces", own, share)):
            hit, where = np.unique(ids, return_inverse=True)
            total = gru.row_sums(where, part, len(hit))
            if name == "words":
                hit, total = hit[hit > 0], total[hit > 0]
            two[name][hit] = 0.99 * two[name][hit] + 0.01 * total**2
            one[name][hit] = 0.9 * one[name][hit] + 0.1 * total
            p[name][hit] -= RATE * one[name][hit] / (np.sqrt(two[name][hit]) + 1e-5)
        for k, value in g.items():
            one[k] = 0.9 * one[k] + 0.1 * value
            two[k] = 0.99 * two[k] + 0.01 * value**2
            p[k] = (p[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p | {"keys": keys}


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Rows (first column, text) to (first column, margin)."""
    net = model.value
    for batch in batches:
        for first, texts in slices(batch.column(1), SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(text_margins(texts, net))], names=[batch.schema.names[0], "margin"])


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on labelled texts; returns the broadcast model, and slope and offset of the link."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("long").alias("toxic"))
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64(F.col("_id"), F.lit(17))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == y).orderBy(mixed, "_id").limit(sample) for y in (0, 1)]
    part = F.pmod(F.xxhash64(F.col("_id"), F.lit(29)), F.lit(5)) < CALIBRATE
    ids = picked[0].union(picked[1]).select("_id", "toxic", part.alias("_spare"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most 2 * sample ids of 8 bytes are broadcast
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id", "toxic", "_spare").agg(F.min("text").alias("text"))
    rows = stored(rows.repartition(12), "sample")
    fit_rows = rows.where("not _spare").select("text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in fit_rows.groupBy("toxic").count().collect()}
    counts = fit_rows.mapInArrow(_features, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("whole"))
    counts = counts.where(f"whole >= {LEAST}").orderBy(F.desc("whole"), "word").limit(VOCABULARY).toArrow()
    keys, bad, whole = (counts.column(c).to_numpy() for c in ("word", "bad", "whole"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    net = {"keys": keys[order], "counts": np.stack([(whole - bad)[order], bad[order]], axis=1).astype(np.int32), "texts": (sizes.get(0, 0), sizes.get(1, 0))}
    for _ in range(2):
        # in a fixed order, so that reruns fit the same network
        chooser = spark.sparkContext.broadcast(net)
        chosen = fit_rows.mapInArrow(partial(_chosen, model=chooser), "text string, toxic long")
        start = chooser if "words" in net else spark.sparkContext.broadcast({"keys": net["keys"]})
        made = chosen.repartition(1).sortWithinPartitions("toxic", "text").mapInArrow(partial(_fit, model=start), "net binary").collect()
        if start is not chooser:
            start.destroy()
        chooser.destroy()
        net = pickle.loads(bytes(made[0][0])) if made else gru.start(INPUTS) | {"keys": net["keys"], "words": np.zeros((len(net["keys"]) + 1, SIZE), np.float32), "pieces": np.zeros((1 << PIECE_BITS, SIZE), np.float32)}
    model = spark.sparkContext.broadcast(net)
    scored = rows.where("_spare").select("toxic", "text").mapInArrow(partial(_score, model=model), "toxic long, margin double").toArrow()
    margin, y = scored.column("margin").to_numpy(), scored.column("toxic").to_numpy().astype(float)
    fine = np.isfinite(margin)
    if len(set(y[fine])) < 2:
        return model, 0.05, -3.0
    slope, offset = boosting.calibrate(np.clip(margin[fine], -12, 12), y[fine])
    # the sample holds the labels in other shares than the table does
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    offset += float(np.log(max(1, totals.get(1, 0)) / max(1, totals.get(0, 0))) - np.log(have[1] / have[0]))
    return model, max(0.05, slope), offset


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null, empty and wordless texts score 0; texts of any length are scored whole.  Without labels of both kinds the
    scores say nothing and stay below the cut.  A null doc_id is not held out.  Repeated rows are scored each, and equal
    texts alike; a doc_id labelled twice counts as toxic if one label says so.  Other columns, whatever their names, are
    not looked at.  An empty table gives an empty result.
    """
    model, slope, offset = trained(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(partial(_score, model=model), "doc_id long, margin double")
    link = 1 / (1 + F.exp(-(F.lit(slope) * F.greatest(F.lit(-12.0), F.least(F.lit(12.0), "margin")) + F.lit(offset))))
    value = F.when(F.col("margin") > float("-inf"), link).otherwise(0.0)
    return out.select("doc_id", held_out().alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op9_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; all columns of the others stay, null and empty texts too."""
    model, slope, offset = trained(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    return docs.mapInArrow(partial(_keep, model=model, slope=slope, offset=offset, text=columns.index("text")), docs.schema)


def _keep(batches: Iterator[pa.RecordBatch], model, slope: float, offset: float, text: int) -> Iterator[pa.RecordBatch]:
    net = model.value
    for batch in batches:
        for first, texts in slices(batch.column(text), SLICE):
            margins = np.clip(text_margins(texts, net), -1e9, 12)
            value = np.where(margins > -1e9, 1 / (1 + np.exp(-(slope * np.maximum(-12, margins) + offset))), 0)
            yield batch.slice(first, len(texts)).filter(pa.array(value < CUT))
