"""MinHash near-dedup: universal hash minima, banding, signature verification, exact check, components.

``near_duplicates`` finds documents whose sets of word shingles have a Jaccard similarity of ``threshold`` or more and
returns one row per document with its component.  Steps:

1. One pass turns each text into its distinct shingle hashes and keeps ``bands * rows`` minima of universal hashes
   ``a * x + b mod 2**64``, as one 64-bit key per band and one byte per minimum, with a 128-bit digest of the set.
2. Texts of equal sets form a class; only its smallest doc_id goes on.
3. In each bucket (band and key) every member is tied to the smallest one: no pairs within a bucket, rows grow with the
   bucket.  A hot bucket is pre-aggregated to its smallest member and joined back (a join that AQE splits).
4. Candidates whose signatures agree too little are dropped (six standard deviations below what the threshold lets
   expect: a true pair is lost with probability 1e-9), the rest are compared on their full sets, computed from the whole
   texts.
5. Components by large-star and small-star.  Members of buckets that still hold several components are then joined
   across components on the rarest shingles of their sets, with prefix, length and positional filters (all exact), so a
   pair that shares a bucket is left uncompared only if it is connected already or cannot reach the threshold.  Any
   order of shingles keeps those filters exact; a table of ``SLOTS`` bytes, of fixed size, orders them by frequency.

A pair at exactly the threshold shares no bucket with probability (1 - t**rows)**bands: 3e-6 for the defaults at 0.8.
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

from .common import flagged, give_back, only_ids, stored, table, whole_groups
from .components import components
from .words import mix, shingles, slices, words

BANDS, ROWS = 32, 5
#: Shingles hashed at once.
BLOCK = 2048
#: Entries of the frequency table that orders shingles, one byte each, whatever the input; entries of one row of it.
SLOT_BITS = 21
SLOTS, LEVELS = 1 << SLOT_BITS, 1 << 15
_U = np.uint64


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(97))
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(values), BLOCK):
        hashed = np.multiply.outer(a, values[at : at + BLOCK])
        hashed += b[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least >> _U(16)


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
)


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    a, b = _functions(bands * rows)
    weights = _functions(rows)[0]
    salt = np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for batch in batches:
        for first, texts in slices(batch.column(1)):
            hashes, _, _, at = words(texts)
            n, digests, keys, sigs = [], [], [], []
            for i in range(len(texts)):
                own = shingles(hashes[at[i] : at[i + 1]], k)
                n.append(len(own))
                if not len(own):
                    digests.append(None), keys.append(None), sigs.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                least = minima(own, a, b)
                keys.append(mix((least.reshape(bands, rows) * weights).sum(axis=1, dtype=_U) + salt).view(np.int64))
                sigs.append((least & _U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                schema=_SIGNED,
            )


def _agree(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree in ``least`` places or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
        good = pa.array((one == two).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) with 100 * intersection >= percent * union on the full shingle sets."""
    text, sets = None, None
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        left, right = batch.column(2), batch.column(3)
        for first, texts in slices(right):
            hashes, _, _, at = words(texts)
            for i in range(len(texts)):
                row = first + i
                if text is None or not text.equals(left.slice(row, 1)):
                    text = left.slice(row, 1)
                    sets = shingles(words(text)[0], k)
                own = shingles(hashes[at[i] : at[i + 1]], k)
                both = len(np.intersect1d(sets, own, assume_unique=True))
                good[row] = both > 0 and 100 * both >= percent * (len(sets) + len(own) - both)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (rep, part, text) to (rep, part, n, items): the distinct shingle hashes as bytes."""
    for batch in batches:
        for first, texts in slices(batch.column(2)):
            hashes, _, _, at = words(texts)
            own = [shingles(hashes[at[i] : at[i + 1]], k) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())],
                names=["rep", "part", "n", "items"],
            )


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = np.frombuffer(b"".join(batch.column("items").to_pylist()), dtype=_U)
        slot, many = np.unique(items >> _U(64 - SLOT_BITS), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(many.astype(np.int64))], names=["slot", "many"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, slot, many) sorted by block to one row a block: a byte for each of its slots, 0 for slots with one
    set at most, else rising with the number of sets (eight steps to its doubling)."""
    for rows in whole_groups(batches, ["block"]):
        block, slot, many = (rows.column(c).to_numpy() for c in ("block", "slot", "many"))
        for one in np.unique(block):
            own = block == one
            level = np.zeros(LEVELS, np.uint8)
            level[slot[own] % LEVELS] = np.where(many[own] > 1, np.minimum(255, 1 + 8 * np.log2(np.maximum(1, many[own]))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([int(one)]), pa.array([level.tobytes()], pa.binary())], names=["block", "data"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts, percent: int) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set, by place: those that a set within the threshold must share one of."""
    table = counts.value
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for rep, part, n, items in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(items, dtype=_U)
            many = table[own >> _U(64 - SLOT_BITS)]
            order = np.lexsort((own, many))[: n - -(-percent * n // 100) + 1]
            place = np.flatnonzero(many[order] > 0)
            for column, value in zip(out, (own[order][place].view(np.int64), place, n, rep, part)):
                column.append(np.broadcast_to(value, place.shape).astype(np.int64))
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "place", "n", "rep", "part"])


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, items_a, items_b) with 100 * intersection >= percent * union."""
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            one, two = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (x, y))
            both = len(np.intersect1d(one, two, assume_unique=True))
            good[i] = 100 * both >= percent * (len(one) + len(two) - both)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])


def _across(left: DataFrame, texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different parts of ``left`` (rep, part), but for ``pairs`` that were compared before."""
    spark = left.sparkSession
    own = only_ids(texts, "doc_id", left.select("rep")).join(left, F.col("doc_id") == F.col("rep")).select("rep", "part", "text")
    sets = stored(own.mapInArrow(partial(_sets, k=k), "rep long, part long, n long, items binary"), "sets")
    slots = sets.select("items").mapInArrow(_slot_counts, "slot long, many long").groupBy("slot").agg(F.sum("many").alias("many"))
    blocks = slots.select(F.floor(F.col("slot") / LEVELS).alias("block"), "slot", "many").repartition("block").sortWithinPartitions("block")
    table = np.zeros(SLOTS, np.uint8)
    for row in blocks.mapInArrow(_levels, "block long, data binary").collect():
        table[row["block"] * LEVELS :][:LEVELS] = np.frombuffer(bytes(row["data"]), np.uint8)
    shared = spark.sparkContext.broadcast(table)
    give_back()
    rare = stored(sets.select("rep", "part", "n", "items").mapInArrow(partial(_prefixes, counts=shared, percent=percent), "item long, place long, n long, rep long, part long"), "rare")
    other = rare.toDF("item", "_place", "_n", "_rep", "_part")
    able = f"rep < _rep and part <> _part and least(n - place, _n - _place) * {100 + percent} >= {percent} * (n + _n)"
    found = rare.join(other, "item").where(able).select(F.col("rep").alias("a"), F.col("_rep").alias("b")).distinct()
    found = found.join(pairs, ["a", "b"], "left_anti")
    full = found.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("_y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("_x")), "a")
    return full.select("a", "b", "_x", "_y").mapInArrow(partial(_meet, percent=percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null or wordless texts have no shingles and link with nothing; a text of fewer than ``k`` words is one shingle;
    a null doc_id links with nothing and is kept.  Texts of any length are compared whole; equal sets link whatever their
    texts.  Repeated rows stay; rows of one doc_id share their component, of which the smallest doc_id is the head.  Other
    columns, whatever their names, are not looked at.  An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(
        own.mapInArrow(partial(_sign, k=k, bands=bands, rows=rows), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"),
        "signed",
    )
    usable = signed.where("digest is not null and doc_id is not null")
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "classes")
    copies = stored(usable.select("digest", "doc_id").join(classes, "digest").select("doc_id", "rep").distinct(), "copies")
    # rows of classes of one go on as they are; of the others, which a small bitmap points out, the first row does
    marked = flagged(usable.select("doc_id", "digest", "bands", "sig"), "doc_id", copies.select("doc_id"))
    rest = marked.where("_maybe").join(classes, "digest", "left").where("rep is null or rep = doc_id").dropDuplicates(["digest"])
    heads = marked.where("not _maybe").union(rest.select(marked.columns)).select(F.col("doc_id").alias("rep"), "bands", "sig")
    placed = heads.select("rep", F.explode("bands").alias("key"))
    stars = placed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("_most")).where("a <> _most").drop("_most")
    pairs = stored(placed.join(stored(stars, "bucket-heads"), "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")

    count = bands * rows
    t = percent / 100
    least = max(1, math.floor(count * (t - 6 * math.sqrt(t * (1 - t) / count))))
    sigs = heads.select("rep", "sig")

    def check(candidates: DataFrame) -> DataFrame:
        """Candidates (a, b) that hold on signatures, then on full sets."""
        signs = candidates.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("_x")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("_y")), "b")
        near = stored(signs.select("a", "b", "_x", "_y").mapInArrow(partial(_agree, least=least), "a long, b long").distinct(), "candidates")
        ids = near.select("a").union(near.select("b")).distinct()
        texts = only_ids(own.where("doc_id is not null"), "doc_id", ids)
        full = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb")), "b").join(
            texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta")), "a"
        )
        return full.select("a", "b", "_ta", "_tb").mapInArrow(partial(_compare, k=k, percent=percent), "a long, b long")

    # where one doc_id has several texts, their classes belong together
    members = usable.select("digest", "doc_id").join(classes, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    spread = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_most"))
    alike = spread.where("a <> doc_id or _most <> doc_id").select(F.col("doc_id").alias("a"), F.explode(F.array("a", "_most")).alias("b")).where("a <> b")
    links = stored(check(pairs).union(alike), "near")
    parts = stored(components(links), "parts")
    where = placed.join(parts, placed.rep == parts.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    mixed = where.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low <> _high").select("key")
    left = stored(where.join(stored(mixed, "mixed-buckets"), "key", "left_semi").select("rep", "part").distinct(), "mixed")
    more = stored(_across(left, own.where("doc_id is not null"), pairs, k, percent), "more")
    if more.limit(1).count():
        parts = stored(components(links.union(more)), "parts")
    found = members.join(parts, members.rep == parts.node, "left").select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("_component"))
    found = found.groupBy("_id").agg(F.min("_component").alias("_component"))
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id, with all its columns, whatever
    their names; null, empty and wordless texts and rows without a doc_id stay, of rows with one doc_id one stays."""
    marks = near_duplicates(docs).where("kept").select("doc_id").distinct()
    kept = docs.join(marks.where("doc_id is not null"), "doc_id", "left_semi")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    if twice.limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


#: The same result by brute force over all pairs of documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS low FROM s UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node AND r.low < e.b),
c AS (SELECT node, min(low) AS low FROM r GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept FROM s JOIN c ON node = doc_id
"""
