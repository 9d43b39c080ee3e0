"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a run of words, wherever lines end: for a template of m words, every run of ``ceil(m / threshold)`` words that
begins with one of the template vocabulary.  Both sides are sets of words ordered by the number of texts they are in,
rarest first.  A block contains a template to the threshold only if it

* shares one of the template's first ``|T| - need + 1`` words (prefix filter),
* holds ``need`` words of the vocabulary at least (length filter), and
* can still reach ``need`` from the place of the shared word in both orders (positional filter);

the few pairs left are intersected in full.  Words outside the template vocabulary cannot count, so blocks are reduced to
it; the vocabulary is fixed and small, whatever the corpus.  Texts that have too few words of every template as a whole
leave no words behind in the one pass over the texts.

Beside it, phrases are counted where their words stand consecutively.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates with their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.9

#: Words are of what is outside this class; upper-case letters are lower-cased or matched without regard to case.
_BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def n_words(text: Column) -> Column:
    """Number of words: one letter is left for each, trailing breaks go, and letters are counted."""
    marks = F.regexp_replace(text, rf"[{_BREAK}]*+[^{_BREAK}]++", "a")
    return F.length(F.regexp_replace(marks, rf"[{_BREAK}]++", "")).cast("long")


def _phrase(words: str) -> str:
    return rf"[{_BREAK}]++".join(words.split())


def _within(pattern: str) -> str:
    return rf"(?i)(?<![^{_BREAK}])(?:{pattern})(?![^{_BREAK}])"


def lower_ascii(text: Column) -> Column:
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, upper, upper.lower())


def needs(templates: dict[str, str], threshold: float) -> dict[str, tuple[int, int]]:
    """Distinct words of each template that a block must hold, and words of its blocks."""
    part = round(threshold * 1000)
    return {name: (-(-part * len(set(t.split())) // 1000), -(-1000 * len(t.split()) // part)) for name, t in templates.items()}


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty: no words, no places, null first and last word, empty labels, score 0.  ``score`` is 1 with
    a phrase, else the best containment found, else 0.  Texts of any length are scanned whole.  Repeated rows are scanned
    each.  Other columns, whatever their names, are not looked at.  An empty table gives an empty result.
    """
    sets_of = {name: sorted(set(t.split())) for name, t in templates.items()}
    vocabulary, need = sorted({w for t in sets_of.values() for w in t}), needs(templates, threshold)
    strings = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    anywhere = _within("|".join(_phrase(p) for p in phrases))
    rest = F.split("_text", anywhere, -1)
    first, tail = F.element_at(rest, 1), F.element_at(rest, -1)
    size_of = F.element_at(F.regexp_extract_all("_text", F.lit(anywhere), F.lit(0)), -1)
    rows = docs.select(F.col("doc_id"), text.alias("_text")).withColumn("_hit", F.col("_text").rlike(anywhere))
    rows = rows.withColumn("_words", F.split(lower_ascii(F.col("_text")), rf"[{_BREAK}]++"))
    rows = rows.withColumn("_own", F.array_intersect("_words", strings(vocabulary)))
    enough = F.lit(False)
    for name, own in sets_of.items():
        enough = enough | (F.size(F.array_intersect("_own", strings(own))) >= need[name][0])
    rows = rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("_row"),
        # breaks at the ends leave an empty word there
        (F.size("_words") - (F.element_at("_words", 1) == "").cast("int") - ((F.size("_words") > 1) & (F.element_at("_words", -1) == "")).cast("int")).cast("long").alias("n_words"),
        F.when(F.col("_hit"), F.size(rest) - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("_hit"), n_words(first)).alias("first_word"),
        F.when(F.col("_hit"), n_words(tail) + n_words(size_of)).alias("_behind"),
        F.when(F.col("_hit"), F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col("_text").rlike(_within(_phrase(p))), F.lit(name)) for p, name in phrases.items()]), lambda x: x.isNotNull()))))
        .otherwise(F.array().cast("array<string>"))
        .alias("_base"),
        "_own",
        F.when(enough, F.col("_words")).alias("_words"),
    )
    base = stored(rows, "texts")
    # texts that each vocabulary word is in; as many rows as the vocabulary has
    seen = base.select(F.explode("_own").alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in seen.collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    order = F.create_map(*chain.from_iterable((F.lit(w), F.lit(i)) for w, i in rank.items()))
    sets = {name: sorted(rank[w] for w in own) for name, own in sets_of.items()}
    prefixes = [(x, i, name) for name, own in sets.items() for i, x in enumerate(own[: len(own) - need[name][0] + 1])]

    spots = base.where("_words is not null").select("_row", F.posexplode("_words").alias("_at", "_w")).select("_row", "_at", order[F.col("_w")].alias("_item")).where("_item is not null")
    sizes = sorted({w for _, w in need.values()})
    ahead = Window.partitionBy("_row").orderBy("_at")
    blocks = spots.select("_row", "_at", *[F.collect_set("_item").over(ahead.rangeBetween(0, w - 1)).alias(f"_{w}") for w in sizes])
    each = [F.struct(F.lit(w).alias("_size"), F.array_sort(f"_{w}").alias("_items")) for w in sizes]
    blocks = blocks.select("_row", "_at", F.explode(F.array(*each)).alias("_b")).select("_row", "_at", "_b.*")
    least = F.create_map(*chain.from_iterable((F.lit(w), F.lit(min(n for n, size in need.values() if size == w))) for w in sizes))
    blocks = blocks.where(F.size("_items") >= least[F.col("_size")])
    spark = docs.sparkSession
    cells = ", ".join(f"({x}, {i}, {need[name][1]}, '{name}', {need[name][0]}, array({', '.join(map(str, sets[name]))}))" for x, i, name in prefixes)
    prefix = spark.sql(f"SELECT * FROM VALUES {cells} AS t(_item, _i, _size, template, _need, _theirs)")
    placed = blocks.where(F.exists("_items", lambda x: x.isin([x for x, _, _ in prefixes]))).select("_row", "_at", "_size", "_items", F.posexplode("_items").alias("_j", "_item"))
    able = placed.join(F.broadcast(prefix), ["_item", "_size"]).where("1 + least(size(_theirs) - 1 - _i, size(_items) - 1 - _j) >= _need")
    shared = able.withColumn("_both", F.size(F.array_intersect("_items", "_theirs"))).where("_both >= _need")
    found = shared.groupBy("_row").agg(F.collect_set("template").alias("_found"), F.max(F.col("_both") / F.size("_theirs")).alias("_best"))
    out = base.drop("_words", "_own").join(found, "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        (F.col("n_words") - F.col("_behind")).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same result for DuckDB, by brute force over all blocks and templates."""
    brk = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    per = " UNION ALL ".join(
        f"SELECT rid, '{name}' AS label, i FROM w, unnest(generate_series(1, len(w.ws) - {len(p.split()) - 1})) t(i) WHERE "
        + " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, name in PHRASES.items()
    )
    need = needs(TEMPLATES, THRESHOLD)
    cells = ", ".join(f"('{name}', {need[name][0]}, {need[name][1]}, [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for name, t in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{brk}'), lambda x: x <> '') AS ws FROM d),
p AS ({per}),
b AS (SELECT rid, count(*)::BIGINT AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY rid),
tt(name, need, size, words) AS (VALUES {cells}),
k AS (SELECT rid, name, need, words, list_slice(ws, i, i + size - 1) AS block FROM w, tt, unnest(generate_series(1, len(ws))) s(i) WHERE list_contains(words, ws[i])),
m AS (SELECT rid, name, len(list_intersect(list_distinct(block), words)) / len(words) AS part FROM k WHERE len(list_intersect(list_distinct(block), words)) >= need),
f AS (SELECT rid, list(name) AS names, max(part) AS best FROM m GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(names, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d JOIN w USING (rid) LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


ORACLE = _oracle()
