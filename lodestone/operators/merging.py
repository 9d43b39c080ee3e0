"""Merge of a notice's items: order-dependent, so rows are sorted by notice and one pass over a partition merges each.

Groups are bounded by the requests of a notice.  The two steps that are plain windows (exclusion and source priority)
run before, as columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from . import flow, policy

NUMBERS, TEXTS = ("unit_price", "quantity", "total_price"), ("brand_supplier", "spec_model", "quantity_unit")
SCHEMA = (
    "notice_id string, item_no int, product_service_name string, category_name string, category_code string, brand_supplier string, spec_model string, "
    "unit_price double, quantity double, quantity_unit string, total_price double, refs array<string>, request_ids array<string>, confidence double, tier int, conflicts array<string>, merged int"
)


def exact_merge(items: DataFrame) -> DataFrame:
    """E-08, first rule: items equal in all nine fields are one, with all references in order of appearance."""
    keys = [X.value_key(F.col(c), c in L.NUMERIC_FIELDS).alias(f"_k_{c}") for c in L.ENTITY_FIELDS]
    names = [f"_k_{c}" for c in L.ENTITY_FIELDS]
    first = F.min_by(F.struct(*L.ENTITY_FIELDS), "pos")
    return items.select("*", *keys).groupBy("notice_id", *names).agg(first.alias("_v"), F.min("pos").alias("pos"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "refs"))), lambda x: x["refs"]))).alias("refs")).select("notice_id", "pos", "_v.*", "refs")


def prioritized(items: DataFrame) -> DataFrame:
    """E-09 steps 1 and 2, A-14: items that are no award go, then those of weak sources whose product a strong source has."""
    plain = {f"_c_{c}": X.compact_nfkc(F.col(c)) for c in ("product_service_name", "brand_supplier", "spec_model", "quantity_unit")}
    rows = flow.settled(items.withColumns(plain))
    reason = policy.compact_item_non_result(F.col("tier"), *[F.col(c) for c in plain])
    name = X.canonical_compact(F.col("_c_product_service_name"))
    rows = flow.settled(rows.withColumns({"_reason": reason, "_name": name}).drop(*plain)).where("_reason is null").drop("_reason")
    best = F.max("tier").over(Window.partitionBy("notice_id", "_name"))
    return rows.withColumn("_best", best).where("not (tier <= 1 and _best >= 3)").drop("_best")


def _key(value) -> str:
    if value is None or isinstance(value, float) and value != value:
        return ""
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}".rstrip("0").rstrip(".")
    return "".join(str(value).lower().replace("（", "(").replace("）", ")").split())


def _known(value) -> bool:
    return value is not None and not (isinstance(value, float) and value != value)


def compatible(one: dict, two: dict) -> bool:
    """E-10: one product, no number against another, and no text against another unless two numbers agree."""
    if one["_name"] != two["_name"]:
        return False
    agree = 0
    for field in NUMBERS:
        if _known(one[field]) and _known(two[field]):
            if _key(one[field]) != _key(two[field]):
                return False
            agree += 1
    return agree >= 2 or all(not (_known(one[f]) and _known(two[f])) or _key(one[f]) == _key(two[f]) for f in TEXTS)


def _quality(item: dict) -> tuple:
    return int(item["tier"]), sum(_known(item[f]) for f in L.ENTITY_FIELDS), float(item["confidence"] if _known(item["confidence"]) else 0)


def _absorb(kept: dict, other: dict, fields: bool = True) -> dict:
    out = dict(kept)
    for name in ("refs", "request_ids"):
        out[name] = list(dict.fromkeys([*kept[name], *other[name]]))
    if fields:
        for f in L.ENTITY_FIELDS:
            if not _known(out[f]) and _known(other[f]):
                out[f] = other[f]
    return out


def _merge(items: list[dict]) -> list[dict]:
    """The final items of one notice, whose items come in order."""
    title = items[0]["_title"] or ""
    for item in items:
        item |= {"refs": list(item["refs"]), "request_ids": [item["request_id"]], "conflicts": []}
    # same fields, then same evidence
    merged: list[dict] = []
    by_fields: dict[tuple, int] = {}
    by_evidence: dict[tuple, int] = {}
    for item in items:
        fields, evidence = tuple(_key(item[f]) for f in L.ENTITY_FIELDS), tuple(sorted(item["refs"]))
        if fields in by_fields:
            at = by_fields[fields]
            merged[at] = _absorb(merged[at], item, fields=False)
        elif evidence and evidence in by_evidence:
            at = by_evidence[evidence]
            old = merged[at]
            clash = [f"{f}:{_key(old[f])}|{_key(item[f])}" for f in L.ENTITY_FIELDS if _known(old[f]) and _known(item[f]) and _key(old[f]) != _key(item[f])]
            merged[at] = _absorb(old, item) | {"conflicts": list(dict.fromkeys([*old["conflicts"], *clash]))}
            by_fields[tuple(_key(merged[at][f]) for f in L.ENTITY_FIELDS)] = at
        else:
            by_fields[fields] = len(merged)
            if evidence:
                by_evidence[evidence] = len(merged)
            merged.append(item)
    # first compatible item of what is kept so far
    kept: list[dict] = []
    joined = 0
    for item in merged:
        at = next((i for i, old in enumerate(kept) if compatible(old, item)), None)
        if at is None:
            kept.append(item)
            continue
        joined += 1
        better, worse = (item, kept[at]) if _quality(item) > _quality(kept[at]) else (kept[at], item)
        kept[at] = _absorb(better, worse)
    detailed = sum(any(_known(x[f]) for f in ("brand_supplier", "spec_model", "unit_price", "quantity")) for x in kept)

    def generic(item: dict) -> bool:
        name = item["_name"]
        return len(name) >= 8 and bool(title) and (name in title or title in name) and not any(_known(item[f]) for f in ("brand_supplier", "spec_model", "unit_price"))

    final = [x for x in kept if not (detailed >= 2 and generic(x))]
    return [x | {"item_no": i, "merged": joined} for i, x in enumerate(final, 1)]


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
_COLUMNS = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final items of the notices of a partition that is sorted by notice and position."""
    out: list[dict] = []
    for _, items in groupby((item for batch in batches for item in batch.to_pylist()), key=lambda item: item["notice_id"]):
        out += _merge(list(items))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, _COLUMNS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _COLUMNS)


def merge_notices(items: DataFrame, titles: DataFrame) -> DataFrame:
    """E-08, E-09, E-11, W-01: final items of each notice, numbered.

    ``items``: notice_id, pos, the nine fields, refs array<string>, request_id, confidence, tier; ``titles``: notice_id,
    title.
    """
    rows = prioritized(items).join(titles.select("notice_id", X.canonical_product_name(F.col("title")).alias("_title")), "notice_id", "left")
    rows = rows.withColumns({c: F.col(c).cast("double") for c in NUMBERS})
    return rows.repartition("notice_id").sortWithinPartitions("notice_id", "pos").mapInArrow(_merged, SCHEMA)


def notice_rollup(outcomes: DataFrame) -> DataFrame:
    """A-13, A-11: requests, what is open and what failed, and counts by status of each notice."""
    return outcomes.groupBy("notice_id").agg(
        F.count("*").alias("request_count"),
        F.sum((F.col("status") == "needs_model").cast("long")).alias("needs_model"),
        F.sum((F.col("status") == "failed").cast("long")).alias("failed"),
    ).withColumn("status", F.when((F.col("needs_model") > 0) | (F.col("failed") > 0), "partial").otherwise("complete"))
