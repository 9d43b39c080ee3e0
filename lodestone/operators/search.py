"""Faceted search over extracted items, with paging and uncapped exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

EXPORT = ("notice_id", "item_no", "product_service_name", "category_name", "category_code", "brand_supplier", "spec_model", "unit_price", "quantity", "quantity_unit", "total_price", "source_file")


def search_text(*columns: str) -> Column:
    """F-04: fields joined by one space each, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def category_facet() -> Column:
    """F-02: a null name makes the whole facet empty."""
    return F.coalesce(F.concat(F.col("category_name"), F.lit(" "), F.coalesce("category_code", F.lit(""))), F.lit(""))


def where(rows: DataFrame, q: str = "", notice_id: str = "", product: str = "", brand: str = "", category: str = "", source_file: str = "") -> DataFrame:
    """F-01, F-03: every facet that is given must match."""
    facets = [("search_text", q), ("notice_id", notice_id), ("product_service_name", product), ("brand_supplier", brand), (None, category), ("source_file", source_file)]
    tests = [X.ascii_like(category_facet() if column is None else F.col(column).cast("string"), value) for column, value in facets if value]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def page(rows: DataFrame, number: int = 1, size: int = 20, **facets: str) -> tuple[DataFrame, DataFrame]:
    """K-01: one page by notice and item, and the total as a one-row table."""
    number, size = max(1, number), max(1, min(size, 100))
    found = where(rows, **facets)
    return found.orderBy("notice_id", "item_no").offset((number - 1) * size).limit(size), found.agg(F.count("*").alias("total"))


def export(rows: DataFrame, **facets: str) -> DataFrame:
    """K-02: the same rows as a search, all of them, the source facet included."""
    found = where(rows, **facets)
    return found.select(*[c for c in EXPORT if c in found.columns]).orderBy("notice_id", "item_no")


def entity_counts(rows: DataFrame) -> DataFrame:
    """A-10."""
    return rows.agg(F.count("*").alias("entities"), F.countDistinct("notice_id").alias("notices"))


def entity(rows: DataFrame, entity_id) -> DataFrame:
    """F-07: one item; nothing for an unknown id."""
    return rows.where(F.col("entity_id") == entity_id).drop("raw_json", "search_text").limit(1)


def imported(notices: DataFrame) -> DataFrame:
    """SNK-05: item rows of notices (notice_id, title, items array<struct>): numbered, with ids and search text."""
    items = notices.where("notice_id is not null and notice_id <> ''").select("notice_id", F.coalesce("title", "notice_id").alias("title"), F.posexplode("items").alias("_i", "v")).select("notice_id", "title", "_i", "v.*")
    number = F.coalesce(F.col("item_no"), F.col("_i") + 1).cast("int") if "item_no" in items.columns else (F.col("_i") + 1).cast("int")
    out = items.withColumn("item_no", number).drop("_i")
    out = out.withColumn("entity_id", X.stable_id("ent", F.col("notice_id"), F.col("item_no"), F.col("source_block_id"), F.col("source_block_row")))
    return out.withColumn("search_text", search_text("title", "product_service_name", "category_name", "category_code", "brand_supplier", "spec_model", "source_file"))


def latest_jobs(updates: DataFrame) -> DataFrame:
    """M-06: state of each job: for each writable column the last value that an update gave."""
    fields = [c for c in ("status", "stage", "progress", "success_count", "failure_count", "message", "errors_json") if c in updates.columns]
    return updates.groupBy("job_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields], F.max("seq").alias("updated_seq"))


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """K-08."""
    return jobs.orderBy(F.desc("updated_seq"), "job_id").limit(limit)


def upload_problems(files: DataFrame, suffixes: tuple[str, ...], one: int = 200 << 20, whole: int = 500 << 20) -> DataFrame:
    """F-21: why a file of an upload is refused, null if it is not; the running total counts files in order."""
    total = F.sum("size").over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    reason = F.when(~suffix.isin(*suffixes), "suffix").when(F.col("size") <= 0, "empty").when(F.col("size") > one, "too large").when(total > whole, "job too large")
    return files.withColumn("reason", reason)


def pick(options: DataFrame, needle: str) -> DataFrame:
    """F-22: options whose label, hint or value holds the needle."""
    whole = F.lower(F.concat_ws(" ", "label", "hint", "value"))
    return options.where(whole.contains(needle.lower()))
