"""Readers: files and stored pages to block tables, JSON logs, manifests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import formats

BLOCKS = "notice_id string, pos int, type string, text string, rows array<array<string>>, place string, path string, file_type string"


def _blocks(frames: Iterator[pd.DataFrame], adapters: formats.Adapters | None) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for frame in frames:
        out = []
        for key, name, data in zip(frame["notice_id"], frame["name"], frame["content"]):
            if data is None:
                continue
            found = formats.parse(name, data.encode() if isinstance(data, str) else bytes(data), adapters=adapters)
            out += [b | {"notice_id": key, "pos": i} for i, b in enumerate(found)]
        yield pd.DataFrame(out, columns=names)


def parsed(files: DataFrame, adapters: formats.Adapters | None = None) -> DataFrame:
    """SRC-02 to SRC-18, P-06: blocks of files (notice_id, name, content binary or text).

    ``adapters`` travel to the executors with the plan and read what the standard library can't.
    """
    return files.select(F.col("notice_id").cast("string").alias("notice_id"), "name", "content").mapInPandas(partial(_blocks, adapters=adapters), BLOCKS)


LAYOUT = "document_id string, page int, kind string, text string, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double"


def _layout(frames: Iterator[pd.DataFrame], reader) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in LAYOUT.split(", ")]
    for frame in frames:
        out = [(key, *row) for key, data in zip(frame["document_id"], frame["content"]) for row in reader(bytes(data))]
        yield pd.DataFrame(out, columns=names)


def pdf_blocks(files: DataFrame, reader, keywords: tuple[str, ...] = (), ocr: DataFrame | None = None) -> DataFrame:
    """SRC-08: blocks of PDF files (document_id, content): document_id, page, place, type, text, rows.

    ``reader`` turns the bytes of a file into rows (page, kind, text, rows, x0, y0, x1, y1), kind being ``paragraph``,
    ``table`` or ``page`` (one row a page).  On each page come the paragraphs that no table covers, in reading order, then
    the tables, then, for pages with little text, what ``ocr`` (document_id, page, text) read of those chosen for it.
    """
    from ..operators import geometry
    from ..operators.flow import dealt, numbered, settled

    layout = files.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInPandas(partial(_layout, reader=reader), LAYOUT)
    # each branch below reads the same shuffle; filters that passed it would have the files read once a branch
    layout = settled(dealt(layout, "document_id", "page"))
    box = ["x0", "y0", "x1", "y1"]
    tables = layout.where("kind = 'table'")
    paragraphs = geometry.in_reading_order(geometry.uncovered(layout.where("kind = 'paragraph' and text <> ''"), tables)).select("document_id", "page", F.lit(0).alias("_step"), F.col("place").cast("int").alias("place"), F.lit("paragraph").alias("type"), "text", "rows")
    placed = numbered(tables, ["document_id", "page"], ["y0", "x0", "x1", "y1"], "place").select("document_id", "page", F.lit(1), F.col("place").cast("int"), F.lit("table"), X.table_to_markdown(X.trim_table(F.col("rows"))), X.trim_table(F.col("rows")))
    words = layout.where("kind <> 'table'").groupBy("document_id", "page").agg(F.coalesce(F.array_join(F.collect_list(F.when(F.col("kind") == "paragraph", F.col("text"))), "\n"), F.lit("")).alias("text"))
    little = words.where(F.length("text") < geometry.OCR_CHARS).select("document_id", "page")
    chosen = geometry.ocr_pages(words, keywords).select("document_id", "page", F.lit(True).alias("_chosen"))
    read = little.join(chosen, ["document_id", "page"], "left")
    read = read.join(ocr.select("document_id", "page", F.col("text").alias("_text")), ["document_id", "page"], "left") if ocr is not None else read.withColumn("_text", F.lit(None).cast("string"))
    scans = read.select("document_id", "page", F.lit(2), F.lit(1), F.lit("ocr_text"), F.when(F.col("_chosen"), F.coalesce("_text", F.lit(""))).otherwise(""), F.lit(None).cast("array<array<string>>"))
    return numbered(paragraphs.union(placed).union(scans), ["document_id", "page"], ["_step", "place"], "_n").drop("_step", "place").withColumnRenamed("_n", "place")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path, through Spark's own readers: notice_id is the folder, name the file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("notice_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def signature(content: Column, name: Column) -> Column:
    """SRC-01 without opening archives: type by first bytes, in the JVM."""
    head = F.substring(content, 1, 8)
    starts = lambda mark: F.substring(head, 1, len(mark)) == F.lit(mark)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = None
    for mark, kind in formats.SIGNATURES:
        out = F.when(starts(mark), kind) if out is None else out.when(starts(mark), kind)
    out = out.when(starts(b"PK\x03\x04") | starts(b"PK\x05\x06"), F.when(suffix.isin("docx", "xlsx"), suffix).otherwise("zip"))
    out = out.when(starts(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), F.when(suffix.isin("xls", "xlt"), "xls").otherwise("doc"))
    return out.when(suffix.isin("html", "htm"), "html").when(suffix == "", "binary").otherwise(suffix)


def stable_blocks(blocks: DataFrame) -> DataFrame:
    """X-20, W-03: content-addressed block ids; equal blocks of a notice are numbered in order."""
    from ..operators.flow import occurrence_ids

    identity = F.to_json(F.struct("notice_id", "type", "path", "text", "rows"), {"ignoreNullFields": "false"})
    base = F.concat(F.col("notice_id"), F.lit(":blk_"), F.substring(F.sha2(X.canonical_json(identity).cast("binary"), 256), 1, 24))
    return occurrence_ids(blocks.withColumn("_base", base), "notice_id", "_base", ["pos"]).drop("_base")


def read_json_log(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """SRC-19: one JSON object a line; a bad line fails the read, or is kept aside in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType(list(schema.fields if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).fields) + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: whole JSON files in path order with their validity; one bad file does not stop the others."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    return rows.withColumn("valid", F.try_parse_json("json").isNotNull())


def relation_roots(files: DataFrame) -> DataFrame:
    """SRC-21: project objects of relation files: one object, a list, or an envelope whose status must be success."""
    whole = F.trim(F.col("json"))
    listed = F.from_json(whole, "array<string>")
    status, inner = F.get_json_object(whole, "$.status"), F.get_json_object(whole, "$.project")
    rows = F.when(whole.startswith("["), listed).when(inner.isNotNull(), F.when(status == "success", F.array(inner)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(whole))
    return files.where("valid").select("path", F.posexplode(rows).alias("place", "project"))


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC-26: metadata of a manifest by notice, where it has some."""
    return files.join(manifest, "notice_id", "left")


def detail_links(pages: DataFrame) -> DataFrame:
    """SRC-23: award links of stored list pages, the last title of an address."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))).alias("place", "a"))
    rows = each.select("page_id", "place", F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1).alias("url"), F.trim(F.regexp_replace("a", r"(?s)<[^>]+>", "")).alias("title"))
    turn = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("page_id"), F.desc("place")))
    return rows.withColumn("_n", turn).where("_n = 1").drop("_n")


DETAILS = "page_id string, title string, content string, meta map<string,string>, attachments array<struct<name:string,uuid:string,url:string,kind:string>>"


def _detail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [formats.parse_detail(html.encode() if isinstance(html, str) else bytes(html or b""), url or "") for html, url in zip(frame["html"], frame["url"])]
        yield pd.DataFrame({"page_id": frame["page_id"], **{name: [x[name] for x in found] for name in ("title", "content", "meta", "attachments")}})


def details(pages: DataFrame) -> DataFrame:
    """SRC-23: stored detail pages (page_id, url, html) with title, text, summary and attachments."""
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(_detail, DETAILS)
