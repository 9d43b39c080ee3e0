"""Page geometry: paragraphs under tables, pages for OCR, and watermark characters, over tables of spans and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import flow

#: Characters below which a page is read by OCR, pages read at most, share of a paragraph under a table.
OCR_CHARS, OCR_PAGES, COVERED = 50, 20, 0.5
#: Fixed value: shape of a watermark's text.
WATERMARK = r"^[0-9a-fA-F]{32}-\d{14,20}$"
_BOX = ("x0", "y0", "x1", "y1")


def uncovered(paragraphs: DataFrame, tables: DataFrame, share: float = COVERED) -> DataFrame:
    """SRC-08, SRC-09: paragraphs of which no table of the page covers ``share`` or more.

    Both: document_id, page, x0, y0, x1, y1; the boxes meet on the page by equality and are compared there.
    """
    boxes = tables.select("document_id", "page", *[F.col(c).alias(f"_t{c}") for c in _BOX])
    hit = X.bbox_overlap(*[F.col(c) for c in _BOX], *[F.col(f"_t{c}") for c in _BOX]) >= share
    same = (F.col("p.document_id") == F.col("t.document_id")) & (F.col("p.page") == F.col("t.page"))
    return paragraphs.alias("p").join(boxes.alias("t"), same & hit, "left_anti")


def in_reading_order(paragraphs: DataFrame) -> DataFrame:
    """SRC-08: place of each text block on its page: by rounded top, then by left edge; boxes alike by their text."""
    tie = ["text"] if "text" in paragraphs.columns else []
    return flow.numbered(paragraphs, ["document_id", "page"], [F.bround("y0"), "x0", "x1", "y1", *tie], "place")


def ocr_pages(pages: DataFrame, keywords: tuple[str, ...], most: int = OCR_PAGES) -> DataFrame:
    """SRC-08, SRC-11: pages with little text that are read by OCR: those with a keyword first, the rest evenly."""
    little = pages.where(F.length(F.coalesce("text", F.lit(""))) < OCR_CHARS)
    return flow.even_sample(little, ["document_id"], ["page"], most, X.contains_any(F.coalesce("text", F.lit("")), keywords))


def _grey(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) - F.least(r, g, b) <= 0.04) & ((r + g + b) / 3).between(0.15, 0.85)


def watermarks(spans: DataFrame) -> DataFrame:
    """SRC-10: spans whose text has a watermark's shape and which are rotated, translucent or mid-grey.

    ``spans``: document_id, page, text, font, size, dir_x, dir_y, alpha, r, g, b, and a box; ``token`` is added.
    """
    rows = spans.withColumn("token", F.regexp_replace("text", r"(?U)\s+", "")).where(F.col("token").rlike(WATERMARK))
    rows = rows.withColumn("rotated", F.abs("dir_y") >= 0.15)
    return rows.where(F.col("rotated") | (F.coalesce("alpha", F.lit(255.0)) < 245) | F.coalesce(_grey(F.col("r"), F.col("g"), F.col("b")), F.lit(False)))


def without_watermarks(chars: DataFrame, marks: DataFrame) -> DataFrame:
    """SRC-10: characters less those of a watermark whose whole token they spell in order; partial matches stay.

    ``chars``: document_id, page, pos, char, font, size, dir_x, dir_y, r, g, b, and a box.
    """
    m = marks.select("document_id", "page", "token", F.col("font").alias("_font"), F.col("size").alias("_size"), F.col("rotated").alias("_rotated"), *[F.col(c).alias(f"_{c}") for c in ("dir_x", "dir_y", "r", "g", "b", *_BOX)])
    near = lambda c: F.abs(F.col(c) - F.col(f"_{c}")) <= 0.04
    turned = ~F.col("_rotated") | ((F.abs(F.abs("dir_x") - F.abs("_dir_x")) <= 0.1) & (F.abs(F.abs("dir_y") - F.abs("_dir_y")) <= 0.1))
    inside = ((F.col("x0") + F.col("x1")) / 2).between(F.col("_x0") - 1, F.col("_x1") + 1) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("_y0") - 1, F.col("_y1") + 1)
    able = (F.col("font") == F.col("_font")) & (F.abs(F.col("size") - F.col("_size")) <= F.greatest(F.lit(1.0), F.col("_size") * 0.08)) & near("r") & near("g") & near("b") & turned & inside
    hits = chars.join(m, ["document_id", "page"]).where(able)
    spelled = hits.groupBy("document_id", "page", "token", *[f"_{c}" for c in _BOX]).agg(F.sort_array(F.collect_list(F.struct("pos", "char"))).alias("_c"))
    whole = spelled.where(F.array_join(F.transform("_c", lambda c: c["char"]), "") == F.col("token"))
    gone = whole.select("document_id", "page", F.explode(F.transform("_c", lambda c: c["pos"])).alias("pos")).distinct()
    return chars.join(gone, ["document_id", "page", "pos"], "left_anti")
