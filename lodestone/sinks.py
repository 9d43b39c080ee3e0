"""Sinks.  Data is written by executors; only the single-file exports stream rows through the driver, one at a time."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.search import EXPORT


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-02; Spark's commit makes the write all or nothing (SNK-01)."""
    rows.write.mode(mode).json(path)


def overwrite_keys(rows: DataFrame, path: str, partition: str) -> None:
    """SNK-05, SNK-06: replace the partitions that ``rows`` holds and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a path, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions below a path that are whole."""
    return [int(n.removeprefix("done-")) for n in _listed(spark, path) if n.startswith("done-")]


def folders(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _listed(spark, path) if not n.startswith(("_", "."))]


def write_version(spark: SparkSession, tables: dict[str, DataFrame], path: str, number: int) -> None:
    """SNK-01, SNK-05, SNK-06: write tables as one version; it counts once its mark is there, whatever fails before."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/v{number}/{name}")
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/done-{number}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def _streamed(rows: DataFrame) -> Iterator[list[str]]:
    for row in rows.toLocalIterator(prefetchPartitions=True):
        yield ["" if v is None else str(v) for v in row]


def write_csv_file(rows: DataFrame, path: str) -> int:
    """SNK-03: one file with a byte-order mark and the export columns, without a row limit; returns the rows."""
    import csv

    rows = rows.select(*[c for c in EXPORT if c in rows.columns])
    count = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        for values in _streamed(rows):
            writer.writerow(values)
            count += 1
    return count


def write_xlsx_file(rows: DataFrame, path: str, sheet: str = "实体") -> int:
    """SNK-04: one sheet of inline strings, streamed into the archive; returns the rows."""
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    line = lambda values: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in values) + "</row>"
    count = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
        with archive.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'.encode())
            out.write(line(rows.columns).encode())
            for values in _streamed(rows):
                out.write(line(values).encode())
                count += 1
            out.write(b"</sheetData></worksheet>")
    return count


def package_names(files: DataFrame) -> DataFrame:
    """SNK-08: names of an archive's members: the same content once, other content under its name with a number."""
    turn = F.row_number().over(Window.partitionBy("archive", "name").orderBy("seq", "sha256"))
    rows = files.groupBy("archive", "name", "sha256").agg(F.min("seq").alias("seq")).withColumn("_n", turn)
    stem, ending = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("member", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ending))).drop("_n")


def run_report(outcomes: DataFrame) -> DataFrame:
    """SNK-07: counts by status and method."""
    return outcomes.groupBy("status", "method").agg(F.count("*").alias("n")).orderBy("status", "method")
