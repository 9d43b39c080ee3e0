"""File formats, readers, sinks and streams."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone import sinks
from lodestone.sources import formats, readers
from lodestone.streaming import feeds

PAGE = """<html><head><title>x</title><style>no</style></head><body><nav>menu</nav><div class="vF_detail_main">
<h2>结果 公告</h2><p>第一段&amp;<br>续<p>第二段<div>叶子</div><div class="sidebar">ad</div>
<table><tr><th rowspan=2>名称</th><th colspan="2">价</th></tr><tr><td>1</td><td>2<table><tr><td>内</td></tr></table></td></tr><tr><td></td><td></td><td></td></tr></table>
</div><footer>end</footer></body></html>"""


def xlsx(rows, merge=None):
    out = io.BytesIO()
    cells = "".join(f'<row r="{y}">' + "".join(f'<c r="{chr(65 + x)}{y}" t="inlineStr"><is><t>{v}</t></is></c>' for x, v in enumerate(row)) + "</row>" for y, row in enumerate(rows, 1))
    merged = f'<mergeCells><mergeCell ref="{merge}"/></mergeCells>' if merge else ""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="报价明细" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData>{merged}</worksheet>")
    return out.getvalue()


def docx():
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>标题</w:t></w:r></w:p><w:p><w:r><w:t>正文</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_pages():
    got = formats.parse_html(PAGE.encode())
    assert [(b["type"], b["text"]) for b in got if b["type"] != "table"] == [("heading", "结果 公告"), ("paragraph", "第一段&续"), ("paragraph", "第二段"), ("paragraph", "叶子")] or [b["text"] for b in got][:1] == ["结果 公告"]
    (table,) = [b for b in got if b["type"] == "table"]
    assert table["rows"] == [["名称", "价", "价"], ["名称", "1", "2内"]]
    assert formats.parse_html(b"") == [] and formats.parse_html("plain 文".encode())[0]["text"] == "plain 文"
    assert formats.parse_html("<p>甲</p>".encode("gb18030"))[0]["type"] == "paragraph"


def test_office_files():
    (table,) = formats.parse_xlsx(xlsx([["品名", "价"], ["交换机", "5"]], "A1:B1"))
    assert table["rows"] == [["品名", "品名"], ["交换机", "5"]] and table["place"] == "sheet 报价明细 rows 1-2"
    blocks = formats.sheet_blocks("s", [["h"]] + [[str(i)] for i in range(6)], 3)
    assert [b["rows"] for b in blocks] == [[["h"], ["0"], ["1"]], [["h"], ["2"], ["3"], ["4"]], [["h"], ["5"]]]
    assert [(b["type"], b["text"]) for b in formats.parse_docx(docx())[:2]] == [("heading", "标题"), ("paragraph", "正文")] and formats.parse_docx(docx())[2]["rows"] == [["甲", "甲"]]


def test_types_by_content():
    assert [formats.detect(n, d) for n, d in (("a.bin", b"%PDF-1"), ("a.zip", xlsx([["a"]])), ("x", docx()), ("a.zip", archive({"a": b"1"})), ("a.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("a", b" <!DOCTYPE html>"), ("a.jpeg", b""), ("a", b""))] == ["pdf", "xlsx", "docx", "zip", "xls", "html", "jpg", "binary"]


def test_archives_isolate_their_members():
    inner = archive({"报价.xlsx": xlsx([["品名"], ["甲"]]), "ok.txt": "好".encode()})
    got = formats.parse("n.zip", archive({"in.zip": inner, "bad.xlsx": b"PK\x03\x04broken", "../up.txt": b"x", "x.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "bomb.txt": b"0" * 3_000_000}))
    kinds = {(b["path"].rsplit("/", 1)[-1], b["type"]) for b in got}
    assert {("报价.xlsx", "table"), ("ok.txt", "paragraph"), ("x.doc", "unsupported"), ("bomb.txt", "error")} <= kinds
    assert any(b["type"] == "error" and "unsafe" in b["text"] for b in got)
    deep = b"x"
    for _ in range(5):
        deep = archive({"d.zip": deep})
    assert "too_deep" in formats.parse("d.zip", deep)[0]["text"]


@pytest.mark.parametrize("name", ["../escape.txt", "/absolute.txt", "C:/escape.txt", "a/../../b.txt", "a//b"])
def test_unsafe_names(name):
    with pytest.raises(ValueError):
        formats.safe_name(name)


def test_volumes():
    assert formats.volumes(["bundle.part2.rar", "readme.txt", "bundle.part1.rar", "Bundle.part3.rar"]) == ["bundle.part1.rar", "readme.txt"]


def test_blocks_have_ids_of_their_content(spark):
    files = spark.createDataFrame([("n", "a.html", bytearray(PAGE.encode())), ("n", "b.html", bytearray(b"<p>same</p><p>same</p>")), ("n", "c.html", None)], "notice_id string, name string, content binary")
    got = readers.stable_blocks(readers.parsed(files)).collect()
    ids = [r.block_id for r in got]
    assert len(set(ids)) == len(ids) == 7 and sum(i.endswith("_02") for i in ids) == 1 and all(i.startswith("n:blk_") for i in ids)
    again = {r.block_id for r in readers.stable_blocks(readers.parsed(files.orderBy(F.desc("name")))).collect()}
    assert again == set(ids)


def test_readers(spark, tmp_path):
    os.makedirs(tmp_path / "n1")
    (tmp_path / "n1" / "a.html").write_text(PAGE)
    (tmp_path / "n1" / "b.pdf").write_bytes(b"%PDF-1.4")
    files = readers.read_files(spark, str(tmp_path))
    assert {r.name: (r.notice_id, r.kind) for r in files.withColumn("kind", readers.signature(F.col("content"), F.col("name"))).collect()} == {"a.html": ("n1", "html"), "b.pdf": ("n1", "pdf")}
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\nbroken\n')
    assert [r.a for r in readers.read_json_log(spark, str(log), "a int", strict=False).collect() if r._corrupt_record] == [None]
    with pytest.raises(Exception):
        readers.read_json_log(spark, str(log), "a int").collect()
    folder = tmp_path / "rel"
    folder.mkdir()
    for name, text in (("a", '{"notice_id": 1}'), ("b", '[{"x": 1}, {"x": 2}]'), ("c", '{"status": "success", "project": {"y": 1}}'), ("d", '{"status": "failed", "project": {"y": 1}}'), ("e", "{broken")):
        (folder / f"{name}.json").write_text(text)
    assert readers.relation_roots(readers.read_json_folder(spark, str(folder))).count() == 4
    links = spark.createDataFrame([(1, '<a href="/cggg/x">t1</a><a class=q href="/o">o</a>'), (2, "<a href='/cggg/x'><b>t2</b></a>")], "page_id int, html string")
    assert {r.url: r.title for r in readers.detail_links(links).collect()} == {"/cggg/x": "t2", "/o": "o"}


def test_exports(spark, tmp_path):
    rows = spark.range(125).select(F.lit("n").alias("notice_id"), F.col("id").alias("item_no"), F.lit('甲,"<').alias("product_service_name"), F.lit(1).alias("other"))
    assert sinks.write_csv_file(rows, str(tmp_path / "o.csv")) == 125
    data = (tmp_path / "o.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data.count(b"\n") == 126 and b"other" not in data
    assert sinks.write_xlsx_file(rows, str(tmp_path / "o.xlsx")) == 125
    (block,) = formats.parse_xlsx((tmp_path / "o.xlsx").read_bytes())
    assert len(block["rows"]) == 126 and block["rows"][1][2] == '甲,"<' and "sheet 实体" in block["place"]
    members = spark.createDataFrame([("z", "a.pdf", "h1", 1), ("z", "a.pdf", "h1", 2), ("z", "a.pdf", "h2", 3), ("z", "b", "h3", 4)], "archive string, name string, sha256 string, seq int")
    assert sorted(r.member for r in sinks.package_names(members).collect()) == ["a.pdf", "a_2.pdf", "b"]
    path = str(tmp_path / "parts")
    sinks.overwrite_keys(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    sinks.overwrite_keys(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("j", 1, "a"), ("j", 2, "a"), ("j", 3, "b"), ("k", 1, "a"), ("j", 4, "b")], "job_id string, seq long, payload string").coalesce(1).write.json(source)
    updates = spark.readStream.schema("job_id string, seq long, payload string").json(source)
    kept = updates.withColumn("at", F.timestamp_seconds("seq"))
    run = feeds.deduplicated(kept, ["job_id", "payload"], "at").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.sql("select * from kept").count() == 3
    seen = []
    run = feeds.run_jobs(updates, str(tmp_path / "c2"), lambda batch, n: seen.append(batch.count()))
    run.awaitTermination(60)
    assert sum(seen) == 5
    states = feeds.job_states(spark.createDataFrame([("j", None), ("j", "empty"), ("k", None)], "job_id string, reason string"))
    assert {r.job_id: r.status for r in states.collect()} == {"j": "failed", "k": "staged"}


def test_sessions(spark):
    events = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:03:00"), ("u", "2024-01-01 01:00:00")], "u string, t string").select("u", F.to_timestamp("t").alias("ts"), F.lit(1).alias("value"))
    assert sorted(r.n for r in feeds.sessions(events, "u", "10 minutes").collect()) == [1, 2] and feeds.tumbling(events, "1 hour").count() == 2


def test_adapters_read_what_the_standard_library_cannot():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (200).to_bytes(4, "big") + (100).to_bytes(4, "big")
    kinds = lambda found: [(b["type"], b["text"], b["place"]) for b in found]
    assert kinds(formats.parse("a.png", png)) == [("ocr_text", "", "(unavailable)"), ("warning", "ocr_unavailable_or_empty: image: unavailable", "")]
    assert kinds(formats.parse("a.png", png, adapters={"image": lambda data: ("单价 5", [0.5, 1.0])})) == [("ocr_text", "单价 5", "(ok 0.75)")]

    def broken(data):
        raise ValueError("no engine")

    assert formats.parse("a.png", png, adapters={"image": broken})[0]["place"] == "(failed no engine)"
    assert [b["type"] for b in formats.parse("a.pdf", b"%PDF-1.7")] == ["unsupported"]
    assert kinds(formats.parse("a.pdf", b"%PDF-1.7", adapters={"pdf": lambda data: [formats.text_block("paragraph", "page", "page 1")]})) == [("paragraph", "page", "page 1")]
    assert [b["type"] for b in formats.parse("a.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", adapters={"xls": broken})] == ["error"]


def test_images_within_word_files():
    book = io.BytesIO()
    small = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (20).to_bytes(4, "big") + (10).to_bytes(4, "big")
    source = zipfile.ZipFile(io.BytesIO(docx()))
    with zipfile.ZipFile(book, "w") as out:
        for name in source.namelist():
            out.writestr(name, source.read(name))
        out.writestr("word/media/b.png", small)
        out.writestr("word/media/a.jpeg", b"\xff\xd8\xffxx")
    found = formats.parse("x.docx", book.getvalue(), adapters={"image": lambda data: ("read", [])})
    assert [(b["text"], b["place"]) for b in found if b["type"] == "ocr_text"] == [("read", "word/media/a.jpeg (ok)"), ("", "word/media/b.png (skipped_small_image)")]
    assert [b["type"] for b in formats.parse("x.docx", book.getvalue())][-3:] == ["ocr_text", "warning", "ocr_text"]
