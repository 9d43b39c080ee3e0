from lodestone.operators import evaluation, geometry

BOX = "x0 double, y0 double, x1 double, y1 double"
TOKEN = "0123456789abcdef0123456789abcdef-20260101000000000"


def test_paragraphs_under_tables_go(spark):
    texts = spark.createDataFrame([("d", 1, 10.0, 10.0, 20.0, 20.0), ("d", 2, 10.0, 10.0, 20.0, 20.0), ("d", 1, 100.0, 1.0, 110.0, 9.0)], f"document_id string, page int, {BOX}")
    tables = spark.createDataFrame([("d", 1, 15.0, 10.0, 30.0, 20.0)], f"document_id string, page int, {BOX}")
    assert sorted((r.page, r.x0) for r in geometry.uncovered(texts, tables).collect()) == [(1, 100.0), (2, 10.0)]
    assert sorted((r.page, r.place, r.x0) for r in geometry.in_reading_order(texts).collect()) == [(1, 1, 100.0), (1, 2, 10.0), (2, 1, 10.0)]


def test_pages_for_ocr(spark):
    pages = spark.createDataFrame([("d", i, "x" * 60 if i == 3 else "报价" if i == 5 else "") for i in range(8)], "document_id string, page int, text string")
    assert sorted(r.page for r in geometry.ocr_pages(pages, ("报价",), 3).collect()) == [0, 5, 7]


def marks(spark, token=TOKEN, dir_y=0.7, grey=0.5):
    look = (0.7, dir_y, 255.0, grey, grey, grey, 0.0, 0.0, 500.0, 500.0)
    return geometry.watermarks(spark.createDataFrame([("d", 1, token, "F", 20.0, *look)], f"document_id string, page int, text string, font string, size double, dir_x double, dir_y double, alpha double, r double, g double, b double, {BOX}"))


def chars(spark, text):
    rows = [("d", 1, i, c, "F", 20.0, 0.7, 0.7, 0.5, 0.5, 0.5, float(i), float(i), i + 1.0, i + 1.0) for i, c in enumerate(text)] + [("d", 1, 900, "值", "G", 9.0, 1.0, 0.0, 0.0, 0.0, 0.0, 5.0, 5.0, 6.0, 6.0)]
    return spark.createDataFrame(rows, f"document_id string, page int, pos int, char string, font string, size double, dir_x double, dir_y double, r double, g double, b double, {BOX}")


def test_whole_watermarks_go_and_others_stay(spark):
    assert [r.char for r in geometry.without_watermarks(chars(spark, TOKEN), marks(spark)).collect()] == ["值"]
    assert geometry.without_watermarks(chars(spark, TOKEN[:-1]), marks(spark)).count() == len(TOKEN)
    assert marks(spark, dir_y=0.0, grey=0.0).count() == 0 and marks(spark, token="plain").count() == 0


def test_reports_and_addresses(spark):
    rows = spark.createDataFrame([("a", "x", "http://h/cggg/1"), ("a", None, "http://h/o"), (None, "x", None)], "source string, region string, url string")
    by_source, by_region = evaluation.dataset_report(rows, 1)
    assert {r.source: r.n for r in by_source.collect()} == {"a": 2, "未知": 1} and [r.region for r in by_region.collect()] == ["x"]
    assert evaluation.of_results(rows).count() == 1
