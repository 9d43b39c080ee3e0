import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X


def value(spark, build, *args, kind="string"):
    names = [f"a{i}" for i in range(len(args))]
    frame = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {kind}" for n in names))
    return frame.select(build(*[F.col(n) for n in names]).alias("v")).first().v


CASES = [
    (X.compact, " Ａb（ C　d） ", "ａb(cd)"),
    (X.compact_nfkc, " Ａ：B（x） ", "a:b(x)"),
    (X.canonical_product_name, "▲ 交换机（核心产品） S-1", "交换机s1"),
    (X.clean_text, "  交 换 机 AB 12；", "交换机 AB 12"),
    (X.clean_text, "详见附件1", None),
    (X.clean_text, "无", None),
    (X.clean_text, "—", None),
    (X.normalize_category_code, "A02010100 台式机", "A02010100"),
    (X.normalize_category_code, "A02010100台式机", None),
    (X.normalize_org_name, "Ａ公司（北 京）、", "a公司(北京)"),
    (X.match_text, "甲-公司_（1）", "甲公司1"),
    (X.normalise_text, "a&amp;b  c\n\n\n\nd ​", "a&b c\n\nd"),
    (X.clean_org_name, "甲公司 <br>地址：x", "甲公司"),
    (X.project_no, "x\n项目编号： T-01，y", "T-01"),
    (X.unit_name, "采购人信息名称：测试学校\n", "测试学校"),
    (X.notice_date, "20260228_x", "2026-02-28"),
    (X.notice_date, "20260230_x", None),
    (X.parse_json_output, '<think>x{"a":1}</think> ok {"items": []} end', '{"items": []}'),
    (X.parse_json_output, '```json\n{"items": [1]}\n```', '{"items": [1]}'),
    (X.parse_json_output, "none", None),
    (X.parse_json_answer, "say [1, 2] ok", "[1, 2]"),
    (X.disposition_name, "attachment; filename*=UTF-8''%E7%94%B2.zip", "甲.zip"),
    (X.disposition_name, 'attachment; filename="a b.zip"', "a b.zip"),
    (X.short_title, "x" * 50, "x" * 39 + "…"),
    (X.canonical_json, '{"b":1,"a":null}', '{"a":null,"b":1}'),
]


@pytest.mark.parametrize("build,given,want", CASES)
def test_texts(spark, build, given, want):
    assert value(spark, build, given) == want


@pytest.mark.parametrize("given,want", [("1,234.50 元", 1234.5), ("12万元", 120000), ("-3", None), ("1 234", 1234), ("无", None), (None, None), ("３", None)])
def test_numbers(spark, given, want):
    got = value(spark, X.parse_number, given)
    assert (None if got is None else float(got)) == want


def test_relation_numbers_do_not_join_digits(spark):
    assert value(spark, X.relation_number, "1 234") == 1.0 and value(spark, X.relation_number, "12万元") == 120000.0


@pytest.mark.parametrize("given,unit,want", [("2台", None, (2.0, "台")), ("3", "套", (3.0, "套")), ("5 (个)", None, (5.0, "个")), ("7", None, (7.0, None)), ("x", "件", (None, "件"))])
def test_quantities(spark, given, unit, want):
    got = value(spark, lambda a, b: F.struct(*X.parse_quantity(a, b)), given, unit)
    assert (None if got[0] is None else float(got[0]), got[1]) == want


def test_categories(spark):
    assert tuple(value(spark, lambda a: F.struct(*X.split_category(a)), "A02010100 台式机")) == ("台式机", "A02010100")
    assert tuple(value(spark, lambda a: F.struct(*X.split_category(a)), "台式机")) == ("台式机", None)
    assert tuple(value(spark, lambda a: F.struct(*X.strict_category(a)), "A02010100 台式机")) == ("台式机", "A02010100")
    assert value(spark, X.strict_number, "12x") is None and float(value(spark, X.strict_number, "1,2")) == 12


@pytest.mark.parametrize("name,good", [("测试有限公司", True), ("测试", False), ("根据本项目有限公司", False), ("1234", False), ("甲公司（联合体牵头）", True), ("通过", False)])
def test_organization_names(spark, name, good):
    assert value(spark, X.valid_org_name, name) is good


def test_stable_id_takes_null_empty_and_zero_alike(spark):
    import hashlib

    want = "p_" + hashlib.sha256("a\x1f\x1f\x1f".encode()).hexdigest()[:20]
    got = spark.range(1).select(X.stable_id("p", F.lit("a"), F.lit(None), F.lit(0), F.lit(""))).first()[0]
    assert got == want


def test_similarity_depends_on_order(spark):
    assert value(spark, X.sequence_ratio, "tide", "diet") == 0.25 and value(spark, X.sequence_ratio, "diet", "tide") == 0.5
    assert value(spark, X.bag_bound, "ab", "abcd") == pytest.approx(4 / 6)


def test_tables(spark):
    rows = [["", ""], [" ", ""], ["a", "b|c", ""], ["d"], [""]]
    frame = spark.createDataFrame([([[c.strip() for c in r] for r in rows],), ([],), ([[""]],)], "r array<array<string>>")
    got = [r[0] for r in frame.select(X.trim_table(F.col("r"))).collect()]
    assert got == [[["a", "b|c"], ["d", ""]], [], []]
    lines = [r[0] for r in spark.createDataFrame([([["a", "b|c"], ["d\ne"]],), ([],)], "r array<array<string>>").select(X.table_to_markdown(F.col("r"))).collect()]
    assert lines == ["| a | b\\|c |\n| --- | --- |\n| d<br>e |  |", ""]


def test_boxes_and_colours(spark):
    box = lambda *v: spark.range(1).select(X.bbox_overlap(*[F.lit(float(x)) for x in v])).first()[0]
    assert box(10, 10, 20, 20, 0, 0, 30, 30) == 1.0 and box(10, 10, 20, 20, 15, 10, 30, 20) == 0.5 and box(10, 10, 20, 20, 30, 30, 40, 40) == 0.0
    assert spark.range(1).select(X.rgb(F.lit(0xFF0000))).first()[0] == [1.0, 0.0, 0.0]
    assert spark.range(1).select(X.rgb_parts(F.array(F.lit(255), F.lit(0), F.lit(51)))).first()[0] == [1.0, 0.0, 0.2]


def test_matching_keeps_wildcards_and_folds_ascii_only(spark):
    like = lambda text, needle: value(spark, lambda c: X.ascii_like(c, needle), text)
    assert like("Foo Bar", "o b") and like("axb", "A_B") and not like("É", "é") and not like(None, "x") and like(None, "")


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.format_money(F.lit(1234.5))) == "¥1,234.5" and one(X.format_size(F.lit(2048))) == "2.0 KB" and one(X.value_key(F.lit(2.50), True)) == "2.5"
    assert one(X.parse_ids(F.lit(" a, ,b"))) == ["a", "b"] and one(X.cost(F.lit(2_000_000), 1.5)) == 3.0
    assert one(X.excerpt(F.array(F.array(F.lit("x"), F.lit("y"))), F.lit(1), F.lit("t"))) == "x ｜ y"
    assert one(X.source_location(file=F.lit("PDF"), page=F.lit(1), sheet=F.lit(None), block_row=F.lit(3))) == "PDF, page=1, block_row=3"
    assert one(X.safe_file_name(F.lit("../a b?.zip"))) == "a_b_.zip" and len(one(X.uuid_urls(F.lit("http://h"), F.lit("u")))) == 4
    assert unicodedata.normalize("NFKC", "①") == one(X.nfkc(F.lit("①")))
