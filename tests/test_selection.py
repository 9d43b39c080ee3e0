"""Evidence selection, extraction, merging and relation candidates on literal notices."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import candidates, extraction, merging, policy, selection

SOURCE = "struct<document_id:string,file_name:string,container_path:string,file_type:string,sheet:string,page:int>"
BLOCKS = f"notice_id string, block_id string, pos int, type string, text string, rows array<array<string>>, source {SOURCE}"
HTML = ("d1", "notice.html", "notice.html", "html", None, None)


def block(i, kind="paragraph", text="", rows=None, source=HTML, notice="N"):
    return (notice, f"b{i}", i, kind, text, rows, source)


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, BLOCKS)


GOODS = [["序号", "货物名称", "品牌", "规格型号", "数量", "单价", "总价"], ["1", "交换机", "华三", "S5130", "2台", "1000.00", "2000.00"], ["2", "路由器", "华三", "R100", "1台", "500", "500"]]


def header(spark, cells):
    row = spark.createDataFrame([(cells,)], "c array<string>").select(selection.match_header(selection.compact_cells(F.col("c")))).first()[0]
    return row


def test_header_fields(spark):
    got = header(spark, ["供应商名称", "地址", "中标金额"])
    assert "product_service_name" not in got and "brand_supplier" not in got and got["total_price"] == 2
    got = header(spark, ["序号", "产品名称", "数量及单位", "单价", "合计"])
    assert got == {"product_service_name": 1, "quantity": 2, "unit_price": 3, "total_price": 4}
    assert header(spark, GOODS[0]) == {"product_service_name": 1, "brand_supplier": 2, "spec_model": 3, "quantity": 4, "unit_price": 5, "total_price": 6}
    assert header(spark, []) == {}


def test_tables_are_scored_or_refused(frame):
    rows = [
        block(0, "table", "主要标的信息", GOODS),
        block(1, "table", "", [["供应商名称", "地址", "中标金额"], ["甲公司", "路", "5元"]]),
        block(2, "table", "", [GOODS[0], ["1", "交换机", "", "", "/", "", ""]]),
        block(3, "table", "", [GOODS[0], ["投标报价", "佰拾万仟", "华三", "", "", "", ""]]),
        block(4, "table", "", [["服务名称", "服务范围", "服务要求", "服务时间", "服务标准"], ["保洁", "全院", "好", "一年", "国标"]]),
        block(5, "table", "", [["项目", "内容"], ["编号", "1"], ["日期", "2"]]),
        block(6, "table", "", [GOODS[0]]),
    ]
    got = {r.block_id: r for r in selection.score_tables(frame(rows)).collect()}
    assert set(got) == {"b0", "b4"}
    # 2 + six fields + structure + several signals + numeric rows + no currency + one phrase
    assert got["b0"].score == 2 + 24 + 10 + 7 + 2 + 6 and [r.block_row for r in got["b0"].data_rows] == [2, 3]
    assert got["b4"].score >= 22 and got["b4"].service["service_scope"] == 1


def test_header_goes_on_across_pdf_pages(frame):
    pdf = lambda page: ("d9", "分项报价表.pdf", "a.zip/分项报价表.pdf", "pdf", None, page)
    rows = [block(0, "table", "", GOODS, pdf(1)), block(1, "table", "", [r[:] for r in GOODS[1:]], pdf(2)), block(2, "table", "", GOODS[1:], pdf(60)), block(3, "table", "", [["x", "y"], ["1", "2"]], pdf(3))]
    got = {r.block_id: r for r in selection.score_tables(frame(rows)).collect()}
    assert set(got) == {"b0", "b1"} and got["b1"].header_inherited and got["b1"].header_source_block_id == "b0" and [r.block_row for r in got["b1"].data_rows] == [1, 2]


def test_source_points(spark):
    one = lambda name, path="": spark.range(1).select(policy.source_bonus(F.lit(name), F.lit(path))).first()[0]
    assert one("分项报价.pdf") == 12 and one("报价结果.pdf") == 10 and one("竞争性磋商文件.pdf") == -25 and one("采购文件报价.pdf") == 5 - 5 and one("资格声明.doc") == -18


def test_requests_of_a_notice(frame):
    rows = [block(0, "heading", "一、主要标的信息"), block(1, "table", "", GOODS), block(2, "paragraph", "中标金额：12万元，数量 3台"), block(3, "paragraph", "其他说明"), block(4, "table", "", GOODS), block(5, "paragraph", "ordinary")]
    got = selection.select(frame(rows)).orderBy("request_id").collect()
    # a table stands between the two texts, so they are two groups; the second table says the same as the first
    assert [r.kind for r in got] == ["table", "text", "text"] and got[0].request_id == "N:req_001"
    assert got[0].block_ids == ["b1"] and len(got[0].data_rows) == 2
    split = selection.select(frame([block(0, "table", "", GOODS + [["3", "键盘", "甲", "K1", "1", "5", "5"]])]), selection.Settings(max_table_rows_per_request=2)).orderBy("request_id").collect()
    assert [[d.block_row for d in r.data_rows] for r in split] == [[2, 3], [4]]
    assert selection.select(frame([block(0, "paragraph", "nothing")])).count() == 0
    stats = selection.selection_stats(frame(rows)).first().asDict()
    assert len(stats) == 20 and stats["original_block_count"] == 6 and stats["request_count"] == 3 and stats["deduplicated_request_count"] == 1
    assert (stats["table_candidate_count"], stats["selected_table_block_count"], stats["selected_table_source_count"], stats["text_group_count_before_limit"], stats["fallback_used"]) == (2, 2, 1, 2, False)


def test_weak_texts_are_a_fallback_only(frame):
    # field words alone stay below the threshold, but above the floor
    rows = [block(0, "paragraph", "品牌 型号 单价 说明文字"), block(1, "paragraph", "无关")]
    got = selection.select(frame(rows)).collect()
    assert [r.kind for r in got] == ["text"] and got[0].block_ids == ["b0", "b1"]


def test_titles(spark, frame):
    notices = spark.createDataFrame([("N", "http://x"), ("M", " a  b "), ("K", None)], "notice_id string, title string")
    got = {r.notice_id: r.title for r in selection.notice_titles(notices, frame([block(3, "heading", "标 题"), block(4, "heading", "later")])).collect()}
    assert got == {"N": "标 题", "M": "a b", "K": "K"}


def test_relation_evidence_keeps_to_its_budget(frame):
    rows = [block(0, "paragraph", "供应商 投标人 评分" * 5, source=("d2", "招标文件.pdf", "招标文件.pdf", "pdf", None, 1)), block(1, "table", "供应商名称 中标" * 30, [["供应商名称", "金额"], ["甲公司", "1"]]), block(2, "paragraph", "采购人")]
    got = selection.relation_evidence(frame(rows), 1, 200).collect()
    assert [r.block_id for r in got] == ["b1"] and len(got[0].text) < 200 and len(got[0].rows) == 2


EVIDENCE = "evidence_id string, block_id string, header array<string>, fields map<string,int>, data_rows array<struct<block_row:int,cells:array<string>>>"


def test_items_of_a_table(spark):
    rows = [(i + 2, r) for i, r in enumerate(GOODS[1:])] + [(4, ["3", "合计", "", "", "", "", "2500"]), (5, ["4", "详见附件", "详见附件", "", "", "", "9"]), (6, ["5", "同名", "同名", "同名", "", "", "1"]), (7, ["6", "空项", "", "", "", "", ""])]
    fields = {"product_service_name": 1, "spec_model": 3, "quantity": 4, "unit_price": 5, "total_price": 6}
    got = extraction.items(spark.createDataFrame([("e", "b", GOODS[0], fields, rows)], EVIDENCE)).orderBy("row_pos").collect()
    assert [(r.product_service_name, r.brand_supplier, float(r.quantity), r.quantity_unit, float(r.total_price), r.block_row) for r in got] == [("交换机", "华三", 2.0, "台", 2000.0, 2), ("路由器", "华三", 1.0, "台", 500.0, 3)]


def test_product_column_moves_to_the_specific_name(spark):
    frame = spark.createDataFrame([(["采购标的", "设备名称", "品牌"], {"product_service_name": 0})], "h array<string>, f map<string,int>")
    assert frame.select(extraction.enrich_columns(F.col("f"), F.col("h"))).first()[0] == {"product_service_name": 1, "brand_supplier": 2}


def test_price_checks(spark):
    one = lambda f, *v: spark.range(1).select(f(*[F.lit(x).cast("double") for x in v])).first()[0]
    assert one(extraction.price_consistency, 1000, 2, 5000) == "mismatch" and one(extraction.price_consistency, 1000, 2, 2010) == "ok" and one(extraction.price_consistency, None, 2, 1) == "not_checkable"
    assert one(extraction.silver_consistency, 0, 2, 0.005) is True and one(extraction.gold_consistency, 10, 2, 20.02) is False


def test_model_outputs_are_validated(spark):
    refs = "array<struct<block_id:string,block_row:int>>"
    names = "product_service_name string, category_name string, category_code string, brand_supplier string, spec_model string, unit_price string, quantity string, quantity_unit string, total_price string"
    row = lambda pos, name, found: ("r", pos, name, "c", "A02010100", "品", "m", "1万元", "2", "台", "x", found)
    outputs = spark.createDataFrame([row(0, "交换机", [("b", 2), ("b", 2), ("b", 99)]), row(1, "详见附件", [("b", 2)]), row(2, "键盘", [("b", 99)])], f"request_id string, item_pos int, {names}, refs {refs}")
    allowed = spark.createDataFrame([("r", "b", 2)], "request_id string, block_id string, block_row int")
    fields = spark.createDataFrame([("r", ["product_service_name", "unit_price", "quantity", "category_name"])], "request_id string, mapped array<string>")
    good, bad = extraction.validate(outputs, allowed, fields)
    (item,) = good.collect()
    assert (float(item.unit_price), item.brand_supplier, item.category_code, item.quantity_unit, item.total_price, len(item.evidence_refs)) == (10000.0, None, "A02010100", "台", None, 1)
    assert {(r.item_pos, r.error) for r in bad.collect()} == {(1, "no product_service_name"), (2, "no valid evidence_refs")}


def test_routes(spark):
    cases = [(True, False, False, 0, 0, None, None), (False, True, False, 2, 5, None, None), (False, True, False, 2, 4, None, None), (False, False, True, 0, 0, None, None), (False, False, False, 0, 0, None, None), (False, False, False, 0, 0, True, None), (False, False, False, 0, 0, False, True), (False, False, False, 0, 0, False, None)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a boolean, b boolean, c boolean, n int, f int, ok boolean, re boolean")
    got = [tuple(r.v) for r in frame.orderBy("i").select(extraction.route(*[F.col(x) for x in ("a", "b", "c", "n", "f", "ok", "re")]).alias("v")).collect()]
    assert got == [("filtered", "success", 0.99), ("rules", "success", 0.94), ("rules", "success", 0.88), ("covered", "success", 0.9), ("deferred", "needs_model", None), ("model", "success", 0.84), ("model_repaired", "success", 0.78), ("model", "failed", 0.0)]


def test_tiers_and_non_results(spark):
    tier = lambda name, kind="pdf": spark.range(1).select(policy.source_tier(F.lit(name), F.lit(kind))).first()[0]
    assert [tier("x.html", "html"), tier("分项报价.pdf"), tier("采购文件.pdf"), tier("采购文件-投标文件.pdf"), tier("承诺函.pdf"), tier("x.pdf")] == [4, 4, 0, 3, 1, 2]
    item = lambda *v: spark.range(1).select(policy.item_non_result(F.lit(4), *[F.lit(x) for x in v])).first()[0]
    assert item("合计金额", None, None, None) == "summary_or_total_row" and item(None, None, None, None) == "missing_product_name"
    assert item("甲", "甲", "甲", None) == "same_template_text_mapped_to_multiple_fields" and item("交换机", "甲", "乙", "台") is None
    frame = spark.createDataFrame([(["名称", "预算金额"], [["a", "1"]]), (["名称", "价"], [["合计", "1"], ["", "2"]]), (["名称", "价"], [["详见附件", "见附件"]]), (["名称", "价"], [["a", "1"]])], "h array<string>, d array<array<string>>")
    got = [r[0] for r in frame.select(policy.table_non_result(F.lit(4), F.col("h"), F.col("d"), F.lit(0))).collect()]
    assert got == ["budget_or_price_ceiling_table", "no_concrete_product_rows", "no_concrete_product_rows", None]


def test_excluded_documents_spread_to_their_requests(spark):
    evidence = spark.createDataFrame([("procurement_source", ["d1", "d2"], [0, 4]), ("no_concrete_product_rows", ["d3"], [0]), (None, ["d4"], [0])], "reason string, document_ids array<string>, tiers array<int>")
    out = policy.excluded_documents(evidence)
    assert [r.document_id for r in out.collect()] == ["d1"]
    requests = spark.createDataFrame([("a", ["d1"]), ("b", ["d1", "d9"]), ("c", [])], "request_id string, document_ids array<string>")
    assert {r.request_id: r.excluded for r in policy.in_excluded(requests, out).collect()} == {"a": True, "b": False, "c": False}


ITEMS = "notice_id string, pos int, product_service_name string, category_name string, category_code string, brand_supplier string, spec_model string, unit_price double, quantity double, quantity_unit string, total_price double, refs array<string>, request_id string, confidence double, tier int"


def item(pos, name, brand=None, spec=None, price=None, n=None, total=None, refs=("b:1",), tier=4, confidence=0.9):
    return ("N", pos, name, None, None, brand, spec, price, n, None, total, list(refs), f"r{pos}", confidence, tier)


def merged(spark, rows, title="某项目"):
    titles = spark.createDataFrame([("N", title)], "notice_id string, title string")
    return merging.merge_notices(spark.createDataFrame(rows, ITEMS), titles).orderBy("item_no").collect()


def test_exact_duplicates_and_conflicts(spark):
    rows = [item(0, "交换机", total=10.0), item(1, "交换机", total=10.0, refs=["b:2"]), item(2, "交换机", "华三", total=12.0, refs=["b:1"])]
    (one,) = merged(spark, rows)
    assert one.refs == ["b:1", "b:2"] and one.brand_supplier == "华三" and one.conflicts == ["total_price:10|12"]


def test_compatible_items_of_two_sources_merge_by_quality(spark):
    rows = [item(0, "交换机", price=5.0, n=2.0, refs=["h:1"], tier=4), item(1, "交换机（核心产品）", "华三", price=5.0, n=2.0, total=10.0, refs=["q:1"], tier=4), item(2, "交换机", price=9.0, refs=["p:1"], tier=0), item(3, "合计", total=10.0)]
    (one,) = merged(spark, rows)
    assert one.total_price == 10.0 and sorted(one.refs) == ["h:1", "q:1"] and one.merged == 1


def test_weak_sources_and_generic_summaries_go(spark):
    rows = [item(0, "路由器", "甲", price=1.0), item(1, "路由器", price=2.0, refs=["w:1"], tier=1), item(2, "键盘鼠标套装", "乙", refs=["k:1"]), item(3, "某某学校设备采购项目", total=99.0, refs=["s:1"])]
    assert [r.product_service_name for r in merged(spark, rows, "某某学校设备采购项目公告")] == ["路由器", "键盘鼠标套装"]


def test_exact_merge_and_rollup(spark):
    got = merging.exact_merge(spark.createDataFrame([item(1, "a", refs=["y"]), item(0, "A ", refs=["x"])], ITEMS)).collect()
    assert [(r.product_service_name, r.refs) for r in got] == [("A ", ["x", "y"])]
    states = spark.createDataFrame([("n", "success"), ("n", "failed"), ("m", "success")], "notice_id string, status string")
    assert {r.notice_id: (r.request_count, r.failed, r.status) for r in merging.notice_rollup(states).collect()} == {"n": (2, 1, "partial"), "m": (1, 0, "complete")}


def test_bids_of_tables(frame):
    rows = [
        block(0, "paragraph", "项目编号：T-01\n采购人：测试学校\n"),
        block(1, "table", "", [["投标人名称", "投标报价", "排名"], ["样例公司", "13万元", "1"], ["另一公司", "9", "2"], ["现场考察", "1", "3"]]),
        block(2, "table", "", [["供应商名称", "成交金额", "中标情况"], ["样例公司", "12万元", "中标"], ["另一公司", "", "未中标"]]),
        block(3, "table", "", [["供应商名称", "报价"], ["模板公司", "1"]], source=("d2", "招标文件.doc", "x", "doc", None, None)),
    ]
    got = {r.name: r for r in candidates.bids(frame(rows)).collect()}
    assert set(got) == {"样例公司", "另一公司"}
    one = got["样例公司"]
    assert (one.amount_yuan, one.result, one.rank, one.block_id, one.block_row, one.package_no) == (130000.0, "中标", 1, "b2", 2, "默认包")
    meta = candidates.metadata(frame(rows)).first()
    assert (meta.project_no, meta.procurement_unit, meta.agency) == ("T-01", "测试学校", None)


def test_results_by_both_orders(spark):
    rows = spark.createDataFrame([("未成交", None), ("第一中标候选人", None), ("成交", None), ("", 1), ("", 2)], "v string, r int")
    assert [r[0] for r in rows.select(candidates.bid_result(F.col("v"), F.col("r"))).collect()] == ["未中标", "候选", "成交", "候选", "未知"]
    assert [r[0] for r in rows.select(candidates.model_result(F.col("v"), F.lit(False), legacy=True)).collect()][:3] == ["成交", "中标", "成交"]
    assert [r[0] for r in rows.select(candidates.model_result(F.col("v"), F.lit(False))).collect()][:3] == ["未中标", "候选", "成交"]


def test_model_bids_and_their_rows(spark, frame):
    answer = '{"packages":[{"package_id":"1","winner":{"supplier_name":"测试公司","amount":5,"row":99,"evidence_block_id":"b1"},"other_bidders":[{"org":{"name":"别的公司"},"outcome":"未中标"},{"company":"测试公司"}]}]}'
    found = candidates.model_bids(spark.createDataFrame([("N", answer)], "notice_id string, answer string"))
    got = {r.name: r for r in found.collect()}
    assert got["测试公司"].result == "中标" and got["测试公司"].amount_yuan == 5.0 and got["别的公司"].result == "未中标" and got["测试公司"].package_no == "1"
    rows = frame([block(1, "table", "", [["供应商", "价"], ["测试公司（甲）", "5"]])])
    back = {r.name: (r.block_row, r.valid) for r in candidates.recovered_rows(found.where("block_id is not null"), rows).collect()}
    assert back == {"测试公司": (2, True)}
    assert candidates.bypassed(found, 2).first().bypass
