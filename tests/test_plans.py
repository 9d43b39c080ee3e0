"""Steps that compute what they need once, however large the input: their plans, beside their results."""

from pyspark.sql import functions as F

from lodestone.operators import candidates, evaluation, extraction, flow, merging, selection
from lodestone.plans.queries import QUERIES


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_settled_columns_stay_in_one_place(spark):
    rows = spark.range(3).withColumn("a.b", F.sha2(F.col("id").cast("string").cast("binary"), 256))
    out = flow.settled(rows)
    assert out.columns == rows.columns and sorted(out.collect()) == sorted(rows.collect())
    assert plan(out.where("`a.b` > 'x' or `a.b` < 'y'")).count("sha2(") == 1


def test_enriched_columns_name_each_step_once(spark):
    rows = spark.createDataFrame([(1, ["采购标的", "品牌", "货物名称"], {"product_service_name": 0})], "id int, header array<string>, fields map<string,int>")
    out = rows.select(extraction.enrich_columns(F.col("fields"), F.col("header")).alias("m"))
    assert plan(out).count("品牌") == 1
    assert out.first()["m"] == {"product_service_name": 2, "brand_supplier": 1}


ITEMS = (
    "notice_id string, pos int, product_service_name string, category_name string, category_code string, brand_supplier string, spec_model string, "
    "unit_price double, quantity double, quantity_unit string, total_price double, refs array<string>, request_id string, confidence double, tier int"
)


def item(notice, pos, name):
    return (notice, pos, name, None, None, None, None, None, 1.0, None, None, [f"r{pos}"], "q", 0.8, 3)


def test_items_are_made_compact_once(spark):
    rows = spark.createDataFrame([item("a", 0, "x")], ITEMS)
    assert plan(merging.prioritized(rows)).count("(?U)\\s+") == 4  # name, brand, model and unit


def test_notices_are_merged_in_one_pass_over_sorted_rows(spark):
    rows = spark.createDataFrame([item(f"n{n % 50}", n, f"p{n % 3}") for n in range(450)], ITEMS)
    out = merging.merge_notices(rows, rows.select("notice_id", F.lit("t").alias("title")).distinct())
    assert "InPandas" not in plan(out)
    got = {(r["notice_id"], r["item_no"]): (r["product_service_name"], list(r["refs"])) for r in out.collect()}
    assert len(got) == 150 and got["n7", 1] == ("p1", ["r7", "r157", "r307"])


def test_files_with_one_stem_pair_only_within_their_group(spark):
    pages = spark.createDataFrame([(1, "a/f1.html"), (2, "a/f1.html")], "part long, path string")
    archives = spark.createDataFrame([(1, "b/f1.zip"), (3, "b/f1.zip")], "part long, path string")
    got = sorted((r["part"], r["stem"], r["reason"]) for r in evaluation.paired(pages, archives, 1, within=("part",)).collect())
    assert got == [(1, "f1", None), (2, "f1", "missing_html_or_zip"), (3, "f1", "missing_html_or_zip")]


def test_members_of_answers_are_found_whatever_their_spelling(spark):
    bids = ['{"name":"a"}', "{'name':'a'}", '{"n\\u0061me":"a"}', '{"other":"name"}', "name", None]
    rows = spark.createDataFrame([(b,) for b in bids], "b string")
    assert [r["n"] for r in rows.select(candidates.pick(F.col("b"), "org_name", "name").alias("n")).collect()] == ["a", "a", "a", None, None, None]


def test_bids_of_answers_parse_each_member_once(spark):
    answers = spark.createDataFrame([("n", '{"packages":[{"winner":{"supplier":"x"},"bidders":[{"org":{"name":"y"}}]}]}')], "notice_id string, answer string")
    out = candidates.model_bids(answers)
    assert plan(out.where("name > ''")).count("$.company_name") == 1
    assert sorted((r["name"], r["result"]) for r in out.collect()) == [("x", "中标"), ("y", "未知")]


def test_headers_of_bidder_tables_are_looked_for_once(spark):
    kind = "notice_id string, block_id string, pos int, type string, text string, rows array<array<string>>, source struct<file_name:string>"
    blocks = spark.createDataFrame([("n", "b", 0, "table", "", [["供应商名称", "排名"], ["某公司", "1"]], ("x",))], kind)
    out = candidates.bids(blocks)
    assert plan(out).count("评审得分") == 1
    assert [(r["name"], r["rank"]) for r in out.collect()] == [("某公司", 1)]


def test_scores_of_tables_and_texts_are_computed_once(spark):
    source = "source struct<document_id:string,file_name:string,container_path:string,file_type:string,sheet:string,page:int>"
    blocks = spark.createDataFrame([("n", "b", 0, "heading", "主要标的信息", None, ("d", "x", "x", "html", None, None))], f"notice_id string, block_id string, pos int, type string, text string, rows array<array<string>>, {source}")
    out = selection.score_texts(blocks)
    assert plan(out).count("网站标识码") == 1 and out.count() == 1
    cells = spark.createDataFrame([(["货物名称", "x", "规格型号"],), (["a"],), ([],)], "c array<string>").select(selection.match_header(F.col("c")).alias("m"))
    assert [r["m"] for r in cells.collect()] == [{"product_service_name": 0, "spec_model": 2}, {}, {}]
    assert plan(cells).count("采购人") == 1


def _planned(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_tasks_are_counted_by_the_bytes_of_the_input(spark, sf, monkeypatch):
    monkeypatch.setattr(flow, "MANY_BYTES", 1)
    monkeypatch.setattr(flow, "TASK_BYTES", 10_000)
    for name, keys in (("unit_cobid_pairs", "unit_id#"), ("unit_bidder_stats", "unit_id#"), ("graph_nodes", "project_id#")):
        rows = QUERIES[name](spark, sf)
        plan = _planned(rows)
        dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
        assert any(f"hashpartitioning({keys}" in line for line in dealt) and any("hashpartitioning(l_orderkey#" in line for line in dealt), name
        assert all(int(line.split("), REPARTITION")[0].rsplit(", ", 1)[1]) > 8 for line in dealt), name


def test_pairs_of_suppliers_meet_by_blocks(spark, sf, monkeypatch):
    from lodestone.operators import relations

    whole = QUERIES["supplier_common_units"](spark, sf).toPandas()
    monkeypatch.setattr(relations, "BLOCK", 3)
    rows = QUERIES["supplier_common_units"](spark, sf)
    assert "_a#" in _planned(rows).split("SortMergeJoin", 1)[-1] or "_a#" in _planned(rows).split("HashJoin", 1)[-1]
    order = ["unit_id", "supplier_a", "supplier_b"]
    one, two = (x.sort_values(order).reset_index(drop=True) for x in (whole, rows.toPandas()))
    assert len(one) and one.equals(two)


def test_files_are_read_once_for_all_blocks(spark):
    from lodestone.sources import readers

    calls = spark.sparkContext.accumulator(0)

    def reader(data: bytes) -> list[tuple]:
        calls.add(1)
        return [(1, "paragraph", data.decode(), None, 0.0, 0.0, 9.0, 9.0), (1, "table", "", [["x"]], 0.0, 20.0, 9.0, 29.0), (1, "page", "", None, None, None, None, None)]

    files = spark.createDataFrame([(f"d{i}", b"text") for i in range(6)], "document_id string, content binary")
    rows = readers.pdf_blocks(files, reader).collect()
    assert sorted(r.type for r in rows) == ["ocr_text"] * 6 + ["paragraph"] * 6 + ["table"] * 6
    assert calls.value == 6
