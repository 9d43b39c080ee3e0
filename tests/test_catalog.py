import pytest

from lodestone.catalog import Catalog
from lodestone.plans import carriers


def test_catalog_answers_by_the_known_names(spark, sf):
    tables = carriers.tables(spark, sf)
    c = Catalog(spark, tables)
    assert c.top_bidders(3, 2).count() == 2 and c.co_bidders(1).count() <= 5 and c.win_suppliers(3).count() > 0 and c.co_bid_pairs(3).count() > 0
    assert c.common_units("1, 2,").columns == c.common_units([1, 2]).columns and c.joint_projects([1]).count() == 0
    assert c.organizations("supplier", 3).count() == 3 and c.projects("order", 4).count() == 4
    assert {r.table_name for r in c.status().collect()} == {"projects", "packages", "organizations", "bids"}
    nodes, edges = c.subgraph(1)
    assert nodes.count() >= 2 and edges.where("type = '包含包件'").count() == 1


def test_items(spark):
    none = "category_name:string,category_code:string,brand_supplier:string,spec_model:string,source_file:string,source_block_id:string,source_block_row:int"
    notice = lambda n, *names: (n, "t", [(x, None, None, None, None, None, "b", 1) for x in names])
    frame = lambda *rows: spark.createDataFrame(list(rows), f"notice_id string, title string, items array<struct<product_service_name:string,{none}>>")
    c = Catalog(spark, {})
    c.import_task1(frame(notice("n", "a", "b"), notice("m", "c")))
    c.import_task1(frame(notice("n", "z")))
    rows, total = c.items(product="Z")
    assert total.first().total == 1 and c.item(rows.first().entity_id).count() == 1 and c["task1_entities"].count() == 2
    with pytest.raises(ValueError):
        c.items(page_size=101)


TREE = (
    "seq long, notice_id string, title string, project_no string, procurement_method string, publish_date string, source_url string, procurement_unit struct<name:string,org_type:string>, agency struct<name:string,org_type:string>, "
    "packages array<struct<package_no:string,name:string,bidders array<struct<org:struct<name:string,org_type:string>,amount_yuan:double,score:double,rank:int,result:string,quote_value:double,quote_unit:string>>,products array<struct<name:string,category_code:string,brand:string,spec_model:string,supplier:struct<name:string,org_type:string>>>>>"
).replace("bidders array", "bidders:array").replace("products array", "products:array")


def tree(seq, notice, unit, bidders, goods=()):
    bids = [((name, "投标参与方"), amount, 90.0, i + 1, "中标" if not i else "未中标", amount, "元") for i, (name, amount) in enumerate(bidders)]
    return (seq, notice, f"title {notice}", None, None, "2024-01-01", None, (unit, "采购单位"), None, [("1", None, bids, [(g, None, None, None, (bidders[0][0], "产品供应商")) for g in goods])])


@pytest.mark.parametrize("stored", [False, True])
def test_ingesting_replaces_a_notice_and_keeps_the_others(spark, tmp_path, stored):
    c = Catalog.open(spark, f"file://{tmp_path}/db") if stored else Catalog(spark, {})
    frame = lambda *rows: spark.createDataFrame(list(rows), TREE)
    c.ingest_projects(frame(tree(1, "N1", "甲大学", [("甲公司", 5.0), ("乙公司", 6.0)], ["椅子", "桌子"])))
    c.ingest_projects(frame(tree(1, "N2", "甲大学", [("甲公司", 7.0)], ["椅子"])))
    counts = lambda: {r.table_name: r.rows for r in c.status().collect()}
    assert counts() == {"projects": 2, "packages": 2, "organizations": 3, "bids": 3, "products": 2}
    won = lambda: {r.supplier_name: (r.win_count, r.total_amount_yuan) for r in c.win_suppliers(c.organizations("甲大学").first().org_id).collect()}
    assert won() == {"甲公司": (2, 12.0)}
    bid = c["bids"].where("amount_yuan = 7").first()
    assert (bid.quote_value, bid.quote_unit, bid.evidence_json) == (7.0, "元", "[]")
    # the same again changes nothing; a new tree of a notice takes its place, organizations stay
    c.ingest_projects(frame(tree(1, "N2", "甲大学", [("甲公司", 7.0)], ["椅子"])))
    assert counts()["bids"] == 3 and won() == {"甲公司": (2, 12.0)}
    c.ingest_projects(frame(tree(2, "N1", "甲大学", [("丙公司", 1.0)])))
    assert counts() == {"projects": 2, "packages": 2, "organizations": 4, "bids": 2, "products": 1} and won() == {"甲公司": (1, 7.0), "丙公司": (1, 1.0)}
    if stored:
        again = Catalog.open(spark, f"file://{tmp_path}/db")
        assert again["bids"].count() == 2 and again["unit_win_stats"].count() == 2
