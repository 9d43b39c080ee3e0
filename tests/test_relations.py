"""Relation fixture of three notices, with values derived by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import flow, relations, scenarios

ORG = "struct<name:string,org_type:string>"
TREES = (
    f"seq long, notice_id string, title string, project_no string, procurement_method string, publish_date string, source_url string, procurement_unit {ORG}, agency {ORG}, "
    f"packages array<struct<package_no:string,name:string,bidders:array<struct<org:{ORG},amount_yuan:double,score:double,rank:int,result:string>>,"
    f"products:array<struct<name:string,category_code:string,brand:string,spec_model:string,supplier:{ORG}>>>>"
)
JIA, YI, BING, DING = "甲供应商有限公司", "乙供应商有限公司", "丙供应商有限公司", "丁供应商有限公司"
UJ, UY = "测试采购单位甲", "测试采购单位乙"


def tree(seq, notice, date, unit, bids, agency=None, products=(), no="包1"):
    people = [((name, "中标供应商" if result in ("中标", "成交") else "投标参与方"), money, None, None, result) for name, money, result in bids]
    return (seq, notice, f"title {notice}", None, None, date, None, (unit, "采购单位"), agency and (agency, "代理机构"), [(no, None, people, list(products))])


FIXTURE = [
    tree(1, "SYN-001", "2026-01-01", UJ, [("甲 供应商有限公司", 100000.0, "中标"), (YI, 110000.0, "未中标"), (BING, 120000.0, "未中标")], "测试代理机构", [("样品", None, "b", None, ("产品厂家公司", "产品供应商"))]),
    tree(2, "SYN-002", "2026-02-01", UJ, [(YI, 200000.0, "成交"), (JIA, 190000.0, "未中标"), (DING, 210000.0, "未中标")]),
    tree(3, "SYN-003", "2026-03-01", UY, [(JIA, 300000.0, "中标"), (YI, 250000.0, "中标")]),
]


@pytest.fixture(scope="module")
def t(spark):
    tables, quarantine = relations.ingest(spark.createDataFrame(FIXTURE, TREES))
    assert quarantine.count() == 0
    return {name: rows.cache() for name, rows in tables.items()}


@pytest.fixture(scope="module")
def ids(t):
    return {r.name: r.org_id for r in t["organizations"].collect()}


def short(ids):
    names = {i: n.replace(" ", "")[0] if "供应商" in n else n[-1] for n, i in ids.items()}
    return lambda i: names[i]


def test_golden_ids_and_counts(t, ids):
    assert ids[UJ] == "org_eeacca57145ca89ad01b" and ids["甲 供应商有限公司"] == "org_446402ae204532f73af9" and ids[BING] == "org_1f09573e4a830a06a65f"
    assert {r.notice_id: r.project_id for r in t["projects"].collect()}["SYN-001"] == "prj_2954b23d6a02feb15c50"
    assert "pkg_c58b7e0ae29c46dd4f3a" in {r.package_id for r in t["packages"].collect()}
    counts = {r.table_name: r.rows for r in relations.counts({k: t[k] for k in ("projects", "packages", "organizations", "bids", "products")}).collect()}
    assert counts == {"projects": 3, "packages": 3, "organizations": 8, "bids": 8, "products": 1}
    assert t["alias_review_queue"].count() == 0


def test_first_spelling_and_highest_type_win(t):
    kinds = {r.name: r.org_type for r in t["organizations"].collect()}
    assert kinds["甲 供应商有限公司"] == "中标供应商" and kinds[YI] == "中标供应商" and kinds[BING] == "投标参与方" and kinds[UJ] == "采购单位"


def test_six_aggregates(t, ids):
    s = short(ids)
    u = {ids[UJ]: "Uj", ids[UY]: "Uy"}
    a = relations.refresh_aggregates(t)
    assert {(u[r.unit_id], s(r.supplier_id), r.win_count, r.total_amount_yuan, r.last_date) for r in a["unit_win_stats"].collect()} == {("Uj", "甲", 1, 100000, "2026-01-01"), ("Uj", "乙", 1, 200000, "2026-02-01"), ("Uy", "甲", 1, 300000, "2026-03-01"), ("Uy", "乙", 1, 250000, "2026-03-01")}
    assert {(u[r.unit_id], s(r.bidder_id), r.bid_count, r.win_count, r.total_win_amount_yuan) for r in a["unit_bidder_stats"].collect()} == {("Uj", "甲", 2, 1, 100000), ("Uj", "乙", 2, 1, 200000), ("Uj", "丙", 1, 0, 0), ("Uj", "丁", 1, 0, 0), ("Uy", "甲", 1, 1, 300000), ("Uy", "乙", 1, 1, 250000)}
    assert {(u[r.unit_id], s(r.bidder_a) + s(r.bidder_b), r.project_count) for r in a["unit_cobid_pairs"].collect()} == {("Uj", "甲乙", 2), ("Uj", "丙甲", 1), ("Uj", "丙乙", 1), ("Uj", "甲丁", 1), ("Uj", "乙丁", 1), ("Uy", "甲乙", 1)}
    assert {(s(r.supplier_id) + s(r.cobidder_id), r.project_count) for r in a["supplier_cobid"].collect()} == {("甲乙", 2), ("甲丙", 1), ("乙甲", 2), ("乙丁", 1)}
    assert {(s(r.supplier_a) + s(r.supplier_b), u[r.unit_id], r.win_count, r.total_amount_yuan) for r in a["supplier_common_units"].collect()} == {("甲乙", "Uj", 2, 300000), ("甲乙", "Uy", 2, 550000)}
    assert sorted(r.participant_amount_yuan for r in a["supplier_joint_projects"].collect()) == [210000, 220000, 230000, 390000, 400000, 410000, 550000]


def test_scenarios(t, ids):
    pair = [ids["甲 供应商有限公司"], ids[YI], ids[YI]]
    rows = scenarios.common_units(t, pair).collect()
    assert [(r.unit_name, r.matched_suppliers, r.project_count, r.total_amount_yuan) for r in rows] == [(UJ, 2, 2, 300000), (UY, 2, 1, 550000)]
    rows = scenarios.joint_projects(t, pair).collect()
    assert [(r.notice_id, r.participant_amount_yuan, r.results) for r in rows] == [("SYN-003", 550000, "中标"), ("SYN-002", 390000, "成交,未中标"), ("SYN-001", 210000, "中标,未中标")]
    assert scenarios.common_units(t, pair[:1]).count() == 0 and scenarios.joint_projects(t, []).count() == 0
    top = scenarios.unit_top_bidders(relations.unit_bidder_stats(t), t["organizations"], ids[UJ], 2).collect()
    assert {r.bidder_id for r in top} == set(pair) and scenarios.unit_top_bidders(relations.unit_bidder_stats(t), t["organizations"], ids[UJ], 0).count() == 1
    assert [r.name for r in scenarios.organizations(t["organizations"], "丙").collect()] == [BING]
    assert [r.notice_id for r in scenarios.projects(t["projects"], "syn").collect()] == ["SYN-003", "SYN-002", "SYN-001"]


def test_ingest_again_changes_nothing_and_duplicates_are_set_aside(spark, t):
    again = relations.ingest(spark.createDataFrame([*FIXTURE, (4, *FIXTURE[0][1:])], TREES))[0]
    assert again["bids"].count() == 8 and again["projects"].count() == 3
    twice = tree(5, "SYN-009", None, UJ, [(JIA, 1.0, "中标"), ("甲供应商 有限公司", 2.0, "未中标")])
    tables, quarantine = relations.ingest(spark.createDataFrame([*FIXTURE, twice], TREES))
    assert [r.notice_id for r in quarantine.collect()] == ["SYN-009"] and tables["projects"].count() == 3


def test_one_project_with_two_packages(spark):
    people = lambda rows: [((n, "投标参与方"), m, None, None, r) for n, m, r in rows]
    packages = [("p1", None, people([("A有限公司", 10.0, "中标"), ("B有限公司", 20.0, "未中标")]), []), ("p2", None, people([("A有限公司", 30.0, "中标"), ("B有限公司", 40.0, "中标")]), [])]
    t, _ = relations.ingest(spark.createDataFrame([(1, "P", "t", None, None, None, None, ("U单位", "采购单位"), None, packages)], TREES))
    a = {k: v.collect() for k, v in relations.refresh_aggregates(t).items()}
    assert sorted((r.win_count, r.total_amount_yuan) for r in a["unit_win_stats"]) == [(1, 40), (2, 40)]
    assert sorted((r.bid_count, r.win_count, r.total_win_amount_yuan) for r in a["unit_bidder_stats"]) == [(2, 1, 40), (2, 2, 40)]
    assert [r.project_count for r in a["unit_cobid_pairs"]] == [1] and [r.project_count for r in a["supplier_cobid"]] == [1, 1]
    assert [(r.win_count, r.total_amount_yuan) for r in a["supplier_common_units"]] == [(3, 80)]
    assert sorted(r.participant_amount_yuan for r in a["supplier_joint_projects"]) == [30, 70]


def test_graph(t, ids):
    project = next(r.project_id for r in t["projects"].collect() if r.notice_id == "SYN-001")
    nodes, edges = (x.collect() for x in scenarios.project_subgraph(t, project))
    kinds = {r.name: r.type for r in nodes}
    assert kinds["甲 供应商有限公司"] == "中标供应商" and kinds[YI] == "投标参与方" and kinds["样品"] == "产品" and kinds["产品厂家公司"] == "产品供应商" and kinds["包1"] == "包件"
    assert sorted(r.type for r in edges) == sorted(["采购单位", "代理机构", "包含包件", "中标", "未中标", "未中标", "包含产品", "供应"])
    assert all(not x.count() for x in scenarios.project_subgraph(t, "prj_none"))
    degree = {r.id: r.degree for r in scenarios.degrees(scenarios.project_subgraph(t, project)[1]).collect()}
    assert degree[project] == 3


def test_resolution_and_small_tools(spark):
    orgs = spark.createDataFrame([("a", "o1"), ("b", "o2")], "name_norm string, org_id string")
    aliases = spark.createDataFrame([("c", "o2"), ("a", "o9")], "alias_norm string, org_id string")
    names = spark.createDataFrame([("a",), ("c",), ("d",)], "name_norm string")
    assert {r.name_norm: r.org_id for r in relations.resolve_orgs(names, orgs, aliases).collect()} == {"a": "o1", "c": "o2", "d": None}
    old = spark.createDataFrame([("b1", 1.0)], "bid_id string, amount double")
    assert set(relations.migrate(old).columns) == {"bid_id", "amount", "quote_value", "quote_unit", "quote_text", "evidence_json"}
    new = spark.createDataFrame([("b1", 2.0), ("b2", 3.0)], "bid_id string, amount double")
    assert sorted(r.amount for r in relations.upsert(old, new, "bid_id").collect()) == [2.0, 3.0]
    rows = spark.createDataFrame([("k", 2, "y"), ("k", 1, "x")], "k string, seq int, v string")
    assert relations.first_wins(rows, ["k"]).first().v == "x" and flow.latest(rows, ["k"], ["seq"]).first().v == "y"


def test_alias_candidates_equal_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = set()
    while len(names) < 60:
        base = "".join(rng.choice("上海北京科技贸易发展工程设备") for _ in range(rng.randint(6, 14))) + "有限公司"
        names.add(base)
        i = rng.randrange(len(base))
        names.add(base[:i] + rng.choice("新中大") + base[i + 1 :])
    order = sorted(names, key=lambda n: rng.random())
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "name_norm string, first_seq long").withColumn("org_id", X.stable_id("org", F.col("name_norm")))
    got = {round(r.similarity, 9) for r in relations.alias_candidates(frame).collect()}
    pairs = [SequenceMatcher(None, new, old).ratio() for i, new in enumerate(order) for old in order[:i]]
    want = [r for r in pairs if 0.88 <= r < 1]
    assert len(want) > 20 and relations.alias_candidates(frame).count() == len(want) and got == {round(r, 9) for r in want}


def test_dense_packages_collapse(spark):
    rows = spark.createDataFrame([("p", i, f"n{i}", i if i < 3 else None, float(i)) for i in range(12)], "package_id string, org_id int, name string, rank int, score double")
    got = {r.node: (r.place, r.members) for r in scenarios.collapse_dense(rows, 8).collect()}
    assert got["others"] == (9, 4) and got["0"] == (1, 1) and got["11"] == (4, 1) and len(got) == 9
    chart = scenarios.chart_rows(spark.createDataFrame([("a", 0, 5), ("b", 2, 1)], "unit_name string, win_count int, bid_count int"), ["supplier_name", "unit_name"], ["win_count", "bid_count"])
    assert [(r.label, r.value) for r in chart.collect()] == [("a", 5.0), ("b", 2.0)]
