"""The five business scenarios, searches, and the graph of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from . import flow
from .relations import Tables, won


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def organizations(orgs: DataFrame, query: str = "", normalized: str | None = None, limit: int = 50) -> DataFrame:
    """F-05: name or normalized name holds the query; by name."""
    name_norm = F.col("name_norm") if "name_norm" in orgs.columns else F.lower(F.col("name"))
    hit = X.ascii_like(F.col("name"), query) | X.ascii_like(name_norm, normalized if normalized is not None else query)
    return orgs.where(hit).orderBy("name", "org_id").limit(clamp(limit, 1, 5000))


def projects(rows: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    """F-06: title, notice or number holds the query; newest first."""
    hit = X.ascii_like(F.col("title"), query) | X.ascii_like(F.col("notice_id"), query) | X.ascii_like(F.col("project_no"), query)
    found = rows.where(hit).select("project_id", "notice_id", "title", "project_no", "publish_date")
    return found.orderBy(F.coalesce("publish_date", F.lit("")).desc(), "title", "project_id").limit(clamp(limit, 1, 5000))


def _named(rows: DataFrame, orgs: DataFrame, key: str, name: str) -> DataFrame:
    """J-06."""
    return rows.join(orgs.select(F.col("org_id").alias(key), F.col("name").alias(name)), key)


def alias_review_queue(queue: DataFrame, orgs: DataFrame, limit: int = 100) -> DataFrame:
    """K-07: pending pairs of names, most similar first."""
    rows = queue.where("status = 'pending'") if "status" in queue.columns else queue
    rows = _named(_named(rows, orgs, "left_org_id", "left_name"), orgs, "right_org_id", "right_name")
    return rows.orderBy(F.desc("similarity"), "review_id").limit(clamp(limit, 1, 500))


def unit_win_suppliers(stats: DataFrame, orgs: DataFrame, unit_id=None) -> DataFrame:
    """K-03, scenario 1: who wins from a buyer (all buyers, if none is given)."""
    rows = stats if unit_id is None else stats.where(F.col("unit_id") == unit_id)
    return _named(rows, orgs, "supplier_id", "supplier_name").orderBy(F.desc("win_count"), F.desc("total_amount_yuan"), "unit_id", "supplier_id")


def unit_top_bidders(stats: DataFrame, orgs: DataFrame, unit_id, top: int = 5) -> DataFrame:
    """K-04, scenario 2."""
    rows = _named(stats.where(F.col("unit_id") == unit_id), orgs, "bidder_id", "bidder_name")
    return rows.orderBy(F.desc("bid_count"), F.desc("win_count"), "bidder_id").limit(clamp(top, 1, 100))


def unit_cobid_pairs(stats: DataFrame, orgs: DataFrame, unit_id) -> DataFrame:
    """K-05, scenario 2."""
    rows = _named(_named(stats.where(F.col("unit_id") == unit_id), orgs, "bidder_a", "bidder_a_name"), orgs, "bidder_b", "bidder_b_name")
    return rows.orderBy(F.desc("project_count"), "bidder_a", "bidder_b")


def supplier_cobidders(stats: DataFrame, orgs: DataFrame, supplier_id, top: int = 5) -> DataFrame:
    """K-06, scenario 3."""
    rows = _named(stats.where(F.col("supplier_id") == supplier_id), orgs, "cobidder_id", "cobidder_name")
    return rows.orderBy(F.desc("project_count"), "cobidder_id").limit(clamp(top, 1, 100))


def common_units(t: Tables, supplier_ids: list) -> DataFrame:
    """A-07, J-07, F-09, scenario 4: buyers from which all given suppliers have won (fewer than two: nothing)."""
    ids = list(dict.fromkeys(supplier_ids))
    units = t["project_units"].where(F.col("role") == L.UNIT_ROLE).select("project_id", F.col("org_id").alias("unit_id"))
    bids = t["bids"].where(won(F.col("result")) & F.col("org_id").isin(*ids))
    rows = bids.join(t["packages"].select("package_id", "project_id"), "package_id").join(units, "project_id")
    out = rows.groupBy("unit_id").agg(
        F.countDistinct("org_id").alias("matched_suppliers"), F.countDistinct("project_id").alias("project_count"), F.coalesce(F.sum("amount_yuan"), F.lit(0)).cast("double").alias("total_amount_yuan")
    )
    out = _named(out.where((F.col("matched_suppliers") == len(ids)) & F.lit(len(ids) > 1)), t.get("units", t["organizations"]), "unit_id", "unit_name")
    return out.orderBy(F.desc("project_count"), "unit_id")


def joint_projects(t: Tables, supplier_ids: list) -> DataFrame:
    """A-08, J-07, scenario 5: packages for which all given suppliers bid, whatever came of it."""
    ids = list(dict.fromkeys(supplier_ids))
    rows = t["bids"].where(F.col("org_id").isin(*ids)).groupBy("package_id").agg(
        F.countDistinct("org_id").alias("matched_suppliers"),
        F.coalesce(F.sum("amount_yuan"), F.lit(0)).cast("double").alias("participant_amount_yuan"),
        F.array_join(F.array_sort(F.collect_set("result")), ",").alias("results"),
    )
    rows = rows.where((F.col("matched_suppliers") == len(ids)) & F.lit(len(ids) > 1)).join(t["packages"].select("package_id", "project_id", "package_no"), "package_id")
    out = rows.join(t["projects"].select("project_id", "notice_id", "title", "publish_date"), "project_id")
    return out.orderBy(F.desc_nulls_last("publish_date"), "title", "package_id").drop("publish_date")


def graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """G-01: nodes and edges of every project.  A node's last mention gives its type, as units, packages, bids and
    products are read in that order; filter on project_id for one project (an unknown id gives an empty graph).  Edges of
    bids carry amount, quote, score and rank, as far as the bids have them."""
    orgs = t["organizations"].select("org_id", "name")
    units_named = t.get("units", t["organizations"]).select("org_id", "name")
    prj = t["projects"].select("project_id", F.col("title").alias("name"))
    text = lambda c: F.col(c).cast("string")
    node = lambda rows, key, name, kind, order: rows.select(text("project_id").alias("project_id"), text(key).alias("id"), F.col(name).alias("name"), kind.alias("type"), order.alias("ord"))
    units = t["project_units"].join(units_named, "org_id")
    packages = t["packages"].select("package_id", "project_id", F.coalesce("name", "package_no").alias("name"))
    bids = t["bids"].join(packages.select("package_id", "project_id"), "package_id").join(orgs, "org_id")
    kind = F.when(won(F.col("result")), "中标供应商").otherwise("投标参与方")
    place = lambda step, *keys: F.concat_ws("|", F.lit(step), *[F.lpad(text(k), 24, "0") for k in keys])
    nodes = [
        node(prj.withColumn("id", F.col("project_id")), "id", "name", F.lit("项目"), F.lit("0")),
        node(units, "org_id", "name", F.col("role"), place("1", "org_id")),
        node(packages, "package_id", "name", F.lit("包件"), place("2", "package_id")),
        node(bids, "org_id", "name", kind, place("2", "package_id", "org_id")),
    ]
    known = {"amount_yuan": "double", "quote_value": "double", "quote_unit": "string", "quote_text": "string", "score": "double", "rank": "int"}

    def edge(rows: DataFrame, source: str, target: str, label: Column, facts: bool = False) -> DataFrame:
        more = [(F.col(c) if facts and c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in known.items()]
        return rows.select(text("project_id").alias("project_id"), text(source).alias("source"), text(target).alias("target"), label.alias("type"), *more)

    edges = [
        edge(units.withColumn("p", F.col("project_id")), "p", "org_id", F.col("role")),
        edge(packages.withColumn("p", F.col("project_id")), "p", "package_id", F.lit("包含包件")),
        edge(bids, "org_id", "package_id", F.col("result"), facts=True),
    ]
    if "package_products" in t:
        goods = t["package_products"].join(packages.select("package_id", "project_id"), "package_id").join(t["products"], "product_id")
        nodes.append(node(goods, "product_id", "name", F.lit("产品"), place("3", "package_id", "product_id")))
        edges.append(edge(goods, "package_id", "product_id", F.lit("包含产品")))
        if "supplier_org_id" in t["products"].columns:
            makers = goods.drop("name").join(orgs.select(F.col("org_id").alias("supplier_org_id"), "name"), "supplier_org_id")
            nodes.append(node(makers, "supplier_org_id", "name", F.lit("产品供应商"), place("3", "package_id", "product_id", "supplier_org_id")))
            edges.append(edge(makers, "supplier_org_id", "product_id", F.lit("供应")))
    both = nodes[0]
    for more in nodes[1:]:
        both = both.union(more)
    lines = edges[0]
    for more in edges[1:]:
        lines = lines.union(more)
    return flow.dealt(both, "project_id").groupBy("project_id", "id").agg(F.max_by("name", "ord").alias("name"), F.max_by("type", "ord").alias("type")), lines


def project_subgraph(t: Tables, project_id) -> tuple[DataFrame, DataFrame]:
    """G-01 for one project; the filter reaches the scans of all its tables."""
    own = {name: rows.where(F.col("project_id") == project_id) if "project_id" in rows.columns else rows for name, rows in t.items()}
    for name in ("bids", "package_products"):
        if name in own:
            own[name] = own[name].join(own["packages"].select("package_id"), "package_id", "left_semi")
    return graph(own)


def degrees(edges: DataFrame) -> DataFrame:
    """A-31, G-03: edges at each node of a project."""
    ends = edges.select("project_id", F.col("source").alias("id")).union(edges.select("project_id", "target"))
    return ends.groupBy("project_id", "id").agg(F.count("*").alias("degree"))


def collapse_dense(bids: DataFrame, keep: int = 8) -> DataFrame:
    """W-14, G-02: the first ``keep`` bidders of a package by rank, score and name; the rest is one counted node."""
    from pyspark.sql import Window

    order = Window.partitionBy("package_id").orderBy(F.col("rank").asc_nulls_last(), F.coalesce("score", F.lit(-1.0)).desc(), "name", "org_id")
    rows = bids.withColumn("place", F.row_number().over(order))
    shown = rows.where(F.col("place") <= keep).select("package_id", F.col("org_id").cast("string").alias("node"), F.col("place").cast("long").alias("place"), F.lit(1).cast("long").alias("members"))
    rest = rows.where(F.col("place") > keep).groupBy("package_id").agg(F.count("*").alias("members"))
    return shown.union(rest.select("package_id", F.lit("others").alias("node"), F.lit(keep + 1).cast("long").alias("place"), "members"))


def chart_rows(rows: DataFrame, labels: list[str], measures: list[str], top: int = 10) -> DataFrame:
    """K-15: label and value of the first rows; the first label there is, the first measure that is not 0."""
    value = F.coalesce(*[F.nullif(F.col(m).cast("double"), F.lit(0.0)) for m in measures if m in rows.columns], F.lit(0.0))
    return rows.limit(top).select(F.coalesce(*[F.col(x).cast("string") for x in labels if x in rows.columns]).alias("label"), value.alias("value"))
