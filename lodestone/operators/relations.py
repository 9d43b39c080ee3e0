"""Relation store: entity resolution, ingest, and the six aggregates.

All functions take and return DataFrames.  Money is summed as decimals and becomes double at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from . import flow

Tables = dict[str, DataFrame]
#: Suppliers of a buyer in one block, of which each two are paired by one task.
BLOCK = 2048


def won(result: Column) -> Column:
    """F-08."""
    return result.isin(*L.WON)


def _unit_bids(t: Tables, winners: bool = False) -> DataFrame:
    """J-01: bids with their buyer, project and date.  ``winners`` filters before the joins."""
    bids = t["bids"].where(won(F.col("result"))) if winners else t["bids"]
    units = t["project_units"].where(F.col("role") == L.UNIT_ROLE).select("project_id", F.col("org_id").alias("unit_id"))
    return bids.join(t["packages"].select("package_id", "project_id"), "package_id").join(units, "project_id")


def unit_win_stats(t: Tables) -> DataFrame:
    """A-01: packages won, money and last date by buyer and supplier."""
    rows = _unit_bids(t, winners=True).join(t["projects"].select("project_id", "publish_date"), "project_id")
    return rows.groupBy("unit_id", F.col("org_id").alias("supplier_id")).agg(
        F.countDistinct("package_id").alias("win_count"), F.coalesce(F.sum("amount_yuan"), F.lit(0)).cast("double").alias("total_amount_yuan"), F.max("publish_date").alias("last_date")
    )


def unit_bidder_stats(t: Tables) -> DataFrame:
    """A-02: packages bid for and won, and money won, by buyer and bidder."""
    hit = won(F.col("result"))
    rows = flow.dealt(_unit_bids(t).select("unit_id", F.col("org_id").alias("bidder_id"), "package_id", "result", "amount_yuan"), "unit_id", "bidder_id")
    return rows.groupBy("unit_id", "bidder_id").agg(
        F.countDistinct("package_id").alias("bid_count"),
        F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("win_count"),
        F.coalesce(F.sum(F.when(hit, F.col("amount_yuan")).otherwise(0)), F.lit(0)).cast("double").alias("total_win_amount_yuan"),
    )


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    return left.join(right, keys).where(condition)


def unit_cobid_pairs(t: Tables) -> DataFrame:
    """A-03, J-02: projects in which two suppliers bid for one package, by buyer.

    A package's bidders meet its buyer as one list; pairs are made from the list, carry ids only and are counted where they
    are dealt to, as few of them repeat within a task.
    """
    met = t["bids"].groupBy("package_id").agg(F.sort_array(F.collect_set("org_id")).alias("orgs")).where("size(orgs) > 1").join(t["packages"].select("package_id", "project_id"), "package_id")
    units = t["project_units"].where(F.col("role") == L.UNIT_ROLE).select("project_id", F.col("org_id").alias("unit_id"))
    one = met.join(units, "project_id").select("project_id", "unit_id", "orgs", F.posexplode("orgs").alias("_n", "bidder_a"))
    rows = one.select("project_id", "unit_id", "bidder_a", F.explode(F.expr("slice(orgs, _n + 2, size(orgs))")).alias("bidder_b"))
    return flow.dealt(rows, "unit_id", "bidder_a", "bidder_b").groupBy("unit_id", "bidder_a", "bidder_b").agg(F.countDistinct("project_id").alias("project_count"))


def supplier_cobid(t: Tables) -> DataFrame:
    """A-04, J-03: projects in which a winner met another bidder."""
    winners = t["bids"].where(won(F.col("result"))).select("package_id", F.col("org_id").alias("supplier_id"))
    others = t["bids"].select("package_id", F.col("org_id").alias("cobidder_id"))
    rows = _pairs(winners, others, ["package_id"], F.col("cobidder_id") != F.col("supplier_id")).join(t["packages"].select("package_id", "project_id"), "package_id")
    return rows.groupBy("supplier_id", "cobidder_id").agg(F.countDistinct("project_id").alias("project_count"))


def supplier_common_units(t: Tables) -> DataFrame:
    """A-05, J-04: wins by buyer and supplier first, then pairs of suppliers of one buyer.

    Rows are as many as the square of a buyer's suppliers.  So these are dealt to blocks of ``BLOCK`` by id, and each two
    blocks of a buyer meet as one task's work: memory of a task depends on the block alone.
    """
    rows = flow.dealt(_unit_bids(t, winners=True).select("unit_id", "org_id", "package_id", "amount_yuan"), "unit_id", "org_id")
    rows = rows.groupBy("unit_id", "org_id").agg(F.countDistinct("package_id").alias("n"), F.coalesce(F.sum("amount_yuan"), F.lit(0)).alias("m"))
    sizes = rows.groupBy("unit_id").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    rows = rows.join(sizes, "unit_id").withColumn("_own", F.pmod(F.xxhash64("org_id"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    one = rows.select("unit_id", F.col("org_id").alias("supplier_a"), F.col("n").alias("_n"), F.col("m").alias("_m"), F.col("_own").alias("_a"), F.col("_other").alias("_b"))
    two = rows.select("unit_id", F.col("org_id").alias("supplier_b"), "n", "m", F.col("_other").alias("_a"), F.col("_own").alias("_b"))
    return _pairs(one, two, ["unit_id", "_a", "_b"], F.col("supplier_a") < F.col("supplier_b")).select(
        "supplier_a", "supplier_b", "unit_id", (F.col("n") + F.col("_n")).alias("win_count"), (F.col("m") + F.col("_m")).cast("double").alias("total_amount_yuan")
    )


def supplier_joint_projects(t: Tables) -> DataFrame:
    """A-06, J-05: pairs of bidders of one package with their money."""
    money = F.coalesce("amount_yuan", F.lit(0))
    one = t["bids"].select("package_id", F.col("org_id").alias("supplier_a"), money.alias("_m"))
    two = t["bids"].select("package_id", F.col("org_id").alias("supplier_b"), money.alias("m"))
    rows = _pairs(one, two, ["package_id"], F.col("supplier_a") < F.col("supplier_b")).join(t["packages"].select("package_id", "project_id"), "package_id")
    return rows.select("supplier_a", "supplier_b", "project_id", "package_id", (F.col("m") + F.col("_m")).cast("double").alias("participant_amount_yuan"))


AGGREGATES = {
    "unit_win_stats": unit_win_stats,
    "unit_bidder_stats": unit_bidder_stats,
    "unit_cobid_pairs": unit_cobid_pairs,
    "supplier_cobid": supplier_cobid,
    "supplier_common_units": supplier_common_units,
    "supplier_joint_projects": supplier_joint_projects,
}


def refresh_aggregates(t: Tables) -> Tables:
    """M-03: all six, from scratch."""
    return {name: build(t) for name, build in AGGREGATES.items()}


def counts(t: Tables) -> DataFrame:
    """A-09: rows of each table."""
    out = None
    for name, rows in t.items():
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.union(one)
    return out


def orphan_products(products: DataFrame, package_products: DataFrame) -> DataFrame:
    """J-09: products that no package has."""
    return products.join(package_products.select("product_id"), "product_id", "left_anti")


def resolve_orgs(names: DataFrame, organizations: DataFrame, aliases: DataFrame) -> DataFrame:
    """J-08: org_id of each ``name_norm``, by name first, then by alias.  Two equi-joins, never an OR."""
    own = organizations.select("name_norm", F.col("org_id").alias("_own"))
    other = aliases.groupBy(F.col("alias_norm").alias("name_norm")).agg(F.min("org_id").alias("_alias"))
    return names.join(own, "name_norm", "left").join(other, "name_norm", "left").withColumn("org_id", F.coalesce("_own", "_alias")).drop("_own", "_alias")


def ensure_orgs(mentions: DataFrame) -> DataFrame:
    """M-02: organizations from mentions (name, org_type, seq): the first spelling and the highest type, first seen."""
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in L.ORG_PRIORITY.items() for x in item]), F.col("org_type")), F.lit(0))
    rows = mentions.withColumn("name_norm", X.normalize_org_name(F.col("name"))).where("name_norm <> ''")
    return rows.groupBy("name_norm").agg(
        F.min_by("name", "seq").alias("name"), F.max_by("org_type", F.struct(priority, -F.col("seq"))).alias("org_type"), F.min("seq").alias("first_seq")
    ).select(X.stable_id("org", F.col("name_norm")).alias("org_id"), "name", "name_norm", "org_type", "first_seq")


def alias_candidates(orgs: DataFrame, least: float = L.ALIAS_LEAST, gram: int = 2) -> DataFrame:
    """J-20, X-12: pairs of similar organization names for review, the later name against the earlier.

    With r the least ratio, at most ``(1 - r) * (n + m)`` characters of two names of n and m are unmatched, and each
    spoils two pairs of neighbouring characters at most.  So both names hold one of the ``4 * n * (1 - r) / r + 2``
    pairs that are rarest among all names (a prefix filter, exact for any fixed order).  Candidates meet there and on
    length, never in a cross join; the exact ratio decides.
    """
    rows = orgs.where(F.length("name_norm") >= 2).select("org_id", "name_norm", "first_seq", F.length("name_norm").alias("n"))

    pieces = rows.select("org_id", "name_norm", "first_seq", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - gram + 1)), lambda i: F.substring("name_norm", i, F.lit(gram))))).alias("piece"))
    common = pieces.groupBy("piece").agg(F.count("*").alias("holders"))
    turn = F.row_number().over(Window.partitionBy("org_id").orderBy("holders", "piece"))
    # a name of n characters has n - 1 pairs; each unmatched character spoils two at most, on either side
    spoiled = F.floor(F.col("n") * 4 * (1 - least) / least) + 1
    rare = pieces.join(common, "piece").withColumn("_turn", turn).where(F.col("_turn") <= F.least(F.col("n"), spoiled + 1)).drop("_turn", "holders")
    other = rare.select(F.col("org_id").alias("old_id"), F.col("name_norm").alias("old_name"), F.col("first_seq").alias("_seq"), F.col("n").alias("_n"), "piece")
    met = rare.where("n >= 4").join(other, "piece").where((F.col("first_seq") > F.col("_seq")) & (2.0 * F.least("n", "_n") / (F.col("n") + F.col("_n")) >= least))
    met = met.select("org_id", "name_norm", "old_id", "old_name").distinct()
    # characters that both names have, each as often as both do, bound the ratio too
    bag = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), i, F.lit(1)), (F.length(F.substring(F.col(c), F.lit(1), i)) - F.length(F.replace(F.substring(F.col(c), F.lit(1), i), F.substring(F.col(c), i, F.lit(1)), F.lit("")))).cast("string")))
    shared = F.size(F.array_intersect(bag("name_norm"), bag("old_name")))
    met = met.where(2.0 * shared / (F.length("name_norm") + F.length("old_name")) >= least)
    found = met.withColumn("similarity", X.sequence_ratio("name_norm", "old_name")).where((F.col("similarity") >= least) & (F.col("similarity") < 1))
    left, right = F.least("org_id", "old_id"), F.greatest("org_id", "old_id")
    return found.select(X.stable_id("alias", left, right).alias("review_id"), left.alias("left_org_id"), right.alias("right_org_id"), "similarity").dropDuplicates(["review_id"])


#: What else is known of a bid, with its type; trees that lack one give null, evidence an empty list.
BID_FACTS = {"quote_value": "double", "quote_unit": "string", "quote_text": "string", "qualification": "string", "compliance": "string", "evidence_json": "string"}


def _facts(bids: DataFrame) -> list[Column]:
    held = bids.schema["b"].dataType.fieldNames()
    out = {c: (F.col(f"b.{c}") if c in held else F.lit(None)).cast(kind) for c, kind in BID_FACTS.items()}
    return [(F.coalesce(v, F.lit("[]")) if c == "evidence_json" else v).alias(c) for c, v in out.items()]


def ingest(trees: DataFrame) -> tuple[Tables, DataFrame]:
    """M-01: project trees to the nine tables; trees with duplicates inside are set aside (second result).

    ``trees``: seq long, notice_id, title, project_no, procurement_method, publish_date, source_url,
    procurement_unit / agency struct<name, org_type>, packages array<struct<package_no, name, bidders array<struct<org
    struct<name, org_type>, amount_yuan, score, rank, result, and what :data:`BID_FACTS` names>>, products array<struct<name, category_code, brand,
    spec_model, supplier struct<name, org_type>>>>>.  The last tree of a notice counts.
    """
    last = trees.withColumn("_turn", F.row_number().over(Window.partitionBy("notice_id").orderBy(F.desc("seq")))).where("_turn = 1").drop("_turn")
    last = last.withColumn("project_id", X.stable_id("prj", F.col("notice_id")))
    packages = last.select("seq", "project_id", F.posexplode("packages").alias("_p", "k")).select(
        "seq", "project_id", "_p", F.coalesce(F.nullif(F.trim("k.package_no"), F.lit("")), F.lit(L.DEFAULT_PACKAGE)).alias("package_no"), F.col("k.name").alias("name"), "k.bidders", "k.products"
    ).withColumn("package_id", X.stable_id("pkg", F.col("project_id"), F.col("package_no")))
    bids = packages.select("seq", "project_id", "package_id", "_p", F.posexplode("bidders").alias("_b", "b")).withColumn("name_norm", X.normalize_org_name(F.col("b.org.name")))
    twice = packages.groupBy("project_id", "package_id").count().where("count > 1").select("project_id").union(
        bids.groupBy("project_id", "package_id", "name_norm").count().where("count > 1").select("project_id")
    ).distinct()
    quarantine = last.join(twice, "project_id", "left_semi").select("notice_id", F.lit("duplicate package or bidder").alias("reason"))
    last, packages, bids = (x.join(twice, "project_id", "left_anti") for x in (last, packages, bids))
    goods = packages.select("seq", "project_id", "package_id", "_p", F.posexplode("products").alias("_g", "g"))
    # organizations are seen in the order: unit, agency, then package by package bidders before products
    order = lambda *parts: F.col("seq") * 10**12 + sum(p * 10**e for p, e in zip(parts, (8, 7, 0)))
    seen = last.where("procurement_unit is not null").select("procurement_unit.*", F.col("seq").alias("_s"), (F.col("seq") * 10**12).alias("seq"))
    seen = seen.select("name", "org_type", "seq").union(last.where("agency is not null").select(F.col("agency.name"), F.col("agency.org_type"), (F.col("seq") * 10**12 + 1).alias("seq")))
    seen = seen.union(bids.select("b.org.name", "b.org.org_type", order(F.col("_p") + 1, F.lit(0), F.col("_b"))))
    seen = seen.union(goods.where("g.supplier is not null").select("g.supplier.name", "g.supplier.org_type", order(F.col("_p") + 1, F.lit(1), F.col("_g"))))
    organizations = ensure_orgs(seen)
    org = lambda name: X.stable_id("org", X.normalize_org_name(name))
    goods = goods.withColumn("supplier_org_id", F.when(F.col("g.supplier").isNotNull(), org(F.col("g.supplier.name"))))
    goods = goods.withColumn("product_id", X.stable_id("prd", F.col("g.name"), F.col("g.category_code"), F.col("g.brand"), F.col("g.spec_model"), F.col("supplier_org_id")))
    tables = {
        "organizations": organizations.select("org_id", "name", "name_norm", "org_type", "first_seq"),
        "projects": last.select("project_id", "notice_id", "title", "project_no", "procurement_method", "publish_date", "source_url"),
        "project_units": last.where("procurement_unit is not null").select("project_id", org(F.col("procurement_unit.name")).alias("org_id"), F.lit(L.UNIT_ROLE).alias("role")).union(
            last.where("agency is not null").select("project_id", org(F.col("agency.name")), F.lit(L.AGENCY_ROLE))
        ),
        "packages": packages.select("package_id", "project_id", "package_no", "name"),
        "bids": bids.withColumn("org_id", X.stable_id("org", F.col("name_norm"))).select(
            X.stable_id("bid", F.col("package_id"), F.col("org_id")).alias("bid_id"), "package_id", "org_id", F.col("b.amount_yuan").cast("decimal(20,4)").alias("amount_yuan"), "b.score", "b.rank", "b.result", *_facts(bids)
        ),
        "products": goods.select("product_id", "g.name", "g.category_code", "g.brand", "g.spec_model", "supplier_org_id").dropDuplicates(["product_id"]),
        "package_products": goods.select("package_id", "product_id").distinct(),
        "org_aliases": organizations.select(F.col("name_norm").alias("alias_norm"), "org_id").where("false"),
        "alias_review_queue": alias_candidates(organizations),
    }
    return tables, quarantine


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """SNK-05, M-01: incoming rows replace all stored rows of their keys."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def merged(stored: Tables, made: Tables) -> Tables:
    """M-01, SNK-06: stored tables with ingested ones.  What is stored of the ingested notices goes, from projects down
    to bids and products that no package has any more; organizations are never deleted, keep their first spelling and
    take the higher type; similar names are looked for among old and new ones.
    """
    if not stored.get("projects"):
        return dict(made)
    stored = {n: rows for n, rows in stored.items() if n in made}
    gone = made["projects"].select("project_id").distinct()
    lost = stored["packages"].join(gone, "project_id", "left_semi").select("package_id")
    out = {}
    for name, key, dead in (("projects", "project_id", gone), ("project_units", "project_id", gone), ("packages", "project_id", gone), ("bids", "package_id", lost), ("package_products", "package_id", lost)):
        kept = stored[name].join(dead, key, "left_anti") if name in stored else None
        out[name] = made[name] if kept is None else kept.unionByName(made[name], allowMissingColumns=True)
    goods = stored["products"].withColumn("_new", F.lit(0)).unionByName(made["products"].withColumn("_new", F.lit(1)), allowMissingColumns=True) if "products" in stored else made["products"].withColumn("_new", F.lit(1))
    out["products"] = first_wins(goods, ["product_id"], "_new").drop("_new").join(out["package_products"].select("product_id"), "product_id", "left_semi")
    old, new = stored["organizations"], made["organizations"]
    old = old if "first_seq" in old.columns else old.withColumn("first_seq", F.lit(0).cast("long"))
    last = old.agg(F.coalesce(F.max("first_seq"), F.lit(0)).alias("_last"))
    # one row is broadcast: new names are seen after all stored ones
    new = new.join(F.broadcast(last.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).withColumn("first_seq", F.col("_last") + 1 + F.col("first_seq")).drop("_last", "_k")
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in L.ORG_PRIORITY.items() for x in item]), F.col("org_type")), F.lit(0))
    out["organizations"] = both.groupBy("org_id").agg(F.min_by("name", "_new").alias("name"), F.min_by("name_norm", "_new").alias("name_norm"), F.max_by("org_type", F.struct(priority, -F.col("_new"))).alias("org_type"), F.min("first_seq").alias("first_seq"))
    out["org_aliases"] = stored.get("org_aliases", made["org_aliases"])
    queue = alias_candidates(out["organizations"])
    held = stored.get("alias_review_queue")
    out["alias_review_queue"] = queue if held is None else held.unionByName(queue.join(held.select("review_id"), "review_id", "left_anti"), allowMissingColumns=True)
    return out


def migrate(bids: DataFrame) -> DataFrame:
    """M-05: add the columns that older bids lack."""
    more = {"quote_value": "double", "quote_unit": "string", "quote_text": "string", "evidence_json": "string"}
    missing = {c: (F.lit("[]") if c == "evidence_json" else F.lit(None)).cast(kind) for c, kind in more.items() if c not in bids.columns}
    return bids.withColumns(missing) if missing else bids


def first_wins(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """M-04, W-11: the first row of each key."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(seq))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
