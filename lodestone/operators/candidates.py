"""Relation candidates from bidder tables and notice texts, and the shapes that models answer in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from . import flow


def review_state(value: Column) -> Column:
    """E-15: refusals before passes."""
    text = X.compact_cell(value)
    return F.when(X.contains_any(text, ("不通过", "不合格", "否决", "无效")), "不通过").when(X.contains_any(text, ("通过", "合格", "有效")), "通过").otherwise("未知")


def bid_result(value: Column, rank: Column) -> Column:
    """E-14: losses before candidates before awards; a first rank alone makes a candidate."""
    text = X.compact_cell(value)
    return (
        F.when(X.contains_any(text, ("未中标", "未成交", "落标", "未入围")), "未中标")
        .when(X.contains_any(text, ("候选", "推荐")), "候选")
        .when(text.contains("成交"), "成交")
        .when(text.contains("中标"), "中标")
        .when(rank == 1, "候选")
        .otherwise("未知")
    )


def model_result(value: Column, winner: Column, legacy: bool = False) -> Column:
    """E-18: result of a model's bid.  ``legacy`` keeps an order that calls a lost deal a deal; the default is E-14's."""
    text = F.coalesce(value, F.lit("未知"))
    if not legacy:
        return F.when(winner, "中标").otherwise(bid_result(text, F.lit(None).cast("int")))
    lost = X.contains_any(text, ("未中标", "未成交", "落标"))
    return F.when(winner, "中标").when(text.contains("成交"), "成交").when(lost, "未中标").when(text.contains("中标"), "中标").when(text.contains("候选"), "候选").otherwise("未知")


def header_row(cells: Column) -> Column:
    """F-17: two short cells or more and none very long."""
    short = F.size(F.filter(cells, lambda c: F.length(c).between(1, 40)))
    return (short >= 2) & (F.coalesce(F.array_max(F.transform(cells, F.length)), F.lit(0)) <= 120)


def _found(name: str):
    return lambda place: F.when(place > 0, F.struct(F.lit(name).alias("field"), (place - 1).cast("int").alias("place")))


def match_columns(cells: Column) -> Column:
    """E-13: field to leftmost column whose cell holds one of its names; a column may serve several fields."""
    pairs = []
    for name, aliases in L.HEADER_ALIASES.items():
        place = F.array_position(F.transform(cells, X.holds_any(aliases)), F.lit(True))
        pairs.append(X.once(place, _found(name)))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def bids(blocks: DataFrame) -> DataFrame:
    """E-12, E-16: one bid for each bidder of a package: notice_id, package_no, name, and what tables say of it.

    Of the first eight rows the one with most fields is the header; it must name bidders and something about bids.
    Where a bidder stands in several rows, awards override and other rows fill what is missing.
    """
    tables = blocks.where((F.col("type") == "table") & ~X.contains_any(F.coalesce("source.file_name", F.lit("")), L.RELATION_EXCLUDED) & (F.size("rows") > 0))
    heads = F.transform(F.slice("rows", 1, 8), lambda row: F.transform(row, X.compact_cell))
    facts = F.array(*[F.lit(x) for x in ("amount", "score", "rank", "qualification", "compliance", "result")])
    # a row that names no bidder is no header, so its other columns are not looked for
    tables = flow.settled(tables.withColumn("_heads", heads))
    named = lambda cells: X.contains_any(F.array_join(cells, "\n"), L.HEADER_ALIASES["org"])
    tables = flow.settled(tables.withColumn("_maps", F.transform("_heads", lambda cells: F.when(named(cells), match_columns(cells)))))
    good = lambda m, cells: m.isNotNull() & F.map_contains_key(m, "org") & F.arrays_overlap(F.map_keys(m), facts) & header_row(cells)
    sizes = F.zip_with("_maps", "_heads", lambda m, cells: F.when(good(m, cells), F.size(m)).otherwise(0))
    tables = flow.settled(tables.withColumn("_sizes", sizes)).where(F.array_max("_sizes") > 0).withColumn("_at", F.array_position("_sizes", F.array_max("_sizes")).cast("int"))
    tables = tables.withColumn("_map", F.element_at("_maps", F.col("_at"))).withColumn("_head", F.element_at(F.element_at("_heads", F.col("_at")), F.element_at("_map", "org") + 1))
    rows = flow.settled(tables.select("notice_id", "block_id", "pos", "_at", "_map", "_head", "rows")).select("*", F.posexplode("rows").alias("_i", "_row")).drop("rows").where("_i >= _at")
    cell = lambda name: F.get(F.col("_row"), F.element_at("_map", name))
    rows = flow.settled(rows.withColumn("name", X.one_line(cell("org")))).where(X.valid_org_name(F.col("name")) & ~X.contains_any(F.col("name"), ("合计", "供应商名称", "投标人名称")))
    rows = flow.settled(rows.withColumn("rank", X.once(X.relation_number(cell("rank")), lambda number: F.when(number >= 1, number.cast("int")))))
    declared = F.when(F.col("_head").contains("中标"), "中标").when(F.col("_head").contains("成交"), "成交")
    rows = flow.settled(rows.withColumn("_plain", bid_result(cell("result"), F.col("rank"))))
    plain = F.col("_plain")
    rows = rows.select(
        "notice_id",
        F.coalesce(F.nullif(X.one_line(cell("package")), F.lit("")), F.lit(L.DEFAULT_PACKAGE)).alias("package_no"),
        "name",
        X.compact_cell(F.col("name")).alias("_name"),
        X.relation_number(cell("amount")).alias("amount_yuan"),
        X.relation_number(cell("score")).alias("score"),
        "rank",
        review_state(cell("qualification")).alias("qualification"),
        review_state(cell("compliance")).alias("compliance"),
        F.when((plain == "未知") & declared.isNotNull(), declared).otherwise(plain).alias("result"),
        "block_id",
        (F.col("_i") + 1).cast("int").alias("block_row"),
        F.struct("pos", "_i").alias("_order"),
    )
    rows = flow.settled(rows)
    award = F.col("result").isin(*L.WON)
    first = lambda c, test=None: F.min_by(c, F.when(F.col(c).isNotNull() if test is None else test, F.col("_order")))
    settled = lambda c: F.coalesce(first(c, F.col(c) != "未知"), F.lit("未知"))
    last = F.max(F.when(award, F.struct("_order", "result", "block_id", "block_row")))
    head = F.min(F.struct("_order", "result", "block_id", "block_row"))
    out = rows.groupBy("notice_id", "package_no", "_name").agg(
        F.min_by("name", "_order").alias("name"), first("amount_yuan").alias("amount_yuan"), first("score").alias("score"), first("rank").alias("rank"), settled("qualification").alias("qualification"), settled("compliance").alias("compliance"), F.coalesce(last, head).alias("_v"), F.min("_order").alias("_order")
    )
    return out.select("notice_id", "package_no", "name", F.when(F.col("_v.result").isin(*L.WON), "中标供应商").otherwise("投标参与方").alias("org_type"), "amount_yuan", "score", "rank", "qualification", "compliance", "_v.result", "_v.block_id", "_v.block_row", "_order")


def metadata(blocks: DataFrame) -> DataFrame:
    """E-12, X-16, X-17: project number, buyer and agency of each notice from all its texts in order."""
    texts = blocks.groupBy("notice_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda b: b["text"]), "\n").alias("_t"))
    named = lambda c: F.when(X.valid_org_name(c), c)
    return texts.select("notice_id", X.project_no(F.col("_t")).alias("project_no"), named(X.clean_org_name(X.unit_name(F.col("_t")))).alias("procurement_unit"), named(X.clean_org_name(X.agency_name(F.col("_t")))).alias("agency"))


def bypassed(rows: DataFrame, most: int = L.LARGE_TABLE) -> DataFrame:
    """E-21: notices with so many bidders that the rules' candidates stand without a model."""
    return rows.groupBy("notice_id").agg(F.count("*").alias("bidders")).withColumn("bypass", F.col("bidders") >= most)


def pick(json: Column, *names: str) -> Column:
    """E-17: the first of several spellings that a model's JSON object has."""
    return F.coalesce(*[_member(json, n) for n in names])


def _member(json: Column, name: str) -> Column:
    """A member of a JSON object.  Text without the name has no such member and is not parsed, unless it holds escapes."""
    return F.when(json.contains(name) | json.contains("\\"), F.get_json_object(json, f"$.{name}"))


def model_bids(answers: DataFrame, legacy: bool = False) -> DataFrame:
    """E-17: bids of model answers (notice_id, answer JSON): winners first, one for each name of a package."""
    listed = flow.settled(answers.select("notice_id", F.from_json(F.get_json_object("answer", "$.packages"), "array<string>").alias("_packages")))
    packages = listed.select("notice_id", F.posexplode("_packages").alias("_p", "package"))
    each = lambda name: F.coalesce(F.from_json(_member(F.col("package"), name), "array<string>"), F.array().cast("array<string>"))
    winner = F.get_json_object("package", "$.winner")
    every = F.concat(
        F.when(winner.isNotNull(), F.array(F.struct(F.lit(True).alias("won"), winner.alias("bid")))).otherwise(F.expr("cast(array() as array<struct<won:boolean,bid:string>>)")),
        F.transform(F.concat(each("bidders"), each("other_bidders")), lambda b: F.struct(F.lit(False).alias("won"), b.alias("bid"))),
    )
    rows = flow.settled(packages.select("notice_id", "_p", F.coalesce(pick(F.col("package"), "package_no", "package_id"), F.lit(L.DEFAULT_PACKAGE)).alias("package_no"), every.alias("_every")))
    rows = rows.select("notice_id", "_p", "package_no", F.posexplode("_every").alias("_b", "v"))
    bid = F.col("v.bid")
    rows = flow.settled(rows.withColumn("_org", F.coalesce(pick(bid, "org", "organization", "supplier", "bidder", "company"), bid)))
    org = F.col("_org")
    plain = F.when(~org.startswith("{"), org)
    rows = flow.settled(rows.withColumn("name", F.coalesce(pick(org, "name", "org_name", "supplier_name", "company_name"), plain)).drop("_org")).where("name is not null")
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("notice_id", "_p", "name").orderBy("_b"))).where("_turn = 1")
    answered = {"_qualification": F.coalesce(pick(bid, "qualification"), F.lit("未知")), "_compliance": F.coalesce(pick(bid, "compliance"), F.lit("未知")), "_result": pick(bid, "result", "outcome")}
    rows = flow.settled(rows.withColumns(answered))
    found = rows.select(
        "notice_id",
        "package_no",
        "name",
        pick(bid, "amount_yuan", "amount").try_cast("double").alias("amount_yuan"),
        pick(bid, "score").try_cast("double").alias("score"),
        pick(bid, "rank").try_cast("int").alias("rank"),
        review_state(F.col("_qualification")).alias("qualification"),
        review_state(F.col("_compliance")).alias("compliance"),
        model_result(F.col("_result"), F.col("v.won"), legacy).alias("result"),
        pick(bid, "evidence_block_id").alias("block_id"),
        pick(bid, "evidence_block_row", "row").try_cast("int").alias("block_row"),
    )
    return flow.settled(found)


def recovered_rows(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """E-19, E-20: bids with the one table row that names them (equal, or holding a name of four characters or more);
    ``valid`` tells if their block is there and the row within it."""
    rows = flow.settled(blocks.select("notice_id", "block_id", "rows")).select("notice_id", "block_id", F.posexplode("rows").alias("_i", "_row"))
    cells = rows.select("notice_id", "block_id", (F.col("_i") + 1).alias("_at"), F.explode("_row").alias("_c"))
    cells = flow.settled(cells.withColumn("_c", X.match_text(F.col("_c"))))
    found = flow.kept(found)
    names = flow.settled(found.select("notice_id", "block_id", "name").distinct().withColumn("_n", X.match_text(F.col("name")))).where("_n <> ''")
    hits = names.join(cells, ["notice_id", "block_id"]).where((F.col("_c") == F.col("_n")) | ((F.length("_n") >= 4) & F.col("_c").contains(F.col("_n"))))
    hits = hits.select("notice_id", "block_id", "name", "_at").distinct()
    one = hits.groupBy("notice_id", "block_id", "name").agg(F.count("*").alias("_hits"), F.min("_at").alias("_at")).where("_hits = 1").drop("_hits")
    sizes = blocks.groupBy("notice_id", "block_id").agg(F.max(F.coalesce(F.size("rows"), F.lit(0))).alias("_size"))
    out = found.join(one, ["notice_id", "block_id", "name"], "left").join(sizes, ["notice_id", "block_id"], "left")
    row = F.coalesce("_at", "block_row")
    return out.withColumn("block_row", row).withColumn("valid", F.col("_size").isNotNull() & (row.isNull() | row.between(1, F.col("_size")))).drop("_at", "_size")
