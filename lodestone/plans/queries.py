"""Queries of the engine over the driver's tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from ..operators import evaluation, extraction, flow, relations, scenarios, search, selection
from ..sources import readers
from ..streaming import feeds
from . import carriers as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
UNIT, PAIR = 3, [1, 2]


def query(sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def with_(sql: str) -> str:
    return f"WITH {C.SQL.strip()}, {sql}" if not sql.lstrip().upper().startswith("SELECT") else f"WITH {C.SQL.strip()} {sql}"


WIN = "SELECT pu.org_id AS unit_id, b.org_id AS supplier_id, count(DISTINCT package_id) AS win_count, coalesce(sum(amount_yuan), 0)::DOUBLE AS total_amount_yuan, max(publish_date) AS last_date FROM bids b JOIN pu ON pu.project_id = b.package_id JOIN pr ON pr.project_id = b.package_id WHERE result IN ('中标', '成交') GROUP BY 1, 2"
BIDDERS = "SELECT pu.org_id AS unit_id, b.org_id AS bidder_id, count(DISTINCT package_id) AS bid_count, sum(CASE WHEN result IN ('中标', '成交') THEN 1 ELSE 0 END)::BIGINT AS win_count, sum(CASE WHEN result IN ('中标', '成交') THEN amount_yuan ELSE 0 END)::DOUBLE AS total_win_amount_yuan FROM bids b JOIN pu ON pu.project_id = b.package_id GROUP BY 1, 2"
COBID = "SELECT pu.org_id AS unit_id, a.org_id AS bidder_a, c.org_id AS bidder_b, count(DISTINCT a.package_id) AS project_count FROM bids a JOIN bids c ON a.package_id = c.package_id AND a.org_id < c.org_id JOIN pu ON pu.project_id = a.package_id GROUP BY 1, 2, 3"
MET = "SELECT w.org_id AS supplier_id, c.org_id AS cobidder_id, count(DISTINCT w.package_id) AS project_count FROM bids w JOIN bids c ON c.package_id = w.package_id AND c.org_id <> w.org_id WHERE w.result IN ('中标', '成交') GROUP BY 1, 2"


@query(with_(WIN))
def unit_win_stats(spark, d):
    return relations.unit_win_stats(C.tables(spark, d))


@query(with_(BIDDERS))
def unit_bidder_stats(spark, d):
    return relations.unit_bidder_stats(C.tables(spark, d))


@query(with_(COBID))
def unit_cobid_pairs(spark, d):
    return relations.unit_cobid_pairs(C.tables(spark, d))


@query(with_(MET))
def supplier_cobid(spark, d):
    return relations.supplier_cobid(C.tables(spark, d))


@query(with_(f"u AS ({WIN}) SELECT a.supplier_id AS supplier_a, b.supplier_id AS supplier_b, a.unit_id, a.win_count + b.win_count AS win_count, a.total_amount_yuan + b.total_amount_yuan AS total_amount_yuan FROM u a JOIN u b ON a.unit_id = b.unit_id AND a.supplier_id < b.supplier_id"))
def supplier_common_units(spark, d):
    return relations.supplier_common_units(C.tables(spark, d))


@query(with_("SELECT a.org_id AS supplier_a, b.org_id AS supplier_b, a.package_id AS project_id, a.package_id, (a.amount_yuan + b.amount_yuan)::DOUBLE AS participant_amount_yuan FROM bids a JOIN bids b ON a.package_id = b.package_id AND a.org_id < b.org_id"))
def supplier_joint_projects(spark, d):
    return relations.supplier_joint_projects(C.tables(spark, d))


@query(with_(f"u AS ({WIN}) SELECT u.*, s_name AS supplier_name FROM u JOIN supplier ON s_suppkey = supplier_id"))
def unit_win_suppliers(spark, d):
    t = C.tables(spark, d)
    return scenarios.unit_win_suppliers(relations.unit_win_stats(t), t["organizations"])


@query(with_(f"u AS ({BIDDERS}) SELECT u.*, s_name AS bidder_name FROM u JOIN supplier ON s_suppkey = bidder_id WHERE unit_id = {UNIT} ORDER BY bid_count DESC, win_count DESC, bidder_id LIMIT 5"))
def unit_top_bidders(spark, d):
    t = C.tables(spark, d)
    return scenarios.unit_top_bidders(relations.unit_bidder_stats(t), t["organizations"], UNIT)


@query(with_(f"u AS ({COBID}) SELECT u.*, a.s_name AS bidder_a_name, b.s_name AS bidder_b_name FROM u JOIN supplier a ON a.s_suppkey = bidder_a JOIN supplier b ON b.s_suppkey = bidder_b WHERE unit_id = {UNIT}"))
def unit_cobidders_named(spark, d):
    t = C.tables(spark, d)
    return scenarios.unit_cobid_pairs(relations.unit_cobid_pairs(t), t["organizations"], UNIT)


@query(with_(f"u AS ({MET}) SELECT u.*, s_name AS cobidder_name FROM u JOIN supplier ON s_suppkey = cobidder_id WHERE supplier_id = 1 ORDER BY project_count DESC, cobidder_id LIMIT 5"))
def supplier_cobidders(spark, d):
    t = C.tables(spark, d)
    return scenarios.supplier_cobidders(relations.supplier_cobid(t), t["organizations"], 1)


@query(with_("SELECT pu.org_id AS unit_id, n_name AS unit_name, count(DISTINCT b.org_id) AS matched_suppliers, count(DISTINCT package_id) AS project_count, sum(amount_yuan)::DOUBLE AS total_amount_yuan FROM bids b JOIN pu ON pu.project_id = package_id JOIN nation ON n_nationkey = pu.org_id WHERE result IN ('中标', '成交') AND b.org_id IN (1, 2) GROUP BY 1, 2 HAVING count(DISTINCT b.org_id) = 2"))
def common_units(spark, d):
    return scenarios.common_units(C.tables(spark, d), PAIR)


@query(with_("SELECT pr.project_id, notice_id, title, package_id, '默认包' AS package_no, count(DISTINCT org_id) AS matched_suppliers, sum(amount_yuan)::DOUBLE AS participant_amount_yuan, string_agg(DISTINCT result, ',' ORDER BY result) AS results FROM bids JOIN pr ON pr.project_id = package_id WHERE org_id IN (1, 2) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT org_id) = 2"))
def joint_projects(spark, d):
    return scenarios.joint_projects(C.tables(spark, d), PAIR)


@query("SELECT s_suppkey AS org_id, s_name AS name FROM supplier WHERE s_name ILIKE '%r#00000001%' ORDER BY name LIMIT 50")
def organizations_search(spark, d):
    return scenarios.organizations(C.suppliers(spark, d), "R#00000001")


@query(with_("SELECT project_id, notice_id, title, NULL::VARCHAR AS project_no, publish_date FROM pr WHERE title ILIKE '%urgent%' ORDER BY publish_date DESC, title, project_id LIMIT 50"))
def projects_search(spark, d):
    return scenarios.projects(C.projects(spark, d), "urgent")


ENTITIES = "e AS (SELECT l_orderkey AS notice_id, l_linenumber::BIGINT AS item_no, p_name AS product_service_name, p_type AS category_name, NULL::VARCHAR AS category_code, p_brand AS brand_supplier, p_retailprice::DECIMAL(18,2) AS unit_price, l_quantity::DECIMAL(18,2) AS quantity, l_extendedprice::DECIMAL(18,2) AS total_price FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {ENTITIES}, u AS (SELECT notice_id, row_number() OVER (PARTITION BY notice_id ORDER BY item_no, product_service_name, brand_supplier, total_price) AS item_no, product_service_name, brand_supplier FROM e) SELECT * FROM u WHERE product_service_name LIKE '%ring%' AND brand_supplier LIKE '%#1%' ORDER BY notice_id, item_no LIMIT 20 OFFSET 20")
def entity_page(spark, d):
    rows = flow.numbered(C.entities(spark, d).withColumnRenamed("item_no", "line"), ["notice_id"], ["line", "product_service_name", "brand_supplier", "total_price"], "item_no")
    return search.page(rows, 2, 20, product="RING", brand="#1")[0].select("notice_id", F.col("item_no").cast("long").alias("item_no"), "product_service_name", "brand_supplier")


@query(f"WITH {ENTITIES} SELECT count(*) AS total FROM e WHERE concat_ws(' ', product_service_name, category_name, brand_supplier) ILIKE '%widget%brand#1%'")
def entity_search_total(spark, d):
    rows = C.entities(spark, d).withColumn("search_text", search.search_text("product_service_name", "category_name", "brand_supplier"))
    return search.page(rows, q="widget%Brand#1")[1]


@query(f"WITH {ENTITIES} SELECT notice_id, item_no, product_service_name, category_name, category_code, brand_supplier, unit_price, quantity, total_price FROM e WHERE category_name || ' ' ILIKE '%promo%'")
def entity_export(spark, d):
    return search.export(C.entities(spark, d), category="promo")


@query(f"WITH {ENTITIES} SELECT count(*) AS entities, count(DISTINCT notice_id) AS notices FROM e")
def entity_counts(spark, d):
    return search.entity_counts(C.entities(spark, d))


@query(with_("SELECT 'bids' AS table_name, count(*) AS rows FROM bids UNION ALL SELECT 'organizations', count(*) FROM supplier UNION ALL SELECT 'packages', count(*) FROM orders UNION ALL SELECT 'project_units', count(*) FROM pu UNION ALL SELECT 'projects', count(*) FROM orders UNION ALL SELECT 'units', count(*) FROM nation"))
def table_counts(spark, d):
    return relations.counts(C.tables(spark, d))


@query("SELECT p_partkey AS product_id, p_name AS name, p_type AS category_code, p_brand AS brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def orphan_products(spark, d):
    large = C.read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("product_id"))
    return relations.orphan_products(C.products(spark, d), large)


@query(f"""WITH {ENTITIES}, x AS (SELECT unit_price::DOUBLE * quantity::DOUBLE AS ex, total_price::DOUBLE AS ac FROM e)
SELECT CASE WHEN abs(ex - ac) / greatest(abs(ex), abs(ac), 1.0) <= 0.02 THEN 'ok' ELSE 'mismatch' END AS loose,
       CASE WHEN ex = 0 THEN abs(ac) < 0.01 ELSE abs(ex - ac) <= 0.02 * abs(ex) END AS silver, abs(ex - ac) <= greatest(0.01, abs(ac) * 1e-6) AS strict, count(*) AS n FROM x GROUP BY ALL""")
def price_checks(spark, d):
    fields = [F.col(c) for c in ("unit_price", "quantity", "total_price")]
    rows = C.entities(spark, d).select(extraction.price_consistency(*fields).alias("loose"), extraction.silver_consistency(*fields).alias("silver"), extraction.gold_consistency(*fields).alias("strict"))
    return rows.groupBy("loose", "silver", "strict").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS notice_id, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_no FROM lineitem")
def item_numbers(spark, d):
    rows = C.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return flow.numbered(rows, ["notice_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_suppkey", "l_extendedprice")


@query("SELECT event_id, user_id::VARCHAR || ':req_' || lpad(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR, greatest(3, length(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR))::INT, '0') AS request_id FROM events")
def request_numbers(spark, d):
    rows = C.read(spark, d, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"))
    return flow.request_ids(rows, "user_id", ["ts", "event_id"]).select("event_id", "request_id")


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT event_id, CASE WHEN n = 1 THEN event_type ELSE event_type || '_' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') END AS block_id FROM r")
def occurrence_ids(spark, d):
    return flow.occurrence_ids(C.read(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", ["event_id"]).select("event_id", "block_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_state(spark, d):
    return flow.latest(C.read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


@query("WITH r AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, user_id, event_type FROM r WHERE n = 1 OR event_type IS DISTINCT FROM p")
def change_feed(spark, d):
    rows = C.read(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return flow.changes(rows, "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("WITH r AS (SELECT event_id, user_id, coalesce(sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent_before FROM events) SELECT * FROM r WHERE spent_before < 500")
def budget_guard(spark, d):
    rows = C.read(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("cost"))
    return flow.within_budget(rows, ["user_id"], ["ts", "event_id"], "cost", 500).select("event_id", "user_id", F.col("spent_before").cast("double").alias("spent_before"))


@query("WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600)::BIGINT AS pos FROM events), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 1 THEN 0 ELSE 1 END AS nw FROM h WINDOW w AS (PARTITION BY user_id ORDER BY pos)) SELECT user_id, pos, sum(nw) OVER (PARTITION BY user_id ORDER BY pos)::BIGINT AS island FROM g")
def islands(spark, d):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return flow.islands(C.read(spark, d, "events").select("user_id", hour.alias("pos")).distinct(), ["user_id"])


@query("WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type FROM events) SELECT DISTINCT r.* FROM r JOIN r s ON r.user_id = s.user_id AND s.event_type = 'error' AND r.pos BETWEEN s.pos - 2 AND s.pos + 2")
def context_window(spark, d):
    rows = flow.numbered(C.read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "pos")
    rows = rows.select(F.col("user_id").alias("notice_id"), F.col("user_id").alias("document_id"), "pos", "event_type", (F.col("event_type") == "error").alias("is_seed"), F.lit(True).alias("is_text"))
    return flow.context(rows).select(F.col("notice_id").alias("user_id"), "pos", "event_type")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) SELECT *, row_number() OVER (ORDER BY place, source) AS position FROM r")
def round_robin(spark, d):
    return flow.round_robin(C.read(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query("WITH r AS (SELECT doc_id, source, n_chars, 24000 - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM documents) SELECT doc_id, source, room, least(n_chars, room) AS used FROM r WHERE room > 0")
def prefix_budget(spark, d):
    return flow.prefix_budget(C.read(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 24_000).drop("n_chars")


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) / 40)::BIGINT AS chunk FROM lineitem")
def row_chunks(spark, d):
    rows = C.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return flow.slices_of(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 40).drop("l_suppkey", "l_extendedprice")


@query("""WITH n AS (SELECT l_orderkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem), a AS (SELECT * FROM n WHERE l_quantity >= 22),
t AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_quantity) DESC, min(pos) FILTER (l_quantity = m)) AS place FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey, l_suppkey) AS m FROM a) GROUP BY 1, 2)
SELECT a.l_orderkey, a.l_suppkey, a.l_quantity, a.pos::BIGINT AS pos FROM a JOIN t USING (l_orderkey, l_suppkey) WHERE place <= 2""")
def source_cap(spark, d):
    rows = C.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = flow.numbered(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "pos")
    best = flow.best_sources(rows, "l_orderkey", ["l_suppkey"], "l_quantity", "pos", 22, 2)
    return best.select("l_orderkey", "l_suppkey", "l_quantity", F.col("pos").cast("long").alias("pos"))


@query("WITH r AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS high, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT event_id, user_id, value, false AS fallback FROM r WHERE value >= 200 UNION ALL SELECT event_id, user_id, value, true FROM r WHERE high < 200 AND value >= 10 AND n <= 5")
def text_fallback(spark, d):
    return flow.fallback(C.read(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value", 200, [F.desc("value"), "event_id"], 5, 10)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events")
def header_forward_fill(spark, d):
    rows = C.read(spark, d, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("place"))
    return flow.carried(rows, ["user_id"], "place", F.col("event_id"), F.col("event_type") == "error", "prior").select("event_id", "user_id", "prior")


@query("SELECT event_id, event_type = 'view' AND coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS covered FROM events")
def early_stop(spark, d):
    rows = C.read(spark, d, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("place"))
    return flow.after_strong(rows, "user_id", "place", F.col("event_type") == "purchase", F.col("event_type") == "view").select("event_id", "covered")


@query("SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, list_sort(list(value))[(count(value) // 2 + 1)::INT] AS median_upper FROM events GROUP BY 1")
def latency(spark, d):
    return evaluation.latency(C.read(spark, d, "events"), "value", "event_type")


@query("""WITH g AS (SELECT l.doc_id, quality, toxic, d.doc_id IS NOT NULL AS present, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS fq, CASE WHEN d.lang = 'en' THEN 1 END AS ft FROM labels l LEFT JOIN documents d USING (doc_id)),
v AS (SELECT 'quality' AS field, present, quality::VARCHAR AS gold, fq::VARCHAR AS found FROM g UNION ALL SELECT 'toxic', present, nullif(toxic, 0)::VARCHAR, ft::VARCHAR FROM g),
c AS (SELECT field, count(*) FILTER (present AND gold = found) AS tp, count(*) FILTER (present AND found IS NOT NULL AND gold IS DISTINCT FROM found) AS fp, count(*) FILTER (NOT present OR gold IS NOT NULL AND gold IS DISTINCT FROM found) AS fn FROM v GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE round(tp / (tp + fp), 4) END AS "precision", CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE round(tp / (tp + fn), 4) END AS recall FROM c)
SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0::DOUBLE ELSE round(2 * "precision" * recall / ("precision" + recall), 4) END AS f1 FROM r""")
def field_scores(spark, d):
    docs = C.read(spark, d, "documents").select("doc_id", "n_chars", "lang")
    rows = C.read(spark, d, "labels").join(docs.withColumn("_d", F.lit(1)), "doc_id", "left").select(
        F.col("_d").isNotNull().alias("present"), F.col("quality").alias("gold_quality"), F.nullif("toxic", F.lit(0)).alias("gold_toxic"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("found_quality"), F.when(F.col("lang") == "en", 1).alias("found_toxic")
    )
    return evaluation.field_scores(rows, ["quality", "toxic"])


@query("SELECT lang, count(*) AS gold, sum((n_chars >= 1000)::INT)::BIGINT AS standard, sum((n_chars >= 200)::INT)::BIGINT AS loose, round(sum((n_chars >= 1000)::INT) / count(*), 4) AS standard_recall, round(sum((n_chars >= 200)::INT) / count(*), 4) AS loose_recall FROM documents GROUP BY 1")
def recall_by_dimension(spark, d):
    rows = C.read(spark, d, "documents").select("lang", (F.col("n_chars") >= 1000).alias("a"), (F.col("n_chars") >= 200).alias("b"))
    return evaluation.recall_by(rows, "lang", "a", "b")


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (d.doc_id IS NULL) AS left_only, count(*) FILTER (l.doc_id IS NULL) AS right_only, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL AND l.quality = d.q) AS agree_quality
FROM labels l FULL OUTER JOIN (SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS q FROM documents) d ON l.doc_id = d.doc_id""")
def label_agreement(spark, d):
    other = C.read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("quality"))
    return evaluation.label_agreement(C.read(spark, d, "labels").select("doc_id", "quality"), other, ["doc_id"], ["quality"])


@query("WITH o AS (SELECT l_partkey AS k, max(l_quantity) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_partkey AS k, max(l_quantity) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.c = n.c THEN 'same' ELSE 'changed' END AS state FROM o FULL OUTER JOIN n ON o.k = n.k")
def block_diff(spark, d):
    rows = C.read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", "l_returnflag")
    part = lambda flag: rows.where(F.col("l_returnflag") == flag).groupBy("k").agg(F.max("l_quantity").alias("c"))
    return evaluation.block_diff(part("A"), part("R"), "k", "c")


@query("WITH h AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS r FROM lineitem GROUP BY 1) SELECT p_partkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicated' ELSE 'assigned' END AS state, CASE WHEN n = 1 THEN r END AS request_id FROM part LEFT JOIN h ON p_partkey = l_partkey")
def exactly_once(spark, d):
    requests = C.read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("request_id"))
    return evaluation.exactly_once(C.read(spark, d, "part").select("p_partkey"), requests, ["p_partkey"])


@query("SELECT l_orderkey AS block_id, l_linenumber AS block_row, CASE WHEN n IS NULL THEN 'missing_block' WHEN l_linenumber BETWEEN 1 AND n THEN 'ok' ELSE 'row_out_of_range' END AS state FROM lineitem LEFT JOIN (SELECT o_orderkey, length(o_orderpriority) - 4 AS n FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey")
def coordinate_audit(spark, d):
    refs = C.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("block_row"))
    blocks = C.read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("block_id"), (F.length("o_orderpriority") - 4).alias("n_rows"))
    return evaluation.coordinate_state(refs, blocks).select("block_id", "block_row", "state")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return evaluation.repeated(C.read(spark, d, "events"), "user_id", "event_type")


@query("SELECT coalesce(o_orderstatus, '未知') AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return evaluation.histogram(C.read(spark, d, "orders"), "o_orderstatus")


@query("SELECT count(quality) AS quality, count(toxic) AS toxic, count(text) AS text, count(lang) AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def field_coverage(spark, d):
    return evaluation.coverage(C.read(spark, d, "documents").join(C.read(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic", "text", "lang"])


@query("SELECT count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total_tokens, round(sum(json_extract(props, '$.k')::BIGINT) / 1000000.0::DOUBLE * 2.5::DOUBLE, 6) AS cost FROM events")
def usage_rollup(spark, d):
    return evaluation.usage(C.read(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("total_tokens")), 2.5)


@query("SELECT DISTINCT s.l_partkey AS k FROM lineitem s WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def common_ids(spark, d):
    rows = C.read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return evaluation.common_ids(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), "k")


@query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def only_left_ids(spark, d):
    rows = C.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return evaluation.only_ids(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), "k")


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def all_ids(spark, d):
    return evaluation.all_ids(C.read(spark, d, "customer").select(F.col("c_custkey").alias("k")), C.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")


NODES = """nodes AS (
  SELECT project_id::VARCHAR AS project_id, project_id::VARCHAR AS id, title AS name, '项目' AS type, '0' AS ord FROM pr
  UNION ALL SELECT project_id::VARCHAR, org_id::VARCHAR, n_name, '采购单位', '1' FROM pu JOIN nation ON n_nationkey = org_id
  UNION ALL SELECT o_orderkey::VARCHAR, o_orderkey::VARCHAR, '默认包', '包件', '2|' || lpad(o_orderkey::VARCHAR, 24, '0') FROM orders
  UNION ALL SELECT package_id::VARCHAR, org_id::VARCHAR, s_name, CASE WHEN result = '未中标' THEN '投标参与方' ELSE '中标供应商' END, '2|' || lpad(package_id::VARCHAR, 24, '0') || '|' || lpad(org_id::VARCHAR, 24, '0') FROM bids JOIN supplier ON s_suppkey = org_id)"""


@query(with_(f"{NODES} SELECT project_id, id, arg_max(name, ord) AS name, arg_max(type, ord) AS type FROM nodes GROUP BY 1, 2"))
def graph_nodes(spark, d):
    return scenarios.graph(C.tables(spark, d))[0]


EDGES = """edges AS (
  SELECT project_id::VARCHAR AS project_id, project_id::VARCHAR AS source, org_id::VARCHAR AS target, '采购单位' AS type, NULL::DOUBLE AS amount_yuan FROM pu
  UNION ALL SELECT o_orderkey::VARCHAR, o_orderkey::VARCHAR, o_orderkey::VARCHAR, '包含包件', NULL FROM orders
  UNION ALL SELECT package_id::VARCHAR, org_id::VARCHAR, package_id::VARCHAR, result, amount_yuan::DOUBLE FROM bids JOIN supplier ON s_suppkey = org_id)"""


@query(with_(f"{EDGES} SELECT * FROM edges"))
def graph_edges(spark, d):
    return scenarios.graph(C.tables(spark, d))[1].select("project_id", "source", "target", "type", "amount_yuan")


@query(with_(f"{EDGES} SELECT project_id, id, count(*) AS degree FROM (SELECT project_id, source AS id FROM edges UNION ALL SELECT project_id, target FROM edges) GROUP BY 1, 2"))
def graph_degrees(spark, d):
    return scenarios.degrees(scenarios.graph(C.tables(spark, d))[1])


@query(with_("""r AS (SELECT b.*, row_number() OVER (PARTITION BY package_id ORDER BY CASE WHEN result = '中标' THEN 1 END ASC NULLS LAST, amount_yuan::DOUBLE DESC, s_name, org_id) AS place FROM bids b JOIN supplier ON s_suppkey = org_id)
SELECT package_id, org_id::VARCHAR AS node, place, 1::BIGINT AS members FROM r WHERE place <= 3 UNION ALL SELECT package_id, 'others', 4, count(*) FROM r WHERE place > 3 GROUP BY 1"""))
def dense_collapse(spark, d):
    rows = C.bids(spark, d).join(C.suppliers(spark, d), "org_id").select("package_id", "org_id", "name", F.when(F.col("result") == L.WON[0], 1).alias("rank"), F.col("amount_yuan").cast("double").alias("score"))
    return scenarios.collapse_dense(rows, 3)


@query("WITH t AS (SELECT doc_id, lower(translate(regexp_replace(text, '[\\s\\p{Z}\\x0b]+', '', 'g'), '（）', '()')) AS c FROM documents), f AS (SELECT doc_id, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS n FROM t) SELECT doc_id FROM f WHERE n = 1")
def evidence_dedup(spark, d):
    rows = C.read(spark, d, "documents").select("doc_id", "text")
    said = selection.fingerprint(F.lit("text"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<array<string>>"), F.array("text"))
    return relations.first_wins(rows.select("doc_id", said.alias("fingerprint")), ["fingerprint"], "doc_id").select("doc_id")


@query("SELECT p_partkey, 'prd_' || substr(sha256(p_name || chr(31) || p_brand || chr(31) || '' || chr(31) || nullif(p_size, 0)::VARCHAR), 1, 20) AS product_id FROM part")
def stable_ids(spark, d):
    rows = C.read(spark, d, "part")
    return rows.select("p_partkey", X.stable_id("prd", F.col("p_name"), F.col("p_brand"), F.lit(None), F.col("p_size")).alias("product_id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice::DECIMAL(28,6))::DOUBLE AS plain, (l_quantity::DECIMAL(28,6) * 10000)::DOUBLE AS scaled FROM lineitem")
def number_parsing(spark, d):
    money = F.concat(F.lit("约 "), F.format_number("l_extendedprice", 2), F.lit(" 元"))
    scaled = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("万元"))
    return C.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.parse_number(money).cast("double").alias("plain"), X.parse_number(scaled).cast("double").alias("scaled"))


@query("SELECT p_partkey, p_name AS name, 'A' || lpad(p_partkey::VARCHAR, 8, '0') AS code FROM part")
def category_split(spark, d):
    cell = F.concat(F.lit("A"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(" "), F.col("p_name"))
    rows = C.read(spark, d, "part").withColumn("cell", cell)
    name, code = X.split_category(F.col("cell"))
    return rows.select("p_partkey", name.alias("name"), code.alias("code"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS notice_date FROM orders")
def notice_dates(spark, d):
    return C.read(spark, d, "orders").select("o_orderkey", X.notice_date(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"))).alias("notice_date"))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 10")
def seeded_sample(spark, d):
    return flow.sampled(C.read(spark, d, "documents").select("doc_id"), "doc_id", 7, 10)


@query("""WITH e AS (SELECT user_id, event_type, max(event_id) AS seq FROM events GROUP BY 1, 2), x AS (SELECT user_id, event_type AS digest, seq, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM e),
w AS (SELECT c_custkey AS user_id, 'view' AS digest FROM customer), l AS (SELECT user_id, arg_max(seq, seq) AS outcome FROM x WHERE status = 'success' GROUP BY 1)
SELECT w.user_id, coalesce(CASE WHEN x.status = 'success' THEN x.seq END, l.outcome) AS outcome, coalesce(CASE WHEN x.status = 'success' THEN x.seq END, l.outcome) IS NULL AS todo FROM w LEFT JOIN x ON w.user_id = x.user_id AND w.digest = x.digest LEFT JOIN l ON l.user_id = w.user_id""")
def resume_lookup(spark, d):
    state = C.read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("digest")).agg(F.max("event_id").alias("seq"))
    state = state.withColumn("status", F.when(F.col("digest") == "error", "failed").otherwise("success")).withColumn("outcome", F.col("seq"))
    work = C.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("digest"))
    return flow.resumed(work, state, ["user_id", "digest"], ["user_id"]).select("user_id", "outcome", "todo")


@query("WITH a AS (SELECT p_brand || ' ' || p_type AS name_norm, min(p_partkey) AS org_id FROM part GROUP BY 1), n AS (SELECT p_name AS name_norm, min(p_partkey) AS org_id FROM part GROUP BY 1), q AS (SELECT DISTINCT p_name AS name_norm FROM part UNION SELECT DISTINCT p_brand || ' ' || p_type FROM part) SELECT q.name_norm, coalesce(n.org_id, a.org_id) AS org_id FROM q LEFT JOIN n USING (name_norm) LEFT JOIN a ON a.name_norm = q.name_norm")
def alias_resolution(spark, d):
    part = C.read(spark, d, "part")
    other = F.concat("p_brand", F.lit(" "), "p_type")
    orgs = part.groupBy(F.col("p_name").alias("name_norm")).agg(F.min("p_partkey").alias("org_id"))
    aliases = part.groupBy(other.alias("alias_norm")).agg(F.min("p_partkey").alias("org_id"))
    names = part.select(F.col("p_name").alias("name_norm")).union(part.select(other)).distinct()
    return relations.resolve_orgs(names, orgs, aliases).select("name_norm", "org_id")


@query()
def alias_candidates(spark, d):
    rows = C.read(spark, d, "part").groupBy(F.concat("p_name", F.lit(" "), "p_type").alias("name_norm")).agg(F.min("p_partkey").alias("first_seq"))
    return relations.alias_candidates(rows.withColumn("org_id", X.stable_id("org", F.col("name_norm"))))


@query()
def html_blocks(spark, d):
    pages = C.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("notice_id"), F.lit("page.html").alias("name"), F.col("html").alias("content"))
    return readers.parsed(pages).drop("rows")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    rows = C.read(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return feeds.tumbling(rows, "5 minutes", None, "event_type").withColumn("total", F.col("total").cast("double")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS attempt FROM conversations")
def replay_attempts(spark, d):
    return flow.numbered(C.read(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], "attempt").drop("text")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def region_units(spark, d):
    return C.read(spark, d, "nation").join(C.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


from . import content, records  # noqa: E402, F401
