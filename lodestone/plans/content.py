"""Queries over the content operators: text functions, policy, and the state of cells and files.

The driver's tables hold none of the domain's texts, so cells are made from ``part``: the key picks one of some texts, ``#``
in it stands for the key and ``@`` for the key in eight digits.  SQL makes the same cells and says the result in its own way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from ..operators import flow, geometry, policy, selection
from . import carriers as C
from .queries import query

# Characters of the full-width block and their plain forms, as NFKC maps them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_CJK = "\u4e00-\u9fff"


def made(spark: SparkSession, d: str, **texts: list) -> DataFrame:
    """``part`` as k and one column for each list of texts."""
    rows = C.spread(C.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k")), "k")
    return rows.select("k", *[picked(F.col("k"), own).alias(name) for name, own in texts.items()])


def picked(key: Column, texts: list) -> Column:
    text = F.element_at(F.array(*[F.lit(x).cast("string") for x in texts]), (key % len(texts) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("#"), key.cast("string")), F.lit("@"), F.lpad(key.cast("string"), 8, "0"))


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def made_sql(**texts: list) -> str:
    """The same rows for DuckDB, as the body of a table expression."""
    cell = lambda own: f"replace(replace([{', '.join(map(quoted, own))}][(p_partkey % {len(own)} + 1)::INT], '#', p_partkey::VARCHAR), '@', lpad(p_partkey::VARCHAR, 8, '0'))"
    return "SELECT p_partkey::BIGINT AS k, " + ", ".join(f"{cell(own)} AS {name}" for name, own in texts.items()) + " FROM part"


def any_of(terms) -> str:
    return "(" + "|".join("".join("\\" + c if c in "()[]{}.*+?|^$\\/" and c != "/" else c for c in t) for t in terms).replace("'", "''") + ")"


def nfkc_sql(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"


def tight_sql(x: str) -> str:
    return f"regexp_replace({x}, '[\\s\\p{{Z}}]+', '', 'g')"


def line_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def compact_sql(x: str) -> str:
    return tight_sql(f"lower(translate(coalesce({x}, ''), '（）', '()'))")


def compact4_sql(x: str) -> str:
    return tight_sql(f"lower({nfkc_sql(x)})")


ORGS = ["上海#（集团）有限公司", "Ａｃｍｅ # 公司, Ltd.", "某某医院#<br/>地址：一号路", "供应商应提供#", "123,456.00", "合格", " 某大学 # | 地址: 路", "第#设计院（联合体牵头人）", None, "Ｘ；#、厂。"]


@query(
    f"""WITH c AS ({made_sql(t=ORGS)}), n AS (SELECT *, {tight_sql("translate(coalesce(t, ''), '（）', '()')")} AS name FROM c),
b AS (SELECT *, regexp_replace(name, '[（(](联合体|牵头人|成员|成员单位|个人独资|有限合伙|普通合伙).{{0,40}}[）)]$', '') AS base FROM n)
SELECT k, lower(regexp_replace({tight_sql(nfkc_sql("t"))}, '[，,。；;：:、]', '', 'g')) AS norm,
       trim(regexp_replace({line_sql("t")}, '(?i)(<br\\s*/?>|\\|\\s*地址|地址\\s*[：:]|联系方式\\s*[：:]|联系电话\\s*[：:]).*$', ''), ' ：:，,；;|') AS cleaned,
       lower(regexp_replace({nfkc_sql("t")}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS matched,
       length(name) BETWEEN 2 AND 120 AND NOT regexp_matches(name, '{any_of(L.ORG_PROSE)}') AND NOT regexp_full_match(name, '[-+]?\\d[\\d,，]*(\\.\\d+)?')
       AND name NOT IN ({', '.join(map(quoted, L.NOT_ORGS))}) AND regexp_matches(base, '{any_of(L.ORG_SUFFIXES)}$') AS valid FROM b"""
)
def org_names(spark, d):
    t = F.col("t")
    return made(spark, d, t=ORGS).select("k", X.normalize_org_name(t).alias("norm"), X.clean_org_name(t).alias("cleaned"), X.match_text(t).alias("matched"), X.valid_org_name(t).alias("valid"))


GOODS = ["▲打印机（核心产品） #", "Ａ４纸：#", "★服务 器·#", "●Ｘ光机(核心标的)#", "桌-子/#", None, "Chair (red) #"]


@query(
    f"""WITH c AS ({made_sql(t=GOODS)}) SELECT k, {compact_sql("t")} AS compact, {compact4_sql("t")} AS compact_nfkc, {line_sql("t")} AS line,
regexp_replace(regexp_replace(regexp_replace({compact4_sql("t")}, '[▲■★●◆·•]', '', 'g'), '\\((核心产品|核心标的)\\)', '', 'g'), '[^0-9a-z{_CJK}]+', '', 'g') AS canonical FROM c"""
)
def product_names(spark, d):
    t = F.col("t")
    return made(spark, d, t=GOODS).select("k", X.compact(t).alias("compact"), X.compact_nfkc(t).alias("compact_nfkc"), X.one_line(t).alias("line"), X.canonical_product_name(t).alias("canonical"))


AMOUNTS = ["#元", "1,#.5 万元", "约 # 台", "# (套)", "-#", "无", "#,000", "12，345.6元", "# 平方米", "3个", None, "0.#万元/年"]
UNITS = [None, "元", None, None, "件", None]
_NUMBER = "regexp_replace(regexp_extract(coalesce({0}, ''), '[-+]?\\d[\\d,，]*(?:\\.\\d+)?'), '[,，]', '', 'g')"


def number_sql(x: str) -> str:
    value = f"(try_cast({_NUMBER.format(x)} AS DECIMAL(28,6)) * CASE WHEN contains({x}, '万元') THEN 10000 ELSE 1 END)::DECIMAL(28,6)"
    return f"CASE WHEN {value} >= 0 THEN {value} END"


@query(
    f"""WITH c AS ({made_sql(t=AMOUNTS, u=UNITS)}), n AS (SELECT *, {number_sql("t")} AS number,
nullif(regexp_extract(coalesce(t, ''), '\\d(?:[\\d,.，]*)(?:\\.\\d+)?\\s*\\(?\\s*([A-Za-z]+\\d?|[{_CJK}]{{1,6}})\\s*\\)?', 1), '') AS follows FROM c)
SELECT k, number::DOUBLE AS relation_number, number::DOUBLE AS quantity, coalesce(u, CASE WHEN number IS NOT NULL THEN follows END) AS unit,
       try_cast(regexp_replace(trim(t), '[,，]', '', 'g') AS DECIMAL(28,6))::DOUBLE AS strict FROM n"""
)
def number_cells(spark, d):
    t, u = F.col("t"), F.col("u")
    number, unit = X.parse_quantity(t, u)
    return made(spark, d, t=AMOUNTS, u=UNITS).select("k", X.relation_number(t).alias("relation_number"), number.cast("double").alias("quantity"), unit.alias("unit"), X.strict_number(t).cast("double").alias("strict"))


CATEGORIES = ["A@ 计算机", "计算机（A@）", "A@", "办公 设备", " B@  桌子# ", "详见附件", None, "C@-服务"]


def clean_sql(x: str) -> str:
    return f"regexp_replace(trim({line_sql(x)}, chr(9) || ' ;；,，、。.：:'), '([{_CJK}]) +([{_CJK}])', '\\1\\2', 'g')"


@query(
    f"""WITH c AS ({made_sql(t=CATEGORIES)}), n AS (SELECT k, t, CASE WHEN t IS NOT NULL AND t <> '详见附件' THEN {clean_sql("t")} END AS clean FROM c),
e AS (SELECT *, nullif(regexp_extract(clean, '(?i)([A-Z]\\d{{6,8}}|\\d{{6,8}})'), '') AS code FROM n)
SELECT k, clean, code, CASE WHEN code IS NULL THEN clean ELSE nullif({clean_sql("trim(replace(clean, code, ' '), ' -—（）()')")}, '') END AS name,
       CASE WHEN regexp_full_match(t, '\\s*([A-Z]\\d{{8}})\\s+(.+?)\\s*') THEN regexp_extract(t, '^\\s*([A-Z]\\d{{8}})\\s+(.+?)\\s*$', 2) ELSE t END AS strict_name,
       nullif(regexp_extract(t, '^\\s*([A-Z]\\d{{8}})\\s+(.+?)\\s*$', 1), '') AS strict_code FROM e"""
)
def category_cells(spark, d):
    t = F.col("t")
    name, code = X.split_category(t)
    strict, strict_code = X.strict_category(t)
    return made(spark, d, t=CATEGORIES).select("k", X.clean_text(t).alias("clean"), X.normalize_category_code(t).alias("code"), name.alias("name"), strict.alias("strict_name"), strict_code.alias("strict_code"))


NOTICES = [
    "项目编号：ZC-# ，采购人：某大学\n采购代理机构名称: 某代理有限公司；其他",
    "招标编号:ABC#/2 采购单位信息 名称：市医院#\n成交 人民币 #,000.00 元 共 3 台",
    "没有编号 #元",
    "采购编号： X #\n代理机构：某所#\n数量 12.5 套",
    None,
    "金额￥ #.5万元",
]


@query(
    f"""WITH c AS ({made_sql(t=NOTICES)}) SELECT k, nullif(regexp_extract(t, '(项目编号|采购编号|招标编号)\\s*[：:]\\s*([^\\s，,；;]{{3,80}})', 2), '') AS project_no,
nullif(regexp_extract(t, '(采购人|采购单位)(信息)?\\s*(名称)?\\s*[：:]\\s*([^\\n；;]{{2,200}})', 4), '') AS unit,
nullif(regexp_extract(t, '(采购代理机构|代理机构)(信息)?\\s*(名称)?\\s*[：:]\\s*([^\\n；;]{{2,200}})', 4), '') AS agency,
regexp_matches(t, '{L.MONEY}') AS money, regexp_matches(t, '{L.QUANTITY}') AS quantity FROM c"""
)
def notice_metadata(spark, d):
    t = F.col("t")
    return made(spark, d, t=NOTICES).select("k", X.project_no(t).alias("project_no"), X.unit_name(t).alias("unit"), X.agency_name(t).alias("agency"), X.has_money(t).alias("money"), X.has_quantity(t).alias("quantity"))


ANSWERS = ['{"a": #}', '<think>{"b": 1}</think> {"a": #}', '```json\n{"a": [#]}\n```', 'Here: {"a": {"c": #}} done', '{"a": ', "[#, 2]", "```\n[#]\n```", "see [1, #] there", "nothing"]


@query(
    f"""WITH c AS ({made_sql(t=ANSWERS)}), p AS (SELECT k, trim(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')) AS t FROM c),
x AS (SELECT k, regexp_extract(t, '(?s)\\{{.*\\}}') AS o, regexp_extract(t, '(?s)\\[.*\\]') AS l, t FROM p)
SELECT k, CASE WHEN o <> '' AND json_valid(o) THEN o END AS output, CASE WHEN k % {len(ANSWERS)} = 1 THEN NULL WHEN contains(t, '{{') THEN CASE WHEN o <> '' AND json_valid(o) THEN o END WHEN l <> '' AND json_valid(l) THEN l END AS answer FROM x"""
)
def model_outputs(spark, d):
    """A thinking part is cut by the first reading only; the second takes first to last brace, which is no JSON then."""
    t = F.col("t")
    return made(spark, d, t=ANSWERS).select("k", X.parse_json_output(t).alias("output"), X.parse_json_answer(t).alias("answer"))


FILES = ["a/b/分项报价 #.xlsx", "C:\\temp\\招标文件#.pdf", "中标结果公告#.html", "中小企业声明函#.docx", "评分办法与成交结果#.doc", "附件#?.pdf", "x" * 260 + "#.tar", "采购文件清单#.pdf", "授权委托#", "主要标的明细#.HTM"]
KINDS = ["xlsx", "pdf", "html", "docx", "doc", "pdf", "HTM"]
_NAME = "replace(t, chr(92), '/')"
_SAFE = f"regexp_replace(regexp_extract({_NAME}, '[^/]*$'), '[^A-Za-z0-9{_CJK}._()（）\\-]', '_', 'g')"


@query(
    f"""WITH c AS ({made_sql(t=FILES, kind=KINDS)}), s AS (SELECT *, {_SAFE} AS plain FROM c), e AS (SELECT *, regexp_extract(plain, '\\.[A-Za-z0-9]{{1,8}}$') AS ending FROM s),
terms(term, points) AS (VALUES {', '.join(f"('{t}', {p})" for t, p in L.SOURCE_BONUS.items())}),
bonus AS (SELECT k, sum(points) AS points FROM c, terms x WHERE contains(c.t, x.term) AND NOT EXISTS (SELECT 1 FROM terms y WHERE y.term <> x.term AND contains(y.term, x.term) AND contains(c.t, y.term)) GROUP BY k)
SELECT k, CASE WHEN length(plain) <= 240 THEN plain ELSE left(plain, 240 - length(ending)::INT) || ending END AS safe,
       (coalesce(points, 0) - CASE WHEN regexp_matches(t, '{any_of(L.NEGATIVE_SOURCE)}') THEN 18 ELSE 0 END
         - CASE WHEN regexp_matches(t, '{any_of(L.TEMPLATE_SOURCE)}') THEN CASE WHEN regexp_matches(t, '{any_of(L.TEMPLATE_RELIEF)}') THEN 5 ELSE 25 END ELSE 0 END)::INT AS bonus,
       CASE WHEN regexp_matches(t, '{any_of(L.LOW_VALUE_SOURCES)}') THEN 1
            WHEN regexp_matches(t, '{any_of(L.EXCLUDED_SOURCES + L.DRAFT_SOURCES)}') THEN CASE WHEN regexp_matches(t, '{any_of(L.RESULT_SOURCES)}') THEN 3 ELSE 0 END
            WHEN lower(kind) IN ('html', 'htm') THEN 4 WHEN regexp_matches(t, '{any_of(L.RESULT_SOURCES)}') THEN 4 ELSE 2 END::INT AS tier
FROM e LEFT JOIN bonus USING (k)"""
)
def source_policy(spark, d):
    t = F.col("t")
    return made(spark, d, t=FILES, kind=KINDS).select("k", X.safe_file_name(t).alias("safe"), policy.source_bonus(t, F.lit(None)).cast("int").alias("bonus"), policy.source_tier(t, F.col("kind")).alias("tier"))


HEADERS = ['attachment; filename="list #.pdf"', "attachment; filename*=UTF-8''%E6%B8%85%E5%8D%95#.xlsx; filename=x.xlsx", "inline", "attachment; filename=plain#.doc", None]


@query(
    f"""WITH c AS ({made_sql(t=HEADERS)}) SELECT k, CASE WHEN contains(t, 'filename*') THEN url_decode(regexp_extract(t, 'filename\\*=[^'']*''''([^;]+)', 1)) ELSE nullif(trim(regexp_extract(t, 'filename="?([^";]+)"?', 1)), '') END AS name,
list_aggregate(list_transform(['https', 'http'], lambda s: s || '://host' || (k % 3)::VARCHAR || '/oss/download?uuid=' || k::VARCHAR || ' ' || s || '://host' || (k % 3)::VARCHAR || '/download?uuid=' || k::VARCHAR), 'string_agg', ' ') AS urls FROM c"""
)
def download_names(spark, d):
    k = F.col("k").cast("string")
    urls = X.uuid_urls(F.concat(F.lit("http://host"), (F.col("k") % 3).cast("string")), k)
    return made(spark, d, t=HEADERS).select("k", X.disposition_name(F.col("t")).alias("name"), F.array_join(urls, " ").alias("urls"))


IDS = ["a#, b ,,c", " , ", "#", "x,y#,"]


@query(
    f"""WITH c AS ({made_sql(t=IDS)}), p AS (SELECT * FROM c JOIN part ON p_partkey = k)
SELECT k, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS ids,
       regexp_replace(printf('%.6f', (p_retailprice / p_size)::DOUBLE), '\\.?0+$', '') AS number_key, lower(regexp_replace(p_name, ' ', '', 'g')) AS text_key,
       CASE WHEN k * 977 < 1024 THEN (k * 977)::VARCHAR || ' B' WHEN k * 977 < 1048576 THEN printf('%.1f KB', floor(k * 977 / 102.4::DOUBLE + 0.5) / 10) ELSE printf('%.1f MB', floor(k * 977 / 104857.6::DOUBLE + 0.5) / 10) END AS size,
       CASE WHEN k % 7 = 0 THEN '—' ELSE '¥' || regexp_replace(format('{{:,.2f}}', p_retailprice::DOUBLE), '\\.?0+$', '') END AS money,
       CASE WHEN length(p_name) > 8 THEN left(p_name, 7) || '…' ELSE p_name END AS title, round(k / 1000000.0::DOUBLE * 2.5, 9) AS cost FROM p"""
)
def display_values(spark, d):
    part = C.read(spark, d, "part").withColumnRenamed("p_partkey", "k")
    rows = made(spark, d, t=IDS).join(part, "k")
    k = F.col("k")
    return rows.select(
        "k",
        F.array_join(X.parse_ids(F.col("t")), "|").alias("ids"),
        X.value_key(F.col("p_retailprice") / F.col("p_size"), True).alias("number_key"),
        X.value_key(F.col("p_name")).alias("text_key"),
        X.format_size(k * 977).alias("size"),
        X.format_money(F.when(k % 7 != 0, F.col("p_retailprice"))).alias("money"),
        X.short_title(F.col("p_name"), 8).alias("title"),
        F.round(X.cost(k, 2.5), 9).alias("cost"),
    )


@query(
    """WITH p AS (SELECT p_partkey::BIGINT AS k, (p_partkey * 7919) % 16777216 AS c, [p_size, p_partkey % 300, 10] AS parts FROM part)
SELECT k, array_to_string([round(((c >> 16) & 255) / 255.0::DOUBLE, 6), round(((c >> 8) & 255) / 255.0::DOUBLE, 6), round((c & 255) / 255.0::DOUBLE, 6)], ' ') AS rgb,
       array_to_string(list_transform(parts, lambda x: round(x / 255.0::DOUBLE, 6)), ' ') AS parts FROM p"""
)
def colours(spark, d):
    rows = C.read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 6).cast("string")), " ")
    value = ((F.col("k") * 7919) % 16777216).cast("int")
    return rows.select("k", text(X.rgb(value)).alias("rgb"), text(X.rgb_parts(F.array("p_size", (F.col("k") % 300).cast("int"), F.lit(10)))).alias("parts"))


_BOX = "SELECT l_orderkey AS document_id, l_linenumber AS page, l_partkey % 50 AS x0, l_suppkey % 40 AS y0, l_partkey % 50 + 20 AS x1, l_suppkey % 40 + 15 AS y1, (l_partkey * 3) % 50 AS u0, (l_suppkey * 7) % 40 AS v0, (l_partkey * 3) % 50 + 25 AS u1, (l_suppkey * 7) % 40 + 20 AS v1 FROM lineitem"


@query(
    f"""WITH b AS ({_BOX}), s AS (SELECT document_id, page % 3 AS page, x0, y0, x1, y1, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) / 300.0::DOUBLE AS share, page AS line FROM b)
SELECT document_id, line, page::INT AS page, round(share, 6) AS share FROM s"""
)
def box_overlaps(spark, d):
    rows = _boxes(spark, d)
    box = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1")]
    return rows.select("document_id", F.col("page").alias("line"), (F.col("page") % 3).cast("int").alias("page"), F.round(X.bbox_overlap(*box), 6).alias("share"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return C.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), (part % 50).alias("x0"), (supp % 40).alias("y0"), (part % 50 + 20).alias("x1"), (supp % 40 + 15).alias("y1"),
        ((part * 3) % 50).alias("u0"), ((supp * 7) % 40).alias("v0"), ((part * 3) % 50 + 25).alias("u1"), ((supp * 7) % 40 + 20).alias("v1"),
    )


@query(
    f"""WITH b AS (SELECT DISTINCT * FROM ({_BOX})), t AS (SELECT document_id, page, u0, v0, u1, v1 FROM b)
SELECT document_id, page, x0, y0, x1, y1, row_number() OVER (PARTITION BY document_id, page ORDER BY y0, x0, x1, y1) AS place FROM (SELECT DISTINCT document_id, page, x0, y0, x1, y1 FROM b) b
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = b.document_id AND t.page = b.page AND greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) >= 150)"""
)
def uncovered_paragraphs(spark, d):
    rows = _boxes(spark, d).distinct()
    paragraphs = rows.select("document_id", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct()
    tables = rows.select("document_id", "page", *[F.col(a).cast("double").alias(b) for a, b in (("u0", "x0"), ("v0", "y0"), ("u1", "x1"), ("v1", "y1"))])
    out = geometry.in_reading_order(geometry.uncovered(paragraphs, tables))
    return out.select("document_id", "page", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "place")


@query(
    """WITH p AS (SELECT user_id AS document_id, event_id AS page, CASE WHEN event_type = 'error' THEN 'seal' WHEN event_type = 'view' THEN repeat('x', 60) ELSE 'few' END AS t FROM events),
l AS (SELECT *, t = 'seal' AS first FROM p WHERE length(t) < 50), r AS (SELECT *, row_number() OVER (PARTITION BY document_id, first ORDER BY page) - 1 AS turn, greatest(0, 6 - sum(first::INT) OVER (PARTITION BY document_id)) AS k, sum((NOT first)::INT) OVER (PARTITION BY document_id) AS m FROM l)
SELECT document_id, page, first FROM r WHERE CASE WHEN first THEN turn < 6 WHEN k >= m THEN true WHEN k = 1 THEN turn = m // 2 WHEN k > 1 THEN list_contains(list_transform(range(0, k::BIGINT), lambda i: round_even(i * (m - 1) / (k - 1), 0)::BIGINT), turn) ELSE false END"""
)
def ocr_pages(spark, d):
    text = F.when(F.col("event_type") == "error", "seal").when(F.col("event_type") == "view", F.repeat(F.lit("x"), 60)).otherwise("few")
    pages = C.read(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("page"), text.alias("text"))
    return geometry.ocr_pages(pages, ("seal",), 6).select("document_id", "page", (F.col("text") == "seal").alias("first"))


@query(
    f"""SELECT p_partkey::BIGINT AS k, '| h\\|1 | h2 |' || chr(10) || '| --- | --- |' || chr(10) || '|  |  |' || chr(10) || '| ' || p_name || ' | ' || p_brand || '<br>x |' || chr(10) || '|  | ' || p_size::VARCHAR || ' |' AS markdown FROM part"""
)
def markdown_tables(spark, d):
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    body = row(F.col("p_name"), F.concat("p_brand", F.lit("\nx")), "")
    table = F.array(row("", "", ""), row("h|1", "h2", ""), row("", "", ""), body, row("", F.col("p_size").cast("string"), ""), row("", "", ""))
    rows = C.spread(C.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    trimmed = flow.settled(rows.select(F.col("p_partkey").cast("long").alias("k"), X.trim_table(table).alias("rows")))
    return trimmed.select("k", X.table_to_markdown(F.col("rows")).alias("markdown"))


RAW = ["a&amp;b\u00a0 c#\r\n\r\n\r\n\r\nd", "\u200bx \t y \n z#\u3000", "&lt;p&gt; #", "plain #", None]


@query(
    f"""WITH c AS ({made_sql(i=["1", "2", "3", "4", "5"])}) SELECT k, replace(CASE i WHEN '1' THEN 'a&b c#' || chr(10) || chr(10) || 'd' WHEN '2' THEN 'x y' || chr(10) || 'z#' WHEN '3' THEN '<p> #' WHEN '4' THEN 'plain #' ELSE '' END, '#', k::VARCHAR) AS plain,
CASE k % 3 WHEN 0 THEN 'f' || k::VARCHAR || ', sheet=s, row=' || (k % 9)::VARCHAR WHEN 1 THEN 'f' || k::VARCHAR || ', row=' || (k % 9)::VARCHAR ELSE 'f' || k::VARCHAR || ', sheet=s' END AS location,
CASE WHEN k % 4 < 2 THEN 'r' || (k % 4 + 1)::VARCHAR || ' ｜ x' ELSE 'text' || k::VARCHAR END AS excerpt FROM c"""
)
def block_texts(spark, d):
    k = F.col("k")
    rows = F.array(F.array(F.lit("r1"), F.lit("x")), F.array(F.lit("r2"), F.lit("x")))
    location = X.source_location(file=F.concat(F.lit("f"), k.cast("string")), sheet=F.when(k % 3 != 1, F.lit("s")), row=F.when(k % 3 != 2, (k % 9).cast("int")))
    return made(spark, d, t=RAW).select("k", X.normalise_text(F.col("t")).alias("plain"), location.alias("location"), X.excerpt(rows, (k % 4 + 1).cast("int"), F.concat(F.lit("text"), k.cast("string"))).alias("excerpt"))


@query(
    """SELECT p_partkey::BIGINT AS k, '{"a":' || p_size::VARCHAR || ',"b":"' || p_name || '","c":null}' AS canonical, sha256('block|' || p_name) AS digest,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE strftime(DATE '2024-01-01' + (p_partkey % 300)::INT, '%Y-%m-%d') END AS notice_date FROM part"""
)
def content_keys(spark, d):
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyyMMdd")
    raw = F.concat(F.lit('{"c": null, "b": "'), "p_name", F.lit('", "a": '), F.col("p_size").cast("string"), F.lit("}"))
    return C.read(spark, d, "part").select(
        k.cast("long").alias("k"), X.canonical_json(raw).alias("canonical"), F.sha2(F.concat(F.lit("block|"), "p_name").cast("binary"), 256).alias("digest"), X.notice_date(F.when(k % 9 == 0, F.lit("20241399_x")).otherwise(F.concat(day, F.lit("_z")))).alias("notice_date")
    )


# ---- policy

PRODUCTS = ["打印机#", "合计#", "", None, "详见附件", "投标人名称（盖章）#", "椅子", "桌子#"]
BRANDS = ["B#", None, "椅子", "同#"]
SPECS = ["S#", "椅子", "同#"]


@query(
    f"""WITH c AS ({made_sql(p=PRODUCTS, b=BRANDS, s=SPECS)}), x AS (SELECT *, {compact4_sql("p")} AS np, {compact4_sql("b")} AS nb, {compact4_sql("s")} AS ns, k % 5 AS tier FROM c)
SELECT k, CASE WHEN tier = 0 THEN 'procurement_source' WHEN np = '' THEN 'missing_product_name' WHEN regexp_matches(np, '^{any_of(L.SUMMARY_PREFIXES)}') THEN 'summary_or_total_row'
  WHEN regexp_matches(np, '{any_of(L.POLICY_TEMPLATE_ROWS)}') THEN 'blank_quotation_template' WHEN np <> '' AND np = nb AND nb = ns OR nb <> '' AND nb = ns AND ns = '同' || k::VARCHAR AND k % 11 = 0 THEN 'same_template_text_mapped_to_multiple_fields' END AS reason FROM x"""
)
def item_policy(spark, d):
    """The unit repeats the specification for every eleventh key."""
    rows = made(spark, d, p=PRODUCTS, b=BRANDS, s=SPECS)
    k = F.col("k")
    unit = F.when(k % 11 == 0, F.col("s")).otherwise(F.lit("台"))
    return rows.select("k", policy.item_non_result((k % 5).cast("int"), F.col("p"), F.col("b"), F.col("s"), unit).alias("reason"))


TOPS = ["货物名称|数量|单价", "标的名称|最高限价|数量", "技术参数及要求|所属行业|名称", "品名|规格型号|备注"]
BODIES = ["打印机#|1|2", "合计|1|2", "投标人须提供#|1|2", "详见附件|见附件|2", "大写)￥(小写|1|2"]


@query(
    f"""WITH c AS ({made_sql(h=TOPS, b=BODIES)}), x AS (SELECT *, {compact4_sql("h")} AS head, {compact4_sql("b")} AS body, k % 5 AS tier, k % 3 = 0 AS two FROM c),
r AS (SELECT *, CASE WHEN tier = 0 THEN 'procurement_source' WHEN regexp_matches(body, '{any_of(L.REQUIREMENT_TEXT)}') THEN 'procurement_requirement_text' WHEN regexp_matches(head, '{any_of(L.BUDGET_HEADERS)}') THEN 'budget_or_price_ceiling_table'
  WHEN regexp_matches(body, '{any_of(L.POLICY_TEMPLATE_ROWS)}') THEN 'blank_quotation_template' WHEN NOT two AND (regexp_matches(body, '^合计') OR regexp_matches(body, '^详见附件')) THEN 'no_concrete_product_rows'
  WHEN contains(head, '技术参数及要求') AND contains(head, '所属行业') THEN 'procurement_requirement_table' END AS reason FROM x)
SELECT k, reason, reason IS NULL AND k % 2 = 0 AND (k % 4 = 0 OR k % 6 = 0) AS fast, reason IS NULL AND tier >= 3 AS cover FROM r"""
)
def table_policy(spark, d):
    rows = made(spark, d, h=TOPS, b=BODIES)
    k = F.col("k")
    data = F.when(k % 3 == 0, F.array(F.split("b", r"\|"), F.array(F.lit("椅子"), F.lit("2"), F.lit("3")))).otherwise(F.array(F.split("b", r"\|")))
    rows = rows.withColumn("reason", policy.table_non_result((k % 5).cast("int"), F.split("h", r"\|"), data, F.lit(0)))
    fields = F.when(k % 4 == 0, F.array(F.lit("product_service_name"), F.lit("quantity"), F.lit("unit_price"))).when(k % 6 == 0, F.array(F.lit("product_service_name"), F.lit("spec_model"), F.lit("total_price"))).otherwise(F.array(F.lit("product_service_name"), F.lit("quantity")))
    kind = F.when(k % 2 == 0, "table").otherwise("text")
    return rows.select("k", "reason", policy.can_use_fast_path(kind, data, F.col("reason"), fields).alias("fast"), policy.can_cover(F.col("reason"), (k % 5).cast("int")).alias("cover"))


TEXTS = ["由供应商填写 #", "投标日期：ＸＸＸＸ", "中标 #", "严格按照招标文件要求"]


@query(
    f"""WITH c AS ({made_sql(t=TEXTS)}) SELECT k, CASE WHEN k % 4 = 3 THEN 'procurement_source' WHEN regexp_matches({compact4_sql("t")}, '{any_of(L.TEMPLATE_TEXT)}') THEN 'blank_procurement_form_text' END AS reason FROM c"""
)
def text_policy(spark, d):
    k = F.col("k")
    tiers = F.when(k % 4 == 3, F.array(F.lit(0), F.lit(0))).when(k % 4 == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return made(spark, d, t=TEXTS).select("k", policy.text_non_result(tiers, F.array("t", F.lit("x"))).alias("reason"))


@query(
    """WITH e AS (SELECT l_orderkey AS o, l_partkey AS doc, l_suppkey % 5 AS tier, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no_concrete_product_rows' ELSE 'procurement_source' END AS reason FROM lineitem),
x AS (SELECT DISTINCT doc FROM e WHERE reason IS NOT NULL AND reason <> 'no_concrete_product_rows' AND tier < 4)
SELECT o AS request_id, bool_and(x.doc IS NOT NULL) AS excluded FROM e LEFT JOIN x USING (doc) GROUP BY 1"""
)
def excluded_requests(spark, d):
    n = F.col("l_linenumber") % 4
    reason = F.when(n == 1, "no_concrete_product_rows").when(n > 1, "procurement_source")
    doc = F.col("l_partkey").cast("string")
    lines = C.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), doc.alias("document_id"), (F.col("l_suppkey") % 5).cast("int").alias("tier"), reason.alias("reason"))
    evidence = lines.select("reason", F.array("document_id").alias("document_ids"), F.array("tier").alias("tiers"))
    requests = lines.groupBy("request_id").agg(F.collect_set("document_id").alias("document_ids"))
    return policy.in_excluded(requests, policy.excluded_documents(evidence)).select("request_id", "excluded")


URLS = ["http://x/cggg/#", "http://x/zbgg/#"]
TITLES = ["中标公告#", "废标公告#", "更正公告", "成交公告#", None]


@query(
    f"""WITH c AS ({made_sql(u=URLS, t=TITLES)}) SELECT k, CASE WHEN k % 3 = 0 THEN 'column' WHEN NOT contains(u, '/cggg/') THEN 'url' WHEN regexp_matches(t, '{L.EXCLUDED_TITLES}') THEN 'title' END AS refused,
CASE WHEN k % 4 = 0 THEN 'empty_html' WHEN t IS NULL THEN 'missing_title' WHEN k % 7 = 0 THEN 'bad_zip' WHEN k % 11 = 0 THEN 'crc_error' WHEN k % 13 = 0 THEN 'no_real_member' END AS pair FROM c"""
)
def admission(spark, d):
    k, t = F.col("k"), F.col("t")
    column = F.when(k % 3 == 0, "news").when(k % 3 == 1, "win").otherwise("deal")
    return made(spark, d, u=URLS, t=TITLES).select(
        "k",
        policy.admission_reason(column, F.col("u"), F.coalesce(t, F.lit("")), ("win", "deal")).alias("refused"),
        policy.pair_reason(F.when(k % 4 == 0, F.when(k % 8 == 0, 0)).otherwise(10), t, k % 7 != 0, k % 11 != 0, F.when(k % 13 == 0, 0).otherwise(2)).alias("pair"),
    )


# ---- headers and scores

HEADS = [
    "序号|货物名称|品牌|规格型号|数量|单价|总价",
    "采购标的|品目名称|品目编码|制造商|单位|金额",
    "标的名称|中标金额（元）|供应商名称",
    "服务名称|服务范围|服务要求|服务时间|服务标准",
    "品名|型号及规格|含税单价(元)|采购数量|合价",
    "编号|备注",
]
#: Columns of the heads above by the rules of header matching, worked out by hand: fields in their order, equal names before
#: others, each column once.
FOUND = [
    "product_service_name=1,brand_supplier=2,spec_model=3,unit_price=5,quantity=4,total_price=6",
    "product_service_name=0,category_name=1,category_code=2,brand_supplier=3,quantity_unit=4,total_price=5",
    "product_service_name=0,total_price=1",
    "product_service_name=0",
    "product_service_name=0,spec_model=1,unit_price=2,quantity=3,total_price=4",
    "",
]
SERVED = ["", "", "", "service_scope=1,service_requirements=2,service_time=3,service_standard=4", "", ""]


def _listed(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query(f"WITH c AS ({made_sql(f=FOUND, s=SERVED)}) SELECT k, f AS fields, s AS service, k % {len(HEADS)} <> 5 AND k % {len(HEADS)} <> 2 OR k % {len(HEADS)} = 2 AS strong FROM c")
def matched_headers(spark, d):
    """Strong headers name a product and a brand, a model, a number or a service column."""
    tables = made(spark, d, t=HEADS).select("k", F.array(F.array(F.lit("题")), F.split("t", r"\|"), F.array(F.lit("x"), F.lit("y"))).alias("rows"))
    found = selection.with_local_header(tables)
    return found.select("k", _listed(F.col("fields")).alias("fields"), _listed(F.col("service")).alias("service"), "strong_header").withColumnRenamed("strong_header", "strong")


BLOCKS = ["主要标的信息：货物名称 打印机 单价 #元 数量 3台", "中标 #", "版权所有 单价 #", "分项报价 成交 #万元", "abc", "品牌 型号 规格型号 报价 # 元", None]
ROLES = ["heading", "paragraph", "ocr_text", "image", "table"]


def count_sql(x: str, terms) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({x}, '{t}') THEN 1 ELSE 0 END" for t in terms) + ")"


@query(
    f"""WITH c AS ({made_sql(t=BLOCKS, kind=ROLES)}), x AS (SELECT k, kind, {line_sql("t")} AS line FROM c),
n AS (SELECT *, {count_sql("line", L.STRONG_PHRASES)} AS strong, {count_sql("line", L.FIELD_TERMS)} AS fields, {count_sql("line", L.OUTCOME_TERMS)} AS outcome, regexp_matches(line, '{L.MONEY}') AS money, regexp_matches(line, '{L.QUANTITY}') AS quantity FROM x)
SELECT k, CASE WHEN kind <> 'image' AND length(line) >= 4 AND NOT (length(line) < 120 AND regexp_matches(line, '{any_of(L.BOILERPLATE)}')) AND (strong > 0 OR fields > 0 OR money)
THEN (6 + least(20, 9 * strong) + least(14, 2 * fields) + least(6, 2 * outcome) + CASE WHEN money THEN 4 ELSE 0 END + CASE WHEN quantity THEN 3 ELSE 0 END + CASE WHEN kind = 'heading' AND strong > 0 THEN 3 ELSE 0 END)::INT END AS score FROM n"""
)
def text_scores(spark, d):
    rows = made(spark, d, t=BLOCKS, kind=ROLES)
    return rows.select("k", selection.text_score(F.col("kind"), F.col("t"), F.lit("成交公告.html"), F.lit("")).cast("int").alias("score"))


RELATIONS = ["供应商名称 甲公司 投标 报价 得分 #", "评审结果：中标 成交 候选", "由供应商填写 #", "天气 #", None, "采购人 代理机构 项目编号 #"]
ORIGINS = ["中标结果#.html", "招标文件#.pdf", "附件#.pdf", "承诺函#.doc", "评审情况#.pdf"]


@query(
    f"""WITH c AS ({made_sql(t=RELATIONS, f=ORIGINS)}), x AS (SELECT k, coalesce(t, '') AS body, f, CASE WHEN k % 2 = 0 THEN 'table' ELSE 'paragraph' END AS kind, regexp_extract(f, '\\.(\\w+)$', 1) AS ft FROM c),
s AS (SELECT *, {count_sql("body", L.RELATION_KEYWORDS)} + CASE WHEN kind = 'table' THEN 3 ELSE 0 END + CASE WHEN ft = 'html' THEN 8 ELSE 0 END + CASE WHEN regexp_matches(f, '{any_of(L.RELATION_RESULT_SOURCES)}') THEN 8 ELSE 0 END + 3 * {count_sql("body", L.RELATION_STRONG)} AS score FROM x)
SELECT k, CASE WHEN score > 0 AND NOT regexp_matches(f, '{any_of(L.RELATION_EXCLUDED + L.RELATION_LOW_VALUE)}') AND NOT regexp_matches(body, '{any_of(L.RELATION_BLANK)}') THEN score::INT END AS score FROM s"""
)
def relation_scores(spark, d):
    rows = made(spark, d, t=RELATIONS, f=ORIGINS)
    kind = F.when(F.col("k") % 2 == 0, "table").otherwise("paragraph")
    return rows.select("k", selection.relation_score(kind, F.col("t"), F.col("f"), F.lit(None), F.regexp_extract("f", r"\.(\w+)$", 1)).cast("int").alias("score"))


@query(
    """SELECT p_partkey::BIGINT AS k, (30 * (p_partkey % 6) + least(p_size * 3, 60) + p_partkey % 4 - p_partkey % 3)::INT AS silver,
       CASE WHEN p_partkey % 7 = 0 THEN 'template' WHEN p_partkey % 2 = 0 AND p_partkey % 5 >= 2 THEN 'potential_result' ELSE 'low' END AS risk FROM part"""
)
def silver_scores(spark, d):
    k = F.col("p_partkey")
    silver = selection.silver_score(k % 6, F.col("p_size") * 3, k % 4, k % 3)
    return C.read(spark, d, "part").select(k.cast("long").alias("k"), silver.cast("int").alias("silver"), selection.risk(k % 2 == 0, k % 5, k % 7 == 0).alias("risk"))
