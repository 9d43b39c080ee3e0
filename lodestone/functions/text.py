"""Scalar functions as Spark columns.  Survey numbers are in the docstrings.

Everything that Spark's own functions can express stays in the JVM.  Only Unicode normalization, sequence similarity and
HTML entities go through Arrow functions, and those see only the rows that need them.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L

#: Spaces as Unicode has them.
_SPACE = r"(?U)\s+"
_CJK = "\u4e00-\u9fff"


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it (a column named twice is computed twice,
    and nested ones multiply).  No Arrow function may stand inside ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_any(text: Column, terms) -> Column:
    """True if ``text`` holds one of ``terms``; one expression, however many terms there are."""
    return text.rlike("|".join(re.escape(t) for t in terms))


def holds_any(terms):
    """Test of :func:`contains_any` for higher-order functions."""
    return lambda text: contains_any(text, terms)


def count_terms(text: Column, terms) -> Column:
    """How many of ``terms`` the text holds."""
    return once(text, lambda x: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: x.contains(t))))


def _folded(function, text: Column) -> Column:
    """``function`` (text to text) on rows outside ASCII only; the others keep their value."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(run(F.when(~ascii_only, text)), text)


def nfkc(text: Column) -> Column:
    return _folded(lambda x: unicodedata.normalize("NFKC", x), text)


def compact(text: Column) -> Column:
    """X-03: lower case, full-width brackets to plain ones, no spaces; null is empty."""
    plain = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "（）", "()")
    return F.regexp_replace(plain, _SPACE, "")


def compact_nfkc(text: Column) -> Column:
    """X-04: as X-03 after NFKC, full-width colons plain too."""
    plain = F.translate(F.lower(nfkc(F.coalesce(text.cast("string"), F.lit("")))), "（）：", "():")
    return F.regexp_replace(plain, _SPACE, "")


def compact_cell(text: Column) -> Column:
    """X-03 without lower case, as the relation candidates read cells."""
    return F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), "（）", "()"), _SPACE, "")


def one_line(text: Column) -> Column:
    """Runs of spaces to one, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, " "))


def canonical_product_name(text: Column) -> Column:
    """X-05."""
    return canonical_compact(compact_nfkc(text))


def canonical_compact(text: Column) -> Column:
    """X-05 of a text as X-04 gives it."""
    bare = F.regexp_replace(text, "[▲■★●◆·•]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\((?:核心产品|核心标的)\)", ""), f"[^0-9a-z{_CJK}]+", "")


def clean_text(text: Column) -> Column:
    """X-06: one line, no punctuation at the ends, no spaces between Chinese characters; placeholders are null."""

    def held(tight: Column) -> Column:
        bare = F.regexp_replace(tight, "[，,。；;：:、]", "")
        empty = tight.isin(*L.PLACEHOLDERS) | tight.startswith("详见附件") | tight.startswith("见附件") | contains_any(tight, ("详见公告附件", "详见分项报价"))
        return empty | once(bare, lambda b: b.isin(*L.PLACEHOLDERS) | b.contains("参数较多详见"))

    def clean(given: Column) -> Column:
        line = F.btrim(one_line(given), F.lit(" \t\r\n;；,，、。.：:"))
        line = F.regexp_replace(line, f"(?<=[{_CJK}])(?U:\\s+)(?=[{_CJK}])", "")
        return F.when(given.isNotNull(), once(line, lambda x: F.when(~once(compact(x), held), x)))

    return once(text, clean)


def _scaled(text: Column) -> Column:
    def scaled(t: Column) -> Column:
        digits = F.regexp_extract(t, r"[-+]?\d[\d,，]*(?:\.\d+)?", 0)
        number = once(F.regexp_replace(digits, "[,，]", "").try_cast("decimal(28,6)"), lambda n: F.when(t.contains("万元"), n * 10000).otherwise(n).cast("decimal(28,6)"))
        return once(number, lambda n: F.when(n >= 0, n))

    return once(text, scaled)


def parse_number(text: Column) -> Column:
    """X-07: first number, digits split by spaces joined, 万元 as ten thousand; negative is null."""
    joined = F.regexp_replace(F.trim(text.cast("string")), r"(?<=\d)(?U:\s+)(?=\d)", "")
    return _scaled(joined)


def relation_number(text: Column) -> Column:
    """X-08: first number as it stands, 万元 as ten thousand."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    return _scaled(plain).cast("double")


def parse_quantity(text: Column, unit: Column | None = None) -> tuple[Column, Column]:
    """X-09: number and unit; an explicit unit first, then what follows the number, then the known units."""
    number = parse_number(text)
    given = clean_text(unit) if unit is not None else F.lit(None).cast("string")
    units = F.array(*[F.lit(u) for u in L.QUANTITY_UNITS])

    def after(plain: Column) -> Column:
        follows = clean_text(F.regexp_extract(plain, rf"(?U)\d(?:[\d,.，]*)(?:\.\d+)?\s*\(?\s*([A-Za-z]+\d?|[{_CJK}]{{1,6}})\s*\)?", 1))
        known = F.get(F.filter(units, lambda u: F.rlike(plain, F.concat(F.lit(r"(?U)\d(?:[\d,.，]*)(?:\([^)]*\))?\s*"), u))), F.lit(0))
        return F.coalesce(follows, known)

    return number, F.coalesce(given, F.when(number.isNotNull(), once(F.coalesce(text.cast("string"), F.lit("")), after)))


_CODE = r"(?iU)\b([A-Z]\d{6,8}|\d{6,8})\b"


def normalize_category_code(text: Column) -> Column:
    """X-10: the first category code."""
    return once(F.regexp_extract(clean_text(text), _CODE, 1), lambda c: F.when(c != "", c))


def split_category(text: Column) -> tuple[Column, Column]:
    """X-10: name and code of a category."""

    def bare(cleaned: Column) -> Column:
        rest = once(F.split(cleaned, _CODE, 2), lambda p: F.concat(F.element_at(p, 1), F.lit(" "), F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))))
        return F.when(F.regexp_extract(cleaned, _CODE, 1) != "", clean_text(F.btrim(rest, F.lit(" -—（）()")))).otherwise(cleaned)

    cleaned = clean_text(text)
    return once(cleaned, bare), once(F.regexp_extract(cleaned, _CODE, 1), lambda c: F.when(c != "", c))


def strict_category(text: Column) -> tuple[Column, Column]:
    """X-11: ``X00000000 name`` as a whole, else the text is the name."""
    whole = r"^\s*([A-Z]\d{8})\s+(.+?)\s*$"
    hit = text.rlike(whole)
    return F.when(hit, F.regexp_extract(text, whole, 2)).otherwise(text), F.when(hit, F.regexp_extract(text, whole, 1))


def strict_number(text: Column) -> Column:
    """X-11: a number and nothing else; anything else is null rather than an error."""
    return F.regexp_replace(F.trim(text), "[,，]", "").try_cast("decimal(28,6)")


def normalize_org_name(text: Column) -> Column:
    """X-01: NFKC, plain brackets, no spaces, no commas and stops, case folded."""
    plain = F.translate(nfkc(F.coalesce(text, F.lit(""))), "（）", "()")
    bare = F.regexp_replace(F.regexp_replace(plain, _SPACE, ""), "[，,。；;：:、]", "")
    return F.lower(_folded(str.casefold, bare))


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """X-02: prefix and hash of the parts; null, empty and zero are the same."""
    texts = [F.when(p.cast("string").isin("0", "0.0", "false"), F.lit("")).otherwise(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *texts).cast("binary"), 256), 1, length))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    """X-12: matching-block ratio of two texts; not symmetric, the later text comes first."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(new, old)], dtype="float64")


def bag_bound(one: Column, two: Column) -> Column:
    """Upper bound of X-12 from lengths alone."""
    return 2.0 * F.least(F.length(one), F.length(two)) / F.greatest(F.lit(1), F.length(one) + F.length(two))


def match_text(text: Column) -> Column:
    """X-13: NFKC, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)[\W_]", ""))


def normalise_text(text: Column) -> Column:
    """X-14: entities resolved, odd spaces plain, zero-width marks gone, lines trimmed, two line ends at most."""
    entity = F.pandas_udf(lambda v: v.map(html.unescape, na_action="ignore"), T.StringType())
    plain = F.coalesce(entity(F.when(text.contains("&"), text)), text, F.lit(""))
    plain = F.regexp_replace(F.translate(plain, "\u00a0\u3000", "  "), "[\u200b\ufeff]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "\r\n|\r|\x0b|\x0c|\u0085|\u2028|\u2029", "\n"), "[\t ]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, " ?\n ?", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def trim_table(rows: Column) -> Column:
    """X-15: blank rows at both ends and blank last columns go, rows are padded to one width."""
    # columns up to the last one with text
    width = lambda row: F.size(row) + 1 - once(F.array_position(F.reverse(F.transform(row, lambda c: F.coalesce(c != "", F.lit(False)))), F.lit(True)), lambda p: F.when(p > 0, p).otherwise(F.size(row) + 1))

    def padded(kept: Column) -> Column:
        pad = lambda w: F.transform(kept, lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), w)), F.lit(1), w))
        return once(F.array_max(F.transform(kept, width)).cast("int"), pad)

    def trimmed(all_rows: Column) -> Column:
        marks = F.transform(all_rows, lambda row: F.exists(row, lambda c: c != ""))
        return once(marks, lambda m: once(F.array_position(m, F.lit(True)).cast("int"), lambda first: F.when(first > 0, padded_rows(all_rows, m, first)).otherwise(F.array().cast("array<array<string>>"))))

    def padded_rows(all_rows: Column, marks: Column, first: Column) -> Column:
        last = F.size(all_rows) - F.array_position(F.reverse(marks), F.lit(True)).cast("int") + 1
        return once(F.slice(all_rows, first, last - first + 1), padded)

    return once(rows, trimmed)


def table_to_markdown(rows: Column) -> Column:
    """SNK-09: a Markdown table; ragged rows are padded, bars and line ends escaped."""
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))

    def drawn(table: Column, width: Column) -> Column:
        line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width), cell), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        whole = once(F.transform(table, line), lambda t: F.concat(F.array(F.element_at(t, 1), rule), F.slice(t, F.lit(2), F.size(t))))
        return F.array_join(whole, "\n")

    return once(rows, lambda t: F.when(F.size(t) > 0, once(F.array_max(F.transform(t, F.size)).cast("int"), lambda w: drawn(t, w))).otherwise(""))


def clean_org_name(text: Column) -> Column:
    """X-16: what stands before an address or a telephone number."""
    head = F.element_at(F.split(one_line(text), r"(?i)(?:<br\s*/?>|\|\s*地址|地址\s*[：:]|联系方式\s*[：:]|联系电话\s*[：:])", 2), 1)
    return F.btrim(head, F.lit(" ：:，,；;|"))


def valid_org_name(text: Column) -> Column:
    """F-18."""

    def valid(name: Column) -> Column:
        base = F.regexp_replace(name, "[（(](?:联合体|牵头人|成员|成员单位|个人独资|有限合伙|普通合伙).{0,40}[）)]$", "")
        good = F.length(name).between(2, 120) & ~contains_any(name, L.ORG_PROSE) & ~name.rlike(r"^[-+]?\d[\d,，]*(?:\.\d+)?$") & ~name.isin(*L.NOT_ORGS)
        return good & base.rlike(f"(?:{'|'.join(L.ORG_SUFFIXES)})$")

    return once(compact_cell(text), valid)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?U){pattern}", 1), F.lit(""))


def project_no(text: Column) -> Column:
    """X-17."""
    return _first(text, r"(?:项目编号|采购编号|招标编号)\s*[：:]\s*([^\s，,；;]{3,80})")


def unit_name(text: Column) -> Column:
    """X-17."""
    return _first(text, r"(?:采购人|采购单位)(?:信息)?\s*(?:名称)?\s*[：:]\s*([^\n；;]{2,200})")


def agency_name(text: Column) -> Column:
    """X-17."""
    return _first(text, r"(?:代理机构|采购代理机构)(?:信息)?\s*(?:名称)?\s*[：:]\s*([^\n；;]{2,200})")


def has_money(text: Column) -> Column:
    """X-18."""
    return text.rlike(f"(?U){L.MONEY}")


def has_quantity(text: Column) -> Column:
    """X-18."""
    return text.rlike(f"(?U){L.QUANTITY}")


def notice_date(notice_id: Column) -> Column:
    """X-19: the date that an id begins with, as text; null if there is none."""
    head = F.regexp_extract(notice_id, r"^(\d{8})", 1)
    return F.date_format(F.try_to_date(F.nullif(head, F.lit("")), "yyyyMMdd"), "yyyy-MM-dd")


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """X-20: JSON text with sorted keys and nulls kept."""
    return values.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")), na_action="ignore")


def strip(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.  Parsing alone passes over what follows a first value, so the
    text is read as the one element of an array."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(whole.isNotNull() & F.try_variant_get(whole, "$[0]", "variant").isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull(), F.lit(False))


def parse_json_output(raw: Column) -> Column:
    """X-22: the JSON object in a model's answer: thinking and fences go, else first to last brace; null if broken."""
    plain = strip(F.regexp_replace(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*", ""))
    plain = F.when(plain.startswith("```"), strip(F.regexp_replace(F.regexp_replace(plain, r"^```[^\n]*\n", ""), r"\n?```\s*$", ""))).otherwise(plain)
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    is_object = lambda x: x.startswith("{") & is_json(x)
    return F.when(is_object(plain), plain).when(is_object(braces), braces)


def parse_json_answer(raw: Column) -> Column:
    """X-23: as X-22, arrays too."""
    plain = strip(F.regexp_replace(F.regexp_replace(raw, r"^\s*```(?:json)?", ""), r"```\s*$", ""))
    cut = F.when(plain.contains("{"), F.regexp_extract(plain, r"(?s)(\{.*\})", 1)).otherwise(F.regexp_extract(plain, r"(?s)(\[.*\])", 1))
    return F.when(is_json(plain), plain).when(is_json(cut), cut)


def safe_file_name(name: Column, longest: int = 240) -> Column:
    """X-24: letters, digits and a few marks; the ending survives the cut."""
    plain = F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), rf"[^A-Za-z0-9{_CJK}._()（）\-]", "_")
    ending = F.regexp_extract(plain, r"(\.[A-Za-z0-9]{1,8})$", 1)
    return F.when(F.length(plain) <= longest, plain).otherwise(F.concat(F.substring(plain, F.lit(1), F.lit(longest) - F.length(ending)), ending))


def source_location(**parts: Column) -> Column:
    """X-27: what is known of a place, comma-joined; the first part without its name."""
    (first, head), *rest = parts.items()
    return F.concat_ws(", ", head, *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c.cast("string"))) for name, c in rest])


def excerpt(rows: Column, row: Column, text: Column) -> Column:
    """X-28: the cells of a row, or the head of the text."""
    cells = F.try_element_at(rows, row)
    return F.coalesce(F.array_join(cells, " ｜ "), F.substring(text, 1, 4000))


def parse_ids(text: Column) -> Column:
    """X-29: comma-separated ids, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def value_key(value: Column, numeric: bool = False) -> Column:
    """X-30: numbers to six places without trailing zeros, texts compact; null is empty."""
    if not numeric:
        return compact(value)
    text = F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")
    return F.when(value.isNull(), "").otherwise(text)


def format_size(size: Column) -> Column:
    """X-31: bytes for readers."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / 1024**2))


def format_money(yuan: Column) -> Column:
    """X-31: yuan with thousands, two places at most."""
    return F.when(yuan.isNull(), "—").otherwise(F.concat(F.lit("¥"), F.regexp_replace(F.format_number(yuan.cast("double"), 2), r"\.?0+$", "")))


def short_title(text: Column, longest: int = 40) -> Column:
    """X-31."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 1), F.lit("…"))).otherwise(text)


def label(value: Column, labels: dict[str, str]) -> Column:
    """X-32: the label of a value, or the value where it has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value), value)


def cost(tokens: Column, price_per_million: float) -> Column:
    """X-33."""
    return tokens.cast("double") / 1_000_000 * price_per_million


def rgb(value: Column) -> Column:
    """X-34: 0xRRGGBB to shares of one."""
    part = lambda shift: F.shiftright(value, shift).bitwiseAND(255).cast("double") / 255
    return F.when(value.isNotNull(), F.array(part(16), part(8), part(0)))


def rgb_parts(parts: Column) -> Column:
    """X-34: three or more components; above one they are of 255."""
    three = F.transform(F.slice(parts, 1, 3), lambda x: x.cast("double"))
    return F.when(F.size(parts) >= 3, F.when(F.array_max(three) > 1, F.transform(three, lambda x: x / 255)).otherwise(three))


def bbox_overlap(x0: Column, y0: Column, x1: Column, y1: Column, u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """SRC-09: share of the first box that the second covers; 0 for an empty box."""
    zero = F.lit(0.0)
    shared = F.greatest(zero, F.least(x1, u1) - F.greatest(x0, u0)) * F.greatest(zero, F.least(y1, v1) - F.greatest(y0, v0))
    area = F.greatest(zero, x1 - x0) * F.greatest(zero, y1 - y0)
    return F.when(area > 0, shared / area).otherwise(zero)


def ascii_like(text: Column, needle: str) -> Column:
    """F-03: substring match without regard to ASCII case; % and _ in the needle stay wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = "".join(c.lower() if c in upper else c for c in needle)
    return F.translate(F.coalesce(text, F.lit("")), upper, lower).like(f"%{folded}%")


def uuid_urls(base: Column, uuid: Column) -> Column:
    """X-25: candidate download addresses in order, without repeats."""
    hosts = [F.regexp_replace(base, "^https?", scheme) for scheme in ("https", "http")]
    return F.array_distinct(F.array(*[F.concat(h, F.lit(p), uuid) for h in hosts for p in ("/oss/download?uuid=", "/download?uuid=")]))


def disposition_name(header: Column) -> Column:
    """X-26: file name of a Content-Disposition header, the encoded form first."""
    wide = F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*''([^;]+)", 1)
    plain = F.regexp_extract(header, r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1)
    return F.when(wide != "", F.try_url_decode(wide)).when(plain != "", F.trim(plain))
