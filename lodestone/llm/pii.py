"""Personal data: generators propose spans, boosted trees over format and context choose among them.

All text work is in DataFrame operations.  One pass cuts each text at the matches of each pattern; a running sum of the
lengths of gaps and matches, over the few rows that are left, gives code-point offsets.

Base kinds (email, ip, card, phone) follow fixed rules and always stand.  Wider generators propose more spans, which may
overlap: assigned secrets, long numbers, numbers grouped as identifiers or telephone numbers, dotted numbers, account
numbers.  Each candidate is described by format and by the context on both sides; the trees, fitted here on rows made by a seeded rule, give a
probability, and a threshold calibrated on held-out rows of that kind selects.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting
from .common import flagged, stored, table

BASE = ("email", "ip", "card", "phone")
WIDE = ("secret", "id", "number", "tel", "dotted", "iban")
#: Patterns of the base kinds, written so that a search never starts twice within one run of characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z0-9_])(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key)\x20{0,3}[=:]\x20{0,3}\"?[A-Za-z0-9+/_.-]{6,}+\"?",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){7,}+",
    "tel": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "dotted": r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: A cheap look that a text must pass before its pattern runs.
LOOKS = {
    "email": "contains(_text, '@')",
    "ip": r"_text rlike '[0-9]\\.[0-9]'",
    "card": r"_text rlike '[0-9][ -]?[0-9]'",
    "phone": "contains(_text, '+')",
    "secret": "_text rlike '[=:]'",
    "id": "_text rlike '[0-9]-[0-9]'",
    "number": "_text rlike '[0-9][ -]?[0-9]'",
    "tel": "_text rlike '[0-9]{3}[ .-][0-9]{4}'",
    "dotted": r"_text rlike '[0-9]\\.[0-9]'",
    "iban": "_text rlike '[A-Z][A-Z][0-9][0-9]'",
}
#: Words before a span that speak for personal data.
CUES = "card|visa|account|acct|iban|ssn|social|passport|licen|phone|tel|call|mobile|fax|ip|address|host|id|token|secret|pass|key|login|user"
AGAINST = "version|release|order|page|total|pi|ratio|isbn|issue|figure|section|build|part|rev"
#: Words after a span that speak against it.
UNITS = "kg|km|cm|mm|ml|mb|gb|kb|usd|eur|dollars|euros|percent|pages|items|units|words|times|years|views"
CONTEXT, TREES = 24, 60
FEATURES = [*(f"f_{k}" for k in WIDE), "f_length", "f_digits", "f_groups", "f_letters", "f_mixed", "f_cue", "f_against", "f_luhn", "f_span", "f_year", "f_low", "f_after", "f_iban"]


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    double = lambda i: F.when(i % 2 == 0, 2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), lambda total, i: total + F.coalesce(double(i), F.lit(0))) % 10 == 0


def iban(text: Column) -> Column:
    """True if an account number passes the check of ISO 13616: letters as numbers, the head last, 1 modulo 97."""
    tight = F.regexp_replace(text, "\x20", "")
    turned = F.concat(F.substring(tight, F.lit(5), F.length(tight)), F.substring(tight, 1, 4))
    each = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda total, x: (total * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _digits(column: str) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def candidates(docs: DataFrame, looked: bool = False) -> DataFrame:
    """Rows of ``docs`` (with text) with an array of the matches of each pattern: kind, gap before, context, match and what follows.

    With ``looked``, texts that no pattern can match (a cheap look tells) are left out.
    """
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    if looked:
        rows = rows.where(" OR ".join(sorted(set(LOOKS.values()))))

    def cut(kind: str) -> Column:
        pattern = PATTERNS[kind]
        own, gaps = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)), F.split("_text", pattern, -1)
        around = F.arrays_zip(F.slice(gaps, 1, F.size(own)).alias("g"), F.slice(gaps, 2, F.size(own)).alias("h"))
        one = lambda m, x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(CONTEXT)).alias("context"), m.alias("match"), F.left(x["h"], F.lit(CONTEXT)).alias("after"))
        some = F.zip_with(own, around, one)
        empty = F.expr("cast(array() as array<struct<kind:string,gap:int,context:string,match:string,after:string>>)")
        return F.when(F.expr(LOOKS[kind]) & F.col("_text").rlike(pattern), some).otherwise(empty)

    return rows.select(*names, *[cut(k).alias(k) for k in PATTERNS])


def placed(found: DataFrame) -> DataFrame:
    """Candidates with code-point offsets: _row, kind, start, end, context, match."""
    each = F.array(*[F.col(k) for k in PATTERNS])
    rows = found.select("_row", F.explode(each).alias("_own")).where("size(_own) > 0").select("_row", F.posexplode("_own").alias("_i", "_c"))
    rows = rows.select("_row", "_i", "_c.kind", "_c.gap", "_c.context", "_c.match", "_c.after").withColumn("_length", F.length("match"))
    end = F.sum(F.col("gap") + F.col("_length")).over(Window.partitionBy("_row", "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("_length")).select("_row", "kind", "start", "end", "context", "match", "after")


def base_rule() -> Column:
    """Whether a candidate of a base kind is personal data by the fixed rules."""
    n = F.length(_digits("match"))
    small = F.forall(F.split("match", r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", small)
        .when(F.col("kind") == "card", n.between(12, 19) & luhn(F.when(n.between(12, 19), _digits("match")).otherwise("")))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(False)
    )


def features(rows: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES`` to candidates of the wide kinds (kind, context, match, after)."""
    digits = _digits("match")
    low = F.lower("context")
    out = rows.withColumns({f"f_{k}": (F.col("kind") == k).cast("double") for k in WIDE})
    return out.withColumns(
        {
            "f_length": F.length("match").cast("double"),
            "f_digits": F.length(digits).cast("double"),
            "f_groups": F.size(F.split("match", r"[^0-9A-Za-z]++")).cast("double"),
            "f_letters": F.length(F.regexp_replace("match", "[^A-Za-z]", "")).cast("double"),
            "f_mixed": F.col("match").rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]").cast("double"),
            "f_cue": low.rlike(rf"(?:^|[^a-z])(?:{CUES})[^0-9]*$").cast("double"),
            "f_against": low.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^0-9]*$").cast("double"),
            "f_luhn": luhn(F.when(F.length(digits).between(8, 40), digits).otherwise(F.lit("1"))).cast("double"),
            "f_span": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
            "f_year": digits.rlike("^(?:19|20)[0-9]{6}$").cast("double"),
            "f_after": F.lower("after").rlike(rf"^[\x20-]?(?:%|(?:{UNITS})(?:$|[^a-z]))").cast("double"),
            "f_iban": iban(F.when(F.col("kind") == "iban", F.col("match")).otherwise(F.lit(""))).cast("double"),
            "f_low": F.when(F.col("kind") == "dotted", F.forall(F.split("match", r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) < 256)).otherwise(False).cast("double"),
        }
    )


def _account(rng: random.Random, good: bool) -> str:
    """An account number of ISO 13616 with right or wrong check digits."""
    country, body = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 18, 20, 22])))
    whole = body + "".join(str(ord(c) - 55) for c in country)
    check = (98 - int(whole + "00") % 97 + (0 if good else rng.randint(1, 90))) % 97
    text = f"{country}{check:02d}{body}"
    return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.5 else text


def examples(count: int = 1500, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Training rows (kind, context, match, after, label) made by a seeded rule."""
    rng = random.Random(seed)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    plain = lambda: rng.choice(["", "the house of ", "und wieder ", "en la noche ", "from here ", "de tout "])
    cue = lambda words: rng.choice(words.split("|")) + rng.choice([" ", ": ", " is ", " no. ", " number "])
    out = []
    for _ in range(count):
        kind = rng.choice(WIDE)
        good = rng.random() < 0.5
        after = rng.choice(["", " and", ", ", ".", " the house"])
        if kind == "secret":
            name = rng.choice(["token", "password", "api_key", "secret"])
            value = "".join(rng.choice("0123456789abcdef" if rng.random() < 0.5 else "abcXYZ0189_-") for _ in range(rng.randint(10, 40))) if good else rng.choice(["economy", "string", "required", "optional", "account", "holders"])
            row = (plain(), f"{name}{rng.choice([' = ', '=', ': '])}" + (f'"{value}"' if good else value))
        elif kind == "id":
            row = (cue("ssn|social|id") if rng.random() < 0.6 else plain(), f"{digit(3)}-{digit(2)}-{digit(4)}") if good else (cue(AGAINST), f"{digit(3)}-{digit(2)}-{digit(4)}")
        elif kind == "number":
            grouped = rng.random() < 0.3
            if good:
                value = rng.choice("3456") + digit(15) if rng.random() < 0.7 else digit(rng.randint(12, 19))
                row = (cue("card|account|visa") if rng.random() < 0.4 else plain(), " ".join(value[i : i + 4] for i in range(0, len(value), 4)) if grouped else value)
            else:
                short = rng.random() < 0.6
                value = rng.choice(["19", "20"]) + digit(6) if short and rng.random() < 0.5 else digit(rng.randint(8, 11)) if short else digit(rng.randint(20, 40))
                row = (cue(AGAINST) if rng.random() < 0.7 else plain(), value)
        elif kind == "tel":
            value = f"({digit(3)}) {digit(3)}-{digit(4)}" if rng.random() < 0.5 else f"{digit(3)}-{digit(3)}-{digit(4)}"
            row = (cue("phone|tel|call|mobile") if rng.random() < 0.5 else plain(), value) if good else (cue(AGAINST), value.replace("(", "").replace(")", ""))
        elif kind == "iban":
            row = (cue("iban|account") if rng.random() < 0.5 else plain(), _account(rng, good))
        else:
            value = ".".join(str(rng.randint(1, 255)) for _ in range(4)) if good else ".".join(str(rng.choice([rng.randint(256, 9999), rng.randint(0, 9)])) for _ in range(4))
            row = (cue("ip|host|address") if rng.random() < 0.4 else plain(), value) if good else (cue("version|section|build"), value)
        if not good and kind in ("number", "dotted") and rng.random() < 0.4:
            row, after = (plain(), row[1]), f" {rng.choice(UNITS.split('|'))}{after}"
        out.append((kind, row[0][-CONTEXT:], row[1], after, int(good)))
    return out


@functools.cache
def _model(spark: SparkSession) -> tuple[str, str]:
    """As :func:`trained`; rows and seed are fixed, so one fit serves a session."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(c)}, {quote(m)}, {quote(h)}, {y}, {i})" for i, (k, c, m, h, y) in enumerate(examples()))
    made = features(spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, context, match, after, label, i)")).select("i", "kind", "label", *FEATURES).collect()
    made.sort(key=lambda r: r["i"])
    x, y = np.array([[r[f] for f in FEATURES] for r in made]), np.array([r["label"] for r in made], float)
    held = np.arange(len(y)) % 3 == 0
    model = boosting.fit(x[~held], y[~held], trees=TREES)
    margin = boosting.predict(model, x)
    a, b = boosting.calibrate(margin[held], y[held])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    probability = f"1D / (1D + exp(-({a!r}D * ({boosting.sql(model, FEATURES)}) + ({b!r}D))))"
    kinds = np.array([r["kind"] for r in made])
    cuts = " ".join(f"WHEN '{k}' THEN {max(0.5, boosting.cutoff(p[held & (kinds == k)], y[held & (kinds == k)], 0.95))!r}D" for k in WIDE)
    return probability, f"CASE kind {cuts} ELSE 1D END"


def trained(spark: SparkSession) -> tuple[str, str]:
    """SQL for the probability of a candidate and for its threshold by kind."""
    return _model(spark)


def spans(found: DataFrame) -> DataFrame:
    """Chosen spans of candidates: _row, kind, start, end."""
    probability, cut = trained(found.sparkSession)
    rows = features(placed(found)).withColumn("_base", F.col("kind").isin(*BASE))
    return rows.where(F.when(F.col("_base"), base_rule()).otherwise(F.expr(f"{probability} >= {cut}"))).select("_row", "kind", "start", "end")


def place() -> Column:
    """Number of a kind in the list of kinds."""
    return F.element_at(F.create_map(*[x for i, k in enumerate((*BASE, *WIDE)) for x in (F.lit(k), F.lit(i))]), F.col("kind"))


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Offsets are code points, end exclusive.  Null and empty texts have no spans: counts 0, the digest of the empty
    string, and empty spans.  Texts of any length are scanned whole.  Repeated rows are scanned each.  Other columns,
    whatever their names, are not looked at.  An empty table gives an empty result.
    """
    found = stored(candidates(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())), "candidates")
    tag = F.struct("start", place().alias("_k"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("_s"))
    own = spans(found).withColumn("_tag", tag).groupBy("_row").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(*BASE), F.col("_tag")))).alias("_base"),
        F.array_sort(F.collect_list("_tag")).alias("_all"),
    )
    line = lambda c: F.coalesce(F.array_join(F.col(f"{c}._s"), ","), F.lit(""))
    out = found.select("doc_id", "_row").join(own, "_row", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(line("_base"), 256).alias("base_sha256"), line("_all").alias("spans"), F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_spans"))


def op7_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; overlapping spans count as one, of
    the kind that starts first.

    Other columns stay, whatever their names; n_chars, where there is one, follows the text.  Null and empty texts stay
    as they are, repeated rows stay, an empty table stays empty.
    """
    # spans depend on the text alone, so they are found once a text and come back by its digest
    digest = F.md5(F.col("text").cast("string").cast("binary"))
    texts = candidates(docs.select(digest.alias("_row"), "text"), looked=True).dropDuplicates(["_row"])
    order = Window.partitionBy("_row").orderBy("start", F.desc("end"), place())
    found = spans(texts).withColumn("_past", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("_new", F.coalesce(F.col("start") >= F.col("_past"), F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(order))
    whole = found.groupBy("_row", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct(F.col("start"), place())).alias("kind"))
    whole = whole.withColumn("_from", F.coalesce(F.lag("end").over(Window.partitionBy("_row").orderBy("start")), F.lit(0)))
    cuts = stored(whole.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "_from"))).alias("_cuts"), F.max("end").alias("_last")), "cuts")
    # documents travel as one struct, so that no column of theirs meets one of these
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), digest.alias("_row"), F.xxhash64(digest).alias("_hash"))
    marked = flagged(own, "_hash", cuts.select(F.xxhash64("_row").alias("_hash")))
    touched = marked.where("_maybe").join(cuts, "_row", "left")
    old = F.col("_doc.text").cast("string")
    piece = lambda c: F.concat(F.substring(old, c["_from"].cast("int") + 1, (c["start"] - c["_from"]).cast("int")), F.lit("["), F.upper(c["kind"]), F.lit("]"))
    text = F.concat(F.array_join(F.transform("_cuts", piece), ""), F.substring(old, F.col("_last").cast("int") + 1, F.length(old)))
    cut = F.col("_cuts").isNotNull()
    touched = touched.withColumn("_text", F.when(cut, text))
    columns = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    new = columns | {"text": F.when(cut, F.col("_text")).otherwise(old)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    select = lambda rows, values: rows.select(*[value.alias(name) for name, value in values.items()])
    return select(marked.where("not _maybe"), columns).union(select(touched, new))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the detector that follow fixed rules alone."""
    return op7_pii_boosted(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256")


#: The patterns of the base kinds as they are stated.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PLACES = " UNION ALL ".join(
    f"SELECT rid, {i} AS place, '{kind}' AS kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, gs FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d)" for i, (kind, p) in enumerate(RULES.items())
)
BASE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_PLACES}),
o AS (SELECT rid, place, kind, m, sum(length(gs[i]) + length(m)) OVER (PARTITION BY rid, place ORDER BY i) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM m),
l AS (SELECT *, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INT ELSE 2 * substr(reverse(digits), i, 1)::INT - CASE WHEN substr(reverse(digits), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) AS luhn FROM o WHERE kind <> 'email'),
g AS (SELECT rid, place, kind, m, e FROM o WHERE kind = 'email'
  UNION ALL SELECT rid, place, kind, m, e FROM l WHERE kind = 'ip' AND len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0
  UNION ALL SELECT rid, place, kind, m, e FROM l WHERE kind = 'card' AND length(digits) BETWEEN 12 AND 19 AND luhn % 10 = 0 UNION ALL SELECT rid, place, kind, m, e FROM l WHERE kind = 'phone' AND length(digits) BETWEEN 9 AND 15),
c AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in RULES)}, string_agg(kind || ':' || (e - length(m))::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY e - length(m), place) AS s FROM g GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in RULES)}, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN c USING (rid)
"""
