"""Evaluation and audit: precision and recall, coordinate checks, label comparison, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """A-16: share to four places, half up; ``empty`` for an empty whole."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(part / whole, 4))


def _unpivot(rows: DataFrame, keys: list[str], fields: list[str], left: str, right: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{left}_{f}").cast("string").alias("gold"), F.col(f"{right}_{f}").cast("string").alias("found")) for f in fields])
    return rows.select(*keys, F.explode(pairs).alias("v")).select(*keys, "v.*")


def field_scores(pairs: DataFrame, fields: list[str], missing_fields: list[str] | None = None) -> DataFrame:
    """A-16: precision, recall and F1 of each field.

    ``pairs``: present boolean, gold_<field>, found_<field>.  Both null: skipped; a value where gold has none is a false
    positive; none where gold has one is a false negative; a wrong value is both.  A missing item is a false negative of
    each of ``missing_fields`` (all, if not given).  Values are compared as text.
    """
    rows = _unpivot(pairs, ["present"], fields, "gold", "found")
    counted = F.lit(True) if missing_fields is None else F.col("field").isin(*missing_fields)
    gold, found = F.col("gold").isNotNull(), F.col("found").isNotNull()
    wrong = gold & found & (F.col("gold") != F.col("found"))
    one = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    out = rows.groupBy("field").agg(
        one(F.col("present") & gold & (F.col("gold") == F.col("found"))).alias("tp"),
        one(F.col("present") & found & (~gold | wrong)).alias("fp"),
        one(F.when(F.col("present"), gold & (~found | wrong)).otherwise(counted)).alias("fn"),
    )
    return scores(out)


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, fp and fn."""
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4))
    return out.withColumn("f1", f1)


def gold_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """J-12: gold items with the prediction at one of their coordinates; the last item of a coordinate counts.

    ``gold``: gold_id, block_id, block_row, fields; ``predicted``: item_pos, refs array<struct<block_id, block_row>>,
    fields.  Gold items without a prediction stay.
    """
    fields = [c for c in predicted.columns if c not in ("item_pos", "refs")]
    each = predicted.select("item_pos", F.explode("refs").alias("r"), F.struct(*fields).alias("_v")).select("r.block_id", "r.block_row", "item_pos", "_v")
    last = each.groupBy("block_id", "block_row").agg(F.max_by("_v", "item_pos").alias("_v"))
    return gold.join(last, ["block_id", "block_row"], "left").withColumn("present", F.col("_v").isNotNull()).select("*", *[F.col(f"_v.{c}").alias(f"found_{c}") for c in fields]).drop("_v")


def exact_ratios(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """A-17: by field the share of gold items with the same value (null equals null), and of all fields at once."""
    same = {f: F.col("present") & F.col(f"gold_{f}").eqNullSafe(F.col(f"found_{f}")) for f in fields}
    whole = reduce(lambda a, b: a & b, same.values())
    mean = lambda test: ratio(F.sum(test.cast("long")), F.count("*"))
    return pairs.agg(mean(F.col("present")).alias("evidence_recall"), mean(whole).alias("strict_exact"), *[mean(test).alias(f"exact_{f}") for f, test in same.items()])


def set_recall(gold: DataFrame, kept: DataFrame, keys: list[str], group: str) -> DataFrame:
    """A-18: gold keys by group and how many of them were kept."""
    rows = gold.select(group, *keys).distinct().join(kept.select(*keys).distinct().withColumn("_k", F.lit(1)), keys, "left")
    return rows.groupBy(group).agg(F.count("*").alias("gold"), F.count("_k").alias("retained")).withColumn("recall", ratio(F.col("retained"), F.col("gold")))


def recall_by(gold: DataFrame, dimension: str, standard: str, loose: str) -> DataFrame:
    """A-19: gold rows by dimension, kept by the standard and by the looser settings."""
    out = gold.groupBy(dimension).agg(F.count("*").alias("gold"), F.sum(F.col(standard).cast("long")).alias("standard"), F.sum(F.col(loose).cast("long")).alias("loose"))
    return out.withColumn("standard_recall", ratio(F.col("standard"), F.col("gold"))).withColumn("loose_recall", ratio(F.col("loose"), F.col("gold")))


def flag_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """A-20: how often each flag is set."""
    return rows.agg(*[F.sum(F.coalesce(F.col(f), F.lit(False)).cast("long")).alias(f) for f in flags])


def coordinate_state(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """J-10, A-21: references with their state: ok, missing block, or row out of range.

    ``blocks``: block_id, n_rows."""
    rows = refs.join(blocks.select("block_id", "n_rows"), "block_id", "left")
    state = F.when(F.col("n_rows").isNull(), "missing_block").when(F.col("block_row").isNull() | F.col("block_row").between(1, F.col("n_rows")), "ok").otherwise("row_out_of_range")
    return rows.withColumn("state", state)


def cell_state(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """J-11: whether the cells of an evidence row, or its piece of text, are what the block holds."""
    rows = evidence.join(blocks.select("block_id", "rows", "text"), "block_id", "left")
    own = F.transform(F.try_element_at("rows", F.col("block_row")), X.one_line)
    piece = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    same = F.when(F.col("block_row").isNotNull(), own == F.col("cells")).otherwise(piece == F.col("piece"))
    return rows.withColumn("exact", F.coalesce(same, F.lit(False))).drop("rows", "text")


def ranked_choice(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """J-13: one candidate for each notice: the first that shares a source with gold, else the best score."""
    sources = gold.select("notice_id", "container", F.lit(True).alias("_hit")).distinct()
    rows = candidates.join(sources, ["notice_id", "container"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("notice_id").orderBy(F.desc("_hit"), F.desc("score"), "candidate_pos"))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_hit")


def label_agreement(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """J-14: rows in both label sets, in one only, and agreement by field on those in both."""
    rows = left.select(*keys, F.struct(*fields).alias("_l")).join(right.select(*keys, F.struct(*fields).alias("_r")), keys, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    one = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    same = [one(both & F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}"))).alias(f"agree_{f}") for f in fields]
    return rows.agg(one(both).alias("matched"), one(F.col("_r").isNull()).alias("left_only"), one(F.col("_l").isNull()).alias("right_only"), *same)


def block_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """J-15, U-02: each key as added, removed, changed or same."""
    rows = old.select(key, F.col(content).alias("_o"), F.lit(True).alias("_in_old")).join(new.select(key, F.col(content).alias("_n"), F.lit(True).alias("_in_new")), key, "full_outer")
    state = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return rows.select(key, state.alias("state"))


def exactly_once(gold: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """J-16: gold items with their request: missing without one, duplicated with several."""
    hits = requests.groupBy(*keys).agg(F.countDistinct("request_id").alias("_n"), F.min("request_id").alias("request_id"))
    rows = gold.join(hits, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    state = F.when(F.col("_n") == 0, "missing").when(F.col("_n") > 1, "duplicated").otherwise("assigned")
    return rows.withColumn("state", state).withColumn("request_id", F.when(F.col("_n") == 1, F.col("request_id"))).drop("_n")


def attach_products(projects: DataFrame, items: DataFrame) -> DataFrame:
    """J-17: items of complete notices as the products of a project's first package."""
    lists = items.where("notice_status = 'complete'").groupBy("notice_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "product_service_name"))), lambda x: x["product_service_name"]).alias("products"))
    return projects.join(lists, "notice_id", "left")


def violations(items: DataFrame) -> DataFrame:
    """E-27: one row for each broken rule: numbering, negative numbers, placeholders, arithmetic.

    ``items``: notice_id, item_no, the nine fields, evidence_text, block_text."""
    from .extraction import gold_consistency

    turn = F.row_number().over(Window.partitionBy("notice_id").orderBy("item_no"))
    rows = items.withColumn("_turn", turn)
    negative = F.lit(False)
    for c in L.NUMERIC_FIELDS:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    texts = [c for c in L.ENTITY_FIELDS if c not in L.NUMERIC_FIELDS]
    placeholder = F.lit(False)
    for c in texts:
        placeholder = placeholder | F.coalesce(F.col(c).isNotNull() & X.clean_text(F.col(c)).isNull(), F.lit(False))
    checks = {
        "item_no_not_sequential": F.col("item_no") != F.col("_turn"),
        "negative_number": negative,
        "placeholder_value": placeholder,
        "price_mismatch": ~F.coalesce(gold_consistency(F.col("unit_price"), F.col("quantity"), F.col("total_price")), F.lit(True)),
        "evidence_text_differs": F.coalesce(~F.coalesce("block_text", F.lit("")).contains(F.coalesce("evidence_text", F.lit(""))), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return rows.select("notice_id", "item_no", F.explode(found).alias("violation"))


def schema_difference(one: list[str], two: list[str], rows: DataFrame) -> DataFrame:
    """U-04: names in one list only."""
    spark = rows.sparkSession
    left, right = (spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("name")) for names in (one, two))
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def common_ids(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """U-01."""
    return one.select(key).intersect(two.select(key))


def only_ids(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """U-02."""
    return one.select(key).distinct().join(two.select(key), key, "left_anti")


def all_ids(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """U-03."""
    return one.select(key).union(two.select(key)).distinct()


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """A-11, A-23, A-26, SNK-07: rows by key, an unknown key as 未知."""
    return rows.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("未知")).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """A-22, A-26: keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def usage(outcomes: DataFrame, price: float) -> DataFrame:
    """A-12, X-33: calls, tokens and cost, to six places."""
    total = F.sum("total_tokens")
    return outcomes.agg(F.count("*").alias("calls"), total.cast("long").alias("total_tokens"), F.round(X.cost(total, price), 6).alias("cost"))


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A-15: values that are there, by field."""
    return rows.agg(*[F.count(f).alias(f) for f in fields])


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """A-27: nearest-rank 95th percentile and upper median, from counts of values by key; no list of values is made."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy("_v")
    ranked = counts.withColumn("_upto", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    first = lambda least: F.min(F.when(F.col("_upto") >= least, F.col("_v")))
    return ranked.groupBy(*keys).agg(first(F.ceil(F.col("_n") * 95 / 100)).alias("p95"), first(F.floor(F.col("_n") / 2) + 1).alias("median_upper"))


def watermark_stats(rows: DataFrame, top: int = 20) -> DataFrame:
    """A-28: blocks and characters filtered by pattern, the most frequent first."""
    return rows.groupBy("pattern").agg(F.count("*").alias("blocks"), F.sum("chars").alias("chars")).orderBy(F.desc("blocks"), "pattern").limit(top)


def label_confidence(rows: DataFrame, keys: list[str], checks: str) -> DataFrame:
    """A-29: share of consistent items among those that can be checked (1 without any), to three places, with its level."""
    share = F.coalesce(F.avg(F.when(F.col(checks).isNotNull(), F.col(checks).cast("double"))), F.lit(1.0))
    out = rows.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), share), 3).alias("confidence"))
    return out.withColumn("level", F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low"))


def extension_target(files: DataFrame, least: int) -> DataFrame:
    """A-25: files and bytes by ending, and whether all endings reach a number."""
    ending = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    rows = files.where("file_name is not null and file_name <> ''").groupBy(ending.alias("extension")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return rows.withColumn("reached", F.bool_and(F.col("n") >= least).over(Window.partitionBy(F.lit(1))))


def review_queue(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """K-14: likely results first, then score; whether the queue was cut."""
    out = rows.orderBy((F.col("risk") == "potential_result").desc(), F.desc("score"), "notice_id", "block_id").limit(limit)
    return out, rows.agg((F.count("*") > limit).alias("truncated"))


def gold_ranking(notices: DataFrame, top: int = 50) -> DataFrame:
    """K-13: notices by best table score, eight points a table up to five, less penalties."""
    return notices.withColumn("rank_score", F.col("best_score") + 8 * F.least("n_tables", F.lit(5)) - F.col("penalty")).orderBy(F.desc("rank_score"), "notice_id").limit(top)


def gold_index(items: DataFrame) -> DataFrame:
    """R-09: items and source types of each notice."""
    return items.groupBy("notice_id").agg(F.count("*").alias("item_count"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"))


def dataset_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """R-02, R-03: problems of a dataset: notices without page or archive, files that no notice names."""
    kinds = files.groupBy("notice_id").pivot("kind", ["html", "zip"]).count()
    rows = manifest.select("notice_id", F.lit(True).alias("_listed")).join(kinds.withColumn("_found", F.lit(True)), "notice_id", "full_outer")
    checks = {"missing_html": F.col("_listed") & F.col("html").isNull(), "missing_zip": F.col("_listed") & F.col("zip").isNull(), "not_in_manifest": F.col("_listed").isNull(), "several_html": F.col("html") > 1, "several_zip": F.col("zip") > 1}
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return rows.select("notice_id", F.explode(found).alias("problem"))


def dataset_verification(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """R-03: the seven problems of a stored dataset: (notice_id, problem, detail).

    ``manifest``: notice_id, url, html_size, html_error, html_title, zip_error, zip_bad_member, attachments array<string>;
    ``files``: notice_id, file_name, size.  A notice without a page is not looked at further.
    """
    rows = manifest.withColumn("_html", F.coalesce("html_size", F.lit(0)) > 0)
    no_title = F.coalesce(F.trim("html_title"), F.lit("")) == ""
    checks = [
        ("html_missing_or_empty", ~F.col("_html"), F.lit("")),
        ("html_parse_error", F.col("_html") & F.col("html_error").isNotNull(), F.col("html_error")),
        ("html_no_title", F.col("_html") & no_title, F.lit("")),
        ("url_notice_id_mismatch", F.col("_html") & ~F.coalesce("url", F.lit("")).contains(F.col("notice_id")), F.coalesce("url", F.lit(""))),
        ("zip_crc_error", F.col("_html") & F.col("zip_bad_member").isNotNull(), F.col("zip_bad_member")),
        ("zip_open_error", F.col("_html") & F.col("zip_error").isNotNull(), F.col("zip_error")),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("problem"), detail.cast("string").alias("detail"))) for name, test, detail in checks]), lambda x: x.isNotNull())
    own = rows.select("notice_id", F.explode(found).alias("p")).select("notice_id", "p.problem", "p.detail")
    named = rows.where("_html").select("notice_id", F.explode("attachments").alias("file_name")).where("file_name <> ''")
    lost = named.join(files.where("size > 0").select("notice_id", "file_name"), ["notice_id", "file_name"], "left_anti")
    return own.union(lost.select("notice_id", F.lit("attachment_file_missing"), "file_name"))


def agent_summary(log: DataFrame) -> DataFrame:
    """A-22: lines, distinct and repeated requests and summed usage of a state log.

    ``log``: request_id (notice_id where there is none), calls, prompt_tokens, completion_tokens, total_tokens."""
    kinds = ("calls", "prompt_tokens", "completion_tokens", "total_tokens")
    each = log.groupBy(F.coalesce("request_id", F.lit("")).alias("request_id")).agg(F.count("*").alias("_n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in kinds])
    again = F.sum(((F.col("_n") > 1) & (F.col("request_id") != "")).cast("long"))
    return each.agg(F.sum("_n").alias("record_count"), F.count("*").alias("unique_request_count"), again.alias("repeated_request_count"), *[F.sum(c).cast("long").alias(c) for c in kinds])


def error_histogram(rows: DataFrame) -> DataFrame:
    """R-02: errors by their first sixty characters."""
    return rows.groupBy(F.substring("error", 1, 60).alias("error")).agg(F.count("*").alias("n"))


def to_sync(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """R-04: files that the mirror lacks or holds in another size."""
    return source.join(mirror.select("path", F.col("size").alias("_size")), "path", "left").where(~F.col("size").eqNullSafe(F.col("_size"))).drop("_size")


def first_success(attempts: DataFrame) -> DataFrame:
    """R-07: of each file the first address that worked."""
    return attempts.where("ok").groupBy("file_id").agg(F.min_by("url", "attempt").alias("url"))


def backfill_codes(items: DataFrame, cells: DataFrame) -> DataFrame:
    """R-08: codes from the source cell, where the table has a name column and no code column."""
    rows = items.join(cells, ["block_id", "block_row"], "left")
    _, code = X.split_category(F.col("category_cell"))
    return rows.withColumn("category_code", F.coalesce("category_code", F.when(~F.coalesce("has_code_column", F.lit(False)), code))).drop("category_cell", "has_code_column")


def paired(pages: DataFrame, archives: DataFrame, target: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """SRC-22, R-10: pages with their archive by stem; what has none, or is over a target, is given a reason.

    Files whose stems are alike meet only if they agree in the columns ``within`` (what else tells them apart)."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)\.[^./]+$", 1)
    keys = [*within, "stem"]
    left = pages.select(*within, stem(F.col("path")).alias("stem"), F.col("path").alias("page"))
    right = archives.select(*within, stem(F.col("path")).alias("stem"), F.col("path").alias("archive"))
    rows = left.join(right, keys, "full_outer")
    whole = F.col("page").isNotNull() & F.col("archive").isNotNull()
    over = F.lit(False)
    if target is not None:
        # the first ones by stem are a bounded list, found without numbering the rest
        first = rows.where(whole).orderBy("stem", *within).limit(target).select(*keys, F.lit(True).alias("_first"))
        rows, over = rows.join(first, keys, "left"), F.col("_first").isNull()
    return rows.withColumn("reason", F.when(~whole, "missing_html_or_zip").when(over, "over_target")).drop("_first")


def packaging_report(rows: DataFrame) -> DataFrame:
    """R-11: by source: notices, files, and how many keys carry a prefix or a suffix."""
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("key").startswith("cg").cast("long")).alias("prefixed"), F.sum(F.col("key").rlike(r"_\d+$").cast("long")).alias("suffixed"))


def with_fallback(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """R-12: a model's items, or the rules' where it gave none."""
    rows = rules.select("notice_id", F.col("items").alias("_rules")).join(answers.select("notice_id", F.col("items").alias("_model")), "notice_id", "left")
    some = F.coalesce(F.size("_model"), F.lit(0)) > 0
    return rows.select("notice_id", F.when(some, F.col("_model")).otherwise(F.col("_rules")).alias("items"), F.when(some, "model").otherwise("rules").alias("origin"))


def gold_mapper(rows: DataFrame, mapper: dict[str, int]) -> DataFrame:
    """P-07: named fields by column place."""
    return rows.select("*", *[F.get("cells", F.lit(place)).alias(name) for name, place in mapper.items()])


def dataset_report(notices: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """A-24: notices by source, and the regions with most of them; an unknown one is 未知."""
    return histogram(notices, "source"), histogram(notices, "region").orderBy(F.desc("n"), "region").limit(top)


def of_results(rows: DataFrame) -> DataFrame:
    """M-10, R-06: rows whose address is one of result notices; the others go from every list alike."""
    return rows.where(F.coalesce(F.col("url").contains(L.RESULT_URL), F.lit(False)))
