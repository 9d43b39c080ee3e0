"""Windows, packing, budgets and evaluation on literal rows."""

from pyspark.sql import functions as F

from lodestone import backends
from lodestone.operators import evaluation, extraction, flow, search


def test_packing_resets_with_each_chunk(spark):
    frame = spark.createDataFrame([([5, 5, 5, 20, 1],), ([],)], "s array<int>")
    got = [r[0] for r in frame.select(flow.packed(F.col("s"), 10)).collect()]
    assert got == [[0, 0, 1, 2, 3], []]
    assert frame.select(flow.packed(F.col("s"), 100, 2)).first()[0] == [0, 0, 1, 1, 2]


def test_segments(spark):
    got = spark.createDataFrame([("abcdefg",), ("",)], "t string").select(flow.segments(F.col("t"), 3)).collect()
    assert [(s.char_start, s.char_end, s.text) for s in got[0][0]] == [(0, 3, "abc"), (3, 6, "def"), (6, 7, "g")] and got[1][0] == []


def test_even_sample_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("d", i, i == 9) for i in range(10)], "doc string, page int, prio boolean")
    pages = lambda n: sorted(r.page for r in flow.even_sample(rows, ["doc"], ["page"], n, F.col("prio")).collect())
    assert pages(1) == [9] and pages(2) == [4, 9] and pages(4) == [0, 4, 8, 9] and pages(20) == list(range(10))


def test_sources_are_capped_but_kept_whole(spark):
    rows = spark.createDataFrame([("n", "a", 30, 3), ("n", "a", 25, 4), ("n", "b", 30, 1), ("n", "c", 24, 0), ("n", "d", 10, 2)], "notice string, src string, score int, pos int")
    got = flow.best_sources(rows, "notice", ["src"], "score", "pos", 22, 2).collect()
    assert sorted((r.src, r.pos) for r in got) == [("a", 3), ("a", 4), ("b", 1)]


def test_first_groups_and_sampling(spark):
    rows = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "g string, pos int")
    assert sorted(r.pos for r in flow.first_groups(rows, "g", "pos", 2).collect()) == [0, 1, 2]
    ids = spark.range(100)
    assert [r.id for r in flow.sampled(ids, "id", 1, 5).collect()] == [r.id for r in flow.sampled(ids.repartition(7), "id", 1, 5).collect()]


def test_resume_prefers_the_exact_key(spark):
    state = spark.createDataFrame([(1, "k", "s1", "failed", "x"), (2, "k", "s1", "success", "y"), (3, "k", "s2", "success", "z"), (4, "m", "s1", "failed", "w")], "seq int, id string, sig string, status string, outcome string")
    work = spark.createDataFrame([("k", "s1"), ("k", "s9"), ("m", "s1")], "id string, sig string")
    got = {(r.id, r.sig): (r.outcome, r.todo) for r in flow.resumed(work, state, ["id", "sig"], ["id"]).collect()}
    assert got == {("k", "s1"): ("y", False), ("k", "s9"): ("z", False), ("m", "s1"): (None, True)}


def test_field_scores_count_every_case(spark):
    rows = [(True, "1", "1"), (True, "2", "2.0"), (True, None, "x"), (True, "y", None), (True, None, None), (False, "z", None)]
    got = evaluation.field_scores(spark.createDataFrame(rows, "present boolean, gold_f string, found_f string"), ["f"]).first()
    assert (got.tp, got.fp, got.fn) == (1, 2, 3) and (got.precision, got.recall) == (0.3333, 0.25)
    none = evaluation.field_scores(spark.createDataFrame([(False, "z", None)], "present boolean, gold_f string, found_f string"), ["f"], []).first()
    assert (none.fn, none.precision, none.recall) == (0, 1.0, 1.0)


def test_gold_meets_the_last_prediction_of_a_place(spark):
    gold = spark.createDataFrame([(1, "b", 2, "x"), (2, "b", 3, "y")], "gold_id int, block_id string, block_row int, gold_f string")
    found = spark.createDataFrame([(0, [("b", 2)], "old"), (1, [("b", 2), ("b", 9)], "x")], "item_pos int, refs array<struct<block_id:string,block_row:int>>, f string")
    got = {r.gold_id: (r.present, r.found_f) for r in evaluation.gold_matches(gold, found).collect()}
    assert got == {1: (True, "x"), 2: (False, None)}
    ratios = evaluation.exact_ratios(evaluation.gold_matches(gold, found), ["f"]).first()
    assert (ratios.evidence_recall, ratios.strict_exact, ratios.exact_f) == (0.5, 0.5, 0.5)


def test_broken_rules_are_listed(spark):
    names = "product_service_name string, category_name string, category_code string, brand_supplier string, spec_model string, unit_price double, quantity double, quantity_unit string, total_price double"
    rows = [("n", 1, "a", None, None, "详见附件", None, 2.0, 3.0, None, 6.0, "t", "text"), ("n", 3, "b", None, None, None, None, -1.0, 1.0, None, 9.0, "zzz", "text")]
    got = {(r.item_no, r.violation) for r in evaluation.violations(spark.createDataFrame(rows, f"notice_id string, item_no int, {names}, evidence_text string, block_text string")).collect()}
    assert got == {(1, "placeholder_value"), (3, "item_no_not_sequential"), (3, "negative_number"), (3, "price_mismatch"), (3, "evidence_text_differs")}


def test_cells_must_be_those_of_the_block(spark):
    blocks = spark.createDataFrame([("b", [["a b", "c"]], None), ("t", None, "hello")], "block_id string, rows array<array<string>>, text string")
    evidence = spark.createDataFrame([("b", 1, ["a b", "c"], None, None, None), ("b", 2, ["x"], None, None, None), ("t", None, None, 1, 3, "el"), ("q", None, None, 0, 1, "h")], "block_id string, block_row int, cells array<string>, char_start int, char_end int, piece string")
    assert sorted((r.block_id, r.exact) for r in evaluation.cell_state(evidence, blocks).collect()) == [("b", False), ("b", True), ("q", False), ("t", True)]


def test_reports(spark):
    files = spark.createDataFrame([("a.ZIP", 5), ("b.zip", 6), ("c.pdf", 1), ("", 9), (None, 3)], "file_name string, size int")
    assert {r.extension: (r.n, r.bytes, r.reached) for r in evaluation.extension_target(files, 2).collect()} == {"zip": (2, 11, False), "pdf": (1, 1, False)}
    manifest, found = spark.createDataFrame([("n1",), ("n2",)], "notice_id string"), spark.createDataFrame([("n1", "html"), ("n1", "zip"), ("n3", "zip")], "notice_id string, kind string")
    assert sorted(tuple(r) for r in evaluation.dataset_audit(manifest, found).collect()) == [("n2", "missing_html"), ("n2", "missing_zip"), ("n3", "not_in_manifest")]
    pages, zips = spark.createDataFrame([("x/a.html",), ("x/b.html",), ("x/c.html",)], "path string"), spark.createDataFrame([("y/a.zip",), ("y/b.zip",)], "path string")
    assert {r.stem: r.reason for r in evaluation.paired(pages, zips, 1).collect()} == {"a": None, "b": "over_target", "c": "missing_html_or_zip"}
    checks = spark.createDataFrame([("n", True), ("n", False), ("n", None), ("m", None)], "notice_id string, ok boolean")
    assert {r.notice_id: (r.confidence, r.level) for r in evaluation.label_confidence(checks, ["notice_id"], "ok").collect()} == {"n": (0.5, "low"), "m": (1.0, "high")}


def test_facets(spark):
    rows = spark.createDataFrame([("n", 1, "Alpha", None, "A02", "甲"), ("n", 2, "beta", "办公", None, "乙%")], "notice_id string, item_no int, product_service_name string, category_name string, category_code string, brand_supplier string")
    find = lambda **f: sorted(r.item_no for r in search.where(rows, **f).collect())
    assert find(product="ALPHA") == [1] and find(category="A02") == [] and find(category="办公 ") == [2] and find() == [1, 2] and find(brand="_") == [1, 2]
    items, total = search.page(rows, 0, 1000)
    assert items.count() == 2 and total.first().total == 2 and search.page(rows, 2, 1)[0].first().item_no == 2


def test_imported_items_and_jobs(spark):
    notices = spark.createDataFrame([("n", None, [("甲", "b", 2)]), ("", "t", [("x", "b", 1)])], "notice_id string, title string, items array<struct<product_service_name:string,source_block_id:string,source_block_row:int>>")
    for name in ("category_name", "category_code", "brand_supplier", "spec_model", "source_file"):
        notices = notices.withColumn("items", F.transform("items", lambda v, c=None, n=name: v.withField(n, F.lit(None).cast("string"))) if False else F.expr(f"transform(items, v -> named_struct('product_service_name', v.product_service_name, 'source_block_id', v.source_block_id, 'source_block_row', v.source_block_row, 'category_name', cast(null as string), 'category_code', cast(null as string), 'brand_supplier', cast(null as string), 'spec_model', cast(null as string), 'source_file', cast(null as string)))"))
    (one,) = search.imported(notices).collect()
    assert one.item_no == 1 and one.search_text == "n 甲     " and one.entity_id.startswith("ent_")
    updates = spark.createDataFrame([("j", 1, "queued", 0), ("j", 2, None, 50), ("j", 3, "staged", None)], "job_id string, seq int, status string, progress int")
    job = search.latest_jobs(updates).first()
    assert (job.status, job.progress, job.updated_seq) == ("staged", 50, 3)
    files = spark.createDataFrame([("j", 1, "a.zip", 5), ("j", 2, "b.exe", 5), ("j", 3, "c.zip", 0), ("j", 4, "d.zip", 8)], "job_id string, seq int, file_name string, size int")
    assert [r.reason for r in search.upload_problems(files, ("zip",), 7, 100).orderBy("seq").collect()] == [None, "suffix", "empty", "too large"]


def test_backends(spark):
    requests = spark.createDataFrame([("a", 1, "m", 10), ("a", 2, "m", 10), ("b", 3, "m", 10)], "request_id string, seq int, messages string, total_tokens int")
    answers = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "request_id string, attempt int, answer string")
    assert sorted((r.request_id, r.answer, r.status) for r in backends.replayed(requests, answers).collect() if r.answer) == [("a", "x", "success"), ("a", "y", "success")]
    assert backends.budgeted(requests, 5, 15).count() == 2 and backends.budgeted(requests, 1, 99).count() == 1
    assert {r.total_tokens for r in backends.called(requests, lambda: backends.FakeBackend("{}")).collect()} == {15}
    cache = spark.createDataFrame([("q", "t", "u1", "s", 1), ("q", "t", "u2", "s", 2), ("*", "w", "u3", "s", 1), ("q", "t", "", "s", 0)], "query string, title string, url string, snippet string, rank int")
    found = backends.searched(spark.createDataFrame([("q",), ("z",)], "query string"), cache, 1).collect()
    assert {r.query: r.url for r in found} == {"q": "u1", "z": "u3"}
    assert backends.ocr(spark.createDataFrame([("i", b"x")], "image_id string, content binary")).first().ocr_status == "unavailable"


def test_decisions_are_graded_by_their_sources(spark):
    decisions = spark.createDataFrame([("d1", ["http://www.city.gov.cn/a", "http://x.com"], "confirmed"), ("d2", ["http://y.com"], "confirmed"), ("d3", ["http://z.com"], "confirmed")], "decision_id string, urls array<string>, status string")
    results = spark.createDataFrame([("d1", "http://www.city.gov.cn/a"), ("d2", "http://y.com")], "decision_id string, url string")
    got = {r.decision_id: (r.quality, r.review) for r in extraction.graded(decisions, results).collect()}
    assert got == {"d1": ("high", False), "d2": ("low", True), "d3": ("none", True)}
    rows = spark.createDataFrame([("a", "2024-01-01", None, "2024-06-01"), ("b", None, "2023-01-01", "2024-06-01")], "x string, valid_from string, valid_to string, as_of string")
    assert [r.x for r in extraction.valid_at(rows).collect()] == ["a"]
