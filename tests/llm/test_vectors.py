import math
import random

from lodestone.llm import cells, topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors():
    rng = random.Random(8)
    rows = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(120)]
    rows += [[x + rng.gauss(0, 0.05) for x in rows[5]] for _ in range(30)] + [list(rows[7])] * 4 + [[2 * x for x in rows[7]]]
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    return [(i, v, 0) for i, v in enumerate(rows + odd)]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_VALUES", 96)
    rows = vectors()
    good = {i: v for i, v, _ in rows if usable(v) and any(v)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and cos(good[i], good[j]) >= 0.9} for i in good}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in links:
        for j in links[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cells.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (len(links.get(i, ())), find(i), find(i) == i) for i, _, _ in rows}


def test_cells_without_rows_or_ids(spark):
    assert cells.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = cells.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 1)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (2, 1, True), (2, 1, True)]


def test_top_k_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_VALUES", 120)
    monkeypatch.setattr(topk, "FAN", 2)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vectors() if usable(v)]
    frame = spark.createDataFrame(whole, "vec_id long, vector array<long>")
    want = []
    for q, a in whole:
        if q % 5 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b)))[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 5 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_beyond_double_precision_and_empty(spark):
    big = 1 << 27
    frame = spark.createDataFrame([(0, [big, 1]), (1, [big, 1]), (2, [big, 2]), (3, None), (None, [1, 1])], "vec_id long, vector array<long>")
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, big * big + 2), (0, 2, 1, big * big + 1)]
    assert topk.top_k(frame.where("false"), F.col("vec_id") == 0).count() == 0


def test_top_k_with_repeated_rows_and_clashing_columns(spark):
    rows = [(0, [2, 0]), (0, [1, 0]), (0, [1, 0]), *[(i, [i, 0]) for i in range(1, 8)], (7, [7, 0])]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, vector array<long>, rank int, score long, query_id string")
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 7), (0, 2, 7, 7), (0, 3, 6, 6), (0, 4, 5, 5), (0, 5, 4, 4)]


def test_cells_with_clashing_columns_and_ties(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2)], 0, "a", 5) for i in range(6)], "vec_id long, embedding array<double>, n_links int, component_id string, dim int")
    assert sorted(tuple(r) for r in cells.near_vectors(frame).collect()) == [(i, 2, i % 2, i < 2) for i in range(6)]
