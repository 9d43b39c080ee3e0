import pytest

from lodestone.llm import minhash
from lodestone.llm.components import components

from .conftest import doc, words_of


def brute(rows, k, percent):
    sets = {}
    for r in rows:
        w = words_of(r[1])
        sets[r[0]] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(make, corpus, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(corpus), k=k).collect()}
    assert got == brute(corpus, k, 80)


def test_nulls_repeats_and_empty(make):
    rows = [doc(None, "a b c"), doc(1, None), doc(2, ""), doc(3, "p q r"), doc(3, "p q r"), doc(4, "P Q R"), doc(5, "z")]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(make(rows), k=2).collect())
    assert got == [(0, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)]
    assert minhash.near_duplicates(make([])).count() == 0


def test_stage_keeps_one_of_each_group(make, spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [doc(1, text), doc(2, text), doc(2, text), doc(3, "other words here"), doc(None, "x"), doc(3, "other words here")]
    out = minhash.stage(spark, make(rows), "")
    assert out.columns == make(rows).columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3]


def test_dense_group_below_the_threshold_stays_apart(make):
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(40):
        words = list(base)
        for j in range(6):
            words[(i * 7 + j * 13) % 100] = f"u{i}_{j}"
        rows.append(doc(i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make(rows), k=2).collect()}
    assert got == brute(rows, 2, 80)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(None, 3), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_columns_and_very_long_texts(make, spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    frame = make([doc(1, long), doc(2, long + " end"), doc(3, "short text here")]).withColumnsRenamed({"title": "rep", "score": "digest", "lang": "_maybe"})
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    out = minhash.stage(spark, frame, "")
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
