import itertools
import random

from lodestone.llm import mixing, packing

from .conftest import doc, words_of


def shares(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    whole, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = (whole - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
        open_ -= over
    return out


def test_targets_and_words_taken(make, corpus):
    rows = [doc(1000 + i, " ".join(["w"] * (1 + i % 37)), f"s{i % 4}") for i in range(400)] + corpus
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(words_of(r[1])) for r in rows}
    own = {}
    for r in rows:
        own[r[3]] = own.get(r[3], 0) + size[r[0]]
    source, want, taken = {r[0]: r[3] for r in rows}, shares(own), {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == own[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in own:
        largest = max(size[i] for i in source if source[i] == s)
        assert abs(taken[s] - want[s]) <= largest
    again = {(r.doc_id, r.taken) for r in mixing.mix(make(list(reversed(rows)))).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_edges(make, spark):
    assert mixing.mix(make([])).count() == 0
    got = mixing.mix(make([doc(1, None), doc(2, ""), doc(None, "a b", None)])).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == [(0, 2, 2), (1, 0, 0), (2, 0, 0)]
    rows = [doc(i, "a b c d", "x") for i in range(30)] + [doc(99, " ".join(["z"] * 300), "y")]
    out = mixing.stage(spark, make(rows), "")
    assert out.columns == make(rows).columns and out.where("source = 'x'").count() > 30
    names = {"title": "target", "component_id": "source_size", "score": "_size", "lang": "_copies"}
    again = mixing.stage(spark, make(rows).withColumnsRenamed(names), "")
    assert again.columns == [names.get(c, c) for c in out.columns] and again.count() == out.count()
    assert {r["target"] for r in again.collect()} == {"t"}


def test_bounds_need_the_least_padding():
    rng = random.Random(2)
    for _ in range(25):
        histogram = {rng.randint(1, 14): rng.randint(1, 9) for _ in range(6)}
        lengths = sorted(histogram)
        for k in (1, 2, 3, 4):
            pad = lambda tops: sum(histogram[x] * (min(t for t in tops if t >= x) - x) for x in lengths)  # noqa: E731, B023
            best = min(pad((*c, lengths[-1])) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
            found = packing.bounds(histogram, k)
            assert pad(found) == best and len(found) <= k
    assert packing.bounds({}, 3) == []


def test_sequences_hold_all_tokens_and_batches_their_budget(make, corpus, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    rows = corpus + [corpus[0]]
    got = packing.pack(make(rows), longest=100, buckets=5, budget=1000).collect()
    tokens, batches = {}, {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert r.n_tokens <= r.bucket_len <= 100
        if r.batch_id is None:
            assert r.bucket_len == 0 and r.n_tokens == 0
        else:
            batches.setdefault(r.batch_id, []).append(r)
    for i, text in {r[0]: r[1] for r in rows}.items():
        assert tokens[i] == len(words_of(text)) * (2 if i == corpus[0][0] else 1)
    by_bucket = {}
    for batch in batches.values():
        (length,) = {r.bucket_len for r in batch}
        assert len(batch) * length <= 1000 and sorted(r.slot for r in batch) == list(range(len(batch)))
        by_bucket.setdefault(length, []).append(len(batch))
    for length, sizes in by_bucket.items():
        assert sum(n < 1000 // length for n in sizes) <= 1
    assert packing.pack(make([])).count() == 0


def test_null_ids_are_packed(make):
    assert packing.pack(make([doc(None, "a b"), doc(None, "a b"), doc(1, None)])).count() == 3
