import random

import corpus_pipeline as P
from lodestone.llm import mixing, pii, toxicity

from .conftest import words_of
from .test_minhash import brute
from .test_mixing_packing import shares
from .test_models import labelled

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    rows, labels = labelled(300)
    rng = random.Random(12)
    plain = [(r[0], r[1], "en", f"s{r[0] % 3}", len(r[1])) for r in rows]
    extra = [" ".join(f"u{rng.randrange(999)}" for _ in range(50)) + " mail me@x.org now" for _ in range(6)]
    plain += [(1000 + i, t, "en", None, len(t)) for i, t in enumerate(extra)]
    plain += [(2000, extra[0], "en", "s9", 1), (2001, extra[0].upper(), "en", "s9", 1), (2002, extra[1] + " end", "en", "s9", 1), (3000, None, None, None, None), (3001, "", "en", "s0", 0)]
    spark.createDataFrame(plain, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r[0]: r[1] for r in plain}, {i for i, _, t in labels if t}


def test_stages_do_their_work_in_order(spark, tmp_path):
    texts, toxic = tables(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = f"{tmp_path}/out-{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == before.columns
            seen.append({r.doc_id: r for r in docs.collect()})
    kept, unique, clean, _ = seen
    assert len(set(kept) & toxic) < 0.1 * len(toxic) and len(set(texts) - toxic - set(kept)) <= 3
    assert not {2000, 2001, 2002} & set(unique) and {1000, 1001, 3000, 3001} <= set(unique)
    assert clean[1000].text.endswith("mail [EMAIL] now") and clean[1000].n_chars == len(clean[1000].text) and clean[3000].text is None
    assert docs.where("batch_id is not null").count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_dedup", "pii", "mixing", "packing"]


def test_run_gives_the_same_sequences_as_the_stages(spark, tmp_path):
    tables(spark, str(tmp_path))
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "first_token", "n_tokens", "bucket_len", "batch_id", "slot"] and out.count() > 100


def test_stages_equal_a_plain_version(spark, tmp_path):
    """Each stage against plain Python over what the one before kept; the model's scores and spans are taken as given."""
    tables(spark, str(tmp_path))
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/plain-{name}")
        docs = spark.read.parquet(f"{tmp_path}/plain-{name}")
        out.append(docs.collect())
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(source, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert {r.doc_id for r in out[0]} == {i for i, s in score.items() if s < toxicity.CUT}
    groups = brute([(r.doc_id, r.text) for r in out[0]], 5, 80)
    assert sorted(r.doc_id for r in out[1]) == sorted(i for i, (_, head) in groups.items() if i == head)
    found = {r.doc_id: r.spans for r in pii.detect(spark.read.parquet(f"{tmp_path}/plain-minhash_dedup")).collect()}
    clean = {r.doc_id: r.text for r in out[2]}
    for r in out[1]:
        text, at, parts = r.text, 0, []
        spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in found[r.doc_id].split(",") if x))
        for a, b, kind in spans:
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, -b)
        assert clean[r.doc_id] == (None if text is None else "".join(parts) + text[at:])
    size, own = {i: len(words_of(t)) for i, t in clean.items()}, {}
    for r in out[2]:
        own[r.source] = own.get(r.source, 0) + size[r.doc_id]
    want, taken = shares({s: n for s, n in own.items()}), {}
    for r in out[3]:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    assert all(abs(taken.get(s, 0) - want[s]) <= max(size[r.doc_id] for r in out[2] if r.source == s) for s in own)
    assert all(sum(x.doc_id == i for x in out[3]) <= mixing.MOST for i in clean)
    assert sum(r.n_tokens for r in out[4]) == sum(size[r.doc_id] for r in out[3])
