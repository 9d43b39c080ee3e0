import random
import re

import numpy as np
import pyarrow as pa

from lodestone.llm import gru, quality, toxicity
from pyspark.sql import functions as F

from .conftest import doc


def labelled(count=500, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["grumblix", "zorkface"]
    rows, labels = [], []
    for i in range(count):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 150))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "!", "###"])
        rows.append(doc(i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(6).items()}
    table, places = rng.standard_normal((20, 6)), rng.integers(0, 20, (3, 5))
    real = np.ones((3, 5), bool)
    real[0, 3:] = False
    y = np.array([0.0, 1, 1])
    _, g, inner = gru.gradients(p, table, places, real, y)
    for at in ((int(places[1, 2]), 3), (int(places[0, 4]), 0)):
        up, down = table.copy(), table.copy()
        up[at] += 1e-3
        down[at] -= 1e-3
        slope = (gru.gradients(p, up, places, real, y)[0] - gru.gradients(p, down, places, real, y)[0]) / 2e-3
        assert abs(slope - inner[at]) < 1e-3 * max(1, abs(slope))
    for name in p:
        at = tuple(0 for _ in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        slope = (gru.gradients(up, table, places, real, y)[0] - gru.gradients(down, table, places, real, y)[0]) / 2e-3
        assert abs(slope - g[name][at]) < 1e-3 * max(1, abs(slope))


def test_windows_cover_every_word():
    for n in (0, 1, 40, 41, 70, 71, 500):
        owner, first = toxicity.windows(np.array([0, n]))
        covered = set()
        for b in first:
            covered |= set(range(b, min(n, b + toxicity.WINDOW)))
        assert covered == set(range(n)) and (n == 0) == (len(first) == 0)


def test_held_out_texts_are_told_apart_and_labels_of_others_do_not_matter(make, spark):
    rows, labels = labelled()
    rows += [doc(9000, None), doc(9001, ""), doc(9002, " ... "), doc(None, "plain words"), doc(0, rows[0][1])]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(make(rows), frame).collect()
    assert len(got) == len(rows)
    toxic = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95
    assert all(r.score == 0.0 for r in got if r.doc_id in (9000, 9001, 9002)) and all(0 <= r.score <= 1 for r in got)
    flipped = frame.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: round(r.score, 6) for r in toxicity.score(make(rows), flipped).collect()}
    assert again == {r.doc_id: round(r.score, 6) for r in got}


def test_long_and_equal_texts_are_scored_whole_and_alike(make, spark):
    rows, labels = labelled(300)
    rng = random.Random(8)
    far = [rng.choice("aeiourstln") * 3 for _ in range(30_000)]
    rows += [doc(9100, " ".join(far)), doc(9101, " ".join([*far, "grumblix", "zorkface"])), doc(9102, rows[4][1]), doc(9102, rows[4][1]), doc(9103, rows[4][1])]
    got = toxicity.score(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    score = {r.doc_id: r.score for r in got}
    assert score[9101] > 0.3 > score[9100] and score[9102] == score[9103] == score[4] and len(got) == len(rows)


def test_toxicity_without_labels_or_documents(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(not r.predicted for r in toxicity.score(make([doc(1, "a b c")]), none).collect())
    assert toxicity.score(make([]), none).count() == 0


def test_ordinal_grades(make, spark):
    rng = random.Random(5)
    rows, grades = [], []
    for i in range(300):
        g = i % 3
        pool = (["@@##", "%%%"], ["meh", "okay"], ["fine", "great"])[g]
        rows.append(doc(i, " ".join(rng.choice(pool) + str(rng.randrange(30)) for _ in range(40))))
        grades.append((i, g))
    train = spark.createDataFrame([x for x in grades if x[0] % 5], "doc_id long, grade int")
    extra = [doc(900, None), doc(901, " "), doc(None, "great1 fine2")]
    got = {r.doc_id: r for r in quality.rate(make(rows + extra), train).collect()}
    held = [(got[i], g) for i, g in grades if i % 5 == 0]
    assert np.mean([r.kept == (g >= 1) for r, g in held]) > 0.95
    means = [np.mean([r.expected_grade for r, g in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert not got[900].kept and got[901].expected_grade == 0 and got[None].kept
    strange = [doc(950, "xqx zvz"), doc(951, " ".join(["great1 fine2"] * 20_000)), doc(952, "fine7"), doc(952, "fine7")]
    told = quality.rate(make(strange), train.where("doc_id < 0").union(train)).collect()
    assert len(told) == 4 and all(r.expected_grade > 0 for r in told) and told[2] == told[3]
    assert quality.rate(make([]), train).count() == 0
    alone = quality.rate(make([doc(1, "a"), doc(2, "")]), train.where("grade = 2")).collect()
    assert {r.doc_id: r.kept for r in alone} == {1: True, 2: False}


def slow_margin(text, net):
    """Score of a text word by word and window by window, in plain loops."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
    h = gru.HIDDEN
    vectors = []
    for word in words:
        hashes, starts, ends, _ = toxicity.words(pa.array([word]), plain=True)
        parts, _ = toxicity.pieces(np.frombuffer(word.encode(), np.uint8), starts, ends)
        at = np.flatnonzero(net["keys"] == hashes[0])
        chars = np.mean([net["pieces"][int(p) >> (64 - toxicity.PIECE_BITS)] for p in parts], axis=0) if len(parts) else np.zeros(toxicity.SIZE)
        vectors.append(np.concatenate([net["words"][at[0] + 1 if len(at) else 0], chars, [1]]).astype(float))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(side, part):
        state, out = np.zeros(h), []
        for x in part if side == "f" else part[::-1]:
            gx, gh = x @ net[f"w{side}"] + net[f"d{side}"], state @ net[f"u{side}"] + net[f"c{side}"]
            r, z = sigmoid(gx[:h] + gh[:h]), sigmoid(gx[h : 2 * h] + gh[h : 2 * h])
            n = np.tanh(gx[2 * h :] + r * gh[2 * h :])
            state = (1 - z) * n + z * state
            out.append(state)
        return out if side == "f" else out[::-1]

    best, begin = -np.inf, 0
    while words:
        part = vectors[begin : begin + toxicity.WINDOW]
        part = part + [np.zeros(toxicity.INPUTS)] * (toxicity.WINDOW - len(part))  # the backward side starts in the padding
        states = [np.concatenate(x) for x in zip(run("f", part), run("b", part))][: len(vectors) - begin]
        weight = np.array([s @ net["a"] for s in states])
        weight = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
        best = max(best, float((weight @ np.array(states)) @ net["o"] + net["k"][0]))
        if begin + toxicity.WINDOW >= len(words):
            break
        begin += toxicity.STEP
    return best


def test_margins_are_those_of_plain_loops():
    rows, labels = labelled(60)
    texts = pa.array([r[1] for r in rows])
    keys = np.unique(toxicity.words(texts, plain=True)[0])[::2]
    net = toxicity.fit(texts, np.array([t for _, _, t in labels]), {"keys": keys})
    some = ["", " .. ", "one", "Grumblix zorkface!", "é ü 漢字 mixed", *[r[1] for r in rows[:6]], " ".join(r[1] for r in rows[:3])]
    assert np.allclose(toxicity.text_margins(pa.array(some), net), [slow_margin(t, net) for t in some], atol=1e-3)


def test_quality_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(4)
    weights = rng.standard_normal(quality.WEIGHTS).astype(np.float32)
    texts = ["a", "Aa bb aa bb aa cc", "é x é", "one two three one two three one", " ".join(f"w{i % 17}" for i in range(90))]
    for text in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        hashes = [int(quality.words(pa.array([w]))[0][0]) for w in words]
        data = np.frombuffer(text.encode(), np.uint8)
        tri = [int(quality._trigrams(data[i : i + 3])[0]) for i in range(len(data) - 2)]
        want = np.mean([weights[x >> (64 - quality.BITS)] for x in hashes]) + (np.mean([weights[quality._TRIGRAM + t] for t in tri]) if tri else 0)
        want += sum(weights[quality._LAG + i] * sum(a == b for a, b in zip(hashes, hashes[lag:])) / len(words) for i, lag in enumerate(quality.LAGS))
        want += weights[quality._STEP + min(quality.STEPS - 1, int(quality.STEPS * len(set(hashes)) / len(hashes)))]
        assert np.allclose(quality.scores(pa.array([text, "", text]), weights), [want, np.nan, want], atol=1e-4, equal_nan=True)


def test_cumulative_links_are_fitted_to_the_likelihood():
    """The fitted thresholds and one shared weight come near the best of a grid."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal(900)
    grade = (x + rng.logistic(size=900) > -0.5).astype(int) + (x + rng.logistic(size=900) > 1.5)
    slots, values = [np.array([0], np.int32)] * 900, [np.array([v], np.float32) for v in x]
    weights, cuts = quality.fit(slots, values, grade, 3)

    def loss(w, cuts):
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        p = 1 / (1 + np.exp(-(edges[grade + 1] - w * x))) - 1 / (1 + np.exp(-(edges[grade] - w * x)))
        return -np.log(np.maximum(p, 1e-9)).mean()

    best = min(loss(w, (a, b)) for w in np.arange(0.2, 2, 0.2) for a in np.arange(-1.5, 1, 0.25) for b in np.arange(0.5, 3, 0.25))
    assert loss(float(weights[0]), cuts) < best + 0.02 and cuts[0] < cuts[1]
