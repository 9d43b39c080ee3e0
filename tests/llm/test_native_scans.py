import hashlib
import re

import duckdb
import pandas as pd
import pytest

from lodestone.llm import boosting, licenses, mixing, pii

from .conftest import doc

LICENSES = [
    doc(1, "Licensed under CC BY-NC 4.0.\nrest of it"),
    doc(2, "ALL rights... RESERVED and cc,by twice cc-by"),
    doc(3, "This work is licensed under the\nGNU General Public License, version 3."),
    doc(4, None),
    doc(5, ""),
    doc(6, "accby by cc Kall rights reservedx"),
    doc(7, "Released under the Apache License"),
    doc(8, "x " * 3000 + "Released under the MIT License."),
    doc(8, "x " * 3000 + "Released under the MIT License."),
    doc(None, "general public license"),
    doc(9, "the " + "a " * 500 + "mit " + "b " * 500 + "license " + "c " * 500 + "released " + "d " * 500 + "under"),
    doc(10, "# Released\n# under\n#\n#  the MIT\n# license"),
    doc(11, "released under the old mit license"),
    doc(12, "released under the very old mit license"),
    doc(13, "this is free and unencumbered software, put into public domain; released into the public domain"),
]


def test_license_scan_equals_sql(make):
    documents = pd.DataFrame([(r[0], r[1]) for r in LICENSES], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    rel = con.sql(licenses.ORACLE)
    want = sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=str)
    got = sorted((r.asDict() for r in licenses.scan(make(LICENSES)).collect()), key=lambda r: str({k: r[k] for k in rel.columns}))
    assert [{k: r[k] for k in rel.columns} for r in got] == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["labels"] == "cc-by,cc-by-nc-4.0" and by_id[3]["labels"] == "gpl,gpl-3.0" and by_id[7]["labels"] == "" and by_id[8]["labels"] == "mit"
    assert by_id[4] == {"doc_id": 4, "n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
    assert [by_id[i]["labels"] for i in (9, 10, 11, 12, 13)] == ["", "mit", "mit", "", "unlicense"] and by_id[9]["score"] == 0.0
    assert licenses.scan(make([])).count() == 0


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for place, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PII = [
    "x@y.z@a.b a@b.c_d@e.f, é\U0001f600 me@mail.example.com",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 256.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 378282246310005",
    "+1 (017) 555-7713 +22 333 +1+2 333 444 5555 555-",
    'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"',
    None,
    "",
    "clean words only",
    "1" * 6000 + " +" + "(" * 4000 + " a" * 4000 + "@" + " " + "b.c@" * 50,
    ".".join(["7"] * 2001),
]


def test_base_spans_equal_brute_force_and_stay(make):
    rows = [doc(i, t) for i, t in enumerate(PII)] + [doc(0, PII[0])]
    got = pii.detect(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(PII[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in RULES]
        assert r.n_spans == len([x for x in r.spans.split(",") if x])
    assert "secret:0:" in next(r.spans for r in got if r.doc_id == 4) and next(r.spans for r in got if r.doc_id == 7) == ""
    assert pii.detect(make([])).count() == 0


def test_redaction_takes_spans_out_and_leaves_the_rest(make):
    out = {r.doc_id: r for r in pii.redact(make([doc(i, t) for i, t in enumerate(PII)])).collect()}
    assert out[0].text == "[EMAIL]@a.b [EMAIL]_d@e.f, é\U0001f600 [EMAIL]".replace("_d@e.f", "[EMAIL]") or "me@mail" not in out[0].text
    assert out[7].text == "clean words only" and out[5].text is None and out[6].text == ""
    assert out[4].text == "[SECRET]" and out[4].n_chars == len("[SECRET]")
    assert "4111 1111 1111 1111" not in out[2].text and out[2].source == "s0"


def test_redaction_with_clashing_columns_and_rows(make):
    frame = make([doc(1, "mail me@mail.example.com"), doc(1, "mail me@mail.example.com"), doc(None, "clean"), doc(3, None)])
    names = {"title": "_row", "component_id": "_cuts", "score": "_hash", "lang": "_maybe"}
    out = pii.redact(frame.withColumnsRenamed(names))
    assert out.columns == [names.get(c, c) for c in frame.columns]
    assert sorted((r.doc_id or 0, r.text or "", r["_row"]) for r in out.collect()) == [(0, "clean", "t"), (1, "mail [EMAIL]", "t"), (1, "mail [EMAIL]", "t"), (3, "", "t")]
    assert pii.redact(make([])).count() == 0


def test_boosted_trees_separate_and_become_sql(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x, y)
    margin = boosting.predict(model, x)
    assert ((margin > 0) == (y > 0)).mean() > 0.95
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in frame.selectExpr(boosting.sql(model, ["a", "b", "c"])).collect()]
    assert np.allclose(got, margin)
    a, b = boosting.calibrate(margin, y)
    assert a > 0 and boosting.cutoff(1 / (1 + np.exp(-(a * margin + b))), y, 0.9) < 0.9


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" a\tb\x0b\x0cc ", 3), (" x", 1), ("\x01 \x01", 2)])
def test_word_counts(spark, text, n):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(mixing.n_words(F.col("t"))).first()[0] == n


def test_account_numbers_and_what_follows(make):
    rows = [doc(1, "iban GB82 WEST 1234 5698 7654 32 please"), doc(2, "iban GB83 WEST 1234 5698 7654 32 please"), doc(3, "we saw 20240101 views in 12345678 units"), doc(4, "DE89370400440532013000")]
    got = {r.doc_id: r.spans for r in pii.detect(make(rows)).collect()}
    assert "iban:5:32" in got[1].split(",") and "iban" not in got[2] and got[3] == "" and "iban:0:22" in got[4]
