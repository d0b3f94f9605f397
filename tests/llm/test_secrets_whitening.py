"""Secret scans and whitening against brute force, with nulls, empties, long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessera.llm import secret_scan, whitening

RNG = random.Random(7)
HEX, UPPER, B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def drawn(alphabet, k):
    return "".join(RNG.choice(alphabet) for _ in range(k))


TEXTS = [
    None, "", " \n", "nothing to see, é日本 only words", "erberbeeinheitkeiter and/or/some-long_path-of/words-2024/01/02",
    f'pässword token = "{drawn(HEX, 40)}" tail', f"日本 PASSWORD:{drawn(B64, 9)} passwd =short api-key=x api_key: '{drawn(B64, 30)}'", "secret=abc token==abcdef secret : -----. Token='\"abcdefg",
    f"AKIA{drawn(UPPER, 16)} AKIA{drawn(UPPER, 15)} xAKIA{drawn(UPPER, 40)}AKIA", drawn(HEX, 23) + " " + drawn(HEX, 24) + "g" + drawn(HEX, 300),
    f"key {drawn(B64, 44)} and {drawn(B64, 19)}", f"mail {drawn(UPPER, 32)}.", "g" * 500 + "H" * 500 + drawn(B64, 60) + "z" * 400, "550e8400-e29b-41d4-a716-446655440000 0123456789abcdefABCDEF0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "word " * 250_000 + drawn(B64, 50) + " x" * 200_000, drawn(B64, 70_000), "0" * 40 + "12345678901234567890", "toKen:" + "a" * 100_000,
]


def entropy(s):
    return -sum(s.count(x) / len(s) * math.log2(s.count(x) / len(s)) for x in set(s))


def brute(text):
    """Spans by definition: every window counted anew."""
    text, out = text or "", []
    for k, p in enumerate(secret_scan.BASE):
        out += [(m.start(), k, m.end(), p.kind) for m in re.finditer(p.pattern, text, re.ASCII) if len(m[p.group]) >= p.least]
    for k, c in enumerate(secret_scan.CLASSES):
        new = []
        for m in re.finditer(f"[{c.characters}]+", text):
            if len(m[0]) < max(c.least, c.window) or any(re.fullmatch(a, m[0]) for a in secret_scan.ALLOW):
                continue
            covered = set()
            for i in range(len(m[0]) - c.window + 1):
                w = m[0][i : i + c.window]
                if entropy(w) >= c.bits and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
                    covered |= {(i, i + c.window)}
            spans = []
            for b, e in sorted(covered):
                if spans and b <= spans[-1][1]:
                    spans[-1][1] = e
                else:
                    spans.append([b, e])
            new += [(m.start() + b, 10 + k, m.start() + e, c.kind) for b, e in spans]
        out += [s for s in new if not any(o[0] <= s[0] and s[2] <= o[2] for o in out)]
    return [(kind, b, e) for b, _, e, kind in sorted(out)]


def test_secrets_equal_brute_force(spark):
    rows = [(k, t, "id", "hit", "spans", "n_hex") for k, t in enumerate(TEXTS)] + [(None, TEXTS[5], "", "", "", ""), (5, TEXTS[5], "", "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, hit string, spans string, n_hex string").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, [tuple(s) for s in r.spans]) for r in secret_scan.find_secrets(docs).collect()), key=str)
    want = sorted(((r[0] if r[0] is not None else -1, brute(r[1])) for r in rows), key=str)
    assert got == want
    kinds = {s[0] for _, spans in got for s in spans}
    assert kinds == {p.kind for p in secret_scan.BASE} | {c.kind for c in secret_scan.CLASSES}
    assert dict(want)[12] and all(970 < s[1] and s[2] < 1100 for s in dict(want)[12])  # the dull part of a long string is no secret
    assert not secret_scan.find_secrets(docs.where("false")).collect()


def test_secrets_digest_and_sql(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.asDict() for r in secret_scan.op11_secret_scan(spark, str(tmp_path)).collect()}
    base = {p.kind for p in secret_scan.BASE}
    for k, text in enumerate(TEXTS):
        spans = brute(text)
        own = ",".join(f"{a}:{b}:{c}" for a, b, c in spans if a in base)
        assert got[k]["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and got[k]["spans"] == ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == tuple(sum(a == p.kind for a, _, _ in spans) for p in secret_scan.BASE)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.sql(secret_scan.OP11_SQL)
    assert {r[0]: dict(zip(told.columns, r)) for r in told.fetchall()} == got


def test_secrets_are_masked(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, merged string")
    got = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.find_secrets(docs, with_text=True)).collect()}
    for k, text in enumerate(TEXTS):
        spans = []
        for _, b, e in brute(text):
            if spans and b < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([b, e])
        for b, e in reversed(spans):
            text = text[:b] + "[secret]" + text[e:]
        assert got[k] == text


def test_allow_list_and_limits(spark):
    token = drawn(B64, 30)
    docs = spark.createDataFrame([(1, f"see {token} here")], "doc_id long, text string")
    assert secret_scan.find_secrets(docs).first().spans and not secret_scan.find_secrets(docs, allow=[re.escape(token)]).first().spans
    for c in secret_scan.CLASSES:  # no attainable entropy is so near the limit that rounding decides
        assert min(abs(h - c.bits) for h in (-sum(k / c.window * math.log2(k / c.window) for k in p) for p in partitions(c.window))) > 1e-6


def partitions(n, largest=None):
    if not n:
        yield ()
    for k in range(min(n, largest or n), 0, -1):
        yield from ((k, *rest) for rest in partitions(n - k, k))


# -- whitening -------------------------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "v", "d") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, v string, d string")


def check(got, rows, k, model, error):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    y = np.array([[float(Fraction(int(c)) - Fraction(int(s), n)) for c, s in zip(row, sums)] for row in x])
    values, components = np.linalg.eigh(y.T @ y / n)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    assert np.allclose(model.values[:k], values, rtol=1e-9) and math.isclose(model.trace, np.square(y).sum() / n, rel_tol=1e-12) and error < 1e-8
    want = y @ components / np.sqrt(values)
    told = {r.vec_id: np.array(r.whitened) for r in got}
    sign = np.sign((want * np.array([told[i] for i, _ in rows])).sum(axis=0))
    for (i, _), w, row in zip(rows, want, x):
        assert np.allclose(told[i] * sign, w, atol=1e-7)
    assert {r.vec_id: int(r.deviation) for r in got} == {i: int(sum((n * c - s) ** 2 for c, s in zip(row, sums))) for (i, _), row in zip(rows, x)}


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_whitening_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + 5)]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [1.0] * 11 + [float("nan")]), (904, [float("inf")] * 12), (905, [1.0, 2.0]), (906, [1e30] * 12)]
    got, model, error = whitening.whiten(vectors(spark, rows + bad).repartition(7), 8)
    check(got.collect(), rows, 8, model, error)
    assert model.n == 300 and model.sums == [sum(math.floor(1024 * float(np.float32(v[j]))) + 100_000 for _, v in rows) for j in range(12)]


def test_whitening_edges(spark):
    same = [(k % 3, [0.5, 0.25, -1.0]) for k in range(9)]
    got, model, error = whitening.whiten(vectors(spark, same))
    assert [r.whitened for r in got.collect()] == [[None] * 3] * 9 and error is None and model.n == 9 and {r.deviation for r in got.collect()} == {0}
    empty, model, error = whitening.whiten(vectors(spark, [(1, None)]))
    assert empty.collect() == [] and model is None and empty.columns == ["vec_id", "whitened", "deviation"]
    two = [(None, [1.0, 1.0, 0.0]), (1, [0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0])]  # a line, a repeat and a null id
    got, model, error = whitening.whiten(vectors(spark, two), None)
    rows = got.collect()
    assert model.n == 3 and len(rows) == 3 and all(r.whitened[1:] == [None, None] for r in rows) and error < 1e-9
    assert sorted(abs(r.whitened[0]) for r in rows) == pytest.approx([0.5**0.5, 0.5**0.5, 2**0.5])
    far = [(k, [float((1 << 41) + 7 * k), 1.0]) for k in range(5)]  # sums and deviations beyond doubles, not beyond decimals
    got, model, _ = whitening.whiten(vectors(spark, far, "double"))
    xs = [1024 * ((1 << 41) + 7 * k) + 100_000 for k in range(5)]
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == {k: (5 * xs[k] - sum(xs)) ** 2 for k in range(5)} and model.sums[0] == sum(xs)


def test_whitening_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rng.standard_normal((50, 5)))] + [(99, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = whitening.op12_whitening(spark, str(tmp_path)).collect()
    assert len(rows) == 250 and {r.component for r in rows} == set(range(1, 6)) and {r.n for r in rows} == {50}
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1) and {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert whitening.op12_whitening(spark, str(tmp_path / "none")).collect() == []
