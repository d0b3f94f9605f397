"""Every corpus operator against brute force, on texts with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, epsilon_join, exact_dedup, language_id, mixing, ngram_join, pitman_yor, sentencepieces, suffix_dedup, textbytes, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WORDS = ["the", "of", "Étoile", "rain", "in", "Spain", "falls", "mainly", "on", "plains", "x", "ßtraße", "日本"]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def corpus(seed=0, n=60):
    """(id, text) rows: random texts, exact and near copies, nulls, blanks, one long text, a repeated row."""
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ing"]) for _ in range(k))
    rows = [(k, make(rng.randint(1, 60))) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(10)]
    rows += [(n + 10 + k, rows[k][1] + " tail") for k in range(10)]
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \n\t "), (n + 23, make(3000)), (n + 24, "one"), (n + 25, "ONE"), (n + 26, "a\u00a0b\n\nc")]
    return rows


def frame(spark, rows, **more):
    """documents with columns whose names the operators use inside."""
    cols = "doc_id long, text string, " + ", ".join(f"{c} string" for c in ("lang", "source", "id", "label", "n", "key", "counts"))
    return spark.createDataFrame([(i, t, more.get("lang", {}).get(i), None, "id", "label", "n", "key", "counts") for i, t in rows], cols)


def components(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


# -- shared parts ----------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["A b  c", None, "", "  x", "b A", "é É", "a" * 50]
    out = {}
    for row, _, hashes, first in textbytes.words_of_texts(pa.array(texts)):
        for k in range(len(first) - 1):
            out[row + k] = hashes[first[k] : first[k + 1]].tolist()
    assert [len(out.get(k, [])) for k in range(7)] == [3, 0, 0, 1, 2, 2, 1]
    assert out[0][:2] == out[4][::-1] and out[5][0] != out[5][1]
    limit, textbytes.PIECE = textbytes.PIECE, 16
    try:
        data, offsets = textbytes.text_buffers(pa.array(["aa bb cc dd ee ff gg hh", "zz"]))
        got = list(textbytes.pieces(data, offsets, 8))
        assert b"".join(bytes(p[1]) for p in got) == b"aa bb cc dd ee ff gg hhzz" and got[-1][0] == 1
    finally:
        textbytes.PIECE = limit


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)]
    got = {r.node: r.component_id for r in common.components(spark.createDataFrame(links + [(1, 1)], "a long, b long").repartition(5), one_task).collect()}
    want = components({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k in {x for a, b in links if a != b for x in (a, b)}}
    assert common.components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


# -- 1 ---------------------------------------------------------------------------------------------------


def test_epsilon_join(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((12, 16))
    x = np.repeat(centre, 12, axis=0) + rng.standard_normal((144, 16)) * rng.choice([0.02, 0.08, 0.2], (144, 1))
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(x)] + [(200, x[0].tolist(), 0), (201, x[0].tolist(), 1), (202, (2 * x[0]).tolist(), 0), (203, None, 0), (204, [0.0] * 16, 0), (205, [math.nan] * 16, 0), (206, x[1].tolist(), None), (207, [], 0), (208, [1.0, 0.0], 0), (209, [0.99, 0.001], 0), (200, x[0].tolist(), 0)]
    got = collections.defaultdict(set)
    for r in epsilon_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got[r.vec_id].add(tuple(r[1:]))
    good = {k: (np.array(v), y) for k, v, y in rows if v and y is not None and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    root = components({r[0] for r in rows}, links)
    degree = collections.Counter(x for e in links for x in e)
    assert len(links) > 20 and got == {k: {(degree[k], root[k], root[k] == k)} for k in root}
    assert epsilon_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------


def brute_classes(rows, n, percent):
    sets = {i: (lambda w: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())(words(t)) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


@pytest.mark.parametrize(("n", "percent", "one_task"), [(3, 90, 1 << 20), (5, 80, 0), (1, 60, 1 << 20)])
def test_jaccard_classes(spark, n, percent, one_task):
    rows = corpus(n)
    base = [f"w{k}" for k in range(80)]
    rng = random.Random(n)
    for k in range(40):  # a group of near copies, some of them too far from the base
        own = base.copy()
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = f"e{k}{rng.random()}"
        rows.append((1000 + k, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(frame(spark, rows).repartition(6), n, percent, one_task=one_task).collect()}
    assert got == brute_classes(rows, n, percent)


def test_jaccard_edges(spark):
    assert ngram_join.jaccard_classes(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)])
    assert sorted(map(str, (r.component_id for r in ngram_join.jaccard_classes(twice).collect()))) == ["1", "1", "1", "2"]
    left = ngram_join.keep_one_of_each(frame(spark, corpus()))
    assert left.columns == frame(spark, []).columns and left.where("text is null").count() == 1


# -- 3 ---------------------------------------------------------------------------------------------------


def test_url_rules_and_list(spark):
    urls = ["http://EXAMPLE.com/en/7?x", "https://a.example.com/en/70", "https://b.com/en/", "https://xcom/en/1", "http://example.net/de/8", "http://q.example.net/de/9#t", "http://a.org", None, "no scheme", "http://a.org/es/1", "ftp://listed.io/a?b", "http://x.listed.io/a", "http://a//b://c", "://"]
    pages = spark.createDataFrame([(k, u, "h", "p", "v") for k, u in enumerate(urls)] + [(0, urls[0], "h", "p", "v")], "page_id long, url string, host string, path string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, spark.createDataFrame([("http://LISTED.io/a",), (None,)], "url string")).collect()}
    assert [got[k][2:] for k in range(14)] == [("example.com/en/7", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/es/", "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert got[7][:2] == ("", "") and got[12][:2] == ("a", "//b://c") and got[6][:2] == ("a.org", "")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    made, blocks = url_filter.bloom_filter(keys, 5000)
    assert url_filter.possible(keys, made, blocks).count() == 5000
    assert url_filter.possible(spark.range(5000, 15000).select(F.col("id").cast("string").alias("key")), made, blocks).count() < 300


# -- 4 ---------------------------------------------------------------------------------------------------


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = corpus(4) + [(500 + k, t) for k, t in enumerate(["  two  marks ", "\ttab\n", "𝄞é ü", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "#" * 70, "        deep", "1234567890 3.14", "x\u2581y", "a\u2581 b"])]
    out = sentencepieces.decode(sentencepieces.encode(frame(spark, rows))).select("doc_id", "text", "ids", "decoded").collect()
    for r in out:
        assert r.ids == library.encode(r.text or ""), r.text
        assert r.decoded == (r.text or "").replace("\u2581", " ")
    assert len(out) == len(rows)


def test_unigram_pieces_have_the_best_sum():
    from itertools import combinations

    score = {"▁a": -1.0, "b": -2.0, "ab": -1.5, "▁": -3.0, "a": -2.5, "▁ab": -2.9, "bb": -2.0}
    record = lambda p, s, k=1: b"\x0a" + bytes([len(m := b"\x0a" + bytes([len(p.encode())]) + p.encode() + b"\x15" + np.float32(s).tobytes() + b"\x18" + bytes([k]))]) + m
    model = record("<unk>", 0, 2) + b"".join(record(p, s) for p, s in score.items()) + b"\x12\x02\x18\x01" + b"\x1a\x0e\x0a\x08identity\x18\x01\x20\x00"
    pieces = sentencepieces.Pieces(model)
    assert not pieces.bpe
    names = sorted(["▁ab", "▁abb", "▁abbb", "▁abab", "▁bba"])
    for word, ids in zip(names, pieces.encode_sorted(names)):
        cuts = [[word[a:b] for a, b in zip((0, *c), (*c, len(word)))] for r in range(len(word)) for c in combinations(range(1, len(word)), r)]
        best = max(sum(score[p] for p in c) for c in cuts if all(p in score for p in c))
        assert sum(score[pieces.pieces[k]] for k in ids) == pytest.approx(best)


# -- 5 ---------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en"), (10_001, "", "en"), (10_002, "123 !!", "en"), (10_003, "a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text", "lang").union(extra)).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in lang if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in lang)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97
    assert [got[k].lang_pred for k in (10_000, 10_001, 10_002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs.where("false")).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------------


def test_exact_groups(spark):
    rows = corpus(6) + [(900, " one"), (901, "one \t "), (902, "one\n"), (None, "lonely"), (None, "lonely"), (3, corpus(6)[3][1])]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    docs = frame(spark, rows)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=str) == want
    half = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0 or doc_id is null")]
    assert sorted(map(tuple, exact_dedup.exact_groups(half[0], half[1]).collect()), key=str) == want
    left = exact_dedup.keep_first(docs)
    assert left.columns == docs.columns and left.where("doc_id is not null").count() == len({k for k in keep.values() if k is not None})
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0
    long = [(1, "ab " * 700_000), (2, "ab\t\n" * 700_000), (3, "ab " * 700_000 + "c")]
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_groups(frame(spark, long)).collect()) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]


def test_exact_groups_come_from_the_hash(spark, monkeypatch):
    """A lookup that finds nothing changes the result: no other step brings equal digests of both sides together."""
    docs = frame(spark, corpus(6))
    right = {r.doc_id: tuple(r)[1:4] for r in exact_dedup.exact_groups(docs).collect()}
    real, names = exact_dedup._lookup, [c.split()[0] for c in exact_dedup._FOUND.split(", ")]

    def blind(asked, index):
        out = real(asked, index)
        none = pa.nulls(len(out), pa.int64())
        return pa.table([*(out[c] for c in names[:5]), none, none, pa.array([0] * len(out), pa.int64())], names=names)

    monkeypatch.setattr(exact_dedup, "_lookup", blind)
    wrong = {r.doc_id: tuple(r)[1:4] for r in exact_dedup.exact_groups(docs).collect()}
    assert wrong != right and any(wrong[60 + k][0] == 60 + k for k in range(10))


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 62, (5000, 4), dtype=np.uint64)
    sizes, bits = exact_dedup.build_hash(keys)
    assert sorted(exact_dedup.slots(keys, sizes, bits)) == list(range(5000))


# -- 7 ---------------------------------------------------------------------------------------------------


def test_raking_meets_its_targets(spark):
    rows = [(k, "w " * (1 + k % 7), f"l{k % 3}", None if k % 11 == 0 else f"s{k % 4}") for k in range(400)] + [(400, None, "l0", "s0"), (401, " ", None, "s1"), (7, "w", "l1", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"source": spark.createDataFrame([("s0", 0.4), ("s1", 0.3), ("s2", 0.1), ("s3", 0.15), ("unknown", 0.05)], "v string, share double"), "lang": spark.createDataFrame([("l0", 0.5), ("l1", 0.25), ("l2", 0.25)], "v string, share double"), "topic": spark.createDataFrame([("prose", 1.0)], "v string, share double")}
    out = mixing.mixed(docs, want)
    mass = out.groupBy("mix_lang").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("m")).collect()
    total = sum(r.m for r in mass)
    assert {r.mix_lang: round(r.m / total, 6) for r in mass if r.m} == {"l0": 0.5, "l1": 0.25, "l2": 0.25}
    assert out.agg(F.max("probability")).first()[0] == pytest.approx(1)
    assert out.where("n_tokens = 0 and (sampled or probability > 0)").count() == 0
    kept = mixing.sample_mix(docs, targets=want)
    assert kept.columns == docs.columns and 0 < kept.count() < 402
    assert mixing.mixed(docs.where("false")).count() == 0
    clash = docs.withColumns({c: F.lit(-7.0) for c in ("n_tokens", "p", "probability", "sampled", "mix_source", "rate", "tokens", "mass", "row")})
    again = mixing.sample_mix(clash, targets=want)
    assert again.columns == clash.columns and sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept.collect())
    assert {r.probability for r in again.collect()} == {-7.0}
    assert sorted(map(str, mixing.mixed(clash, want, carried=["doc_id"]).collect())) == sorted(map(str, mixing.mixed(docs, want, carried=["doc_id"]).collect()))
    assert 0 <= mixing.mixed(clash, want).agg(F.min("probability")).first()[0]


# -- 8 ---------------------------------------------------------------------------------------------------


def test_seating_samples_the_exact_conditional():
    rng = np.random.default_rng(0)
    seats = pitman_yor.Seating(np.full(20000, 3), np.full(20000, 1.0), 0.8, rng)
    for _ in range(40):
        seats.sweep(np.full(20000, 1.0))
    share = np.bincount(seats.tables(), minlength=4)[1:] / 20000
    weight = np.array([0.2 * 1.2, 3 * 0.2, 1.0])  # one, two and three tables of three customers
    assert np.abs(share - weight / weight.sum()).max() < 0.02
    for k, first in enumerate(seats.first):
        own = slice(first, first + 3)
        assert seats.seats[own].sum() == 3 and (seats.seats[own] > 0).sum() == seats.n[k]


def test_cells_seated_together_follow_the_law_of_customers_one_by_one():
    """Tables drawn at once, tables after many sweeps of single customers, and the law written out by partitions."""
    rng = np.random.default_rng(2)
    for size, a in ((2, 0.3), (5, 1.7), (7, 40.0)):
        drawn = np.bincount(pitman_yor.draw_tables(np.full(40000, size), np.full(40000, a), 0.8, rng), minlength=size + 1)[1:] / 40000
        single = pitman_yor.Seating(np.full(8000, size), np.full(8000, a), 0.8, rng)
        for _ in range(25):
            single.sweep(np.full(8000, a))
        weight = np.zeros(size)

        def seat(left, sizes):
            if not left:
                weight[len(sizes) - 1] += a ** len(sizes) * math.prod(math.prod(j - 0.8 for j in range(1, s)) for s in sizes)
                return
            for k in range(len(sizes)):
                seat(left - 1, sizes[:k] + [sizes[k] + 1] + sizes[k + 1 :])
            seat(left - 1, [*sizes, 1])

        seat(size - 1, [1])
        assert np.abs(drawn - weight / weight.sum()).max() < 0.012
        assert np.abs(np.bincount(single.tables(), minlength=size + 1)[1:] / 8000 - weight / weight.sum()).max() < 0.03
    mixed = np.array([1, 2, 600, 3, 512, 513, 0])
    seats = pitman_yor.Seats(mixed, np.ones(7), 0.8, rng)
    again = pitman_yor.Seats(mixed, None, 0.8, rng, seats.state())
    assert (again.tables() == seats.tables()).all() and seats.tables()[0] == 1 and seats.tables()[6] == 0
    again.sweep(np.ones(7))
    assert (again.tables() <= mixed).all() and (again.tables()[:6] >= 1).all()


def test_large_cells_are_drawn_from_the_exact_law():
    """The contour integral and the tabled numbers agree from one table to nearly all, and nothing is kept by customer."""
    law, t, place = pitman_yor.log_stirling(0.8, 700)[700, 1:], np.arange(1, 701), (np.arange(2000) + 0.5) / 2000
    laws = []
    for a in (1e-6, 0.3, 8.0, 90.0, 500.0, 750.0, 3000.0, 1e6):
        weight = np.exp(law + t * np.log(a) - (law + t * np.log(a)).max())
        weight /= weight.sum()
        mean = weight @ t
        seats = pitman_yor.Seats(np.full(2000, 700), np.full(2000, a), 0.8, np.random.default_rng(4))
        seats.sweep(np.full(2000, a))
        assert abs(seats.tables().mean() - mean) <= 5 * math.sqrt(max(weight @ (t - mean) ** 2, 1e-6) / 2000) + 1e-2
        laws.append((a, weight.cumsum()))
    for a, below in laws:
        assert (pitman_yor._draw_many(np.full(2000, 700.0), np.full(2000, a), 0.8, place) == 1 + np.searchsorted(below, place)).all()
    counts = np.array([1, 40_000, 30_000_000])
    seats = pitman_yor.Seats(counts, np.array([1.0, 4.0, 900.0]), 0.8, np.random.default_rng(5))
    assert len(seats.state()) == 2 and seats.tables()[0] == 1 and 1 <= seats.tables()[1] < 30 and 900 < seats.tables()[2] < 1350


def test_cells_of_flushes_are_merged_whatever_stands_between():
    """Contexts that begin alike stand between the tokens of a cell; a word that only held-out texts have stays known."""
    contexts = np.array([5, 6, 5, 6, 5, 7, 1 << 60], np.uint64)
    words = np.array([9, 9, 9, 9, 9, 2, 3], np.uint64)
    bodies = [pitman_yor._pack(words, contexts, np.array([1, 1, 1, 1, 0, 0, 1]), True), pitman_yor._pack(words[:2], contexts[:2], np.array([4, 0]), True)]
    state = pitman_yor.Bucket(lambda w: np.ones(len(w), np.int64), 1)
    state.open(bodies, np.random.default_rng(0))
    assert state.words.tolist() == [2, 3, 9] and state.keys.tolist() == [5, 6, 7, 1 << 60] and state.width.tolist() == [0, 1, 2]
    assert list(zip(state.word.tolist(), state.cell_context.tolist(), state.counts.tolist())) == [(1, 3, 1), (2, 0, 6), (2, 1, 2)]


def test_a_sweep_reseats_every_customer():
    counts = np.array([1] + [50] * 300 + [4000, 700])
    seats = pitman_yor.Seating(counts, np.full(len(counts), 1e-9), 0.8, np.random.default_rng(3))
    assert (seats.tables() == 1).all()
    seats.sweep(np.full(len(counts), 1e12))
    assert (seats.tables() >= counts - 1).all()
    again = pitman_yor.Seating(counts, None, 0.8, np.random.default_rng(4), seats.names())
    assert (again.tables() == seats.tables()).all() and (again.seats == seats.seats).all()
    seats.sweep(np.full(len(counts), 1e-9))
    seats.sweep(np.full(len(counts), 1e-9))
    assert (np.bincount(seats.table, minlength=len(seats.seats)) == seats.seats).all() and seats.tables().mean() < 12


@pytest.mark.parametrize("bucket", [400, 1 << 22])
def test_pitman_yor_scores(spark, bucket, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", bucket)
    rows = corpus(8, 120)
    got = {r.doc_id: r for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    tokens = {i: [*words(t), None] for i, t in rows}
    teach = collections.Counter(w for i in tokens if zlib.crc32(str(i).encode()) % 10 for w in tokens[i])
    total, types = sum(teach.values()), len(teach)
    for i, t in tokens.items():
        base = sum(math.log10((teach[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(teach[w] > 0 for w in t), total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


@pytest.mark.parametrize("bucket", [60, 1 << 22])
def test_words_whose_hashes_begin_alike_keep_their_own_predictions(spark, bucket, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", bucket)
    seen = {}
    for k in range(5000):
        ((_, _, hashes, _),) = textbytes.words_of_texts(pa.array([f"w{k}"]))
        top = int(hashes[0]) >> 48
        if top in seen:
            one, two = seen[top], f"w{k}"
            break
        seen[top] = f"w{k}"
    taught = [i for i in range(10000) if zlib.crc32(str(i).encode()) % 10][:80]
    rows = [(i, f"{one} left" if k % 2 else f"{two} right") for k, i in enumerate(taught)]
    asked = [i for i in range(10000, 20000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows += list(zip(asked, (f"{one} left", f"{one} right", f"{two} right", f"{two} left")))
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(frame(spark, rows)).collect()}
    a, b, c, d = (got[i] for i in asked)
    assert min(a - b, c - d) > 0.8  # a shared restaurant gives both words the same predictions


def test_model_beats_the_base_on_held_out_texts(spark):
    out = pitman_yor.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# -- 9 ---------------------------------------------------------------------------------------------------


def test_merged_transforms_give_the_first_ids(monkeypatch):
    rng = random.Random(1)
    for _ in range(40):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", rng.choice([8, 30, 1000]))
        n = rng.choice([2, 3, 5])
        texts = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 12))))
        ids = np.array(rng.sample(range(100), len(texts)))
        for t, got in zip(texts, suffix_dedup.first_ids(texts, ids, n)):
            assert list(got) == [min(int(j) for u, j in zip(texts, ids) if t[k : k + n] in u) for k in range(len(t) - n + 1)]


@pytest.mark.parametrize("heavy", [0, 1 << 30])
def test_remove_repeats(spark, heavy, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    rng = random.Random(2)
    make = lambda k: "".join(rng.choice("abcdefgé \n") for _ in range(k))
    passage = make(90)
    rows = [(k, make(rng.randint(0, 200)) + (passage if k % 3 == 0 else "") + make(20)) for k in range(30)]
    rows += [(40, rows[4][1]), (41, rows[4][1] + "!"), (42, None), (43, "De " * 300), (44, "x" + "De " * 200), (45, passage[10:]), (46, passage[:49]), (4, rows[4][1])]
    starts = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            starts[b[k : k + 50]] = min(i, starts.get(b[k : k + 50], i))
    want = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if starts[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.add((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest(), left))
    got = [tuple(r[:5]) + (bytes(r.kept),) for r in suffix_dedup.remove_repeats(frame(spark, rows + [(None, passage)])).collect()]
    assert len(got) == len(rows) + 1 and {g for g in got if g[0] is not None} == want
    assert [g for g in got if g[0] is None][0][2] == 0
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_texts_that_share_less_than_a_key_are_not_cut(spark, monkeypatch):
    """Anchors that texts share by chance grow with the square of the corpus; keys hold more bytes than these have."""
    rng = random.Random(3)
    make = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    chance, passage, cut, keep = make(30), make(60), [], common.keep

    def kept(df, *how):
        out = keep(df, *how)
        if "segment" in df.columns:
            cut.append({r.id for r in out.select("id").collect()})
        return out

    monkeypatch.setattr(common, "keep", kept)
    rows = [(k, make(60) + (passage if k in (7, 31) else chance) + make(60)) for k in range(40)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert {k: n for k, n in got.items() if n} == {31: 60} and cut[0] == {7, 31}


def test_many_groups_and_ranges_give_the_same_removals(spark, monkeypatch):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 90))) for _ in range(30)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(4))) for k in range(60)]
    rows += [(60, "ab" * 80), (61, "b" + "ab" * 60), (7, rows[7][1]), (8, rows[9][1])]
    want = sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 500)
    assert sum(r[2] > 0 for r in want) > 20 and sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()) == want


def test_prints_of_keys():
    key = np.array([5, 9, 5, 5, 7, 9], np.uint64) << np.uint64(24)
    own, which = suffix_dedup.prints(key, np.array([0, 0, 0, 1, 1, 0]), 40)
    assert list(own) == [5, 5, 7, 9] and list(own[which]) == [5, 9, 5, 5, 7, 9] and list(which) == [0, 3, 0, 0, 2, 3]
    same = suffix_dedup._compare(pa.table({"g": [1, 2], "range": [0, 0], "prints": pa.array([np.array(x, np.uint32).tobytes() for x in ([1, 1, 4], [2, 4, 9])])}))
    assert [list(np.unpackbits(np.frombuffer(x, np.uint8))[:3]) for x in same["hits"].to_pylist()] == [[1, 1, 1], [0, 1, 0]]


# -- 10 --------------------------------------------------------------------------------------------------


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    vectors = list({tuple(sorted(rng.choice(30, rng.integers(1, 6), replace=False))): None for _ in range(900)})
    vectors = [(list(map(int, v)), [1] * len(v)) for v in vectors]
    idf = rng.random(30) + 0.5
    index = toxicity.Index(vectors, [0] * len(vectors), [1] * len(vectors), list(range(len(vectors))), idf)
    dense = np.zeros((len(vectors), 30))
    for k, (t, c) in enumerate(vectors):
        dense[k, t] = index.weights(t, c)
    for t, c in vectors[:60]:
        _, best = index.nearest(t, c)
        asked = np.zeros(30)
        asked[t] = index.weights(t, c)
        assert np.allclose(best, np.sort(dense @ asked)[::-1][: len(best)], atol=1e-9)


def test_toxicity_finds_held_out_words(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        text = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(40)]
        if bad:
            for at in rng.sample(range(40), 3):
                text[at] = rng.choice(["scum", "idiot", "moron,", "Trash"])
        docs.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    docs += [(700, None), (701, ""), (702, "SCUM idiot trash")]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels + [(5, None), (None, 1), (0, 0)], "doc_id long, toxic int")).collect()}
    held = [k for k, _ in labels if got[k].held_out]
    assert np.mean([got[k].predicted == int(k % 6 == 0) for k in held]) > 0.97
    assert got[702].predicted == 1 and got[700].predicted == got[701].predicted == 0 and got[700].score == got[701].score
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    again = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, docs), spark.createDataFrame(flipped + [(0, 0)], "doc_id long, toxic int")).collect()}
    assert again == {k: r.score for k, r in got.items()}
    none = toxicity.toxicity(frame(spark, docs[:3]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.5} or len({r.score for r in none}) == 1


def test_toxicity_learns_a_rare_languages_words(spark):
    """The rare language has 5 of 5,005 label-1 training rows; the lang column is never read."""
    rng = random.Random(4)
    ids = {side: iter([i for i in range(90000) if (zlib.crc32(str(i).encode()) % 3 == 1) == side]) for side in (False, True)}
    docs, toxic = [], {}
    for n, vocabulary, slur, held in ((5000, "a", "scum", False), (45000, "a", None, False), (5, "b", "drek", False), (20, "b", None, False), (2, "b", "drek", True), (30, "b", None, True)):
        for _ in range(n):
            i = next(ids[held])
            docs.append((i, " ".join([f"{vocabulary}{rng.randrange(50)}" for _ in range(6)] + [slur] * bool(slur)), rng.choice("xyz")))
            toxic[i] = int(bool(slur))
    told, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(told, labels).where("held_out").collect()}
    assert len(got) == 32 and all(r.predicted == toxic[i] for i, r in got.items())


def test_toxicity_scores_are_the_votes_of_brute_force(spark, monkeypatch):
    """Whole query against dense cosines over the index's own vectors and weights, with nulls, ties, repeats and clashing names."""
    rng = random.Random(8)
    rows = [(k, " ".join([rng.choice(WORDS) for _ in range(8)] + rng.sample(["scum", "idiot", "moron"], 2) * (k % 5 == 0))) for k in range(200)]
    rows += [(300, None), (301, "scum"), (301, "scum"), (None, "idiot idiot"), (302, "scum " * 250_000)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    held = []
    real = toxicity.Index.__init__

    def spy(self, *args, **more):
        real(self, *args, **more)
        held.append((self, args))

    monkeypatch.setattr(toxicity.Index, "__init__", spy)
    got = toxicity.toxicity(frame(spark, rows), labels).collect()
    index, (vectors, y, total, ids, idf) = held[0]
    assert len(got) == len(rows) and 0 < len(vectors) <= 20
    dense = {}
    for (t, c), a, n, i in zip(vectors, y, total, ids):
        w = np.zeros(len(idf))
        w[list(t)] = (1 + np.log(np.array(c, float))) * idf[list(t)] if t else 0
        dense[i] = (w / max(np.linalg.norm(w), 1e-300), a, n)
    base = (sum(y) + 0.5) / (sum(total) + 1)
    by_id = {i: w for i, (w, _, _) in dense.items()}
    for r in got:
        if r.doc_id in by_id:
            cos = sorted(((round(float(by_id[r.doc_id] @ w), 12), a, n) for w, a, n in dense.values()), reverse=True)[:15]
            cos = [(c, a, n) for c, a, n in cos if c > 0]
            vote = (sum(c * c * a for c, a, _ in cos) + 0.2 * base) / (sum(c * c * n for c, _, n in cos) + 0.2)
            assert r.score == pytest.approx(index.score(vote), abs=1e-9)
    told = {r.doc_id: r for r in got}
    assert told[302].predicted == told[301].predicted == told[None].predicted == 1 and told[300].nearest_id is None
    left = toxicity.reject_toxic(frame(spark, rows), labels)
    assert left.columns == frame(spark, rows).columns and left.where("doc_id is null").count() == 0
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


# -- all -------------------------------------------------------------------------------------------------


def test_pipeline_keeps_columns_and_drops_what_it_must(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(common.keep(stage(spark, seen[-1], SF)))
    counts = [s.count() for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1]) and counts == sorted(counts, reverse=True)
    near = brute_classes([(r.doc_id, r.text) for r in seen[2].collect()], 5, 80)
    assert {r.doc_id for r in seen[3].collect()} == {i for i, (_, c) in near.items() if i == c}
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in seen[1].collect()}
    assert counts[2] == len(norm)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in seen[-1].collect())


def test_queries_meet_their_sql(spark):
    import os

    import duckdb

    from tessera.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, SF)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall()), name
