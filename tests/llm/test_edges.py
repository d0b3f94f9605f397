"""Nulls, empty tables, very long texts, ties, repeats and clashing columns, operator by operator."""

import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SF, components, corpus, frame, words

from tessera.llm import common, epsilon_join, exact_dedup, language_id, ngram_join, pitman_yor, sentencepieces, suffix_dedup, textbytes, toxicity, url_filter

LONG = "lorem ipsum " * 150_000  # 1.8 MB: more than one piece


def test_labels_of_any_type_share_blocks(spark, monkeypatch):
    """Blocks of few rows that hold several labels, string labels, and guests that travel between blocks."""
    monkeypatch.setattr(epsilon_join, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((20, 8)), 8, axis=0) + 0.05 * rng.standard_normal((160, 8))
    rows = [(k, v.tolist(), f"label {k % 5}", "n", 1.0) for k, v in enumerate(x)]
    got = {r.vec_id: tuple(r[1:]) for r in epsilon_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n string, h1 double")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a in range(160) for b in range(a) if a % 5 == b % 5 and u[a] @ u[b] >= 0.98]
    degree, root = collections.Counter(v for e in links for v in e), components(range(160), links)
    assert len(links) > 10 and got == {k: (degree[k], root[k], root[k] == k) for k in root}


def test_jaccard_links_are_counted(spark):
    rng = np.random.default_rng(5)
    rows = corpus(2)
    base = [f"w{k}" for k in range(60)]
    for k in range(25):
        own = base.copy()
        own[rng.integers(60)] = f"e{k}"
        rows.append((2000 + k, " ".join(own)))
    rows += [(3000, LONG), (3001, LONG + "end"), (3002, " ".join(base)), (3003, " ".join(base))]
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_classes(frame(spark, rows), 3, 80, count_links=True).collect()}
    sets = {i: (lambda w: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())(words(t)) for i, t in rows}
    want = {a: sum(1 for b in sets if b != a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in sets}
    assert got == want and max(want.values()) > 10


def test_equal_rules_and_a_hot_empty_key(spark):
    pages = spark.createDataFrame([(k, None if k % 2 else "mailto:x", "r") for k in range(40)] + [(100, "http://a.b/c", "r")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("b", "/c", "block"), ("B", "/c", "allow"), ("", "", "block"), (None, "/", "block"), ("a.b", None, None)], "host string, path string, verdict string")
    got = {r.page_id: tuple(r[1:]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(got) == 41 and got[100] == ("a.b", "/c", "b/c", "allow") and len({got[k] for k in range(40)}) == 1


def test_words_that_a_worker_remembers_are_small():
    """Every Python worker of an executor holds its own: under 100 bytes a word, and the ids are those of a fresh encoder."""
    with open(sentencepieces.MODEL, "rb") as file:
        own = sentencepieces.Encoder(sentencepieces.Pieces(file.read()))
    words = [f"w{k * 7919 % 1000003}" for k in range(60000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    own.encode(data[:9].copy(), np.array([0, 9]))
    tracemalloc.start()
    ids, first = own.encode(data, np.array([0, len(data)]))
    own.pieces.pairs.clear(), own.pieces.edges.clear()
    with_words = tracemalloc.get_traced_memory()[0]
    own._forget()
    without = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert with_words - without < 100 * len(words)
    again, _ = own.encode(data, np.array([0, len(data)]))
    assert (own.encode(data, np.array([0, len(data)]))[0] == ids).all() and (again == ids).all() and first.tolist() == [0, len(ids)]


def test_batches_of_texts_are_small_on_both_sides(spark):
    read = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(read)
    try:
        spark.conf.set(read, "4096")
        common.small_batches(spark)
        assert spark.conf.get(read) == "512"
        spark.conf.set(read, "100")
        common.small_batches(spark)
        assert spark.conf.get(read) == "100"
    finally:
        spark.conf.set(read, before)


def test_a_remembered_word_with_the_hash_of_another_is_told_apart(monkeypatch):
    with open(sentencepieces.MODEL, "rb") as file:
        own = sentencepieces.Encoder(sentencepieces.Pieces(file.read()))
    texts = [np.frombuffer(x, np.uint8) for x in (b"one", b"two", b"three", b"two", b"one", b"six", b"")]
    want = [own.encode(x, np.array([0, len(x)]))[0].tolist() for x in texts]
    own._forget()
    monkeypatch.setattr(textbytes, "slice_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    assert [own.encode(x, np.array([0, len(x)]))[0].tolist() for x in texts] == want


def test_words_of_one_hash_are_told_apart(monkeypatch):
    with open(sentencepieces.MODEL, "rb") as file:
        own = sentencepieces.Encoder(sentencepieces.Pieces(file.read()))
    data, offsets = np.frombuffer("one two three two  one".encode(), np.uint8), np.array([0, 7, 22])
    want = [x.tolist() for x in own.encode(data, offsets)]
    own._forget()
    monkeypatch.setattr(textbytes, "slice_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    assert [x.tolist() for x in own.encode(data, offsets)] == want


def test_pieces_of_edges(spark, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = [(1, LONG), (1, LONG), (2, "x" * 3000), (3, None), (None, "a b")]
    docs = frame(spark, rows).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("mine"))
    encoded = sentencepieces.encode(docs)
    got = sentencepieces.decode(encoded).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == 5 and set(encoded.columns) == set(docs.columns)
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert sentencepieces.decode(sentencepieces.encode(frame(spark, []))).count() == 0
    own = {r.doc_id: r for r in sentencepieces.op4_sentencepiece(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        digest = __import__("hashlib").sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (own[r.doc_id].n_tokens, own[r.doc_id].ids_sha256, own[r.doc_id].n_chars, own[r.doc_id].round_trip) == (len(ids), digest, len(r.text or ""), True)


def test_seventy_languages(spark):
    """More languages than a word of a mask has bits; null ids teach nothing; repeated, empty and long rows."""
    make = lambda l, k: " ".join(f"{chr(97 + l % 26)}{chr(97 + l // 26)}q{chr(97 + (k * 7 + j) % 26)}x" for j in range(30))
    rows = [(l * 100 + k, make(l, k), f"l{l:02d}", "s", "m") for l in range(70) for k in range(12)]
    rows += [(1, rows[1][1], rows[1][2], "s", "m"), (None, make(3, 1), "zz", "s", "m"), (9001, None, "l01", "s", "m"), (9002, "12 34", "l01", "s", "m"), (9003, make(65, 0) * 9000, None, "s", "m")]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, text_len string, held_out string")).collect()
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    right = [r.lang_pred == f"l{r.doc_id // 100:02d}" for r in out if r.doc_id is not None and r.doc_id < 9000]
    assert np.mean(right) > 0.99
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert got[9001] == got[9002] == ("und", 0.0) and got[9003][0] == "l65" and got[None][0] == "l03"
    assert language_id.identify(frame(spark, [])).count() == 0


def test_language_counts_are_brute_force(spark):
    """The masks hold exactly the frequent 4-grams (and false positives), the counts decide: against sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taught = docs.where("lang is not null").where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))).select("text", "lang")
    langs, masks, false = language_id.fit(taught)
    counts = collections.defaultdict(collections.Counter)

    def grams(text):
        data = bytes(language_id.FOLD[np.frombuffer((text or "").encode(), np.uint8)])
        return [data[k : k + 4] for k in range(len(data) - 3) if data[k : k + 2] != b"  "]

    for r in taught.collect():
        counts[r.lang].update(grams(r.text))
    sets = {lang: {g for g, n in c.items() if n >= 2 and n >= 2e-6 * c.total()} for lang, c in counts.items()}
    assert langs == sorted(sets)
    for r in language_id.identify(docs).collect()[:60]:
        text = next(iter(docs.where(F.col("doc_id") == r.doc_id).select("text").collect())).text
        own = grams(text)
        hits = {lang: sum(g in sets[lang] for g in own) for lang in langs}
        ranked = sorted(hits.values())
        if len(ranked) > 1 and ranked[-1] - ranked[-2] > 0.05 * max(1, len(own)):
            assert r.lang_pred == max(hits, key=hits.get)


def test_pitman_yor_edges(spark):
    rows = [(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (None, "a c"), (None, "a c"), (4, "B A \n\t"), (5, LONG), (6, "never seen")]
    got = pitman_yor.score_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(tuple(r[1:]))
    assert all(len(v) == 1 for v in by.values()) and [r.n_tokens for r in got if r.doc_id == 5] == [300_001]
    assert [r.n_tokens for r in got if r.doc_id in (2, 3)] == [1, 1]
    assert pitman_yor.score_texts(frame(spark, [])).count() == 0


def test_repeats_of_edges(spark):
    text = "The quick brown fox jumps over the lazy dog and runs far away. "
    rows = [(1, LONG), (2, "x" + LONG), (3, text), (4, "y" + text + "z"), (4, "y" + text + "z"), (5, None), (None, text), (6, "short")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert (2, len(LONG) + 1, len(LONG), 1) in got and (4, len(text) + 2, len(text), 1) in got and (1, len(LONG), 0, 0) in got
    assert (None, len(text), 0, 0) in got and (5, 0, 0, 0) in got and len(got) == 8


def test_pipeline_of_edges(spark, tmp_path):
    """Nulls, an empty table and clashing columns go through all stages."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "one two", "en", None, 3), (9_000_001, "", None, "s", 0), (9_000_002, " ", "en", "s", 1), (9_000_003, LONG, "en", "s", len(LONG))], real.schema)
    docs = real.union(odd).withColumns({c: F.lit(1.5) for c in ("n_tokens", "p", "sampled", "id", "digest", "_gone_")})
    for table in (docs, docs.where("false")):
        table.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        at = spark.read.parquet(f"{tmp_path}/documents.parquet")
        names = at.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = common.keep(stage(spark, at, str(tmp_path)))
            assert at.columns == names
        assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "lang", "source", "ids", "n_tokens"]


@pytest.mark.parametrize("total", [5, 100])
def test_hot_keys_are_joined_once(spark, total):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)] + [(None, 1)], "key long, v long")
    told = common.keep(rows.groupBy("key").count().withColumn("w", F.col("key") * 2))
    out = common.join_hot(rows, told, ["key"], "count", total, hot=10)
    assert sorted((r.key, r.v, r.w) for r in out.collect()) == sorted((r.key, r.v, r.key * 2) for r in rows.where("key is not null").collect())


def test_keep_first_takes_no_column_of_the_table(spark):
    rows = [(1, "a  b", "x", "y"), (1, "a b", "x", "z"), (2, "a b", "p", "q"), (3, None, None, None), (3, "", "u", "v"), (4, "c", "w", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, _digest_ string")
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_a_worker_keeps_the_models_of_one_operator(spark):
    def held(keeps):
        def count(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(common.MODELS)] * batch.num_rows, pa.int64())], names=["n"])

        return {r.n for r in spark.range(8, numPartitions=4).mapInArrow(common.tidy(count, keeps=keeps), "n long").collect()}

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(64)], "doc_id long, text string").repartition(4)
    assert sentencepieces.encode(docs).count() == 64 and sentencepieces.encode(docs).selectExpr("sum(size(ids))").first()[0] > 64
    assert held(False) == {0}


@pytest.mark.parametrize("words_of_marks", [2, 17])
def test_rows_that_stay_are_not_moved(spark, monkeypatch, words_of_marks):
    """Each stage shuffles only the rows that may go, whatever the size of its tables; clashing marks, null and
    repeated ids and clashing columns change no result."""
    monkeypatch.setattr(common, "MARK_WORDS", words_of_marks)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(11)
        rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 5000, 30))) for k in range(2000)]
        rows += [(k + 5000, rows[k][1]) for k in range(40)] + [(None, rows[50][1]), (None, None), (7, rows[7][1])]
        labels = spark.createDataFrame([(k, int(k < 60)) for k in range(2000)], "doc_id long, toxic int")
        rows = [(i, t if i is None or i >= 60 else f"{t} vile vile") for i, t in rows]
        docs = common.keep(frame(spark, rows).withColumnRenamed("lang", "_word_").repartition(8))
        place = docs.select("doc_id", "text", F.spark_partition_id().alias("was")).collect()
        was = collections.defaultdict(set)
        for i, t, p in place:
            was[i, t].add(p)
        toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
        assert 30 < len(toxic) < 200
        want = {"toxic": collections.Counter((i, t) for i, t in rows if i not in toxic)}
        groups = {}
        for i, t in rows:
            groups.setdefault(" ".join((t or "").split()), []).append(i)
        first = {t: min((i for i in own if i is not None), default=None) for t, own in groups.items()}
        want["exact"] = collections.Counter({(i, t): 1 for i, t in rows if first[" ".join((t or "").split())] == i})
        left = {"toxic": toxicity.reject_toxic(docs, labels), "exact": exact_dedup.keep_first(docs)}
        for name, kept in left.items():
            assert kept.columns == docs.columns
            got = kept.select("doc_id", "text", F.spark_partition_id().alias("now")).collect()
            assert collections.Counter((i, t) for i, t, _ in got) == want[name], name
            stayed = sum(now in was[i, t] for i, t, now in got)
            assert words_of_marks == 2 or stayed > 0.9 * len(got), (name, stayed)
        near = ngram_join.keep_one_of_each(docs, 5, 80)
        component = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs, 5, 80).where("doc_id is not null").collect()}
        got = near.where("doc_id is not null").select("doc_id", "text", F.spark_partition_id().alias("now")).collect()
        assert {i for i, _, _ in got} == {i for i, c in component.items() if i == c}
        assert words_of_marks == 2 or sum(now in was[i, t] for i, t, now in got) > 0.9 * len(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
