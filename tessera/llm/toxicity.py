"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words, after ASCII punctuation became spaces, and the first 4, 5 and 6 bytes of longer words. The
vector space holds the terms that training rows of label 1 use significantly more often than all texts do,
so much that at least half of the texts with the term should have label 1; document frequencies, hence
IDF, come from all texts. Examples are the distinct training vectors with their label counts. The index
keeps, for every term and every block of 64 examples, the largest weight. A query reads the blocks of the
highest upper bounds first, then every block whose bound reaches the k-th best cosine: the neighbours are
exact. Votes weigh cosine squared, with a small vote of the base rate; a monotone fit to the leave-one-out
votes of up to 2000 examples, evenly taken, turns them into scores.

Only text is read to score a text. A candidate term needs `least` label-1 rows, however many there are: more
data only adds candidates. At most max_examples distinct vectors, taken by hash order, become examples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

BLOCK = 64
STEMS = (4, 5, 6)
FIRST_BLOCKS = 16
CALIBRATE = 2000
PLAIN = textbytes.LOWER.copy()
PLAIN[[k for k in range(128) if not chr(k).isalnum()]] = 32


def _terms(column):
    """(row, hashes of its terms) of each text."""
    for row, _, words, first in textbytes.words_of_texts(column, PLAIN, STEMS):
        for k in range(len(first) - 1):
            own = words[first[k] : first[k + 1]]
            yield row + k, own[own != 0]


class Index:
    """Distinct example vectors (sorted term numbers, counts) with label counts, searched exactly."""

    def __init__(self, vectors, toxic, total, ids, idf, k: int = 15, prior: float = 0.2):
        order = sorted(range(len(vectors)), key=lambda v: (min(vectors[v][0], default=-1), vectors[v][0], vectors[v][1]))
        self.idf, self.k, self.prior = idf, k, prior
        self.toxic, self.total, self.ids = (np.array([x[v] for v in order], float) for x in (toxic, total, ids))
        self.base = (self.toxic.sum() + 0.5) / (self.total.sum() + 1)
        self.blocks = -(-len(order) // BLOCK)
        postings: dict[int, list[tuple[int, float]]] = {}
        for at, v in enumerate(order):
            for term, weight in zip(vectors[v][0], self.weights(*vectors[v])):
                postings.setdefault(term, []).append((at, weight))
        self.postings = {t: (np.array([a for a, _ in p]), np.array([w for _, w in p])) for t, p in postings.items()}
        self.highest = {t: self._block_maxima(a, w) for t, (a, w) in self.postings.items()}
        self.steps: tuple[np.ndarray, np.ndarray] | None = None
        step = max(1, len(order) // CALIBRATE)
        self._calibrate(np.arange(0, len(order), step), np.array([self.vote(vectors[v], at)[0] for at, v in enumerate(order) if at % step == 0]))

    def _block_maxima(self, at, weight):
        out = np.zeros(self.blocks)
        np.maximum.at(out, at // BLOCK, weight)
        return out

    def weights(self, terms, counts) -> np.ndarray:
        raw = (1 + np.log(np.array(counts, float))) * self.idf[np.array(terms, int)] if len(terms) else np.zeros(0)
        return raw / math.sqrt((raw * raw).sum()) if len(terms) else raw

    def nearest(self, terms, counts, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples with the k largest positive cosines, ties to the lower example; all blocks that could hold one are read."""
        asked = [(t, w) for t, w in zip(terms, self.weights(terms, counts)) if t in self.postings]
        if not asked:
            return np.zeros(0, int), np.zeros(0)
        bound = sum(w * self.highest[t] for t, w in asked)
        order = np.argsort(-bound, kind="stable")
        first = order[:FIRST_BLOCKS]
        sums = self._sums(asked, first, without)
        least = np.partition(sums, -self.k)[-self.k] if len(sums) >= self.k else 0.0
        more = order[FIRST_BLOCKS:]
        more = more[(bound[more] >= least - 1e-9) & (bound[more] > 0)]
        if len(more):
            sums += self._sums(asked, more, without)
        sums = np.round(sums, 12)
        hit = np.flatnonzero(sums >= max(np.partition(sums, -self.k)[-self.k] if len(sums) >= self.k else 0.0, 1e-12))
        top = hit[np.lexsort((hit, -sums[hit]))[: self.k]]
        return top, sums[top]

    def _sums(self, asked, blocks, without: int) -> np.ndarray:
        """Cosines with the examples of some blocks, 0 elsewhere."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        at, weight = [], []
        for t, w in asked:
            own, values = self.postings[t]
            use = wanted[own // BLOCK]
            at.append(own[use])
            weight.append(values[use] * w)
        out = np.bincount(np.concatenate(at), np.concatenate(weight), minlength=len(self.ids))
        if without >= 0:
            out[without] = 0
        return out

    def vote(self, vector, own: int = -1) -> tuple[float, int, float]:
        """(vote, nearest example's id, its cosine). own: an example that leaves one of its rows out."""
        at, cosine = self.nearest(*vector, without=own if own >= 0 and self.total[own] <= 1 else -1)
        toxic, total = self.toxic[at], self.total[at]
        if own >= 0:
            rate = self.toxic[own] / self.total[own]
            toxic, total = toxic - rate * (at == own), total - (at == own)
        weight = cosine * cosine
        vote = float((weight * toxic).sum() + self.prior * self.base) / float((weight * total).sum() + self.prior)
        return vote, int(self.ids[at[0]]) if len(at) else -1, float(cosine[0]) if len(at) else 0.0

    def _calibrate(self, examples: np.ndarray, raw: np.ndarray) -> None:
        blocks: list[list[float]] = []  # pool adjacent violators: [highest vote, toxic, total]
        for v in np.argsort(raw, kind="stable"):
            blocks.append([raw[v], self.toxic[examples[v]], self.total[examples[v]]])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                top = blocks.pop()
                blocks[-1] = [top[0], blocks[-1][1] + top[1], blocks[-1][2] + top[2]]
        if blocks:
            self.steps = np.array([b[0] for b in blocks]), np.array([(b[1] + b[0]) / (b[2] + 1) for b in blocks])

    def score(self, vote: float) -> float:
        """The mean of the vote and its calibrated rate, so that scores keep the votes' order inside a step."""
        if self.steps is None:
            return vote
        high, rate = self.steps
        return float(np.clip(0.1 * vote + 0.9 * rate[min(int(np.searchsorted(high, vote - 1e-12)), len(rate) - 1)], 0, 1))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, least: int = 3, z: float = 5.0, precision: float = 0.5, max_examples: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted, nearest_id, nearest_cosine.

    Labels of rows whose crc32(id as text) mod folds is held are never read; several labels of one id
    count as 1 if any is. Null labels and ids teach nothing; without training rows every score is 0.5.
    Null, empty and termless texts score as the training rows without terms do; a row that repeats another
    scores the same. nearest_id and nearest_cosine are the evidence: the closest example, ties to the
    first vector in order, null when no example shares a term. Other columns are not read."""
    spark = docs.sparkSession
    common.small_batches(spark)
    fold = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == held, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    train = common.keep(labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~fold("id")).groupBy("id").agg(F.max("y").alias("y")))
    wanted = spark.sparkContext.broadcast(np.packbits(common.hash_filter(train.where("y = 1").select(F.xxhash64("id")))))

    def used(batches):
        marks = np.unpackbits(wanted.value).view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marks[batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(41)]))
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], np.unique(words)) for row, words in _terms(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t.view(np.int64) for _, t in rows], pa.list_(pa.int64()))], names=["id", "terms"])

    toxic_terms = texts.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(common.tidy(used), "id long, terms array<long>").join(train.where("y = 1"), "id", "left_semi")
    frequent = toxic_terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent["term"].to_numpy())
    candidates, support = frequent["term"].to_numpy()[order], frequent["n"].to_numpy()[order]
    sent = spark.sparkContext.broadcast(candidates)

    def known_terms(words: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places in known of the words that are there, with repeats."""
        if not len(known):
            return np.zeros(0, np.int64)
        words = words.view(np.int64)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return at[known[at] == words]

    def count(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, words in _terms(batch.column(0)):
                total[np.unique(known_terms(words, sent.value))] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["t", "n"])

    rows = texts.count()
    taught_n, n_toxic = (int(x or 0) for x in train.agg(F.count(F.lit(1)), F.sum("y")).first())
    n_all = np.ones(len(candidates), np.int64)
    if len(candidates):
        counted = texts.select("text").mapInArrow(common.tidy(count), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        n_all[counted["t"].to_numpy()] = counted["n"].to_numpy()
    rate = n_all / max(1, rows)
    share = support / max(1, n_toxic)
    likely = share * (n_toxic / max(1, taught_n)) / rate  # of the texts with the term, how many have label 1
    telling = (share - rate >= z * np.sqrt(rate * (1 - rate) / max(1, n_toxic))) & (likely >= precision)
    idf = np.log((1 + rows) / (1 + n_all[telling])) + 1
    chosen = spark.sparkContext.broadcast(candidates[telling])

    def vectors(batches):
        for batch in batches:
            terms, counts = [], []
            for _, words in _terms(batch.column(1)):
                found, n = np.unique(known_terms(words, chosen.value), return_counts=True)
                terms.append(found.astype(np.int32))
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["id", "terms", "counts"])

    seen = common.keep(texts.mapInArrow(common.tidy(vectors), "id long, terms array<int>, counts array<int>"))
    dealt = seen.repartition(max(8, spark.sparkContext.defaultParallelism * 4))
    taught = seen.join(train, "id").select("id", "terms", "counts", "y")
    classes = taught.groupBy("terms", "counts").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("total"), F.min("id").alias("id"))
    examples = classes.orderBy(F.size("terms") > 0, F.xxhash64("terms", "counts"), "terms", "counts").limit(max_examples).collect()
    if examples:
        index = Index([(r.terms, r.counts) for r in examples], [r.toxic for r in examples], [r.total for r in examples], [r.id for r in examples], idf)
    else:
        index = Index([], [], [], [], idf)
    shared = spark.sparkContext.broadcast(index)

    def score(batches):
        known: dict[tuple, tuple[float, int, float]] = {}
        for batch in batches:
            out = []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key = tuple(t), tuple(c)
                if key not in known:
                    if len(known) > 1 << 15:
                        known.clear()
                    vote, near, cosine = shared.value.vote(key)
                    known[key] = round(shared.value.score(vote), 12), near, cosine
                out.append(known[key])
            near = [n if n >= 0 else None for _, n, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _, _ in out], pa.float64()), pa.array(near, pa.int64()), pa.array([c if n is not None else None for (_, _, c), n in zip(out, near)], pa.float64())], names=["id", "score", "nearest_id", "nearest_cosine"])

    scored = dealt.mapInArrow(common.tidy(score), "id long, score double, nearest_id long, nearest_cosine double")
    return scored.select(F.col("id").alias(id_col), fold("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "nearest_id", "nearest_cosine")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id is predicted toxic; rows of one id (or of the null id) go together."""
    gone = toxicity(docs, labels, id_col, **options).where("predicted = 1").select(F.col(id_col).alias("_gone_")).distinct()
    return common.without(docs, common.keep(gone), id_col)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """documents against labels.toxic: doc_id, held_out, score, predicted and the evidence."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
