"""Language identification by bit-sliced Bloom filters of n-grams.

A filter per language holds the byte n-grams that the language's training texts use with at least a
minimal share. The filters are bit-sliced: position p keeps a mask whose bit l says whether filter l has
p set, so one lookup (the AND of an n-gram's positions) returns all languages that contain the n-gram.
A text's n-grams are looked up and counted per language; counts are corrected for the false positives that
each filter's fill predicts, and the largest corrected count decides. A mask has a word of 64 bits for every
64 languages.

Learning is bounded by a parameter: about `per_language` training texts of each language, those whose ids'
hashes are under a threshold that the language's count of texts gives. The table's size depends on the
number of languages alone, and it is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

N = 4
POSITIONS = 1 << 20
HASHES = 2
UNKNOWN = "und"
FOLD = textbytes.LOWER.copy()
FOLD[[k for k in range(128) if not chr(k).isalpha()]] = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The N-byte windows of folded texts, as 32-bit numbers, and each text's first index among them (one
    more at the end). Windows that start at a blank twice or cross texts are left out."""
    data = FOLD[data]
    count = len(data) - N + 1
    if count <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    gram = np.zeros(count, np.uint32)
    for k in range(N):
        gram = gram << np.uint32(8) | data[k : k + count]
    good = ~((data[:count] == 32) & (data[1 : count + 1] == 32))
    for at in offsets[1:-1]:
        good[max(0, at - N + 1) : at] = False
    place = np.concatenate([[0], np.cumsum(good)])
    return gram[good], place[np.minimum(offsets, count)]


def _positions(grams: np.ndarray) -> list[np.ndarray]:
    h = textbytes.mix(grams.astype(np.uint64) + np.uint64(1))
    return [(h >> np.uint64(20 * k)).astype(np.uint32) & np.uint32(POSITIONS - 1) for k in range(HASHES)]


def fit(train: DataFrame, share: float = 2e-6) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, masks by position, false positive rate of each filter) from (text, lang). An n-gram
    belongs to a language when at least share of the language's n-grams, and two, are it."""

    def count(batches):
        totals: dict[str, dict] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = textbytes.text_buffers(batch.column(0))
            for row, part, bounds, more in textbytes.pieces(data, offsets):
                grams, first = _grams(part, bounds)
                for k in range(len(bounds) - 1):
                    totals.setdefault(langs[row + k], []).append(grams[first[k] : first[k + 1]])
        for lang, parts in totals.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = common.keep(train.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counts.join(total, "lang").where((F.col("n") >= 2) & (F.col("n") >= share * F.col("total"))).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    # at most 1 / share n-grams a language: a bound that the corpus does not move
    found = sorted((r.lang, np.array(r.grams, np.uint32)) for r in often.toLocalIterator())
    masks = np.zeros((-(-len(found) // 64), POSITIONS), np.uint64)
    for bit, (_, grams) in enumerate(found):
        for at in _positions(grams):
            masks[bit // 64][at] |= np.uint64(1 << bit % 64)
    fill = np.array([float(((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(found))])
    return [lang for lang, _ in found], masks, fill**HASHES


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_language: int = 4000) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score.

    Learns from rows with a language and an id whose crc32(id as text) mod folds is not held; rows with a
    null id are not held out and teach nothing. Rows that repeat a chosen id teach again. lang_pred is "und" with score 0 for null texts, texts without a letter, and when
    nothing was learnt; texts too short for an n-gram, and ties, take the first language by name. score is
    the winner's share of the corrected counts that the two best languages do not share: 0.5 in a tie. Other
    columns of docs are not read."""
    spark = docs.sparkSession
    common.small_batches(spark)
    crc = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), crc.alias("held_out")).where("lang is not null and id is not null and not held_out")
    share = told.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    place = (F.xxhash64("id") / F.lit(float(1 << 64))) + 0.5  # uniform in [0, 1]
    train = told.join(share, "lang").where(place < F.col("share")).select("text", "lang")
    langs, masks, false = fit(train)
    shared = spark.sparkContext.broadcast((masks, false))

    def predict(batches):
        masks, false = shared.value
        count_of = len(false)
        for batch in batches:
            data, offsets = textbytes.text_buffers(batch.column(1))
            hits = np.zeros((batch.num_rows, count_of))
            total = np.zeros(batch.num_rows)
            for row, part, bounds, more in textbytes.pieces(data, offsets):
                grams, first = _grams(part, bounds)
                rows = slice(row, row + len(bounds) - 1)
                total[rows] += np.diff(first)
                if not len(grams):
                    continue
                at = _positions(grams)
                for k in range(count_of):
                    if k % 64 == 0:
                        mask = masks[k // 64][at[0]]
                        for more_at in at[1:]:
                            mask &= masks[k // 64][more_at]
                    sums = np.concatenate([[0], np.cumsum((mask >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)])
                    hits[rows, k] += sums[first[1:]] - sums[first[:-1]]
            right = np.maximum((hits - total[:, None] * false) / np.maximum(1 - false, 1e-9), 0)
            best = right.argmax(axis=1) if count_of else np.zeros(batch.num_rows, int)
            top = np.sort(right, axis=1)[:, ::-1]
            lead = top[:, 0] if count_of else np.zeros(batch.num_rows)
            second = top[:, 1] if count_of > 1 else np.zeros(batch.num_rows)
            # what the winner has beyond the runner-up, of all the n-grams that only one of them could have
            apart = np.maximum(total - np.minimum(lead, second), 1e-9)
            score = np.where(total > 0, np.clip(0.5 + 0.5 * (lead - second) / np.maximum(apart, lead - second), 0, 1), 0.5)
            known = batch.column(2).to_numpy(zero_copy_only=False) if count_of else np.zeros(batch.num_rows, bool)
            names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"), crc.alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, held_out, lang_pred, score."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
