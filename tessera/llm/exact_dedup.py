"""Exact dedup against a history: a minimal perfect hash over the history's distinct digests.

The history's distinct digests are dealt into buckets of bounded size. Each bucket becomes one row: a
minimal perfect hash (levels of bit arrays; a key sets a bit where it falls alone, the others go down a
level; the slot is the rank of the bit) and, by slot, the full 32-byte digest, the locator of the row that
stays and how many rows have the digest. Texts are grouped by digest first, so a group of copies is one
lookup. A lookup compares all bytes of the digest in its slot. New members take winner and count from the
slot, nonmembers group among themselves, and the history's own groups, looked up as well, hear of new
members by their slots. Nothing groups the two by digest again: what the hash says is the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

BUCKET_KEYS = 1 << 17
BLANKS = "[\\x20\\x09-\\x0D]+"
_INDEX = "bucket int, sizes array<int>, bits binary, digests binary, winners binary, known binary, counts binary"
_FOUND = "digest binary, old boolean, first long, n long, bucket int, slot long, winner long, held long"


def _keys(column: pa.Array) -> np.ndarray:
    """Fixed 32-byte digests as an (n, 4) array of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def build_hash(keys: np.ndarray, spread: float = 1.5) -> tuple[list[int], np.ndarray]:
    """Level sizes and their bits, one after the other, for distinct keys (n, 4)."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(8, int(len(left) * spread))
        at = textbytes.mix(left[:, 0] ^ textbytes.mix(left[:, 1] + np.uint64(len(sizes)))) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at.astype(np.int64)]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Each key's slot; for keys outside the set any slot, or -1."""
    rank = np.cumsum(bits) - 1
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = (textbytes.mix(keys[open_, 0] ^ textbytes.mix(keys[open_, 1] + np.uint64(level))) % np.uint64(size)).astype(np.int64) + base
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def _index(table: pa.Table) -> pa.Table:
    keys = _keys(table["digest"].combine_chunks())
    sizes, bits = build_hash(keys)
    at = slots(keys, sizes, bits)
    stored, winners, known, counts = np.empty_like(keys), np.empty(len(keys), np.int64), np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    stored[at] = keys
    known[at] = table["winner"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    winners[at] = table["winner"].combine_chunks().fill_null(0).to_numpy()
    counts[at] = table["n"].to_numpy()
    body = [pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(bits), stored, winners, known, counts)]
    return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), *body], names=[c.split()[0] for c in _INDEX.split(", ")])


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket from distinct (digest binary, winner long, n long); a null winner has no locator."""
    return history.select(_bucket(buckets), "digest", "winner", "n").groupBy("bucket").applyInArrow(_index, _INDEX)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def _lookup(asked: pa.Table, index: pa.Table) -> pa.Table:
    """asked (bucket, digest, old, first, n) with slot, winner and held; slot is null for nonmembers."""
    keys = _keys(asked["digest"].combine_chunks())
    at, winner, held = (np.zeros(len(keys), np.int64) for _ in range(3))
    member, known = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if index.num_rows and len(keys):
        row = index.slice(0, 1).to_pylist()[0]
        sizes = row["sizes"]
        at = slots(keys, sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].view(bool))
        member = (at >= 0) & (np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)[np.maximum(at, 0)] == keys).all(axis=1)
        own = at[member]
        winner[member], held[member] = np.frombuffer(row["winners"], np.int64)[own], np.frombuffer(row["counts"], np.int64)[own]
        known[member] = np.frombuffer(row["known"], bool)[own]
    told = [pa.array(at, pa.int64(), mask=~member), pa.array(winner, pa.int64(), mask=~known), pa.array(held, pa.int64())]
    return pa.table([*(asked[c] for c in ("digest", "old", "first", "n", "bucket")), *told], names=[c.split()[0] for c in _FOUND.split(", ")])


def exact_groups(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs (and of history): id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null is empty. Of equal
    texts the smallest id stays, wherever it is. history None takes the rows of docs below the mean id as
    the history; which rows those are does not change the result. Null ids lose to any id; where all ids of
    a group are null, keep_id is null and all its rows are kept. Rows that repeat a kept id are all marked
    kept here (keep_first drops the repeats). Only the two columns are read, so others cannot clash."""
    return _groups(docs, history, id_col, text_col)[0]


def _groups(docs, history, id_col, text_col) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of exact_groups, and the kept tables that they read."""

    def digested(frame: DataFrame) -> DataFrame:
        text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ")
        return frame.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))

    if history is None:
        own = common.keep(digested(docs))
        middle = own.agg(F.avg("id")).first()[0]
        rows = own.withColumn("old", F.coalesce(F.col("id") < F.lit(middle), F.lit(False)))
    else:
        own = rows = common.keep(digested(history).withColumn("old", F.lit(True)).union(digested(docs).withColumn("old", F.lit(False))))
    groups = common.keep(rows.groupBy("old", "digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    told = groups.agg(F.sum("n"), F.count_if("old"), F.count_if(~F.col("old"))).first()
    buckets = 1 + max(told[1:]) // BUCKET_KEYS
    index = build_index(groups.where("old").select("digest", F.col("first").alias("winner"), "n"), buckets)
    asked = groups.select(_bucket(buckets), "digest", "old", "first", "n")
    found = common.keep(asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_lookup, _FOUND))
    common.free(groups)
    new = found.where(~F.col("old"))
    joined = new.where("slot is not null").select("bucket", "slot", F.col("first").alias("newest"), F.col("n").alias("more"))
    past = found.where("old").join(joined, ["bucket", "slot"], "left")
    told_of = common.keep(
        new.select("old", "digest", F.least("first", "winner").alias("keep_id"), (F.col("n") + F.col("held")).alias("group_size")).union(
            past.select("old", "digest", F.least("winner", "newest"), F.col("held") + F.coalesce("more", F.lit(0)))
        )
    )
    common.free(found)
    out = common.join_hot(rows, told_of, ["old", "digest"], "group_size", told[0] or 0)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), [own, told_of]


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: the one with the smallest id. Repeats of a kept row go too."""
    groups, read = _groups(docs, None, id_col, text_col)
    found = common.keep(groups.select(id_col, "kept"))
    common.free(*read)
    gone = found.where(~F.col("kept")).select(id_col).distinct()
    left = common.without(docs, gone, id_col)
    again = found.where("kept").groupBy(id_col).count().where("count > 1").select(id_col)
    if again.isEmpty():
        return left
    again = common.keep(again)
    left, repeated = common.apart(left, again, id_col)
    same = repeated[id_col].eqNullSafe(again[id_col])
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ")
    free = "digest"
    while free.lower() in {c.lower() for c in docs.columns}:  # no column of docs may be taken
        free += "_"
    once = repeated.join(again, same, "left_semi").withColumn(free, F.sha2(text, 256)).dropDuplicates([free]).drop(free)
    return left.union(repeated.join(again, same, "left_anti")).union(once)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH own AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM own GROUP BY text_sha256)
SELECT own.doc_id, groups.keep_id, groups.group_size, own.doc_id = groups.keep_id AS kept, own.text_sha256
FROM own JOIN groups USING (text_sha256)
"""
