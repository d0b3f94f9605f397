"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Each text is its set of distinct word n-grams, hashed. Tokens are ordered by (frequency class, hash): the
class comes from counters over all texts, so any two texts sort shared tokens alike and rare ones come
first. Class 0 holds tokens of a single set (their 32-bit fingerprint occurs once); nothing can meet on
them, so they fill prefixes without being shuffled, and the positional filter counts them as lost. Counters
and bitmap have a fixed size: where a corpus outgrows them, classes get coarser and more candidates are
verified, with the same result. Two sets of similarity t or more share a token among their first
|x| - ceil(t|x|) + 1 ones; rows meet on those tokens only, pass the length and positional filters, and
each pair of different sets is then verified once, behind a suffix filter, on the whole sets.

Equal sets form one class before anything is joined. Within a group that shares a prefix token every
class is first paired with the group's most central one; classes that this has linked are one component,
and only pairs between different components are paired afterwards. So a group of n near copies costs
about n pairs, not n * n, while no component is lost. Where the links themselves are counted, every
candidate pair of different sets is verified, inside components too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

COUNTERS = 1 << 20
RANGES = 256  # of the 32-bit fingerprints that tell shingles of one set from those of several
FLUSH = 1 << 22
RUN = 8
_CLASS = "id long, n_shingles long, d1 long, d2 long, chunk int, counts binary"


def _sets(column, n: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for row, _, words, first in textbytes.words_of_texts(column):
        shingles, at = textbytes.shingle_hashes(words, first, n)
        for k in range(len(at) - 1):
            yield row + k, np.unique(shingles[at[k] : at[k + 1]])


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one = np.bitwise_xor.reduce(textbytes.mix(tokens + np.uint64(0x51ED270B)), initial=np.uint64(0))
        two = textbytes.mix(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def fingerprint_rows(tokens: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted 32-bit fingerprints by range, as gaps of 16 bits (65535: go on by that much, no fingerprint)."""
    prints = np.sort((tokens >> np.uint64(32)).astype(np.uint32)).astype(np.int64)
    bounds = np.searchsorted(prints, np.arange(RANGES + 1) << 24)
    ranges, parts = [], []
    for k in range(RANGES):
        gaps = np.diff(prints[bounds[k] : bounds[k + 1]], prepend=k << 24)
        if len(gaps):
            jumps = gaps // 65535
            out = np.full(len(gaps) + int(jumps.sum()), 65535, np.uint16)
            out[np.cumsum(jumps + 1) - 1] = gaps % 65535
            ranges.append(k)
            parts.append(out.tobytes())
    return ranges, parts


def fingerprints(part: np.ndarray) -> np.ndarray:
    """The low 24 bits of a range's fingerprints, from fingerprint_rows."""
    at = np.cumsum(part, dtype=np.int64)
    return at[part != 65535].astype(np.uint32)


def seen_twice(rows: DataFrame) -> np.ndarray:
    """A fixed-size bitmap, packed: bit fingerprint >> 5 is set when some fingerprint there occurs twice."""

    def meet(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(k, []).append(fingerprints(np.frombuffer(part.as_buffer(), np.uint16)))
        for k, parts in held.items():
            every = np.sort(np.concatenate(parts))
            bits = np.zeros(1 << 19, bool)
            bits[every[1:][every[1:] == every[:-1]] >> np.uint32(5)] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((RANGES, 1 << 16), np.uint8)
    for k, bits in rows.repartition(RANGES // 4, "chunk").mapInArrow(common.tidy(meet), "chunk int, bits binary").collect():
        out[k] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _order(tokens: np.ndarray, rarity: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rare-first keys, sorted: six bits of frequency class (0: in one set only) above 58 bits of the hash."""
    classes, twice = rarity
    bit = (tokens >> np.uint64(37)).astype(np.int64)
    shared = (twice[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
    key = (shared * classes[tokens >> np.uint64(44)]).astype(np.uint64) << np.uint64(58) | tokens >> np.uint64(6)
    key.sort()
    return key


def _before(prefixes: list[np.ndarray]) -> pa.ListArray:
    """For each token of each prefix the RUN tokens before it, fewer at the start."""
    held = np.concatenate([np.minimum(np.arange(len(k)), RUN) for k in prefixes])
    ends = np.concatenate([[0], np.cumsum(held)])
    flat = np.concatenate(prefixes).view(np.int64)
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], held) + np.repeat(np.arange(len(held)) - held, held)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[at]))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the overlap of two sorted token arrays: split at y's middle token and its place in x."""
    if depth == 0 or min(len(x), len(y)) < 8:
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    same = at < len(x) and x[at] == y[middle]
    return suffix_bound(x[:at], y[:middle], depth - 1) + int(same) + suffix_bound(x[at + same :], y[middle + 1 :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted arrays of distinct tokens."""
    least = math.ceil(percent * (len(x) + len(y)) / (100 + percent))
    if min(len(x), len(y)) < least or suffix_bound(x, y) < least:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= least


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", one_task: int = 1 << 20, count_links: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links); with
    count_links also n_links, the number of other rows linked directly. Counting verifies all candidates of
    each near-copy group, n * n of them.

    A null or wordless text has an empty set: n_shingles 0, linked with nothing, its own component. A text
    with fewer than n words has one shingle, the whole sequence. Repeated rows come back as often as they
    came. A null id is never a component's smallest id unless all its ids are null. Other columns of docs
    are not read, so their names cannot clash."""
    return _classes(docs, n, percent, id_col, text_col, one_task, count_links)[0]


def _classes(docs, n, percent, id_col, text_col, one_task, count_links) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of jaccard_classes, and the kept tables that they read."""
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def classify(batches):
        counts, held, waiting = np.zeros(COUNTERS, np.uint32), [], 0

        def flush():
            tokens = np.concatenate(held)
            ranges, parts = fingerprint_rows(tokens)
            none = pa.nulls(len(ranges)).cast(pa.int64())
            return np.bincount(tokens >> np.uint64(44), minlength=COUNTERS).astype(np.uint32), pa.RecordBatch.from_arrays([none] * 4 + [pa.array([k + COUNTERS for k in ranges], pa.int32()), pa.array(parts, pa.binary())], names=["id", "n_shingles", "d1", "d2", "chunk", "counts"])

        for batch in batches:
            size, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, tokens in _sets(batch.column(1), n):
                size[row] = len(tokens)
                if len(tokens):
                    one[row], two[row] = _digest(tokens)
                    held.append(tokens)
                    waiting += len(tokens)
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(one), pa.array(two), empty.cast(pa.int32()), empty.cast(pa.binary())], names=["id", "n_shingles", "d1", "d2", "chunk", "counts"])
            if waiting > FLUSH:
                more, rows = flush()
                counts, held, waiting = counts + more, [], 0
                yield rows
        if held:
            more, rows = flush()
            counts = counts + more
            yield rows
        rows = common.bucket_rows(counts)
        none = pa.nulls(rows.num_rows).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [rows.column(0), rows.column(1)], names=["id", "n_shingles", "d1", "d2", "chunk", "counts"])

    seen = common.keep(texts.mapInArrow(common.tidy(classify), _CLASS))
    counts = common.fold_buckets(seen.where(F.col("chunk") < COUNTERS), COUNTERS)
    base = int(np.median(counts))
    classes = np.minimum(63, np.log2(np.maximum(1, counts.astype(np.float64) - 2 * base) + 1) * 2).astype(np.uint8)
    rarity = np.maximum(1, classes), seen_twice(seen.where(F.col("chunk") >= COUNTERS).select(F.col("chunk") - COUNTERS, "counts").toDF("chunk", "counts"))
    own = common.keep(seen.where("chunk is null").select("id", "n_shingles", "d1", "d2"))
    common.free(seen)
    classes = common.keep(own.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def prefixes(batches):
        done: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            for _, tokens in _sets(batch.column(1), n):
                if not len(tokens) or (own := _digest(tokens)) in done:
                    continue
                if len(done) < 1 << 18:
                    done.add(own)
                key = _order(tokens, shared.value)
                alone = int(np.searchsorted(key, np.uint64(1) << np.uint64(58)))
                prefix = key[alone : len(key) - math.ceil(percent * len(key) / 100) + 1]
                if len(prefix):
                    out.append((prefix.copy(), own[0], len(key), len(key) - alone))
            if out:
                each = [len(k) for k, _, _, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([k for k, _, _, _ in out]).view(np.int64)),
                        pa.array(np.repeat(np.array([d for _, d, _, _ in out], np.int64), each)),
                        pa.array(np.repeat(np.array([s for _, _, s, _ in out], np.int32), each)),
                        pa.array(np.repeat(np.array([m for _, _, _, m in out], np.int32), each)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in each])),
                        _before([k for k, _, _, _ in out]),
                    ],
                    names=["token", "d1", "n", "m", "pos", "prev"],
                )

    rows = common.keep(texts.mapInArrow(common.tidy(prefixes), "token long, d1 long, n int, m int, pos int, prev array<long>"))
    # the hub of a token: the class with the fewest tokens of its own is the likeliest to be like the others;
    # least and largest differ when two classes have the token
    lost = (F.col("n") - F.col("m")).alias("lost")
    hubs = rows.groupBy("token").agg(F.min(F.struct(lost, "n", "d1", "m", "pos")).alias("hub"), F.max(F.struct(lost, "n", "d1")).alias("last")).where("hub.lost <> last.lost or hub.n <> last.n or hub.d1 <> last.d1").select("token", "hub")
    met = common.keep(rows.join(hubs, "token").groupBy("token", "d1", "n", F.col("hub.d1").alias("hub"), F.col("hub.n").alias("hub_n")).agg(F.max("m").alias("m"), F.max("hub.m").alias("hub_m"), F.min("pos").alias("pos"), F.min("hub.pos").alias("hub_pos"), F.first("prev").alias("prev")))
    common.free(rows)

    def can_link(n1: str, m1: str, p1: str, n2: str, m2: str, p2: str):
        """Length and positional filters; of n tokens m are in several sets, and only those can be common."""
        return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and (100 + {percent}) * (least({p1}, {p2}) + least({m1} - {p1}, {m2} - {p2})) >= {percent} * ({n1} + {n2})")

    star = common.keep(met.where("d1 <> hub").where(can_link("n", "m", "pos", "hub_n", "hub_m", "hub_pos")).select(F.least("d1", "hub").alias("a"), F.greatest("d1", "hub").alias("b")).distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(common.hash_filter(met.select("d1"))))

    def collect(batches):
        marks = np.unpackbits(wanted.value).view(bool)
        for batch in batches:
            ids, found = [], []
            for _, tokens in _sets(batch.column(1), n):
                if len(tokens) and marks[np.int64(one := _digest(tokens)[0]).view(np.uint64) >> np.uint64(41)]:
                    ids.append(one)
                    found.append(_order(tokens, shared.value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["d1", "tokens"])

    sets = common.keep(texts.mapInArrow(common.tidy(collect), "d1 long, tokens binary").join(met.select("d1").distinct(), "d1", "left_semi").groupBy("d1").agg(F.first("tokens").alias("tokens")))

    def verify(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [similar(np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64), percent) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("d1").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("d1").alias("b"), F.col("tokens").alias("y")), "b")
        return common.keep(both.select("a", "b", "x", "y").mapInArrow(common.tidy(verify), "a long, b long"))

    first = links(star)
    near = common.components(first, one_task)
    part = F.col("d1") if count_links else F.coalesce("component_id", "d1")
    split = met.join(near.withColumnRenamed("node", "d1"), "d1", "left").select("token", "d1", "n", "m", "pos", "prev", part.alias("c"))
    torn = split.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    rest = common.keep(split.join(torn, "token", "left_semi").withColumn("band", F.expr(f"cast(floor(ln(n) / ln({100 / percent})) as int)")))
    # two sets that have one of the tokens before in common as well have met there: a pair is made where a common run begins
    # a partner has as many tokens or more, up to n * 100 / percent: it is in the same band, or in one of the next two at an edge
    left = rest.select("token", "d1", "n", "m", "pos", "prev", "c", F.explode(F.array([F.col("band") + k for k in range(3)])).alias("band"))
    right = rest.select("token", F.col("d1").alias("d2"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"), F.col("prev").alias("prev2"), "band")
    pairs = left.join(right, (left["token"] == right["token"]) & (left["band"] == right["band"]) & F.expr("c <> c2 and (n < n2 or n = n2 and d1 < d2) and not arrays_overlap(prev, prev2)") & can_link("n", "m", "pos", "n2", "m2", "pos2"))
    pairs = common.keep(pairs.select(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    common.free(met, rest, star)
    every = first.union(links(pairs))
    common.free(sets, pairs)

    reps = classes.groupBy("d1").agg(F.min("rep").alias("rep"))
    linked = every.join(reps.select(F.col("d1").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("d1").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb")
    whole = common.components(linked, one_task).select(F.col("node").alias("rep"), F.col("component_id").alias("whole"))
    named = classes.join(whole, "rep", "left").select("d1", "d2", "n_shingles", "copies", F.coalesce("whole", "rep").alias("component"))
    if count_links:
        sides = every.select("a", "b").union(every.select("b", "a")).toDF("d1", "b")
        met_copies = sides.join(classes.groupBy("d1").agg(F.sum("copies").alias("others")).withColumnRenamed("d1", "b"), "b").groupBy("d1").agg(F.sum("others").alias("others"))
        named = named.join(met_copies, "d1", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    named = common.keep(named)
    common.free(classes)
    # a set of many copies is a hot key
    joined = common.join_hot(own.where("n_shingles > 0"), named, ["d1", "d2", "n_shingles"], "copies", own.count())
    more = [F.col("n_links")] if count_links else []
    out = joined.select("id", "n_shingles", F.col("component").alias("component_id"), *more)
    out = out.union(own.where("n_shingles = 0").select("id", "n_shingles", "id", *[F.lit(0).cast("long") for _ in more]))
    return out.withColumnRenamed("id", id_col), [own, named]


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: of each component the row with the smallest id stays, and rows
    without words stay. Rows that repeat an id that stays are all kept."""
    found, read = _classes(docs, n, percent, id_col, text_col, 1 << 20, False)
    gone = common.keep(found.where(~F.col("component_id").eqNullSafe(F.col(id_col))).select(id_col).distinct())
    common.free(*read)
    return common.without(docs, gone, id_col)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """documents, 3-word shingles, 90 percent: doc_id, n_shingles, component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs, n=3, percent=90)
