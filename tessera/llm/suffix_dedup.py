"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

Every string of LENGTH bytes that occurs in a document with a smaller id is removed. Two equal strings
hold the same anchor, the least hash of their GRAM-byte slices, at the same place, and so the same key: the
anchor with the SIDE bytes on the side that has more of the string. Only strings whose key several texts
have are looked at. A key tells far more texts apart than an anchor, which much text shares by chance.
Prints of the keys, whose width follows the input, are dealt by range; bits come back to the group of texts
that sent them, so no table of the corpus is held anywhere. What is left is cut into segments of strings
with one anchor. Segments meet by anchor; equal segments become one with its smallest id, and anchors with
several different segments go on.

In a bucket of anchors, segments are dealt to shards. Each shard has the Burrows-Wheeler transform of its
segments. The interleave says which shard's row each row of the merged transform is; it starts in shard
order and is refined by the symbols before each row, two a pass: in the interleave's order they are sorted
stably and lead to the rows of the strings they begin. A row whose symbols, or whose predecessor's interval, differ from
its neighbour's opens an interval: the symbols taken so far are more than the common prefix. After LENGTH
symbols the intervals are the repeated strings. No suffixes are sorted again; on the way, segments of which
no string can be repeated any more leave the transforms, which takes their rows out and nothing else.

What never reaches a transform, as it has nothing to merge: whole copies, found by two 64-bit hashes, and
anchors all of whose segments are equal by anchor and 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # starts of one segment at most
SIDE = (LENGTH - GRAM) // 2  # a string has so many bytes before its anchor, or more than that after it
PLACE = np.uint64(21)  # bits of a place in a chunk of texts
END = 0xFF  # no byte of UTF-8
AFTER_END = np.array([(1 << 64) - (1 << (8 * (7 - k))) for k in range(8)], np.uint64)  # the first k + 1 bytes of eight
SHARD_BYTES = 1 << 17
BUCKET_BYTES = 1 << 18
HEAVY = 200_000  # distinct segments of one anchor that stay together
FEW_COPIES = 500_000  # 24 bytes each: so many whole copies at most are broadcast
GROUP_BYTES = 1 << 22  # of texts that send their prints together
RANGE_BYTES = 1 << 26  # of texts whose prints one task compares, about 6 million


def _chunks(data: np.ndarray, offsets: np.ndarray, limit: int = textbytes.PIECE):
    """(first row, place in its text, bytes, offsets) of whole texts up to limit, or of parts of one long
    text that overlap by LENGTH - 1 bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        if end > row:
            yield row, 0, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
            continue
        for at in range(int(offsets[row]), int(offsets[row + 1]) - LENGTH + 1, limit):
            part = data[at : min(at + limit + LENGTH - 1, int(offsets[row + 1]))]
            yield row, at - int(offsets[row]), part, np.array([0, len(part)], np.int64)
        row += 1


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, key, first start, number of starts) of the stretches of texts whose strings have one key: the
    anchor is the leftmost of the least hashes, and the key takes the SIDE bytes before it if a string has them."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, down = textbytes.powers(len(data) + 1)
    prefix = textbytes.prefix_hash(data)
    with np.errstate(over="ignore"):
        h = (prefix[GRAM:] - prefix[:-GRAM]) * down[: len(data) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    least, width = h >> PLACE << PLACE, 1
    least |= np.arange(len(h), dtype=np.uint64)
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: n], least[SPAN - width :][:n])
    inside = np.ones(n, bool)
    for at in offsets[1:-1]:
        inside[max(0, at - LENGTH + 1) : at] = False
    opens = np.ones(n, bool)
    opens[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], n)
    good = inside[starts]
    starts, ends = starts[good], ends[good]
    place = (least[starts] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    turn = np.clip(place - SIDE + 1, starts, ends)  # from here on strings have fewer than SIDE bytes before the anchor
    count = np.stack([turn - starts, ends - turn], axis=1).reshape(-1)
    some = count > 0
    starts, place = np.stack([starts, turn], axis=1).reshape(-1)[some], np.repeat(place, 2)[some]
    begin = (place - np.tile([SIDE, 0], len(turn))[some])
    # minima crowd at low values: spread them
    return textbytes.mix(h[place]), textbytes.slice_hash(prefix, begin, begin + SIDE + GRAM), starts, count[some]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(rows, places in their texts, bytes, anchors, keys, starts in the bytes, numbers of starts) of each chunk."""
    for row, base, part, bounds in _chunks(data, offsets):
        anchor, key, start, count = segments(part, bounds)
        text = np.searchsorted(bounds, start, "right") - 1
        yield row + text, base + start - bounds[text], part, anchor, key, start, count


def prints(key: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(prints, which): the first bits of the keys, sorted, each once or, if several rows have it, twice; and
    which of them is each key's."""
    order = np.argsort(key)
    own, row = key[order] >> np.uint64(64 - bits), row[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    times = 1 + (np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)) if len(own) else first
    which = np.empty(len(own), np.int64)
    which[order] = np.repeat(np.cumsum(times) - times, np.diff(np.append(first, len(own))))
    return np.repeat(own[first], times), which


def _in_range(own: np.ndarray, bits: int) -> np.ndarray:
    """Where the ranges of prints begin; prints of a range differ in their last 32 bits."""
    return np.searchsorted(own, np.arange((1 << (bits - 32)) + 1, dtype=np.uint64) << np.uint64(32))


def _compare(table: pa.Table) -> pa.Table:
    """Bits for the prints of one range: whether another print equals it."""
    data, offsets = textbytes.text_buffers(table["prints"])
    own, offsets = np.frombuffer(data.tobytes(), np.uint32), offsets // 4
    every = np.sort(own)
    twice = every[1:][every[1:] == every[:-1]]
    hit = np.zeros(len(own), bool)
    if len(twice):
        hit = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.table({"g": table["g"], "range": table["range"], "hits": pa.array(bits, pa.binary())})


def _joined(anchor: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of one anchor: stretches that follow each other become one, of SPAN starts at most."""
    opens = np.ones(len(anchor), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(opens)
    anchor, start, count = anchor[first], start[first], np.add.reduceat(count, first)
    cuts = -(-count // SPAN)  # texts with a period have long runs of one anchor
    if cuts.max() > 1:
        inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start, count = np.repeat(start, cuts) + inner * SPAN, np.minimum(np.repeat(count, cuts) - inner * SPAN, SPAN)
    return np.repeat(anchor, cuts), start, count


def _take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices data[start : start + size], one after the other, and their offsets."""
    to = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)], to


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform) of strings that each end in END. Ends are in the order
    of their places, so equal suffixes are in the order of their strings. A whole string's row has END."""
    n = len(text)
    code = np.zeros(n + 8, np.uint8)
    code[:n] = np.where(text == END, 0, text + np.uint8(1))  # END is least
    to_end = np.flatnonzero(text == END)
    room = np.repeat(to_end, np.diff(to_end, prepend=-1)) - np.arange(n)  # symbols before the end
    key = np.lib.stride_tricks.sliding_window_view(code, 8)[:n].copy().view(">u8").reshape(-1).astype(np.uint64)
    key &= AFTER_END[np.minimum(room, 7)]
    order = np.argsort(key, kind="stable")
    depth = 8
    ranks = np.empty(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (room[order][1:] < depth) | (room[order][:-1] < depth)
    # ranks: the first row of the group, so that they stay right while groups are split
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        last = np.append(fresh[1:], True)
        rows = np.flatnonzero(~(fresh & last))
        if not len(rows):
            break
        at = order[rows]
        pair = ranks[at] << 32 | ranks[np.minimum(at + depth, n - 1)]
        by = np.argsort(pair, kind="stable")
        order[rows] = at[by]
        pair = pair[by]
        same = np.concatenate([[False], pair[1:] == pair[:-1]])
        fresh[rows] = ~same
        ranks[order[rows]] = np.maximum.accumulate(np.where(same, 0, rows))
        depth *= 2
    before = np.concatenate([[END], text[:-1]]).astype(np.uint8)
    return order, before[order]


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH, thin_at: tuple[int, ...] = (8, 14, 20, 28, 38)):
    """Merge transforms: (shard of each row, row in its shard, opens), after length symbols.

    shards: of each the transform, the row that each row's symbol leads to (of the string's end, for a whole
    string's row), the string number of each row, and whether a string of length begins there; opens marks
    the first row of each interval. A pass takes two symbols (the first one of an odd length takes one).
    Strings that leave after thin_at symbols or more are missing: at none of the rows where one of length
    could begin do they share an interval, so no other string equals one of theirs."""
    sizes = np.array([len(s[0]) for s in shards])
    base = np.cumsum(sizes) - sizes
    code = np.concatenate([s[0] for s in shards]) + np.uint8(1)  # 0 for END, as in the transforms' order
    leads = np.concatenate([s[1] + at for s, at in zip(shards, base)]).astype(np.int32)
    counts = np.array([int(s[2].max(initial=-1)) + 1 for s in shards])
    string = np.concatenate([s[2] + at for s, at in zip(shards, np.cumsum(counts) - counts)]).astype(np.int32)
    begins = np.concatenate([s[3] for s in shards])
    name = np.arange(len(code), dtype=np.int32)  # rows as the shards have them, of those that are left
    row = name.copy()  # the interleave
    block = np.zeros(len(row), np.int32)
    fresh = np.arange(len(row)) == 0

    def refine(symbols, to, ends):
        """Sort by the symbols before, in the interleave's order; rows with an end in their symbols equal no other."""
        nonlocal row, block, fresh
        own = symbols.take(row)
        order = np.argsort(own, kind="stable")
        own, old, row = own.take(order), block.take(order), row.take(order)
        fresh = np.ones(len(order), bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        fresh[1:] |= old[1:] != old[:-1]
        alone = np.flatnonzero(ends.take(row))
        fresh[alone] = True
        fresh[alone[alone < len(row) - 1] + 1] = True
        row = to.take(row)
        block = np.cumsum(fresh, dtype=np.int32)

    def pairs():
        before = code.take(leads)
        return before.astype(np.uint16) << np.uint16(8) | code, leads.take(leads), (before == 0) | (code == 0)

    depth = length % 2
    if depth and len(row):
        refine(code, leads, code == 0)
    two, wanted = pairs(), list(thin_at)
    while depth < length and len(row):
        refine(*two)
        depth += 2
        if wanted and depth >= wanted[0]:
            wanted = [at for at in wanted if at > depth]
            together = row[~(fresh & np.append(fresh[1:], True))]
            stays = np.zeros(int(counts.sum()), bool)
            stays[string[together[begins[together]]]] = True
            left = stays[string]
            if left.all():
                continue
            in_order = left[row]
            to = np.cumsum(left, dtype=np.int32) - 1
            row, block = to[row[in_order]], block[in_order]
            code, leads, string, begins, name = code[left], to[leads[left]], string[left], begins[left], name[left]
            fresh = np.ones(len(row), bool)
            fresh[1:] = block[1:] != block[:-1]
            two = pairs()
    at = name[row]
    shard = np.searchsorted(base, at, "right") - 1
    return shard, at - base[shard], fresh


def first_ids(texts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each start of a string of length in each text the smallest id of the texts that hold the string."""
    sizes = np.array([len(t) for t in texts])
    shards, at = [], 0
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:] + 1), SHARD_BYTES, "right")))
        end = min(end, len(texts))
        if not shards and end == len(texts) and end - at > 1:
            end = at + (end - at) // 2  # two shards at least
        text = np.frombuffer(b"".join(t + b"\xff" for t in texts[at:end]), np.uint8)
        suffixes, bwt = transform(text)
        stop = np.cumsum(sizes[at:end] + 1)
        begin = stop - sizes[at:end] - 1
        string = np.searchsorted(stop, suffixes, "right")
        place = np.empty(len(text), np.int64)
        place[suffixes] = np.arange(len(text))
        leads = place[np.where(suffixes == begin[string], stop[string] - 1, suffixes - 1)]
        shards.append((at, begin, suffixes, string, bwt, leads, suffixes + length < stop[string]))
        at = end
    out = [np.full(max(0, size - length + 1), i, np.int64) for size, i in zip(sizes, ids)]
    shard, row, opens = merge([(s[4], s[5], s[3], s[6]) for s in shards], length)
    shared = ~(opens & np.append(opens[1:], True)) if len(opens) else opens
    shard, row, block = shard[shared], row[shared], np.cumsum(opens)[shared]
    if not len(row):
        return out
    text_of, start = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    for k, (first, begin, suffixes, string, *_) in enumerate(shards):
        own = shard == k
        text_of[own] = first + string[row[own]]
        start[own] = suffixes[row[own]] - begin[string[row[own]]]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    least = np.repeat(np.minimum.reduceat(ids[text_of], edge), np.diff(np.append(edge, len(block))))
    flat = np.concatenate(out)
    flat[(np.cumsum([len(o) for o in out]) - [len(o) for o in out])[text_of] + start] = least
    return np.split(flat, np.cumsum([len(o) for o in out])[:-1])


def _bucket(table: pa.Table) -> pa.Table:
    first = first_ids(table["segment"].to_pylist(), table["id"].to_numpy())
    sizes = [len(f) for f in first]
    flat = np.concatenate(first)
    text = np.repeat(np.arange(len(first)), sizes)
    opens = np.ones(len(flat), bool)
    opens[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(opens)
    begin = (np.cumsum(sizes) - sizes)[text[at]]
    take = pa.array(text[at])
    return pa.table({"k1": table["k1"].take(take), "k2": table["k2"].take(take), "start": pa.array((at - begin + table["start"].to_numpy()[text[at]]).astype(np.int32)), "n": pa.array(np.diff(np.append(at, len(flat))).astype(np.int32)), "first": pa.array(flat[at])})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k, k2): the keys tell texts apart, together with their length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("k2"))


def whole_copies(texts: DataFrame) -> DataFrame:
    """(k, k2, first): texts of LENGTH bytes or more that several ids have, and the smallest of those."""
    same = texts.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH)).groupBy("k", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return common.keep(same.where("first <> last").select("k", "k2", "first"))


def shared_segments(texts: DataFrame) -> DataFrame:
    """(id, k, at, k1, k2, segment): the parts of texts, from byte at on, that may hold strings of other texts.
    k1 is the anchor, k2 the segment's own hash: together 128 bits."""
    texts = texts.where(F.octet_length("text") >= LENGTH)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 32 + (size // RANGE_BYTES).bit_length()
    # rows that repeat an id and its text are nothing to each other
    grouped = texts.withColumn("g", F.pmod(F.xxhash64("id", "k"), F.lit(1 + size // GROUP_BYTES))).repartition("g").dropDuplicates(["g", "id", "k"])

    def tell(table):
        found = [(key, row) for row, _, _, _, key, _, _ in _pieces(*textbytes.text_buffers(table["text"]))]
        own, _ = prints(*map(np.concatenate, zip(*found)), bits)
        edges = _in_range(own, bits)
        ranges = np.flatnonzero(np.diff(edges))
        low = own.astype(np.uint32)
        parts = [low[edges[k] : edges[k + 1]].tobytes() for k in ranges]
        return pa.table({"range": pa.array(ranges, pa.int32()), "g": pa.array(np.full(len(ranges), table["g"][0].as_py())), "prints": pa.array(parts, pa.binary())})

    def cut(table, told):
        names = ["id", "k", "at", "k1", "k2", "segment"]
        found = list(_pieces(*textbytes.text_buffers(table["text"])))
        own, which = prints(np.concatenate([x[4] for x in found]), np.concatenate([x[0] for x in found]), bits)
        edges = _in_range(own, bits)
        hits = np.zeros(len(own), bool)
        for k, part in zip(told["range"].to_pylist(), told["hits"].to_pylist()):
            hits[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(part, np.uint8), count=int(edges[k + 1] - edges[k]))
        shared, out = np.split(hits[which], np.cumsum([len(x[0]) for x in found])[:-1]), []
        for keeps, (row, at, part, anchor, _, start, count) in zip(shared, found):
            if not keeps.any():
                continue
            shift, row = (at - start)[keeps], row[keeps]  # of the text in its chunk
            begins = start[keeps]
            anchor, start, count = _joined(anchor[keeps], begins, count[keeps])
            text = np.searchsorted(begins, start, "right") - 1
            raw, to = _take(part, start, count + LENGTH - 1)
            key = textbytes.slice_hash(textbytes.prefix_hash(raw), to[:-1], to[1:])
            own = pa.array(row[text])
            segment = pa.BinaryArray.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            ids = [table[name].take(own).combine_chunks() for name in names[:2]]
            out.append(pa.table([*ids, pa.array((start + shift[text]).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(key.view(np.int64)), segment], names=names))
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())], names=names)
        return pa.concat_tables([empty, *out])

    cells = grouped.groupBy("g").applyInArrow(tell, "range int, g long, prints binary")
    told = common.keep(cells.groupBy("range").applyInArrow(_compare, "g long, range int, hits binary"))
    cuts = common.keep(grouped.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(cut, "id long, k long, at int, k1 long, k2 long, segment binary"), "zstd")
    common.free(told)
    return cuts


def _marks(hashes: DataFrame, count: int) -> np.ndarray:
    """A packed bitmap of the count hashes in the only column, of four bits a hash or more."""
    return np.packbits(common.hash_filter(hashes, min(27, max(23, (4 * count).bit_length()))))


def _marked(marks: np.ndarray, hashes: pa.Array) -> np.ndarray:
    """Whether the bitmap may hold the hashes."""
    bit = hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(65 - (8 * len(marks)).bit_length())
    return (marks[bit >> np.uint64(3)] << (bit & np.uint64(7)).astype(np.uint8)) & 128 > 0


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, k, spans): runs (start, n) of n starts of strings, in bytes, that also start in a smaller id of texts."""
    spark = texts.sparkSession
    common.small_batches(spark)
    cuts = shared_segments(texts.where(F.col("id").isNotNull()).select("id", "k", "text"))
    stats = common.keep(cuts.groupBy("k1").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("k2").alias("a"), F.max("k2").alias("b")).where("low <> high"), "zstd")
    # an anchor whose segments are all equal has nothing to merge: the smallest id has every string of it first
    equal = cuts.select("id", "k", "at", "k1", (F.length("segment") - LENGTH + 1).alias("n")).join(stats.where("a = b").select("k1", "low"), "k1").where("low < id").select("id", "k", F.col("at").alias("start"), "n")
    equal = common.keep(equal, "zstd")
    several = stats.where("a <> b").select("k1")
    marks = spark.sparkContext.broadcast(_marks(several, several.count()))

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(_marked(marks.value, batch.column(3))))

    mixed = common.keep(cuts.mapInArrow(maybe, "id long, k long, at int, k1 long, k2 long, segment binary").join(several, "k1", "left_semi").select("id", "k", "at", "k1", "k2", "segment"), "zstd")
    common.free(cuts, stats)
    joint = mixed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("segment").alias("segment"))
    heavy = mixed.groupBy("k1").agg(F.count_distinct("k2").alias("c")).where(F.col("c") > HEAVY).select("k1", F.lit(True).alias("heavy"))
    none = heavy.isEmpty()
    told = joint.withColumn("heavy", F.lit(None).cast("boolean")) if none else joint.join(heavy, "k1", "left")
    whole = told.where("heavy is null").select("k1", "k2", F.lit(0).alias("start"), "id", "segment", F.col("k1").alias("place"))
    single = told.where("heavy").withColumn("start", F.explode(F.sequence(F.lit(0), F.length("segment") - LENGTH))).withColumn("segment", F.expr(f"substring(segment, start + 1, {LENGTH})"))
    together = whole if none else whole.union(single.select("k1", "k2", "start", "id", "segment", F.xxhash64("segment").alias("place")))
    size = mixed.agg(F.sum(F.length("segment"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    first = together.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets))).drop("place").groupBy("bucket").applyInArrow(_bucket, "k1 long, k2 long, start int, n int, first long")
    merged = common.keep(mixed.select("id", "k", "at", "k1", "k2").join(first, ["k1", "k2"]).where("first < id").select("id", "k", (F.col("at") + F.col("start")).alias("start"), "n"), "zstd")
    common.free(mixed)
    spans = common.keep(equal.union(merged).groupBy("id", "k").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "zstd")
    common.free(equal, merged)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Each byte covered by a string of 50 bytes that also starts in a row with a smaller id goes; strings are
    judged on the input. Null texts are empty. Rows with a null id take no part and keep their text. Rows
    that repeat an id lose the same bytes for the same text, and nothing to each other. Texts under 50
    bytes are whole. Other columns are not read. A text that a smaller id has as a whole goes as a whole,
    before any string is looked for; the smallest id speaks for all."""
    texts = _keyed(docs, id_col, text_col)
    copies = whole_copies(texts)
    few = copies.count() <= FEW_COPIES
    marked = texts.join(F.broadcast(copies) if few else copies, ["k", "k2"], "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    spans = repeated_spans(marked.where("not copy"))
    wanted = docs.sparkSession.sparkContext.broadcast(_marks(spans.select(F.xxhash64("id", "k")), spans.count()))
    schema = "id long, k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def part(flagged: bool):
        """Rows that may have spans, with their bytes in kept and no digest; or the others, which are done."""

        def run(batches):
            for batch in batches:
                hits = _marked(wanted.value, batch.column(4)) & ~batch.column(3).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(hits if flagged else ~hits))
                data, offsets = textbytes.text_buffers(batch.column(2))
                sizes = np.diff(offsets)
                copy = batch.column(3).to_numpy(zero_copy_only=False)
                kept = [b"" if c else data[a:b].tobytes() for a, b, c in zip(offsets[:-1], offsets[1:], copy)]
                digest = [None if flagged else hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(np.where(copy, sizes, 0)), pa.array(copy.astype(np.int64)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=[c.split()[0] for c in schema.split(", ")])

        return marked.select("id", "k", "text", "copy", F.xxhash64("id", "k").alias("h")).mapInArrow(run, schema)

    def drop(batches):
        for batch in batches:
            columns = {name: [] for name in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for own, spans in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                own = np.frombuffer(own, np.uint8)
                edges = np.zeros(len(own) + 1, np.int32)
                if spans:
                    start = np.array([s["start"] for s in spans])
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + np.array([s["n"] for s in spans]) + LENGTH - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                left = own[~gone].tobytes()
                columns["n_removed"].append(int(gone.sum()))
                columns["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(own) else 0)
                columns["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                columns["kept"].append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(columns["n_removed"], pa.int64()), pa.array(columns["n_spans"], pa.int64()), pa.array(columns["kept_sha256"], pa.string()), pa.array(columns["kept"], pa.binary())], names=batch.schema.names[:7])

    done, open_ = part(False), part(True)
    open_ = open_.join(spans, ["id", "k"], "left").select(*done.columns, "spans").mapInArrow(drop, schema)
    return done.union(open_).drop("k").withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
