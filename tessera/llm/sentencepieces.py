"""SentencePiece encoding and decoding by a shared-prefix forward pass over a trie of distinct words.

A text is its marked words: each run of spaces becomes as many marks, and the word after it. No piece has
a mark after another character (checked when the model is loaded), so words are encoded apart, each
distinct word once while a worker remembers it. Sorted, they are a trie in depth-first order: going from one word to the
next, the forward states of the common prefix stay, and only the other characters are visited.

Unigram models keep the best score and last piece of each prefix: Viterbi. A BPE model's pieces are not
those of the best sum of scores, so for BPE a prefix keeps the one last piece with which its encoding
ends: among the pieces that end there, the one that its merges leave next to the last piece of the prefix
before it. Pairs are judged by the model's own merges and remembered. Both passes are exact.
"""

from __future__ import annotations

import heapq
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD_BYTES = 24 << 20  # of the words that a worker remembers
PIECE = 1 << 19  # bytes of whole texts that are encoded together
PAIRS_KEPT = 3 << 16
DECODE_IDS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """A model's pieces, and decoding. Models with a normalisation other than the identity are refused."""

    def __init__(self, model: bytes):
        self.pieces, self.score, self.kinds = [], [], []
        scores, kinds = self.score, self.kinds
        self.bpe, self.dummy, extra = False, True, True
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                norm = dict(_fields(value))
                self.dummy, extra = bool(norm.get(3, 1)), bool(norm.get(4, 1))
                if norm.get(1, b"identity") != b"identity" or norm.get(2):
                    raise ValueError("only models without character normalisation are supported")
        if extra:
            raise ValueError("models that remove extra white space are not supported")
        raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for k, kind in enumerate(kinds):
            raw[k] = bytes([int(self.pieces[k][3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else raw[k]
        self.sizes = np.array([len(r) for r in raw])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of ids[first[k]:first[k + 1]]; one leading space, the dummy's, goes."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], size)]
        offsets = ends[first]
        if self.dummy:
            lead = (np.diff(offsets) > 0) & (np.append(data, 0)[np.minimum(offsets[:-1], len(data))] == 32)
            stay = np.ones(len(data), bool)
            stay[offsets[:-1][lead]] = False
            data, offsets = data[stay], offsets - np.concatenate([[0], np.cumsum(lead)])
        return data, offsets


class Pieces(Vocabulary):
    """What encoding needs besides: the pieces' places, their ends and the pairs judged so far."""

    def __init__(self, model: bytes):
        super().__init__(model)
        kinds, scores = self.kinds, self.score
        usable = [k for k, kind in enumerate(kinds) if kind in (NORMAL, USER)]
        self.id_of = {self.pieces[k]: k for k in usable}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes on after a mark")
        self.byte = [0] * 256
        for k, kind in enumerate(kinds):
            if kind == BYTE:
                self.byte[int(self.pieces[k][3:5], 16)] = k
        self.unknown = next(k for k, kind in enumerate(kinds) if kind == UNKNOWN)
        self.has_bytes = BYTE in kinds
        self.longest = max(map(len, self.id_of), default=1)
        # True for pieces, False for what only ends one: how far back a piece that ends here can begin
        self.tails = {p[k:]: False for p in self.id_of for k in range(1, len(p))} | dict.fromkeys(self.id_of, True)
        self.lowest = min((scores[k] for k in usable), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, bool], list[tuple[str, float]] | None] = {}

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            k = self.id_of.get(p)
            if k is not None:
                out.append(k)
            elif self.has_bytes:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """BPE by its definition: join the neighbours whose piece scores highest, the leftmost of equals.
        steps gets the pairs in the order in which they are joined."""
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left, right):
            if 0 <= left and right < len(parts) and (k := self.id_of.get(both := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (-self.score[k], left, both))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left]
            if not parts[left] or right >= len(parts) or parts[left] + parts[right] != both:
                continue
            if steps is not None:
                steps.append((parts[left], parts[right]))
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _edge(self, piece: str, right: bool) -> list[tuple[str, float]] | None:
        """What stands at one edge while piece is merged, from a character to piece, with the scores at
        which each appears. None where the piece is not its own encoding or a part scores less than it."""
        known = self.edges.get((piece, right), False)
        if known is not False:
            return known
        out = None
        if len(piece) == 1:
            out = [(piece, np.inf)]
        else:
            steps: list[tuple[str, str]] = []
            if self.merge(piece, steps) == [piece]:
                score = [self.score[self.id_of[a + b]] for a, b in steps]
                inner = self._edge(steps[-1][right], right)
                if inner is not None and all(x >= y for x, y in zip(score, score[1:])):
                    out = [*inner, (piece, score[-1])]
        self.edges[piece, right] = out
        return out

    def _fits(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is those two pieces. Their own merges run in the order of
        scores; the pair is broken when, before one of them, what stands left and right of the border joins."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        a = self._edge(left, True) if left else None
        b = self._edge(right, False)
        if not left:
            known = self.merge(right) == [right] if b is None else True
        elif a is None or b is None:
            known = self.merge(left + right) == [left, right]
        else:
            i = j = 0
            while True:
                own = a[i + 1][1] if i + 1 < len(a) else -np.inf
                other = b[j + 1][1] if j + 1 < len(b) else -np.inf
                k = self.id_of.get(a[i][0] + b[j][0])
                if k is not None and self.score[k] > own and self.score[k] >= other:
                    known = False
                    break
                if own == other == -np.inf:
                    known = True
                    break
                if own >= other:
                    i += 1
                else:
                    j += 1
        self.pairs[left, right] = known
        return known

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """The ids of sorted distinct marked words."""
        out = []
        last: list[str] = [""]  # last[i]: the piece that ends the encoding of the first i characters
        total: list[float] = [0.0]
        previous = ""
        id_of, longest, pairs, tails = self.id_of, self.longest, self.pairs.get, self.tails.get
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.bpe:
                    start = end - 1
                    piece = found = word[start]
                    kind = tails(piece)
                    whole = True  # a character may stand alone even if it is no piece
                    while True:
                        if whole:
                            fits = pairs((last[start], piece))
                            if self._fits(last[start], piece) if fits is None else fits:
                                found = piece
                                break
                        if kind is None or not start:
                            break
                        start -= 1
                        piece = word[start:end]
                        kind = whole = tails(piece)
                    last.append(found)
                else:
                    best, found = -np.inf, word[end - 1]
                    for start in range(max(0, end - longest), end):
                        piece = word[start:end]
                        k = id_of.get(piece)
                        if k is None and start < end - 1:
                            continue
                        score = total[start] + (self.score[k] if k is not None else self.lowest)
                        if score > best:
                            best, found = score, piece
                    last.append(found)
                    total.append(best)
            previous = word
            parts, at = [], len(word)
            while at:
                parts.append(last[at])
                at -= len(last[at])
            out.append(self.ids(parts[::-1]))
        return out


def decoder(model: bytes) -> Vocabulary:
    """The model's vocabulary, kept while the worker decodes or encodes."""
    return _kept("decoder", model, Vocabulary)


def encoder(model: bytes) -> Encoder:
    """The model's encoder, kept with its words and what it has learnt of its pairs while the worker encodes or decodes."""
    return _kept("encoder", model, lambda m: Encoder(Pieces(m)))


def _kept(kind: str, model: bytes, make):
    if (kind, model) not in common.MODELS:
        common.MODELS[kind, model] = make(model)
    return common.MODELS[kind, model]


class Encoder:
    """Encodes batches of texts; remembers the words it has seen, up to a bound in bytes, in flat arrays:
    a word's row has its bytes, its marks and its ids, and sorted hashes lead to the rows."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self):
        self.keys, self.row_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.marks, self.word_at, self.id_at = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.row_of, self.marks, self.word_at, self.id_at, self.bytes, self.ids))

    @staticmethod
    def _distinct(data, starts, ends, marks) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(an occurrence of each distinct marked word, each occurrence's word, the words' hashes): by hash, and
        compared byte by byte. No hashes where two words have the same."""
        with np.errstate(over="ignore"):
            keys = textbytes.slice_hash(textbytes.prefix_hash(data), starts, ends) + textbytes.mix(marks.astype(np.uint64))
        keys, at, where = np.unique(keys, return_index=True, return_inverse=True)
        like, size = at[where], ends - starts
        if (size == size[like]).all() and (marks == marks[like]).all() and _alike(data, starts, data, starts[like], size).all():
            return at, where, keys
        number: dict[tuple[int, bytes], int] = {}  # two words of one hash
        raw = data.tobytes()
        where = np.array([number.setdefault((m, raw[a:b]), len(number)) for m, a, b in zip(marks.tolist(), starts.tolist(), ends.tolist())])
        return np.unique(where, return_index=True)[1], where, None

    def _rows(self, data, starts, ends, marks, keys) -> np.ndarray:
        """The rows of distinct marked words; those that are not remembered are encoded first."""
        rows, size = np.zeros(len(starts), np.int64), ends - starts
        hit = named = np.zeros(len(starts), bool)  # known by hash and bytes; by hash
        if keys is not None and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rows, named = self.row_of[place].astype(np.int64), self.keys[place] == keys
            hit = named & (np.diff(self.word_at)[rows] == size) & (self.marks[rows] == marks)
            own = np.flatnonzero(hit)
            hit[own] = _alike(data, starts[own], self.bytes, self.word_at[rows[own]], size[own])
        new = np.flatnonzero(~hit)
        if not len(new):
            return rows
        raw = data.tobytes()
        words = [MARK * m + raw[a:b].decode("utf-8", "surrogateescape") for m, a, b in zip(marks[new].tolist(), starts[new].tolist(), ends[new].tolist())]
        plain = sorted(word for word in words if word[1:2] != MARK)
        found = dict(zip(plain, self.pieces.encode_sorted(plain)))
        ids = array("i")
        sizes = np.zeros(len(new), np.int64)
        for k, word in enumerate(words):
            own = found.get(word)
            if own is None:  # runs of marks have pieces of equal score: merged by definition
                own = self.pieces.ids(self.pieces.merge(word)) if self.pieces.bpe else self.pieces.encode_sorted([word])[0]
            ids.extend(own)
            sizes[k] = len(own)
        rows[new] = len(self.marks) + np.arange(len(new))
        self.marks = np.concatenate([self.marks, marks[new].astype(np.int32)])
        self.bytes = np.concatenate([self.bytes, data[_runs(starts[new], size[new])]])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.int32)])
        self.word_at = np.concatenate([self.word_at, self.word_at[-1] + np.cumsum(size[new])])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(sizes)])
        if keys is not None:  # a word whose hash is another word's is encoded each time
            add = new[~named[new]]
            to = np.searchsorted(self.keys, keys[add])
            self.keys, self.row_of = np.insert(self.keys, to, keys[add]), np.insert(self.row_of, to, rows[add].astype(np.int32))
        return rows

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, each text's first index among them, one more at the end)."""
        texts, n = len(offsets) - 1, len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        space = data == 32
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        solid = ~space
        first, final = solid.copy(), solid.copy()
        first[1:] &= space[:-1] | edge[1:-1]
        final[:-1] &= space[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
        # a chunk for every word, and one without a word for spaces that end a text
        text_of = np.searchsorted(offsets, starts, "right") - 1
        ends_in_space = (np.diff(offsets) > 0) & space[np.maximum(offsets[1:] - 1, 0)]
        tails = offsets[1:][ends_in_space]
        starts = np.concatenate([starts, tails])
        ends = np.concatenate([ends, tails])
        text_of = np.concatenate([text_of, np.flatnonzero(ends_in_space)])
        order = np.lexsort((starts, text_of))
        starts, ends, text_of = starts[order], ends[order], text_of[order]
        opens = np.concatenate([[True], text_of[1:] != text_of[:-1]]) if len(text_of) else np.zeros(0, bool)
        before = np.where(opens, offsets[text_of], np.concatenate([[0], ends[:-1]]))
        marks = starts - before + (opens if self.pieces.dummy else 0)
        at, where, keys = self._distinct(data, starts, ends, marks)
        if self.held > WORD_BYTES:
            self._forget()
        rows = self._rows(data, starts[at], ends[at], marks[at], keys)[where]
        size = np.diff(self.id_at)[rows]
        to = np.concatenate([[0], np.cumsum(size)])
        return self.ids[_runs(self.id_at[rows], size)], to[np.searchsorted(text_of, np.arange(texts + 1))]


def _runs(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes from these starts, end to end."""
    return np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)


def _alike(data: np.ndarray, starts: np.ndarray, others: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each slice of data is that of others, of the same size."""
    differ = np.concatenate([[0], np.cumsum(data[_runs(starts, size)] != others[_runs(at, size)])])
    end = np.cumsum(size)
    return differ[end] == differ[end - size]


def _batches(column):
    """(first row, bytes, offsets) of groups of whole texts, marks turned into the spaces they stand for."""
    data, offsets = textbytes.text_buffers(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        bounds = offsets[row : end + 1] - offsets[row]
        raw = part.tobytes()
        if MARK.encode() in raw:
            texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(bounds[:-1], bounds[1:])]
            part, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        yield row, part, bounds
        row = end


def encode(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col array<int>: the model's encoding of the whole text; null and empty texts have no
    ids. The model is read on the driver (its size is that of a vocabulary) and broadcast. A column of
    that name in docs is replaced; all others come back as they are. Each row is encoded by itself, where it
    is: repeated rows come back as often as they came, ties of scores go as in the public library, an empty
    table gives an empty one, and nothing is shuffled."""
    common.small_batches(docs.sparkSession)
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)

    def run(batches):
        own = encoder(model.value)
        for batch in batches:
            parts, sizes = [], [np.zeros(1, np.int64)]
            for _, data, offsets in _batches(batch.column(at)):
                ids, first = own.encode(data, offsets)
                parts.append(ids)
                sizes.append(np.diff(first))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*batch.schema.names, ids_col])
            common.trim()

    return docs.mapInArrow(common.tidy(run, keeps=True), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{ids_col}` array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with text_col string: the text that the ids stand for (bytes that are no UTF-8 become U+FFFD)."""
    common.small_batches(encoded.sparkSession)
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    encoded = encoded.drop(text_col)
    at = encoded.columns.index(ids_col)

    def run(batches):
        pieces = decoder(model.value)
        for batch in batches:
            column = batch.column(at)
            column = pa.concat_arrays([column]).fill_null([]) if column.null_count else column
            first = column.offsets.to_numpy().astype(np.int64)
            ids = column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
            first = first - first[0]
            parts, ends, row = [], [np.zeros(1, np.int64)], 0
            while row < len(column):
                end = max(row + 1, int(np.searchsorted(first, first[row] + DECODE_IDS, "right")) - 1)
                some, bounds = pieces.decode(ids[first[row] : first[end]], first[row : end + 1] - first[row])
                parts.append(some)
                ends.append(bounds[1:] + ends[-1][-1])
                row = end
            data, offsets = np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate(ends)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            try:
                text = raw.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    return encoded.mapInArrow(common.tidy(run, keeps=True), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{text_col}` string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, n_tokens, ids_sha256 (of the ids in decimal, one space between), n_chars, and
    round_trip: whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(encode(docs).select("doc_id", F.xxhash64("text").alias("was"), F.length("text").cast("long").alias("n_chars"), "ids"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "n_chars", ((F.length("decoded") == F.col("n_chars")) & (F.xxhash64("decoded") == F.col("was"))).alias("round_trip"))
