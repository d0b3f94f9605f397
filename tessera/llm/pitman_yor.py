"""Language-model scores from a hierarchical Pitman-Yor model.

Three levels: the restaurant of a context (the whole hash of the word before) has the restaurant of all
words as its parent, whose base is uniform over the training words and one unknown word.
Customers are the training tokens; a new table in a context sends one customer to the parent. Seating is
sampled by Gibbs: a customer leaves and sits down again, at a new table in proportion to (strength +
discount * tables) * parent probability, else at one of the tables with its dish in proportion to its
customers less the discount. The customers of a cell (a dish in a restaurant) leave and sit down together:
predictions read only how many tables they take, and that is drawn from its exact law given all other cells,
the weight of a new table to the power of the tables times a generalised Stirling number, which is tabled
for up to BLOCK customers and a contour integral for more. Predictive probabilities are averaged over the samples.

Tokens are dealt to buckets by word, so a dish's customers in all contexts meet in one task, packed: each
flush of a task sends a bucket its distinct words and contexts, then the contexts (and, for scoring, the
documents) of their tokens. A slot of words that is too large for a bucket is dealt by context as well.
Contexts and split words have an owner, a bucket by their hash. Sampling goes in rounds: each bucket
seats its customers with the totals of all other buckets as they were at the last exchange and its own as
they are; then it sends its tables by context and by split word to the owners, which add them up, seat the
split words in the parent and send the totals back to the buckets that asked. State and messages are kept
rows; only three sums a round come to the driver.
"""

from __future__ import annotations

import functools
import pickle
import random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textbytes

SLOTS = 1 << 16
END = np.uint64(0x0E2D0E2D0E2D0E2D)
START = np.uint64(0x57A2757A2757A275)
DISCOUNT, STRENGTH = 0.8, 5.0
SAMPLES, BURN, BETWEEN = 3, 6, 2
BLOCK = 512  # customers of the cells whose law is tabled
POINTS = 48  # of the contours that give the law of larger cells
LONE = 48  # fewer cells than this are seated one by one
BUCKET_TOKENS = 2_000_000
FLUSH = 1_500_000
FLUSH_TEXTS = 32_000  # places of texts are kept in 16 bits
LOW48 = np.uint64((1 << 48) - 1)
STATE, UP, REPLY, CHUNK, KEYS = range(5)
ROWS = "bucket int, kind int, source long, body binary, tables long, parents long, types long"


def _tokens(column):
    """(first row, end row, tokens, contexts, firsts): each text's words and END, and the word before each."""
    for row, end, words, first in textbytes.words_of_texts(column):
        texts = len(first) - 1
        where = first[1:] + np.arange(texts)
        out = np.empty(len(words) + texts, np.uint64)
        solid = np.ones(len(out), bool)
        solid[where] = False
        out[solid], out[where] = words, END
        context = np.empty(len(out), np.uint64)
        context[1:] = out[:-1]
        bounds = first + np.arange(texts + 1)
        context[bounds[:-1]] = START
        yield row, end, out, context, bounds


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, as compressed planes of bytes."""
    parts = []
    for x in arrays:
        wide = x.astype(np.uint64)
        if not len(wide) or wide.max() < 1 << 32:
            wide = wide.astype(np.uint32)
        planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.itemsize).T)
        parts.append((len(wide), wide.itemsize, pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(wide) else b""))
    return pickle.dumps(parts)


def _get(data: bytes) -> list[np.ndarray]:
    out = []
    for n, size, planes in pickle.loads(data):
        planes = pa.decompress(planes, n * size, codec="zstd", asbytes=True) if n else b""
        wide = np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(np.uint32 if size == 4 else np.uint64).reshape(-1)
        out.append(wide.astype(np.int64))
    return out


def _gaps(ascending: np.ndarray) -> np.ndarray:
    x = ascending.astype(np.uint64)
    return np.concatenate([x[:1], np.diff(x)])


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)


def _pack(words: np.ndarray, contexts: np.ndarray, last: np.ndarray, merge: bool) -> bytes:
    """Distinct words (48 bits) and how many tokens each, distinct contexts and each token's, docs or weights.

    Tokens are ordered by word, then by the top bits of the context. merge: neighbours of one cell become one
    with their summed weight; other contexts may stand between some of a cell, these are merged by Bucket.open."""
    key = (words << np.uint64(16)) | (contexts >> np.uint64(48))
    order = np.argsort(key, kind="stable")
    words, contexts, last = key[order] >> np.uint64(16), contexts[order], last[order]
    if merge:
        new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])]))
        words, contexts, last = words[new], contexts[new], np.add.reduceat(last, new)
    first = _starts(words)
    keys, place = np.unique(contexts, return_inverse=True)
    return _put(_gaps(words[first]), np.diff(first, append=len(words)), _gaps(keys), place, last)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, tokens of each, distinct contexts, each token's place in them, docs or weights)."""
    names, counts, keys, place, last = _get(data)
    return _sums(names), counts, _sums(keys), place, last


class Seating:
    """The tables of cells and their customers, each seated by itself, for all cells together: the sampler
    that draw_tables' law is tested against, for whoever needs the customers' tables. Seats does without.

    Cells of one customer have one table; the others keep each customer's table. Customers take turns by
    their place in the cell, all cells at once; where fewer than LONE cells are so long, the rest of each
    is seated by itself. Each customer sees the seats of all others of its cell as they are then."""

    def __init__(self, counts: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator, names: np.ndarray | None = None):
        """names: the customers' tables as an earlier seating of these counts gave them out."""
        self.counts, self.discount, self.rng = counts, discount, rng
        self.many = np.flatnonzero(counts > 1)
        self.size = counts[self.many].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.by_size = np.argsort(-self.size, kind="stable")
        self.falling = -self.size[self.by_size]
        total = int(self.size.sum())
        if names is not None:
            self.table = (np.repeat(self.first, self.size) + names).astype(np.int32)
            self.seats = np.bincount(self.table, minlength=total).astype(np.int32)
            self.n = np.add.reduceat(self.seats > 0, self.first).astype(np.int64) if total else np.zeros(0, np.int64)
            return
        self.n = np.ones(len(self.many), np.int64)  # tables of each cell
        self.table = np.zeros(total, np.int32)  # customers' tables, named by a place of their cell
        self.seats = np.zeros(total, np.int32)  # customers of a table, at its name
        self.table[self.first] = self.first
        self.seats[self.first] = 1
        self._turns(pull[self.many], 1, False)

    def sweep(self, pull: np.ndarray) -> None:
        """Every customer of every cell leaves and is seated again, one after the other."""
        self._turns(pull[self.many], 0, True)

    def _turns(self, a: np.ndarray, k: int, leave: bool) -> None:
        while len(cells := self.by_size[: np.searchsorted(self.falling, -k)]) >= LONE:
            self._turn(cells, a[cells], k, leave)
            k += 1
        for cell in cells.tolist():
            self._rest(cell, float(a[cell]), k, leave)

    def _turn(self, cells: np.ndarray, a: np.ndarray, k: int, leave: bool) -> None:
        """The customer at place k of each cell takes a seat."""
        rng, first = self.rng, self.first[cells]
        who = first + k
        others = self.size[cells] - 1 if leave else np.full(len(cells), k)
        if leave:
            old = self.table[who]
            self.seats[old] -= 1
            self.n[cells] -= self.seats[old] == 0
        n = self.n[cells]
        new = (rng.random(len(cells)) * (a + others - self.discount * n) < a) | (n == 0)
        to = np.zeros(len(cells), np.int64)
        left = np.flatnonzero(~new)
        while len(left):  # the table of a random other, kept with (customers - discount) / customers
            other = (rng.random(len(left)) * others[left]).astype(np.int64)
            other += leave & (other >= k)
            table = self.table[first[left] + other]
            seats = self.seats[table]
            kept = rng.random(len(left)) * seats < seats - self.discount
            to[left[kept]] = table[kept]
            left = left[~kept]
        opened = np.flatnonzero(new)
        to[opened] = self._free(cells[opened]) if leave else who[opened]
        self.n[cells[opened]] += 1
        self.table[who] = to
        self.seats[to] += 1

    def _rest(self, cell: int, a: float, k: int, leave: bool) -> None:
        """The customers of one cell from place k on take seats."""
        first, size, d, n = int(self.first[cell]), int(self.size[cell]), self.discount, int(self.n[cell])
        draw = random.Random(int(self.rng.integers(1 << 62))).random
        own = slice(first, first + size)
        table, seats = (self.table[own] - first).tolist(), self.seats[own].tolist()
        free = [t for t in range(size) if not seats[t]] if leave else []
        for at in range(k, size):
            others = size - 1 if leave else at
            if leave:
                old = table[at]
                seats[old] -= 1
                if not seats[old]:
                    n -= 1
                    free.append(old)
            if n == 0 or draw() * (a + others - d * n) < a:
                to = free.pop() if leave else at
                n += 1
            else:
                while True:
                    other = int(draw() * others)
                    to = table[other + (leave and other >= at)]
                    if draw() * seats[to] < seats[to] - d:
                        break
            table[at] = to
            seats[to] += 1
        self.table[own], self.seats[own], self.n[cell] = np.array(table) + first, seats, n

    def names(self) -> np.ndarray:
        """Each customer's table, counted from the first place of its cell."""
        return self.table - np.repeat(self.first, self.size)

    def _free(self, cells: np.ndarray) -> np.ndarray:
        """An unused table name of each cell: it has as many names as customers, and one is standing."""
        out = self.first[cells].copy()
        left = np.arange(len(cells))
        for _ in range(32):
            left = left[self.seats[out[left]] > 0]
            if not len(left):
                return out
            own = cells[left]
            out[left] = self.first[own] + (self.rng.random(len(left)) * self.size[own]).astype(np.int64)
        for k in left[self.seats[out[left]] > 0]:
            names = slice(self.first[cells[k]], self.first[cells[k]] + self.size[cells[k]])
            out[k] = self.first[cells[k]] + int(np.argmin(self.seats[names]))
        return out

    def tables(self) -> np.ndarray:
        out = np.minimum(self.counts, 1)
        out[self.many] = self.n
        return out


@functools.lru_cache
def log_stirling(discount: float, limit: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weights of all seatings of n customers at t tables."""
    out = np.full((limit + 1, limit + 1), -np.inf)
    out[1, 1] = 0
    for n in range(1, limit):
        t = np.arange(1, n + 1)
        out[n + 1, t] = out[n, t] + np.log(n - discount * t)
        out[n + 1, t + 1] = np.logaddexp(out[n + 1, t + 1], out[n, t])
    return out


def draw_tables(customers: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells of customers, given their weights of a new table, from their exact law."""
    law, out, drawn = log_stirling(discount, BLOCK), np.ones(len(customers), np.int64), rng.random(len(customers))
    large = np.flatnonzero(customers > BLOCK)
    if len(large):
        out[large] = _draw_many(customers[large].astype(float), a[large], discount, drawn[large])
    order = np.argsort(-customers, kind="stable")[len(large) :]
    falling = -customers[order]
    at = 0
    while at < len(order):
        most = -int(falling[at])
        end = min(at + max(1, (1 << 18) // most), int(np.searchsorted(falling, -(most * 3 // 4), "right")))
        own = order[at : max(end, at + 1)]
        x = law[customers[own], 1 : most + 1] + np.log(a[own])[:, None] * np.arange(1, most + 1)
        x = np.exp(x - x.max(axis=1, keepdims=True)).cumsum(axis=1)
        out[own] += (x < drawn[own, None] * x[:, -1:]).sum(axis=1)
        at += len(own)
    return out


def _draw_many(n: np.ndarray, a: np.ndarray, discount: float, drawn: np.ndarray) -> np.ndarray:
    """draw_tables for cells too large for log_stirling; drawn: where in its law each falls, 0 to 1.

    The Stirling number of n and t is n! / t! times the coefficient of z^n in (F(z) / discount)^t, where
    F(z) = 1 - (1 - z)^discount. So the law of t is that of Poisson(F(x) a / discount) times the integral of
    (F(z) / F(x))^t z^(-n-1) along a contour through x, which _contour gives as a sum over some points. Points
    serve all t of a cell; they are summed as products of steps of one and of many tables."""
    q, x = _saddles(n, a, discount)
    reach = -np.expm1(discount * np.log(q))  # F(x), where the mean is n at this many tables:
    mean = reach * a / discount
    each = x * discount * q ** (discount - 1) / reach
    variance = np.maximum(each + x * x * discount * (1 - discount) * q ** (discount - 2) / reach - each * each, 0)
    half = 9 * np.sqrt(mean * variance / (variance + each * each)) + 20
    low = np.clip(np.floor(mean - half), 1, n)
    width = (np.minimum(np.ceil(mean + half), n) - low + 1).astype(np.int64)
    out = np.zeros(len(n), np.int64)
    for far in (False, True):
        cells = np.flatnonzero((q > 0.3) == far)
        cells = cells[np.argsort(-width[cells], kind="stable")]
        at = 0
        while at < len(cells):
            step = int(np.ceil(np.sqrt(width[cells[at]])))
            own = cells[at : at + max(1, (1 << 17) // (POINTS * step))]
            weight, power, shift = _contour(n[own], q[own], x[own], reach[own], variance[own] * np.maximum(low[own], 1), discount, far)
            coarse = weight[:, None, :] * np.exp(power[:, None, :] * (low[own, None] + step * np.arange(step))[:, :, None])
            fine = np.exp(power[:, :, None] * np.arange(step))
            part = (coarse @ fine).real.reshape(len(own), -1)
            t = low[own, None] + np.arange(step * step)
            factors = np.log(t)
            factors[:, 0] = 0  # t! / low! will do
            log = t * (np.log(mean[own]) + shift)[:, None] - factors.cumsum(axis=1)
            log[np.arange(step * step) >= width[own, None]] = -np.inf
            p = (np.exp(log - log.max(axis=1, keepdims=True)) * np.maximum(part, 0)).cumsum(axis=1)
            out[own] = low[own] + np.minimum((p < drawn[own, None] * p[:, -1:]).sum(axis=1), width[own] - 1)
            at += len(own)
    return out


def _saddles(n: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(1 - x, x), where a x (1 - x)^(discount - 1) = n: at x the likeliest tables have n customers."""
    left, right = np.full(len(n), -600.0), np.full(len(n), 60.0)  # of log((1 - x) / x)
    for _ in range(70):
        middle = (left + right) / 2
        log_x, log_q = -np.logaddexp(0, middle), -np.logaddexp(0, -middle)
        more = np.log(a) + log_x - (1 - discount) * log_q > np.log(n)
        left, right = np.where(more, middle, left), np.where(more, right, middle)
    return np.exp(-np.logaddexp(0, -left)), np.exp(-np.logaddexp(0, left))


def _log1p(z: np.ndarray) -> np.ndarray:
    """log(1 + z): numpy's loses the digits of small complex z."""
    return 0.5 * np.log1p(z.real * (2 + z.real) + z.imag**2) + 1j * np.arctan2(z.imag, 1 + z.real)


def _contour(n, q, x, reach, spread, discount: float, far: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, logarithms of F(z) / F(x'), log F(x') / F(x)) at the points z of a contour through x'.

    z = exp(-s / n). Near the branch point z = 1, s runs on a hyperbola around the negative axis, open so far
    that neither exp(s) nor F grows along it; x' is at s = 2 at least. Far from it |z| = x: an arc of 9 standard
    deviations, by the least variance (spread) of a cell's tables, or the circle. Of both only the upper half is
    taken, the lower one is its mirror."""
    k = np.arange(POINTS) + 0.5
    if far:
        start = np.log(x)
        y = start[:, None] + 1j * k * (np.minimum(np.pi, 9 / np.sqrt(np.maximum(spread, 1e-9))) / POINTS)[:, None]
        weight = np.exp(-1j * n[:, None] * y.imag)
    else:
        open_by = min(np.pi / 8, np.pi / 2 * (1 / discount - 1))
        s = np.maximum(-n * np.log1p(-q), 2)
        scale = s / (1 - np.sin(open_by))
        angle = k * (np.minimum(4.2, 13 / np.sqrt(s)) / POINTS)[:, None]
        path = scale[:, None] * (1 - np.sin(open_by) * np.cosh(angle) + 1j * np.cos(open_by) * np.sinh(angle))
        weight = np.exp(path - s[:, None]) * scale[:, None] * (np.cos(open_by) * np.cosh(angle) + 1j * np.sin(open_by) * np.sinh(angle))
        start, y = -s / n, -path / n[:, None]
    if far:
        at = np.log(reach)
        power = np.log(-np.expm1(discount * _log1p(-np.exp(y))))
    else:
        at = np.log(-np.expm1(discount * np.log(-np.expm1(start))))
        power = _log1p(-np.exp(discount * np.log(-np.expm1(y))))
    return weight, power - at[:, None], at - np.log(reach)


class Seats:
    """The tables of all cells of a bucket; lone customers have one each."""

    def __init__(self, counts: np.ndarray, pull: np.ndarray | None, discount: float, rng: np.random.Generator, state: np.ndarray | None = None):
        """state: what state() gave for these counts; else the customers are seated by pull."""
        self.counts, self.discount, self.rng = counts, discount, rng
        self.many = np.flatnonzero(counts > 1)
        self.n = state
        if state is None:
            self.sweep(pull)

    def sweep(self, pull: np.ndarray) -> None:
        """Every customer of every cell leaves and is seated again."""
        self.n = draw_tables(self.counts[self.many], pull[self.many], self.discount, self.rng)

    def state(self) -> np.ndarray:
        return self.n

    def tables(self) -> np.ndarray:
        out = np.minimum(self.counts, 1)
        out[self.many] = self.n
        return out


class Bucket:
    """The words of a bucket, their cells (word and context) and what is known of contexts' and words' totals."""

    PARTS = ("words", "width", "keys", "cell_context", "counts", "seated", "at", "c_context", "t_context", "w_at", "c_split", "t_split", "p_split", "parent")

    def __init__(self, split_of, buckets: int, body: bytes | None = None):
        self.split_of, self.buckets, self.samples = split_of, buckets, []
        if body is not None:
            got = _get(body)
            for name, x in zip(self.PARTS, got):
                setattr(self, name, x)
            rest = got[len(self.PARTS) :]
            self.samples = [rest[k : k + 4] for k in range(0, len(rest), 4)]
            self.words, self.keys = _sums(self.words), _sums(self.keys)
            self._index()

    def _index(self) -> None:
        self.word = np.repeat(np.arange(len(self.words)), self.width)
        self.c_word = np.bincount(self.word, self.counts, len(self.words)).astype(np.int64)
        self.split = np.flatnonzero(self.split_of(self.words) > 1)
        self.single = np.ones(len(self.words), bool)
        self.single[self.split] = False
        self.routes = []  # of contexts, then of split words: (order by owner, edges of the owners)
        for keys in (self.keys, self.words[self.split]):
            owner = (textbytes.mix(keys) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            self.routes.append((order, np.searchsorted(owner[order], np.arange(self.buckets + 1))))

    def body(self) -> bytes:
        own = {name: getattr(self, name) for name in self.PARTS} | {"words": _gaps(self.words), "keys": _gaps(self.keys)}
        return _put(*own.values(), *(x for sample in self.samples for x in sample))

    def open(self, bodies, rng: np.random.Generator) -> None:
        """Merge the cells that tasks sent and seat their customers by this bucket's own totals."""
        got = [_unpack(x) for x in bodies]
        self.words, self.keys = (np.unique(np.concatenate([g[k] for g in got])) for k in (0, 2))
        cells = np.concatenate([(np.repeat(np.searchsorted(self.words, g[0]), g[1]) << 32) | np.searchsorted(self.keys, g[2])[g[3]] for g in got])
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first = _starts(cells)
        weights = np.add.reduceat(np.concatenate([g[4] for g in got])[order], first)
        use = weights > 0  # held-out tokens bring the words and contexts that are asked for later
        self.counts, cells = weights[use], cells[first[use]]
        self.width = np.bincount(cells >> 32, minlength=len(self.words))
        self.cell_context = cells & 0xFFFFFFFF
        none = np.zeros(0, np.int64)
        self.at = self.c_context = self.t_context = self.w_at = self.c_split = self.t_split = self.p_split = none
        self._index()
        ones = np.minimum(self.counts, 1)
        self.parent = np.minimum(self.c_word, 1)
        self.t_context, self.t_split, self.p_split = np.bincount(self.cell_context, ones, len(self.keys)), np.bincount(self.word, ones, len(self.words))[self.split], self.parent[self.split]
        t_word, _ = self.word_totals(ones)
        types = max(int((self.c_word > 0).sum()), 1)
        self.seats = Seats(self.counts, self.pull(ones, ones, t_word, ones.sum(), types, types), DISCOUNT, rng)
        self._seat_parent(types, types, rng)

    def word_totals(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each word in all buckets, and in the parent, as of the last exchange."""
        t_word = np.bincount(self.word, tables, len(self.words)).astype(np.int64)
        parent = self.parent.copy()
        t_word[self.split], parent[self.split] = self.t_split, self.p_split
        return t_word, parent

    def pull(self, then: np.ndarray, now: np.ndarray, t_word: np.ndarray, all_tables: float, parents: float, types: float) -> np.ndarray:
        """Each cell's weight of a new table. then, now: the cells' tables at the last exchange and now;
        t_word and all_tables are of the last exchange."""
        more = now - then
        t_context = self.t_context + np.bincount(self.cell_context, more, len(self.keys))
        t_word = t_word + np.bincount(self.word, more, len(self.words))
        parent = self.parent.copy()
        parent[self.split] = self.p_split
        p_word = (np.maximum(t_word - DISCOUNT * parent, 0) + (STRENGTH + DISCOUNT * parents) / (types + 1)) / (STRENGTH + all_tables + more.sum())
        return (STRENGTH + DISCOUNT * t_context)[self.cell_context] * p_word[self.word]

    def _seat_parent(self, parents: float, types: float, rng: np.random.Generator) -> None:
        customers = np.bincount(self.word, self.seats.tables(), len(self.words)).astype(np.int64) * self.single
        base = np.full(len(customers), (STRENGTH + DISCOUNT * parents) / (types + 1))
        self.parent = Seats(customers, base, DISCOUNT, rng).tables()

    def sit(self, rng: np.random.Generator) -> None:
        self.seats = Seats(self.counts, None, DISCOUNT, rng, self.seated)

    def run(self, sweeps: int, sums, rng: np.random.Generator) -> None:
        all_tables, parents, types = sums
        then = self.seats.tables()
        t_word, _ = self.word_totals(then)
        for _ in range(sweeps):
            self.seats.sweep(self.pull(then, self.seats.tables(), t_word, all_tables, parents, types))
        self._seat_parent(parents, types, rng)

    def ask(self, first: bool) -> list[tuple[int, bytes]]:
        """(owner, message): this bucket's tables, and at first its customers, by context and by split word."""
        self.seated = self.seats.state()
        tables = self.seats.tables()
        own = [(self.keys, np.bincount(self.cell_context, self.counts, len(self.keys)), np.bincount(self.cell_context, tables, len(self.keys)), self.at)]
        own.append((self.words[self.split], self.c_word[self.split], np.bincount(self.word, tables, len(self.words))[self.split], self.w_at))
        out = []
        for o in range(self.buckets):
            parts = []
            for (keys, c, t, at), (order, edges) in zip(own, self.routes):
                mine = order[edges[o] : edges[o + 1]]
                parts += [_gaps(keys[mine]), c[mine], t[mine]] if first else [_gaps(at[mine]), t[mine]]
            if len(parts[0]) or len(parts[len(parts) // 2]):
                out.append((o, _put(*parts)))
        return out

    def hear(self, replies, first: bool) -> None:
        """replies: (owner, message)."""
        if first:
            self.at, self.c_context, self.t_context = (np.zeros(len(self.keys), np.int64) for _ in range(3))
            self.w_at, self.c_split, self.t_split, self.p_split = (np.zeros(len(self.split), np.int64) for _ in range(4))
        names = (("at", "c_context", "t_context"), ("w_at", "c_split", "t_split", "p_split")) if first else (("t_context",), ("t_split", "p_split"))
        for o, message in replies:
            got = iter(_get(message))
            for group, (order, edges) in zip(names, self.routes):
                mine = order[edges[o] : edges[o + 1]]
                for name in group:
                    x = next(got)
                    getattr(self, name)[mine] = _sums(x).astype(np.int64) if name in ("at", "w_at") else x

    def take_sample(self) -> None:
        tables = self.seats.tables()
        self.samples.append([tables[self.seats.many], self.t_context.copy(), *self.word_totals(tables)])


def _answer(messages, first: bool, base: float, rng: np.random.Generator) -> tuple[list[tuple[int, bytes]], int, int]:
    """What an owner tells each bucket that asked: total customers (at first) and tables of its contexts and
    split words, and these words' tables in the parent. Also the sums of those tables and of such words."""
    got = [(source, _get(body)) for source, body in messages]
    half = 3 if first else 2
    replies: dict[int, list] = {source: [] for source, _ in got}
    parents = types = 0
    for start in (0, half):
        if first:
            keys = np.unique(np.concatenate([_sums(g[start]) for _, g in got]))
            places = [np.searchsorted(keys, _sums(g[start])) for _, g in got]
            size = len(keys)
        else:
            places = [_sums(g[start]).astype(np.int64) for _, g in got]
            size = max((int(x[-1]) + 1 for x in places if len(x)), default=0)
        totals = []
        for k in range(start + 1, start + half):
            total = np.zeros(size, np.int64)
            for at, (_, g) in zip(places, got):
                total[at] += g[k]  # a bucket names a key once
            totals.append(total)
        if start:
            totals.append(Seats(totals[-1], np.full(size, base), DISCOUNT, rng).tables())
            parents, types = int(totals[-1].sum()), int((totals[-2] > 0).sum())
        for at, (source, _) in zip(places, got):
            replies[source] += ([_gaps(at)] if first else []) + [total[at] for total in totals]
    return [(source, _put(*parts)) for source, parts in replies.items()], parents, types


def _rows(rows: list[tuple]) -> pa.Table:
    """A table of (bucket, kind, source, body, tables, parents, types)."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "kind", "source", "body", "tables", "parents", "types"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, seed: int = 7) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod folds is not held; null ids teach. Null texts are empty:
    one token, the end. base_score is the unigram score of the contract; score the model's log10
    probability of all tokens. A row that repeats another scores the same, and both teach."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(id_col, text).alias("key"), held_out.alias("held_out"), text.alias("text"))

    def survey(batches):
        slots = np.zeros(2 * SLOTS, np.int64)
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.zeros(batch.num_rows, np.int64)
            for row, end, tokens, _, bounds in _tokens(batch.column(2)):
                sizes[row:end] = np.diff(bounds)
                teach = np.repeat(~held[row:end], np.diff(bounds))
                slot = (tokens >> np.uint64(32)).astype(np.int64) & 0xFFFF
                slots[:SLOTS] += np.bincount(slot, minlength=SLOTS)
                slots[SLOTS:] += np.bincount(slot[teach], minlength=SLOTS)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), none.cast(pa.int32()), none.cast(pa.binary())], names=["key", "n_tokens", "chunk", "counts"])
        rows = common.bucket_rows(np.minimum(slots, 0xFFFFFFFF))
        none = pa.nulls(rows.num_rows).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, rows.column(0), rows.column(1)], names=["key", "n_tokens", "chunk", "counts"])

    seen = common.keep(texts.mapInArrow(survey, "key long, n_tokens long, chunk int, counts binary"))
    slots = common.fold_buckets(seen.where("chunk is not null"), 2 * SLOTS).astype(np.int64)
    train_tokens = int(slots[SLOTS:].sum())
    buckets = 1 + int(slots[:SLOTS].sum()) // BUCKET_TOKENS
    parts = np.maximum(1, -(-2 * slots[:SLOTS] * buckets // max(1, int(slots[:SLOTS].sum())))) if buckets > 1 else np.ones(SLOTS, np.int64)
    sent = spark.sparkContext.broadcast(parts)

    def split_of(words):
        # the slot is in bits 32 to 47, which the 48 bits kept in a bucket hold
        return sent.value[(words >> np.uint64(32)).astype(np.int64) & 0xFFFF]

    def by_bucket(words, contexts, last, source, merge):
        part = textbytes.mix(contexts) % split_of(words).astype(np.uint64)
        bucket = (textbytes.mix(words ^ textbytes.mix(part)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16), kind="stable") if buckets < 65536 else np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        own = [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b + 1] > edges[b]]
        yield from _rows([(b, CHUNK, source, _pack(words[x], contexts[x], last[x], merge), None, None, None) for b, x in own]).to_batches()

    def teach(batches):
        words, contexts, weights, waiting = [], [], [], 0
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for row, end, tokens, context, bounds in _tokens(batch.column(2)):
                words.append(tokens)
                contexts.append(context)
                weights.append(np.repeat(~held[row:end], np.diff(bounds)).astype(np.int64))
                waiting += len(tokens)
                if waiting > FLUSH:
                    yield from by_bucket(np.concatenate(words), np.concatenate(contexts), np.concatenate(weights), 0, True)
                    words, contexts, weights, waiting = [], [], [], 0
        if waiting:
            yield from by_bucket(np.concatenate(words), np.concatenate(contexts), np.concatenate(weights), 0, True)

    def told_of(bucket, state, first) -> pa.Table:
        asked = state.ask(first)
        sums = int(state.seats.tables().sum()), int(state.parent[state.single].sum()), int((state.c_word[state.single] > 0).sum())
        return _rows([(bucket, STATE, 0, state.body(), *sums)] + [(o, UP, bucket, message, None, None, None) for o, message in asked])

    def open_bucket(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        state = Bucket(split_of, buckets)
        state.open((x.as_py() for x in table["body"]), np.random.default_rng([seed, bucket, 0]))
        return told_of(bucket, state, True)

    def heard(table: pa.Table, step: int) -> Bucket:
        """The bucket's state, with the answers to what it sent after this step."""
        bodies = {kind: [(source, at) for at, (k, source) in enumerate(zip(table["kind"].to_pylist(), table["source"].to_pylist())) if k == kind] for kind in (STATE, REPLY)}
        state = Bucket(split_of, buckets, table["body"][bodies[STATE][0][1]].as_py())
        state.sit(np.random.default_rng([seed, table["bucket"][0].as_py(), step + 1]))
        state.hear(((o, table["body"][at].as_py()) for o, at in bodies[REPLY]), step == 0)
        if step > 1:
            state.take_sample()
        return state

    def answered(step: int, sums):
        """Kept answers of the owners after a step, and all buckets' sums of tables, of parents' and of words."""
        base = (STRENGTH + DISCOUNT * sums[1]) / (sums[2] + 1) if sums else DISCOUNT

        def answer(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            asked = sorted((source, at) for at, source in enumerate(table["source"].to_pylist()))
            replies, parents, types = _answer([(source, table["body"][at].as_py()) for source, at in asked], step == 0, base, np.random.default_rng([seed, bucket, step, 1]))
            return _rows([(source, REPLY, bucket, message, 0, parents if not k else 0, types if not k else 0) for k, (source, message) in enumerate(replies)])

        replies = common.keep(rows.where(F.col("kind") == UP).groupBy("bucket").applyInArrow(answer, ROWS))
        both = rows.select("tables", "parents", "types").union(replies.select("tables", "parents", "types"))
        return replies, tuple(float(x or 0) for x in both.agg(F.sum("tables"), F.sum("parents"), F.sum("types")).first())

    def after(step: int, sweeps: int, sums):
        def run(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            state = heard(table, step)
            state.run(sweeps, sums, state.seats.rng)
            return told_of(bucket, state, False)

        return run

    rows = common.keep(texts.mapInArrow(teach, ROWS).groupBy("bucket").applyInArrow(open_bucket, ROWS))
    replies, sums = answered(0, None)
    levels_of = []
    for step, sweeps in enumerate([BURN] + [BETWEEN] * SAMPLES):
        told, heard_of = rows, replies
        rows = common.keep(told.where(F.col("kind") == STATE).union(heard_of).groupBy("bucket").applyInArrow(after(step, sweeps, sums), ROWS))
        common.free(told, heard_of)
        replies, sums = answered(step + 1, sums)
        if step:
            levels_of.append(sums)
    types = sums[2]

    def score_rows(batches):
        words, contexts, docs, keys, waiting, texts_n = [], [], [], [], 0, 0
        number = TaskContext.get().partitionId() << 32

        def flush():
            """A row for each bucket, and one with the texts' keys: only their places go to the buckets."""
            yield from by_bucket(np.concatenate(words), np.concatenate(contexts), np.concatenate(docs), number, False)
            yield from _rows([(number % buckets, KEYS, number, np.concatenate(keys).tobytes(), None, None, None)]).to_batches()

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for row, end, tokens, context, bounds in _tokens(batch.column(2)):
                for at in range(row, end, FLUSH_TEXTS // 2):
                    stop = min(at + FLUSH_TEXTS // 2, end)
                    if waiting > FLUSH or texts_n + stop - at > FLUSH_TEXTS:
                        yield from flush()
                        words, contexts, docs, keys, waiting, texts_n = [], [], [], [], 0, 0
                        number += 1
                    part = slice(bounds[at - row], bounds[stop - row])
                    words.append(tokens[part])
                    contexts.append(context[part])
                    docs.append(np.repeat(np.arange(texts_n, texts_n + stop - at), np.diff(bounds[at - row : stop - row + 1])))
                    keys.append(key[at:stop])
                    waiting += len(words[-1])
                    texts_n += stop - at
        if waiting:
            yield from flush()

    def score(table: pa.Table) -> pa.Table:
        kinds, flushes = table["kind"].to_pylist(), table["source"].to_pylist()
        keys = [[flushes[at], None, None, None, None, table["body"][at].as_py()] for at, k in enumerate(kinds) if k == KEYS]
        levels = []
        if STATE in kinds:
            state = heard(table, SAMPLES + 1)
            c_word = state.c_word.copy()
            c_word[state.split] = state.c_split
            cell_key = (state.word << 32) | state.cell_context
            for (n_many, t_context, t_word, parent), (all_tables, parents, _) in zip(state.samples, levels_of):
                cell_tables = np.minimum(state.counts, 1)
                cell_tables[state.seats.many] = n_many
                low = (t_word - DISCOUNT * parent + (STRENGTH + DISCOUNT * parents) / (types + 1)) / (STRENGTH + all_tables)
                levels.append((state.counts - DISCOUNT * cell_tables, low, STRENGTH + DISCOUNT * t_context))

        def row(flush, body):
            names, each, contexts, place, docs = _unpack(body)
            word = np.repeat(np.searchsorted(state.words, names), each)  # all are there: held-out texts were sent as well
            context = np.searchsorted(state.keys, contexts)[place]
            count = c_word[word]
            key = (word << 32) | context
            cell_at = np.minimum(np.searchsorted(cell_key, key), max(len(cell_key) - 1, 0))
            in_cell = cell_key[cell_at] == key if len(cell_key) else np.zeros(len(key), bool)
            p = np.zeros(len(key))
            for mass, low, fresh in levels:
                own = np.where(in_cell, mass[cell_at], 0.0) if len(cell_key) else 0.0
                p += (own + fresh[context] * low[word]) / (STRENGTH + state.c_context[context])
            live = np.flatnonzero(np.bincount(docs))
            known, base, total = (np.bincount(docs, x)[live] for x in (count > 0, np.log10(count + 0.1), np.log10(p / SAMPLES)))
            return [flush, live.astype(np.uint16).tobytes(), known.astype(np.uint32).tobytes(), base.tobytes(), total.tobytes(), None]

        out = [row(flushes[at], table["body"][at].as_py()) for at, k in enumerate(kinds) if k == CHUNK] + keys
        return pa.table({name: pa.array([r[k] for r in out], pa.binary() if k else pa.int64()) for k, name in enumerate(("flush", "docs", "known", "base", "score", "keys"))})

    def gather(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(next(x for x in table["keys"].to_pylist() if x is not None), np.int64)
        known, base, total = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for docs, k, b, s in zip(*(table[c].to_pylist() for c in ("docs", "known", "base", "score"))):
            if docs is not None:
                at = np.frombuffer(docs, np.uint16)
                known[at] += np.frombuffer(k, np.uint32)
                base[at] += np.frombuffer(b)
                total[at] += np.frombuffer(s)
        return pa.table({"key": keys, "n_known": known, "base": base, "score": total})

    asked = texts.mapInArrow(score_rows, ROWS).union(rows.where(F.col("kind") == STATE)).union(replies)
    scored = asked.groupBy("bucket").applyInArrow(score, "flush long, docs binary, known binary, base binary, score binary, keys binary")
    scored = scored.groupBy("flush").applyInArrow(gather, "key long, n_known long, base double, score double")
    sums = scored.groupBy("key").agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    sizes = seen.where("chunk is null").groupBy("key").agg(F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("rows"))
    told = sizes.join(sums, "key", "left").select("key", "n_tokens", (F.coalesce("n_known", F.lit(0)) / F.col("rows")).cast("long").alias("n_known"), (F.col("base") / F.col("rows") - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + 0.1 * (types + 1))))).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("key"), held_out.alias("held_out"))
    return own.join(told, "key").select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
