"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are rotated to their principal axes, which keeps distances. cosine >= t is distance <= eps =
sqrt(2 - 2t). Vectors are sorted by label and grid cell (side eps) on the leading axes and cut into
blocks, each with its interval of labels and its bounding box on those axes. Sequence intervals are joined
recursively: two intervals whose labels do not overlap or whose boxes are further apart than eps are
skipped, single blocks are paired. Of the later block of a pair only the vectors within eps of the other's
box travel, to where the other block is. A pair is joined the same way down to small leaves, where cosines
are computed in double precision from the vectors as given.

Equal vectors of a label are one class with a multiplicity. A pair of blocks returns each class's number
of links and a spanning forest of the links found, never the links themselves: dense clusters cost rows in
proportion to their classes. The block size grows with the input, and a block may hold many labels, so the
boxes that are broadcast stay few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

AXES = 6
BLOCK_ROWS = 1024
MOST_BLOCKS = 65_536
LEAF = 64
SLACK = 1e-7
_BODY = ("labels", "reps", "counts", "vectors")
_BLOCK = "block long, first long, last long, lo array<double>, hi array<double>, " + ", ".join(f"{c} binary" for c in _BODY)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array<double> column of equal lengths, as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int, axes: int = AXES) -> np.ndarray:
    """The leading eigenvectors (width, axes) of the unit vectors' second moments, summed over all of them."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                u = _unit(x)
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        total = np.zeros(width * width)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = vectors.mapInArrow(moments, "m binary").repartition(8).mapInArrow(add, "m binary").collect()
    total = sum(np.frombuffer(r.m) for r in parts).reshape(width, width)
    return np.linalg.eigh(total)[1][:, ::-1][:, :axes]


class BoxTree:
    """Boxes of blocks in sequence order, with their intervals of labels, merged two by two, level after level."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.levels = [(lo, hi, first, last)]
        while len(lo) > 1:
            pairs = []
            for x, f in ((lo, np.minimum), (hi, np.maximum), (first, np.minimum), (last, np.maximum)):
                left, right = x[::2], x[1::2]
                pairs.append(f(left, np.concatenate([right, x[-1:]]) if len(x) % 2 else right))
            lo, hi, first, last = pairs
            self.levels.append((lo, hi, first, last))

    def before(self, k: int, eps: float) -> np.ndarray:
        """The blocks before k that share a label with block k and whose boxes are within eps of its box."""
        own_lo, own_hi, own_first, own_last = (x[k] for x in self.levels[0])
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            lo, hi, first, last = self.levels[level]
            nodes = nodes[(nodes < len(lo)) & (nodes << level < k)]
            nodes = nodes[(first[nodes] <= own_last) & (last[nodes] >= own_first)]
            nodes = nodes[_apart(lo[nodes], hi[nodes], own_lo, own_hi) <= eps * eps]
            if level:
                nodes = np.concatenate([nodes * 2, nodes * 2 + 1])
        return np.sort(nodes)


def _apart(lo, hi, other_lo, other_hi) -> np.ndarray:
    """Squared distances of boxes (or points) from a box."""
    gap = np.maximum(0, np.maximum(lo - other_hi, other_lo - hi))
    return (gap * gap).sum(axis=-1)


def join_blocks(x: np.ndarray, y: np.ndarray, zx: np.ndarray, zy: np.ndarray, lx: np.ndarray, ly: np.ndarray, cosine: float, same: bool):
    """(rows of x, rows of y) of one label with cosine or more, leaf after leaf; x and y are unit rows in the
    order of their labels lx, ly and grid cells, zx and zy their leading coordinates. With same only i < j come."""
    eps = math.sqrt(2 - 2 * cosine) + SLACK
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a or lx[a] > ly[d - 1] or lx[b - 1] < ly[c]:
            continue
        if _apart(zx[a:b].min(axis=0), zx[a:b].max(axis=0), zy[c:d].min(axis=0), zy[c:d].max(axis=0)) > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero((x[a:b] @ y[c:d].T >= cosine) & (lx[a:b, None] == ly[c:d]))
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", one_task: int = 1 << 20) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Only vectors of one label, not null, and one length are compared; labels that are no whole numbers are
    compared by a 64-bit hash. Null, empty and zero vectors, those
    with a null, NaN or infinite component, and rows with a null id or label link with nothing. A row that
    repeats an id with the same vector is the same vector, not another one. Other columns are not read."""
    spark = vectors.sparkSession
    whole = isinstance(vectors.schema[label_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    infinite = float("inf")
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)) & F.exists("v", lambda c: c != 0)
    own = own.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = own.where("sound").select("id", "label", "v", F.size("v").alias("width"), F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(9), "v", "label").alias("h2"))
    members = common.keep(keyed.groupBy("h1", "h2", "id").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.first("width").alias("width")))
    classes = common.keep(members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"), F.first("width").alias("width")))
    found, forest = [], []
    for (width,) in classes.select("width").distinct().collect():  # one, unless the table mixes kinds of vectors
        part = classes.where(F.col("width") == width)
        out = _join(spark, part, width, cosine)
        found.append(out.where("other is null").select("rep", "links"))
        forest.append(out.where("other is not null").select("rep", "other"))
    if not found:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links, edges = found[0], forest[0]
    for more_links, more_edges in zip(found[1:], forest[1:]):
        links, edges = links.union(more_links), edges.union(more_edges)
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = common.components(edges, one_task).withColumnRenamed("node", "rep")
    told = classes.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(whole, "rep", "left")
    told = told.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component"))
    rows = own.select("id", F.when(F.col("sound"), F.xxhash64("label", "v")).alias("h1"), F.when(F.col("sound"), F.xxhash64(F.lit(9), "v", "label")).alias("h2"))
    out = rows.join(told, ["h1", "h2"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _join(spark, classes: DataFrame, width: int, cosine: float) -> DataFrame:
    """(rep, links, other): links of rep in a pair of blocks where other is null, else an edge of the forest."""
    axes = min(AXES, width)
    eps = math.sqrt(2 - 2 * cosine) + SLACK
    basis = spark.sparkContext.broadcast(principal_axes(classes.select("v"), width, axes))
    rows = max(BLOCK_ROWS, classes.count() // MOST_BLOCKS)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(3))
            cells = np.floor(_unit(x) @ basis.value / eps).astype(np.int32) if len(x) else np.zeros((0, axes), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(axes)]], names=["rep", "n", "label", "v", *[f"c{k}" for k in range(axes)]])

    cells = [f"c{k}" for k in range(axes)]
    placed = classes.select("rep", "n", "label", "v").mapInArrow(place, "rep long, n long, label long, v array<double>, " + ", ".join(f"{c} int" for c in cells))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "label", *cells, "rep").sortWithinPartitions("label", *cells, "rep")

    def cut(batches):
        base, held = TaskContext.get().partitionId() << 32, None

        def block(some):
            nonlocal base
            base += 1
            x = _matrix(some["v"].combine_chunks())
            z, label = _unit(x) @ basis.value, some["label"].to_numpy()
            body = (label, some["rep"].to_numpy(), some["n"].to_numpy(), x)
            told = [base, int(label[0]), int(label[-1]), z.min(axis=0).tolist(), z.max(axis=0).tolist(), *(part.tobytes() for part in body)]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.float64())] * 2 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(told, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            while held.num_rows >= rows:
                yield block(held.slice(0, rows))
                held = held.slice(rows)
        if held is not None and held.num_rows:
            yield block(held)

    blocks = common.keep(ordered.mapInArrow(cut, _BLOCK))
    boxes = blocks.select("block", "first", "last", "lo", "hi").orderBy("block").collect()  # at most MOST_BLOCKS and one a partition more
    names = np.array([b.block for b in boxes], np.int64)
    tree = BoxTree(*(np.array([b[c] for b in boxes]).reshape(len(boxes), -1) for c in ("lo", "hi")), *(np.array([b[c] for b in boxes], np.int64) for c in ("first", "last")))
    shared = spark.sparkContext.broadcast((names, tree))

    def body_of(row, suffix: str = ""):
        """(labels, reps, counts, unit vectors, their coordinates) of a block's row."""
        label, rep, n = (np.frombuffer(row[c + suffix], np.int64) for c in _BODY[:3])
        x = _unit(np.frombuffer(row["vectors" + suffix]).reshape(-1, width))
        return label, rep, n, x, x @ basis.value

    def guests(batches):
        """Each block's vectors that are within eps of an earlier block's box, for that block."""
        names, tree = shared.value
        lo, hi, first, last = tree.levels[0]
        for batch in batches:
            for row in batch.to_pylist():
                k = int(np.searchsorted(names, row["block"]))
                label, rep, n, _, z = body_of(row)
                x = np.frombuffer(row["vectors"]).reshape(-1, width)
                for host in tree.before(k, eps):
                    use = np.flatnonzero((label >= first[host]) & (label <= last[host]) & (_apart(z, z, lo[host], hi[host]) <= eps * eps))
                    if len(use):
                        told = (label[use], rep[use], n[use], x[use])
                        yield pa.RecordBatch.from_arrays([pa.array([names[host]], pa.int64()), *[pa.array([part.tobytes()], pa.binary()) for part in told]], names=["block", *(f"{c}_b" for c in _BODY)])

    def link(batches):
        """Links of rows with a block and its guest; without a guest, the block's own."""
        for batch in batches:
            for row in batch.to_pylist():
                same = "reps_b" not in row
                label_a, ra, na, x, zx = own = body_of(row)
                label_b, rb, nb, y, zy = own if same else body_of(row, "_b")
                la, lb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
                ea, eb, waiting = [], [], 0
                for i, j in join_blocks(x, y, zx, zy, label_a, label_b, cosine, same):
                    np.add.at(la, i, nb[j])
                    np.add.at(lb, j, na[i])
                    ea.append(ra[i])
                    eb.append(rb[j])
                    waiting += len(i)
                    if waiting > 1 << 18:
                        node, root = common.local_components(np.concatenate(ea), np.concatenate(eb))
                        ea, eb, waiting = [node[node != root]], [root[node != root]], 0
                rep, links, other = [ra[la > 0], rb[lb > 0]], [la[la > 0], lb[lb > 0]], []
                if ea:
                    node, root = common.local_components(np.concatenate(ea), np.concatenate(eb))
                    rep.append(node[node != root])
                    links.append(np.zeros(len(rep[-1]), np.int64))
                    other = root[node != root]
                plain = len(rep[0]) + len(rep[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rep)), pa.array(np.concatenate(links)), pa.concat_arrays([pa.nulls(plain, pa.int64()), pa.array(np.asarray(other, np.int64))])], names=["rep", "links", "other"])

    found = "rep long, links long, other long"
    bodies = blocks.select("block", *_BODY)
    visits = bodies.mapInArrow(guests, "block long, " + ", ".join(f"{c}_b binary" for c in _BODY))
    out = common.keep(bodies.repartition(parts, "block").mapInArrow(link, found).union(visits.join(bodies, "block").mapInArrow(link, found)))
    common.free(blocks)
    return out


def op1_epsilon_join(spark, sf_dir: str) -> DataFrame:
    """embeddings at cosine 0.98 within a label: vec_id, n_links, component_id, kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE own AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM own a JOIN own b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM own UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
       coalesce((SELECT min(b) FROM reach WHERE reach.a = e.vec_id), e.vec_id) AS component_id,
       e.vec_id = coalesce((SELECT min(b) FROM reach WHERE reach.a = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""
