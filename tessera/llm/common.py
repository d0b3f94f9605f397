"""What several operators share: kept tables, fixed-size counters and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, a
    temporary folder of a single-machine session."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _local[app], True)
    return f"file://{_local[app]}"


def small_batches(spark: SparkSession, rows: int = 2000, read: int = 512) -> None:
    """Send texts to Python workers in batches of fewer rows than the session's default of 10000: a batch
    is held whole on both sides. The Parquet reader's batches get fewer rows than its default of 4096: one
    of texts is an array of many megabytes, for which the heap grows. Smaller settings of the session stay."""
    for name, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.parquet.columnarReaderBatchSize", "4096", read)):
        if int(spark.conf.get(name, usual)) > most or int(spark.conf.get(name, usual)) <= 0:
            spark.conf.set(name, str(most))


MARK_WORDS = 17  # log2 of the 64-bit words in the bitmap of without()
MODELS: dict = {}  # what the tasks of one operator keep in a worker from partition to partition


def tidy(task, keeps: bool = False):
    """task, for mapInArrow, so that memory it has freed goes back to the system when a partition begins and
    ends: Python workers live on from stage to stage, and what they hold idly counts against their executor.
    A task that does not keep MODELS drops those that another operator has left in its worker."""

    def run(batches):
        if not keeps:
            _drop_models()
        trim()
        yield from task(batches)
        trim()

    return run


def _drop_models() -> None:
    MODELS.clear()  # by a function of this module: a task's own globals are a copy of the driver's


def trim() -> None:
    """Give memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it from there: cuts the lineage, survives lost executors,
    and gives every later reader the same rows. The files go with free(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    # Spark deletes a shuffle's files when the plan that wrote them is collected; this one has ended
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def free(*kept: DataFrame) -> None:
    """Delete the files of frames as keep() returned them. Nothing that is still to run may read them."""
    for frame in kept:
        path = _paths.pop(id(frame), None)
        if path:
            _forget(frame.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def join_hot(rows: DataFrame, told: DataFrame, keys: list[str], size: str, total: int, hot: int = 10_000) -> DataFrame:
    """rows with the columns of told (kept; one row a key, size says how many rows have it), inner by keys.

    Keys of more than total / hot rows are at most hot many: these are broadcast, so that their rows stay
    where they are; the others meet by a shuffle in which no key has more rows than that."""
    many = told.where(F.col(size) > total // hot)
    spread = rows.join(F.broadcast(many), keys)
    return spread.unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(told.where(F.col(size) <= total // hot), keys))


def apart(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose id is surely not in the only column of ids (kept; longs), and the others, few
    more than the rows of these ids. Null is an id as well. The hashes of ids mark a bitmap of fixed size,
    which is broadcast, so no row of docs is shuffled."""
    own = ids.columns[0]
    word = lambda c: F.shiftrightunsigned(F.xxhash64(c.cast("long")), 64 - MARK_WORDS)
    bit = lambda c: F.xxhash64(c.cast("long")).bitwiseAND(F.lit(63))
    marks = ids.select(word(ids[own]).alias("word"), bit(ids[own]).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
    hit = (word(docs[id_col]) == marks["word"]) & (F.getbit(marks["bits"], bit(docs[id_col]).cast("int")) == 1)
    return docs.join(F.broadcast(marks), hit, "left_anti"), docs.join(F.broadcast(marks), hit, "left_semi")


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id, null or not, is in the only column of gone (kept; longs). Only rows that
    may go are shuffled and compared by the id itself; the others stay where they are."""
    stay, unsure = apart(docs, gone, id_col)
    return stay.union(unsure.join(gone, docs[id_col].eqNullSafe(gone[gone.columns[0]]), "left_anti"))


def fold_buckets(rows: DataFrame, size: int, chunks: int = 16) -> np.ndarray:
    """Add up counters that tasks emit as rows (chunk int, counts binary of uint32). Only the sums, of a
    fixed size, come to the driver. Two levels, so that no task reads the parts of all tasks."""
    each = size // chunks

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_buffer(), np.uint32)
                if k in sums:
                    with np.errstate(over="ignore"):
                        sums[k] = np.maximum(sums[k] + part, sums[k])
                else:
                    sums[k] = part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    some = rows.select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    whole = some.repartition(chunks, "chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(size, np.uint32)
    for k, part in whole.collect():
        out[k * each : (k + 1) * each] = np.frombuffer(part, np.uint32)
    return out


def bucket_rows(counts: np.ndarray, chunks: int = 16) -> pa.RecordBatch:
    """The rows that fold_buckets adds up."""
    parts = counts.astype(np.uint32).reshape(chunks, -1)
    live = [k for k in range(chunks) if parts[k].any()]
    return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([parts[k].tobytes() for k in live], pa.binary())], names=["chunk", "counts"])


def hash_filter(ids: DataFrame, bits: int = 23) -> np.ndarray:
    """A fixed-size bitmap (bool array of 2**bits) of the hashes in the only column of ids: no false negatives."""

    def mark(batches):
        packed = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            own = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            if len(own):
                edge = np.flatnonzero(np.diff(own >> 3, prepend=-1))
                packed[own[edge] >> 3] |= np.bitwise_or.reduceat((128 >> (own & 7)).astype(np.uint8), edge)
        yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], names=["bits"])

    def join(batches):
        out = None
        for batch in batches:
            for part in batch.column(0):
                part = np.frombuffer(part.as_buffer(), np.uint32)
                out = part.copy() if out is None else out | part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    marked = ids.mapInArrow(mark, "bits binary")
    out = np.zeros(1 << bits, bool)
    for (part,) in marked.repartition(8).mapInArrow(join, "bits binary").collect():
        out |= np.unpackbits(np.frombuffer(part, np.uint8)).view(bool)
    return out


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the graph with edges a-b, by hooking and pointer jumping."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        low = np.minimum(p, q)
        if (p == q).all():
            return nodes, nodes[root]
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while not np.array_equal(jump := root[root], root):
            root = jump


def _contract(batches):
    """Replace the edges of a partition by one edge per node, to its smallest local companion."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 1 << 21:
            nodes, roots = local_components(np.concatenate(a), np.concatenate(b))
            a, b = [nodes[nodes != roots]], [roots[nodes != roots]]
    if a:
        nodes, roots = local_components(np.concatenate(a), np.concatenate(b))
        other = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other], pa.int64()), pa.array(roots[other], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, one_task: int = 1 << 20) -> DataFrame:
    """(node, component_id) for every node of the edges (a long, b long): component_id is the smallest
    node reachable. Partitions contract their edges; then large-star and small-star rounds until each
    node hangs on its root. Contracted edges of at most one_task rows are finished in one task of that
    bounded size. Null ends and loops are left out; nodes without an edge do not appear."""
    pair = "a long, b long"
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = keep(edges.mapInArrow(_contract, pair))
    before = None
    while True:
        if before is not None:
            free(*before)
        count = edges.count()
        if count <= one_task:
            done = edges.coalesce(1).mapInArrow(_contract, pair) if count else edges
            return done.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(done.select("b", "b").distinct())
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        small = keep(small.where("a <> b").distinct())
        chained = small.select("a").intersect(small.select(F.col("b").alias("a"))).limit(1).count()
        many = small.groupBy("a").count().where("count > 1").limit(1).count()
        if not chained and not many:
            return small.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(small.select("b", "b").distinct())
        before, edges = (edges, small), keep(small.mapInArrow(_contract, pair))
