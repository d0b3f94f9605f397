"""Embedding whitening by Chan's merging of counts, means and centred scatters.

A partition holds its vectors a block at a time: a block's count, integer sums and scatter about its own mean are
merged into the partition's, and the partitions' by the same formula in treeReduce, so that nothing is ever
centred on a far point. Entries become integers first; sums are therefore exact, and so are the differences of
means that the formula needs. The driver sees one d x d state at a time and finds its eigenvectors. A second pass
projects every vector and merges the counts, means and scatters of what came out, whose covariance has to be the
identity.
"""

from __future__ import annotations

import decimal
import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Entries of a larger magnitude have no exact double once scaled and count as non-finite.
LARGEST = float(1 << 42)
BLOCK_BYTES = 4 << 20
#: An eigenvalue under this share of the trace is rounding, not variance.
NOISE = 1e-13


class Moments(NamedTuple):
    """n vectors, their exact sums (Python integers where they are integers) and the scatter about their mean."""

    n: int
    sums: list
    scatter: np.ndarray


class Whitening(NamedTuple):
    """The model: n, exact sums, components as rows, their eigenvalues (falling) and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def moments(x: np.ndarray) -> Moments:
    """Of one block of rows, integer or double. The mean's rounding is put right to first order."""
    n = len(x)
    if np.issubdtype(x.dtype, np.integer):
        base = x[0]
        near = x - base  # differences are small where the values are close
        sums = [n * int(b) + int(s) for b, s in zip(base, near.sum(axis=0, dtype=object if np.abs(near).max(initial=0) > (1 << 62) // n else np.int64))]
        y = near - np.array([float(s - n * int(b)) / n for b, s in zip(base, sums)])
    else:
        sums = [math.fsum(c) for c in x.T]
        y = x - np.array(sums) / n
    off = y.sum(axis=0)
    return Moments(n, sums, y.T @ y - np.outer(off, off) / n)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's pairwise formula; None is the empty state."""
    if a is None or b is None:
        return b if a is None else a
    n = a.n + b.n
    # means differ by (Sb na - Sa nb) / (na nb): exact up to the division for integers
    gap = np.array([float(t * a.n - s * b.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums)])
    return Moments(n, [s + t for s, t in zip(a.sums, b.sums)], a.scatter + b.scatter + np.outer(gap, gap) * (a.n * b.n / n))


def _sound(vector: str, size: int | None = None):
    """Whether a vector has entries, all finite and not too large."""
    c = F.col(vector)
    whole = F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)), F.lit(False))
    return whole if size is None else whole & (F.size(c) == size)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Scaled integers of a batch's vectors; all have d entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _step(d: int) -> int:
    """Rows of d entries in a block."""
    return max(1, BLOCK_BYTES // (8 * d))


def _tree(rows: DataFrame, block, d: int, exact: bool, step: int) -> Moments | None:
    """The moments of block(batch), d wide, over all batches, step rows at a time: by partition in the tasks, then by treeReduce with a
    fan-in of eight, so that neither a task nor the driver holds more than a few states. None without a row."""

    def part(batches):
        state = None
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                state = merged(state, moments(block(batch.slice(k, step))))
        if state is not None:
            told = [[state.n], [[str(s) if exact else s.hex() for s in state.sums]], [state.scatter.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(told, (pa.int64(), pa.list_(pa.string()), pa.binary()))], names=["n", "sums", "scatter"])

    read = int if exact else float.fromhex
    states = rows.mapInArrow(part, "n long, sums array<string>, scatter binary").rdd
    if not states.getNumPartitions():
        return None
    # a partition without rows is None, the formula's empty state
    own = states.mapPartitions(lambda it: [functools.reduce(merged, (Moments(r.n, [read(s) for s in r.sums], np.frombuffer(r.scatter).reshape(d, d)) for r in it), None)])
    return own.treeReduce(merged, max(2, math.ceil(math.log(max(2, own.getNumPartitions()), 8))))


def width(vectors: DataFrame, vector_col: str = "embedding") -> int | None:
    """The length that most sound vectors have (ties: the larger), None where there is none."""
    sizes = vectors.where(_sound(vector_col)).groupBy(F.size(vector_col).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0].d if top else None


def fit(vectors: DataFrame, d: int, vector_col: str = "embedding") -> Whitening | None:
    """The model over all sound vectors of d entries; None where there is none."""
    rows = vectors.where(_sound(vector_col, d)).select(F.col(vector_col).cast("array<double>").alias("v"))
    state = _tree(rows, lambda batch: _matrix(batch.column(0), d), d, True, _step(d))
    if state is None:
        return None
    values, components = np.linalg.eigh(state.scatter / state.n)
    return Whitening(state.n, state.sums, components.T[::-1], values[::-1], float(np.trace(state.scatter)) / state.n)


def _projection(model: Whitening, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d x k matrix onto the first k components over their deviations, the integer and the rest of the mean)."""
    low = [s // model.n for s in model.sums]
    rest = np.array([(s - model.n * q) / model.n for s, q in zip(model.sums, low)])
    live = model.values[:k] > NOISE * model.trace
    scale = np.where(live, 1 / np.sqrt(np.where(live, model.values[:k], 1)), np.nan)
    return model.components[:k].T * scale, np.array(low, np.int64), rest


def whiten(vectors: DataFrame, k: int | None = 8, id_col: str = "vec_id", vector_col: str = "embedding", d: int | None = None, model: Whitening | None = None) -> tuple[DataFrame, Whitening | None, float | None]:
    """((id_col, whitened array<double>, deviation decimal(38,0)), model, identity_error) with one row per sound
    vector and its first k components, all of them with k None.

    Each entry c becomes floor(1024 c) + 100000. deviation is the exact sum over dimensions of (n x - S)^2, null
    where it has more than 38 digits. identity_error is the largest absolute entry of the whitened covariance minus
    the identity, over components with variance, found by a second pass over all rows.
    Left out of rows and model alike: null or empty vectors, those with a null, NaN or infinite entry or one over
    2^42 in magnitude, and those of another length than d (None: the length that most have). Null and repeated
    ids are kept row by row; every repeat counts. A component without variance (under 1e-13 of the trace: constant
    vectors, a single one, fewer vectors than dimensions) is null in whitened. Equal eigenvalues share a plane,
    whose axes are any. Without a sound vector the result is empty and the model None; a model given is used as it
    is. Only the two columns are read, so others cannot clash."""
    id_type = vectors.select(id_col).schema[0].dataType.simpleString()
    d = d or width(vectors, vector_col)
    model = model or (fit(vectors, d, vector_col) if d else None)
    schema = f"id {id_type}, whitened array<double>, deviation decimal(38,0)"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col), None, None
    k = min(d, k or d)
    rows = vectors.where(_sound(vector_col, d)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    onto, low, rest = _projection(model, k)
    live = ~np.isnan(onto[0])

    def project(x):
        return (x - low - rest) @ onto

    error = None
    if live.any():
        told = _tree(rows, lambda batch: project(_matrix(batch.column(1), d))[:, live], int(live.sum()), False, _step(d))
        error = float(np.abs(told.scatter / told.n - np.eye(int(live.sum()))).max())
    n, sums, step = model.n, model.sums, _step(d)

    def tell(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column(1), d)
                w = project(x)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(deviations(x, n, sums), pa.decimal128(38, 0))], names=["id", "whitened", "deviation"])

    return rows.mapInArrow(tell, schema).withColumnRenamed("id", id_col), model, error


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[decimal.Decimal | None]:
    """Of each row the sum over dimensions of (n x - S)^2, exact; None over 38 digits."""
    low = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    y = x - low
    largest = n * (int(np.abs(y).max(initial=0)) + 1)
    if largest**2 * max(1, x.shape[1]) < 1 << 62:
        told = np.square(n * y - np.array(rest, np.int64)).sum(axis=1).tolist()
    else:
        told = np.square(n * y.astype(object) - np.array(rest, object)).sum(axis=1).tolist()
    return [decimal.Decimal(t) if t < 10**38 else None for t in told]


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """embeddings: vec_id, component, n, deviation, whitened, explained, identity_error; deviation is null where it
    does not fit a long."""
    rows, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    n, shares = (0, []) if model is None else (model.n, [float(v / model.trace) if model.trace > 0 else None for v in model.values[:8]])
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.lit(None).cast("array<double>")
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
