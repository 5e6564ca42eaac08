"""Whitening of embeddings from an exact integer scatter.

Vectors become integers on a grid. Of these, less a shift that keeps them small, every task adds up sums and cross-products without any rounding: numbers are cut into digits whose products
and sums double precision holds exactly, and what they add up to are Python integers, cut again into digits that Spark sums. So n·XᵀX − SSᵀ comes out as exact integers, whatever the order
of rows or tasks and however far the mean is from zero. Only then it is turned to floating point and decomposed. What is gathered depends on the vectors' length, never on how many there are.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of a digit whose products are summed in double precision, and so many rows of them at once: 2 * 20 + 13 bits are exact.
DIGIT, ROWS = 20, 1 << 13
#: Bits of a digit that Spark sums as a long: 2 ** 23 tasks can't overflow it.
PART = 40
#: Matrix entries that a task keeps before it hands them on, and bytes of fitted models that are sent to every task; beyond, they are joined by length.
ENTRIES, MODEL_BYTES = 1 << 22, 64 << 20
#: Larger entries count as not finite: their squares have no place in double precision.
LARGEST = 1e100


def usable(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of lists: the rows with entries, all of them finite; where each begins, how long it is, and all entries as double."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets, np.int64)
    values = column.values
    entries = np.asarray(values.cast(pa.float64()).fill_null(float("nan")), float)
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(entries) <= LARGEST))])
    ok = np.asarray(column.is_valid()) & (bad[off[1:]] == bad[off[:-1]]) & (off[1:] > off[:-1])
    rows = np.flatnonzero(ok)
    return rows, off[rows], off[rows + 1] - off[rows], entries


def on_grid(c: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) for a power of two as scale: 64-bit integers, or Python integers where these are too small."""
    if not c.size or np.abs(c).max() < 2.0**50 / scale:
        return np.floor(c * scale).astype(np.int64)
    whole = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)), 1, 1)
    return whole(c.astype(object))


def _digits(a: np.ndarray, bits: int):
    """(place, digit) of integers of any size, the lowest first: all but the last digit are in [0, 2 ** bits), the last is signed."""
    place = 0
    while a.size and (a.min() < -(1 << (bits - 1)) or a.max() >= 1 << (bits - 1)):
        yield place, a & ((1 << bits) - 1)
        a, place = a >> bits, place + 1
    yield place, a


class Scatter:
    """Exact n, sums and cross-products of integer vectors of one length."""

    def __init__(self, d: int):
        self.n, self.sums, self.cross = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, z: np.ndarray) -> None:
        for at in range(0, len(z), ROWS):
            parts = [(k, p.astype(float)) for k, p in _digits(z[at : at + ROWS], DIGIT)]
            self.n += len(parts[0][1])
            for k, p in parts:
                self.sums += p.sum(axis=0).astype(np.int64).astype(object) << (DIGIT * k)
                for m, q in parts:
                    self.cross += (p.T @ q).astype(np.int64).astype(object) << (DIGIT * (k + m))

    def rows(self, d: int):
        """(length, i, digit's place, values): n as row -2, the sums as row -1, row i of the upper half of the cross-products as i."""
        for i, values in ((-2, np.array([self.n], object)), (-1, self.sums), *((i, self.cross[i, i:]) for i in range(d))):
            for k, v in _digits(values, PART):
                yield d, i, k, v.astype(np.int64).tolist()


def _by_length(length: np.ndarray, begin: np.ndarray, entries: np.ndarray):
    """(which rows, their matrix) for each length."""
    for d in np.unique(length).tolist():
        own = np.flatnonzero(length == d)
        yield d, own, entries[begin[own][:, None] + np.arange(d)]


def scatter(vectors: DataFrame, vector_col: str, scale: int, add: int = 0) -> DataFrame:
    """(length, i, j, k, v): the digits of the exact n, sums and cross-products of all usable vectors floor(scale * c) + add, summed over tasks."""

    def run(batches):
        own: dict[int, Scatter] = {}

        def out():
            table = list(zip(*[r for d, s in own.items() for r in s.rows(d)], strict=True)) or [[]] * 4
            own.clear()
            return pa.RecordBatch.from_arrays([pa.array(table[0], pa.int32()), pa.array(table[1], pa.int32()), pa.array(table[2], pa.int32()), pa.array(table[3], pa.list_(pa.int64()))], names=["length", "i", "k", "values"])

        for batch in batches:
            _, begin, length, entries = usable(batch.column(0))
            for d, _, m in _by_length(length, begin, entries):
                own.setdefault(d, Scatter(d)).add(on_grid(m, scale) + add)
            if sum(d * d for d in own) > ENTRIES:
                yield out()
        yield out()

    parts = vectors.select(vector_col).mapInArrow(run, "length int, i int, k int, values array<long>")
    return parts.select("length", "i", "k", F.posexplode("values").alias("j", "v")).groupBy("length", "i", "j", "k").agg(F.sum("v").alias("v"))


def decompose(n: int, sums: np.ndarray, cross: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues from the largest, their unit vectors as rows, trace) of the covariance (n·XᵀX − SSᵀ) / n², exact up to its turn to double."""
    exact = n * cross - np.outer(sums, sums)
    cov = np.frompyfunc(lambda a: a / (n * n), 1, 1)(exact).astype(float)
    e, v = np.linalg.eigh(cov)
    trace = sum(exact[i, i] for i in range(len(sums))) / (n * n)
    order = np.argsort(-e, kind="stable")[:most]
    noise = trace * len(sums) * np.finfo(float).eps
    return np.where(e[order] > noise, e[order], 0.0), v[:, order].T, trace


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = 1024, offset: int = 0, shift: int | None = None, components: int = 8) -> DataFrame:
    """One row per length of vectors: length, n, sums (exact, as text, of x = floor(scale * c) + offset), parts (components end to end), values (their eigenvalues), trace.

    ``shift``, by default the offset, is subtracted before anything is multiplied and put back into the sums: the covariance doesn't depend on it, but digits do.
    Vectors of different lengths are spaces of their own.  Components without variance have the value 0.  Written, so that all that use it see the same signs.
    """

    less = offset if shift is None else shift

    def run(frames):
        for pdf in frames:
            out = []
            for length, cells in zip(pdf["length"], pdf["cells"], strict=True):
                d = int(length)
                n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
                for c in cells:
                    v = int(c["v"]) << (PART * int(c["k"]))
                    i, j = int(c["i"]), int(c["j"])
                    if i == -2:
                        n += v
                    elif i == -1:
                        sums[j] += v
                    else:
                        cross[i, i + j] += v
                        if j:
                            cross[i + j, i] += v
                values, own, trace = decompose(n, sums, cross, components)
                sums = sums + n * less
                out.append((d, n, [str(s) for s in sums], own.ravel().tolist(), values.tolist(), trace))
            yield pd.DataFrame(out, columns=["length", "n", "sums", "parts", "values", "trace"])

    cells = scatter(vectors, vector_col, scale, offset - less).groupBy("length").agg(F.collect_list(F.struct("i", "j", "k", "v")).alias("cells"))  # about half the square of the length
    model = cells.mapInPandas(run, "length int, n long, sums array<string>, parts array<double>, values array<double>, trace double")
    return common.stage(model, "whitening")


def _squares(dev: np.ndarray):
    """Exact sums of squares of the rows of an integer matrix, as an Arrow decimal column; null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    top = int(np.abs(dev).max()) if dev.size else 0
    if top * top * dev.shape[1] < 1 << 62:
        return pa.array((dev.astype(np.int64) ** 2).sum(axis=1)).cast(kind)
    exact = [sum(int(v) ** 2 for v in row) for row in dev]
    return pa.array([Decimal(x) if x < 10**38 else None for x in exact], kind)


def whitened(vectors: DataFrame, model: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, offset: int = 0) -> DataFrame:
    """(id, length, deviation, w): each usable vector's exact sum of (n·x − S)² over its entries and its whitened coordinates."""
    read = lambda r: (int(r["n"]), np.array([int(s) for s in r["sums"]], object), np.array(r["parts"], float).reshape(len(r["values"]), -1), np.array(r["values"], float))
    size = model.agg(F.sum(F.size("parts") * 8 + F.size("sums") * 48)).first()[0] or 0
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    if size <= MODEL_BYTES:
        fitted = {r["length"]: read(r) for r in model.collect()}
        model_of = lambda d, batch, row: fitted[d]
    else:
        source = source.withColumn("length", F.size("vector")).join(model, "length").select("id", "vector", F.struct("n", "sums", "parts", "values").alias("model"))
        model_of = lambda d, batch, row: read(batch.column(2)[row].as_py())

    def run(batches):
        for batch in batches:
            rows, begin, length, entries = usable(batch.column(1))
            for d, own, m in _by_length(length, begin, entries):
                n, sums, parts, values = model_of(d, batch, int(rows[own[0]]))
                x = on_grid(m, scale) + offset
                top = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
                dev = n * x - sums.astype(np.int64) if top < 1 << 62 and x.dtype != object else n * x.astype(object) - sums
                root = np.sqrt(values)
                flat = np.frompyfunc(lambda v: v / n, 1, 1)(dev).astype(float) if dev.dtype == object else dev / n
                w = np.divide(flat @ parts.T, root, out=np.zeros((len(own), len(root))), where=root > 0)
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(root))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[own])), pa.array(np.full(len(own), d, np.int32)), _squares(dev), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "length", "deviation", "w"])

    return source.mapInArrow(run, "id long, length int, deviation decimal(38,0), w array<double>")


def _identity_error(rows: DataFrame, components: int) -> DataFrame:
    """(length, rank, identity_error): how far the covariance of whitened coordinates, centred before multiplying, is from the identity, over components that have variance."""
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    at = lambda i: F.get("w", F.lit(i))
    cov = rows.groupBy("length").agg(*[F.covar_pop(at(a), at(b)).alias(f"c{a}_{b}") for a, b in pairs], *[F.count_if(at(a) != 0).alias(f"n{a}") for a in range(components)])
    off = [F.when((F.col(f"n{a}") > 0) & (F.col(f"n{b}") > 0), F.abs(F.col(f"c{a}_{b}") - float(a == b))) for a, b in pairs]
    return cov.select("length", F.coalesce(F.array_max(F.array(*off)), F.lit(0.0)).alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, offset: int = 0, components: int = 8) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation (decimal), whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries have no rows and don't count in the fit.  Entries become x = floor(scale * c) + offset, scale a power of two; S and n are
    the sums of x and how many vectors there are.  Of vectors shorter than ``components`` there are as many components as entries.  A component without variance has whitened and
    explained 0 and no part in identity_error.  Vectors of different lengths are fitted each with their own kind.  Rows that repeat an id, or have none, are rows of their own.  An
    empty table gives no rows.  A deviation beyond 38 digits is null.  Other columns are ignored, whatever their names.
    """
    model = fit(vectors, vector_col, scale, offset, components=components)
    rows = common.stage(whitened(vectors, model, id_col, vector_col, scale, offset), "whitened")
    share = F.transform("values", lambda e: F.when(F.col("trace") > 0, e / F.col("trace")).otherwise(0.0))
    facts = common.stage(model.select("length", "n", share.alias("explained")).join(_identity_error(rows, components), "length"), "facts")  # a row for each length
    out = rows.join(facts, "length").select("id", "n", "deviation", "explained", "identity_error", F.posexplode("w").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
