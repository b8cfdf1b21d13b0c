"""Shared plumbing of the training-data operators.

Nothing here keeps state between calls, but for the one object that ``held`` keeps
in a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, NumericType

from kinfold.functions.groups import runs
from kinfold.operators.graph import components
from kinfold.sources.scratch import cut, release, shared_dir, stored, temporary

__all__ = ["batches", "components", "cut", "dense", "fit_logistic", "held", "keep_rows", "key_of", "let_go", "matrix", "release", "remainder", "runs", "shared_dir", "stored", "sums", "table", "temporary", "unused", "usable"]

#: Rows of one Arrow batch handed back by the operators below; texts can be long.
OUT_ROWS = 256


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """The object ``name`` of this Python worker, made where the worker lacks it.

    A worker holds one at a time, so what the operators remember for speed (memos,
    tokenizers) does not add up in a worker that serves stage after stage.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Forget what this Python worker holds for another operator."""
    _HELD.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def remainder(column: str, modulus: int) -> F.Column:
    """crc32 of a column as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def key_of(df: DataFrame, columns: list[str]) -> F.Column:
    """A 128-bit key of the values of ``columns``, nulls included; rows with equal
    keys are equal in them (but for one chance in 2 ** 128 a pair)."""
    parts = []
    for c in columns:
        quoted = F.col(f"`{c.replace('`', '``')}`")
        value = quoted if isinstance(df.schema[c].dataType, (AtomicType, NumericType)) else F.to_json(F.struct(quoted))
        parts += [quoted.isNull(), value]
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(0x9E3779B9), *parts[::-1]).alias("y"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it as many as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` for which ``judge`` says so, with all their columns.

    ``judge()`` is called once per task and gives a function from an Arrow batch
    to a list of booleans. Texts stay where they are: no shuffle.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for f in frames:
            kept = f.filter(pa.array(decide(f), pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)


def sums(df: DataFrame, partial, columns: str = "k long, v double") -> dict[int, float]:
    """Sum sparse vectors over all partitions.

    ``partial`` takes an iterator of pandas frames and yields ``(index array,
    value array)`` pairs for one partition. Spark adds them up by index; what
    comes to the driver is as long as the vector, whatever the input's size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for index, values in partial(frames):
            if len(index):
                yield pd.DataFrame({"k": np.asarray(index, np.int64), "v": np.asarray(values, np.float64)})

    rows = df.mapInPandas(run, columns).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    return dict(zip(rows["k"].tolist(), rows["v"].tolist(), strict=True))


def dense(found: dict[int, float], size: int) -> np.ndarray:
    out = np.zeros(size)
    if found:
        out[np.fromiter(found.keys(), np.int64, len(found))] = np.fromiter(found.values(), np.float64, len(found))
    return out


def fit_logistic(rows: DataFrame, x: str, y: str, weight: str, size: int, l2: float = 1.0, rounds: int = 6, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression over all of ``rows`` by Newton steps.

    Each step sums the gradient and the Hessian (``size`` squared numbers) over
    the partitions; rows stay where they are. ``x`` is an array column with the
    constant 1 included, ``y`` a target in 0..1, ``weight`` a row weight.
    """
    w = np.zeros(size) if start is None else start.astype(float).copy()
    upper = np.triu_indices(size)
    for _ in range(rounds):
        at = w.copy()

        def partial(frames, at=at):
            gradient, hessian = np.zeros(size), np.zeros((size, size))
            for f in frames:
                if not len(f):
                    continue
                m = np.stack(f[x].to_numpy()).astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip(m @ at, -30, 30)))
                g = f[weight].to_numpy(float)
                gradient += m.T @ (g * (f[y].to_numpy(float) - p))
                hessian += m.T @ (m * (g * p * (1 - p))[:, None])
            values = np.concatenate([gradient, hessian[upper]])
            yield np.arange(len(values)), values

        got = dense(sums(rows.select(x, y, weight), partial), size + len(upper[0]))
        gradient, hessian = got[:size] - l2 * at, np.zeros((size, size))
        hessian[upper] = got[size:]
        hessian = hessian + np.triu(hessian, 1).T + l2 * np.eye(size)
        step = np.linalg.solve(hessian, gradient)
        w = at + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def usable(vector: str) -> F.Column:
    """Whether an array column is a vector: not null, not empty, not zero, and
    without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray, code: str = "<f8") -> np.ndarray:
    """Rows of equally long vectors of numbers of kind ``code``, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), code).reshape(len(column), -1).astype(float)
