"""Vectors packed into blocks, so that a task multiplies matrices and rows don't travel one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, k: int, rows: int) -> np.ndarray:
    """Row ``k`` of an Arrow column of flat arrays as a matrix of ``rows`` rows."""
    return column[k].values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def vector_blocks(vectors: DataFrame, group: str, keys: tuple[str, ...], size: int = 512) -> DataFrame:
    """(group, n, the keys as arrays, vecs): up to ``size`` vectors of a group a row, packed where they lie, without a shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select(group, *keys, F.col("vec").cast("array<double>").alias("vec"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pc.dictionary_encode(batch.column(0))
            for k in range(len(groups.dictionary)):
                mine = batch.filter(pc.equal(groups.indices, k))
                for begin in range(0, len(mine), size):
                    part = mine.slice(begin, size)
                    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                    lists = [whole(part.column(c)) for c in range(1, len(keys) + 1)]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([len(part)], pa.int32()), *lists, whole(part.column(len(keys) + 1).flatten())], [group, "n", *keys, "vecs"])

    return rows.mapInArrow(work, f"`{group}` {kinds[group]}, n int, " + "".join(f"`{k}` array<{kinds[k]}>, " for k in keys) + "vecs array<double>")


def whole_series(rows: DataFrame, keys: tuple[str, ...], index: str, vec: str) -> DataFrame:
    """(keys, index array, n, vecs): each group's vectors in order of ``index``, flattened, an array a row."""
    item = F.struct(F.col(index).alias("i"), F.col(vec).cast("array<double>").alias("v"))
    per = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("s"))
    return per.select(*keys, F.col("s.i").alias(index), F.size("s").alias("n"), F.flatten("s.v").alias("vecs"))


def stacked(lengths: np.ndarray, vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their series as one array (rows, n, dim)) of the rows of a batch that have equal lengths and dimensions."""
    sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    shapes = np.stack([lengths, sizes], 1)
    for n, size in np.unique(shapes, axis=0).tolist():
        rows = np.flatnonzero((lengths == n) & (sizes == size))
        yield rows, flat[ends[rows][:, None] + np.arange(size)].reshape(len(rows), n, size // n)
