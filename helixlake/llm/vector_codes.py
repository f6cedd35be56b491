"""Product codes of vectors by Lloyd's rounds that compare only what moved.

A vector is cut into equal parts of integers, and each part position has a codebook.  Per
part a task stores the nearest entry and the exact squared distance to it.  In the next round
a part whose entry stayed where it was compares only the entries that moved with that stored
distance: entries that didn't move can't have come closer.  Other parts are compared
with all entries.  Of equal distances the lower index counts, the stored entry's included, so
codes are those of a full comparison.

Each round is one pass: a task writes its vectors with new codes and distances and, as the
last rows, its sums per part and entry, a fixed number of them.  What reaches the driver is the
codebooks and those sums added up, parts x entries rows whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import discard, stored, table

#: Scaled components are held between -MOST and MOST, so that sums of squares fit 64 bits.
MOST = 1 << 27
_STATE = "vec_id bigint, label {}, ints array<int>, code binary, distance array<bigint>, part int, entry int, n bigint, sums array<bigint>"
_NAMES = ["vec_id", "label", "ints", "code", "distance", "part", "entry", "n", "sums"]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of ``entries``."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - entries[None, :, k]
        gap *= gap
        out += gap
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry, the lower index on ties."""
    far = distances(x, entries)
    code = far.argmin(1)
    return code, far[np.arange(len(x)), code]


def renew(x: np.ndarray, code: np.ndarray, far: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` from an earlier round's result, and the number of distances computed; ``moved`` flags changed entries."""
    code, far = code.copy(), far.copy()
    free = moved[code]
    active = np.flatnonzero(moved)
    fixed = np.flatnonzero(~free)
    if len(active) and len(fixed):
        best, d = nearest(x[fixed], entries[active])
        best = active[best]
        better = (d < far[fixed]) | ((d == far[fixed]) & (best < code[fixed]))
        code[fixed[better]], far[fixed[better]] = best[better], d[better]
    if free.any():
        code[free], far[free] = nearest(x[free], entries)
    return code, far, len(fixed) * len(active) + int(free.sum()) * len(entries)


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), size):
            yield batch.slice(k, size)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _assign(books: np.ndarray, moved: np.ndarray | None, last: bool, size: int = 4096):
    """A task's pass: ``books`` (parts, entries, width); ``moved`` flags per part and entry, None in the first round."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _rows(batches, size):
            x = _matrix(batch.column(2), parts * width, np.int64)
            code, far = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
            if moved is not None:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                known = _matrix(batch.column(4), parts, np.int64)
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                if moved is None:
                    code[:, p], far[:, p] = nearest(mine, books[p])
                else:
                    code[:, p], far[:, p], _ = renew(mine, old[:, p], known[:, p], books[p], moved[p])
                if not last:
                    count[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(sums[p], code[:, p], mine)
            codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])
                continue
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts)
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), codes, pa.ListArray.from_arrays(ends, pa.array(far.ravel())), *none], _NAMES)
        if not last and count.any():
            p, e = np.nonzero(count)
            none = [pa.nulls(len(p), t) for t in (pa.int64(), batch.column(1).type, pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))]
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*none, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.ListArray.from_arrays(ends, pa.array(sums[p, e].ravel()))], _NAMES)

    return work


def scaled(vector: Column, scale: int = 256) -> Column:
    """Components as integers floor(scale * x); null where the vector is null or empty or holds null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(float(MOST))), F.lit(float(-MOST))).cast("int"))
    return F.when(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0), held)


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame | None, np.ndarray, list[np.ndarray]]:
    """(rows with the codes of the last assignment before the final one, final codebooks, moved flags) of rows (vec_id, label, ints)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()  # the codebooks' first entries
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    label = rows.schema["label"].dataType.simpleString()
    moved, done = None, []
    for _ in range(rounds):
        state = stored(rows.mapInArrow(_assign(books, moved, False), _STATE.format(label)), "codes")
        width = books.shape[2]
        added = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
        new = books.copy()
        for r in state.filter("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts x entries rows
            new[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
        moved, books = (new != books).any(2), new
        done.append(state)
        rows = state.filter("part IS NULL").select(*_NAMES[:5])
        if len(done) > 1:
            discard(done[-2])
    return rows, books, moved


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of all kept vectors, stored, and the codebooks (parts, entries, width) of integers.

    Vectors that are null or empty, or that hold null or non-finite components, are dropped, and
    so are those of another length than the kept vector with the smallest id (the shorter one
    where ids repeat), or of a length that ``parts`` doesn't divide.  The codebooks begin with
    the ``entries`` kept vectors of smallest id: null ids come last, of repeated ids the
    vector smaller in order of components first.  With fewer vectors there are as many entries as
    vectors.  A component beyond MOST / ``scale`` counts as that.  Repeated rows count as
    often as they stand.  Other columns are ignored, whatever their names.  No rows in, no
    rows out, and codebooks without entries.  ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), scaled(F.col(vector), scale).alias("ints"))
    rows = rows.filter(F.col("ints").isNotNull() & (F.size("ints") % parts == 0))
    least = rows.select("vec_id", F.size("ints").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").limit(1).collect()
    if not least:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    state, books, moved = train(rows.filter(F.size("ints") == least[0].n), parts, entries, rounds)
    codes = stored(state.mapInArrow(_assign(books, moved, True), f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code binary, error bigint"), "codes")
    if rounds:
        discard(state)
    return codes, books


def decoded(code: Column, books: np.ndarray, scale: int = 256) -> Column:
    """The vectors that codes stand for, as array<double>."""

    @F.arrow_udf("array<double>")
    def look_up(codes: pa.Array) -> pa.Array:
        parts, _, width = books.shape
        at = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, parts)
        flat = books[np.arange(parts), at].reshape(len(at), -1) / scale
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * parts * width), pa.array(flat.ravel()))

    return look_up(code)


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: ``error`` summed over rows of equal label, null labels together; null where it exceeds 64 bits.

    Sums are combined before the shuffle; there is a row per label to join, which Spark sends to
    all tasks if it is small and otherwise merges, splitting a hot label's rows.
    """
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignment a{n} by the codebooks b{n}, and the codebooks after it."""
    return f"""
      d{n} AS (SELECT c.row, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN b{n} b USING (part, pos) GROUP BY ALL),
      a{n} AS (SELECT row, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY row, part ORDER BY d, entry) AS k FROM d{n}) WHERE k = 1),
      m{n} AS (SELECT part, pos, entry, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM cells JOIN a{n} USING (row, part) GROUP BY ALL),
      b{n + 1} AS (SELECT part, pos, entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (part, pos, entry))"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {
    "op12_vector_codes": f"""
      WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding FROM embeddings
                    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      cells AS (SELECT row, CAST(i // 4 AS INTEGER) AS part, CAST(i % 4 AS INTEGER) AS pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
                FROM (SELECT row, unnest(embedding) AS x, unnest(range(64)) AS i FROM kept)),
      b0 AS (SELECT part, pos, row - 1 AS entry, x FROM cells WHERE row <= 64),{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
      codes AS (SELECT row, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
             (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
      FROM codes JOIN kept USING (row)"""
}
