"""Packing token ids into sequences of fixed length by cutting-stock column generation.

Documents are encoded and cut at multiples of the sequence length; the last piece of each
is what has to be packed.  Short pieces of equal length are first taken together in bundles that
fill their bin, or nearly so.  The lengths of all items form a histogram of fixed width.  A
linear program over patterns (which bins a sequence holds, how often) is solved by column
generation: the master's dual values price the bins, a knapsack dynamic program finds the
best new pattern, until none improves.  Patterns are rounded down, the few pieces left are
packed first-fit decreasing, and every bin's pieces, ranked, are dealt to the pattern
places of their bin.  The histogram and the patterns have a fixed size, whatever the
input; ranks, sequence numbers and offsets are computed by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.llm.common import running_start, stored, table, text_or_empty
from helixlake.llm.encoding import chunks, encoder

_PIECES = "row bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, text: str = "text", doc_id: str = "doc_id", drops_space: bool = True, with_ids: bool = False) -> DataFrame:
    """Encodes every document, adds ``end_id`` and cuts at multiples of ``capacity``.

    Columns: row (number of the input row), doc_id, start, length, ids_crc32, doc_tokens
    and, if asked for, ids.  Null and empty texts give one piece with the end id alone;
    repeated rows and null ids are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for begin, end in chunks(texts):
                tokens, sizes = encoder(vocabulary, drops_space).batch(texts[begin:end], end_id)
                data, at = memoryview(tokens.astype("<u4").tobytes()), 0
                out: list[tuple] = []
                for k, n in zip(range(begin, end), sizes.tolist(), strict=True):
                    for s in range(0, n, capacity):
                        m = min(capacity, n - s)
                        part = data[4 * (at + s) : 4 * (at + s + m)]
                        out.append((rows[k], ids[k], s, m, zlib.crc32(part), n, *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                    at += n
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[6:]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


def best_pattern(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of bins 1 .. len(values) within ``room`` units."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        m = min(c, len(values))
        gain = best[c - m : c][::-1] + values[:m]  # bin b (b units) leaves c - b
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values)), room
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[room]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss and Jordan's steps; array operations only, which no thread pool of a linear algebra library takes up."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def column_generation(demand: np.ndarray, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional numbers for the cutting-stock program.

    ``demand[b - 1]`` pieces of b units have to go into sequences of len(demand) units.
    Starts from patterns of one bin each; revised simplex with a fixed number of rows.
    """
    room, need = len(demand), np.flatnonzero(demand > 0)
    if not len(need):
        return []
    each = (room // (need + 1)).astype(float)
    basis, inverse, amount = np.diag(each), np.diag(1 / each), demand[need] / each
    for step in range(most):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(room)
        values[need] = np.maximum(duals, 0)
        worth, pattern = best_pattern(values, room)
        if worth <= 1 + 1e-7:
            break
        entering = pattern[need]
        change = (inverse * entering).sum(axis=1)
        ok = change > 1e-9
        ratio = np.full(len(need), np.inf)
        ratio[ok] = amount[ok] / change[ok]
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * change, 0)
        amount[out] = ratio[out]
        basis[:, out] = entering
        row = inverse[out] / change[out]
        inverse -= change[:, None] * row
        inverse[out] = row
        if step % 200 == 199:  # rounding errors add up
            inverse = inverted(basis)
            amount = np.maximum((inverse * demand[need]).sum(axis=1), 0)
    out = []
    for j, x in enumerate(amount):
        whole = np.zeros(room)
        whole[need] = basis[:, j]
        out.append((whole, float(x)))
    return out


def rounded(demand: np.ndarray, patterns: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold ``demand`` exactly: rounded down, cut to what is there, the rest first-fit."""
    left, out, room = demand.astype(np.int64).copy(), [], len(demand)
    for pattern, x in patterns:
        p = pattern.astype(np.int64)
        used = p > 0
        n = min(int(np.floor(x + 1e-6)), int((left[used] // p[used]).min()) if used.any() else 0)
        if n > 0:
            out.append((p, n))
            left -= n * p
    space: list[int] = []
    rest: list[np.ndarray] = []
    for b in range(room, 0, -1):  # the largest first; no more than a pattern's worth per bin is left
        for _ in range(int(left[b - 1])):
            k = next((i for i, s in enumerate(space) if s >= b), None)
            if k is None:
                space.append(room)
                rest.append(np.zeros(room, np.int64))
                k = len(space) - 1
            space[k] -= b
            rest[k][b - 1] += 1
    return out + [(p, 1) for p in rest]


def places(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per bin, ranges of ranks: (first rank, first sequence, pieces of the bin per sequence)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for pattern, n in plan:
        for b in np.flatnonzero(pattern):
            each = int(pattern[b])
            out.setdefault(int(b) + 1, []).append((given.get(int(b) + 1, 0), first, each))
            given[int(b) + 1] = given.get(int(b) + 1, 0) + each * n
        first += n
    return {b: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for b, rows in out.items()}


def bundle_size(length: int, unit: int, most: int) -> int:
    """How many pieces of ``length`` tokens lose least when together they are rounded up to units, with ``most`` tokens at most; the fewest of these."""
    lost = lambda m: -(-m * length // unit) * unit / (m * length)
    return min(range(1, max(1, most // length) + 1), key=lambda m: (round(lost(m), 9), m))


def item_ranks(counts: dict[int, int], unit: int, short: int, most: int) -> tuple[dict[int, tuple[int, ...]], dict[int, int]]:
    """How a class's pieces become items of the bins, and the number of items per bin.

    A class is a length up to ``short``, or minus the bin of longer pieces.  Per class:
    (pieces in bundles, pieces per bundle, bin of a bundle, rank of its first bundle in the bin,
    bin of a single piece, rank of its first single piece in the bin).
    """
    held: dict[int, int] = {}
    out = {}

    def take(b: int, n: int) -> int:
        held[b] = held.get(b, 0) + n
        return held[b] - n

    for c, n in sorted(counts.items()):
        m = bundle_size(c, unit, most) if 0 < c <= short else 1
        whole = n // m if m > 1 else 0
        bundle, single = -(-m * c // unit) if c > 0 else -c, -(-c // unit) if c > 0 else -c
        out[c] = (whole * m, m, bundle, take(bundle, whole), single, take(single, n - whole * m))
    return out, held


def pack(pieces: DataFrame, capacity: int = 4096, bins: int = 256) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``capacity`` tokens (columns row, start, length, any others).

    A sequence's pieces follow one another from offset 0 without a gap.  Pieces of up to eight
    units are bundled by length, so that little is lost by rounding to units.  Pieces are read
    three times, so pass a stored table.  No pieces in, none out.
    """
    unit = -(-capacity // bins)
    short, most = 8 * unit, max(8 * unit, capacity // 8)
    class_ = F.when(F.col("length") <= short, F.col("length")).otherwise(-F.ceil(F.col("length") / unit)).cast("int")
    classed = pieces.withColumn("_class", class_).withColumn("_one", F.lit(1))
    counts = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # a row per short length or bin
    items, held = item_ranks(counts, unit, short, most)
    demand = np.array([held.get(b, 0) for b in range(1, bins + 1)], np.float64)
    where = places(rounded(demand, column_generation(demand)))
    ranked = running_start(classed, ["_class"], [F.col("row"), F.col("start")], "_one", "_rank")

    columns = list(pieces.columns)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = np.array(batch.column(batch.schema.get_field_index("_class")))
            rank = np.array(batch.column(batch.schema.get_field_index("_rank")))
            seq, at, place = (np.zeros(len(rank), np.int64) for _ in range(3))
            for c in np.unique(classes):
                bundled, m, bundle, first_bundle, single, first_single = items[int(c)]
                mine = classes == c
                r = rank[mine]
                at[mine] = np.where(r < bundled, bundle, single)
                place[mine] = np.where(r < bundled, first_bundle + r // m, first_single + r - bundled)
            for b in np.unique(at):
                mine = at == b
                first, sequence, each = where[int(b)]
                k = np.searchsorted(first, place[mine], "right") - 1
                seq[mine] = sequence[k] + (place[mine] - first[k]) // each[k]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq)], [*columns, "sequence_id"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    seated = ranked.select(*pieces.columns, "_class", "_rank").mapInArrow(seat, f"{kinds}, sequence_id bigint")
    order = W.partitionBy("sequence_id").orderBy("row", "start").rowsBetween(W.unboundedPreceding, -1)  # ``capacity`` pieces at most
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, bins: int = 256, **options) -> DataFrame:
    """Encodes, cuts and packs documents; a row per piece, with sequence_id and offset."""
    pieces = stored(token_pieces(docs, vocabulary, end_id, capacity, **options), "pieces")
    return pack(pieces, capacity, bins)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2).drop("row")


QUERIES = {"op1_pack_sequences": op1_pack_sequences}
ORACLE: dict[str, str] = {}
